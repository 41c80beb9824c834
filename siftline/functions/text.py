"""Column -> Column text functions; all stay inside the JVM.

Null text gives null (or the stated default). Lengths and positions are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CJK = r"一-鿿"


def tokens(text: Column) -> Column:
    """Each CJK character, and each run of two or more of a-z and 0-9, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{CJK}]|[a-z0-9]{{2,}}"), F.lit(0))


#: White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(WHITE))


def squeezed(text: Column) -> Column:
    """White space (of Unicode) collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def replaced_characters(text: Column) -> Column:
    """Private-use bullets, quotes, dashes and wide spaces as plain characters; then
    control, zero-width, bidi and format characters dropped."""
    plain = F.translate(text, fixed.REPLACED_FROM, fixed.REPLACED_TO)
    return F.regexp_replace(plain, f"[{fixed.DROPPED}]", "")


def normalised(text: Column) -> Column:
    """For comparison: lower case, punctuation and white space as single spaces."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), f"[{fixed.PUNCTUATION}]", " "))


def grams(text: Column, n: int = 5) -> Column:
    """The set of character n-grams; empty for shorter texts. One pass of a pattern
    that looks n characters ahead: substrings by position would cost the square of a
    text's length."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements of two sets over the larger set; 0 if one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def edit_ratio(a: Column, b: Column, most: int = fixed.COMPARED_CHARS) -> Column:
    """1 - edits / longer length over the first ``most`` characters; the ratio of
    lengths where the shorter text lies in the longer; 0 if one is empty."""
    swap = F.length(a) > F.length(b)
    x, y = F.substring(F.when(swap, b).otherwise(a), 1, most), F.substring(F.when(swap, a).otherwise(b), 1, most)
    n, m = F.length(x), F.length(y)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).when(y.contains(x), n / m).otherwise(1 - F.levenshtein(x, y) / F.greatest(n, m))


def lexical_overlap(chunk: Column, query: Column) -> Column:
    """0.7 of the share of the query's CJK characters and 0.3 of its words that the chunk has."""
    sets = lambda t, p: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(p), F.lit(0)))
    share = lambda p: F.size(F.array_intersect(sets(chunk, p), sets(query, p))) / (F.size(sets(query, p)) + 0.001)
    return F.when((F.length(chunk) == 0) | (F.length(query) == 0) | chunk.isNull() | query.isNull(), F.lit(0.0)).otherwise(0.7 * share(f"[{CJK}]") + 0.3 * share("[a-z0-9]+"))


def context(text: Column, keyword: Column, window: int, absent: Column | None = None) -> Column:
    """Text about the first occurrence of a keyword, with dots where it is cut;
    ``absent`` (by default empty) if there is none."""
    at = F.position(keyword, text)
    begin, end = F.greatest(F.lit(1), at - window), F.least(F.length(text), at + F.length(keyword) - 1 + window)
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.lit("") if absent is None else absent)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 for other lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def redacted(text: Column) -> Column:
    """Keys, passwords, tokens and authorisation headers masked."""
    for pattern in fixed.SECRETS:
        text = F.regexp_replace(text, pattern, "$1***REDACTED***")
    return text


def plain_markdown(text: Column) -> Column:
    """Inline Markdown as plain text."""
    for pattern, put in fixed.MARKDOWN:
        text = F.regexp_replace(text, pattern, put)
    return text


def list_markers(text: Column) -> Column:
    """Star list items as dash items; lines of white space as empty lines."""
    def line(x: Column) -> Column:
        t = F.trim(x)
        return F.when(t == "", "").when(t.startswith("* "), F.concat(F.lit("- "), F.substring(t, F.lit(3), F.length(t)))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def is_header_or_footer(line: Column) -> Column:
    """Page numbers, running titles, notices: what a page repeats around its text."""
    t = stripped(line)
    # the anchor before the alternation keeps the matcher from trying every position
    patterns = "^(?:" + "|".join(f"(?:{p})" for p in fixed.HEADER_LINES) + ")"
    return (t != "") & (t.rlike(patterns) | ((F.length(t) < 8) & t.rlike(r"^[\d\s\-=/\\|]+$")))


def is_advert(text: Column, whole_words: bool = False) -> Column:
    """Whether an advert or navigation keyword occurs, as a substring or (English
    ones) as a word; texts under five characters never are."""
    low = F.lower(text)
    if whole_words:
        ascii_words = "|".join(w.lower() for w in fixed.ADVERT_WORDS if w.isascii())
        hit = low.rlike(rf"\b(?:{ascii_words})\b") | low.rlike("|".join(w for w in fixed.ADVERT_WORDS if not w.isascii()))
    else:
        hit = F.exists(F.array(*(F.lit(w.lower()) for w in fixed.ADVERT_WORDS)), lambda w: F.contains(low, w))
    return (F.length(F.trim(text)) >= 5) & hit


def parsed_number(text: Column) -> Column:
    """Digits, dots and signs as a number; null where they are none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(0.01))
