"""Personal data in texts, plain and disguised, with offsets into the source.

Base matches are those of the four plain patterns (email, ip, card, phone). For
disguised ones, transducers rewrite a copy of the text and carry for every
character of the copy the stretch of the source it stands for: homoglyphs and
compatibility characters become ASCII and invisible characters vanish, runs of
spelled digits become digits, and disguises of ``@`` and ``.`` become those. The
same patterns run over the copy, and what they find is mapped back; a match is
added where it overlaps no base match.

Digits are rewritten where at least four in a row are spelled, or where spelled and
plain ones together are nine or more. An ``at`` in bare words counts if a dot of the
same language is disguised too and a known ending follows; or, with any ending and a
plain dot too, if what stands before it looks like an address (a digit, dot, hyphen
or underscore in it) or a word like "mail" or "contact" comes shortly before. So "look
at example.com" and "at this point in time" stay. Offsets are code points of the source,
ends exclusive.

Null texts count as empty. Texts are searched whole, in time linear in their
length. Equal rows give equal results; an empty table gives an empty one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern: from each ``@`` back over the local
    part, but not into an earlier match."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if begin < at else None
        done = at + 1
        if found:
            done = found.end()
            out.append((begin, done))
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Characters that look like ASCII ones and have no compatibility form.
LOOKALIKES = dict(
    zip(
        "аеорсухіїјѕһԁԛԝԍвнкмтзАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ‐‑‒–—―−﹣∙。｡",
        "aeopcyxiijshdqwgbhkmt3ABEKMHOPCTYXIJSaeikvoptuxABEZHIKMNOPTYXiag--------...",
        strict=True,
    )
)
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff"
# Digits 0 to 9 in words.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
# At and the dots that go with it, by language; plus.
AT_DOTS = {"at": "dot punkt", "arobase": "dot point", "arroba": "dot punto"}
PLUS_WORDS = "plus"
# Words that announce an address.
CUES = "mail email e-mail mailto contact contacts kontakt contacto correo courriel adresse address write schreib escribe écris reach"
# Endings of domains that a disguise in bare words must have.
ENDINGS = "com org net edu gov mil int info biz name io co ai app dev me tv de fr es uk eu us ca ch at it nl be pt se no fi pl ru jp cn in br mx au example test"


def _character_map() -> dict[int, str]:
    out = {}
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F130)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and 32 <= ord(plain) < 127:
            out[code] = plain
        elif unicodedata.category(c) == "Nd":
            out[code] = str(unicodedata.decimal(c))
    return out | {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}


CHARACTERS = _character_map()
_VALUE = {w: str(d) for line in DIGIT_WORDS for d, w in enumerate(line.split())} | {"oh": "0"}
_NUMBER = "|".join(sorted(_VALUE, key=len, reverse=True))
_DOTS = sorted({d for dots in AT_DOTS.values() for d in dots.split()})
_DOT, _AT = "|".join(_DOTS), "|".join(AT_DOTS)
_SPELLED = re.compile(rf"(?<![^\W_])(?:{PLUS_WORDS}[ \-,]+)?(?:{_NUMBER}|[0-9]+)(?:(?:[ ,]{{1,3}}|-)(?:{_NUMBER}|{_DOT}|[0-9]+))+(?![^\W_])", re.I)
_SPELLED_TOKEN = re.compile(r"[^\W_]+")
_BRACKETED_AT = re.compile(rf"[ ]{{0,3}}[\[({{<][ ]{{0,3}}(?:{_AT}|@)[ ]{{0,3}}[\])}}>][ ]{{0,3}}", re.I)
_BRACKETED_DOT = re.compile(rf"[ ]{{0,3}}[\[({{<][ ]{{0,3}}(?:{_DOT}|\.)[ ]{{0,3}}[\])}}>][ ]{{0,3}}", re.I)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ ]{{1,3}}({_DOT})[ ]{{1,3}}|[ ]\.[ ])(?=[A-Za-z0-9])", re.I)
#: Stand for a dot that a spaced dot or each of the words disguised until the at is
#: settled, and for an at that what is before it makes sure.
_SPACED, _SURE = "\ue000", "\ue001"
_WORD_DOT = {d: chr(0xE002 + k) for k, d in enumerate(_DOTS)}
_BARE = _SPACED + "".join(_WORD_DOT.values())
_ENDS = rf"(?:[A-Za-z0-9-]+[.{_BARE}])+(?:{'|'.join(ENDINGS.split())})(?![A-Za-z0-9-])"
_ANY_END = rf"(?:[A-Za-z0-9-]+[.{_BARE}])+[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"
_BARE_AT = re.compile(
    "|".join(rf"(?<=[A-Za-z0-9])[ ]{{1,3}}{at}[ ]{{1,3}}(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*[{_SPACED}{''.join(_WORD_DOT[d] for d in dots.split())}])(?={_ENDS})" for at, dots in AT_DOTS.items())
    + rf"|(?<=[A-Za-z0-9])[ ]{{1,3}}@[ ]{{0,3}}(?={_ENDS})|@[ ]{{1,3}}(?={_ENDS})",
    re.I,
)
_SURE_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]{{1,3}}(?:{_AT})[ ]{{1,3}}(?={_ANY_END})", re.I)
_CUE = re.compile(rf"(?<![^\W_])(?:{'|'.join(CUES.split())})(?![^\W_])[^.!?\n]{{0,30}}$", re.I)
_PLAIN = dict.fromkeys(map(ord, _BARE), ".") | {ord(_SURE): "@"}


class Copy:
    """A rewritten text; start and end: the source's stretch of each character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, put: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> None:
        """Put (characters, begin, end in the present text) for each match."""
        pieces, start, end, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = put(m)
            if new is None:
                continue
            pieces.append(self.text[done : m.start()])
            start += self.start[done : m.start()]
            end += self.end[done : m.start()]
            for c, a, b in new:
                pieces.append(c)
                start += [self.start[a]] * len(c)
                end += [self.end[b - 1]] * len(c)
            done = m.end()
        if done:
            pieces.append(self.text[done:])
            self.text, self.start, self.end = "".join(pieces), [*start, *self.start[done:]], [*end, *self.end[done:]]

    def characters(self) -> None:
        if any(c in self.text for c in INVISIBLE):
            keep = [k for k, c in enumerate(self.text) if c not in INVISIBLE]
            self.start, self.end = [self.start[k] for k in keep], [self.end[k] for k in keep]
        self.text = self.text.translate(CHARACTERS)  # what doesn't vanish stays one character

    def source(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    out, spelled, digits = [], 0, 0
    for t in _SPELLED_TOKEN.finditer(m.group()):
        word, begin = t.group().lower(), m.start() + t.start()
        if word[0].isdigit():
            out += [(c, begin + k, begin + k + 1) for k, c in enumerate(word)]
            digits += len(word)
            continue
        out.append((_VALUE.get(word, "+" if word == PLUS_WORDS else "."), begin, begin + len(word)))
        spelled += word in _VALUE
    return out if spelled >= 4 or (spelled and spelled + digits >= 9) else None


def _dot(m: re.Match) -> list[tuple[str, int, int]]:
    return [(_WORD_DOT[m[1].lower()] if m[1] else _SPACED, m.start(), m.end())]


def _sure(m: re.Match) -> list[tuple[str, int, int]] | None:
    before = m.string[max(0, m.start() - 100) : m.start()]
    local = before[len(before.rstrip(_LOCAL)) :]
    if any(not c.isalpha() for c in local[1:-1]) or local[-1:].isdigit() or _CUE.search(before[: len(before) - len(local)]):
        return [(_SURE, m.start(), m.end())]
    return None


def normalised(text: str) -> Copy:
    """The copy on which disguised matches are looked for."""
    copy = Copy(text)
    copy.characters()
    whole = lambda c: lambda m: [(c, m.start(), m.end())]
    copy.rewrite(_SPELLED, _digits)
    copy.rewrite(_BRACKETED_DOT, whole("."))
    copy.rewrite(_BRACKETED_AT, whole("@"))
    copy.rewrite(_BARE_DOT, _dot)
    copy.rewrite(_BARE_AT, whole("@"))
    copy.rewrite(_SURE_AT, _sure)
    return copy


_BARE_DOMAIN = re.compile(rf"@{_ENDS}", re.I)
_ANY_BARE = re.compile(f"[{_BARE}]")


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Matches of the rewritten copy, mapped back, that overlap no base match."""
    copy = normalised(text)
    dotted = copy.text.translate(_PLAIN)
    if dotted == text:
        return {}
    taken = sorted(s for spans in base.values() for s in spans)
    out: dict[str, list[Span]] = {}
    for kind, find in FINDERS.items():
        for span in find(dotted):
            if kind == "email" and _ANY_BARE.search(copy.text, *span):
                at = dotted.index("@", span[0])
                if copy.text[at] != _SURE and not _BARE_DOMAIN.match(copy.text, at):
                    continue  # a bare word made the dot, but no domain ends there
            a, b = copy.source(span)
            if text[a:b] != dotted[slice(*span)] and not any(x < b and a < y for x, y in taken):
                out.setdefault(kind, []).append((a, b))
    return out


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base matches, added matches) by kind."""
    base = {}
    if "@" in text:
        base["email"] = emails(text)
    if _ANY_DIGIT.search(text):
        base |= {k: FINDERS[k](text) for k in KINDS[1:]}
    return base, disguised(text, base)


_ANY_DIGIT = re.compile("[0-9]")
_CLASS = "".join(f"\\x{{{c:x}}}" for c in sorted(CHARACTERS))
#: What a text needs for any match, in RE2's spelling: a base character, a
#: character to rewrite, a bracketed disguise, bare words for at and dot, or spelled digits.
TRIGGER = rf"[@0-9]|[{_CLASS}]|(?i:[\[({{<][ ]{{0,3}}(?:{_AT}|{_DOT}|\.)[ ]{{0,3}}[\])}}>]|(?:^|[^\pL])(?:{_NUMBER})[ ,-]{{1,3}}(?:{_NUMBER}|{_DOT})(?:[^\pL]|$)|[ ](?:{_AT})[ ]{{1,3}}[A-Za-z0-9-]+\.[A-Za-z]|[ ](?:{_AT})[ ](?s:.)*[ ](?:{_DOT}|\.)[ ])"


def joined(found: dict[str, list[Span]]) -> str:
    rows = sorted((a, KINDS.index(kind), b) for kind, spans in found.items() for a, b in spans)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) to (key, spans)."""
    for batch in batches:
        texts = batch.column(1).fill_null("")
        spans: list[list] = [[] for _ in range(len(texts))]
        for d in pc.indices_nonzero(pc.match_substring_regex(texts, TRIGGER)).to_pylist():
            base, more = find(texts[d].as_py())
            rows = [(a, KINDS.index(k), b, True) for k, found in base.items() for a, b in found] + [(a, KINDS.index(k), b, False) for k, found in more.items() for a, b in found]
            spans[d] = [{"kind": KINDS[k], "start": a, "end": b, "base": plain} for a, k, b, plain in sorted(rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["key", "spans"])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,end,base>>), ordered by start and kind."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(detected, f"key {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>").withColumnRenamed("key", key)


def masked_text(text: str) -> str:
    """The text with every match replaced by its kind in angle brackets; matches
    that overlap are replaced together, under the name of the first."""
    base, more = find(text)
    rows = sorted((a, KINDS.index(k), b) for found in (base, more) for k, spans in found.items() for a, b in spans)
    out, done = [], 0
    for n, (a, k, b) in enumerate(rows):
        if a >= done or n == 0:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text`` to the same with its personal data masked."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)
        hit = pc.indices_nonzero(pc.match_substring_regex(texts.fill_null(""), TRIGGER)).to_pylist()
        changed = {d: new for d in hit if (new := masked_text(texts[d].as_py())) != texts[d].as_py()}
        if changed:
            texts = pa.array([changed.get(d, t) for d, t in enumerate(texts.to_pylist())], texts.type)
            batch = batch.set_column(at, batch.schema.field(at), texts)
        yield batch


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of its column ``text`` masked; null stays."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(masked, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
