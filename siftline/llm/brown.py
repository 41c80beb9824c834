"""Language-model scores from a Brown class-based bigram model.

Counts cover all training documents: every word's, and those of all neighbouring
pairs in an alphabet of the CLASS_WORDS most frequent words, the end token, classes
by the logarithm of the count for other frequent words, and one class of rare
words: those that occur once, whatever the size of the corpus, and those beyond the
HOT_WORDS most frequent. So words that no training document has are expected as
often as new words came. Exchange clustering moves each of the most frequent words, one after the
other, to the class that most raises the likelihood of the pairs, until no word
moves or ROUNDS are over. All other words of the model, which then leave their
classes by count, are added each to the class that most raises the likelihood of
those pairs, from counts of the classes before and after the word, in one pass over
all training documents; the pairs of the final classes are counted anew. The
probability of a token is

    P(class | class before) * P(token | class),

the transitions smoothed with the classes' shares (the exchange sees one half of
the training documents, the weight comes from the likelihood of the other half,
counts from both), the rare words' emissions by
adding 0.1 to each count and one unseen word. A document starts after an end.

Words are 64-bit hashes of whole words (A-Z as a-z). The model that is broadcast
holds at most HOT_WORDS words, whatever the corpus: the rare words of a document are
joined with the table of all counts instead.

Null texts count as empty: one end token. Repeated rows count and score each on
its own; an empty table gives an empty one. Without training documents every count
is zero. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ppm import Table, remainder
from .shared import bounded_batches, scratch
from .words import Words, words

HOT_WORDS, CLASS_WORDS, CLASSES, ROUNDS = 131_072, 2_000, 50, 4
#: Words that occur less often are rare.
LEAST_COUNT = 2
#: Classes by count, of frequent words that are not clustered.
BY_COUNT = 24
#: A worker hands on its counts at so many distinct words.
HELD_WORDS = 1_500_000
ADD = 0.1
END, RARE = CLASS_WORDS + BY_COUNT, CLASS_WORDS + BY_COUNT + 1
ALPHABET = RARE + 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a text column to (word, n), words repeated between batches."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([keys, *(k for k, _ in waiting)])
        number = np.concatenate([counts, *(c for _, c in waiting)])
        order = np.argsort(every)
        every, number = every[order], number[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return every[first], np.add.reduceat(number, first) if len(first) else number

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for _, w in words(batch.column(0)):
            waiting.append(np.unique(w.hash, return_counts=True))
            size += len(waiting[-1][0])
            if size > max(400_000, len(keys)):
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) > HELD_WORDS:
                    yield out()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = merged()
    yield out()


@dataclass
class Hot:
    """The most frequent words: their hashes (find gives a row), counts, and
    letters of the alphabet."""

    table: Table
    count: np.ndarray
    letter: np.ndarray


def hot_words(counts: DataFrame) -> tuple[Hot, int]:
    """At most HOT_WORDS words with the largest counts, and the least count of
    them, LEAST_COUNT at least; what count that is follows from a histogram of the counts."""
    step = F.floor(F.log2("n") * 16)
    histogram = sorted((r.step, r.words, r.least) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect())
    least, room = (1 << 62), HOT_WORDS
    for _, size, low in reversed(histogram):
        if size > room:
            break
        least, room = low, room - size
    least = max(least, LEAST_COUNT)
    rows = counts.where(F.col("n") >= least).toArrow()
    word, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.lexsort((word, -n))
    word, n = word[order], n[order]
    letter = CLASS_WORDS + np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), BY_COUNT - 1)
    letter[:CLASS_WORDS] = np.arange(min(CLASS_WORDS, len(n)))
    return Hot(Table(word, np.zeros((len(word), 1))), n, letter), least


def letters(hot: Hot, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word in ``hot``; letters of the slice's tokens, an end after
    each text; where each text begins in them)."""
    row = hot.table.find(w.hash)
    own = np.where(row < 0, RARE, hot.letter[row] if len(hot.letter) else RARE)
    n = len(w.doc) - 1
    at = w.doc + np.arange(n + 1)
    out = np.full(len(own) + n, END, np.int64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = own
    return row, out, at


def before(letter: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The letter before each token; an end before the first."""
    out = np.empty_like(letter)
    out[1:] = letter[:-1]
    out[at[:-1]] = END
    return out


def paired(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (text, half) to (pair, n): one batch of counts for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * ALPHABET * ALPHABET, np.int64)
        for batch in batches:
            half = batch.column(1).to_numpy(zero_copy_only=False)
            for i, w in words(batch.column(0)):
                _, letter, at = letters(shared.value, w)
                own = np.repeat(half[i : i + len(at) - 1], np.diff(at))
                total += np.bincount((own * ALPHABET + before(letter, at)) * ALPHABET + letter, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each letter, by exchange clustering of the first CLASS_WORDS.

    ``pairs[x, y]`` counts x before y. The other letters keep classes of their own.
    The likelihood is the sum of n log n over pairs of classes, less that over
    classes on both sides."""
    size = len(pairs)
    movable = min(CLASS_WORDS, size)
    total = pairs.sum(axis=1) + pairs.sum(axis=0)
    own = np.empty(size, np.int64)
    own[movable:] = classes + np.arange(size - movable)
    own[:movable] = np.arange(movable) % classes
    k = classes + size - movable
    f = lambda x: x * np.log(np.maximum(x, 1))
    member = np.zeros((size, k))
    member[np.arange(size), own] = 1
    pairs = pairs.astype(np.float64)
    left, right = pairs.T @ member, pairs @ member  # of each letter: classes before it, after it
    table = member.T @ right
    for _ in range(rounds):
        moved = 0
        for x in range(movable):
            if not total[x]:
                continue
            a, same = own[x], pairs[x, x]
            into, out = left[x].copy(), right[x].copy()
            into[a] -= same
            out[a] -= same
            # take x out of its class
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= same
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            n_out, n_in = out.sum() + same, into.sum() + same
            c = np.arange(classes)
            diagonal = table[c, c]
            gain = (f(table[:classes] + out) - f(table[:classes])).sum(axis=1) - (f(diagonal + out[c]) - f(diagonal))
            gain += (f(table[:, :classes] + into[:, None]) - f(table[:, :classes])).sum(axis=0) - (f(diagonal + into[c]) - f(diagonal))
            gain += f(diagonal + out[c] + into[c] + same) - f(diagonal)
            gain -= f(rows[c] + n_out) - f(rows[c]) + f(columns[c] + n_in) - f(columns[c])
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-6:
                best = a
            table[best] += out
            table[:, best] += into
            table[best, best] += same
            if best != a:
                moved += 1
                own[x] = best
                left[:, a] -= pairs[x]
                left[:, best] += pairs[x]
                right[:, a] -= pairs[:, x]
                right[:, best] += pairs[:, x]
        if not moved:
            break
    return own


def around(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of a text column to (word, at, n): how often a class comes before
    (at = class) or after (at = k + class) a word that the exchange didn't move, by
    the word's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, kind, k = shared.value
        total = np.zeros(len(hot.count) * 2 * k, np.int32)
        for batch in batches:
            for _, w in words(batch.column(0)):
                row, letter, at = letters(hot, w)
                token = np.full(len(letter), -1, np.int64)
                keep = np.ones(len(letter), bool)
                keep[at[1:] - 1] = False
                token[keep] = row
                own = np.flatnonzero(token >= CLASS_WORDS)
                cell = token[own] * 2 * k
                np.add.at(total, cell + kind[before(letter, at)[own]], 1)
                np.add.at(total, cell + k + kind[letter[own + 1]], 1)  # the end at least
        found = np.flatnonzero(total)
        for i in range(0, len(found), 1 << 18):
            part = found[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part // (2 * k)), pa.array((part % (2 * k)).astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["word", "at", "n"])

    return run


def gains(table: np.ndarray, word: np.ndarray, at: np.ndarray, n: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """[words, classes] likelihood gained by adding to a class a word that isn't in
    one, from entries sorted by word (0, 1, ...): at < k counts class before, others
    class after."""
    k, size = len(table), int(word[-1]) + 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    n = n.astype(np.float64)
    after = at >= k
    # each entry's cell of the table, by class
    cell = np.where(after[:, None], table[:classes, at % k].T, table[at % k, :classes])
    change = f(cell + n[:, None]) - f(cell)
    inner = np.flatnonzero(at % k < classes)
    change[inner, at[inner] % k] = 0  # the class's own cell gets both sides, below
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.add.reduceat(change, first)
    both = np.zeros((size, classes))
    np.add.at(both, (word[inner], at[inner] % k), n[inner])
    c = np.arange(classes)
    diagonal, rows, columns = table[c, c], table.sum(axis=1)[c], table.sum(axis=0)[c]
    n_out, n_in = np.bincount(word, n * after, size)[:, None], np.bincount(word, n * ~after, size)[:, None]
    out += f(diagonal + both) - f(diagonal)
    return out - (f(rows + n_out) - f(rows)) - (f(columns + n_in) - f(columns))


def assigned(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (word, at list, n list) to (word, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                word, at, n = batch.slice(i, 1024).columns
                each = np.repeat(np.arange(len(word)), at.value_lengths().to_numpy())
                best = gains(table, each, at.flatten().to_numpy(), n.flatten().to_numpy()).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([word, pa.array(best)], names=["word", "class"])

    return run


def all_classed(training: DataFrame, hot: Hot, pairs: np.ndarray) -> tuple[Hot, np.ndarray]:
    """``hot`` with classes for letters, and the class of each such letter: exchange
    for the most frequent words, then all others by what is around them."""
    kind = exchange(pairs)
    k = int(kind.max()) + 1
    member = np.zeros((ALPHABET, k))
    member[np.arange(ALPHABET), kind] = 1
    letter = kind[hot.letter]
    if len(letter) > CLASS_WORDS:
        share = training.sparkSession.sparkContext.broadcast
        counts = training.mapInArrow(around(share((hot, kind, k))), "word long, at int, n long").groupBy("word", "at").agg(F.sum("n").alias("n"))
        lists = counts.groupBy("word").agg(F.collect_list(F.struct("at", "n")).alias("x")).select("word", "x.at", "x.n")
        found = lists.mapInArrow(assigned(share(member.T @ pairs @ member)), "word long, class long").toArrow()
        letter[found.column("word").to_numpy()] = found.column("class").to_numpy()
    final = np.minimum(np.arange(ALPHABET), CLASSES + 1)
    final[END] = CLASSES
    return Hot(hot.table, hot.count, letter), final


@dataclass
class Model:
    hot: Hot
    kind: np.ndarray  # class of each letter
    step: np.ndarray  # log10 of the transitions between classes
    emit: np.ndarray  # log10 of P(word | class) of each hot word
    base: np.ndarray  # log10 of the base probability of each hot word
    base_end: float


def smoothing(table: np.ndarray, other: np.ndarray) -> float:
    """The weight of the classes' shares under which transitions counted in
    ``table`` make those of other documents likeliest."""
    row, share = table.sum(axis=1, keepdims=True), shares(table)
    return max((10.0**e for e in range(10)), key=lambda weight: float((other * np.log((table + weight * share) / (row + weight))).sum()))


def shares(table: np.ndarray) -> np.ndarray:
    return (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * len(table))


def fit(hot: Hot, halves: np.ndarray, ends: int, per_base: float = 0.0, kind: np.ndarray | None = None) -> Model:
    """A model of the pairs in two halves of the documents: classes come from the
    first if not given, the smoothing from how they do on the second, counts from
    both."""
    kind = exchange(halves[0]) if kind is None else kind
    k = int(kind.max()) + 1
    member = np.zeros((ALPHABET, k))
    member[np.arange(ALPHABET), kind] = 1
    first, second = (member.T @ x @ member for x in halves)
    weight, table = smoothing(first, second), first + second
    step = np.log10((table + weight * shares(table)) / (table.sum(axis=1, keepdims=True) + weight))
    own = kind[hot.letter]
    of_class = np.bincount(own, hot.count, k) if len(own) else np.zeros(k)
    emit = np.log10(hot.count / of_class[own]) if len(own) else np.zeros(0)
    return Model(hot, kind, step, emit, np.log10(hot.count + ADD) - per_base, float(np.log10(ends + ADD)) - per_base)


def by_text(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, which begin at ``at``."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(x, at[some])
    return out


def scored(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (row, text) to (row, n_tokens, n_hot, base, score, rare): the sums
    over what is hot (ends included) and the words that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for i, w in words(batch.column(1)):
                row, letter, at = letters(m.hot, w)
                n = len(at) - 1
                kind = m.kind[letter]
                known = row >= 0
                sums = lambda x: by_text(x, w.doc)  # noqa: B023, E731
                score, base, hot = by_text(m.step[m.kind[before(letter, at)], kind], at), np.full(n, m.base_end), sums(known.astype(float))
                if len(m.emit):
                    score = score + sums(np.where(known, m.emit[row], 0.0))
                    base = base + sums(np.where(known, m.base[row], 0.0))
                rare = w.hash[~known].view(np.int64)
                off = np.concatenate([[0], np.cumsum(~known)])[w.doc].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(at)), pa.array(hot.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(off), pa.array(rare))],
                    names=["row", "n_tokens", "n_hot", "base", "score", "rare"],
                )

    return run


@dataclass
class Learned:
    """What the training documents teach."""

    model: Model
    rest: DataFrame  # (word, n) of rare words
    known_end: int
    tokens: int
    per_base: float
    per_rare: float


def learn(rows: DataFrame, held_out: int) -> Learned:
    """A model of the rows (doc_id, held_out, text) that aren't held out."""
    context = rows.sparkSession.sparkContext
    training = rows.where("not held_out").select("text")
    counts = scratch(training.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = training.count()
    hot, least = hot_words(counts)
    all_words, all_tokens = (lambda r: (r.words, r.tokens or 0))(counts.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first())
    rare_words, rare_tokens = all_words - len(hot.count), all_tokens - int(hot.count.sum())

    n, v = all_tokens + ends, all_words + (ends > 0)
    per_base, per_rare = float(np.log10(n + ADD * (v + 1))), float(np.log10(rare_tokens + ADD * (rare_words + 1)))
    half = F.coalesce(F.floor(remainder(F.col("doc_id"), 2 * held_out) / held_out), F.lit(0)).cast("long")
    halved = rows.where("not held_out").select("text", half.alias("half"))

    def counted_pairs(hot: Hot) -> np.ndarray:
        found = halved.mapInArrow(paired(context.broadcast(hot)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        pairs = np.zeros(2 * ALPHABET * ALPHABET, np.int64)
        pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
        return pairs.reshape(2, ALPHABET, ALPHABET)

    hot, kind = all_classed(training, hot, counted_pairs(hot)[0])
    model = fit(hot, counted_pairs(hot), ends, per_base, kind)
    return Learned(model, counts.where(F.col("n") < least), int(ends > 0), n, per_base, per_rare)


def scores(docs: DataFrame, held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity) of every row, learned from the documents that aren't held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    apart = F.coalesce(remainder(F.col("doc_id"), held_out) == 0, F.lit(False))
    rows = docs.select("doc_id", apart.alias("held_out"), "text")
    known = learn(rows, held_out)
    numbered = rows.withColumn("row", F.struct(F.monotonically_increasing_id().alias("number"), "doc_id", "held_out"))
    key = rows.schema["doc_id"].dataType.simpleString()
    parts = scratch(
        numbered.select("row", "text").mapInArrow(scored(spark.sparkContext.broadcast(known.model)), f"row struct<number:bigint,doc_id:{key},held_out:boolean>, n_tokens long, n_hot long, base double, score double, rare array<long>"),
        "scores",
    )
    seen = parts.select(F.col("row.number").alias("number"), F.explode("rare").alias("word")).join(known.rest, "word", "left")
    rare = seen.groupBy("number").agg(F.count("n").alias("n_seen"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD) - known.per_base).alias("rare_base"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD) - known.per_rare).alias("rare"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = parts.withColumn("number", F.col("row.number")).drop("rare").join(rare, "number", "left")
    return out.select(
        "row.doc_id",
        "row.held_out",
        "n_tokens",
        (F.col("n_hot") + zero("n_seen") + known.known_end).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
