"""Collections of chunks by content, prompts by key, files by content, and models that
the caller registers. Nothing here uses a network."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CHUNK = "key string, source_index int, text string, origin string"


def content_name(chunks: DataFrame, by: str = "collection") -> DataFrame:
    """(by, name): ``pdf-`` and the first 16 digits of the MD5 of the texts of each
    collection (by, ord, text) one after the other. One collection is one document's
    chunks, which one task holds at once."""
    texts = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"].alias("t"))
    return texts.select(by, F.concat(F.lit("pdf-"), F.substring(F.md5(F.array_join("t", "").cast("binary")), 1, 16)).alias("name"))


def files(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, key, text) of the files under a folder: the key is the MD5 of the bytes;
    ``extract`` turns bytes into text, by default UTF-8. A file that it can't read
    has a null text."""

    def run(batches):
        import pyarrow as pa

        read = extract or (lambda raw: raw.decode())
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                try:
                    out.append(read(raw))
                except Exception:  # noqa: BLE001  whatever a reader of unknown files raises, the file has no text
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "key", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("key"), "content")
    return rows.mapInArrow(run, "path string, key string, text string")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The chunks (key, source_index, text, origin) of a cache; none if there isn't one."""
    try:
        return spark.read.schema(CHUNK).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CHUNK)


def ingested(spark: SparkSession, path: str, files_: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunks of all files (key, text), of which only those that the cache hasn't
    are cut, by ``chunk`` (doc_id, text to doc_id, chunk_no, text); the new ones join
    the cache. Files of equal content count once."""
    old = cached(spark, path)
    new = files_.where("text is not null").dropDuplicates(["key"]).join(old.select("key").distinct(), "key", "left_anti")
    cut = chunk(new.select(F.col("key").alias("doc_id"), "text"))
    rows = cut.select(F.col("doc_id").alias("key"), F.col("chunk_no").cast("int").alias("source_index"), "text", F.lit("pdf").alias("origin"))
    rows.write.mode("append").parquet(path)
    return cached(spark, path).join(files_.select("key").distinct(), "key", "left_semi")


def collected(spark: SparkSession, path: str, name: str, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """(chunks with embeddings, reason): a collection that is made once under its name
    and read after that. Without an embedding function, or where it fails, the chunks
    come back as they are, with the reason for searching them by words alone."""
    if embed is None:
        return chunks, "no embedding function"
    try:
        embed(chunks).write.mode("ignore").parquet(f"{path}/{name}")
    except Exception as error:  # noqa: BLE001  any provider's failure leaves search by words
        return chunks, str(error).splitlines()[0]
    return spark.read.parquet(f"{path}/{name}"), ""


def prompt(folder: str, key: str, file: str | None = None, **values: object) -> str:
    """The text ``key`` of a prompt file (``== key ==`` lines part its texts), or of
    the first file that has it, with {names} filled in. FileNotFoundError without the
    file, KeyError without the key."""
    names = [file] if file else [p.name for p in sorted(Path(folder).glob("*.txt"))]
    for name in names:
        texts = prompts(folder, name)
        if key in texts:
            return texts[key].format(**values) if values else texts[key]
    raise KeyError(key)


def prompts(folder: str, file: str) -> dict[str, str]:
    out: dict[str, list[str]] = {}
    own: list[str] = []
    for line in Path(folder, file).read_text(encoding="utf-8").splitlines():
        if line.startswith("== ") and line.endswith(" =="):
            own = out.setdefault(line[3:-3].strip(), [])
        else:
            own.append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


_models: dict[str, Callable[[Column], Column]] = {}


def register_model(name: str, answer: Callable[[Column], Column]) -> None:
    """``answer`` maps a column of prompts to one of answers: a pandas function that
    calls a provider, or an expression."""
    _models[name.lower()] = answer


def model(*names: str) -> Callable[[Column], Column]:
    """The first registered model of the names, so that a local one may stand in."""
    for name in names:
        if name.lower() in _models:
            return _models[name.lower()]
    raise ValueError(f"no model {' or '.join(names)}")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A stand-in for an embedding model: the words of a text hashed into ``size``
    places, scaled to length 1; all zero without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c))
    return F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(0.0))
