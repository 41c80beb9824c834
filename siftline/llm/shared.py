"""What several operators need: shared scratch tables and a total order by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that one Arrow batch may hold before it goes to a Python worker.
BATCH_BYTES = "4m"


#: Folders of the scratch tables of this process that haven't been deleted.
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that
    is unset, a local session takes one beside its warehouse; a cluster has to name
    one."""
    conf = spark.sparkContext.getConf()
    given = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts lineage and
    survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratch_mark() -> int:
    """A place in the sequence of scratch tables, for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the scratch tables made since ``mark`` but those to keep, also after a
    failure: what was computed from them must have been written."""
    kept = {df.scratch_path for df in keep}
    for path in [p for p in _made[mark:] if p not in kept]:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing needs any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, so that very long texts
    don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def numbered(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """``df`` with a dense 0-based position in the total order of ``keys``.

    The rows are range-partitioned and written once; the offset of each part
    comes from one count a part, so no task sees more than its own range."""
    spark = df.sparkSession
    parts = scratch(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    out = parts.withColumn("__at", within).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, (F.col("__at") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__part", "__p", "__at", "__before")
    out.scratch_path = parts.scratch_path
    return out
