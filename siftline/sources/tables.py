"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session takes a folder
    beside its warehouse; a cluster has to name one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing is made there."""
    return f"{shared_folder(spark)}/siftline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; its path is ``path`` of the result."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern of one name, since Spark takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
