"""Helpers shared by the operators: shared folders, column checks, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.session import ensure_checkpoint_dir

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs start from the files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one job; a table goes when another takes its name, or by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that begins with ``stem`` and that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, about to be read by a Python function: batches of a thousand texts.

    Spark's ten thousand rows in an Arrow batch are meant for numbers; with
    texts they fill the memory beside the heap several times over.  A value that
    someone has set is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS) == "10000":
        conf.set(_BATCH_ROWS, "1000")
    return df


def remainder(key: str, divisor: int):
    """crc32 of the key's decimal text, modulo ``divisor`` (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(divisor)
