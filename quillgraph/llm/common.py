"""Helpers shared by the text-corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reach_workers

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: For ``str.translate``: lower-cases A-Z and nothing else.
LOWER_AZ = str.maketrans(*LETTERS)


def lower_az(column: Column) -> Column:
    """Lower-cases A-Z only, whatever the session's locale or collation."""
    return F.translate(column, *LETTERS)


#: Rows of an Arrow batch at most: whole texts come in batches, and Spark's own 10,000 would take memory on both sides of the worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of ``df``: writes it once to the shared checkpoint folder and reads it back.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only where
    that is unset (tests, a laptop) one below the warehouse is used.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files behind a ``written`` frame that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n (null stays null)."""
    return F.crc32(F.encode(column.cast("string"), "utf-8")) % n
