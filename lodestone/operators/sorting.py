"""External sort: (key, row) in ascending order, as a range exchange and a spilling sort.

``sort_to_files`` leaves one sorted file for each range, in the order of their names, and
``positions`` numbers the rows of such a folder, as longs, from each file's row count: no row ever passes a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sorted_relation(df: DataFrame, key: str, row: str) -> DataFrame:
    """(key, row) ordered by both, so that ties have an order too."""
    return df.select(key, row).orderBy(key, row)


def without_deleted(df: DataFrame, row: str, deleted: DataFrame) -> DataFrame:
    """``df`` but for the rows whose number ``deleted`` lists."""
    return df.join(deleted.select(row).distinct(), row, "left_anti")


def sort_to_files(df: DataFrame, key: str, row: str, path: str) -> None:
    sorted_relation(df, key, row).write.parquet(path)


def positions(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """The sorted rows with their places from 1."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    # one row a file: a bounded table, which is broadcast only below the session's threshold
    files = df.groupBy("_file").agg(F.count("*").alias("_n"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")  # as a number: names of over 99999 parts differ in length
    before = files.select("_file", (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    return df.join(before, "_file").withColumn(name, F.col("_before") + F.col("_index") + 1).drop("_file", "_index", "_before")


def sorted_text(df: DataFrame, key: str, path: str) -> None:
    """One key a line, in order."""
    df.select(F.col(key).cast("string").alias("value"), F.col(key).alias("k")).orderBy("k").select("value").write.text(path)


def random_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Rows (x, y, c, pkey) of random integers, a constant and a running number."""
    integer = lambda k: (F.floor(F.rand(seed + k) * (1 << 32)) - (1 << 31)).cast("int")
    return spark.range(n).select(integer(0).alias("x"), integer(1).alias("y"), F.lit("A").alias("c"), (F.col("id") + 1).alias("pkey"))
