"""Transactions: one row (tx, item) per item of a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, folder or gzip file as (line, value), numbered from 0 in order of files and lines.

    The numbers come from the sizes of the blocks of the files and the order in them, not from a sort of the lines.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = cut(spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at")))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(blocks, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def parse_int_lines(lines: DataFrame) -> DataFrame:
    """(tx, item) of numbered lines of integers separated by blanks; other tokens are skipped.

    Empty lines use up a transaction number.
    """
    tokens = lines.select(F.col("line").alias("tx"), F.explode(F.split("value", " ")).alias("token"))
    return tokens.select("tx", F.expr("try_cast(trim(token) AS int)").alias("item")).where(F.col("item").isNotNull())


def read_int_transactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_int_lines(numbered_lines(spark, path))


def baskets(df: DataFrame, tx: str, item: str) -> DataFrame:
    """Distinct (tx, item) of a table with a row per item; nulls drop out."""
    return df.select(F.col(tx).alias("tx"), F.col(item).alias("item")).dropna().distinct()


def inverted(transactions: DataFrame) -> DataFrame:
    """(item, txs): the transactions of each item, sorted."""
    return transactions.groupBy("item").agg(F.array_sort(F.collect_set("tx")).alias("txs"))
