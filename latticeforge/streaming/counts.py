"""Counts of items and pairs over arriving transactions: an extension for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(transactions: DataFrame, window: str | None = None, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(a, b, support) of a stream of (tx, items array), or per window of event time behind a watermark.

    A transaction arrives as one row, so that its pairs need no join with others.
    """
    items = F.array_sort(F.array_distinct("items"))
    pairs = F.flatten(F.transform(items, lambda a: F.transform(F.filter(items, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    keys = []
    if window is not None:
        transactions = transactions.withWatermark(time, late)
        keys = [F.window(time, window).alias("window")]
    rows = transactions.select(*([time] if window else []), F.explode(pairs).alias("pair"))
    return rows.groupBy(*keys, "pair.a", "pair.b").agg(F.count("*").alias("support"))
