"""Estimates from samples of patterns, and statistics of their probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def inclusion(pr: Column, samples: int) -> Column:
    """Chance that a pattern is among ``samples`` independent draws."""
    return 1 - F.pow(1 - pr, F.lit(samples))


def horvitz_thompson(patterns: DataFrame, samples: int, confidence: float = 0.90) -> DataFrame:
    """One row: population, total, mean, and variances and bounds of total and mean. ``patterns`` has pr and y.

    The variances sum over pairs of patterns; those of equal pr and y are one row with their number, and only such rows
    are joined with each other.
    """
    rows = cut(patterns.groupBy("pr", "y").agg(F.count("*").alias("k")).select("pr", "y", "k", inclusion(F.col("pr"), samples).alias("pi")))
    sums = rows.agg(F.sum(F.col("k") / F.col("pi")).alias("population"), F.sum(F.col("k") * F.col("y") / F.col("pi")).alias("total"))
    sums = sums.withColumn("mean", F.col("total") / F.col("population"))
    means = sums.select("mean")
    own = lambda y: F.sum(F.col("k") * (1 - F.col("pi")) / F.pow("pi", F.lit(2)) * F.pow(y, F.lit(2)))
    centred = F.col("y") - F.col("mean")
    single = rows.crossJoin(F.broadcast(means)).agg(own(F.col("y")).alias("own_total"), own(centred).alias("own_mean"))  # one row
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
    joint = F.col("pi_a") + F.col("pi_b") - (1 - F.pow(1 - F.col("pr_a") - F.col("pr_b"), F.lit(samples)))
    joint = F.when(joint == 0, F.lit(1e-17)).otherwise(joint)
    same = (F.col("pr_a") == F.col("pr_b")) & (F.col("y_a") == F.col("y_b"))
    times = F.col("k_a") * (F.col("k_b") - F.when(same, 1).otherwise(0))  # no pattern with itself
    pairs = a.crossJoin(b).crossJoin(F.broadcast(means)).withColumn("joint", joint)
    both = times * (F.col("joint") - F.col("pi_a") * F.col("pi_b")) / (F.col("pi_a") * F.col("pi_b") * F.col("joint"))
    pair_sums = pairs.agg(
        F.coalesce(F.sum(both * F.col("y_a") * F.col("y_b")), F.lit(0.0)).alias("pair_total"),
        F.coalesce(F.sum(both * (F.col("y_a") - F.col("mean")) * (F.col("y_b") - F.col("mean"))), F.lit(0.0)).alias("pair_mean"),
    )
    t = student_t(1 - (1 - confidence) / 2, max(1, samples - 1))
    out = sums.crossJoin(single).crossJoin(pair_sums)
    out = out.withColumn("var_total", F.col("own_total") + F.col("pair_total")).withColumn("var_mean", (F.col("own_mean") + F.col("pair_mean")) / F.pow("population", F.lit(2)))
    for what in ("total", "mean"):
        half = t * F.sqrt(F.greatest(F.col(f"var_{what}"), F.lit(0.0)))
        out = out.withColumn(f"{what}_low", F.col(what) - half).withColumn(f"{what}_high", F.col(what) + half)
    return out.select("population", "total", "mean", "var_total", "var_mean", "total_low", "total_high", "mean_low", "mean_high")


def uniformity(prs: DataFrame) -> DataFrame:
    """One row about column pr: n, non_zero, expected, total, mean, std (of the population), median, least, most, stderr."""
    n = prs.agg(F.count("*").alias("n"))
    rows = prs.crossJoin(F.broadcast(n))  # one row
    return rows.agg(
        F.max("n").alias("n"),
        F.sum((F.col("pr") > 0).cast("long")).alias("non_zero"),
        (1.0 / F.max("n")).alias("expected"),
        F.sum("pr").alias("total"),
        F.avg("pr").alias("mean"),
        F.stddev_pop("pr").alias("std"),
        F.percentile("pr", F.lit(0.5)).alias("median"),
        F.min("pr").alias("least"),
        F.max("pr").alias("most"),
        F.round(F.sqrt(F.sum(F.pow(F.col("pr") - 1.0 / F.col("n"), F.lit(2)))), 10).alias("stderr"),
    )


def extremes(values: DataFrame, item: str, value: str) -> DataFrame:
    """One row: the items of least and of greatest value (the least item of several), both values, and the sum of all."""
    low, high = F.min(F.struct(F.col(value).alias("v"), F.col(item).alias("i"))), F.max(F.col(value))
    top = values.agg(high.alias("m"))
    first = values.join(F.broadcast(top), F.col(value) == F.col("m")).agg(F.min(item).alias("argmax"))  # one row
    rest = values.agg(low.alias("l"), high.alias("greatest"), F.sum(value).alias("total"))
    return rest.crossJoin(F.broadcast(first)).select(F.col("l.i").alias("argmin"), F.col("l.v").alias("least"), "argmax", "greatest", "total")


def moments(values: DataFrame, column: str) -> DataFrame:
    """One row: mean (-1 if there are no rows) and variance of the sample."""
    return values.agg(F.coalesce(F.avg(column), F.lit(-1.0)).alias("mean"), F.var_samp(column).alias("variance"))


def chi_square(counts: DataFrame, expected: str | None = None) -> DataFrame:
    """One row: statistic, degrees of freedom and p-value of ``observed`` against equal counts, or column ``expected``."""
    totals = counts.agg(F.count("*").alias("n"), F.sum("observed").alias("all_"))
    e = F.col(expected) if expected else F.col("all_") / F.col("n")
    rows = counts.crossJoin(F.broadcast(totals)).select(F.pow(F.col("observed") - e, F.lit(2)).alias("d"), e.alias("e"))  # one row
    out = rows.agg(F.sum(F.col("d") / F.col("e")).alias("statistic"), (F.count("*") - 1).alias("df"))

    @F.udf("double")
    def upper(statistic, df):
        return None if statistic is None or not df else gamma_upper(df / 2, statistic / 2)

    return out.withColumn("p_value", upper("statistic", "df"))


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def _t_cdf(t: float, df: float) -> float:
    """By Simpson's rule on the density after t = tan(angle) * sqrt(df)."""
    top, steps = math.atan(t / math.sqrt(df)), 2000
    h = top / steps
    f = lambda x: math.cos(x) ** (df - 1)
    area = f(0) + f(top) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + scale * area * h / 3


def student_t(p: float, df: float) -> float:
    """Quantile of Student's t distribution, by bisection."""
    low, high = 0.0, 1e3
    while _t_cdf(high, df) < p:
        high *= 10
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2
