"""Mixing sources to target weights by a low-discrepancy schedule.

Built-in DataFrame functions only. Documents of a source form one stream in a keyed order; the stream is cut
into blocks of equal size in words. Slots of the schedule fall to sources by the fractional parts of multiples
of the golden ratio, mapped through the cumulative targets. The r-th slot of a source takes its block r modulo
its number of blocks; the last slot of a source takes only what its target still lacks. What is taken of a document, and
where in the mix it first appears, is read off the slots. Tables with a row a source are ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, table

#: Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949

#: Rows that one task sorts to rank them, and cells of the range join of points with sources.
ROWS_PER_GROUP, CELLS = 2_000, 4096


def words_in(text: Column) -> Column:
    """Number of words, counted as the length of a text that has one letter for each: no array of them is made."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+$", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target. ``sizes`` has source and size.

    Sources in the order of their code points, null last, get ``weights`` in turn. They share ``share`` times all
    sizes by weight; no target exceeds ``most`` times its source's size, and what is above is shared again by
    weight. That ends where target = min(most * size, level * weight) for one level: sources reach their
    bounds in the order of bound / weight.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    stats = stats.withColumn("weight", pick).withColumn("bound", F.col("source_size") * F.lit(most))
    full = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stats = stats.withColumn("own_level", level).withColumn("free", F.col("own_level") * F.col("weight") < F.col("bound"))
    # The first source that stays under its bound fixes the level of all that stay under theirs.
    stats = stats.withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("bound") / F.col("weight")).alias("r"), F.col("own_level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("level") * F.col("weight")))
    return stats.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _rank_in_groups(rows: DataFrame, keys: list[str], group: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys that come before in (group, order).

    Two levels, so that no task sorts more than a group: sums per group, a running sum over groups, and a running
    sum inside each. Keys may be null.
    """
    rows = rows.withColumn("value_", value)
    sums = rows.groupBy(*keys, group).agg(F.sum("value_").alias("sum_"))
    earlier = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"{k}_k") for k in keys], F.col(group).alias("group_k"), "base_")
    same = F.col(group) == F.col("group_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    inside = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside_", F.coalesce(F.sum("value_").over(inside), F.lit(0)))
    rows = rows.join(sums, same).withColumn(name, F.col("base_") + F.col("inside_"))
    return rows.drop("value_", "inside_", "base_", "group_k", *[f"{k}_k" for k in keys])


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 1024, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, first_slot.

    first_slot is the first slot of the schedule that takes words of the document, null if none does. taken is the number of words that the mix takes from the document, repeats counted. The words taken from a
    source sum to its target, rounded down, if ``most`` is 2 or a whole number; no document is taken more than
    ``most`` times its size. Null and empty texts have size 0 and nothing is taken. Null sources form one source.
    Repeated rows are separate documents; rows without any words leave all targets 0. The order of a
    source's documents is that of md5(seed:id), then the id and the size, so reruns agree. Other columns are not
    read.
    """
    rows = docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), words_in(docs[text_column]).alias("size"))
    rows = cut(rows)
    targets = cut(source_targets(rows, weights, share, most).withColumn("quota", F.floor("target").cast("long")))
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0

    # Streams: start of each document in the order of its hash; groups are ranges of the hash.
    groups = max(1, math.ceil(largest / ROWS_PER_GROUP))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    stream = rows.withColumn("key", key).withColumn("g", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * groups / F.lit(4294967296)))
    stream = _rank_in_groups(stream, ["source"], "g", ["key", "id", "size"], F.col("size"), "start").drop("g", "key")
    same = F.col("source").eqNullSafe(F.col("source_t"))
    stream = stream.join(F.broadcast(targets.withColumnRenamed("source", "source_t")) if _few(targets) else targets.withColumnRenamed("source", "source_t"), same).drop("source_t")

    taken = block_takes(slots(docs.sparkSession, targets, block_words))
    pieces = stream.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    on = F.col("source").eqNullSafe(F.col("source_b")) & (F.col("block") == F.col("block_b"))
    origin = F.col("block") * block_words
    low, high = F.greatest("start", origin), F.least(F.col("start") + F.col("size"), origin + block_words)
    cut_off = F.when(F.col("part") > 0, F.greatest(F.least(high, origin + F.col("part")) - low, F.lit(0))).otherwise(F.lit(0))
    words = F.coalesce((high - low) * F.col("full") + cut_off, F.lit(0))
    slot = F.least(F.when(F.col("full") > 0, F.col("first_full")), F.when(cut_off > 0, F.col("first_part")))
    sums = pieces.join(taken, on, "left").groupBy("id", "source", "size", "source_size", "target", "start")
    sums = sums.agg(F.sum(words).cast("long").alias("taken"), F.min(slot).alias("first_slot")).drop("start")
    nothing = (F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    empty = stream.where("size = 0").select("id", "source", "size", "source_size", "target", *nothing)
    return sums.unionByName(empty).withColumnRenamed("id", id_column)


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources, which is checkpointed, may be broadcast."""
    return targets.count() <= most


def slots(spark: SparkSession, targets: DataFrame, block_words: int) -> DataFrame:
    """The schedule: rows (n, source, rank, block, length, take), n the order of the mix.

    Slot n falls to the source whose part of the cumulative quotas holds the n-th golden-ratio point. Its rank among
    the source's slots says which block it takes; take is the block's length, or what the quota still lacks.
    Ranks that the points have not given to a source when they end, a few at most, follow in turn.
    """
    total = targets.agg(F.sum("quota")).first()[0] or 0
    points_end = -(-total // block_words)
    up_to = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.where("quota > 0").withColumn("high", F.sum("quota").over(up_to)).withColumn("low", F.col("high") - F.col("quota"))
    # A range join by cells of equal width: a source is in every cell that its part touches.
    width = max(1, total // CELLS)
    cells = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    shares = shares.select("source", "low", "high", cells.alias("cell"))
    point = F.col("id") * F.lit(GOLDEN)
    at = F.floor((point - F.floor(point)) * F.lit(total)).cast("long")
    points = spark.range(points_end).select(F.col("id").alias("n"), at.alias("at"))
    points = points.withColumn("cell", F.floor(F.col("at") / width))
    drawn = points.join(shares, "cell").where("at >= low and at < high").select("n", "source", F.floor(F.col("n") / ROWS_PER_GROUP).alias("g"))
    drawn = _rank_in_groups(drawn, ["source"], "g", ["n"], F.lit(1), "rank").select("n", "source", "rank")

    blocks = F.ceil(F.col("source_size") / block_words)
    needed = F.floor(F.col("quota") / F.col("source_size")) * blocks + F.ceil((F.col("quota") % F.col("source_size")) / block_words)
    limits = targets.where("quota > 0").select(F.col("source").alias("source_l"), "source_size", "quota", blocks.alias("blocks"), needed.alias("needed"))
    same = F.col("source").eqNullSafe(F.col("source_l"))
    counts = drawn.groupBy("source").agg(F.count("*").alias("drawn"))
    missing = limits.join(counts, same, "left").where(F.coalesce("drawn", F.lit(0)) < F.col("needed"))
    last = F.coalesce("drawn", F.lit(0)).cast("long")
    missing = missing.select(F.col("source_l").alias("source"), last.alias("drawn"), F.explode(F.sequence(last, F.col("needed") - 1)).alias("rank"))
    missing = missing.select((F.lit(points_end).cast("long") + F.col("rank") - F.col("drawn")).alias("n"), "source", "rank")
    ranked = drawn.unionByName(missing).join(limits, same).where("rank < needed")
    block = F.col("rank") % F.col("blocks")
    offset = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + block * block_words
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - block * block_words)
    out = ranked.select("n", "source", "rank", block.alias("block"), length.alias("length"), F.least(length, F.col("quota") - offset).alias("take"))
    return out.where("take > 0")


def block_takes(slots: DataFrame) -> DataFrame:
    """Per source and block: how often it is taken whole, how many words of its beginning once more, and the first slots of either."""
    whole = F.col("take") == F.col("length")
    sums = slots.groupBy("source", "block").agg(F.sum(whole.cast("int")).alias("full"), F.sum(F.when(whole, 0).otherwise(F.col("take"))).alias("part"), F.min(F.when(whole, F.col("n"))).alias("first_full"), F.min(F.when(~whole, F.col("n"))).alias("first_part"))
    return sums.withColumnRenamed("source", "source_b").withColumnRenamed("block", "block_b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS bound FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(bound) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM w
), f AS (
  SELECT *, (SELECT arg_min(own, bound / weight) FROM l WHERE own * weight < bound) AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN bound ELSE least(bound, level * weight) END AS target FROM f
), q AS (
  SELECT *, floor(target)::BIGINT AS quota FROM t
), p AS (
  SELECT doc_id, d.source, size, source_size, target, quota,
    (sum(size) OVER (PARTITION BY d.source ORDER BY md5('1:' || doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
, shares AS (
  SELECT source, (sum(quota) OVER o - quota)::BIGINT AS low, (sum(quota) OVER o)::BIGINT AS high FROM q WHERE quota > 0
  WINDOW o AS (ORDER BY source IS NULL, source ROWS UNBOUNDED PRECEDING)
), n AS (
  SELECT coalesce(sum(quota), 0)::BIGINT AS total, ((coalesce(sum(quota), 0) + 1023) // 1024)::BIGINT AS points FROM q
), points AS (
  SELECT range::BIGINT AS n, floor((range * 0.6180339887498949::DOUBLE - floor(range * 0.6180339887498949::DOUBLE)) * total)::BIGINT AS x FROM n, range(points)
), drawn AS (
  SELECT n, source, (row_number() OVER (PARTITION BY source ORDER BY n) - 1)::BIGINT AS rank FROM points JOIN shares ON x >= low AND x < high
), limits AS (
  SELECT source, source_size, quota, (source_size + 1023) // 1024 AS blocks,
    quota // source_size * ((source_size + 1023) // 1024) + (quota % source_size + 1023) // 1024 AS needed,
    (SELECT count(*) FROM drawn d WHERE d.source IS NOT DISTINCT FROM q.source) AS drawn FROM q WHERE quota > 0
), ranked AS (
  SELECT * FROM drawn UNION ALL
  SELECT points + rank - drawn, source, rank FROM n, (SELECT source, drawn, unnest(range(drawn, needed)) AS rank FROM limits WHERE drawn < needed)
), slots AS (
  SELECT n, r.source, rank % blocks * 1024 AS origin,
    least(1024, source_size - rank % blocks * 1024, quota - rank // blocks * source_size - rank % blocks * 1024) AS take
  FROM ranked r JOIN limits l ON r.source IS NOT DISTINCT FROM l.source WHERE rank < needed
), takes AS (
  SELECT p.doc_id, p.start, p.size, p.source, sum(least(p.start + p.size, origin + take) - greatest(p.start, origin)) AS taken, min(n) AS first_slot
  FROM p JOIN slots s ON s.source IS NOT DISTINCT FROM p.source AND p.start < origin + take AND p.start + p.size > origin AND take > 0
  WHERE p.size > 0 GROUP BY ALL
)
SELECT p.doc_id, p.size, source_size, target::DOUBLE AS target, p.source, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM p LEFT JOIN takes k ON k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.start = p.start AND k.size = p.size AND k.source IS NOT DISTINCT FROM p.source
"""
