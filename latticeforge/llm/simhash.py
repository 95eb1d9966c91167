"""SimHash near-duplicates, linked through pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table, text_or_empty
from ._components import connected_components


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of unsigned 64-bit ``hashes``, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # keeps the unpacked bits small for texts of any length
        block = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of ``text`` as a signed 64-bit number; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, 42)).view(np.int64))
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return majority(hashes)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    return hashed(text)


def _segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` segments that make up ``bits`` bits."""
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(column: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << width) - 1))


def _ring_rows(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, way, part): for each first segment of the ring and each half of the second, the bits that a chain starts with."""
    if not 1 <= distance <= 7:
        raise ValueError("distance must be from 1 to 7")
    count = distance + 1
    ring = _segments(64, count)
    keys = []
    for i, (shift, width) in enumerate(ring):
        after, wide = ring[(i + 1) % count]
        half = wide // 2
        for j, (at, w) in enumerate(((after, half), (after + half, wide - half))):
            part = F.shiftleft(_bits("fp", shift, width), w).bitwiseOR(_bits("fp", at, w))
            keys.append(F.struct(F.lit(2 * i + j).alias("way"), part.alias("part")))
    return prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.way", "key.part")


def _chains_hold(distance: int) -> Column:
    """Whether every chain of segments from that of ``way`` on keeps its budget, for fp_a and fp_b."""
    count = distance + 1
    ring = _segments(64, count)
    differing = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    within = F.lit(False)
    for i in range(count):
        chain, met = F.lit(0), F.lit(True)
        for n in range(count):
            shift, width = ring[(i + n) % count]
            chain = chain + F.bit_count(F.shiftrightunsigned(differing, shift).bitwiseAND(F.lit((1 << width) - 1)))
            met = met & (chain <= (n + 1) * distance // count)
        within = within | ((F.col("way") >= 2 * i) & (F.col("way") <= 2 * i + 1) & met)
    return within


def pigeonring_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (fp_a, fp_b), fp_a < fp_b, of the distinct values of ``prints.fp`` at 1 to ``distance`` differing bits.

    The 64 bits form a ring of distance + 1 segments. If at most ``distance`` bits differ, a segment exists
    from which every chain of l consecutive segments differs in at most l * distance / (distance + 1) bits,
    rounded down. So the first segment of that chain is equal, and the second differs in at most one bit:
    one of its two halves is equal too. The join key is the first segment with such a half, the join condition
    holds every longer chain to its budget, and the whole ring is the Hamming check.
    """
    rows = _ring_rows(prints, distance)
    a, b = rows.select(F.col("fp").alias("fp_a"), "way", "part"), rows.select(F.col("fp").alias("fp_b"), "way", "part")
    return a.join(b, ["way", "part"]).where((F.col("fp_a") < F.col("fp_b")) & _chains_hold(distance)).select("fp_a", "fp_b").distinct()


def pigeonring_stars(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Those of the pairs whose first value is the least of all that start a chain alike: as many as values, whatever the
    groups. They join most of a group, and are for callers that look for the other links by other means."""
    rows = _ring_rows(prints, distance)
    least = cut(rows.groupBy("way", "part").agg(F.min("fp").alias("fp_a"), F.max("fp").alias("last")).where("fp_a < last").drop("last"))
    pairs = rows.withColumnRenamed("fp", "fp_b").join(least, ["way", "part"])
    return pairs.where((F.col("fp_a") != F.col("fp_b")) & _chains_hold(distance)).select("fp_a", "fp_b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: its id, fp (signed 64 bits), component_id and text_key (a hash of the text).

    Texts whose fingerprints differ in at most ``distance`` bits are linked; component_id is the smallest id
    reachable. Equal fingerprints form one class before any pair is made, so a group of copies of any size adds
    one row to the join. Null and empty texts have fingerprint 0 and are linked like others. A null id is
    never a component_id unless a component has no other; repeated rows each give a row. No rows give no rows.
    Other columns of ``docs``, whatever their names, are not read.
    """
    text = text_or_empty(docs, text_column)
    base = docs.select(docs[id_column].cast("long").alias("id"), F.xxhash64(text).alias("text_key"), fingerprint_column(text, width).alias("fp"))
    base = cut(base)
    classes = base.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = connected_components(pigeonring_pairs(base, distance))
    # Components are found over fingerprints; the smallest id among their classes names them.
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return base.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id", "text_key")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is component_id.

    Of several rows with that id one stays. All columns are returned as they are.
    """
    found = near_duplicates(docs, id_column, text_column, width, distance)
    kept = found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_column).alias("kept_id")).agg(F.min("text_key").alias("kept_key"))
    match = docs[id_column].cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(text_or_empty(docs, text_column)) == F.col("kept_key"))
    return docs.join(kept, match, "left_semi").dropDuplicates([id_column])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
