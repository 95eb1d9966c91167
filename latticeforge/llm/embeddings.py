"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by the pivots nearest to it, in order. It enters the inverted list of each pair of its
nearest pivots, per label. Two vectors that meet in a list share those two pivots; they are compared only if they
share enough of all their listed pivots, and then by cosine in double precision. A pair that meets in several
lists is counted in the first of them only.

Pivots grow with the square root of the number of vectors, so lists stay short as vectors are added; lists hold
ids, and only vectors that meet another one in a list are fetched. A list of many vectors is spread over pairs of blocks of
bounded size, so no task holds a whole list, and every pair is still met once. A task returns, for each vector, its number
of links and the smallest vector it is joined to in that block: output grows with the list, not with its pairs. The work
inside a list grows with its pairs: all links of a group of near copies are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table
from ._components import connected_components

PIVOTS, NEAREST, LISTED, SHARED, SAMPLE, BLOCK, SEED = 64, 8, 5, 3, 4096, 1024, 11


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe from overflow and underflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` directions at most from the sample, each far from those before it, in random order."""
    rng = np.random.default_rng(seed)
    unit = _unit(sample)[rng.permutation(len(sample))]
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        at = int(np.argmin(nearest))
        chosen.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[chosen]


def _describe(pivots: np.ndarray, nearest: int, listed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            out: dict[str, list] = {"c": [], "label": [], "n": [], "near": [], "lists": [], "vector": []}
            ids, labels, times = (batch.column(n).to_pylist() for n in ("c", "label", "n"))
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                x = np.array([rows[i] for i in at], np.float64)
                if size == pivots.shape[1]:
                    order = np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                else:  # vectors of another size than most have lists of their own
                    order = np.tile(np.arange(nearest, dtype=np.int32), (len(at), 1))
                for i, near in zip(at, order.tolist(), strict=True):
                    top = sorted(near[:listed])
                    out["c"].append(ids[i])
                    out["label"].append(labels[i])
                    out["n"].append(times[i])
                    out["near"].append(near)
                    out["lists"].append([a << 32 | b for a, b in combinations(top, 2)] if size == pivots.shape[1] else [-1 - size])
                    out["vector"].append(rows[i])
            yield pa.RecordBatch.from_arrays([pa.array(out["c"], pa.int64()), pa.array(out["label"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["near"], pa.list_(pa.int32())), pa.array(out["lists"], pa.list_(pa.int64())), pa.array(out["vector"], batch.column("vector").type)], names=list(out))

    return scan


def _marks(near: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros((len(near), wide), np.float32)
    np.put_along_axis(out, near.astype(np.int64), 1, axis=1)
    return out


def _compare(limit: float, shared: int, listed: int, own_size: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """A pair of blocks of one list, or, where all rows are of side 2, one block with itself."""
        itself = bool((pdf["side"] == 2).all())
        first, second = (pdf, pdf) if itself else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
        none = pd.DataFrame({"c": [], "links": [], "low": []}).astype("int64")
        if not len(first) or not len(second):
            return none
        a, b = (_unit(np.stack(x["vector"].to_numpy())) for x in (first, second))
        ids_a, ids_b = first["c"].to_numpy(), second["c"].to_numpy()
        candidates = ids_a[:, None] < ids_b[None, :] if itself else np.ones((len(a), len(b)), bool)
        ordered = len(pdf["vector"].iloc[0]) == own_size
        if ordered:
            near_a, near_b = (np.stack(x["near"].to_numpy()) for x in (first, second))
            pivots = np.unique(np.concatenate([near_a, near_b]))  # few of all, in their order
            near_a, near_b, wide = np.searchsorted(pivots, near_a), np.searchsorted(pivots, near_b), len(pivots)
            candidates &= _marks(near_a, wide) @ _marks(near_b, wide).T >= shared
        rows, cols = np.nonzero(candidates & (a @ b.T >= limit))
        if ordered and len(rows):
            # The pair belongs to the list of the two least pivots that both have listed.
            top_a, top_b = _marks(near_a[:, :listed], wide) > 0, _marks(near_b[:, :listed], wide) > 0
            own = int(pdf["list"].iloc[0])
            here = []
            for at in range(0, len(rows), 65536):
                both = top_a[rows[at : at + 65536]] & top_b[cols[at : at + 65536]]
                low = both.argmax(axis=1)
                both[np.arange(len(both)), low] = False
                here.append((pivots[low].astype(np.int64) << 32 | pivots[both.argmax(axis=1)]) == own)
            here = np.concatenate(here)
            rows, cols = rows[here], cols[here]
        if not len(rows):
            return none
        ids = np.unique(np.concatenate([ids_a[rows], ids_b[cols]]))
        left, right = np.searchsorted(ids, ids_a[rows]), np.searchsorted(ids, ids_b[cols])
        links = np.bincount(left, second["n"].to_numpy()[cols], len(ids)) + np.bincount(right, first["n"].to_numpy()[rows], len(ids))
        root = np.arange(len(ids))
        while True:  # the least label of the neighbours, until nothing changes
            before = root.copy()
            np.minimum.at(root, left, root[right])
            np.minimum.at(root, right, root[left])
            root = root[root]
            if (root == before).all():
                break
        return pd.DataFrame({"c": ids, "links": links.astype(np.int64), "low": ids[root]})

    return block


def _blocks(index: DataFrame, block: int) -> DataFrame:
    """Each vector once for every pair of blocks that its block is part of, in each of its lists that holds another one."""
    lists = index.select("c", "label", F.explode("lists").alias("list"))
    sizes = lists.groupBy("label", "list").agg(F.count("*").alias("m")).where("m > 1")
    sizes = cut(sizes.select("label", "list", F.ceil(F.col("m") / block).alias("of")))
    lists = lists.join(sizes, ["label", "list"]).withColumn("b", F.pmod(F.hash("c"), F.col("of")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))
    pairs = lists.withColumn("o", other)
    side = F.when(F.col("o") == F.col("b"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    pairs = pairs.select("c", "label", "list", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), side.alias("side"))
    return pairs.join(index.select("c", "n", "near", "vector"), "c").select("label", "list", "i", "j", "side", "c", "n", "near", "vector")


def near_duplicates(vectors: DataFrame, limit: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", pivots: int | None = None, nearest: int = NEAREST, listed: int = LISTED, shared: int = SHARED, sample: int = SAMPLE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows with equal labels are linked if their cosine is at least ``limit`` and the index finds them: they share
    two of their ``listed`` nearest of ``pivots`` pivots and ``shared`` of their ``nearest``. Every link returned
    is verified; recall is measured in the tests. Vectors that are null, empty, zero or hold null or non-finite
    components, and those without label, link with nothing. Vectors of different sizes are never linked.

    Equal vectors of a label are one class, told by 128 bits, which is never expanded into pairs. There are ``pivots`` pivots,
    by default a third of the square root of the number of classes, 64 at least, chosen from ``sample`` rows, or as many as there are
    pivots, those with the least hash; all rows are indexed. Repeated ids are separate vectors; a null id has no
    links of its own to name and its component is that of the smallest id reached. Extra columns are not read.
    """
    kind = dict(vectors.dtypes)[vector_column]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast(kind).alias("vector"), vectors[label_column].cast("long").alias("label"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("fit", fit)
    rows = rows.withColumn("h1", F.when(F.col("fit"), F.xxhash64("label", "vector"))).withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(1), "label", "vector")))
    rows = cut(rows)
    members = rows.where("fit")
    classes = members.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))  # numbers that are written, and so stay
    pivots = pivots or max(PIVOTS, math.isqrt(classes.count()) // 3)
    sample = max(sample, pivots)
    few = classes.orderBy(F.xxhash64("h1", F.lit(seed)), "h1", "h2").limit(sample).select("vector").toPandas()["vector"]
    if not len(few):
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    size = int(few.map(len).mode().iloc[0])
    points = choose_pivots(np.stack(few[few.map(len) == size].to_numpy()), pivots, seed)
    nearest, listed = min(nearest, len(points)), min(listed, len(points))
    shared = min(shared, nearest)
    if listed < 2:  # too few vectors to choose two pivots from: one list for all
        points, size = np.zeros((nearest, 0)), -1
    index = classes.select("c", "label", "n", "vector").mapInArrow(_describe(points, nearest, listed), f"c long, label long, n long, near array<int>, lists array<long>, vector {kind}")
    blocks = _blocks(cut(index), block).groupBy("label", "list", "i", "j")
    found = cut(blocks.applyInPandas(_compare(limit, shared, listed, size), "c long, links long, low long"))
    roots = connected_components(found.select("c", "low"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "h1", "h2", "id", "n").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    named = named.select("h1", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    named = cut(named.select("h1", "h2", "n_links", "component_id"))
    linked = members.join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs by brute force, which small tables allow; vectors of one size.
ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""
