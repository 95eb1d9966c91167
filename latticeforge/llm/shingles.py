"""Near copies by the exact Jaccard similarity of their word shingles.

Shingles are compared by 64-bit hashes, in one order for all texts, rare ones first. Two sets of similarity t share a
shingle among the first n - ceil(t * n) + 1 of either, so these prefixes are all that is joined; sizes and places in
the prefix bound what a pair can share. Every candidate is verified on its whole sets: no pair of t or more is lost, and
none below it is linked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, tables, text_or_empty
from ._components import connected_components
from .simhash import majority, pigeonring_stars

#: Counters a text in the table that tells rare shingles from frequent ones, bits of the greatest number of them, and of those
#: in a row. None changes a result: any one order finds all pairs, and that of rare shingles first finds them with the fewest candidates.
COUNTERS, MOST_BITS, ROW_BITS = 64, 24, 16
#: Rows of three numbers that may be broadcast, and links whose components the driver finds; more are joined by a shuffle.
FEW = 100_000
#: Bits of parity, a multiple of 64.
PARITIES = 1024
#: Longs of parity that go with the entries of shingles, so that most pairs are never made.
FOLDED = 4
#: Bytes of texts that may be broadcast to be verified, and hashes of them that a task remembers.
FEW_BYTES, HELD = 4_000_000, 1_000_000
#: Parts in which the entries are shuffled, one after another, which bounds the disk that shuffles hold at a time.
PARTS = 2
_SLACK = 1e-9


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles of ``text``, rising; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, n = b" ".join(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, n - width + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], 42) for a, b in zip(starts, ends[min(n, width) - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)).view(np.int64))


def _counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of shingles in a table of 2 ** ``bits`` counters."""
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _prefixes(text: Column, width: int, similarity: float, rarity: np.ndarray) -> Column:
    """Structs of a hash of the whole set, its size, its SimHash, its parities and its first shingles.

    The parities are bits, one for each remainder of the hashes, set if an odd number of shingles has it. Sets that differ
    in k shingles differ in k of these bits at most.
    """
    bits = len(rarity).bit_length() - 1

    @F.pandas_udf("key long, n int, fp long, parity array<long>, prefix array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sizes, prints, parities, prefixes = [], [], [], [], []
            for t in batch:
                hashes = shingle_hashes(t, width)
                n = len(hashes)
                keys.append(xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63))
                sizes.append(n)
                odd = np.bincount((hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(PARITIES), minlength=PARITIES) % 2
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                prints.append(majority(hashes.view(np.uint64)) if n else 0)
                length = n - math.ceil(similarity * n - _SLACK) + 1 if n else 0
                prefixes.append(hashes[np.argsort(rarity[_counter(hashes, bits)], kind="stable")[:length]])
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "n": pd.Series(sizes, dtype="int32"), "fp": pd.Series(prints, dtype="int64"), "parity": pd.Series(parities, dtype="object"), "prefix": pd.Series(prefixes, dtype="object")})

    return found(text)


def _rarity(docs: DataFrame, text: Column, width: int) -> np.ndarray:
    """A table of counters, of one byte: about 16 times the logarithm of the texts that hold a shingle of each place.

    All texts are counted. A shingle shares its place with others, which adds as much to all, give or take: so the shingles of a
    large group stand out whatever the number of texts, which those of a sample of fixed size do not.
    """
    bits = min(MOST_BITS, max(ROW_BITS, (COUNTERS * docs.count()).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at = _counter(shingle_hashes(t, width), bits)
                seen[at] += seen[at] < 255
        for i, block in enumerate(np.split(seen, 1 << bits - ROW_BITS)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                sums[part] = sums[part] + block if part in sums else block.astype(np.uint32)
        for part, total in sums.items():
            scaled = np.minimum(255, np.rint(16 * np.log2(1.0 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([scaled.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    rows = docs.select(text.alias("t")).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros(1 << bits, np.uint8)
    for part, counts in rows:
        out[part << ROW_BITS : part + 1 << ROW_BITS] = np.frombuffer(counts, np.uint8)
    return out


def _sizes_fit(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - _SLACK


def _possible(similarity: float) -> Column:
    """Whether sets of n_a and n_b shingles that first meet at pos_a and pos_b can be similar enough."""
    na, nb = F.col("n_a"), F.col("n_b")
    left = F.least(na - F.col("pos_a"), nb - F.col("pos_b"))
    return _sizes_fit(similarity) & (left >= similarity / (1 + similarity) * (na + nb) - _SLACK)


def _folded(parity: str) -> list[Column]:
    """Fewer parities, each of several: sets that differ in k shingles differ in k of these bits at most, too."""
    return [reduce(Column.bitwiseXOR, [F.get(parity, i) for i in range(n, PARITIES // 64, FOLDED)]) for n in range(FOLDED)]


def _parities_fit(similarity: float) -> Column:
    """Whether the parities leave room for sets as similar as that: no pair that is so fails."""
    both = F.col("n_a") + F.col("n_b")
    differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differ <= both - 2 * F.ceil(similarity / (1 + similarity) * both - _SLACK)


def _similar(similarity: float, width: int):
    """Whether two texts are similar enough, by their whole sets."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[str, np.ndarray] = {}

        def hashes(text: str) -> np.ndarray:
            found = held.get(text)
            if found is None:
                if sum(map(len, held.values())) > HELD:
                    held.clear()
                found = held[text] = shingle_hashes(text, width)
            return found

        for first, second in batches:
            out = []
            for x, y in zip(first, second, strict=True):
                a, b = hashes(x), hashes(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both >= similarity * (len(a) + len(b) - both) - _SLACK)
            yield pd.Series(out, dtype=bool)

    return similar


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, component_id and text_key (a hash of the text).

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more are linked, those of
    equal sets (empty ones, too) always; component_id is the smallest id reachable. Case and white space do not count. A
    null id is never a component_id unless a component has no other.

    Links are looked for in two steps: between SimHash fingerprints of the sets at ``distance`` differing bits, through
    pigeonring filtering, and between each text and one that shares a prefix shingle; then between all pairs that share one
    and are not in one component yet. The second step misses no link, the first spares it the groups.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, and 1 at most")
    text = text_or_empty(docs, text_column)
    spark = docs.sparkSession
    with tables(spark) as keep:
        found = _prefixes(text, width, similarity, _rarity(docs, text, width))
        base = docs.select(docs[id_column].cast("long").alias("id"), F.xxhash64(text).alias("text_key"), found.alias("f"))
        with tables(spark) as hold:
            # Equal sets are one class before any pair is made.
            rows = hold(base.select("id", "text_key", "f.*"))
            base = keep(rows.select("id", "text_key", "key"))
            first_row = F.min_by("text_key", F.struct(F.col("id").isNull(), "id", "text_key")).alias("rep_key")
            classes = keep(rows.groupBy("key").agg(F.min("id").alias("rep"), first_row, *[F.first(c).alias(c) for c in ("fp", "n", "parity", "prefix")]))
        links = spark.createDataFrame([], "a long, b long")

        def verified(pairs: DataFrame) -> DataFrame:
            """Those of the pairs (a, b) of classes that are similar enough. Texts travel, not sets, which are larger."""
            of = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
            pairs = keep(pairs.distinct())
            pairs = keep(pairs.join(of("a"), "a").join(of("b"), "b").where(_parities_fit(similarity)).select("a", "b"))
            needed = keep(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", F.col("rep").alias("id"), "rep_key"))
            texts = docs.select(docs[id_column].cast("long").alias("row_id"), F.xxhash64(text).alias("row_key"), text.alias("t"))
            wanted = F.broadcast(needed) if needed.count() <= FEW else needed
            texts = texts.join(wanted, (F.col("row_key") == F.col("rep_key")) & F.col("row_id").eqNullSafe(F.col("id")))
            texts = keep(texts.dropDuplicates(["key"]).select("key", "t"))
            if (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= FEW_BYTES:
                texts = F.broadcast(texts)
            both = pairs.join(texts.select(F.col("key").alias("b"), F.col("t").alias("t_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("t").alias("t_a")), "a")
            return cut(both.where(_similar(similarity, width)(F.col("t_a"), F.col("t_b"))).select("a", "b"))

        def roots() -> DataFrame:
            nonlocal links
            found = cut(connected_components(links, few=FEW))
            links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))  # as good as all so far, and settled sooner
            return found

        # Fingerprints: the classes of one fingerprint with the least of them, and the least of fingerprints that are near.
        least = keep(classes.groupBy("fp").agg(F.min("key").alias("a")))
        alike = classes.join(least, "fp").where("a != key").select("a", F.col("key").alias("b"))
        near = pigeonring_stars(least, distance)
        near = near.join(least.select(F.col("fp").alias("fp_a"), "a"), "fp_a").join(least.select(F.col("fp").alias("fp_b"), F.col("a").alias("b")), "fp_b").select("a", "b")

        def shared(entries: DataFrame, name: str) -> DataFrame:
            """The entries of shingles with which several values of ``name`` come."""
            out = []
            for part in range(PARTS):
                here = entries.where(F.pmod("h", F.lit(PARTS)) == part)
                several = keep(here.groupBy("h").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low != high").select("h"))
                out.append(keep(here.join(several, "h", "left_semi")))
            return reduce(DataFrame.union, out)

        # Prefixes: shingles that several texts share, first with one of the texts.
        some = shared(classes.select("key", "n", F.posexplode("prefix").alias("pos", "h")), "key")
        first = keep(some.groupBy("h").agg(F.min(F.struct(F.xxhash64("key", F.lit(1)), "key", "n")).alias("first")))
        stars = some.join(first, "h").select(F.col("first.key").alias("a"), F.col("first.n").alias("n_a"), F.col("key").alias("b"), F.col("n").alias("n_b"))
        stars = stars.where((F.col("a") != F.col("b")) & _sizes_fit(similarity)).select("a", "b")
        links = links.union(verified(alike.union(near).union(stars)))
        # Then all pairs of texts that are not in one component yet.
        rooted = some.join(roots(), F.col("key") == F.col("node"), "left").select("h", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
        folded = classes.select("key", F.array(*_folded("parity")).alias("parity"))
        some = keep(shared(rooted, "root").join(folded, "key"))
        side = lambda x, s: x.select("h", F.struct("n", "key").alias(f"at_{s}"), F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("root").alias(f"root_{s}"), F.col("parity").alias(f"parity_{s}"))
        met = side(some, "a").join(side(some, "b"), "h").where((F.col("at_a") < F.col("at_b")) & (F.col("root_a") != F.col("root_b")) & _possible(similarity) & _parities_fit(similarity))
        links = links.union(verified(met.select("a", "b")))
        named = classes.join(roots(), F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
        smallest = keep(named.groupBy("root").agg(F.min("rep").alias("component_id")))
        named = keep(named.join(smallest, "root").select("key", "component_id"))
        return cut(base.select("id", "key", "text_key").join(named, "key").select(F.col("id").alias(id_column), "component_id", "text_key"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component of near copies: the one whose id is component_id.

    Of several rows with that id one stays. All columns are returned as they are.
    """
    found = near_copies(docs, id_column, text_column, width, similarity)
    kept = found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_column).alias("kept_id")).agg(F.min("text_key").alias("kept_key"))
    match = docs[id_column].cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(text_or_empty(docs, text_column)) == F.col("kept_key"))
    return docs.join(kept, match, "left_semi").dropDuplicates([id_column])
