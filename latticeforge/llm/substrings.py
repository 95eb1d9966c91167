"""Substring deduplication by level-wise doubling of repeated word windows.

A window of ``length`` words that occurs twice holds equal windows of about half and a quarter of that length at
the same offsets. So the levels start from quarter windows and extend only those found more than once: a level
counts its windows by hash, drops those that occur once, and doubles the rest, until those of the full length
are left.

At the first level not every quarter window is counted: each full window names the quarter window in it with
the least hash, its anchor, and only anchors are counted. Equal full windows name the same anchor at the same
offset, so none is lost, and about one word position in fourteen makes a row.

Tables between levels hold hashes and positions. Texts go through two joins, compressed: when full windows are
hashed around the anchors that are left, and when words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table, tables, text_or_empty

# Odd multipliers of a well-known 64-bit mixing function.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_VOCABULARY = 300_000


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of concatenated windows from those of their halves."""
    z = a * _M1 + (b ^ (b >> np.uint64(29)))
    z = (z ^ (z >> np.uint64(30))) * _M2
    return z ^ (z >> np.uint64(27))


class _Words:
    """Hashes of words; remembers so many at most."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _VOCABULARY:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def _windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words; windows of twice a length are joined from two of that length."""
    if len(words) < length:
        return words[:0]
    have, size = words, 1
    while 2 * size <= length:
        have, size = _join(have[:-size], have[size:]), 2 * size
    if size < length:
        have = _join(have[: len(have) - (length - size)], have[length - size :])
    return have


def _levels(length: int) -> tuple[int, int]:
    """Half and quarter of a window, rounded up."""
    half = -(-length // 2)
    return half, -(-half // 2)


def _anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of quarter windows; the anchor of each full window; the first full window of each run with one anchor."""
    quarter = _windows(words, _levels(length)[1])
    if len(words) < length:
        none = np.zeros(0, np.int64)
        return quarter, none, none
    span = len(quarter) - (len(words) - length)
    views = np.lib.stride_tricks.sliding_window_view(quarter, span)
    anchor = np.concatenate([views[a : a + 8192].argmin(axis=1) for a in range(0, len(views), 8192)]) + np.arange(len(views))
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return quarter, anchor, starts


def text_key(text: bytes) -> tuple[int, int]:
    """Identity of a text: 128 bits, as two signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(text), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _keys(keys: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)]


def _encoded(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _first_level(length: int):
    half, quarter_size = _levels(length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for text in _encoded(batch.column("text")):
                parts = text.split()
                if len(parts) < length:
                    continue
                words = hashes(parts)
                quarter, anchor, starts = _anchors(words, length)
                at = anchor[starts]
                halves = _windows(words, half)
                # A full window holds the half window that ends or the one that begins with its anchor.
                left = np.where(at + quarter_size >= half, halves[np.maximum(at + quarter_size - half, 0)], np.uint64(0))
                right = np.where(at < len(halves), halves[np.minimum(at, len(halves) - 1)], np.uint64(0))
                for out, values in zip(columns, (*(np.full(len(at), x, np.int64) for x in text_key(text)), quarter[at].view(np.int64), at.astype(np.int32), left.view(np.int64), right.view(np.int64)), strict=True):
                    out.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["k", "q", "h", "p", "l", "r"])

    return scan


def _full_level(length: int):
    """For texts with their surviving anchors: runs of full windows around each anchor, as hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, plain = _Words(), zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("k", "q", "n", "h", "s", "g", "w", "run")}
            for k, q, n, packed, at in zip(*(batch.column(c).to_pylist() for c in ("k", "q", "n", "packed")), batch.column("at"), strict=True):
                words = hashes(plain.decompress(packed).split())
                quarter, anchor, starts = _anchors(words, length)
                full = _windows(words, length)
                ends = np.r_[starts[1:], len(anchor)]
                wanted = np.isin(anchor[starts], at.values.to_numpy(zero_copy_only=False))
                for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                    blob = full[s:e].tobytes()
                    out["k"].append(k)
                    out["q"].append(q)
                    out["n"].append(n)
                    out["h"].append(int(quarter[anchor[s]].view(np.int64)))
                    out["s"].append(s)
                    out["g"].append(e - s)
                    out["w"].append(blob)
                    out["run"].append(text_key(blob)[1])
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int64()), pa.array(out["q"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["h"], pa.int64()), pa.array(out["s"], pa.int32()), pa.array(out["g"], pa.int32()), pa.array(out["w"], pa.binary()), pa.array(out["run"], pa.int64())], names=list(out))

    return scan


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (h, run, n, w) to their windows (h, run, j, x, n)."""
    for batch in batches:
        h, run, n, blobs = (batch.column(i) for i in range(4))
        sizes = np.array([len(b.as_py()) // 8 for b in blobs], np.int64)
        if not sizes.sum():
            continue
        x = np.frombuffer(b"".join(blobs.to_pylist()), np.int64)
        j = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        repeat = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), sizes))
        yield pa.RecordBatch.from_arrays([repeat(h), repeat(run), pa.array(j.astype(np.int32)), pa.array(x), repeat(n)], names=["h", "run", "j", "x", "n"])


def _kept(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Words, removed words and the kept words of a text, given runs (start, count) of repeated windows."""
    words = text.split()
    covered = np.zeros(len(words) + 1, np.int64)
    for s, g in spans:
        covered[s] += 1
        covered[s + g + length - 1] -= 1
    keep = np.cumsum(covered)[:-1] == 0
    return len(words), int((~keep).sum()), b" ".join(w for w, good in zip(words, keep.tolist(), strict=True) if good)


def _summaries(length: int):
    """Of every row: its text's key, words, and the hash of all its words joined by one space."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in _encoded(batch.column("text")):
                words = text.split()
                keys.append(text_key(text))
                sizes.append(len(words))
                hashes.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_keys(keys), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], names=["id", "k", "q", "n_words", "sha"])

    return scan


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = _encoded(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *_keys([text_key(t) for t in texts]), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["id", "k", "q", "packed"])


def _removed(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [_kept(plain.decompress(t), [(x["s"], x["g"]) for x in spans], length) for t, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("q"), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].decode("utf-8") for f in found], pa.string())], names=["k", "q", "n_removed", "kept"])

    return scan


def _repeated(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """The keys that occur more than once."""
    n = F.sum(weight) if weight else F.count("*")
    return rows.groupBy(*keys).agg(n.alias("times_")).where("times_ > 1").drop("times_")


class Found:
    """What ``repeated_windows`` finds.

    rows: (id, k, q, n_words, sha) per row of the input, k and q its text's key. copies: (k, q, n, id) per text, id
    the smallest. spans: (k, q, spans) for texts that occur once and hold repeated windows; spans are arrays of
    (s, g), g windows from word s on. A text that occurs more often repeats as a whole, if it is long enough.
    """

    def __init__(self, rows: DataFrame, copies: DataFrame, spans: DataFrame, texts: DataFrame) -> None:
        self.rows, self.copies, self.spans, self.texts = rows, copies, spans, texts


def repeated_windows(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text") -> Found:
    """Finds every window of ``length`` words whose sequence also starts elsewhere, same document included."""
    if length < 4:
        raise ValueError("windows have 4 words at least")
    texts = docs.select(docs[id_column].cast("long").alias("id"), text_or_empty(docs, text_column).alias("text"))
    rows = cut(texts.mapInArrow(_summaries(length), "id long, k long, q long, n_words long, sha binary"))
    copies = cut(rows.groupBy("k", "q").agg(F.count("*").alias("n"), F.min("id").alias("id")))

    spark = docs.sparkSession
    packed = texts.mapInArrow(_packed, "id long, k long, q long, packed binary")
    with tables(spark) as keep_quarters:
        # Quarter windows.
        anchors = keep_quarters(texts.select("text").mapInArrow(_first_level(length), "k long, q long, h long, p int, l long, r long"))
        with tables(spark) as keep_halves:
            left = keep_halves(anchors.join(keep_halves(_repeated(anchors, ["h"])), "h", "left_semi"))
            # Half windows: to the left and to the right of a quarter window that is left.
            side = lambda n, x: F.struct(F.lit(n).alias("side"), F.col(x).alias("x"))
            halves = left.select("k", "q", "p", F.explode(F.array(side(0, "l"), side(1, "r"))).alias("half")).select("k", "q", "p", "half.side", "half.x").where("x != 0")
            halves = halves.join(keep_halves(_repeated(halves, ["side", "x"])), ["side", "x"], "left_semi")
            wanted = cut(halves.groupBy("k", "q").agg(F.collect_set("p").alias("at")))
    with tables(spark) as keep:
        # Full windows around those, one text for all its copies.
        one = cut(wanted.join(copies.select("k", "q", "id", F.least("n", F.lit(2)).alias("n")), ["k", "q"]))
        same = (packed["k"] == one["k"]) & (packed["q"] == one["q"]) & packed["id"].eqNullSafe(one["id"])
        runs = packed.join(one, same).select(packed["k"], packed["q"], "n", "packed", "at").mapInArrow(_full_level(length), "k long, q long, n long, h long, s int, g int, w binary, run long")
        runs = keep(runs)
        whole = keep(runs.groupBy("h", "run").agg(F.sum("n").alias("n"), F.min_by("w", "s").alias("w")))
        # Where all runs with an anchor are equal, their number decides; else each window counts.
        mixed = keep(_repeated(whole, ["h"]))
        windows = keep(whole.join(mixed, "h", "left_semi").select("h", "run", "n", "w").mapInArrow(_spread, "h long, run long, j int, x long, n long"))
        found = windows.join(keep(_repeated(windows, ["h", "x"], "n")), ["h", "x"], "left_semi").where("n = 1").select("h", "run", "j")
        alone = runs.where("n = 1").select("k", "q", "s", "g", "h", "run")
        spans = alone.join(whole.where("n > 1").select("h", "run"), ["h", "run"], "left_semi").select("k", "q", "s", "g")
        spans = spans.union(alone.select("k", "q", "s", "h", "run").join(found, ["h", "run"]).select("k", "q", (F.col("s") + F.col("j")).alias("s"), F.lit(1).alias("g")))
        spans = cut(spans.groupBy("k", "q").agg(F.collect_list(F.struct("s", "g")).alias("spans")))
    return Found(rows, copies, spans, packed)


def deduplicate(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (the words left, joined by one space, or null
    where nothing is removed) and kept_sha256.

    Words are runs of characters other than ASCII white space, unchanged. Each word covered by a window of
    ``length`` words whose sequence also starts anywhere else is removed; windows are judged on the input. Null
    texts have no words; texts shorter than a window keep all; of repeated rows and copies none is spared.
    Null and repeated ids are allowed; other columns are not read; no rows give no rows.
    """
    found = repeated_windows(docs, length, id_column, text_column)
    changed = found.texts.join(found.spans, ["k", "q"]).select("k", "q", "packed", "spans").mapInArrow(_removed(length), "k long, q long, n_removed long, kept string")
    rows = found.rows.join(found.copies.select("k", "q", "n"), ["k", "q"]).join(cut(changed), ["k", "q"], "left")
    gone = (F.col("n") > 1) & (F.col("n_words") >= length)
    return rows.select(
        F.col("id").alias(id_column),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, "").otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM starts
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY t) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
