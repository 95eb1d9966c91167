"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared by words. Runs of five words that a text shares with an item are seeds; the
pairs of text and item that they join are tiled: the longest matches of unmarked words are marked in both, then
shorter ones, until none of five words is left. Matches of a length are found by Karp-Rabin hashing of the unmarked
runs. The share of the item that tiles cover does not depend on their order in the text, so passages whose sentences
were moved are caught. A text that covers enough of any item is contaminated.

The benchmark is a query set of stated size against all texts. It is read in blocks of bounded size; each block goes to
the executors and meets every text there. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fresh, table, text_or_empty

WORD = re.compile(r"\w+")
#: Least tile in words; least share of an item's words covered; words of items that go to executors at once, about.
LEAST, COVERED, BLOCK_WORDS = 5, 0.6, 2_000_000
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2 to the 64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[at] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class _Side:
    """The words of one side, as Karp-Rabin sums, and which of them are marked."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.marked = words, np.zeros(len(words), bool)
        mixed = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed * _powers(len(words) + 1)[1][:-1], dtype=np.uint64)]
        self.refresh()

    def refresh(self) -> None:
        self.before = np.r_[0, np.cumsum(self.marked)]

    def longest(self) -> int:
        """Length of the longest run of unmarked words."""
        edges = np.flatnonzero(np.diff(np.r_[True, self.marked, True].astype(np.int8)))
        return int((edges[1::2] - edges[::2]).max(initial=0))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``length`` unmarked words."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero(self.before[length:] == self.before[:n])
        return starts, (self.sums[starts + length] - self.sums[starts]) * _powers(len(self.words) + 1)[0][starts + length - 1]


def tiles(pattern: list[int], text: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length), longest first; ties in order of starts.

    The length of the longest matches of unmarked words is found by halving, as shorter matches exist wherever longer
    ones do; the windows of that length are then paired by hash, each taken once, so repeated words cost no more than others.
    """
    p, t, out = _Side(np.asarray(pattern, np.int64)), _Side(np.asarray(text, np.int64)), []
    high = min(p.longest(), t.longest())
    while high >= least:
        low, top = 0, high  # matches of low words exist, or low is 0; none of more than top
        while low < top:
            length = max(least, (low + top + 1) // 2)
            if np.isin(p.windows(length)[1], t.windows(length)[1]).any():
                low = length
            elif length == least:
                break
            else:
                top = length - 1
        if not low:
            break
        _mark(p, t, low, out)
        high = min(low - 1, p.longest(), t.longest())
    return out


def _mark(p: _Side, t: _Side, length: int, out: list[tuple[int, int, int]]) -> None:
    """Marks the matches of ``length`` words that do not overlap, in order of their starts."""
    (p_at, p_hash), (t_at, t_hash) = p.windows(length), t.windows(length)
    keep = np.isin(t_hash, p_hash)
    groups: dict[int, list[int]] = {}
    for h, j in zip(t_hash[keep].tolist(), t_at[keep].tolist(), strict=True):
        groups.setdefault(h, []).append(j)
    at = dict.fromkeys(groups, 0)
    keep = np.isin(p_hash, t_hash)
    for h, i in zip(p_hash[keep].tolist(), p_at[keep].tolist(), strict=True):
        if p.marked[i] or p.marked[i + length - 1]:
            continue
        places = groups[h]
        while at[h] < len(places):
            j = places[at[h]]
            at[h] += 1
            if t.marked[j] or t.marked[j + length - 1]:
                continue  # tiles of this round are as long as the window: one that overlaps it holds one of its ends
            if not np.array_equal(p.words[i : i + length], t.words[j : j + length]):
                at[h] -= 1  # equal hashes of different words
                break
            p.marked[i : i + length] = t.marked[j : j + length] = True
            out.append((i, j, length))
            break
    p.refresh()
    t.refresh()


class Benchmark:
    """Items of a block: their words as numbers, and where each run of ``least`` words occurs, by hash. Items of equal words
    are one."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.numbers: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.words: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        hashes = []
        for item_id, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.uint64)
            if len(ids) < least:
                continue
            at = known.setdefault(ids.tobytes(), len(self.ids))
            if at == len(self.ids):
                self.ids.append([])
                self.words.append(ids.astype(np.int32))
                hashes.append(self._hashes(ids))
            self.ids[at].append(item_id)
        sizes = [len(h) for h in hashes]
        self.hash = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(hashes), dtype=np.int32), sizes)
        self.place = np.concatenate([*(np.arange(n, dtype=np.int32) for n in sizes), np.zeros(0, np.int32)])
        order = np.argsort(self.hash, kind="stable")  # within a hash by item, then place
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]

    def _hashes(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.least + 1
        h = np.zeros(n, np.uint64)
        for c in range(self.least):
            h = (h ^ ids[c : c + n]) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
        return h

    def coverage(self, text: str, threshold: float = 0.0) -> list[tuple[int, float, int]]:
        """(item, share of its words in tiles, words in tiles) of every item that tiles cover by ``threshold``.

        Tiles consist of seeds. The seeds that an item shares with the text, each of its places once, bound what tiles can
        cover; only items that this bound lets pass are tiled.
        """
        get, least = self.numbers.get, self.least
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        if len(ids) < least or not len(self.hash):
            return []
        known = np.r_[0, (ids != 0).cumsum()]
        at = np.flatnonzero(known[least:] - known[:-least] == least)
        if not len(at):
            return []
        h = self._hashes(ids)[at]
        own = np.unique(h)
        low, high = np.searchsorted(self.hash, own), np.searchsorted(self.hash, own, "right")
        n = high - low
        seeds = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(seeds):
            return []
        seeds = seeds[np.lexsort((self.place[seeds], self.item[seeds]))]
        item, place = self.item[seeds], self.place[seeds]
        first = np.r_[True, item[1:] != item[:-1]]
        step = np.r_[np.diff(place), 0]
        reach = np.where(np.r_[first[1:], True], least, np.minimum(step, least))  # words that a seed adds to those before it
        starts = np.flatnonzero(first)
        bound = np.add.reduceat(reach, starts)
        out = []
        for k, a, b in zip(bound.tolist(), starts.tolist(), [*starts[1:].tolist(), len(seeds)], strict=True):
            pattern = self.words[item[a]]
            if k < threshold * len(pattern):
                continue
            here = at[np.isin(h, self.hash[seeds[a:b]])]
            mark = np.zeros(len(ids) + 1, bool)
            for c in range(least):
                mark[here + c] = True
            part = np.where(mark[:-1], ids, 0).astype(np.int32)[mark[:-1] | mark[1:]]
            covered = sum(x for _, _, x in tiles(pattern, part, least))
            if covered >= threshold * len(pattern):
                out += [(item_id, covered / len(pattern), covered) for item_id in self.ids[item[a]]]
        return sorted(out, key=lambda x: (x[0] is None, x))


FOUND = "array<struct<item_id: long, coverage: double, words: long>>"


def _found(benchmark: Benchmark, threshold: float):
    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"item_id": i, "coverage": c, "words": w} for i, c, w in benchmark.coverage(t, threshold)] for t in batch])

    return found


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_words`` words, or one longer item."""
    rows = benchmark.select(benchmark[item_column].cast("long").alias("item_id"), text_or_empty(benchmark, text_column).alias("text")).distinct()
    block, n = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(r["text"]))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((r["item_id"], r["text"]))
        n += size
    yield block


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", least: int = LEAST, threshold: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a column ``name``: the items that the text covers by ``threshold`` or more, by item_id.

    It holds structs (item_id, coverage, words). Null and empty texts and items, and items of fewer than ``least``
    words, match nothing. Repeated rows each keep their row; an item that is repeated counts once, equal texts under
    several ids each count; an item's null id stays null. All columns of ``docs`` are kept. A benchmark of
    several blocks takes a pass over the texts for each; what a pass finds is kept by the text's hash.
    """
    text = text_or_empty(docs, text_column)
    blocks = _blocks(benchmark, item_column, item_text_column, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(name, _found(Benchmark(first, least), threshold)(text))
    passes = []
    for block in chain([first, second], blocks):
        found = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), _found(Benchmark(block, least), threshold)(text).alias("found"))
        passes.append(cut(found.where(F.size("found") > 0).distinct()))
    found = reduce(DataFrame.union, passes).groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias(name))
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit(1), text))
    joined = keyed.join(found.withColumnsRenamed({"k1": f"{k1}_", "k2": f"{k2}_"}), (F.col(k1) == F.col(f"{k1}_")) & (F.col(k2) == F.col(f"{k2}_")), "left")
    return joined.select(*[keyed[c] for c in docs.columns], F.coalesce(F.col(name), F.array().cast(FOUND)).alias(name))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text covers a benchmark item; the options are those of ``with_leaks``."""
    name = fresh(docs, "leaks")
    return with_leaks(docs, benchmark, name, **options).where(F.size(name) == 0).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (those it covers) and coverage (of the most covered)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"), "leaks")
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.col("leaks.item_id").alias("item_ids"),
        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"),
    )
