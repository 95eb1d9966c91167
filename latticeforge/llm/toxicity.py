"""Toxicity by maximum-scoring segments.

Tokens get log-odds of coming from a toxic text. Their prior is Dirichlet and nested: a word's share is drawn
towards that of its 5-letter beginning, this towards the 4-letter one, and so on, so that unseen forms of a known stem
count too. A scan linear in the number of tokens finds all maximal-scoring segments of a text. By extreme-value
theory the number of segments of clean text that reach score S by chance is K * m * exp(-lambda * S) in m tokens; the
chance that r segments are as good as the r-th best, least over r, is the text's evidence, and a logistic curve over its
logarithm, fitted on texts kept apart from the log-odds, turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table, text_or_empty

TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5)
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 6000
#: Weight of the prior in tokens; what every token costs; share of the sample that the curve is fitted on; least
#: likelihood-ratio statistic at which a unit's share counts as different from its stem's.
PRIOR, COST, APART, EVIDENT = 2.0, 0.5, 0.25, 16.0
#: A passage is significant if no more of its score are expected by chance in clean text of that length.
SIGNIFICANT = 0.05
_CACHE = 500_000


def units(word: str) -> list[str]:
    """Stems of a word, marked, shortest first, then the word."""
    return [word[:n] + "*" for n in STEMS if len(word) > n] + [word]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in time linear in their number and that of tokens."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, last one with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        before, after, first = total[i], total[i + 1], i
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= before:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= after:
                stack.append((before, after, first, i + 1, at))
                break
            before, first, at, low = stack[at][0], stack[at][2], stack[at][4], at
            del stack[low:]
    return [(first, end, float(after - before)) for before, after, first, end, _ in stack]


def _rarity(r: int, mean: float) -> float:
    """Minus the log of the chance that a Poisson variable is at least r."""
    if mean >= r:
        return 0.0
    term = total = 1.0
    k = r
    while term > 1e-12 * total:
        k += 1
        term *= mean / k
        total += term
    return max(0.0, mean - r * math.log(max(mean, 1e-300)) + math.lgamma(r + 1) - math.log(total))


def best_segments(scores: np.ndarray) -> list[float]:
    """Scores of all segments, falling: in a long text the evidence may lie in any number of them."""
    return sorted((s for _, _, s in segments(scores)), reverse=True)


class Model:
    """Log-odds by unit, the constants of chance segments, and the curve."""

    def __init__(self, odds: dict[str, float], scale: float = 1.0, density: float = 0.1, curve: tuple[float, float] = (0.0, 1.0)) -> None:
        self.odds, self.scale, self.density, self.curve = odds, scale, density, curve
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def token_score(self, word: str) -> float:
        for unit in reversed(units(word)):
            if unit in self.odds:
                return self.odds[unit] - COST
        return -COST

    def token_scores(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        out = []
        for word in TOKEN.findall(text.lower()):
            score = known.get(word)
            if score is None:
                score = known[word] = self.token_score(word)
            out.append(score)
        return np.array(out, np.float64)

    def evidence(self, tops: list[float], n: int) -> float:
        """Minus the log of the least chance, over r, that clean text of n tokens has r segments as good as its r-th best.

        Segments of score S or more come by chance as a Poisson process of mean K * n * exp(-lambda * S).
        """
        found = 0.0
        for r, s in enumerate(tops, 1):
            mean = self.density * max(1, n) * math.exp(-self.scale * s)
            # The chance is at least that of exactly r, which is cheap and spares most of the sums.
            if mean < r and mean - r * math.log(max(mean, 1e-300)) + math.lgamma(r + 1) > found:
                found = max(found, _rarity(r, mean))
        return found

    def judge(self, text: str | None, most_expected: float = SIGNIFICANT) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of a text, and (first token, end, score, number expected by chance) of its significant segments."""
        scores = self.token_scores(text or "")
        found = segments(scores)
        a, b = self.curve
        evidence = self.evidence(sorted((s for _, _, s in found), reverse=True), len(scores))
        chance = ((first, end, s, self.density * len(scores) * math.exp(-self.scale * s)) for first, end, s in found)
        return 1 / (1 + math.exp(-(a + b * math.log1p(evidence)))), [p for p in chance if p[3] <= most_expected]

    def probability(self, text: str | None) -> float:
        return self.judge(text)[0]

    def passages(self, text: str | None, most_expected: float = SIGNIFICANT) -> list[tuple[int, int, float, float]]:
        return self.judge(text, most_expected)[1]


def held_out(id_column: Column) -> Column:
    """Rows that no model may learn from; a null id is not held out, and has no label."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word before, word) of either class; the former as a hash."""
    seen: tuple[set, set] = (set(), set())

    def out() -> pa.RecordBatch:
        rows = [(b, w, t) for t in (0, 1) for b, w in seen[t]]
        for s in seen:
            s.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["before", "word", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = TOKEN.findall(text.lower())
            seen[toxic].update(zip([0, *(xxhash.xxh3_64_intdigest(w) >> 1 for w in words[:-1])], words, strict=True) if words else ())
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield out()
    yield out()


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words to counts of their units, and, as unit "", of all."""
    for batch in batches:
        counts: dict[str, list[int]] = {"": [0, 0]}
        for word, clean, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for unit in ("", *units(word)):
                n = counts.setdefault(unit, [0, 0])
                n[0] += clean
                n[1] += toxic
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([n[0] for n in counts.values()], pa.int64()), pa.array([n[1] for n in counts.values()], pa.int64())], names=["unit", "clean", "toxic"])


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of units, from their counts in (clean, toxic) texts, where they differ from those of their stem.

    The prior of a unit's share of toxic tokens, at equal sizes of both classes, is its stem's share. Units whose
    counts fit their stem's share by the likelihood-ratio statistic take it.
    """
    clean, toxic = counts[""]
    ratio = toxic / clean
    share: dict[str, float] = {}
    out: dict[str, float] = {}

    def stem_share(unit: str) -> float:
        word = unit.rstrip("*")
        return next((share[s] for n in reversed(STEMS) if len(word) > n and (s := word[:n] + "*") in share), 0.5)

    for unit in sorted(counts.keys() - {""}, key=lambda u: (len(u.rstrip("*")), not u.endswith("*"))):
        c, t = counts[unit]
        prior = share[unit] = stem_share(unit)
        expected = ratio * prior / (ratio * prior + 1 - prior)  # of tokens as many as there are of each class
        statistic = 2 * sum(n * math.log(n / ((c + t) * q)) for n, q in ((t, expected), (c, 1 - expected)) if n)
        if statistic >= EVIDENT:
            p = share[unit] = (t + PRIOR * prior) / (t + c * ratio + PRIOR)
            out[unit] = math.log(p / (1 - p))
    return out


def chance_scale(values: np.ndarray, times: np.ndarray) -> float:
    """lambda > 0 that solves mean(exp(lambda * score)) = 1 over the token scores of clean texts, each so many ``times``; 1 if
    none does."""
    share = times / times.sum()
    excess = lambda x: float((share * np.exp(x * values)).sum()) - 1
    if (share * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope by Newton's method on inputs scaled to unit spread; the slope is kept positive."""
    middle, spread = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z, beta = np.stack([np.ones_like(x), (x - middle) / spread], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge * beta
        curvature = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(curvature, gradient), -4, 4)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(beta[1], 1e-3) / spread
    return float(beta[0] - slope * middle), float(slope)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out.

    It is fitted on a sample of ``sample`` documents a class at most, those with the least hash of their id, and on all
    of their words. Labels that are null, repeated or without document are allowed; of
    several labels of a document the largest counts. Without labels of both classes every score is the share of toxic
    ones, smoothed.
    """
    known = labels.select(labels[id_column].cast("long").alias("id"), labels[label_column].cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model({}, curve=(math.log(rate / (1 - rate)), 0.0))
    order = [F.xxhash64("id", F.lit(17)), "id"]
    chosen = [known.where(F.col("toxic") == t).orderBy(*order).limit(sample).toPandas() for t in (0, 1)]
    chosen = docs.sparkSession.createDataFrame(pd.concat(chosen).astype({"id": "int64", "toxic": "int32"}), "id long, toxic int")
    chosen = chosen.withColumn("apart", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1000)) < int(1000 * APART))
    texts = docs.select(docs[id_column].cast("long").alias("id"), text_or_empty(docs, text_column).alias("text"))
    # As many rows as the sample has; they are read several times.
    texts = cut(texts.join(F.broadcast(chosen), "id").select("text", "toxic", "apart"))
    # A word counts once for each word that comes before it, so copies and near copies of a text add nothing.
    contexts = texts.where("not apart").select("text", "toxic").mapInArrow(_contexts, "before long, word string, toxic int").distinct()
    words = contexts.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    counts = words.mapInArrow(_by_unit, "unit string, clean long, toxic long")
    counts = counts.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 2")
    counts = counts.toPandas()
    table = dict(zip(counts["unit"], zip(counts["clean"], counts["toxic"], strict=True), strict=True))
    odds = log_odds(table) if min(table.get("", (0, 0))) else {}

    return _calibrated(odds, texts.where("apart").select("text", "toxic"), totals)


def _calibrated(odds: dict[str, float], apart: DataFrame, totals: dict[int, int]) -> Model:
    """The model with the constants of chance segments, from clean texts of ``apart`` (text, toxic), and the curve, from all."""
    raw = Model(odds)
    both = {r["toxic"]: r["count"] for r in apart.groupBy("toxic").count().collect()}
    if len(both) < 2:
        rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model(odds, curve=(math.log(rate / (1 - rate)) - 2, 1.0))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each token score occurs."""
        for batch in batches:
            times: Counter = Counter()
            for text in batch.column("text").to_pylist():
                times.update(np.round(raw.token_scores(text), 3).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.float64()), pa.array(list(times.values()), pa.int64())], names=["value", "times"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [raw.token_scores(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(max(1, len(x))) for x in scores]), pa.array([max([0.0, *best_segments(x)]) for x in scores])], names=["n", "best"])

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [raw.token_scores(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([raw.evidence(best_segments(x), len(x)) for x in scores], pa.float64())], names=["toxic", "evidence"])

    clean = apart.where("toxic = 0").select("text")
    times = clean.mapInArrow(values, "value double, times long").groupBy("value").agg(F.sum("times").alias("times")).toPandas()
    times = pd.concat([times, pd.DataFrame({"value": [-COST], "times": [1]})]).groupby("value", as_index=False)["times"].sum()
    raw.scale = chance_scale(times["value"].to_numpy(float), times["times"].to_numpy(float))
    held = clean.mapInArrow(best, "n double, best double").toPandas()
    raw.density = float(np.clip(len(held) / max(1e-9, (held["n"] * np.exp(-raw.scale * held["best"])).sum()), 1e-6, 10))
    found = apart.mapInArrow(evidence, "toxic int, evidence double").toPandas()
    x, y = np.log1p(found["evidence"].to_numpy(float)), found["toxic"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    raw.curve = logistic(x, y, weight / weight.mean())
    return raw


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.probability(t) for t in batch], dtype="float64")

    return scored(text)


PASSAGES = "array<struct<first:long,end:long,score:double,expected:double>>"


def judgement(model: Model, text: Column, most_expected: float = SIGNIFICANT) -> Column:
    """A struct of the score of a text and its significant passages."""

    @F.pandas_udf(f"score double, passages {PASSAGES}")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.judge(t, most_expected) for t in batch]
            passages = [[dict(zip(("first", "end", "score", "expected"), p, strict=True)) for p in f[1]] for f in found]
            yield pd.DataFrame({"score": pd.Series([f[0] for f in found], dtype="float64"), "passages": pd.Series(passages, dtype="object")})

    return judged(text)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score from 0 to 1, predicted (1 if score >= 0.5), passages.

    passages holds every significant segment: its tokens from ``first`` to before ``end``, its score, and how many as good are
    expected by chance. Whole texts are scored; null and empty ones like texts without any evidence. Repeated rows each
    give a row; ids may be null; columns other than the id and the text are not read.
    """
    model = fit(docs, labels, id_column, text_column)
    rows = docs.select(docs[id_column].alias(id_column), held_out(docs[id_column]).alias("held_out"), judgement(model, text_or_empty(docs, text_column)).alias("j"))
    return rows.select(id_column, "held_out", "j.score", (F.col("j.score") >= 0.5).cast("int").alias("predicted"), "j.passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more."""
    model = fit(docs, labels, id_column, text_column)
    return docs.where(score_column(model, text_or_empty(docs, text_column)) < 0.5)


def passages(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", most_expected: float = SIGNIFICANT) -> DataFrame:
    """A row (id, first, end, score, expected) for every significant segment: token positions and its E-value."""
    found = judgement(model, text_or_empty(docs, text_column), most_expected)
    return docs.select(docs[id_column].alias(id_column), found.alias("j")).select(id_column, F.explode("j.passages").alias("p")).select(id_column, "p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
