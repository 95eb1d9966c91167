import math
import random
import zlib

import numpy as np

from latticeforge.llm import toxicity


def brute_segments(scores):
    """All maximal segments by their recursive definition: the best one, then those on either side of it."""
    def split(a, b):
        best, where = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-12 or (where and abs(total - best) <= 1e-12 and j + 1 - i < where[1] - where[0]):
                    best, where = total, (i, j + 1)
        return [] if where is None else [*split(a, where[0]), (*where, best), *split(where[1], b)]

    return split(0, len(scores))


def test_segments_against_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        scores = np.array([rng.choice([-1, 1]) * rng.random() for _ in range(rng.randint(0, 30))])
        got = [(a, b) for a, b, _ in toxicity.segments(scores)]
        assert got == [(a, b) for a, b, _ in brute_segments(scores)]


def test_evidence_of_many_scattered_segments():
    model = toxicity.Model({}, scale=1.0, density=0.3)
    every = max(toxicity._rarity(r, 0.3 * 20000 * np.exp(-4.0)) for r in range(1, 201))
    for apart, want in ((100, every), (1000, 0.0)):
        scores = np.full(20000, -5.0)
        scores[::apart] = 4.0
        tops = toxicity.best_segments(scores)
        assert len(tops) == 20000 // apart
        assert abs(model.evidence(tops, len(scores)) - want) < 1e-9
    assert every > 30


def corpus(n=600):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    bad = ["vexum", "vexula", "grimbo", "trolt"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", ",", "."])
        docs.append((i, " ".join(text), "fr", 7.0))
        if i % 3 != 2:
            labels.append((i, 1, toxic))
    return docs, labels, {i: int(i % 6 == 0) for i in range(n)}


SCHEMA = "doc_id long, text string, lang string, score double"


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    docs += [(900, None, None, None), (901, "", "", 0.0), (None, "vexum grimbo", "x", 0.0), (902, "clean " * 20000, "x", 0.0), (0, docs[0][1], "x", 1.0)]
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, known).collect()
    assert len(got) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r["score"] for r in got}
    assert max(by[900], by[901], by[902]) < 0.5
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)
    model = toxicity.fit(df, known)
    found = toxicity.passages(df, model).collect()
    assert {r["doc_id"] for r in found} >= {r["doc_id"] for r in got if r["score"] > 0.9 and r["doc_id"] is not None}


def test_labels_are_not_read_where_held_out(spark):
    docs, labels, _ = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    df = spark.createDataFrame(docs, SCHEMA)
    a, b = (sorted(toxicity.score(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", "x", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score(df, none).collect()] in ([0], [1])
    assert toxicity.score(df.limit(0), none).collect() == []


def test_scores_against_brute_force():
    """The score by the definitions: all maximal segments by comparison, Poisson tails summed term by term."""
    rng = np.random.default_rng(4)
    model = toxicity.Model({"bad": 2.0, "awful": 3.5, "fine": -1.0}, scale=0.8, density=0.05, curve=(-2.0, 1.5))
    words = np.array(["bad", "awful", "fine", "word", "other"])
    for n in (0, 1, 5, 40, 300):
        text = " ".join(words[rng.choice(5, n, p=[0.1, 0.05, 0.2, 0.35, 0.3])])
        scores = [{"bad": 1.5, "awful": 3.0, "fine": -1.5}.get(w, -0.5) for w in text.split()]
        found, rest = [], [(0, n)]
        while rest:  # the best contiguous part, then left and right of it
            a, b = rest.pop()
            best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0)) if b - a <= 60 else _kadane(scores, a, b)
            if best[0] > 1e-9:
                found.append(best[0])
                rest += [(a, best[2]), (best[3], b)]
        evidence = 0.0
        for r, s in enumerate(sorted(found, reverse=True), 1):
            mean = 0.05 * max(1, n) * math.exp(-0.8 * s)
            tail = math.fsum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(r, r + 200))
            evidence = max(evidence, -math.log(min(1.0, tail)))
        want = 1 / (1 + math.exp(-(-2.0 + 1.5 * math.log1p(evidence))))
        got, passages = model.judge(text)
        assert abs(got - want) < 1e-6
        assert all(p[3] <= toxicity.SIGNIFICANT and abs(sum(scores[p[0] : p[1]]) - p[2]) < 1e-9 for p in passages)


def _kadane(scores, a, b):
    best, total, start = (0.0, 0, 0, 0), 0.0, a
    for k in range(a, b):
        if total <= 0:
            total, start = 0.0, k
        total += scores[k]
        if total > best[0] + 1e-12:
            best = (total, 0, start, k + 1)
    return best
