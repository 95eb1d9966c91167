import hashlib
import random
from collections import Counter

from latticeforge.llm import substrings


def brute(texts, length):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + length]) for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - length + 1):
            if seen[tuple(d[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, length):
    words = [f"wörd{i}" for i in range(400)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [some(rng.randint(length - 2, 3 * length)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += p[a : a + rng.randint(1, len(p))] + some(rng.randint(0, 12))
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    near = [t.split() for t in texts[: n // 4]]
    for t in near:
        if t:
            t[rng.randrange(len(t))] = "edited"
    return texts + [" ".join(t) for t in near] + texts[: n // 5]


def test_windows_of_any_length():
    import numpy as np

    words = substrings._Words()([b"a", b"b", b"c"] * 20)
    for n in range(1, 40):
        got = substrings._windows(words, n)
        assert len(got) == 61 - n
        assert len(np.unique(got)) == min(3, 61 - n)


def test_against_brute_force(spark):
    for seed, length in ((1, 35), (2, 8), (3, 4), (4, 13)):
        rng = random.Random(seed)
        texts = corpus(rng, 60, length) + [None, "", " \n", "loop " * 500, "a b " * 3000, "x " * length, "y " * (length - 1)]
        df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, n int, k string").repartition(3)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(df, length).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(None, text), (1, text), (1, text), (None, "alone " + text[:40]), (1, "z")]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(1, 0), (14, 0), (50, 50), (50, 50), (50, 50)]
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
