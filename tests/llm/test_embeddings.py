import numpy as np

from latticeforge.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, c string, n int"


def brute(rows, limit=0.98):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = {i: set() for i in range(len(rows))}
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = (np.float32(v).astype(float) for v in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    links[i].add(j)
    return links


def planted(seed, n=150, size=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        v = rng.normal(size=size)
        label = int(rng.integers(0, 3))
        rows.append((v.tolist(), label))
        for _ in range(int(rng.integers(0, 4))):
            rows.append(((v + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.12, 0.2])).tolist(), label))
    hot = rng.normal(size=size)
    rows += [((hot + rng.normal(size=size) * 0.03).tolist(), 1) for _ in range(60)]
    rows += [(hot.tolist(), 1)] * 40
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def test_recall_and_exactness(spark):
    rows = planted(1)
    for block in (16, 1024):
        df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=block).collect()}
        want = brute(rows)
        assert len(got) == len(rows)
        assert all(got[i]["n_links"] <= len(want[i]) for i in want)
        assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(map(len, want.values()))
        roots = {}
        for i in sorted(want):
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in roots:
                    roots[k] = i
                    stack += want[k]
        assert sum(got[i]["component_id"] == roots[i] for i in want) >= 0.99 * len(want)
        for i in want:
            assert got[got[i]["component_id"]]["component_id"] == got[i]["component_id"] <= i
            assert got[i]["kept"] == (got[i]["component_id"] == i)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [3.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    linked = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["n_links"]), key=str)
    assert linked == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (12, 4, 1, False), (None, 4, 1, False)], key=str)
    assert all(r["component_id"] == r["vec_id"] and r["kept"] for r in got if not r["n_links"])
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
