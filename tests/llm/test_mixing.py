import hashlib
import math
import random

from latticeforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, start int"


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_targets_and_takes(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "a", "Z", "é", None, "hot", "hot", "hot"])
        rows.append((i, " ".join("x" * rng.randint(0, 90)) if i % 11 else rng.choice([None, "", "a " * 5000]), source, "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block_words=64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 0.001 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), block_words=64).collect()))


def test_schedule_is_spread(spark):
    targets = spark.createDataFrame([("a", 6400, 3, 6400.0, 6400), ("b", 3200, 1, 3200.0, 3200)], "source string, source_size long, weight int, target double, quota long")
    rows = [r for r in mixing.slots(spark, targets, 64).collect() if r["n"] is not None]
    first = [r["source"] for r in sorted(rows, key=lambda r: r["n"])][:60]
    assert 36 <= first.count("a") <= 44


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "", 0)] * 3 + [(None, "d", None, "", 0)], SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) in (14, 15)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, None, "s", "", 0), (2, "", None, "", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def brute_schedule(rows, block=64):
    """taken and first slot of every document, slot by slot, from documents (id, size, source)."""
    sizes, streams = {}, {}
    for i, n, s in sorted(rows, key=lambda r: hashlib.md5(f"1:{r[0]}".encode()).hexdigest()):
        streams.setdefault(s, []).extend([i] * n)
        sizes[s] = sizes.get(s, 0) + n
    quota = {s: int(t + 1e-9) for s, t in brute_targets(sizes).items() if t >= 1}
    names = sorted(quota, key=lambda s: (s is None, s or ""))
    total, left, at = sum(quota.values()), dict(quota), dict.fromkeys(quota, 0)
    points = -(-total // block)
    taken, first = {}, {}

    def take(n, s):
        end = min(at[s] + block, len(streams[s]), at[s] + left[s])
        for i in streams[s][at[s] : end]:
            taken[i] = taken.get(i, 0) + 1
            first[i] = min(n, first.get(i, n))
        left[s] -= end - at[s]
        at[s] = end % len(streams[s])

    for n in range(points):
        x, low = int((n * mixing.GOLDEN - math.floor(n * mixing.GOLDEN)) * total), 0
        for s in names:
            if low <= x < low + quota[s]:
                take(n, s)
            low += quota[s]
    for s in names:
        n = points
        while left[s]:
            take(n, s)
            n += 1
    return {i: (taken.get(i, 0), first.get(i)) for i, *_ in rows}


def test_slots_decide(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 150), rng.choice(["a", "b", "c", "c", "c", None])) for i in range(300)]
    df = spark.createDataFrame([(i, "w " * n, s, "s", 1) for i, n, s in rows], SCHEMA)
    got = lambda: {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(df, block_words=64).collect()}
    mine = got()
    assert mine == brute_schedule(rows)
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)
    assert got() != mine


def test_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([(1, None, "s", "", 0), (2, "a b", "s", "", 0), (3, None, None, "", 0)], SCHEMA)
        assert sorted((r["doc_id"], r["size"]) for r in mixing.mix(df).collect()) == [(1, 0), (2, 2), (3, 0)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
