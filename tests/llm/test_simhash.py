import random

import xxhash
from pyspark.sql import functions as F

from latticeforge.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if linked(a, b) and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return root


def test_hash_equals_the_engine_s(spark):
    text = "Àb cd\tEF"
    row = spark.createDataFrame([("Àb cd ef",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert simhash.fingerprint(text) == row["h"]


def test_fingerprints(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 9, 200):
        text = " ".join(rng.choice("alpha Beta gamma delta É".split()) for _ in range(n))
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_pairs_are_whole(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for k in (1, 2, 2, 3):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (1, 2, 3):
        got = {tuple(r) for r in simhash.pigeonring_pairs(df, distance).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
        assert got == want


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 120]))) for _ in range(20)]
    for t in texts[:12]:
        parts = t.split()
        texts.append(" ".join(parts).upper())
        texts.append(" ".join(parts[: len(parts) // 2] + ["odd"] + parts[len(parts) // 2 :]))
    texts += [None, "", "  ", "x", "x", "long " * 30000]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    roots = brute_components(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert got == {i: (prints[i], roots[i]) for i in prints}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert len(simhash.keep_first(df).collect()) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_first(none).collect() == []
