import random

import corpus_pipeline
from latticeforge.llm import _components, shingles

from .test_simhash import brute_components

SCHEMA = "doc_id long, text string, key string, n int"


def brute_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b, similarity=0.8):
    return a == b or len(a & b) / len(a | b) >= similarity


def planted(seed=3):
    """Texts with near copies of 1 to 6 changed words, on either side of the threshold, and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 30, 60, 150]))) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(25))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 20, 40)]
    for t in texts[:30]:
        for k in range(1, 7):
            parts = t.split()
            for at in rng.sample(range(len(parts)), min(k, len(parts))):
                parts[at] = rng.choice(words)
            texts.append(" ".join(parts))
    return [*texts, texts[4].upper(), None, "", " \n", "x", "X", "x y"]


def test_against_brute_force(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(planted())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets = {i: brute_set(t) for i, t, *_ in rows}
    for similarity in (0.8, 0.5):
        roots = brute_components(list(sets), lambda a, b: alike(sets[a], sets[b], similarity))
        assert 20 < len(rows) - len(set(roots.values()))
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(df, similarity=similarity).collect()}
        assert got == roots


def test_the_stage_drops_planted_near_copies(spark):
    rng = random.Random(9)
    first = [f"a{rng.randrange(10**6)}" for _ in range(100)]
    near, far = list(first), list(first)
    near[20] = near[60] = "changed"  # 86 of 106 shingles are shared
    for at in (20, 40, 60):
        far[at] = "other"  # 81 of 111 with either
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate((first, near, far))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_documents(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingles.near_copies(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert len(shingles.keep_first(df).collect()) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingles.keep_first(none).collect() == []


def test_every_text_counts_for_the_rarity_of_shingles(spark):
    """A passage of 40 texts among 9,000 stands out from shingles of one text."""
    passage = "one passage that many texts hold"
    rows = [(i, f"{passage} " * (i % 225 == 0) + f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rarity = shingles._rarity(df, df["text"], 5)
    bits = len(rarity).bit_length() - 1
    shared = rarity[shingles._counter(shingles.shingle_hashes(passage), bits)]
    own = rarity[shingles._counter(shingles.shingle_hashes(rows[1][1]), bits)]
    assert shared.min() >= 16 * 5 > own.max() > 0


def test_few_links_are_settled_without_rounds(spark, monkeypatch):
    """The rounds of joins, many jobs each, are left to links that are many; either way gives the same components."""
    rng = random.Random(4)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {tuple(r) for r in _components.connected_components(links).collect()}
    monkeypatch.setattr(_components, "_least", None)  # what every round begins with
    assert {tuple(r) for r in _components.connected_components(links, few=1000).collect()} == want
    assert _components.connected_components(links.limit(0), few=1000).collect() == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(("a b c d e", "A b c d e", "q", "q"))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
