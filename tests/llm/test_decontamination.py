import random
import time

from latticeforge.llm import decontamination as d


def brute_tiles(p, t, least):
    """The textbook algorithm, by comparing every position with every other."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in sorted(found):
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                for x in range(best):
                    mp[i + x] = mt[j + x] = True
                out.append((i, j, best))


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        p = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        least = rng.randint(1, 4)
        assert d.tiles(p, t, least) == brute_tiles(p, t, least)
    assert d.tiles([1] * 60, [1] * 20000, 5) == [(0, 0, 60)]


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, ". ".join(some(9) for _ in range(4))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (3, None), (None, some(20))]
    items.append(items[0])
    docs, truth = [], {}
    for i in range(80):
        text = some(rng.randint(0, 80))
        if i % 4 == 0:
            item = items[i // 4 % 12]
            sentences = item[1].split(". ")
            rng.shuffle(sentences)
            text = f"{text} {', '.join(sentences).upper()} {some(10)}"
            truth[i] = [item[0]]
        elif i % 4 == 1:
            text += " " + items[0][1].split(". ")[0]
        docs.append((i, text, 1, "x"))
    docs += [(100, None, 1, "x"), (101, "", 1, "x"), (0, docs[0][1], 1, "x"), (None, docs[4][1], 1, "x"), (102, some(30000), 1, "x")]
    return docs, items, truth


def test_planted_passages(spark):
    docs, items, truth = planted(2)
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(([r[0], truth.get(r[0] if r[0] is not None else 4, [])] for r in docs), key=str)
    for block_words in (10**6, 60):
        got = d.with_leaks(df, bench, "hits", block_words=block_words)
        assert got.columns == [*df.columns, "hits"]
        assert sorted(([r["doc_id"], [h["item_id"] for h in r["hits"]]] for r in got.collect()), key=str) == want
    kept = d.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, h in want if not h), key=str)


def test_empty_tables(spark):
    docs, items, _ = planted(3)
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.drop_leaks(df, bench.limit(0)).count() == len(docs)
    assert d.drop_leaks(df.limit(0), bench).count() == 0


def test_many_items_that_share_their_beginning_and_repeated_words():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    opening = some(8)
    bench = d.Benchmark([(i, f"{opening} {some(30)}") for i in range(2000)], 5)
    start = time.perf_counter()
    assert bench.coverage(f"{some(500)} {opening} {some(500)}", 0.6) == []
    assert time.perf_counter() - start < 0.5
    same = d.Benchmark([(7, "the " * 200), (8, "the " * 200)], 5)
    start = time.perf_counter()
    assert same.coverage("the " * 8000, 0.6) == [(7, 1.0, 200), (8, 1.0, 200)]
    assert time.perf_counter() - start < 0.5


def test_coverage_against_brute_force():
    rng = random.Random(6)
    words = "a b c d e f g h i j k l".split()
    for _ in range(60):
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(6)]
        text = " ".join([rng.choice(words) for _ in range(20)] + rng.choice(items)[1].split() + rng.choice(items)[1].split()[:6])
        got = d.Benchmark(items, 3).coverage(text, 0.6)
        want = []
        for i, item in items:
            n = sum(k for _, _, k in brute_tiles(item.split(), text.split(), 3))
            if len(item.split()) >= 3 and n >= 0.6 * len(item.split()):
                want.append((i, n / len(item.split()), n))
        assert got == want
