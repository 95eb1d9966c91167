import hashlib
import math
import random
import statistics
from collections import Counter
from itertools import combinations

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from latticeforge.operators import itemsets, lattices
from latticeforge.options import ItemsetOptions, bounds
from latticeforge.plans import modes, reporters, walks
from latticeforge.sources import transactions

LINES = ["0", *["1 2 3"] * 3, *["2 3 4"] * 3, "7 8 9 10", "7 8 9 11", "7 8 9 12", "1 12", "1 11", "1 10", "1 8 10", "1 9 11", "1 4 12", "1 12 7", "1 11 8", "1 10 12"]


@pytest.fixture(scope="module")
def baskets(spark):
    return transactions.parse_int_lines(spark.createDataFrame(list(enumerate(LINES)), "line long, value string")).persist()


@pytest.fixture(scope="module")
def mined(baskets):
    return itemsets.mine(baskets, ItemsetOptions(3))


def test_lines_from_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n\n3 x 4  5\n")
    rows = {tuple(r) for r in transactions.read_int_transactions(spark, str(tmp_path)).collect()}
    assert rows == {(0, 1), (0, 2), (2, 3), (2, 4), (2, 5)}


def test_bounds():
    assert bounds(0, 0) == (0, 2**31 - 1) and bounds(5, 3) == (2, 3)
    with pytest.raises(ValueError):
        ItemsetOptions(0)


def test_singletons_are_strict(spark, baskets):
    at = lambda s, **k: {r["item"] for r in itemsets.frequent_items(baskets, ItemsetOptions(s, **k)).collect()}
    assert at(3) == {1, 2, 3, 4, 7, 8, 9, 10, 11, 12}
    assert at(4) == {1, 2, 3, 8, 12} and at(4, strict_singletons=False) == at(3)


def test_children_and_parents(mined, baskets):
    edges = {(r["parent"], r["child"]) for r in mined.edges().collect()}
    assert {c for p, c in edges if p == "1"} == {"1 2", "1 3", "1 10", "1 11", "1 12"}
    assert {c for p, c in edges if p == "1 2"} == {"1 2 3"}
    assert {p for p, c in edges if c == "1 2 3"} == {"1 2", "1 3", "2 3"}
    searched = itemsets.children(mined, baskets, mined.patterns.where("key = '1'")).collect()
    assert {r["child"] for r in searched} == {"1 2", "1 3", "1 10", "1 11", "1 12"}


def test_against_fpgrowth(mined, baskets):
    wide = baskets.groupBy("tx").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=3 / wide.count()).fit(wide)
    want = {(" ".join(map(str, sorted(r["items"]))), r["freq"]) for r in model.freqItemsets.collect() if r["freq"] >= 3}
    got = {(r["key"], r["support"]) for r in mined.patterns.where("size > 0").collect()}
    assert got == want


def test_closure_and_tree(mined):
    edges, support = mined.edges().collect(), {r["key"]: r["support"] for r in mined.patterns.collect()}
    assert all(support[e["child"]] <= support[e["parent"]] for e in edges)
    canonical = [e["child"] for e in edges if e["canonical"]]
    assert sorted(canonical) == sorted(k for k in support if k)


def test_duplicates(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], "tx long, item int")
    support = lambda **k: {r["key"]: r["support"] for r in itemsets.mine(rows, ItemsetOptions(1, strict_singletons=False, **k)).patterns.collect()}
    assert support()["1"] == 2 and support(dedupe=False)["1"] == 3


def test_modes_agree(mined):
    lattice = modes.Lattice.of_itemsets(mined)
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(modes.dfs(lattice)) == keys(modes.vsigram(lattice))
    assert set(keys(modes.qsplor(lattice, 100))) == set(keys(modes.dfs(lattice, False)))
    assert set(keys(modes.qsplor(lattice, 1))) < set(keys(modes.dfs(lattice)))


def test_walks_follow_their_probabilities(mined):
    lattice = modes.Lattice.of_itemsets(mined)
    chain = walks.graple(lattice.patterns, lattice.edges).persist()
    start = chain.sparkSession.createDataFrame([("", 1.0)], "node string, pr double")
    prs = {r["node"]: r["pr"] for r in walks.absorption(chain, start).collect()}
    assert abs(sum(prs.values()) - 1) < 1e-9
    assert set(prs) == {r["key"] for r in lattices.maximal(lattice.patterns, lattice.edges).collect()}
    ends = reporters.histogram(walks.walk(chain, "", 3000, 9).withColumnRenamed("node", "name")).collect()
    assert all(abs(r["freq"] - prs[r["name"]]) < 0.04 for r in ends)
    leaves = {r["key"] for r in lattices.canonical_leaves(lattice.patterns, lattice.edges).collect()}
    even = {r["node"]: r["pr"] for r in walks.absorption(walks.unisorb(lattice.patterns, lattice.edges), start).collect()}
    assert set(even) == leaves and max(abs(p - 1 / len(leaves)) for p in even.values()) < 1e-9
    for mode in ("musk", "ospace", "premusk", "uniprox", "fastmax"):
        got = modes.sample(lattice, mode, 3, per_sample=2).collect()
        assert 0 < len(got) <= 3 and len({r["node"] for r in got}) == len(got)


def test_reporters(spark):
    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(25)], "seq long, name string")
    assert sorted(r["seq"] for r in reporters.skip(10)(rows).collect()) == [9, 19]
    assert sorted(r["seq"] for r in reporters.unique()(rows).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        reporters.skip(0)
    sets = {"a": "xyzw", "b": "xyzwv", "c": "xyzwvu", "d": "pq", "e": "pq", "f": "k"}
    df = spark.createDataFrame([(k, list(v), list(v[:1])) for k, v in sets.items()], "key string, labels array<string>, attrs array<string>")
    got = {r["key"]: r["cluster"] for r in reporters.dbscan(df, 0.2).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert reporters.dbscan(df, 0.2, attributes="attrs").count() == 6


def _events_of_pairs(spark, folder):
    """Events whose baskets hold two types at most, so that no set of four is frequent."""
    rows = [(i, i // 2, "ab"[i % 2]) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("*", "TIMESTAMP'2024-01-01' AS ts")
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_common_ancestor_of_no_patterns_is_null(spark, tmp_path):
    from latticeforge.queries import QUERIES

    assert [r["items"] for r in QUERIES["itemset_common_ancestor"](spark, _events_of_pairs(spark, tmp_path)).collect()] == [None]


def test_reporter_dir_without_samples(spark, tmp_path):
    from latticeforge.queries import QUERIES

    assert QUERIES["reporter_dir"](spark, _events_of_pairs(spark, tmp_path)).collect() == []


def test_reporter_dir_writes_every_embedding(spark, tmp_path, monkeypatch):
    from latticeforge.queries import QUERIES

    rows = [(4 * u + i, u, "abcd"[i]) for u in range(7) for i in range(4)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("*", "TIMESTAMP'2024-01-01' AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    report, written = reporters.dir_report, {}

    def reported(folder, *more):
        report(folder, *more)
        for name in ("embeddings", "embedding", "pattern"):
            written[name] = [r["value"] for r in spark.read.text(f"{folder}/{name}").collect()]

    monkeypatch.setattr(reporters, "dir_report", reported)
    assert [tuple(r) for r in QUERIES["reporter_dir"](spark, str(tmp_path)).collect()] == [(0, "a b c d", 7, 1)]
    assert written["embeddings"] == ["7"] and len(written["embedding"]) == 7 and written["pattern"] == ["a b c d"]
    assert all(sum(f"{u}:2024-01-01" in line for line in written["embedding"]) == 1 for u in range(7))


def test_dir_report_reads_back(spark, tmp_path):
    """Every embedding under its sample and number, line breaks within and all."""
    embeddings = [(s, i, f"{s}\n{i}") for s, n in ((0, 3), (1, 5)) for i in range(n)]
    samples = spark.createDataFrame([(0, "a", "A"), (1, "b", "B")], "sample int, key string, pattern string")
    reporters.dir_report(str(tmp_path), samples, spark.createDataFrame(embeddings, "sample int, embedding int, text string"))
    text = lambda name: sorted((r["sample"], r["value"]) for r in spark.read.text(f"{tmp_path}/{name}").collect())
    assert (text("pattern.name"), text("pattern"), text("embeddings")) == ([(0, "a"), (1, "b")], [(0, "A"), (1, "B")], [(0, "3"), (1, "5")])
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/embedding").select("sample", "embedding", "text").collect())) == embeddings
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/count").collect()] == ["2"]


def brute_metrics(rows):
    """intra, inter and the correlation of (set, cluster), pair by pair."""
    size = Counter(c for _, c in rows)
    pairs = [(1 - len(a & b) / len(a | b) if a | b else 0.0, x, y) for (a, x), (b, y) in combinations(rows, 2)]
    intra = sum(d / size[x] for d, x, y in pairs if x == y)
    inter = sum(d / (size[x] * size[y]) for d, x, y in pairs if x != y)
    return intra, inter, statistics.correlation([d for d, *_ in pairs], [float(x == y) for _, x, y in pairs])


def _metrics(spark, rows, **more):
    sets = spark.createDataFrame([(str(i), sorted(s)) for i, (s, _) in enumerate(rows)], "key string, items array<string>")
    clusters = spark.createDataFrame([(str(i), c) for i, (_, c) in enumerate(rows)], "key string, cluster string")
    return reporters.cluster_metrics(clusters, sets, **more).first()


@pytest.mark.parametrize("clusters", [4, 60])
def test_cluster_metrics_against_all_pairs(spark, clusters):
    """Blocks of a few sets, repeated and empty sets, few and many clusters."""
    rng = random.Random(5)
    rows = [(frozenset(rng.sample("abcdefgh", rng.randrange(5))), str(rng.randrange(clusters))) for _ in range(150)]
    got = _metrics(spark, rows, block=13)
    dealt = [(s, math.floor(int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:8], 16) / 2**32 * got["clusters"])) for i, (s, _) in enumerate(rows)]
    for prefix, want in (("", brute_metrics(rows)), ("random_", brute_metrics(dealt))):
        assert [got[prefix + x] for x in ("intra", "inter", "correlation")] == pytest.approx(want, abs=1e-9)
    assert (got["items"], got["clusters"]) == (150, len({c for _, c in rows}))


def test_cluster_metrics_of_more_than_20000_patterns(spark):
    """Sets that differ by number only: distances and their sums are known."""
    n, k = 24_000, 5
    numbers = spark.range(n).withColumn("s", F.col("id") % 300)
    sets = numbers.select(F.col("id").cast("string").alias("key"), F.array(F.lit("x"), F.concat(F.lit("s"), "s")).alias("items"))
    clusters = numbers.select(F.col("id").cast("string").alias("key"), (F.col("s") % k).cast("string").alias("cluster"))
    got = reporters.cluster_metrics(clusters, sets).first()
    size, copies = n // k, n // 300  # two sets that differ are 2/3 apart
    inside = size * (size - 1) // 2 - 300 // k * copies * (copies - 1) // 2
    assert (got["items"], got["clusters"]) == (n, k)
    assert got["intra"] == pytest.approx(k * inside * 2 / 3 / size) and got["inter"] == pytest.approx(k * (k - 1) / 2 * 2 / 3)


def test_cluster_metrics_of_few_patterns(spark):
    none = _metrics(spark, [])
    assert none["items"] == 0 and none["intra"] is None and none["correlation"] is None
    one = _metrics(spark, [({"a"}, "1"), ({"b"}, "1")])
    assert one["intra"] == 0.5 and one["inter"] is None and math.isnan(one["correlation"])
