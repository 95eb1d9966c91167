import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeforge import cli
from latticeforge.functions import patterns as P
from latticeforge.functions import theory
from latticeforge.operators import digraphs
from latticeforge.operators.digraphs import Graph
from latticeforge.options import DigraphOptions
from latticeforge.plans import estimates, modes
from latticeforge.sources import graphs
from latticeforge.streaming import counts


def graph(spark, vertices, edges):
    return Graph(
        spark.createDataFrame([(str(i), v) for i, v in vertices.items()], "id string, label string"),
        spark.createDataFrame([(str(s), str(t), e) for s, t, e in edges], "src string, targ string, label string"),
    )


@pytest.fixture(scope="module")
def six(spark):
    return graph(spark, {1: "black", 2: "black", 3: "red", 4: "red", 5: "red", 6: "red"}, [(1, 3, ""), (1, 4, ""), (2, 5, ""), (2, 6, ""), (5, 3, ""), (4, 6, "")])


def test_canonical_form_is_invariant():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 6)
        vs = tuple(rng.choice("ab") for _ in range(n))
        es = tuple({(rng.randrange(n), rng.randrange(n), rng.choice("xy")) for _ in range(rng.randint(0, 7))})
        order = rng.sample(range(n), n)
        moved = P.Pattern(tuple(vs[order.index(i)] for i in range(n)), tuple((order[s], order[t], e) for s, t, e in rng.sample(es, len(es))))
        a, at = P.canonical(P.Pattern(vs, es))
        b, _ = P.canonical(moved)
        assert a == b and P.canonical(a)[0] == a
        assert a.vertices == tuple(vs[i] for i in at)
        assert P.parse(a.name()) == a


def test_text_form_with_marks():
    p = P.canonical(P.Pattern(("f(x)", "a\\b"), ((0, 1, "e[1]"),)))[0]
    assert P.parse(p.name()) == p and P.parse("0:0") == P.Pattern()
    assert P.parse("{0:1}(f(x))").vertices == ("f(x)",)
    with pytest.raises(ValueError):
        P.parse("{1:1}(a)")


def test_parts():
    p = P.Pattern(("a", "b", "c"), ((0, 1, ""), (1, 2, ""), (0, 2, "")))
    assert len(P.parents(p)) == 3 and P.connected(p)
    assert P.remove_edge(P.Pattern(("a", "b", "c", "d"), ((0, 1, ""), (2, 3, ""))), 0) is None
    assert {q.name() for q in P.parents(P.Pattern(("a", "b"), ((0, 1, "x"),)))} == {"{0:1}(a)", "{0:1}(b)"}
    assert len(P.parents(P.Pattern(("a",), ((0, 0, "x"),)))) == 1
    assert P.walk_distance(p, p) == 0 < P.walk_distance(p, P.parents(p)[0])


def test_six_vertex_lattice(six):
    mined = digraphs.mine(six, DigraphOptions(2))
    support = {r["key"]: r["support"] for r in mined.patterns.collect()}
    edges = [tuple(r) for r in mined.edges.collect()]
    kids = lambda k: {c for p, c, _ in edges if p == k}
    assert support["{0:1}(black)"] == 2 and support["{0:1}(red)"] == 4
    one = P.canonical(P.Pattern(("black", "red"), ((0, 1, ""),)))[0].name()
    assert kids("{0:1}(black)") == {one}
    name = lambda *es: P.canonical(P.Pattern(("black", "red", "red"), tuple((s, t, "") for s, t in es)))[0].name()
    assert kids(one) == {name((0, 1), (0, 2)), name((0, 1), (2, 1)), name((0, 2), (2, 1))} and all(support[k] == 2 for k in kids(one))
    star = name((0, 1), (0, 2))
    assert len(kids(star)) == 2 and {p for p, c, _ in edges if c == star} == {one}
    whole = P.Pattern(("black", "black", *["red"] * 4), ((0, 2, ""), (0, 3, ""), (1, 4, ""), (1, 5, ""), (4, 2, ""), (3, 5, "")))
    assert digraphs.find_embeddings(six, P.canonical(whole)[0]).count() == 2
    assert digraphs.find_embeddings(six, P.Pattern(("black", "black", "red"), ((0, 2, ""), (1, 2, "")))).count() == 0
    lattice = modes.Lattice.of_digraphs(mined)
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(modes.dfs(lattice)) == keys(modes.vsigram(lattice))
    assert modes.qsplor(lattice, 2, "walk-kernel").count() > 0


def test_random_graph_properties(spark):
    rng = random.Random(3)
    vertices = {i: rng.choice("abcd") for i in range(60)}
    edges = {(rng.randrange(60), rng.randrange(60), rng.choice("jk")) for _ in range(90)}
    g = graph(spark, vertices, edges)
    mined = digraphs.mine(g, DigraphOptions(2, max_edges=2))
    support = {r["key"]: r["support"] for r in mined.patterns.collect()}
    links = [tuple(r) for r in mined.edges.collect()]
    assert any(r > 1 for r in (len(P.parse(k).edges) for k in support))
    assert all(support[c] <= support[p] for p, c, _ in links if p != "0:0")
    for k in support:
        assert sum(canonical for _, c, canonical in links if c == k) == 1
        pattern = P.parse(k)
        rows = digraphs.find_embeddings(g, pattern).collect()
        assert support[k] == min(len({r[i] for r in rows}) for i in range(len(pattern.vertices)))
        assert {p for p, c, _ in links if c == k} == {q.name() for q in P.parents(pattern)}


def chain(spark, labels):
    """Alternating vertices, every edge towards an o."""
    edges = []
    for i in range(len(labels) - 1):
        edges.append((i + 1, i, "") if labels[i] == "o" else (i, i + 1, ""))
    return graph(spark, dict(enumerate(labels)), edges)


@pytest.mark.parametrize(
    ("labels", "pattern", "want"),
    [("oxoxoxoxo", P.Pattern(("x", "o"), ((0, 1, ""),)), (4, 4, 1)), ("zoxoxoz", P.Pattern(("x", "o"), ((0, 1, ""),)), (2, 2, 1)), ("zoxoxoz", P.Pattern(("z", "o", "x"), ((0, 1, ""), (2, 1, ""))), (2, 2, 2))],
)
def test_support_metrics(spark, labels, pattern, want):
    rows = digraphs.find_embeddings(chain(spark, labels), pattern)
    rows = rows.select(F.lit("p").alias("key"), F.array(*rows.columns).alias("ids"))
    assert tuple(m(rows).first()["support"] for m in (digraphs.mni, digraphs.gis, digraphs.fis)) == want


def test_estimate_match(six):
    good = P.canonical(P.Pattern(("black", "red"), ((0, 1, ""),)))[0]
    assert digraphs.estimate_match(six, good) == (1.0, good)
    p = P.canonical(P.Pattern(("black", "red", "green"), ((0, 1, ""), (1, 2, ""))))[0]
    assert digraphs.estimate_match(six, p) == (0.5, good)


def test_sources(spark, tmp_path):
    veg = 'vertex\t{"id":136,"label":" a ","line":7}\nvertex\t{"id":2,"label":"b"}\nedge\t{"src":136,"targ":2,"label":"ddg","x":1}\nno tab here\n'
    (tmp_path / "g.veg").write_text(veg)
    g = graphs.read_graph(spark, str(tmp_path / "g.veg"))
    assert {(r["id"], r["label"], r["attrs"].get("line")) for r in g.vertices.collect()} == {("136", "a", "7"), ("2", "b", None)}
    assert [tuple(r) for r in g.edges.collect()] == [("136", "2", "ddg")]
    (tmp_path / "bad.veg").write_text("vertex\t{oops\n")
    with pytest.raises(Exception, match="bad line"):
        graphs.read_graph(spark, str(tmp_path / "bad.veg")).vertices.collect()
    (tmp_path / "g.int").write_text("# c\nv 1 black hole\nv 3 red\ne 1 3 ddg\n")
    i = graphs.read_graph(spark, str(tmp_path / "g.int"), "int", exclude=("^red$",))
    assert [r["label"] for r in i.vertices.collect()] == ["black hole"] and i.edges.count() == 0
    (tmp_path / "g.dot").write_text('digraph g { a [label="x \\"q\\""]; a -> b -> c [label="e"]; subgraph s { z; } rankdir=LR; // c\n}\ndigraph h { a; }')
    d = graphs.read_graph(spark, str(tmp_path / "g.dot"), "dot")
    assert {(r["id"], r["label"]) for r in d.vertices.collect()} == {("a", 'x "q"'), ("b", "b"), ("c", "c")}
    assert {tuple(r) for r in d.edges.collect()} == {("a", "b", "e"), ("b", "c", "e")}
    lost = Graph(g.vertices, g.edges.union(spark.createDataFrame([("9", "2", "x")], "src string, targ string, label string")))
    with pytest.raises(ValueError, match="unknown end"):
        graphs.check_ends(lost)
    pr, n = graphs.read_probabilities(spark.createDataFrame([(0, "0.25, {0:1}(a)"), (1, "0.5, {0:1}(a)"), (2, "")], "line long, value string"))
    assert n == 2 and [tuple(r) for r in pr.collect()] == [(0.25, "{0:1}(a)")]


def test_command_line(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(["1 2 3"] * 4 + ["2 3"] * 3))
    cli.main(["mine", "-o", str(tmp_path / "out"), "--support", "2", "--reporters", "max,count", "itemset", str(tmp_path / "t.txt"), "dfs"], spark)
    assert [r["key"] for r in spark.read.json(str(tmp_path / "out/patterns")).collect()] == ["1 2 3"]
    cli.main(["sample", "-o", str(tmp_path / "s"), "--support", "2", "--samples", "1", "--show-pr", "itemset", str(tmp_path / "t.txt"), "graple"], spark)
    assert [(r["key"], r["pr"]) for r in spark.read.json(str(tmp_path / "s/patterns")).collect()] == [("1 2 3", 1.0)]


def test_estimates_and_theory(spark):
    assert abs(estimates.student_t(0.95, 10) - 1.812461) < 1e-5 and abs(estimates.gamma_upper(1, 2) - np.exp(-2)) < 1e-12
    assert abs(estimates.gamma_upper(2.5, 6.0) - 0.0347) < 1e-3
    row = estimates.horvitz_thompson(spark.createDataFrame([(0.5, 1.0), (0.5, 3.0)], "pr double, y double"), 1).first()
    assert (row["population"], row["total"], row["mean"]) == (4.0, 8.0, 2.0)
    found = theory.compare(4)
    assert found["unisorb"]["stderr"] < 1e-9 < found["urw"]["stderr"]
    assert abs(sum(theory.absorption(theory.chain(theory.layered_graph(np.random.default_rng(2)), "fastmax"))[0]) - 1) < 1e-9


def test_stream_of_pairs(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a", "a"])], "tx long, items array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tx long, items array<string>").parquet(str(tmp_path / "in"))
    q = counts.pair_counts(stream).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("pairs").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
