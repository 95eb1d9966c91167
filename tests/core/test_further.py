import itertools
import random
import time

import pytest

from latticeforge import cli
from latticeforge.functions import patterns as P
from latticeforge.functions import theory
from latticeforge.operators import digraphs
from latticeforge.options import DigraphOptions
from latticeforge.plans import reporters, walks
from latticeforge.sources import graphs, transactions


def random_pattern(rng, n):
    edges = {(rng.randrange(n), rng.randrange(n), rng.choice("xy")) for _ in range(rng.randint(0, 7))}
    return P.Pattern(tuple(rng.choice("ab") for _ in range(n)), tuple(edges))


def test_canonical_against_all_orders():
    """Equal names for all orders of vertices, different ones for patterns that no order maps to each other."""
    rng = random.Random(2)
    for _ in range(120):
        n = rng.randint(1, 5)
        p, q = random_pattern(rng, n), random_pattern(rng, n)
        forms = lambda x, n=n: {(tuple(x.vertices[i] for i in o), tuple(sorted((o.index(s), o.index(t), e) for s, t, e in x.edges))) for o in itertools.permutations(range(n))}
        assert (P.canonical(p)[0] == P.canonical(q)[0]) == bool(forms(p) & forms(q))
        c, order = P.canonical(p)
        assert (c.vertices, tuple(sorted(c.edges))) in forms(p) and c.vertices == tuple(p.vertices[v] for v in order)
        assert P.from_bytes(P.to_bytes(c)) == c


def test_symmetric_patterns_are_quick():
    star = P.Pattern(("a",) * 31, tuple((i, 30, "x") for i in range(30)))
    cycle = P.Pattern(("a",) * 24, tuple((i, (i + 1) % 24, "x") for i in range(24)))
    full = P.Pattern(("a",) * 8, tuple((i, j, "x") for i in range(8) for j in range(8) if i != j))
    start = time.perf_counter()
    for p in (star, cycle, full):
        P.canonical(p)
    assert time.perf_counter() - start < 2
    with pytest.raises(ValueError):
        P.from_bytes(P.to_bytes(star)[:-1] + b"")


def graph(spark, vertices, edges):
    return digraphs.Graph(spark.createDataFrame(vertices, "id string, label string"), spark.createDataFrame(edges, "src string, targ string, label string"))


def test_both_ways_to_extend_give_one_lattice(spark):
    rng = random.Random(6)
    vertices = [(str(i), rng.choice("abc")) for i in range(30)]
    edges = list({(str(rng.randrange(30)), str(rng.randrange(30)), rng.choice("jk")) for _ in range(70)})
    found = []
    for how in ("embeddings", "freq-edges"):
        lattice = digraphs.mine(graph(spark, vertices, edges), DigraphOptions(3, max_edges=3, extend_from=how))
        found.append((sorted(map(tuple, lattice.patterns.collect())), sorted(map(tuple, lattice.edges.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 10
    for key, n_edges, _, _, support in found[0][0]:
        rows = digraphs.find_embeddings(graph(spark, vertices, edges), P.parse(key)) if n_edges == 2 else None
        if rows is not None:
            images = rows.collect()
            assert support == min(len({r[i] for r in images}) for i in range(len(rows.columns))) >= 3
    children = {}
    for parent, child, canonical in found[0][1]:
        children.setdefault(child, []).append((parent, canonical))
    assert all(sum(c for _, c in ps) == 1 for ps in children.values())


def test_star_images_against_pairs(spark):
    rng = random.Random(3)
    vertices = [(str(i), rng.choice("ab")) for i in range(14)]
    edges = list({(str(rng.randrange(14)), str(rng.randrange(14)), rng.choice("jk")) for _ in range(50)})
    label = dict(vertices)
    for direction in ("in", "out"):
        got = {tuple(r) for r in digraphs.star_images(graph(spark, vertices, edges), direction).collect()}
        want = set()
        for (s1, t1, e1), (s2, t2, e2) in itertools.product(edges, edges):
            (h1, a), (h2, b) = ((t1, s1), (t2, s2)) if direction == "in" else ((s1, t1), (s2, t2))
            ka, kb = f"{label[a]}|{e1}", f"{label[b]}|{e2}"
            if h1 == h2 and a != b and ka <= kb:
                want |= {(f"{label[h1]}|{ka}|{kb}", i, x) for i, x in enumerate((h1, a, b))}
        assert got == want


def test_numbered_lines_of_a_folder(spark, tmp_path):
    for i, name in enumerate(("a", "b", "c")):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i} {j}\n" for j in range(200 * (i + 1))))
    rows = sorted((r["line"], r["value"]) for r in transactions.numbered_lines(spark, str(tmp_path)).collect())
    assert [n for n, _ in rows] == list(range(1200))
    assert [v for _, v in rows] == [f"{i} {j}" for i in range(3) for j in range(200 * (i + 1))]


def test_common_ancestor_and_exists(spark):
    star = P.parse("{2:3}(a)(b)(b)[0->1:x][0->2:x]")
    path = P.parse("{2:3}(a)(b)(c)[0->1:x][1->2:y]")
    assert digraphs.common_ancestor(spark, [star, path]).name() == "{1:2}(a)(b)[0->1:x]"
    assert digraphs.common_ancestor(spark, [star, star]) == star
    assert digraphs.common_ancestor(spark, []) == digraphs.common_ancestor(spark, [star, P.Pattern()]) == P.Pattern()


def test_draws(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "key long, w double")
    some = [r["key"] for r in walks.draw(rows, 25, 4, "key", weight="w").collect()]
    assert len(some) == len(set(some)) == 25 and all(k % 3 for k in some)
    assert len(walks.draw(rows, 100, 4, "key").collect()) == 60
    assert sorted(r["place"] for r in walks.permutation(rows, 1, "key").collect()) == list(range(60))


def test_chains_of_the_theory():
    for mode in ("fastmax2", "dprox", "musk", "uniprox"):
        kids = theory.layered_graph(__import__("numpy").random.default_rng(3), (5, 8), 4)
        matrix = theory.chain(kids, mode)
        assert abs(matrix.sum(axis=1) - 1).max() < 1e-9 and matrix.min() >= 0
        prs, steps = theory.absorption(matrix)
        assert abs(prs.sum() - 1) < 1e-6 and steps > 0


def test_collector_refuses_more(spark):
    rows = spark.range(5)
    assert len(reporters.collector(rows, 5)) == 5
    with pytest.raises(ValueError):
        reporters.collector(rows, 4)


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "g.veg"
    path.write_text("".join(f'vertex\t{{"id":{i},"label":"{x}"}}\n' for i, x in enumerate("aabbb")) + 'edge\t{"src":0,"targ":2,"label":"x"}\nedge\t{"src":1,"targ":3,"label":"x"}\n')
    out = tmp_path / "out"
    cli.main(["mine", "-o", str(out), "--support", "2", "--reporters", "chain,max,histogram,endchain,count,log=found,file,dir", "digraph", "--extend-from-freq-edges", str(path), "dfs"], spark)
    assert {p.name for p in out.iterdir()} >= {"patterns", "histogram", "count", "log", "file", "dir"}
    names = sorted(r["value"] for r in spark.read.text(f"{out}/file/names.txt").collect())
    assert names == ["{0:1}(a)", "{0:1}(b)", "{1:2}(a)(b)[0->1:x]"]
    with pytest.raises(SystemExit):
        cli.main(["mine", "-o", str(out), "--support", "2", "--reporters", "chain,max", "digraph", str(path), "dfs"], spark)
    prs = tmp_path / "p.txt"
    prs.write_text("0.25, {1:2}(a)(b)[0->1:x]\n0.5, {0:1}(b)\n")
    cli.main(["find-embeddings", "-l", "veg", "--probabilities", str(prs), "--samples", "10", str(path)], spark)
    text = capsys.readouterr().out
    assert "1, 2, {1:2}(a)(b)[0->1:x]" in text and "population" in text
    cli.main(["list-embeddings", "-p", "{1:2}(a)(b)[0->1:x]", "-o", str(tmp_path / "dots"), str(path)], spark)
    assert "digraph embedding" in "".join(r["value"] for r in spark.read.text(f"{tmp_path}/dots/0").collect())


def test_dense_ids_are_dense(spark):
    g = graph(spark, [(f"v{i:03d}", "ab"[i % 2]) for i in range(300)], [("v001", "v299", "e")])
    dense = graphs.dense_ids(g)
    assert sorted(int(r["id"]) for r in dense.vertices.collect()) == list(range(300))
    assert [tuple(r) for r in dense.edges.collect()] == [("1", "299", "2")]


def test_uniprox_by_walks_and_for_maximal_patterns(spark):
    """On a binary tree enough walks see every path, so depth and diameter are the exact ones."""
    keys = ["", *(a for n in (1, 2, 3) for a in map("".join, itertools.product("ab", repeat=n)))]
    patterns = spark.createDataFrame([(k, len(k) + 1, 1) for k in keys], "key string, level int, support long")
    edges = spark.createDataFrame([(k[:-1], k, True) for k in keys if k] + [("aaa", "bbb", False)], "parent string, child string, canonical boolean")
    exact = {(r["u"], r["v"]): r["pr"] for r in walks.uniprox(patterns, edges).collect()}
    by_walks = {(r["u"], r["v"]): r["pr"] for r in walks.uniprox(patterns, edges, walks=40).collect()}
    assert exact.keys() == by_walks.keys() and all(abs(exact[k] - by_walks[k]) < 1e-9 for k in exact)
    back = {(r["u"], r["v"]): r["pr"] for r in walks.uniprox(patterns, edges, only_maximal=True).collect()}
    assert back[("aaa", "")] == 1.0 and len(back) == len(exact) + 1
