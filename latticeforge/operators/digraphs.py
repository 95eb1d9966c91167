"""Labelled digraphs: indices, embeddings of patterns, support metrics and the lattice of connected subgraphs.

A graph is two tables, vertices (id, label) and edges (src, targ, label); ids are strings. Embeddings are rows (key, ids): the
canonical name of a pattern and the graph vertex at each of its positions. Only canonical forms of distinct candidate
patterns are computed in Python; matching, counting and pruning are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import patterns as P
from ..options import DigraphOptions


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def labelled_edges(self) -> DataFrame:
        """(src, targ, label, src_label, targ_label), each edge once."""
        label = lambda end: self.vertices.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        return self.edges.select("src", "targ", "label").distinct().join(label("src"), "src").join(label("targ"), "targ").select("src", "targ", "label", "src_label", "targ_label")


def vertex_labels(graph: Graph) -> DataFrame:
    return graph.vertices.groupBy("label").agg(F.count("*").alias("n"))


def edge_triples(graph: Graph, duplicates: bool = True) -> DataFrame:
    """(src_label, label, targ_label, n): edges by the labels of both ends and their own."""
    if not duplicates:
        return graph.labelled_edges().groupBy("src_label", "label", "targ_label").agg(F.count("*").alias("n"))
    label = lambda end: graph.vertices.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    rows = graph.edges.select("src", "targ", "label").join(label("src"), "src").join(label("targ"), "targ")
    return rows.groupBy("src_label", "label", "targ_label").agg(F.count("*").alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """(id, out_degree, in_degree) of every vertex."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = graph.edges.groupBy(F.col("targ").alias("id")).agg(F.count("*").alias("in_degree"))
    return graph.vertices.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"])


def frequent_edges(graph: Graph, support: int) -> DataFrame:
    """Labelled edges whose triple reaches the support; no pattern with another one can be frequent."""
    rows = graph.labelled_edges()
    triple = ["src_label", "label", "targ_label"]
    enough = rows.groupBy(*triple).agg(F.count("*").alias("n")).where(F.col("n") >= support).select(*triple)
    return rows.join(enough, triple, "left_semi").select("src", "targ", "label", "src_label", "targ_label")


def fitting(graph: Graph, pattern: P.Pattern) -> Graph:
    """The graph without vertices whose label or degrees fit no position of the pattern: they are in no embedding."""
    needed = {}
    for i, label in enumerate(pattern.vertices):
        needed.setdefault(label, set()).add((sum(s == i for s, _, _ in pattern.edges), sum(t == i for _, t, _ in pattern.edges)))
    least = lambda label: reduce(lambda a, b: a | b, [(F.col("out_degree") >= o) & (F.col("in_degree") >= i) for o, i in sorted(needed[label])])
    fits = reduce(lambda a, b: a | b, [(F.col("label") == label) & least(label) for label in sorted(needed)], F.lit(False))
    vertices = graph.vertices.join(degrees(graph), "id").where(fits).select(*graph.vertices.columns)
    ids = vertices.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "targ"), "targ", "left_semi")
    return Graph(vertices, edges.select(*graph.edges.columns))


def as_graph(spark: SparkSession, pattern: P.Pattern) -> Graph:
    """A pattern as a graph of its own, vertices named by their position."""
    vertices = spark.createDataFrame([(str(i), v) for i, v in enumerate(pattern.vertices)], "id string, label string")
    return Graph(vertices, spark.createDataFrame([(str(s), str(t), e) for s, t, e in pattern.edges], "src string, targ string, label string"))


def exists(graph: Graph, pattern: P.Pattern, embeddings: DataFrame) -> DataFrame:
    """``embeddings`` (v0, v1, ...) with ``ok``: ids differ, labels fit, and every edge of the pattern is there."""
    columns = [f"v{i}" for i in range(len(pattern.vertices))]
    out = embeddings.withColumn("ok", F.size(F.array_distinct(F.array(*columns))) == len(columns))
    labels = graph.vertices.select(F.col("id").alias("id_"), F.col("label").alias("label_"))
    for c, label in zip(columns, pattern.vertices, strict=True):
        right = labels.where(F.col("label_") == label).select(F.col("id_").alias(c), F.lit(True).alias("has_"))
        out = out.join(right, c, "left").withColumn("ok", F.col("ok") & F.col("has_").isNotNull()).drop("has_")
    for s, t, e in pattern.edges:
        right = graph.edges.where(F.col("label") == e).select(F.col("src").alias("s_"), F.col("targ").alias("t_")).distinct().withColumn("has_", F.lit(True))
        out = out.join(right, (F.col(f"v{s}") == F.col("s_")) & (F.col(f"v{t}") == F.col("t_")), "left")
        out = out.withColumn("ok", F.col("ok") & F.col("has_").isNotNull()).drop("s_", "t_", "has_")
    return out.select(*embeddings.columns, "ok")


def find_embeddings(graph: Graph, pattern: P.Pattern, degree_filter: bool = False) -> DataFrame:
    """All injective, label-preserving embeddings: columns v0, v1, ... of vertex ids.

    One join for each edge of a chain, the first edges first bound; an edge between bound vertices joins on both ends.
    Vertices of equal label are kept apart by conditions of the joins. With ``degree_filter`` vertices of too small
    degrees are left out before, which pays where joins would grow at hubs.
    """
    if not pattern.vertices:
        raise ValueError("the empty pattern has no embedding")
    if degree_filter:
        graph = fitting(graph, pattern)
    if not pattern.edges:
        return graph.vertices.where(F.col("label") == pattern.vertices[0]).select(F.col("id").alias("v0"))
    rows, bound = None, set()
    labelled = graph.labelled_edges()
    for s, t, e in P.edge_chain(pattern):
        fits = (F.col("label") == e) & (F.col("src_label") == pattern.vertices[s]) & (F.col("targ_label") == pattern.vertices[t])
        step = labelled.where(fits & (F.col("src") == F.col("targ")) if s == t else fits & (F.col("src") != F.col("targ")))
        step = step.select(F.col("src").alias(f"v{s}")) if s == t else step.select(F.col("src").alias(f"v{s}"), F.col("targ").alias(f"v{t}"))
        if rows is None:
            rows = step
        else:
            rows = rows.join(step, [f"v{x}" for x in {s, t} if x in bound])
            for new in {s, t} - bound:
                for old in bound:
                    if pattern.vertices[new] == pattern.vertices[old]:
                        rows = rows.where(F.col(f"v{new}") != F.col(f"v{old}"))
        bound |= {s, t}
    return rows.select(*[f"v{i}" for i in range(len(pattern.vertices))])


def embedded(graph: Graph, pattern: P.Pattern) -> bool:
    return not pattern.vertices or not find_embeddings(graph, pattern).isEmpty()


def estimate_match(graph: Graph, pattern: P.Pattern) -> tuple[float, P.Pattern]:
    """Share of edges, and the part of the pattern, that embeds after edges were dropped one by one.

    Edges are tried in the order of the chain: the longest embedded beginning names the edge that fails, which is
    dropped if the rest hangs together, else the next one that allows it.
    """
    part = pattern
    while True:
        if embedded(graph, part):
            return (len(part.edges) / len(pattern.edges) if pattern.edges else 1.0), part
        chain = P.edge_chain(part)
        if len(chain) <= 1:
            return 0.0, P.Pattern()
        fails = next(n for n in range(1, len(chain) + 1) if not embedded(graph, _beginning(part, chain[:n]))) - 1
        for e in chain[fails:]:
            rest = P.remove_edge(part, part.edges.index(e))
            if rest is not None and P.connected(rest):
                part = P.canonical(rest)[0]
                break
        else:
            return 0.0, P.Pattern()


def _beginning(p: P.Pattern, edges: list[P.Edge]) -> P.Pattern:
    used = sorted({v for s, t, _ in edges for v in (s, t)})
    place = {v: i for i, v in enumerate(used)}
    return P.Pattern(tuple(p.vertices[v] for v in used), tuple((place[s], place[t], e) for s, t, e in edges))


def overlap(embeddings: DataFrame) -> DataFrame:
    """(key, idx, id): graph vertices at each position of a pattern in any embedding."""
    return embeddings.select("key", F.posexplode("ids").alias("idx", "id")).distinct()


def mni(embeddings: DataFrame) -> DataFrame:
    """(key, support): least number of distinct graph vertices over the positions of a pattern."""
    return mni_of_images(overlap(embeddings))


def mni_of_images(images: DataFrame) -> DataFrame:
    """(key, support) from the distinct rows (key, idx, id)."""
    images = images.groupBy("key", "idx").agg(F.count("*").alias("n"))
    return images.groupBy("key").agg(F.min("n").alias("support"))


def star_images(graph: Graph, direction: str = "in") -> DataFrame:
    """(key, idx, id) of the stars of two edges into one vertex, or out of it: hub, first and second leaf.

    Leaves are in order of label and edge label. No pair of leaves is made, so a hub costs as much as it has edges: a
    leaf is an image if its hub has another one of the other kind, which the number of those and the least one tell.
    """
    hub, leaf = ("targ", "src") if direction == "in" else ("src", "targ")
    kind = F.concat_ws("|", f"{leaf}_label", "label")
    edges = graph.labelled_edges().select(F.col(hub).alias("hub"), F.col(f"{hub}_label").alias("hub_label"), F.col(leaf).alias("leaf"), kind.alias("kind"))
    kinds = cut(edges.groupBy("hub", "hub_label", "kind").agg(F.count("*").alias("n"), F.min("leaf").alias("least")))
    side = lambda s: kinds.select("hub", "hub_label", *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "n", "least")])
    pairs = side("a").join(side("b"), ["hub", "hub_label"]).where(F.col("kind_a") <= F.col("kind_b"))
    other = (F.col("n_a") > 1) | (F.col("n_b") > 1) | (F.col("least_a") != F.col("least_b"))
    pairs = cut(pairs.where(other).withColumn("key", F.concat_ws("|", "hub_label", "kind_a", "kind_b")))
    parts = [pairs.select("key", F.lit(0).alias("idx"), F.col("hub").alias("id"))]
    for idx, (own, far) in enumerate((("a", "b"), ("b", "a")), 1):
        leaves = edges.join(pairs.select("key", "hub", F.col(f"kind_{own}").alias("kind"), F.col(f"n_{far}").alias("n"), F.col(f"least_{far}").alias("least")), ["hub", "kind"])
        parts.append(leaves.where((F.col("n") > 1) | (F.col("least") != F.col("leaf"))).select("key", F.lit(idx).alias("idx"), F.col("leaf").alias("id")))
    return reduce(DataFrame.unionByName, parts).distinct()


def representatives(embeddings: DataFrame) -> DataFrame:
    """(key, id, ids): the least embedding for each image of the position with fewest images, the first such position."""
    images = overlap(embeddings).groupBy("key", "idx").agg(F.count("*").alias("n"))
    least = images.groupBy("key").agg(F.min_by("idx", F.struct("n", "idx")).alias("idx"))
    at = embeddings.join(least, "key").select("key", F.get("ids", F.col("idx")).alias("id"), "ids")
    return at.groupBy("key", "id").agg(F.min("ids").alias("ids"))


def gis(embeddings: DataFrame) -> DataFrame:
    """(key, support): size of the greedy set of embeddings without common vertices, in order of their ids.

    Rounds accept every embedding that is the least left at all of its vertices, and drop those it touches. That
    gives the same set as going through them one by one.
    """
    left = cut(embeddings.select("key", "ids").distinct())
    taken = None
    while not left.isEmpty():
        at = left.select("key", "ids", F.explode("ids").alias("id"))
        least = at.groupBy("key", "id").agg(F.min("ids").alias("least"))
        best = at.join(least, ["key", "id"]).groupBy("key", "ids").agg(F.min((F.col("ids") == F.col("least")).cast("int")).alias("ok"))
        accepted = cut(best.where("ok = 1").select("key", "ids"))
        used = accepted.select("key", F.explode("ids").alias("id"))
        touched = at.join(used, ["key", "id"], "left_semi").select("key", "ids").distinct()
        left = cut(left.join(touched, ["key", "ids"], "left_anti"))
        taken = accepted if taken is None else taken.unionByName(accepted)
    if taken is None:
        return embeddings.select("key", F.lit(0).cast("long").alias("support")).limit(0)
    return taken.groupBy("key").agg(F.count("*").alias("support"))


def fis(embeddings: DataFrame) -> DataFrame:
    """(key, support): connected components of the embeddings that share vertices.

    Every embedding takes the least name at its vertices until none changes.
    """
    names = cut(embeddings.select("key", "ids").distinct().withColumn("name", F.col("ids")))
    while True:
        at = names.select("key", "ids", "name", F.explode("ids").alias("id"))
        least = at.groupBy("key", "id").agg(F.min("name").alias("least"))
        new = at.join(least, ["key", "id"]).groupBy("key", "ids", "name").agg(F.min("least").alias("new"))
        new = cut(new)
        # Follow names: the embedding that names a component may itself have a lesser name by now.
        jump = new.select("key", F.col("ids").alias("new"), F.col("new").alias("to"))
        moved = cut(new.join(jump, ["key", "new"]).select("key", "ids", "name", F.col("to").alias("new")))
        names = moved.select("key", "ids", F.col("new").alias("name"))
        if moved.where("name <> new").isEmpty():
            return names.groupBy("key").agg(F.countDistinct("name").alias("support"))


SUPPORTS = {"mni": mni, "gis": gis, "fis": fis}


@dataclass
class DigraphLattice:
    """patterns (key, n_edges, n_vertices, level, support), root excluded; edges (parent, child, canonical); embeddings."""

    patterns: DataFrame
    edges: DataFrame
    embeddings: DataFrame
    options: DigraphOptions

    def acceptable(self) -> DataFrame:
        o = self.options
        return self.patterns.where(F.col("n_edges").between(o.min_edges, o.max_edges) & F.col("n_vertices").between(o.min_vertices, o.max_vertices))


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct extensions to canonical children: their key, order of vertices and canonical parent."""
    for pdf in batches:
        out = []
        for key, s, t, label, new in zip(pdf["key"], pdf["s"], pdf["t"], pdf["label"], pdf["new_label"], strict=True):
            child, order = P.extend(P.parse(key), int(s), int(t), label, new)
            out.append((key, s, t, label, new, child.name(), list(order), P.parents(child)[0].name(), len(child.edges), len(child.vertices)))
        yield pd.DataFrame(out, columns=["key", "s", "t", "label", "new_label", "child", "order", "first_parent", "n_edges", "n_vertices"])


_CHILDREN = "key string, s int, t int, label string, new_label string, child string, order array<int>, first_parent string, n_edges int, n_vertices int"


def frequent_kinds(images: DataFrame, edges: DataFrame, support: int) -> DataFrame:
    """(key, idx, out, label, other_label): edges at the images of a position that may be frequent extensions.

    Both ends of such an edge have at least ``support`` images, a bound that no metric exceeds; no embedding is read.
    """
    parts = []
    for out, here, there in ((True, "src", "targ"), (False, "targ", "src")):
        met = images.join(edges, images["id"] == edges[here]).select("key", "idx", "id", F.lit(out).alias("out"), "label", F.col(f"{there}_label").alias("other_label"), F.col(there).alias("other"))
        kinds = met.groupBy("key", "idx", "out", "label", "other_label").agg(F.countDistinct("id").alias("here"), F.countDistinct("other").alias("there"))
        parts.append(kinds.where((F.col("here") >= support) & (F.col("there") >= support)).drop("here", "there"))
    return parts[0].unionByName(parts[1])


def extensions(embeddings: DataFrame, edges: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(key, ids, s, t, label, new_label, new_id): incident edges of every embedding, as edges between positions.

    Position size(ids) is a new vertex. Edges of the pattern itself come too; they go when names are compared. With
    ``kinds`` only edges of these kinds are joined at all.
    """
    at = embeddings.select("key", "ids", F.posexplode("ids").alias("i", "id"))
    size = F.size("ids")

    def met(out: bool) -> DataFrame:
        here, there = ("src", "targ") if out else ("targ", "src")
        if kinds is None:
            rows = at.join(edges, at["id"] == edges[here])
        else:
            own = at.join(kinds.where(F.col("out") == out).withColumnRenamed("idx", "i").drop("out"), ["key", "i"])
            e = edges.withColumnRenamed("label", "edge_label")
            rows = own.join(e, (F.col("id") == F.col(here)) & (F.col("label") == F.col("edge_label")) & (F.col("other_label") == F.col(f"{there}_label")))
        return rows.select("key", "ids", "i", "label", F.col(there).alias("other"), F.col(f"{there}_label").alias("other_label"))

    out = met(True).withColumnRenamed("i", "s")
    place = F.array_position("ids", F.col("other")).cast("int")
    out = out.select("key", "ids", "s", F.when(place > 0, place - 1).otherwise(size).alias("t"), "label", F.when(place == 0, F.col("other_label")).alias("new_label"), F.when(place == 0, F.col("other")).alias("new_id"))
    into = met(False).where(~F.array_contains("ids", F.col("other")))
    into = into.select("key", "ids", size.alias("s"), F.col("i").alias("t"), "label", F.col("other_label").alias("new_label"), F.col("other").alias("new_id"))
    return out.unionByName(into)


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(key, i, v, len(p.vertices)) for key in pdf["key"] for p in (P.parse(key),) for i, v in enumerate(p.vertices)]
        yield pd.DataFrame(rows, columns=["key", "idx", "vertex_label", "n"])


def kinds_from_triples(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, s, t, label, new_label): extensions of the patterns (key) by frequent label triples, told from labels alone.

    No embedding is read, so some may have none; counting drops them.
    """
    triples = cut(edges.select("src_label", "label", "targ_label").distinct())
    at = cut(patterns.mapInPandas(_positions, "key string, idx int, vertex_label string, n int"))
    out = at.join(triples, at["vertex_label"] == triples["src_label"]).select("key", F.col("idx").alias("s"), F.col("n").alias("t"), "label", F.col("targ_label").alias("new_label"))
    into = at.join(triples, at["vertex_label"] == triples["targ_label"]).select("key", F.col("n").alias("s"), F.col("idx").alias("t"), "label", F.col("src_label").alias("new_label"))
    a = at.select("key", F.col("idx").alias("s"), F.col("vertex_label").alias("src_label"))
    b = at.select("key", F.col("idx").alias("t"), F.col("vertex_label").alias("targ_label"))
    closing = a.join(b, "key").join(triples, ["src_label", "targ_label"]).select("key", "s", "t", "label", F.lit(None).cast("string").alias("new_label"))
    return out.unionByName(into).unionByName(closing).distinct()


def too_large(patterns: DataFrame, options: DigraphOptions) -> DataFrame:
    """The patterns beyond the greatest size."""
    return patterns.where((F.col("n_edges") > options.max_edges) | (F.col("n_vertices") > options.max_vertices))


def mine(graph: Graph, options: DigraphOptions, metric: Callable[[DataFrame], DataFrame] | None = None) -> DigraphLattice:
    """The lattice of frequent connected subgraphs, level by level, by extending embeddings by one edge.

    Candidates come from the embeddings, of which only the kinds of edges that may be frequent are joined, or, if
    ``options.extend_from`` says so, from the frequent label triples. The lattice is the same. ``metric`` replaces the
    support that ``options`` names; it may not exceed the number of images of any position.
    """
    support = metric or SUPPORTS[options.count_mode]
    edges = cut(frequent_edges(graph, options.support))
    name = F.concat(F.lit("{0:1}("), F.regexp_replace("label", r"([()\\])", r"\\$1"), F.lit(")"))
    singles = graph.vertices.select(name.alias("key"), F.array("id").alias("ids"))
    counts = cut(support(singles).where(F.col("support") >= options.support).select("key", "support"))
    level = cut(singles.join(counts.select("key"), "key", "left_semi"))
    found = [counts.select("key", F.lit(0).alias("n_edges"), F.lit(1).alias("n_vertices"), F.lit(1).alias("level"), "support")]
    lattice_edges = [found[0].select(F.lit("0:0").alias("parent"), F.col("key").alias("child"), F.lit(True).alias("canonical"))]
    all_embeddings, n = [level], 0
    known = _edge_known()
    while n < options.max_edges:
        if options.extend_from == "freq-edges":
            grown = extensions(level, edges)
            kinds = kinds_from_triples(found[-1].select("key"), edges)
        else:
            grown = cut(extensions(level, edges, cut(frequent_kinds(overlap(level), edges, options.support))))
            kinds = grown.select("key", "s", "t", "label", "new_label").distinct()
        kinds = kinds.where(~known(F.col("key"), F.col("s"), F.col("t"), F.col("label")))
        children = cut(kinds.mapInPandas(_children, _CHILDREN).where(F.col("n_vertices") <= options.max_vertices))
        same = [grown[c].eqNullSafe(children[c]) for c in ("key", "s", "t", "label", "new_label")]
        ids = F.when(F.col("new_id").isNotNull(), F.concat("ids", F.array("new_id"))).otherwise(F.col("ids"))
        placed = F.transform("order", lambda v: F.get(F.col("all_ids"), v))
        made = grown.join(children, reduce(lambda a, b: a & b, same)).select(grown["key"].alias("parent"), "child", "order", "first_parent", "n_edges", "n_vertices", ids.alias("all_ids"))
        made = cut(made.select("child", placed.alias("ids")).distinct().select(F.col("child").alias("key"), "ids"))
        frequent = support(made).where(F.col("support") >= options.support)
        facts = children.select(F.col("child").alias("key"), "n_edges", "n_vertices").distinct()
        frequent = cut(facts.join(frequent, "key").select("key", "n_edges", "n_vertices", (F.col("n_edges") + 1).alias("level"), "support"))
        if frequent.isEmpty():
            break
        found.append(frequent)
        links = children.select(F.col("key").alias("parent"), "child", (F.col("key") == F.col("first_parent")).alias("canonical")).distinct()
        lattice_edges.append(links.join(frequent.select(F.col("key").alias("child")), "child", "left_semi").select("parent", "child", "canonical"))
        level = cut(made.join(frequent.select("key"), "key", "left_semi"))
        all_embeddings.append(level)
        n += 1
    join = lambda parts: reduce(DataFrame.unionByName, parts)
    return DigraphLattice(cut(join(found)), cut(join(lattice_edges)), join(all_embeddings), options)


def common_ancestor(spark: SparkSession, patterns: list[P.Pattern]) -> P.Pattern:
    """The largest pattern that all of a few patterns hold, the first by name of several; the empty one if there is none.

    The patterns become one graph without links between them; the support of a part is the number of them that hold it.
    """
    n = len(patterns)
    if not n or not all(p.vertices for p in patterns):
        return P.Pattern()
    vertices = [(f"{g}/{i}", v) for g, p in enumerate(patterns) for i, v in enumerate(p.vertices)]
    edges = [(f"{g}/{s}", f"{g}/{t}", e) for g, p in enumerate(patterns) for s, t, e in p.edges]
    graph = Graph(spark.createDataFrame(vertices, "id string, label string"), spark.createDataFrame(edges, "src string, targ string, label string"))
    holders = lambda rows: rows.groupBy("key").agg(F.countDistinct(F.substring_index(F.get("ids", 0), "/", 1)).alias("support"))
    found = mine(graph, DigraphOptions(n), holders).patterns
    row = found.orderBy(F.desc("level"), F.desc("n_vertices"), "key").select("key").first()
    return P.parse(row["key"]) if row else P.Pattern()


def attribute_sets(embeddings: DataFrame, vertices: DataFrame, attribute: str | None = None) -> DataFrame:
    """(key, labels): the distinct values of an attribute, or the labels, over all vertices of a pattern's embeddings, sorted."""
    value = F.col("label") if attribute is None else F.col("attrs")[attribute]
    at = embeddings.select("key", F.explode("ids").alias("id")).distinct()
    met = at.join(vertices.select("id", value.alias("value")), "id").where(F.col("value").isNotNull())
    return met.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("labels"))


def _edge_known():
    @F.pandas_udf("boolean")
    def known(key: pd.Series, s: pd.Series, t: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series([(int(a), int(b), e) in P.parse(k).edges for k, a, b, e in zip(key, s, t, label, strict=True)], dtype=bool)

    return known
