"""Graph sources: veg and int text, DOT, and tables; label filters; writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.digraphs import Graph

_ATTRIBUTES = "map<string,string>"


def parse_veg(lines: DataFrame) -> Graph:
    """Graph of lines (value) ``vertex<TAB>{json}`` and ``edge<TAB>{json}``.

    Lines without a tab are skipped; an unknown kind or bad JSON is an error. Labels are trimmed; further keys of a
    vertex become attributes, those of an edge are dropped.
    """
    parts = F.split("value", "\t", 2)
    rows = lines.where(F.col("value").contains("\t")).select(F.get(parts, 0).alias("kind"), F.get(parts, 1).alias("body"))
    rows = rows.withColumn("obj", F.from_json("body", _ATTRIBUTES))
    required = F.when(F.col("kind") == "vertex", F.col("obj")["id"].isNotNull() & F.col("obj")["label"].isNotNull()).when(
        F.col("kind") == "edge", F.col("obj")["src"].isNotNull() & F.col("obj")["targ"].isNotNull() & F.col("obj")["label"].isNotNull()
    )
    bad = F.coalesce(~required, F.lit(True))
    rows = rows.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), "kind", F.lit(" "), "body"))).otherwise(F.col("kind")))
    vertices = rows.where("kind = 'vertex'").select(F.col("obj")["id"].alias("id"), F.trim(F.col("obj")["label"]).alias("label"), F.map_filter("obj", lambda k, _: ~k.isin("id", "label")).alias("attrs"))
    edges = rows.where("kind = 'edge'").select(F.col("obj")["src"].alias("src"), F.col("obj")["targ"].alias("targ"), F.trim(F.col("obj")["label"]).alias("label"))
    return Graph(vertices, edges)


def parse_int(lines: DataFrame) -> Graph:
    """Graph of lines ``v <id> <label>`` and ``e <src> <targ> <label>``; lines with a # are skipped."""
    rows = lines.where(~F.col("value").contains("#"))
    v = rows.where(F.col("value").startswith("v ")).select(F.split("value", " ", 3).alias("p"))
    e = rows.where(F.col("value").startswith("e ")).select(F.split("value", " ", 4).alias("p"))
    get = lambda i: F.coalesce(F.get("p", i), F.lit(""))
    return Graph(v.select(get(1).alias("id"), get(2).alias("label"), F.create_map().cast(_ATTRIBUTES).alias("attrs")), e.select(get(1).alias("src"), get(2).alias("targ"), get(3).alias("label")))


_DOT_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|#[^\n]*|("(?:\\.|[^"\\])*"|->|--|[{}\[\];,=:]|[^\s{}\[\];,=:"]+?(?=->|--|[\s{}\[\];,=:"]|$))', re.S)


def dot_graphs(text: str) -> Iterator[tuple[str, dict[str, dict[str, str]], list[tuple[str, str, dict[str, str]]]]]:
    """(name, vertices with attributes, edges with attributes) of every graph in a DOT text; subgraphs are skipped."""
    tokens = [m[1] for m in _DOT_TOKEN.finditer(text) if m[1]]
    plain = lambda t: re.sub(r'\\(["\\])', r"\1", t[1:-1]) if t.startswith('"') else t
    i = 0

    def attributes(i: int) -> tuple[dict[str, str], int]:
        out = {}
        while i < len(tokens) and tokens[i] == "[":
            i += 1
            while tokens[i] != "]":
                if tokens[i] in ",;":
                    i += 1
                elif tokens[i + 1] == "=":
                    out[plain(tokens[i])] = plain(tokens[i + 2])
                    i += 3
                else:
                    out[plain(tokens[i])] = ""
                    i += 1
            i += 1
        return out, i

    while i < len(tokens):
        if tokens[i].lower() not in ("digraph", "graph"):
            i += 1
            continue
        name, i = ("", i + 1) if tokens[i + 1] == "{" else (plain(tokens[i + 1]), i + 2)
        i += 1
        vertices: dict[str, dict[str, str]] = {}
        edges = []
        while tokens[i] != "}":
            t = tokens[i]
            if t == ";":
                i += 1
            elif t.lower() == "subgraph" or t == "{":
                while tokens[i] != "{":
                    i += 1
                depth = 1
                while depth:
                    i += 1
                    depth += (tokens[i] == "{") - (tokens[i] == "}")
                i += 1
            elif t.lower() in ("graph", "node", "edge") and tokens[i + 1] == "[":
                _, i = attributes(i + 1)
            elif tokens[i + 1] == "=":
                i += 3
            else:
                chain, i = [plain(t)], i + 1
                while tokens[i] == ":":
                    i += 2
                while tokens[i] in ("->", "--"):
                    chain.append(plain(tokens[i + 1]))
                    i += 2
                    while tokens[i] == ":":
                        i += 2
                found, i = attributes(i)
                for v in chain:
                    vertices.setdefault(v, {})
                if len(chain) == 1:
                    vertices[chain[0]].update(found)
                edges += [(a, b, found) for a, b in zip(chain, chain[1:], strict=False)]
        i += 1
        yield name, vertices, edges


def _dot_rows(per_graph_ids: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                for n, (name, vertices, edges) in enumerate(dot_graphs(text)):
                    ident = (lambda v, n=n, path=path: f"{path}#{n}/{v}") if per_graph_ids else (lambda v: v)
                    out += [("vertex", ident(v), None, a.get("label", v), {**{k: x for k, x in a.items() if k != "label"}, "graphId": name}) for v, a in vertices.items()]
                    out += [("edge", ident(s), ident(t), a.get("label", ""), {}) for s, t, a in edges]
            yield pd.DataFrame(out, columns=["kind", "id", "targ", "label", "attrs"])

    return scan


def parse_dot(files: DataFrame, per_graph_ids: bool = False) -> Graph:
    """Graph of whole DOT files (path, value). Vertices of edges exist without statement; labels default to the id, and
    to nothing for edges. With ``per_graph_ids`` equal ids of different graphs stay apart.
    """
    rows = files.mapInPandas(_dot_rows(per_graph_ids), "kind string, id string, targ string, label string, attrs map<string,string>")
    vertices = rows.where("kind = 'vertex'").groupBy("id").agg(F.min_by("label", F.struct(F.col("label") == F.col("id"), "label")).alias("label"), F.first("attrs").alias("attrs"))
    return Graph(vertices, rows.where("kind = 'edge'").select(F.col("id").alias("src"), "targ", "label"))


def read_graph(spark: SparkSession, path: str, loader: str = "veg", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Graph:
    """A graph from a file, folder or gzip file."""
    if loader == "dot":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
        graph = parse_dot(files)
    elif loader in ("veg", "int"):
        graph = (parse_veg if loader == "veg" else parse_int)(spark.read.text(path))
    else:
        raise ValueError("loader must be veg, int or dot")
    return filter_labels(graph, include, exclude)


def _any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"({p})" for p in patterns)


def filter_labels(graph: Graph, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Graph:
    """Vertices and edges whose labels some ``include`` pattern finds and no ``exclude`` pattern does.

    Edges with an end that went go too. Edges of vertices that never were are an error; ``check_ends`` tells.
    """

    def fits(label: Column) -> Column:
        ok = label.rlike(_any_of(include)) if include else F.lit(True)
        return ok & ~label.rlike(_any_of(exclude)) if exclude else ok

    vertices = graph.vertices.where(fits(F.col("label")))
    ids = vertices.select("id")
    edges = graph.edges.where(fits(F.col("label")))
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "targ"), "targ", "left_semi")
    return Graph(vertices, edges.select("src", "targ", "label"))


def unknown_ends(graph: Graph) -> DataFrame:
    """Edges with an end that is no vertex."""
    ids = graph.vertices.select("id")
    lost = lambda end: graph.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("src", "targ", "label")
    return lost("src").union(lost("targ")).distinct()


def check_ends(graph: Graph) -> Graph:
    row = unknown_ends(graph).first()
    if row is not None:
        raise ValueError(f"edge {row['src']} -> {row['targ']} has an unknown end")
    return graph


def veg_lines(graph: Graph) -> DataFrame:
    """(value): the graph as veg text."""
    base = F.create_map(F.lit("id"), F.col("id"), F.lit("label"), F.col("label"))
    body = F.map_concat(base, "attrs") if "attrs" in graph.vertices.columns else base
    v = graph.vertices.select(F.concat(F.lit("vertex\t"), F.to_json(body)).alias("value"))
    e = graph.edges.select(F.concat(F.lit("edge\t"), F.to_json(F.struct("src", "targ", "label"))).alias("value"))
    return v.union(e)


def dense_ids(graph: Graph) -> Graph:
    """Vertices and labels as dense numbers, by order of id and label; numbered in ranges, not by one global sort."""

    def numbers(df: DataFrame, name: str) -> DataFrame:
        # The upper bits of the increasing id name the range, the lower 33 the place in it.
        column, low = df.columns[0], (1 << 33) - 1
        rows = cut(df.distinct().orderBy(column).withColumn("at", F.monotonically_increasing_id()))
        ranges = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        numbered = rows.join(ranges, F.shiftright("at", 33) == F.col("range"))
        return numbered.select(F.col(column), (F.col("before") + F.col("at").bitwiseAND(F.lit(low))).alias(name))

    ids = numbers(graph.vertices.select(F.col("id").cast("string").alias("id")), "n")
    labels = numbers(graph.vertices.select("label").union(graph.edges.select("label")), "colour")
    vertices = graph.vertices.join(ids, "id").join(labels, "label").select(F.col("n").cast("string").alias("id"), F.col("colour").cast("string").alias("label"))
    at = lambda end: ids.select(F.col("id").alias(end), F.col("n").cast("string").alias(f"{end}_n"))
    edges = graph.edges.join(at("src"), "src").join(at("targ"), "targ").join(labels, "label")
    return Graph(vertices, edges.select(F.col("src_n").alias("src"), F.col("targ_n").alias("targ"), F.col("colour").cast("string").alias("label")))


def int_lines(graph: Graph) -> DataFrame:
    """(value): the graph as int text."""
    v = graph.vertices.select(F.concat_ws(" ", F.lit("v"), "id", "label").alias("value"))
    return v.union(graph.edges.select(F.concat_ws(" ", F.lit("e"), "src", "targ", "label").alias("value")))


def shorten_labels(graph: Graph) -> Graph:
    """Vertex labels cut at their first escaped line break; the whole one stays as attribute original_label."""
    attrs = F.map_concat("attrs", F.create_map(F.lit("original_label"), "label")) if "attrs" in graph.vertices.columns else F.create_map(F.lit("original_label"), "label")
    return Graph(graph.vertices.select("id", F.substring_index("label", "\\n", 1).alias("label"), attrs.alias("attrs")), graph.edges)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(pattern): lines that are not empty."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("pattern"))


def read_probabilities(lines: DataFrame) -> tuple[DataFrame, int]:
    """(pr, pattern) of numbered lines ``pr, pattern``, the first line of a pattern counting; and the number of lines."""
    parts = F.split("value", ",", 2)
    rows = lines.where(F.trim("value") != "").select("line", F.trim(F.get(parts, 0)).cast("double").alias("pr"), F.trim(F.get(parts, 1)).alias("pattern"))
    return rows.groupBy("pattern").agg(F.min_by("pr", "line").alias("pr")).select("pr", "pattern"), rows.count()
