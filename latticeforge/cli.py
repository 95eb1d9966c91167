"""Command line: ``mine`` and ``sample`` over a data type, a path, a mode and reporters; ``find-embeddings`` and converters.

    python -m latticeforge.cli mine -o out --support 3 itemset --max-items 4 data.txt dfs
    python -m latticeforge.cli sample -o out --support 5 --samples 20 digraph -l veg graph.veg uniprox
    python -m latticeforge.cli list-embeddings --pattern '{1:2}(a)(b)[0->1:x]' -o out -l veg graph.veg
    python -m latticeforge.cli find-embeddings --pattern '{1:2}(a)(b)[0->1:x]' -l veg graph.veg
    python -m latticeforge.cli dot-to-veg graphs.dot out
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators import digraphs, itemsets
from .options import DigraphOptions, ItemsetOptions
from .plans import estimates, modes, reporters
from .sources import graphs, transactions


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticeforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for command in ("mine", "sample"):
        c = commands.add_parser(command)
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--support", type=int, required=True)
        c.add_argument("--reporters", default="max" if command == "sample" else "", help="comma-separated: max, canon-max, unique, count, histogram, log[=PREFIX], file, dir, skip=N; chain ... endchain tees")
        c.add_argument("--seed", type=int, default=1)
        if command == "sample":
            c.add_argument("--samples", type=int, required=True)
            c.add_argument("--non-unique", action="store_true")
            c.add_argument("--teleport", type=float, default=0.01)
            c.add_argument("--walks", type=int, default=0, help="uniprox: estimate by so many walks; 0 for exact weights")
            c.add_argument("--max", action="store_true", help="uniprox: only maximal patterns")
            c.add_argument("--show-pr", action="store_true")
        else:
            c.add_argument("-s", "--score-function", default="random", choices=("random", "walk-kernel"))
            c.add_argument("-m", "--max-queue-size", type=int, default=10)
        types = c.add_subparsers(dest="type", required=True)
        t = types.add_parser("itemset")
        t.add_argument("--min-items", type=int, default=0)
        t.add_argument("--max-items", type=int, default=0)
        g = types.add_parser("digraph")
        g.add_argument("-l", "--loader", default="veg", choices=("veg", "dot", "int"))
        g.add_argument("-c", "--count-mode", default="mni", type=str.lower, choices=("mni", "fis", "gis"))
        for what in ("edges", "vertices"):
            g.add_argument(f"--min-{what}", type=int, default=0)
            g.add_argument(f"--max-{what}", type=int, default=0)
        g.add_argument("--extend-from-freq-edges", action="store_true")
        g.add_argument("-i", "--include", action="append", default=[])
        g.add_argument("-e", "--exclude", action="append", default=[])
        for x in (t, g):
            x.add_argument("path")
            x.add_argument("mode")
    f = commands.add_parser("find-embeddings")
    f.add_argument("-p", "--pattern", action="append", default=[])
    f.add_argument("--names")
    f.add_argument("--probabilities", help="lines of pr, pattern; estimates over them are printed")
    f.add_argument("--samples", type=int, help="draws that the probabilities are of; the number of lines if not given")
    e = commands.add_parser("list-embeddings")
    e.add_argument("-p", "--pattern", action="append", default=[])
    e.add_argument("--names")
    e.add_argument("-o", "--output", required=True)
    e.add_argument("-l", "--loader", default="veg", choices=("veg", "dot", "int"))
    e.add_argument("path")
    f.add_argument("-l", "--loader", default="veg", choices=("veg", "dot", "int"))
    f.add_argument("path")
    for convert in ("dot-to-veg", "veg-to-int", "clean-dot"):
        c = commands.add_parser(convert)
        c.add_argument("path")
        c.add_argument("output")
    return top


def _names(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    return list(a.pattern) + ([r["pattern"] for r in graphs.read_names(spark, a.names).toLocalIterator()] if a.names else [])


def _lattice(spark: SparkSession, a: argparse.Namespace) -> modes.Lattice:
    if a.type == "itemset":
        rows = transactions.read_int_transactions(spark, a.path)
        return modes.Lattice.of_itemsets(itemsets.mine(rows, ItemsetOptions(a.support, a.min_items, a.max_items)))
    graph = graphs.check_ends(graphs.read_graph(spark, a.path, a.loader, tuple(a.include), tuple(a.exclude)))
    options = DigraphOptions(a.support, a.min_edges, a.max_edges, a.min_vertices, a.max_vertices, a.count_mode, "freq-edges" if a.extend_from_freq_edges else "embeddings")
    return modes.Lattice.of_digraphs(digraphs.mine(graph, options))


def _report(a: argparse.Namespace, lattice: modes.Lattice, rows) -> None:
    out = {"patterns": rows}
    held: list = []
    for name in filter(None, a.reporters.split(",")):
        name, _, value = name.partition("=")
        if name == "chain":
            held.append(rows)
        elif name == "endchain":
            if not held:
                raise SystemExit("endchain without chain")
            rows = held.pop()
        elif name == "max":
            rows = reporters.only_maximal(lattice.edges)(rows)
        elif name == "canon-max":
            rows = reporters.only_canonical_leaves(lattice.edges)(rows)
        elif name == "unique":
            rows = reporters.unique("key", "seq")(rows)
        elif name == "skip":
            rows = reporters.skip(int(value), "seq")(rows)
        elif name == "count":
            out["count"] = reporters.count(rows)
        elif name == "log":
            out["log"] = reporters.log_lines(value, "key", "seq")(rows)
        elif name == "file":
            reporters.file_report(f"{a.output}/file", rows.select(F.col("key").alias("line")), rows, probabilities=rows if "pr" in rows.columns else None)
        elif name == "dir":
            reporters.dir_report(f"{a.output}/dir", rows.withColumn("sample", F.col("seq")).withColumn("pattern", F.col("key")))
        elif name == "histogram":
            out["histogram"] = reporters.histogram(rows, "key")
        else:
            raise SystemExit(f"unknown reporter {name}")
        out["patterns"] = rows
    if held:
        raise SystemExit("chain without endchain")
    reporters.write_reports(out, a.output, "json")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("latticeforge").getOrCreate()
    if a.command == "mine":
        lattice = _lattice(spark, a)
        if a.mode == "index-speed":
            print(modes.index_speed(lattice.patterns))
            return
        run = {"dfs": modes.dfs, "vsigram": modes.vsigram, "qsplor": lambda x: modes.qsplor(x, a.max_queue_size, a.score_function, a.seed)}
        if a.mode not in run:
            raise SystemExit(f"unknown mode {a.mode}")
        _report(a, lattice, run[a.mode](lattice).withColumn("seq", F.monotonically_increasing_id()))
    elif a.command == "sample":
        lattice = _lattice(spark, a)
        rows = modes.sample(lattice, a.mode, a.samples, not a.non_unique, a.seed, a.teleport, walks_n=a.walks, only_maximal=a.max).select(F.col("node").alias("key"), F.col("sample").alias("seq"))
        if a.show_pr:
            from .plans import walks

            chain = modes.CHAINS[a.mode](lattice.patterns, lattice.edges)
            start = spark.createDataFrame([(lattice.root, 1.0)], "node string, pr double")
            rows = rows.join(walks.absorption(chain, start).withColumnRenamed("node", "key"), "key", "left")
        _report(a, lattice, rows)
    elif a.command == "find-embeddings":
        graph = graphs.read_graph(spark, a.path, a.loader)
        prs, lines = {}, 0
        if a.probabilities:
            rows, lines = graphs.read_probabilities(transactions.numbered_lines(spark, a.probabilities))
            prs = {r["pattern"]: r["pr"] for r in reporters.collector(rows)}
        found = []
        for name in dict.fromkeys([*_names(spark, a), *prs]):
            pattern = P.parse(name)
            share, part = digraphs.estimate_match(graph, pattern)
            n = digraphs.find_embeddings(graph, part).count() if part.vertices else 0
            print(f"{share:g}, {n}, {part.name()}, {pattern.name()}")
            if prs.get(name):
                found.append((prs[name], float(share)))
        if found:
            row = estimates.horvitz_thompson(spark.createDataFrame(found, "pr double, y double"), a.samples or lines).first()
            print(", ".join(f"{k} {v:g}" for k, v in row.asDict().items()))
    elif a.command == "list-embeddings":
        graph = graphs.read_graph(spark, a.path, a.loader)
        for k, name in enumerate(_names(spark, a)):
            pattern = P.parse(name)
            rows = digraphs.find_embeddings(graph, pattern)
            rows = rows.select(F.lit(pattern.name()).alias("key"), F.array(*[f"v{i}" for i in range(len(pattern.vertices))]).alias("ids"))
            reporters.embedding_dots(rows, graph.vertices).select("dot").write.mode("overwrite").text(f"{a.output}/{k}")
    elif a.command == "dot-to-veg":
        files = spark.read.text(a.path, wholetext=True).select(F.input_file_name().alias("path"), "value")
        graphs.veg_lines(graphs.parse_dot(files, per_graph_ids=True)).write.mode("overwrite").text(a.output)
    elif a.command == "veg-to-int":
        graphs.int_lines(graphs.dense_ids(graphs.read_graph(spark, a.path, "veg"))).write.mode("overwrite").text(a.output)
    else:
        graphs.veg_lines(graphs.shorten_labels(graphs.read_graph(spark, a.path, "dot"))).write.mode("overwrite").text(a.output)


if __name__ == "__main__":
    main()
