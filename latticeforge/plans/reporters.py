"""Reporters: what becomes of reported patterns. Each takes and gives a DataFrame, so that they compose."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import patterns as P
from ..functions.distances import Block, block_sums
from . import walks

Reporter = Callable[[DataFrame], DataFrame]


def chain(*reporters: Reporter) -> Callable[[DataFrame], list[DataFrame]]:
    """A tee: the rows, written once, go to every reporter. Chains may hold chains."""

    def report(rows: DataFrame) -> list[DataFrame]:
        rows = cut(rows)
        out = [r(rows) for r in reporters]
        return [x for r in out for x in (r if isinstance(r, list) else [r])]

    return report


def only_maximal(edges: DataFrame, key: str = "key") -> Reporter:
    return lambda rows: rows.join(edges.select(F.col("parent").alias(key)), key, "left_anti")


def only_canonical_leaves(edges: DataFrame, key: str = "key") -> Reporter:
    return only_maximal(edges.where("canonical"), key)


def skip(n: int, order: str = "seq") -> Reporter:
    """Every n-th row; rows are numbered from 1 in ``order``, in groups, so no task sorts all of them."""
    if n < 1:
        raise ValueError("skip must be 1 or more")

    def report(rows: DataFrame) -> DataFrame:
        group = F.floor(F.col(order) / 10_000)
        sizes = rows.groupBy(group.alias("g_")).agg(F.count("*").alias("size_"))
        sizes = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(Window.orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("g_").orderBy(order))
        numbered = rows.withColumn("g_", group).withColumn("at_", inside).join(sizes, "g_")
        return numbered.where((F.col("before_") + F.col("at_")) % n == 0).drop("g_", "at_", "size_", "before_")

    return report


def unique(name: str = "name", order: str = "seq") -> Reporter:
    """The first row of each name."""

    def report(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(name).agg(F.min_by(F.struct(*rows.columns), order).alias("row_"))
        return first.select("row_.*")

    return report


def histogram(rows: DataFrame, name: str = "name") -> DataFrame:
    """(count, freq, name): how often each name was reported, and its share."""
    counts = rows.groupBy(name).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("count", (F.col("count") / F.col("total")).alias("freq"), F.col(name).alias("name"))  # one row


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("count"))


def log_lines(prefix: str = "", name: str = "name", order: str = "seq", pr: str | None = None) -> Reporter:
    """A line per pattern: running number, name and, if given, its probability."""
    parts = [F.lit(prefix)] if prefix else []
    more = [F.col(pr).cast("string")] if pr else []
    return lambda rows: rows.select(order, F.concat_ws(" ", *parts, (F.col(order) + 1).cast("string"), *more, F.col(name)).alias("line"))


def itemset_lines(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, line): items joined by blanks, and a mark at maximal ones."""
    inner = edges.select(F.col("parent").alias("key")).distinct().withColumn("inner", F.lit(True))
    mark = F.when(F.col("inner"), "").otherwise(" # maximal")
    return patterns.join(inner, "key", "left").select("key", F.concat("key", mark).alias("line"))


def embedding_lines(tx_lists: DataFrame) -> DataFrame:
    """(key, line): items, a colon and the transactions."""
    return tx_lists.select("key", F.concat_ws(" : ", "key", F.array_join(F.transform("txs", lambda t: t.cast("string")), " ")).alias("line"))


def matrices(nodes: DataFrame, edges: DataFrame, name: str = "key") -> DataFrame:
    """(key, json): the transition matrices of a pattern's sub-lattice, sparse.

    ``nodes`` (key, node) and ``edges`` (key, parent, child) come from the sub-lattice operators. Q joins inner nodes,
    R the last step to the pattern, u starts at the top. Rows are numbered by node.
    """
    inner = nodes.where("node <> key")
    number = F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1
    numbered = inner.withColumn("i", number)
    n = edges.groupBy("key", "parent").agg(F.count("*").alias("kids"))
    rows = edges.join(n, ["key", "parent"]).join(numbered.withColumnsRenamed({"node": "parent", "i": "row"}), ["key", "parent"])
    rows = rows.join(numbered.withColumnsRenamed({"node": "child", "i": "col"}), ["key", "child"], "left")
    entry = F.struct(F.col("row").alias("Row"), F.coalesce("col", F.lit(0)).alias("Col"), (1.0 / F.col("kids")).alias("Value"), F.col("kids").alias("Inverse"))
    gathered = rows.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), entry))).alias("q"),
        F.array_sort(F.collect_list(F.when(F.col("col").isNull(), entry))).alias("r"),
    )
    sizes = numbered.groupBy("key").agg(F.count("*").alias("n"), F.min_by("i", F.length("node")).alias("start"))
    out = gathered.join(sizes, "key")
    shape = lambda e, cols: F.struct(F.col("n").alias("Rows"), cols.alias("Cols"), F.col(e).alias("Entries"))
    body = F.struct(F.col("key").alias("Name"), shape("q", F.col("n")).alias("Q"), shape("r", F.lit(1)).alias("R"), F.col("start").alias("u"), F.lit(1).alias("startingPoints"))
    return out.select("key", F.to_json(body).alias("json"))


def jaccard_pairs(sets: DataFrame, epsilon: float, key: str = "key", items: str = "items") -> DataFrame:
    """(a, b, distance): pairs a < b of rows whose sets are at most ``epsilon`` apart by Jaccard distance.

    Rows meet on the elements of a prefix of their set in a fixed order, rare elements first, which two sets that
    close must share; so rows without a common rare element are never compared. Equal empty sets are at distance 0.
    """
    keep = 1 - epsilon
    elements = sets.select(key, F.explode(F.array_distinct(items)).alias("e"))
    rarity = elements.groupBy("e").agg(F.count("*").alias("n"))
    ordered = elements.join(rarity, "e").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("o"))
    size = F.size("o")
    prefix = F.slice("o", 1, F.greatest(F.lit(1), (size - F.ceil(size * keep) + 1).cast("int")))
    rows = ordered.select(key, F.transform("o", lambda x: x["e"]).alias("s"), F.explode(prefix).alias("p"))
    rows = rows.select(key, "s", F.col("p.e").alias("e"))
    left, right = rows.select(F.col(key).alias("a"), F.col("s").alias("sa"), "e"), rows.select(F.col(key).alias("b"), F.col("s").alias("sb"), "e")
    close = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * keep - 1e-9
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = left.join(right, "e").where((F.col("a") < F.col("b")) & close).select("a", "b", (1 - both / (F.size("sa") + F.size("sb") - both)).alias("distance"))
    return pairs.where(F.col("distance") <= epsilon + 1e-12).distinct()


def components(nodes: DataFrame, links: DataFrame, key: str = "key") -> DataFrame:
    """(key, cluster): single-link clusters, named by their least key; labels spread and jump until none changes."""
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")))
    labels = cut(nodes.select(key, F.col(key).alias("cluster")))
    while True:
        near = both.join(labels, F.col("y") == F.col(key)).groupBy("x").agg(F.min("cluster").alias("least"))
        moved = labels.join(near, F.col(key) == F.col("x"), "left").select(key, F.least("cluster", F.coalesce("least", "cluster")).alias("new"), "cluster")
        jump = moved.select(F.col(key).alias("at"), F.col("new").alias("to"))
        moved = cut(moved.join(jump, F.col("new") == F.col("at")).select(key, F.col("to").alias("new"), "cluster"))
        labels = moved.select(key, F.col("new").alias("cluster"))
        if moved.where("new <> cluster").isEmpty():
            return labels


def dbscan(patterns: DataFrame, epsilon: float = 0.2, key: str = "key", labels: str = "labels", attributes: str | None = None) -> DataFrame:
    """(key, cluster[, group]): single-link clusters by the Jaccard distance of label sets, each split by attribute sets."""
    clusters = components(patterns, jaccard_pairs(patterns, epsilon, key, labels), key)
    if attributes is None:
        return clusters
    close = jaccard_pairs(patterns, epsilon, key, attributes)
    at = lambda end: clusters.select(F.col(key).alias(end), F.col("cluster").alias(f"c{end}"))
    inside = close.join(at("a"), "a").join(at("b"), "b").where("ca = cb").select("a", "b", "distance")
    groups = components(patterns, inside, key).withColumnRenamed("cluster", "group")
    return clusters.join(groups, key)


def _blocks(named: DataFrame, items: str, ways: tuple[str, ...], block: int) -> tuple[DataFrame, int]:
    """(block, data): the distinct sets of ``items`` in blocks of about ``block``, each what distances.Block takes, pickled; and how many blocks."""
    rows = named.where(F.col(items).isNotNull()).withColumn("set_", F.array_sort(F.array_distinct(items)))
    for way in ways:
        sizes = cut(named.where(F.col(way).isNotNull()).groupBy(way).agg(F.count("*").alias(f"{way}_n")))
        rows = rows.join(sizes.withColumn(f"{way}_id", F.monotonically_increasing_id()), way, "left")
    columns = [f"{way}_{x}" for way in ways for x in ("id", "n")]
    # A null cluster is -1: its pairs have no part.
    counts = rows.groupBy("set_", *columns).agg(F.count("*").alias("m")).na.fill(-1, columns)
    sets = cut(counts.groupBy("set_").agg(F.collect_list(F.struct("m", *columns)).alias("cell")))
    blocks = -(-sets.count() // block)
    sets = cut(sets.withColumn("at_", F.monotonically_increasing_id()))
    elements = sets.select("at_", F.explode("set_").alias("e"))
    numbers = cut(elements.select(F.col("e").alias("x")).distinct()).withColumn("i", F.monotonically_increasing_id())
    lists = elements.join(numbers, F.col("e").eqNullSafe(F.col("x"))).groupBy("at_").agg(F.collect_list("i").alias("list"))
    fields = [F.col(f"cell.{x}").alias(x) for x in ("m", *columns)]
    sets = sets.join(lists, "at_", "left").select(F.pmod(F.xxhash64("at_"), F.lit(max(1, blocks))).cast("int").alias("block"), "list", *fields)

    def pack(rows):
        import pandas as pd

        cells, of = [], np.repeat(np.arange(len(rows)), rows["m"].map(len))
        for way in ways:
            at = pd.DataFrame({"set": of, "id": np.concatenate(rows[f"{way}_id"].tolist()), "n": np.concatenate(rows[f"{way}_n"].tolist()), "m": np.concatenate(rows["m"].tolist())})
            at = at[at["id"] >= 0].groupby(["set", "id", "n"], as_index=False)["m"].sum()
            cells.append(tuple(at[x].to_numpy(np.int64) for x in ("set", "id", "m", "n")))
        lists = [np.zeros(0, np.int64) if x is None else x for x in rows["list"]]
        data = pickle.dumps((np.array([len(x) for x in lists], np.int64), np.concatenate(lists), cells))
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "data": [zlib.compress(data, 1)]})

    return cut(sets.groupBy("block").applyInPandas(pack, "block int, data binary")), blocks


def _pair_sums(blocks: DataFrame, n: int, ways: int) -> list[dict[str, float]]:
    """The sums of distances.block_sums over all pairs of ``n`` blocks."""
    names = ("d", "dd", "inside", "intra", "inter")

    def compare(batches):
        import pandas as pd

        for batch in batches:
            for a, b, x, y in zip(batch["a"], batch["b"], batch["data_a"], batch["data_b"], strict=True):
                first = Block(*pickle.loads(zlib.decompress(x)))
                found = block_sums(first, first if a == b else Block(*pickle.loads(zlib.decompress(y))))
                yield pd.DataFrame([{"way": i} | s for i, s in enumerate(found)])

    spark = blocks.sparkSession
    of = lambda s: blocks.select(F.col("block").alias(s), F.col("data").alias(f"data_{s}"))
    pairs = spark.range(n * n).select((F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b")).where("a <= b")
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    # Few pairs a task, as their sets are heavy; the number is not left to adaptive execution, which sees bytes, not work.
    pairs = pairs.repartition(max(3 * spark.sparkContext.defaultParallelism, n * n // 32), "a", "b")
    schema = "way int, " + ", ".join(f"{x} double" for x in (*names, "low", "high"))
    sums = pairs.mapInPandas(compare, schema).groupBy("way").agg(*[F.sum(x).alias(x) for x in names], F.min("low").alias("low"), F.max("high").alias("high"))
    found = {r["way"]: r.asDict() for r in sums.collect()}
    return [found.get(i, {}) for i in range(ways)]


def cluster_metrics(clusters: DataFrame, sets: DataFrame, seed: int = 1, key: str = "key", items: str = "items", block: int = 1024) -> DataFrame:
    """One row about clusters (key, cluster) of patterns by the Jaccard distance of their sets (key, items); a key has one row.

    intra and inter sum, over clusters and pairs of clusters, the distances of pairs inside and across, divided by the
    sizes; correlation is that of a pair's distance with its being inside one. They are null if there is no such pair. The
    same follow for patterns dealt to as many clusters by hashed numbers (random_...), and the differences (difference_...).

    All pairs count, but only distinct sets are compared, ``block`` or so of them with as many others at a time, and no row is
    made of a pair: work grows with the square of the distinct sets, memory does not.
    """
    named = cut(clusters.select(key, F.col("cluster").alias("c")).join(sets.select(key, items), key))
    groups = named.select("c").where("c IS NOT NULL").distinct().count()
    named = cut(named.withColumn("r", F.floor(walks.hashed(seed, key) * groups).cast("string")))
    sums = _pair_sums(*_blocks(named, items, ("c", "r"), block), 2)
    row = named.agg(F.count("*").alias("items"), F.countDistinct("c").alias("clusters"), F.countDistinct("r").alias("random_clusters")).first().asDict()
    for way, prefix, found in zip(("c", "r"), ("", "random_"), sums, strict=True):
        members = named.where(F.col(way).isNotNull() & F.col(items).isNotNull()).groupBy(way).agg(F.count("*").alias("n"))
        exact = members.select(F.col("n").cast("decimal(38,0)").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside")).first()
        n, inside = int(exact["n"] or 0), int(exact["inside"] or 0) // 2
        pairs = n * (n - 1) // 2
        row[f"{prefix}intra"] = found["intra"] if inside else None
        row[f"{prefix}inter"] = found["inter"] if inside < pairs else None
        row[f"{prefix}correlation"] = None
        if pairs:
            # Without variance there is none, as in DuckDB.
            share, mean = inside / pairs, found["d"] / pairs
            varies = 0 < inside < pairs and found["low"] < found["high"]
            row[f"{prefix}correlation"] = (found["inside"] / pairs - share * mean) / math.sqrt((found["dd"] / pairs - mean * mean) * share * (1 - share)) if varies else math.nan
    schema = ", ".join(f"{x} {'long' if x.endswith(('items', 'clusters')) else 'double'}" for x in row)
    out = named.sparkSession.createDataFrame([tuple(row.values())], schema)
    for prefix in ("", "random_"):
        out = out.withColumn(f"{prefix}ratio", F.col(f"{prefix}intra") / F.nullif(F.col(f"{prefix}inter"), F.lit(0.0)))
    for name in ("clusters", "intra", "inter", "correlation", "ratio"):
        out = out.withColumn(f"difference_{name}", F.abs(F.col(name) - F.col(f"random_{name}")))
    return out


def embedding_dots(embeddings: DataFrame, vertices: DataFrame) -> DataFrame:
    """(key, ids, dot): each embedding as a DOT graph whose nodes bear the graph's ids and attributes.

    A vertex is shown by its label, and by attribute start_line where it has one.
    """
    attrs = F.col("attrs") if "attrs" in vertices.columns else F.create_map().cast("map<string,string>")
    at = embeddings.select("key", "ids", F.posexplode("ids").alias("i", "id")).join(vertices.select("id", attrs.alias("attrs")), "id", "left")
    rows = at.groupBy("key", "ids").agg(F.array_sort(F.collect_list(F.struct("i", F.to_json("attrs").alias("attrs")))).alias("x"))

    @F.pandas_udf("string")
    def dot(keys, ids, attrs):
        import json

        import pandas as pd

        return pd.Series([P.embedding_dot(P.parse(k), list(i), [json.loads(x["attrs"] or "{}") for x in a]) for k, i, a in zip(keys, ids, attrs, strict=True)])

    return rows.select("key", "ids", dot("key", "ids", "x").alias("dot"))


def file_report(folder: str, patterns: DataFrame, names: DataFrame, embeddings: DataFrame | None = None, matrices: DataFrame | None = None, probabilities: DataFrame | None = None) -> None:
    """The artefacts of a run as text, one folder each: patterns (line), names.txt (key), embeddings (line), matrices.json
    (json) and probabilities.prs (pr, key), a line ``pr, name`` each."""
    artefacts = {"patterns": patterns.select("line"), "names.txt": names.select("key")}
    if embeddings is not None:
        artefacts["embeddings"] = embeddings.select("line")
    if matrices is not None:
        artefacts["matrices.json"] = matrices.select("json")
    if probabilities is not None:
        artefacts["probabilities.prs"] = probabilities.select(F.concat_ws(", ", F.col("pr").cast("string"), "key").alias("line"))
    write_reports(artefacts, folder, "text")


def dir_report(folder: str, samples: DataFrame, embeddings: DataFrame | None = None) -> None:
    """A numbered folder for each sample (sample, key, pattern[, pr, matrices]) with its name, pattern, count of embeddings,
    matrices and probability, one with all of its embeddings (sample, embedding, text), and the count of all.

    An embedding is a numbered line of JSON, not a file of its own, so that files do not grow with the embeddings.
    """
    number = {"key": "pattern.name", "pattern": "pattern", "pr": "pattern.pr", "matrices": "matrices.json"}
    for column, name in number.items():
        if column in samples.columns:
            rows = samples.select("sample", F.col(column).cast("string").alias("value")).where("value IS NOT NULL")
            rows.write.mode("overwrite").partitionBy("sample").text(f"{folder}/{name}")
    if embeddings is not None:
        embeddings = cut(embeddings.select("sample", "embedding", "text"))
        counts = embeddings.groupBy("sample").agg(F.count("*").cast("string").alias("value"))
        counts.write.mode("overwrite").partitionBy("sample").text(f"{folder}/embeddings")
        embeddings.write.mode("overwrite").partitionBy("sample").json(f"{folder}/embedding")
    count(samples).select(F.col("count").cast("string")).write.mode("overwrite").text(f"{folder}/count")


def collector(rows: DataFrame, most: int = 100_000) -> list:
    """The rows as a list in memory, ``most`` at most; more are an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return found


def write_reports(rows: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One sub-folder for each artefact: patterns, embeddings, names, matrices, probabilities and so on."""
    for name, df in rows.items():
        writer = df.write.mode("overwrite")
        if fmt == "text":
            writer.text(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")


def write_samples(samples: DataFrame, folder: str, number: str = "sample") -> None:
    """A folder for each sample, and their count."""
    samples.write.mode("overwrite").partitionBy(number).json(f"{folder}/samples")
    count(samples).select(F.col("count").cast("string")).write.mode("overwrite").text(f"{folder}/count")


def quoted_dot(text: Column) -> Column:
    """Text for a DOT attribute: quotes and line breaks escaped."""
    return F.regexp_replace(F.regexp_replace(text, '"', '\\\\\\\\"'), "\n", "\\\\\\\\n")


