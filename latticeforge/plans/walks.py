"""Markov walks on a materialised lattice.

A chain is a table of transitions (u, v, weight). Exact selection probabilities follow from one join and one sum a level,
as chains that only go down have no cycle. Walks themselves are rows (walk, step, node): every step joins all walks with
the cumulative transitions and takes the first one that reaches a hashed number, so runs repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.lattices import degrees


def _nodes(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    return patterns.select("key", "level").join(degrees(patterns, edges), "key")


def _ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the columns of both nodes, prefixed."""
    for end in ("u", "v"):
        named = nodes.select(F.col("key").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in nodes.columns if c != "key"])
        rows = rows.join(named, end)
    return rows


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("u"), F.col("child").alias("v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return _down(edges).union(edges.select("child", "parent"))


def normalised(rows: DataFrame) -> DataFrame:
    """(u, v, pr): weights over their sum per u; nodes whose weights sum to 0 have no transition."""
    total = rows.groupBy("u").agg(F.sum("weight").alias("total")).where("total > 0")
    return rows.join(total, "u").where("weight > 0").select("u", "v", (F.col("weight") / F.col("total")).alias("pr"))


def graple(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """To every child alike."""
    return normalised(_down(edges).withColumn("weight", F.lit(1.0)))


def fastmax(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """To maximal children by level / parents, to others by children / level."""
    rows = _ends(_down(edges), _nodes(patterns, edges))
    weight = F.when(F.col("v_n_children") == 0, F.col("v_level") / F.col("v_n_parents")).otherwise(F.col("v_n_children") / F.col("v_level"))
    return normalised(rows.withColumn("weight", weight))


def musk(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """To neighbours: never from maximal to maximal; towards or away from one by 1 / its degree; else alike."""
    rows = _ends(_both_ways(edges), _nodes(patterns, edges))
    u_max, v_max = F.col("u_n_children") == 0, F.col("v_n_children") == 0
    weight = F.when(u_max & v_max, 0.0).when(v_max, 1.0 / F.col("v_n_adjacent")).when(u_max, 1.0 / F.col("u_n_adjacent")).otherwise(1.0)
    return normalised(rows.withColumn("weight", weight))


def ospace(patterns: DataFrame, edges: DataFrame, stay: bool = True) -> DataFrame:
    """To neighbours by 1 / (3 * the greater degree), else stay: uniform over all nodes in the long run."""
    rows = _ends(_both_ways(edges), _nodes(patterns, edges))
    rows = rows.select("u", "v", (1.0 / (3 * F.greatest("u_n_adjacent", "v_n_adjacent"))).alias("pr"))
    if not stay:
        return normalised(rows.withColumnRenamed("pr", "weight"))
    own = rows.groupBy("u").agg((1 - F.sum("pr")).alias("pr"))
    return rows.union(own.select("u", F.col("u").alias("v"), "pr"))


def tree_metrics(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, leaves, depth): of the canonical subtree below each node, the leaves and the nodes on its longest path.

    Level by level from the bottom; each level is a join and a sum.
    """
    tree = edges.where("canonical").select("parent", "child")
    deepest = patterns.agg(F.max("level")).first()[0] or 0
    inner = tree.select(F.col("parent").alias("key")).distinct()
    found = patterns.join(inner, "key", "left_anti").select("key", "level", F.lit(1).cast("long").alias("leaves"), F.lit(1).alias("depth"))
    found = cut(found)
    for level in range(deepest - 1, 0, -1):
        here = patterns.where(F.col("level") == level).select("key", "level").join(inner, "key")
        below = here.join(tree, here["key"] == tree["parent"]).join(found.select(F.col("key").alias("child"), "leaves", "depth"), "child")
        sums = below.groupBy("key", "level").agg(F.sum("leaves").alias("leaves"), (F.max("depth") + 1).alias("depth"))
        found = cut(found.unionByName(sums))
    # The root may share its level with single vertices.
    rest = patterns.join(found, "key", "left_anti").select("key", "level")
    below = rest.join(tree, rest["key"] == tree["parent"]).join(found.select(F.col("key").alias("child"), "leaves", "depth"), "child")
    return found.unionByName(below.groupBy("key", "level").agg(F.sum("leaves").alias("leaves"), (F.max("depth") + 1).alias("depth")))


def unisorb(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Down the canonical tree by the number of leaves: every leaf alike in the end."""
    leaves = tree_metrics(patterns, edges).select(F.col("key").alias("v"), F.col("leaves").cast("double").alias("weight"))
    return normalised(_down(edges.where("canonical")).join(leaves, "v").select("u", "v", "weight"))


def draw(rows: DataFrame, n: int, seed: int, key: str, replace: bool = False, weight: str | None = None) -> DataFrame:
    """``n`` rows by hashed numbers: without repeats, all rows at most, or with ``replace``; ``weight`` makes some likelier.

    Without repeats rows are ordered by -log(x) / weight, which draws by weight one after another. With repeats draw k takes
    the row whose part of the cumulative weights holds its number; rows are then numbered in one task.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if not replace:
        return rows.where(w > 0).orderBy(-F.log(F.greatest(hashed(seed, key), F.lit(1e-300))) / w, key).limit(n)
    upto = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.where(w > 0).withColumn("high_", F.sum(w).over(upto)).withColumn("low_", F.col("high_") - w)
    total = parts.agg(F.max("high_").alias("total_"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), hashed(seed, "id").alias("x_")).crossJoin(F.broadcast(total))  # one row
    at = F.col("x_") * F.col("total_")
    return draws.join(parts, (F.col("low_") <= at) & (at < F.col("high_"))).drop("x_", "total_", "low_", "high_")


def permutation(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """``rows`` with ``place``, their place from 0 in an order by hashed numbers."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(hashed(seed, key), key)) - 1)


def estimated_metrics(patterns: DataFrame, edges: DataFrame, walks: int, seed: int = 1) -> DataFrame:
    """(key, level, depth, diameter) of every pattern, from so many hashed uniform walks down its canonical subtree.

    depth counts the nodes of the longest walk and 1; the diameter is the level of its end less that of the last node that
    all walks share, and 1.
    """
    tree = edges.where("canonical")
    kids = cut(tree.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("kids")))
    start = patterns.select("key").crossJoin(patterns.sparkSession.range(walks).withColumnRenamed("id", "walk"))  # a few walks each
    here, step = cut(start.select("key", "walk", F.col("key").alias("at"))), 0
    paths = []
    while not here.isEmpty():
        paths.append(here.select("key", "walk", "at", F.lit(step).alias("step")))
        step += 1
        x = hashed(seed, "key", "walk", F.lit(step))
        moved = here.join(kids, here["at"] == kids["parent"])
        here = cut(moved.select("key", "walk", F.get("kids", F.floor(x * F.size("kids")).cast("int")).alias("at")))
    steps = reduce(DataFrame.unionByName, paths).groupBy("key", "step").agg(F.countDistinct("at").alias("nodes"), F.count("*").alias("n"))
    shared = F.max(F.when((F.col("nodes") == 1) & (F.col("n") == walks), F.col("step")))
    found = steps.groupBy("key").agg((F.max("step") + 2).alias("depth"), (F.max("step") - shared + 1).alias("diameter"))
    return patterns.select("key", "level").join(found, "key")


def uniprox(patterns: DataFrame, edges: DataFrame, minimum_level: int = 0, walks: int = 0, seed: int = 1, only_maximal: bool = False) -> DataFrame:
    """Down the canonical tree by depth times diameter of the subtree.

    They are exact, as the tree is materialised, or with ``walks`` estimated by so many hashed walks. A leaf weighs 1 if
    it reaches the minimum level, else 0. The exact diameter of a subtree is the level of its deepest leaf less that of
    its top, which all its leaves have in common, and 1; the depth counts the nodes of its longest path and 1. With
    ``only_maximal`` a leaf that has children, though no canonical ones, leads back to the root.
    """
    tree = edges.where("canonical")
    if walks:
        metrics = estimated_metrics(patterns, edges, walks, seed).withColumnRenamed("key", "v")
    else:
        exact = tree_metrics(patterns, edges)
        metrics = exact.select(F.col("key").alias("v"), "level", (F.col("depth") + 1).alias("depth"), F.col("depth").alias("diameter"))
    inner = tree.select(F.col("parent").alias("v")).distinct().withColumn("inner", F.lit(True))
    metrics = metrics.join(inner, "v", "left")
    deep = F.col("depth") - 1 + F.col("level") >= minimum_level
    weight = F.when(F.col("inner"), F.when(deep, F.col("depth") * F.col("diameter")).otherwise(0)).otherwise(F.when(F.col("level") >= minimum_level, 1).otherwise(0))
    down = _down(tree).join(metrics.select("v", weight.cast("double").alias("weight")), "v").select("u", "v", "weight")
    if only_maximal:
        roots = patterns.select(F.col("key").alias("v")).join(tree.select(F.col("child").alias("v")), "v", "left_anti")
        back = edges.select(F.col("parent").alias("u")).distinct().join(inner.select(F.col("v").alias("u")), "u", "left_anti")
        down = down.unionByName(back.crossJoin(roots.select("v")).withColumn("weight", F.lit(1.0)))  # one root
    return normalised(down)


def absorption(transitions: DataFrame, start: DataFrame, max_steps: int = 1000) -> DataFrame:
    """(node, pr): chance that a walk from ``start`` (node, pr) ends at each node without transitions.

    A step is a join and a sum. The chain must go down, so it ends after as many steps as there are levels.
    """
    here, ended = cut(start), None
    for _ in range(max_steps):
        stopped = here.join(transitions.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
        ended = stopped if ended is None else ended.unionByName(stopped)
        moved = here.withColumnRenamed("pr", "at").join(transitions, F.col("node") == F.col("u"))
        here = cut(moved.groupBy(F.col("v").alias("node")).agg(F.sum(F.col("at") * F.col("pr")).alias("pr")))
        if here.isEmpty():
            return ended.groupBy("node").agg(F.sum("pr").alias("pr"))
    raise ValueError("the chain does not end; it has a cycle or more steps than allowed")


def hashed(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from the seed and the columns; MD5, so that other engines can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def cumulative(transitions: DataFrame) -> DataFrame:
    """(u, v, low, high): the part of [0, 1) that leads from u to v, neighbours in order of their key."""
    order = Window.partitionBy("u").orderBy("v")
    last = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("v"))) == 1
    high = F.sum("pr").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = transitions.withColumn("high", high).withColumn("low", F.col("high") - F.col("pr"))
    return rows.select("u", "v", F.lag("high", 1, 0.0).over(order).alias("low"), F.when(last, F.lit(2.0)).otherwise(F.col("high")).alias("high"))


def walk(transitions: DataFrame, start: str, walks: int, steps: int, seed: int = 1, every: bool = False) -> DataFrame:
    """(walk, step, node): the last node of each walk, or with ``every`` all nodes that it visits.

    Walks end at nodes without transitions or after ``steps`` steps; all of them move in one join a step.
    """
    parts = cut(cumulative(transitions))
    spark = transitions.sparkSession
    here = spark.range(walks).select(F.col("id").alias("walk"), F.lit(0).alias("step"), F.lit(start).alias("node"))
    done = [here] if every else []
    for step in range(1, steps + 1):
        drawn = here.withColumn("x", hashed(seed, "walk", F.lit(step)))
        moved = drawn.join(parts, F.col("node") == F.col("u")).where("low <= x and x < high").select("walk", F.lit(step).alias("step"), F.col("v").alias("node"))
        if not every:
            done.append(here.join(parts.select(F.col("u").alias("node")).distinct(), "node", "left_anti").select("walk", "step", "node"))
        here = cut(moved)
        if every:
            done.append(here)
        if here.isEmpty():
            break
    else:
        if not every:
            done.append(here)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def collect_samples(visits: DataFrame, acceptable: DataFrame, samples: int, unique: bool = True) -> DataFrame:
    """(sample, node): the first acceptable visits in order of walk and step, each node once if ``unique``.

    The walks are bounded, so fewer than ``samples`` may come.
    """
    good = visits.join(acceptable.select(F.col("key").alias("node")), "node", "left_semi")
    if unique:
        good = good.groupBy("node").agg(F.min(F.struct("walk", "step")).alias("at")).select("at.walk", "at.step", "node")
    top = good.orderBy("walk", "step").limit(samples)
    return top.select((F.row_number().over(Window.orderBy("walk", "step")) - 1).alias("sample"), "node")


def premusk(patterns: DataFrame, edges: DataFrame, start: str, walks: int, steps: int, teleport: float = 0.01, pool: int = 100, seed: int = 1) -> DataFrame:
    """(walk, step, node): musk walks that, after a maximal node, go to a node of a pool with chance ``teleport``.

    The pool holds nodes that ospace walks without self-transitions visit, every tenth step, each once.
    """
    visits = walk(ospace(patterns, edges, stay=False), start, max(1, pool // 4), 40, seed + 1, every=True)
    pooled = visits.where("step > 0 and step % 10 = 0").select("node").distinct().orderBy(hashed(seed, "node"), "node").limit(pool)
    pooled = cut(pooled.select(F.col("node").alias("target"), (F.row_number().over(Window.orderBy("node")) - 1).alias("n")))
    size = pooled.count()
    parts, leaves = cut(cumulative(musk(patterns, edges))), cut(patterns.select("key").join(edges.select(F.col("parent").alias("key")), "key", "left_anti"))
    here = patterns.sparkSession.range(walks).select(F.col("id").alias("walk"), F.lit(0).alias("step"), F.lit(start).alias("node"))
    done = here
    for step in range(1, steps + 1):
        drawn = here.withColumn("x", hashed(seed, "walk", F.lit(step))).withColumn("jump", hashed(seed + 2, "walk", F.lit(step)))
        drawn = drawn.join(leaves.withColumn("leaf", F.lit(True)), F.col("node") == F.col("key"), "left").withColumn("jumps", F.coalesce("leaf", F.lit(False)) & (F.col("jump") < teleport))
        jumped = drawn.where("jumps").withColumn("n", F.floor(hashed(seed + 3, "walk", F.lit(step)) * size)).join(pooled, "n").select("walk", F.lit(step).alias("step"), F.col("target").alias("node"))
        moved = drawn.where("not jumps").join(parts, F.col("node") == F.col("u")).where("low <= x and x < high").select("walk", F.lit(step).alias("step"), F.col("v").alias("node"))
        here = cut(moved.unionByName(jumped))
        done = done.unionByName(here)
    return done
