"""Mining and sampling modes: what a command line of the engine names, as functions over a lattice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import patterns as P
from . import walks


@dataclass
class Lattice:
    """What every mode needs: patterns (key, level, support), edges, the acceptable patterns and the root's key."""

    patterns: DataFrame
    edges: DataFrame
    acceptable: DataFrame
    root: str

    @classmethod
    def of_itemsets(cls, mined) -> Lattice:
        return cls(mined.patterns, cut(mined.edges()), mined.acceptable(), "")

    @classmethod
    def of_digraphs(cls, mined) -> Lattice:
        root = mined.patterns.sparkSession.createDataFrame([("0:0", 1, None)], "key string, level int, support long")
        return cls(mined.patterns.select("key", "level", "support").unionByName(root), mined.edges, mined.acceptable(), "0:0")


def dfs(lattice: Lattice, include_root: bool = True) -> DataFrame:
    """All acceptable patterns reached from the root through children; the root itself if its size is acceptable."""
    rows = lattice.acceptable.select("key", "support")
    return rows if include_root else rows.where(F.col("key") != lattice.root)


def vsigram(lattice: Lattice, include_root: bool = True) -> DataFrame:
    """The same through canonical children only: level by level along the canonical tree, no pattern met twice."""
    frontier = lattice.patterns.where(F.col("key") == lattice.root).select("key")
    tree, found = lattice.edges.where("canonical"), None
    while True:
        found = frontier if found is None else found.unionByName(frontier)
        frontier = cut(frontier.join(tree, frontier["key"] == tree["parent"]).select(F.col("child").alias("key")))
        if frontier.isEmpty():
            break
    return dfs(lattice, include_root).join(found, "key", "left_semi")


def random_score(seed: int) -> Column:
    return walks.hashed(seed, "key")


def walk_kernel_scores(patterns: DataFrame, sample: list[str]) -> DataFrame:
    """(key, score): mean walk distance of each pattern to a sample of patterns of stated size."""
    others = [P.parse(s) for s in sample]

    @F.pandas_udf("double")
    def score(keys):
        return keys.map(lambda k: sum(P.walk_distance(P.parse(k), o) for o in others) / max(1, len(others)))

    return patterns.select("key", score("key").alias("score"))


def qsplor(lattice: Lattice, queue: int = 10, score: str = "random", seed: int = 1) -> DataFrame:
    """Best-first walks of the canonical tree, one from each child of the root, with a queue of bounded size.

    Per level and start the ``queue`` best are kept and expanded, which is a beam search. Scores are random numbers or, for
    digraphs, mean walk distances to ten patterns. The root is not reported.
    """
    if score == "walk-kernel":
        sample = [r["key"] for r in lattice.patterns.where(F.col("key") != lattice.root).orderBy(walks.hashed(seed, "key"), "key").limit(10).collect()]
        scores = cut(walk_kernel_scores(lattice.patterns.where(F.col("key") != lattice.root), sample))
    elif score == "random":
        scores = lattice.patterns.select("key", random_score(seed).alias("score"))
    else:
        raise ValueError("score must be random or walk-kernel")
    tree = lattice.edges.where("canonical")
    here = tree.where(F.col("parent") == lattice.root).select(F.col("child").alias("start"), F.col("child").alias("key"))
    found = here
    best = Window.partitionBy("start").orderBy(F.desc("score"), "key")
    while True:
        below = here.join(tree, here["key"] == tree["parent"]).select("start", F.col("child").alias("key")).join(scores, "key")
        here = cut(below.withColumn("n", F.row_number().over(best)).where(F.col("n") <= queue).select("start", "key"))
        if here.isEmpty():
            break
        found = found.unionByName(here)
    return dfs(lattice, include_root=False).join(found.select("key").distinct(), "key", "left_semi")


def index_speed(*tables: DataFrame) -> int:
    """Load and index only: the rows of all tables."""
    return sum(t.count() for t in tables)


CHAINS = {"graple": walks.graple, "fastmax": walks.fastmax, "musk": walks.musk, "ospace": walks.ospace, "uniprox": walks.uniprox, "unisorb": walks.unisorb}


def sample(lattice: Lattice, mode: str, samples: int, unique: bool = True, seed: int = 1, teleport: float = 0.01, per_sample: int = 4, walks_n: int = 0, only_maximal: bool = False) -> DataFrame:
    """(sample, node) of a sampling mode.

    Absorbing chains start ``per_sample`` walks a sample; musk, ospace and premusk start that many chains and report
    maximal nodes, or for ospace all nodes, that they visit. ``walks_n`` and ``only_maximal`` are options of uniprox. Walks are bounded, so there may be fewer samples than asked.
    """
    if samples <= 0:
        raise ValueError("samples must be positive")
    starts, levels = samples * per_sample, lattice.patterns.agg(F.max("level")).first()[0] + 2
    good = lattice.acceptable
    if mode == "premusk":
        visits = walks.premusk(lattice.patterns, lattice.edges, lattice.root, starts, 4 * levels, teleport, seed=seed)
    elif mode in ("musk", "ospace"):
        visits = walks.walk(CHAINS[mode](lattice.patterns, lattice.edges), lattice.root, starts, 4 * levels, seed, every=True)
    elif mode == "uniprox" and (walks_n or only_maximal):
        chain = walks.uniprox(lattice.patterns, lattice.edges, walks=walks_n, seed=seed, only_maximal=only_maximal)
        visits = walks.walk(chain, lattice.root, starts, 4 * levels, seed)
    elif mode in CHAINS:
        visits = walks.walk(CHAINS[mode](lattice.patterns, lattice.edges), lattice.root, starts, levels, seed)
    else:
        raise ValueError(f"unknown mode {mode}")
    if mode in ("musk", "premusk"):
        good = good.join(lattice.edges.select(F.col("parent").alias("key")), "key", "left_anti")
    return walks.collect_samples(visits, good, samples, unique)
