"""The itemset lattice, level by level.

Patterns are rows (key, items, size, support): items a sorted array, key the items joined by blanks. A pattern's
transactions are rows (items, tx). Level k + 1 joins the transactions of level k with the frequent items on tx, greater
items only, so each itemset is made once; counting is a partial and a final aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..options import ItemsetOptions


def key_of(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: i.cast("string")), " ")


def frequent_items(transactions: DataFrame, options: ItemsetOptions) -> DataFrame:
    """(item, support): items in more transactions than the support; in as many too if not strict."""
    n = F.countDistinct("tx") if options.dedupe else F.count("*")
    enough = F.col("support") > options.support if options.strict_singletons else F.col("support") >= options.support
    return transactions.groupBy("item").agg(n.alias("support")).where(enough & (F.col("support") >= options.support))


def restrict(transactions: DataFrame, items: DataFrame, dedupe: bool = True) -> DataFrame:
    """The transactions without infrequent items; an item that is repeated in one counts once if ``dedupe``."""
    left = transactions.join(items.select("item"), "item", "left_semi").select("tx", "item")
    return left.distinct() if dedupe else left


def extend(members: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions (items, tx) of all patterns made by appending a greater item."""
    joined = members.join(transactions, (members["tx"] == transactions["tx"]) & (F.element_at("items", -1) < F.col("item")))
    return joined.select(F.concat("items", F.array("item")).alias("items"), members["tx"])


def all_children(members: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions (items, tx) of every superset with one more item, whatever its place."""
    joined = members.join(transactions, members["tx"] == transactions["tx"]).where(~F.array_contains("items", F.col("item")))
    return joined.select(F.array_sort(F.concat("items", F.array("item"))).alias("items"), members["tx"]).distinct()


def counted(members: DataFrame, support: int) -> DataFrame:
    return members.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def too_large(patterns: DataFrame, options: ItemsetOptions) -> DataFrame:
    """The patterns beyond the greatest size."""
    return patterns.where(F.col("size") > options.max_items)


@dataclass
class ItemsetLattice:
    """patterns (key, items, size, level, support), root included; members (items, tx) of all but the root."""

    patterns: DataFrame
    members: DataFrame
    options: ItemsetOptions

    def edges(self) -> DataFrame:
        """(parent, child, canonical): every pattern with one item less, all frequent by downward closure.

        The canonical parent lacks the greatest item.
        """
        items = self.patterns.where("size > 0").select("key", "items", F.explode("items").alias("gone"))
        parent = key_of(F.array_remove("items", F.col("gone")))
        return items.select(parent.alias("parent"), F.col("key").alias("child"), (F.col("gone") == F.element_at("items", -1)).alias("canonical"))

    def acceptable(self) -> DataFrame:
        return self.patterns.where(F.col("size").between(self.options.min_items, self.options.max_items))

    def tx_lists(self) -> DataFrame:
        """(key, txs): sorted transactions of each pattern."""
        return self.members.groupBy("items").agg(F.array_sort(F.collect_list("tx")).alias("txs")).select(key_of(F.col("items")).alias("key"), "txs")


def mine(transactions: DataFrame, options: ItemsetOptions, keep_members: bool = True) -> ItemsetLattice:
    """All frequent itemsets. Without ``keep_members`` the transactions of the last level are only counted."""
    singles = frequent_items(transactions, options)
    basket = cut(restrict(transactions, singles, options.dedupe))
    members = basket.select(F.array("item").alias("items"), "tx")
    levels, kept, size = [singles.select(F.array("item").alias("items"), F.col("support"))], [members], 1
    while size < options.max_items:
        wider = extend(members, basket)
        last = size + 1 == options.max_items and not keep_members
        wider = wider if last else cut(wider)
        found = cut(counted(wider, options.support))
        if found.isEmpty():
            break
        levels.append(found)
        size += 1
        if last:
            break
        members = cut(wider.join(found.select("items"), "items", "left_semi"))
        kept.append(members)
    patterns = reduce(DataFrame.unionByName, levels)
    patterns = patterns.select(key_of(F.col("items")).alias("key"), "items", F.size("items").alias("size"), (F.size("items") + 1).alias("level"), "support")
    item_type = patterns.schema["items"].dataType
    total = basket.agg(F.countDistinct("tx").alias("support"))
    root = total.select(F.lit("").alias("key"), F.array().cast(item_type).alias("items"), F.lit(0).alias("size"), F.lit(1).alias("level"), "support")
    return ItemsetLattice(cut(patterns.unionByName(root)), reduce(DataFrame.unionByName, kept), options)


def children(lattice: ItemsetLattice, transactions: DataFrame, of: DataFrame) -> DataFrame:
    """(parent, child, support) by search: all frequent supersets of the patterns ``of`` (items), one item more."""
    members = lattice.members.join(of.select("items"), "items", "left_semi")
    joined = members.join(transactions, "tx").where(~F.array_contains("items", F.col("item")))
    pairs = joined.select(key_of(F.col("items")).alias("parent"), F.array_sort(F.concat("items", F.array("item"))).alias("items"), "tx").distinct()
    return pairs.groupBy("parent", "items").agg(F.count("*").alias("support")).where(F.col("support") >= lattice.options.support).select("parent", key_of(F.col("items")).alias("child"), "support")


def parent_support(members: DataFrame, child: DataFrame) -> DataFrame:
    """Support of the parents of patterns ``child`` (items) by division: transactions that hold all items of a parent.

    ``members`` is the long table (tx, item).
    """
    parents = child.select(F.explode(F.transform("items", lambda i: F.array_remove("items", i))).alias("items")).where(F.size("items") > 0).distinct()
    wanted = parents.select("items", F.explode("items").alias("item"))
    met = members.join(wanted, "item").groupBy("items", "tx").agg(F.countDistinct("item").alias("n")).where(F.col("n") == F.size("items"))
    return met.groupBy("items").agg(F.count("*").alias("support")).select(key_of(F.col("items")).alias("key"), "support")


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 0 for two empty sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)


def common_ancestor(patterns: DataFrame) -> DataFrame:
    """One row (items): the items that all patterns share, by counting rather than by gathering them; null if there are no patterns."""
    total = patterns.agg(F.count("*").alias("n"))
    shared = patterns.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    shared = shared.join(F.broadcast(total), "n")  # one row
    found = shared.agg(F.array_sort(F.collect_list("item")).alias("items"))
    return found.crossJoin(F.broadcast(total)).select(F.when(F.col("n") > 0, F.col("items")).alias("items"))  # one row each
