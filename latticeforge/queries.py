"""The engine's queries over the driver tables, each with the SQL that gives the same rows.

Keys carry the ids of the operator inventory in their docstrings. Baskets: brands per order, event types per user and
day. Graphs: orders to customers to nations to regions, and the events of a user in their order. Supports are two percent
of the baskets or a share of the vertices, so that they follow the data.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut, scratch
from .functions import patterns as P
from .operators import digraphs, itemsets, lattices
from .operators.digraphs import Graph
from .options import DigraphOptions, ItemsetOptions
from .plans import estimates, modes, reporters, walks
from .sources import graphs, transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Itemsets ---------------------------------------------------------------------------------------------------------------


def brand_baskets(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return transactions.baskets(items, "l_orderkey", "p_brand")


def event_baskets(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").select(F.concat_ws(":", "user_id", F.to_date("ts").cast("string")).alias("tx"), "event_type")
    return transactions.baskets(events, "tx", "event_type")


def _support(baskets: DataFrame) -> int:
    return max(2, baskets.select("tx").distinct().count() * 2 // 100)


def _brands(spark: SparkSession, d: str, size: int = 2, **more) -> itemsets.ItemsetLattice:
    baskets = cut(brand_baskets(spark, d))
    return itemsets.mine(baskets, ItemsetOptions(_support(baskets), max_items=size), **more)


def _events(spark: SparkSession, d: str) -> itemsets.ItemsetLattice:
    baskets = cut(event_baskets(spark, d))
    return itemsets.mine(baskets, ItemsetOptions(_support(baskets), max_items=5))


B_SQL = """WITH b AS (SELECT DISTINCT l_orderkey AS tx, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL),
s AS (SELECT greatest(2, count(DISTINCT tx) * 2 // 100) AS s FROM b),
f AS (SELECT item, count(*) AS support FROM b GROUP BY item HAVING count(*) > (SELECT s FROM s)),
fb AS (SELECT tx, item FROM b SEMI JOIN f USING (item))
"""
E_SQL = B_SQL.replace("SELECT DISTINCT l_orderkey AS tx, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL", "SELECT DISTINCT user_id::VARCHAR || ':' || ts::DATE::VARCHAR AS tx, event_type AS item FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")


def _levels_sql(start: str, most: int) -> str:
    """CTEs pat (items, key, size, support) and members (items, tx) of all itemsets up to ``most`` items."""
    sql = start + ", m1 AS (SELECT [item] AS items, tx FROM fb), p1 AS (SELECT items, count(*) AS support FROM m1 GROUP BY items)"
    for k in range(2, most + 1):
        sql += f""", c{k} AS (SELECT list_append(m.items, fb.item) AS items, m.tx FROM m{k - 1} m JOIN fb ON m.tx = fb.tx AND fb.item > m.items[-1]),
p{k} AS (SELECT items, count(*) AS support FROM c{k} GROUP BY items HAVING count(*) >= (SELECT s FROM s)),
m{k} AS (SELECT items, tx FROM c{k} SEMI JOIN p{k} USING (items))"""
    union = lambda x: " UNION ALL ".join(f"SELECT * FROM {x}{k}" for k in range(1, most + 1))
    return (
        sql
        + f""", members AS ({union('m')}), found AS ({union('p')}),
pat AS (SELECT array_to_string(items, ' ') AS key, items, len(items)::INT AS size, (len(items) + 1)::INT AS level, support FROM found
  UNION ALL SELECT '', []::VARCHAR[], 0, 1, (SELECT count(DISTINCT tx) FROM fb)),
edge AS (SELECT array_to_string([i FOR i IN items IF i <> x], ' ') AS parent, key AS child, x = items[-1] AS canonical FROM (SELECT key, items, unnest(items) AS x FROM pat WHERE size > 0)),
deg AS (SELECT key, level, (SELECT count(*) FROM edge WHERE parent = key) AS kids, (SELECT count(*) FROM edge WHERE child = key) AS folks FROM pat)
"""
    )


EL_SQL = _levels_sql(E_SQL, 5)


@query(B_SQL + "SELECT item, support::BIGINT AS support FROM f")
def src_items_filter(spark, d):
    """SRC-3, SRC-4, AGG-1: items in more baskets than the support."""
    baskets = brand_baskets(spark, d)
    return itemsets.frequent_items(baskets, ItemsetOptions(_support(baskets)))


@query(B_SQL + "SELECT a.item || ' ' || b.item AS key, count(*)::BIGINT AS support FROM fb a JOIN fb b ON a.tx = b.tx AND a.item < b.item GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)")
def itemset_pairs(spark, d):
    """LAT-4, JOIN-2, FLT-5: frequent pairs of brands."""
    return _brands(spark, d, keep_members=False).patterns.where("size = 2").select("key", "support")


@query(EL_SQL + "SELECT key, size, level, support::BIGINT AS support FROM pat")
def itemset_levels(spark, d):
    """MINE-1, LAT-1, LAT-9: the whole lattice of event types, root included."""
    return _events(spark, d).patterns.select("key", "size", "level", "support")


@query(EL_SQL + "SELECT key, support::BIGINT AS support FROM pat WHERE size BETWEEN 2 AND 3")
def itemset_acceptable(spark, d):
    """FLT-1, FLT-4, FLT-8: itemsets within size bounds."""
    baskets = cut(event_baskets(spark, d))
    return itemsets.mine(baskets, ItemsetOptions(_support(baskets), min_items=2, max_items=3)).acceptable().select("key", "support")


@query(_levels_sql(B_SQL, 2) + "SELECT array_to_string(items, ' ') AS key, count(*)::BIGINT AS n, string_agg(tx::VARCHAR, ' ' ORDER BY tx) AS txs FROM members WHERE len(items) = 2 GROUP BY items")
def itemset_tx_lists(spark, d):
    """JOIN-1, SNK-5: sorted transactions of each frequent pair."""
    lists = _brands(spark, d).tx_lists().where(F.col("key").contains(" "))
    return lists.select("key", F.size("txs").cast("long").alias("n"), F.array_join(F.transform("txs", lambda t: t.cast("string")), " ").alias("txs"))


@query(EL_SQL + "SELECT parent, child, canonical FROM edge")
def itemset_parents(spark, d):
    """LAT-3, LAT-4, LAT-5: edges of the lattice."""
    return _events(spark, d).edges()


@query(EL_SQL + "SELECT a.key AS parent, b.key AS child, b.support::BIGINT AS support FROM pat a JOIN edge ON edge.parent = a.key JOIN pat b ON edge.child = b.key WHERE a.size = 2")
def itemset_children(spark, d):
    """LAT-3, JOIN-1: children of all pairs, searched through their transactions."""
    lattice = _events(spark, d)
    baskets = itemsets.restrict(event_baskets(spark, d), lattice.patterns.where("size = 1").select(F.get("items", 0).alias("item")))
    return itemsets.children(lattice, baskets, lattice.patterns.where("size = 2"))


@query(EL_SQL + "SELECT DISTINCT a.key, a.support::BIGINT AS support FROM pat a JOIN edge ON edge.parent = a.key JOIN pat b ON edge.child = b.key WHERE b.size = 3")
def itemset_parent_support(spark, d):
    """JOIN-3, SET-1, SET-2: support of the parents of triples by division."""
    lattice = _events(spark, d)
    return itemsets.parent_support(event_baskets(spark, d), lattice.patterns.where("size = 3"))


@query(EL_SQL + "SELECT key, kids::BIGINT AS n_children, folks::BIGINT AS n_parents, (kids + folks)::BIGINT AS n_adjacent FROM deg")
def itemset_degrees(spark, d):
    """AGG-11."""
    lattice = _events(spark, d)
    return lattices.degrees(lattice.patterns, lattice.edges())


@query(EL_SQL + "SELECT key, support::BIGINT AS support FROM pat WHERE key NOT IN (SELECT parent FROM edge)")
def itemset_maximal(spark, d):
    """FLT-11, REP-2."""
    lattice = _events(spark, d)
    return lattices.maximal(lattice.patterns, lattice.edges()).select("key", "support")


@query(EL_SQL + "SELECT key, support::BIGINT AS support FROM pat WHERE key NOT IN (SELECT parent FROM edge WHERE canonical)")
def itemset_canon_leaves(spark, d):
    """REP-3."""
    lattice = _events(spark, d)
    return reporters.only_canonical_leaves(lattice.edges())(lattice.patterns).select("key", "support")


@query(EL_SQL + ", r AS (SELECT a.key, b.key AS node FROM pat a JOIN pat b ON list_has_all(a.items, b.items) WHERE a.size = 3) SELECT key, node FROM r")
def itemset_sublattice(spark, d):
    """LAT-11: all nodes below each triple."""
    lattice = _events(spark, d)
    return lattices.sublattice(lattice.edges(), lattice.patterns.where("size = 3").select("key"))


@query(EL_SQL + "SELECT a.key AS a, b.key AS b, round(1 - len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::DOUBLE, 9) AS distance FROM pat a JOIN pat b ON a.key < b.key WHERE a.size > 0")
def itemset_jaccard(spark, d):
    """FN-1: Jaccard distances of all pairs of patterns; a lattice of event types has 31 at most."""
    rows = _events(spark, d).patterns.where("size > 0").select("key", "items")
    a, b = rows.select(F.col("key").alias("a"), F.col("items").alias("x")), rows.select(F.col("key").alias("b"), F.col("items").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(itemsets.jaccard_distance(F.col("x"), F.col("y")), 9).alias("distance"))


@query(EL_SQL + "SELECT key, key || CASE WHEN kids = 0 THEN ' # maximal' ELSE '' END AS line FROM deg")
def itemset_format(spark, d):
    """SNK-5: pattern lines with the mark of maximal ones."""
    lattice = _events(spark, d)
    return reporters.itemset_lines(lattice.patterns, lattice.edges())


@query(EL_SQL + "SELECT array_to_string(list_sort(list_reduce(list(items), lambda x, y: list_intersect(x, y))), ' ') AS items FROM pat WHERE size >= 4")
def itemset_common_ancestor(spark, d):
    """AGG-12: items that all itemsets of four or more share."""
    rows = _events(spark, d).patterns.where("size >= 4")
    return itemsets.common_ancestor(rows).select(itemsets.key_of(F.col("items")).alias("items"))


@query("SELECT doc_id AS tx, list_sum([try_cast(w AS INT) FOR w IN string_split(text, ' ')])::BIGINT AS total, len([1 FOR w IN string_split(text, ' ') IF try_cast(w AS INT) IS NOT NULL])::BIGINT AS n FROM (SELECT l_orderkey AS doc_id, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) || ' x' AS text FROM lineitem GROUP BY 1)")
def src_int_lines(spark, d):
    """SRC-1, SRC-2: integers of text lines, other tokens skipped."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    lines = lines.select(F.col("l_orderkey").alias("line"), F.concat(F.array_join(F.transform("p", lambda x: x["l_partkey"].cast("string")), " "), F.lit(" x")).alias("value"))
    return transactions.parse_int_lines(lines).groupBy("tx").agg(F.sum("item").cast("long").alias("total"), F.count("*").alias("n"))


# Walks ------------------------------------------------------------------------------------------------------------------


def _chain(name: str):
    def f(spark, d):
        lattice = _events(spark, d)
        rows = getattr(walks, name)(lattice.patterns, lattice.edges())
        return rows.select("u", "v", F.round("pr", 9).alias("pr"))

    f.__name__, f.__doc__ = f"{name}_transition_pr", f"SMP: transition probabilities of {name}."
    return f


_BOTH = ", adj AS (SELECT parent AS u, child AS v FROM edge UNION ALL SELECT child, parent FROM edge), w AS (SELECT u, v, {} AS w FROM adj JOIN deg a ON a.key = u JOIN deg b ON b.key = v)"
_DOWN = ", adj AS (SELECT parent AS u, child AS v FROM edge{}), w AS (SELECT u, v, {} AS w FROM adj JOIN deg a ON a.key = u JOIN deg b ON b.key = v)"
_NORM = " SELECT u, v, round(w / sum(w) OVER (PARTITION BY u), 9) AS pr FROM w WHERE w > 0"
_FASTMAX = EL_SQL + _DOWN.format("", "CASE WHEN b.kids = 0 THEN b.level / b.folks::DOUBLE ELSE b.kids / b.level::DOUBLE END")
query(EL_SQL + _DOWN.format("", "1.0::DOUBLE") + _NORM)(_chain("graple"))
query(_FASTMAX + _NORM)(_chain("fastmax"))
query(EL_SQL + _BOTH.format("CASE WHEN a.kids = 0 AND b.kids = 0 THEN 0 WHEN b.kids = 0 THEN 1.0::DOUBLE / (b.kids + b.folks) WHEN a.kids = 0 THEN 1.0::DOUBLE / (a.kids + a.folks) ELSE 1 END") + _NORM)(_chain("musk"))
query(EL_SQL + _BOTH.format("1.0::DOUBLE / (3 * greatest(a.kids + a.folks, b.kids + b.folks))") + " SELECT u, v, round(w, 9) AS pr FROM w UNION ALL SELECT u, u, round(1 - sum(w), 9) FROM w GROUP BY u")(_chain("ospace"))

# Leaves and depth of canonical subtrees: canonical descendants append greater items, so their items begin with the node's.
_TREE = EL_SQL + """, leaf AS (SELECT items, size FROM pat WHERE key NOT IN (SELECT parent FROM edge WHERE canonical)),
tree AS (SELECT p.key, p.level, p.size, count(l.items) AS leaves, max(l.size) - p.size + 1 AS depth FROM pat p JOIN leaf l ON l.items[:p.size] = p.items GROUP BY p.key, p.level, p.size)"""
query(_TREE + ", w AS (SELECT parent AS u, child AS v, leaves::DOUBLE AS w FROM edge JOIN tree ON tree.key = child WHERE canonical)" + _NORM)(_chain("unisorb"))
query(_TREE + ", w AS (SELECT parent AS u, child AS v, (CASE WHEN child IN (SELECT parent FROM edge WHERE canonical) THEN (depth + 1) * depth ELSE 1 END)::DOUBLE AS w FROM edge JOIN tree ON tree.key = child WHERE canonical)" + _NORM)(_chain("uniprox"))


@query(_TREE + "SELECT key, leaves::BIGINT AS leaves, depth::INT AS depth FROM tree")
def canonical_tree_metrics(spark, d):
    """SMP-6, SMP-14: leaves and depth of the canonical subtrees."""
    lattice = _events(spark, d)
    return walks.tree_metrics(lattice.patterns, lattice.edges()).select("key", "leaves", F.col("depth").cast("int").alias("depth"))


def _selection_sql(start: str) -> str:
    """Selection probabilities: mass moves down ``pr`` (u, v, pr) six times from the root."""
    sql = start + ", h0 AS (SELECT '' AS node, 1.0::DOUBLE AS p)"
    for k in range(1, 7):
        sql += f", h{k} AS (SELECT v AS node, sum(p * pr) AS p FROM h{k - 1} JOIN pr ON u = node GROUP BY v)"
    union = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(7))
    return sql + f" SELECT node AS key, round(sum(p), 9) AS pr FROM ({union}) WHERE node NOT IN (SELECT u FROM pr) GROUP BY node"


_PR = ", pr AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS pr FROM w WHERE w > 0)"


def _selection(name: str):
    def f(spark, d):
        lattice = _events(spark, d)
        chain = cut(getattr(walks, name)(lattice.patterns, lattice.edges()))
        start = spark.createDataFrame([("", 1.0)], "node string, pr double")
        return walks.absorption(chain, start).select(F.col("node").alias("key"), F.round("pr", 9).alias("pr"))

    f.__name__, f.__doc__ = f"{name}_selection_pr", f"SMP-10, SMP-11: exact chance that a {name} walk ends at each pattern."
    return f


query(_selection_sql(EL_SQL + _DOWN.format("", "1.0::DOUBLE") + _PR))(_selection("graple"))
query(_selection_sql(_FASTMAX + _PR))(_selection("fastmax"))
query(_selection_sql(_TREE + ", w AS (SELECT parent AS u, child AS v, leaves::DOUBLE AS w FROM edge JOIN tree ON tree.key = child WHERE canonical)" + _PR))(_selection("unisorb"))
query(_selection_sql(_TREE + ", w AS (SELECT parent AS u, child AS v, (CASE WHEN child IN (SELECT parent FROM edge WHERE canonical) THEN (depth + 1) * depth ELSE 1 END)::DOUBLE AS w FROM edge JOIN tree ON tree.key = child WHERE canonical)" + _PR))(_selection("uniprox"))


def _walk_sql(walks_n: int, steps: int) -> str:
    sql = EL_SQL + _DOWN.format("", "1.0::DOUBLE") + _PR + """, cum AS (SELECT u, v, sum(pr) OVER (PARTITION BY u ORDER BY v) AS hi, row_number() OVER (PARTITION BY u ORDER BY v DESC) AS back FROM pr),
part AS (SELECT u, v, lag(hi, 1, 0.0) OVER (PARTITION BY u ORDER BY v) AS low, CASE WHEN back = 1 THEN 2.0 ELSE hi END AS high FROM cum)"""
    sql += f", s0 AS (SELECT range AS walk, '' AS node FROM range({walks_n}))"
    for k in range(1, steps + 1):
        sql += f", x{k} AS (SELECT walk, node, ('0x' || substr(md5('1|' || walk::VARCHAR || '|{k}'), 1, 8))::BIGINT / 4294967296.0 AS x FROM s{k - 1}), s{k} AS (SELECT walk, v AS node FROM x{k} JOIN part ON u = node AND low <= x AND x < high)"
    union = " UNION ALL ".join(f"SELECT {k} AS step, walk, node FROM s{k}" for k in range(steps + 1))
    return sql + f", ended AS (SELECT * FROM ({union}) WHERE node NOT IN (SELECT u FROM pr))"


def _graple_walks(spark, d):
    lattice = _events(spark, d)
    return walks.walk(cut(walks.graple(lattice.patterns, lattice.edges())), "", 500, 8, seed=1)


@query(_walk_sql(500, 6) + " SELECT walk, step::INT AS step, node FROM ended")
def graple_walks(spark, d):
    """SMP-1, SMP-7, SMP-9, SMP-13: where 500 walks end, by hashed numbers."""
    return _graple_walks(spark, d)


@query(_walk_sql(500, 6) + " SELECT count(*)::BIGINT AS count, round(count(*) / sum(count(*)) OVER (), 9) AS freq, node AS name FROM ended GROUP BY node")
def sample_histogram(spark, d):
    """AGG-8, REP-5: how often each pattern is sampled."""
    return reporters.histogram(_graple_walks(spark, d).withColumnRenamed("node", "name")).select("count", F.round("freq", 9).alias("freq"), "name")


@query(_walk_sql(500, 6) + ", firsts AS (SELECT node, min(walk * 100 + step) AS nth FROM ended GROUP BY node) SELECT (row_number() OVER (ORDER BY nth) - 1)::BIGINT AS sample, node FROM firsts ORDER BY nth LIMIT 3")
def sample_unique(spark, d):
    """SMP-8, REP-10: the first three distinct acceptable samples."""
    lattice = _events(spark, d)
    return walks.collect_samples(_graple_walks(spark, d), lattice.acceptable(), 3).select(F.col("sample").cast("long").alias("sample"), "node")


@query()
def premusk_visits(spark, d):
    """SMP-3, SMP-4, SMP-5: visits of musk walks with teleports; hashed, checked by the tests."""
    lattice = _events(spark, d)
    return walks.premusk(lattice.patterns, lattice.edges(), "", 20, 6)


# Reporters --------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 7 = 0")
def reporter_skip(spark, d):
    """REP-4."""
    return reporters.skip(7, "event_id")(_t(spark, d, "events").select("event_id", "event_type"))


@query("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def reporter_unique(spark, d):
    """REP-5."""
    return reporters.unique("user_id", "event_id")(_t(spark, d, "events").select("event_id", "user_id"))


@query(EL_SQL + "SELECT count(*)::BIGINT AS count FROM pat")
def reporter_count(spark, d):
    """SNK-3, REP-1."""
    lattice = _events(spark, d)
    return reporters.chain(reporters.count)(lattice.patterns)[0]


@query(EL_SQL + "SELECT (row_number() OVER (ORDER BY key) - 1)::BIGINT AS seq, 'found ' || row_number() OVER (ORDER BY key) || ' ' || key AS line FROM pat WHERE size > 0")
def reporter_log(spark, d):
    """SNK-4."""
    from pyspark.sql import Window

    rows = _events(spark, d).patterns.where("size > 0").select(F.col("key").alias("name"), (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("seq"))
    return reporters.log_lines("found")(rows)


@query(
    EL_SQL
    + """, nodes AS (SELECT a.key, b.key AS node FROM pat a JOIN pat b ON list_has_all(a.items, b.items) WHERE a.size = 3),
num AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY node) - 1 AS i FROM nodes WHERE node <> key),
e AS (SELECT n.key, parent, child, count(*) OVER (PARTITION BY n.key, parent) AS kids FROM nodes n JOIN edge ON edge.parent = n.node JOIN nodes m ON m.key = n.key AND m.node = edge.child)
SELECT e.key, CASE WHEN c.i IS NULL THEN 'R' ELSE 'Q' END AS matrix, r.i::BIGINT AS row, coalesce(c.i, 0)::BIGINT AS col, round(1.0::DOUBLE / kids, 9) AS value, kids::BIGINT AS inverse
FROM e JOIN num r ON r.key = e.key AND r.node = e.parent LEFT JOIN num c ON c.key = e.key AND c.node = e.child"""
)
def graple_matrices(spark, d):
    """SNK-11, SMP-10: entries of the sparse matrices of the triples' sub-lattices, read back from their JSON lines."""
    lattice = _events(spark, d)
    edges = cut(lattice.edges())
    nodes = lattices.sublattice(edges, lattice.patterns.where("size = 3").select("key"))
    matrix = "struct<Rows:long,Cols:long,Entries:array<struct<Row:long,Col:long,Value:double,Inverse:long>>>"
    body = F.from_json("json", f"struct<Name:string,Q:{matrix},R:{matrix}>")
    rows = reporters.matrices(nodes, lattices.sublattice_edges(edges, nodes)).select(body.alias("m"))
    entries = [rows.select(F.col("m.Name").alias("key"), F.lit(x).alias("matrix"), F.explode(f"m.{x}.Entries").alias("e")) for x in "QR"]
    rows = entries[0].union(entries[1])
    return rows.select("key", "matrix", F.col("e.Row").alias("row"), F.col("e.Col").alias("col"), F.round("e.Value", 9).alias("value"), F.col("e.Inverse").alias("inverse"))


_SETS = "SELECT user_id::VARCHAR AS key, list_sort(list_distinct(list(event_type || ':' || floor(value / 20)::INT::VARCHAR))) AS items FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id"


def _user_sets(spark, d):
    """Users' sets of event types and value ranges; all users."""
    events = _t(spark, d, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    item = F.concat_ws(":", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string"))
    return events.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.array_sort(F.collect_set(item)).alias("labels"))


@query("WITH s AS (" + _SETS + "), p AS (SELECT a.key AS a, b.key AS b, 1 - len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))::DOUBLE AS distance FROM s a JOIN s b ON a.key < b.key) SELECT a, b, round(distance, 9) AS distance FROM p WHERE distance <= 0.2 + 1e-12")
def dbscan_pairs(spark, d):
    """REP-6, REP-8: pairs of users whose sets are at most 0.2 apart."""
    return reporters.jaccard_pairs(_user_sets(spark, d), 0.2, items="labels").select("a", "b", F.round("distance", 9).alias("distance"))


@query("WITH RECURSIVE s AS (" + _SETS + "), p AS (SELECT a.key AS a, b.key AS b FROM s a JOIN s b ON a.key <> b.key AND 1 - len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))::DOUBLE <= 0.2 + 1e-12), r AS (SELECT key, key AS other FROM s UNION SELECT r.key, p.b FROM r JOIN p ON p.a = r.other) SELECT key, min(other) AS cluster FROM r GROUP BY key")
def dbscan_clusters(spark, d):
    """REP-6: single-link clusters of users."""
    return reporters.dbscan(_user_sets(spark, d), 0.2)


# Graphs -----------------------------------------------------------------------------------------------------------------


def star_graph(spark, d) -> Graph:
    """Orders, customers, nations and regions with their links."""
    o, c, n, r = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    vertex = lambda df, p, key, label: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"))
    edge = lambda df, p, a, q, b, label: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("targ"), F.lit(label).alias("label"))
    vertices = vertex(o, "o", "o_orderkey", "o_orderpriority").union(vertex(c, "c", "c_custkey", "c_mktsegment")).union(vertex(n, "n", "n_nationkey", "n_name")).union(vertex(r, "r", "r_regionkey", "r_name"))
    edges = edge(o, "o", "o_orderkey", "c", "o_custkey", "placed_by").union(edge(c, "c", "c_custkey", "n", "c_nationkey", "in")).union(edge(n, "n", "n_nationkey", "r", "n_regionkey", "of"))
    return Graph(vertices, edges)


def event_graph(spark, d) -> Graph:
    """Events of a user, each followed by the next."""
    from pyspark.sql import Window

    events = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").cast("string").alias("src"), after.cast("string").alias("targ"), F.lit("next").alias("label")).where("targ IS NOT NULL")
    return Graph(events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label")), edges)


G_SQL = """WITH v AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS label FROM orders UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS targ, 'placed_by' AS label FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'of' FROM nation),
le AS (SELECT e.*, a.label AS sl, b.label AS tl FROM (SELECT DISTINCT * FROM e) e JOIN v a ON a.id = src JOIN v b ON b.id = targ)
"""
N_SQL = """WITH v AS (SELECT event_id, event_type AS label FROM events), e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS targ FROM events),
le AS (SELECT src, targ, a.label AS sl, b.label AS tl FROM e JOIN v a ON a.event_id = src JOIN v b ON b.event_id = targ)
"""


@query(G_SQL + "SELECT label, count(*)::BIGINT AS n FROM v GROUP BY label")
def graph_vertex_labels(spark, d):
    """SRC-9, AGG-6, LAT-2."""
    return digraphs.vertex_labels(star_graph(spark, d))


@query(G_SQL + "SELECT sl AS src_label, label, tl AS targ_label, count(*)::BIGINT AS n FROM le GROUP BY ALL")
def graph_edge_triples(spark, d):
    """SRC-9, AGG-6, FLT-6."""
    return digraphs.edge_triples(star_graph(spark, d))


@query(G_SQL + "SELECT id, (SELECT count(*) FROM e WHERE src = id)::BIGINT AS out_degree, (SELECT count(*) FROM e WHERE targ = id)::BIGINT AS in_degree FROM v")
def graph_degrees(spark, d):
    """SRC-10."""
    return digraphs.degrees(star_graph(spark, d))


@query(G_SQL + ", k AS (SELECT * FROM v WHERE regexp_matches(label, '(URGENT)|(A)|(^placed)|(^in$)') AND NOT regexp_matches(label, 'MACHINERY')) SELECT src, targ, label FROM e WHERE src IN (SELECT id FROM k) AND targ IN (SELECT id FROM k) AND regexp_matches(label, '(URGENT)|(A)|(^placed)|(^in$)')")
def graph_include_exclude(spark, d):
    """SRC-8, FN-7: edges left by label filters."""
    graph = star_graph(spark, d)
    return graphs.filter_labels(graph, ("URGENT", "A", "^placed", "^in$"), ("MACHINERY",)).edges


@query(G_SQL + "SELECT 'v' AS kind, id, label, '' AS targ FROM v UNION ALL SELECT 'e', src, label, targ FROM e")
def graph_veg_roundtrip(spark, d):
    """SRC-5, SNK-7, FN-8: the graph written as veg text and parsed again."""
    back = graphs.parse_veg(graphs.veg_lines(star_graph(spark, d)))
    v = back.vertices.select(F.lit("v").alias("kind"), "id", "label", F.lit("").alias("targ"))
    return v.union(back.edges.select(F.lit("e"), F.col("src"), "label", "targ"))


@query(G_SQL + "SELECT 'v' AS kind, id, label, '' AS targ FROM v UNION ALL SELECT 'e', src, label, targ FROM e")
def graph_int_roundtrip(spark, d):
    """SRC-6: the graph written as int text and parsed again."""
    back = graphs.parse_int(graphs.int_lines(star_graph(spark, d)))
    v = back.vertices.select(F.lit("v").alias("kind"), "id", "label", F.lit("").alias("targ"))
    return v.union(back.edges.select(F.lit("e"), F.col("src"), "label", "targ"))


@query(G_SQL + ", l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT label FROM v UNION SELECT label FROM e)), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v) SELECT a.n::VARCHAR AS src, b.n::VARCHAR AS targ, l.n::VARCHAR AS label FROM e JOIN i a ON a.id = src JOIN i b ON b.id = targ JOIN l ON l.label = e.label")
def graph_dense_ids(spark, d):
    """SNK-8: ids and labels as dense numbers."""
    return graphs.dense_ids(star_graph(spark, d)).edges


def _paths(graph: Graph) -> DataFrame:
    """Embeddings (key, ids) of paths of two edges."""
    e = graph.labelled_edges()
    a = e.select(*[F.col(c).alias(f"{c}_a") for c in e.columns])
    b = e.select(*[F.col(c).alias(f"{c}_b") for c in e.columns])
    rows = a.join(b, F.col("targ_a") == F.col("src_b")).where("src_a <> targ_b")
    return rows.select(F.concat_ws("|", "src_label_a", "label_a", "targ_label_a", "label_b", "targ_label_b").alias("key"), F.array("src_a", "targ_a", "targ_b").alias("ids"))


@query(G_SQL + "SELECT concat_ws('|', sl, label, tl) AS key, least(count(DISTINCT src), count(DISTINCT targ))::BIGINT AS support FROM le GROUP BY 1")
def mni_edge(spark, d):
    """AGG-2: minimum images of single edges."""
    e = star_graph(spark, d).labelled_edges()
    return digraphs.mni(e.select(F.concat_ws("|", "src_label", "label", "targ_label").alias("key"), F.array("src", "targ").alias("ids")))


@query(G_SQL + "SELECT concat_ws('|', a.sl, a.label, a.tl, b.label, b.tl) AS key, least(count(DISTINCT a.src), count(DISTINCT a.targ), count(DISTINCT b.targ))::BIGINT AS support FROM le a JOIN le b ON a.targ = b.src AND a.src <> b.targ GROUP BY 1")
def mni_path2(spark, d):
    """AGG-2, JOIN-4, JOIN-5: minimum images of paths of two edges."""
    return digraphs.mni(_paths(star_graph(spark, d)))


_STAR = "SELECT concat_ws('|', a.{1}l, a.{0}l, a.label, b.{0}l, b.label) AS key, least(count(DISTINCT a.{3}), count(DISTINCT a.{2}), count(DISTINCT b.{2}))::BIGINT AS support FROM le a JOIN le b ON a.{3} = b.{3} AND a.{2} <> b.{2} AND a.{0}l || '|' || a.label <= b.{0}l || '|' || b.label GROUP BY 1"


@query(G_SQL + _STAR.format("s", "t", "src", "targ"))
def mni_in_star2(spark, d):
    """AGG-2: minimum images of two edges into one vertex."""
    return digraphs.mni_of_images(digraphs.star_images(star_graph(spark, d), "in"))


def supply_graph(spark, d) -> Graph:
    """Orders and the suppliers of their lines: stars out of every order of several suppliers."""
    o, s, lines = (_t(spark, d, x) for x in ("orders", "supplier", "lineitem"))
    vertices = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    vertices = vertices.union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("supplier"), F.col("s_nationkey") % 5)))
    edges = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("targ"), F.concat(F.lit("by"), F.col("l_linenumber") % 2).alias("label"))
    return Graph(vertices, edges)


_SUPPLY_SQL = """WITH v AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS label FROM orders UNION ALL SELECT 's' || s_suppkey, 'supplier' || s_nationkey % 5 FROM supplier),
le AS (SELECT e.*, a.label AS sl, b.label AS tl FROM (SELECT DISTINCT 'o' || l_orderkey AS src, 's' || l_suppkey AS targ, 'by' || l_linenumber % 2 AS label FROM lineitem) e JOIN v a ON a.id = src JOIN v b ON b.id = targ)
"""


@query(_SUPPLY_SQL + _STAR.format("t", "s", "targ", "src"))
def mni_out_star2(spark, d):
    """AGG-2: minimum images of two edges from one vertex."""
    return digraphs.mni_of_images(digraphs.star_images(supply_graph(spark, d), "out"))


@query(G_SQL + "SELECT a.src AS o, a.targ AS c, b.targ AS n FROM le a JOIN le b ON a.targ = b.src WHERE a.sl = '1-URGENT' AND a.label = 'placed_by' AND a.tl = 'BUILDING' AND b.label = 'in' AND b.tl = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def find_embeddings_path(spark, d):
    """JOIN-4, JOIN-6, JOIN-7, SRC-12: all embeddings of a parsed pattern."""
    nation = _t(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    pattern = P.parse(P.Pattern(("1-URGENT", "BUILDING", nation), ((0, 1, "placed_by"), (1, 2, "in"))).name())
    names = {"1-URGENT": "o", "BUILDING": "c", nation: "n"}
    rows = digraphs.find_embeddings(star_graph(spark, d), pattern)
    return rows.select(*[F.col(f"v{i}").alias(names[v]) for i, v in enumerate(pattern.vertices)])


@query(G_SQL + "SELECT concat_ws('|', sl, label, tl) AS key, count(*)::BIGINT AS n FROM le GROUP BY 1")
def embeddings_count(spark, d):
    """AGG-7, JOIN-7: embeddings of single edges."""
    e = star_graph(spark, d).labelled_edges()
    return e.groupBy(F.concat_ws("|", "src_label", "label", "targ_label").alias("key")).agg(F.count("*").alias("n"))


@query(G_SQL + ", m AS (SELECT sl, label, tl, CASE WHEN count(DISTINCT src) <= count(DISTINCT targ) THEN 0 ELSE 1 END AS idx FROM le GROUP BY ALL) SELECT concat_ws('|', sl, label, tl) AS key, CASE WHEN idx = 0 THEN src ELSE targ END AS id, min(src || ' ' || targ) AS ids FROM le JOIN m USING (sl, label, tl) GROUP BY 1, 2")
def embedding_representatives(spark, d):
    """AGG-2: one embedding for each image of the position with fewest."""
    e = star_graph(spark, d).labelled_edges()
    rows = digraphs.representatives(e.select(F.concat_ws("|", "src_label", "label", "targ_label").alias("key"), F.array("src", "targ").alias("ids")))
    return rows.select("key", "id", F.array_join("ids", " ").alias("ids"))


@query(G_SQL + "SELECT DISTINCT concat_ws('|', sl, label, tl) AS key, 0 AS idx, src AS id FROM le UNION ALL SELECT DISTINCT concat_ws('|', sl, label, tl), 1, targ FROM le")
def overlap_sets(spark, d):
    """JOIN-8, OPT-4: graph vertices at each position of single-edge patterns."""
    e = star_graph(spark, d).labelled_edges()
    return digraphs.overlap(e.select(F.concat_ws("|", "src_label", "label", "targ_label").alias("key"), F.array("src", "targ").alias("ids"))).select("key", F.col("idx").cast("int").alias("idx"), "id")


def _event_support(spark, d) -> int:
    return max(2, _t(spark, d, "events").count() // 200)


def _paths_sql(most: int) -> str:
    sql = N_SQL + ", s AS (SELECT greatest(2, count(*) // 200) AS s FROM events), g1 AS (SELECT src AS first, targ AS last, sl || '>' || tl AS names, 1 AS n FROM le)"
    for k in range(2, most + 1):
        sql += f", g{k} AS (SELECT g.first, e.targ AS last, names || '>' || tl AS names, {k} AS n FROM g{k - 1} g JOIN le e ON e.src = g.last)"
    rows = " UNION ALL ".join(f"SELECT n, names, count(*) AS support FROM g{k} GROUP BY ALL" for k in range(1, most + 1))
    return sql + f", all_paths AS (SELECT 0 AS n, label AS names, count(*) AS support FROM v GROUP BY label UNION ALL {rows}), frequent AS (SELECT * FROM all_paths WHERE support >= (SELECT s FROM s))"


def _event_lattice(spark, d):
    return digraphs.mine(event_graph(spark, d), DigraphOptions(_event_support(spark, d), max_edges=3))


@query(_paths_sql(3) + " SELECT n::INT AS n_edges, (n + 1)::INT AS n_vertices, support::BIGINT AS support FROM frequent")
def digraph_lattice(spark, d):
    """MINE-1, LAT-6, LAT-12, JOIN-11, AGG-2: all frequent subgraphs of up to three edges; here they are paths."""
    return _event_lattice(spark, d).patterns.select("n_edges", "n_vertices", "support")


@query(_paths_sql(3) + ", child AS (SELECT * FROM frequent WHERE n > 0) SELECT n::INT AS n_edges, support::BIGINT AS support, CASE WHEN n = 1 THEN CASE WHEN split_part(names, '>', 1) = split_part(names, '>', 2) THEN 1 ELSE 2 END WHEN regexp_replace(names, '>[^>]*$', '') = regexp_replace(names, '^[^>]*>', '') THEN 1 ELSE 2 END::BIGINT AS n_parents FROM child")
def digraph_parents(spark, d):
    """LAT-7, LAT-8: number of distinct parents of each frequent path; one is canonical."""
    lattice = _event_lattice(spark, d)
    n = lattice.edges.groupBy(F.col("child").alias("key")).agg(F.count("*").alias("n_parents"))
    return lattice.patterns.where("n_edges > 0").join(n, "key").select("n_edges", "support", "n_parents")


def _hub_embeddings(spark, d):
    """Orders and customers of one segment: single edges that share customers."""
    e = star_graph(spark, d).labelled_edges().where("label = 'placed_by'")
    return e.select(F.concat_ws("|", "src_label", "targ_label").alias("key"), F.array("src", "targ").alias("ids"))


@query(G_SQL + "SELECT concat_ws('|', sl, tl) AS key, count(DISTINCT targ)::BIGINT AS support FROM le WHERE label = 'placed_by' GROUP BY 1")
def gis_greedy(spark, d):
    """AGG-3, OPT-9: vertex-disjoint embeddings; an order has one customer, so as many as customers."""
    return digraphs.gis(_hub_embeddings(spark, d))


@query(G_SQL + "SELECT concat_ws('|', sl, tl) AS key, count(DISTINCT targ)::BIGINT AS support FROM le WHERE label = 'placed_by' GROUP BY 1")
def fis_components(spark, d):
    """AGG-4: components of embeddings that share vertices, here one for each customer."""
    return digraphs.fis(_hub_embeddings(spark, d))


@query("SELECT '{3:4}(1-URGENT)(BUILDING)(' || n_name || ')(X)[0->1:placed_by][1->2:in][2->3:of]' AS pattern, 2 / 3.0::DOUBLE AS share, '{2:3}(1-URGENT)(BUILDING)(' || n_name || ')[0->1:placed_by][1->2:in]' AS matched FROM nation WHERE n_nationkey = 3")
def estimate_match(spark, d):
    """JOIN-9, JOIN-10: share of a pattern's edges that embed; the last edge cannot, as nothing leaves a region."""
    nation = _t(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    pattern = P.canonical(P.Pattern(("1-URGENT", "BUILDING", nation, "X"), ((0, 1, "placed_by"), (1, 2, "in"), (2, 3, "of"))))[0]
    share, part = digraphs.estimate_match(star_graph(spark, d), pattern)
    return spark.createDataFrame([(pattern.name(), share, part.name())], "pattern string, share double, matched string")


@query()
def walk_metric(spark, d):
    """FN-4, MINE-4: distances of all pairs of frequent two-edge patterns."""
    rows = cut(_event_lattice(spark, d).patterns.where("n_edges = 2").select("key"))
    if rows.count() > 2_000:
        raise ValueError("pairs of at most 2000 patterns are compared")

    @F.pandas_udf("double")
    def distance(a, b):
        known = {k: P.parse(k) for k in {*a, *b}}
        return pd.Series([round(P.walk_distance(known[x], known[y]), 9) for x, y in zip(a, b, strict=True)])

    return rows.select(F.col("key").alias("a")).join(rows.select(F.col("key").alias("b")), F.col("a") < F.col("b")).select("a", "b", distance("a", "b").alias("distance"))


# Estimates --------------------------------------------------------------------------------------------------------------


def _sampled(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(((F.col("n_nationkey") + 1) / 400.0).alias("pr"), (F.col("n_nationkey") % 3 + 1).cast("double").alias("y"))


_HT = """WITH r AS (SELECT (n_nationkey + 1) / 400.0::DOUBLE AS pr, (n_nationkey % 3 + 1)::DOUBLE AS y, n_nationkey AS i FROM nation), p AS (SELECT *, 1 - pow(1 - pr, 25) AS pi FROM r),
s AS (SELECT sum(1 / pi) AS n, sum(y / pi) AS t FROM p), m AS (SELECT t / n AS mean FROM s),
j AS (SELECT a.y AS ya, b.y AS yb, (a.pi + b.pi - (1 - pow(1 - a.pr - b.pr, 25)) - a.pi * b.pi) / (a.pi * b.pi * (a.pi + b.pi - (1 - pow(1 - a.pr - b.pr, 25)))) AS w FROM p a JOIN p b ON a.i <> b.i)
SELECT round(n, 6) AS population, round(t, 6) AS total, round(t / n, 6) AS mean,
  round((SELECT sum((1 - pi) / pow(pi, 2) * pow(y, 2)) FROM p) + (SELECT sum(w * ya * yb) FROM j), 4) AS var_total,
  round(((SELECT sum((1 - pi) / pow(pi, 2) * pow(y - mean, 2)) FROM p, m) + (SELECT sum(w * (ya - mean) * (yb - mean)) FROM j, m)) / pow(n, 2), 6) AS var_mean FROM s"""
#: The quantile of Student's t for 24 degrees of freedom and 0.95, from a table.
_HT = f"SELECT *, round(total - 1.7108820799 * sqrt(greatest(var_total, 0)), 2) AS total_low, round(total + 1.7108820799 * sqrt(greatest(var_total, 0)), 2) AS total_high, round(mean - 1.7108820799 * sqrt(greatest(var_mean, 0)), 3) AS mean_low, round(mean + 1.7108820799 * sqrt(greatest(var_mean, 0)), 3) AS mean_high FROM ({_HT})"


@query(_HT)
def ht_estimates(spark, d):
    """AGG-14, AGG-15, AGG-16: population, total and mean from inclusion chances."""
    row = estimates.horvitz_thompson(_sampled(spark, d), 25)
    return row.select(*[F.round(c, 6).alias(c) for c in ("population", "total", "mean")], F.round("var_total", 4).alias("var_total"), F.round("var_mean", 6).alias("var_mean"), *[F.round(f"total_{x}", 2).alias(f"total_{x}") for x in ("low", "high")], *[F.round(f"mean_{x}", 3).alias(f"mean_{x}") for x in ("low", "high")])


@query("WITH t AS (SELECT user_id, count(*) / (SELECT count(*) FROM events)::DOUBLE AS pr FROM events GROUP BY user_id), n AS (SELECT count(*) AS n FROM t) SELECT max(n)::BIGINT AS n, count(*) FILTER (pr > 0)::BIGINT AS non_zero, round(1.0::DOUBLE / max(n), 9) AS expected, round(sum(pr), 9) AS total, round(avg(pr), 9) AS mean, round(stddev_pop(pr), 9) AS std, round(quantile_cont(pr, 0.5), 9) AS median, round(min(pr), 9) AS least, round(max(pr), 9) AS most, round(sqrt(sum(pow(pr - 1.0::DOUBLE / n, 2))), 9) AS stderr FROM t, n")
def uniformity_stats(spark, d):
    """AGG-9, AGG-17."""
    events = _t(spark, d, "events")
    prs = events.groupBy("user_id").agg((F.count("*") / F.lit(float(events.count()))).alias("pr"))
    row = estimates.uniformity(prs)
    return row.select("n", "non_zero", *[F.round(c, 9).alias(c) for c in ("expected", "total", "mean", "std", "median", "least", "most", "stderr")])


@query("WITH c AS (SELECT event_type, count(*) AS o FROM events GROUP BY 1), t AS (SELECT sum(o) / count(*)::DOUBLE AS e, count(*) - 1 AS df FROM c) SELECT round(x, 6) AS statistic, df::BIGINT AS df, round(exp(-x / 2) * (SELECT sum(pow(x / 2, k) / factorial(k::INT)) FROM range((df // 2)::BIGINT) r(k)), 6) AS p_value FROM (SELECT sum(pow(o - e, 2) / e) AS x, max(df) AS df FROM c, t)")
def chi_square(spark, d):
    """AGG-18: event types against equal counts; the chance has a closed form as the degrees of freedom are even."""
    counts = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("observed"))
    return estimates.chi_square(counts).select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"))


# Further sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS items, sum(l_partkey)::BIGINT AS total, count(DISTINCT l_orderkey)::BIGINT AS transactions, count(DISTINCT l_orderkey)::BIGINT AS lines FROM lineitem")
def src_open_files(spark, d):
    """SRC-1, SRC-2, SET-4: a folder of gzip files of integer lines, written, opened and numbered."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"))
    lines = lines.select(F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("value"))
    with scratch(spark) as path:
        lines.write.option("compression", "gzip").text(path)
        rows = transactions.read_int_transactions(spark, path)
        return cut(rows.agg(F.count("*").alias("items"), F.sum("item").cast("long").alias("total"), F.countDistinct("tx").alias("transactions"), (F.max("tx") + 1).alias("lines")))


def _dot_files(spark, d) -> DataFrame:
    """A DOT text for each region, with its nations; regions are only named by edges."""
    n = _t(spark, d, "nation")
    node = F.concat(F.lit('n'), "n_nationkey", F.lit(' [label="'), "n_name", F.lit('", rank='), F.col("n_nationkey") % 3, F.lit("];"))
    edge = F.concat(F.lit("n"), "n_nationkey", F.lit(" -> r"), "n_regionkey", F.lit(' [label="of"];'))
    body = F.array_join(F.sort_array(F.collect_list(F.concat(node, F.lit(" "), edge))), " ")
    texts = n.groupBy("n_regionkey").agg(F.concat(F.lit("digraph g {"), body, F.lit(" subgraph s { a -> b; } }")).alias("value"))
    return texts.select(F.col("n_regionkey").cast("string").alias("path"), "value")


_DOT_SQL = "SELECT 'v' AS kind, 'n' || n_nationkey AS id, n_name AS label, (n_nationkey % 3)::VARCHAR AS targ FROM nation UNION ALL SELECT DISTINCT 'v', 'r' || n_regionkey, 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT 'e', 'n' || n_nationkey, 'of', 'r' || n_regionkey FROM nation"


@query(_DOT_SQL)
def src_dot(spark, d):
    """SRC-7: DOT texts, subgraphs skipped, vertices of edges made."""
    graph = graphs.parse_dot(_dot_files(spark, d))
    v = graph.vertices.select(F.lit("v").alias("kind"), "id", "label", F.col("attrs")["rank"].alias("targ"))
    return v.union(graph.edges.select(F.lit("e"), F.col("src"), "label", "targ"))


@query(_DOT_SQL)
def dot_to_veg(spark, d):
    """SNK-7, SRC-5: DOT texts as veg text, read again."""
    graph = graphs.parse_veg(graphs.veg_lines(graphs.parse_dot(_dot_files(spark, d))))
    v = graph.vertices.select(F.lit("v").alias("kind"), "id", "label", F.col("attrs")["rank"].alias("targ"))
    return v.union(graph.edges.select(F.lit("e"), F.col("src"), "label", "targ"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS label, n_name || '\\nfile.go:' || n_regionkey AS original FROM nation")
def clean_labels(spark, d):
    """SNK-9: labels cut at their first escaped line break; the whole one kept as an attribute."""
    n = _t(spark, d, "nation")
    label = F.concat("n_name", F.lit("\\nfile.go:"), "n_regionkey")
    graph = Graph(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), label.alias("label")), spark.createDataFrame([], "src string, targ string, label string"))
    return graphs.shorten_labels(graph).vertices.select("id", "label", F.col("attrs")["original_label"].alias("original"))


@query("SELECT event_type AS pattern, (arg_min(event_id, event_id) % 10 / 10.0)::DOUBLE AS pr, (SELECT count(*) FROM events)::BIGINT AS lines FROM events GROUP BY event_type")
def src_probabilities(spark, d):
    """SRC-13: lines of pr, pattern; the first line of a pattern counts, all lines are counted."""
    events = _t(spark, d, "events")
    lines = events.select(F.col("event_id").alias("line"), F.concat((F.col("event_id") % 10 / 10.0).cast("string"), F.lit(", "), "event_type").alias("value"))
    rows, n = graphs.read_probabilities(lines)
    return rows.select("pattern", "pr", F.lit(n).cast("long").alias("lines"))


@query(EL_SQL + "SELECT 'names.txt' AS artefact, count(*)::BIGINT AS lines, sum(length(key))::BIGINT AS chars FROM pat WHERE size > 0 UNION ALL SELECT 'patterns', count(*), sum(length(key) + CASE WHEN kids = 0 THEN 10 ELSE 0 END) FROM deg WHERE key <> '' UNION ALL SELECT 'probabilities.prs', count(*), sum(length(key) + 5) FROM pat WHERE size > 0")
def reporter_file(spark, d):
    """SNK-1: the artefacts of a run, written and read again."""
    lattice = _events(spark, d)
    some = lattice.patterns.where("size > 0")
    with scratch(spark) as path:
        reporters.file_report(path, reporters.itemset_lines(lattice.patterns, lattice.edges()).where("key <> ''"), some, probabilities=some.withColumn("pr", F.lit(0.5)))
        read = lambda n: spark.read.text(f"{path}/{n}").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars")).select(F.lit(n).alias("artefact"), "lines", "chars")
        return cut(read("names.txt").union(read("patterns")).union(read("probabilities.prs")))


@query(EL_SQL + ", n AS (SELECT key, support, (row_number() OVER (ORDER BY key) - 1)::INT AS sample FROM pat WHERE size = 4) SELECT sample, key AS name, support::BIGINT AS embeddings, (SELECT count(*) FROM n)::BIGINT AS all_samples FROM n")
def reporter_dir(spark, d):
    """SNK-2: a folder for each sample, written and read again."""
    from pyspark.sql import Window

    lattice = _events(spark, d)
    samples = cut(lattice.patterns.where("size = 4").withColumn("sample", F.row_number().over(Window.orderBy("key")) - 1).withColumn("pattern", F.col("key")))
    number = F.row_number().over(Window.partitionBy("sample").orderBy("tx")) - 1
    txs = lattice.members.join(samples.select("items", "sample"), "items").select("sample", number.alias("embedding"), F.col("tx").alias("text"))
    with scratch(spark) as path:
        reporters.dir_report(path, samples.select("sample", "key", "pattern"), txs)
        names = spark.read.text(f"{path}/pattern.name")
        names = names if "sample" in names.columns else names.withColumn("sample", F.lit(None))  # no sample, no folder
        names = names.select(F.col("sample").cast("int").alias("sample"), F.col("value").alias("name"))
        written = spark.read.schema("sample int, embedding int, text string").json(f"{path}/embedding")
        counts = written.groupBy("sample").agg(F.count("*").alias("embeddings"))
        n = spark.read.text(f"{path}/count").first()["value"]
        return cut(names.join(counts, "sample").select("sample", "name", "embeddings", F.lit(int(n)).cast("long").alias("all_samples")))


@query("SELECT 'n' || n_nationkey AS id, 'digraph embedding {' || chr(10) || '  \"n' || n_nationkey || '\" [label=\"N\\\\n' || n_nationkey || '\", \"start_line\"=\"' || n_nationkey || '\"];' || chr(10) || '  \"r' || n_regionkey || '\" [label=\"R\"];' || chr(10) || '  \"n' || n_nationkey || '\" -> \"r' || n_regionkey || '\" [label=\"of\"];' || chr(10) || '}' || chr(10) AS dot FROM nation".replace("\\\\n", "\\n"))
def embedding_dots(spark, d):
    """SNK-6, FN-5, FN-6, JOIN-13: embeddings as DOT with the attributes of their vertices."""
    graph = nation_graph(spark, d)
    rows = digraphs.find_embeddings(graph, P.Pattern(("N", "R"), ((0, 1, "of"),)))
    attrs = graph.vertices.select("id", F.when(F.col("label") == "N", F.create_map(F.lit("start_line"), F.substring("id", 2, 9))).otherwise(F.create_map().cast("map<string,string>")).alias("attrs"))
    dots = reporters.embedding_dots(rows.select(F.lit("{1:2}(N)(R)[0->1:of]").alias("key"), F.array("v0", "v1").alias("ids")), attrs)
    return dots.select(F.get("ids", 0).alias("id"), "dot")


# Further mining -----------------------------------------------------------------------------------------------------------


@query(EL_SQL + "SELECT key, support::BIGINT AS support FROM pat")
def itemset_vsigram(spark, d):
    """MINE-2: the lattice through canonical children only."""
    return modes.vsigram(modes.Lattice.of_itemsets(_events(spark, d))).select("key", "support")


def _beam_sql(queue: int) -> str:
    sql = EL_SQL + ", q1 AS (SELECT key AS start, key FROM pat WHERE size = 1)"
    for k in range(2, 6):
        sql += f", q{k} AS (SELECT start, child AS key FROM q{k - 1} q JOIN edge ON edge.parent = q.key WHERE canonical QUALIFY row_number() OVER (PARTITION BY start ORDER BY ('0x' || substr(md5('1|' || child), 1, 8))::BIGINT DESC, child) <= {queue})"
    union = " UNION ".join(f"SELECT key FROM q{k}" for k in range(1, 6))
    return sql + f" SELECT key, support::BIGINT AS support FROM pat SEMI JOIN ({union}) USING (key)"


@query(_beam_sql(2))
def itemset_qsplor(spark, d):
    """MINE-3, MINE-4: the best two of each level and start by hashed scores."""
    return modes.qsplor(modes.Lattice.of_itemsets(_events(spark, d)), 2, seed=1).select("key", "support")


@query(EL_SQL + "SELECT (SELECT count(*) FROM pat)::BIGINT + (SELECT count(*) FROM edge)::BIGINT AS n")
def index_speed(spark, d):
    """MINE-5: rows of the loaded and indexed tables."""
    lattice = _events(spark, d)
    return spark.createDataFrame([(modes.index_speed(lattice.patterns, lattice.edges()),)], "n long")


@query(EL_SQL + "SELECT key FROM pat WHERE size > 3")
def itemset_too_large(spark, d):
    """FLT-3."""
    return itemsets.too_large(_events(spark, d).patterns, ItemsetOptions(1, max_items=3)).select("key")


@query(EL_SQL + ", r AS (SELECT key FROM pat WHERE size = 2 UNION ALL SELECT key FROM pat WHERE size = 3) SELECT 'count' AS reporter, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'maximal', (SELECT count(*) FROM r WHERE key NOT IN (SELECT parent FROM edge)) UNION ALL SELECT 'skip', (SELECT count(*) // 3 FROM r)")
def reporter_chain(spark, d):
    """REP-1, REP-2, REP-4: one stream of patterns to three reporters."""
    lattice = _events(spark, d)
    edges = cut(lattice.edges())
    rows = lattice.patterns.where("size IN (2, 3)").withColumn("seq", F.monotonically_increasing_id())
    every, best, some = reporters.chain(reporters.count, reporters.only_maximal(edges), reporters.skip(3))(rows)
    n = lambda name, r: r.agg(F.count("*").alias("n")).select(F.lit(name).alias("reporter"), "n")
    return every.select(F.lit("count").alias("reporter"), F.col("count").alias("n")).union(n("maximal", best)).union(n("skip", some))


def nation_graph(spark, d) -> Graph:
    """Nations of a region, each linked to the next, and to the region: paths, stars and triangles of equal labels."""
    from pyspark.sql import Window

    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("region"), "n_nationkey")
    after = F.lead("id").over(Window.partitionBy("region").orderBy("n_nationkey"))
    vertices = n.select("id", F.lit("N").alias("label")).union(n.select("region", F.lit("R")).distinct())
    edges = n.select(F.col("id").alias("src"), F.col("region").alias("targ"), F.lit("of").alias("label"))
    return Graph(vertices, edges.union(n.select("id", after, F.lit("next")).where(F.col("id").isNotNull()).dropna()))


_NATION_SQL = """WITH o AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation), x AS (SELECT 'n' || n_nationkey AS a, 'n' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation QUALIFY b IS NOT NULL),
f AS (SELECT '{0:1}(N)' AS key, count(*) AS support FROM o UNION ALL SELECT '{0:1}(R)', count(DISTINCT r) FROM o
UNION ALL SELECT '{1:2}(N)(N)[0->1:next]', least(count(DISTINCT a), count(DISTINCT b)) FROM x
UNION ALL SELECT '{1:2}(N)(R)[0->1:of]', least(count(DISTINCT n), count(DISTINCT r)) FROM o
UNION ALL SELECT '{2:3}(N)(N)(N)[0->1:next][1->2:next]', least(count(DISTINCT x.a), count(DISTINCT x.b), count(DISTINCT y.b)) FROM x JOIN x y ON x.b = y.a
UNION ALL SELECT '{2:3}(N)(N)(R)[0->1:next][1->2:of]', least(count(DISTINCT a), count(DISTINCT b), count(DISTINCT r)) FROM x JOIN o ON n = b
UNION ALL SELECT '{2:3}(N)(N)(R)[0->1:next][0->2:of]', least(count(DISTINCT a), count(DISTINCT b), count(DISTINCT r)) FROM x JOIN o ON n = a
UNION ALL SELECT '{2:3}(N)(N)(R)[0->2:of][1->2:of]', least(count(DISTINCT p.n), count(DISTINCT q.n), count(DISTINCT p.r)) FROM o p JOIN o q ON p.r = q.r AND p.n <> q.n
UNION ALL SELECT '{3:3}(N)(N)(R)[0->1:next][0->2:of][1->2:of]', least(count(DISTINCT a), count(DISTINCT b), count(DISTINCT p.r)) FROM x JOIN o p ON p.n = a JOIN o q ON q.n = b AND q.r = p.r)
"""


def _nation_lattice(spark, d, **more):
    return digraphs.mine(nation_graph(spark, d), DigraphOptions(2, max_edges=3, **more))


@query(_NATION_SQL + "SELECT key, support::BIGINT AS support FROM f")
def digraph_names(spark, d):
    """LAT-6, LAT-12, LAT-14, LAT-15, FLT-10, FN-3: names and supports, with automorphic stars and closing edges."""
    return _nation_lattice(spark, d).patterns.where("n_edges < 3 OR n_vertices = 3").select("key", "support")


@query(_NATION_SQL + "SELECT key, support::BIGINT AS support FROM f")
def digraph_names_from_triples(spark, d):
    """JOIN-12: the same lattice, candidates told from frequent label triples."""
    return _nation_lattice(spark, d, extend_from="freq-edges").patterns.where("n_edges < 3 OR n_vertices = 3").select("key", "support")


@query(_NATION_SQL + "SELECT key, support::BIGINT AS support FROM f WHERE key LIKE '{1:%' OR key LIKE '{2:%'")
def digraph_acceptable(spark, d):
    """FLT-2, FLT-4: patterns within bounds on edges and vertices."""
    return digraphs.mine(nation_graph(spark, d), DigraphOptions(2, min_edges=1, max_edges=2, max_vertices=3)).acceptable().select("key", "support")


@query(
    "SELECT * FROM (VALUES ('{3:3}(N)(N)(R)[0->1:next][0->2:of][1->2:of]', '{2:3}(N)(N)(R)[0->1:next][0->2:of]', true), ('{3:3}(N)(N)(R)[0->1:next][0->2:of][1->2:of]', '{2:3}(N)(N)(R)[0->1:next][1->2:of]', false), ('{3:3}(N)(N)(R)[0->1:next][0->2:of][1->2:of]', '{2:3}(N)(N)(R)[0->2:of][1->2:of]', false), "
    "('{2:3}(N)(N)(R)[0->1:next][0->2:of]', '{1:2}(N)(N)[0->1:next]', true), ('{2:3}(N)(N)(R)[0->1:next][0->2:of]', '{1:2}(N)(R)[0->1:of]', false)) t(child, parent, canonical)"
)
def digraph_canonical(spark, d):
    """LAT-7, LAT-8, LAT-13: parents of the triangle and of one of these; the canonical one lacks the last edge that may go."""
    children = ("{3:3}(N)(N)(R)[0->1:next][0->2:of][1->2:of]", "{2:3}(N)(N)(R)[0->1:next][0->2:of]")
    return _nation_lattice(spark, d).edges.where(F.col("child").isin(*children)).select("child", "parent", "canonical")


@query(_NATION_SQL + "SELECT key, 8 + 4 * (length(key) - length(replace(key, '(', '')) + length(key) - length(replace(key, '[', ''))) + 8 * (length(key) - length(replace(key, '[', ''))) + (length(key) - length(replace(key, '(', ''))) + 4 * (length(key) - length(replace(key, 'next', ''))) // 4 + 2 * (length(key) - length(replace(key, ':of', ''))) // 3 AS bytes FROM f")
def pattern_bytes(spark, d):
    """SRC-14, FN-3, FLT-12: patterns as bytes and back; their length, where both are equal."""
    rows = _nation_lattice(spark, d).patterns.where("n_edges < 3 OR n_vertices = 3").select("key")

    @F.pandas_udf("long")
    def size(keys):
        return keys.map(lambda k: len(P.to_bytes(P.parse(k))) if P.from_bytes(P.to_bytes(P.parse(k))).name() == k else -1)

    return rows.select("key", size("key").alias("bytes"))


@query("SELECT * FROM (VALUES ('{2:3}(a)(b)(c)[0->1:x][1->2:y]', 1::BIGINT), ('{1:2}(a)(b)[0->1:x]', 1), ('{1:2}(b)(c)[0->1:y]', 1), ('{1:2}(a)(c)[0->1:x]', 0)) t(pattern, n)")
def pattern_as_graph(spark, d):
    """SRC-11, JOIN-9: parts found in a pattern that is taken as a graph."""
    graph = digraphs.as_graph(spark, P.parse("{2:3}(a)(b)(c)[0->1:x][1->2:y]"))
    names = ("{2:3}(a)(b)(c)[0->1:x][1->2:y]", "{1:2}(a)(b)[0->1:x]", "{1:2}(b)(c)[0->1:y]", "{1:2}(a)(c)[0->1:x]")
    return spark.createDataFrame([(n, digraphs.find_embeddings(graph, P.parse(n)).count()) for n in names], "pattern string, n long")


@query("SELECT * FROM (VALUES ('{2:3}(a)(b)(c)[0->1:x][1->2:y]'), ('0:0')) t(ancestor)")
def digraph_common_ancestor(spark, d):
    """AGG-13: the largest part that all of a few patterns hold."""
    some = [P.parse(n) for n in ("{3:4}(a)(b)(c)(d)[0->1:x][1->2:y][2->3:z]", "{3:3}(a)(b)(c)[0->1:x][0->2:z][1->2:y]", "{2:3}(a)(b)(c)[0->1:x][1->2:y]")]
    found = [digraphs.common_ancestor(spark, some), digraphs.common_ancestor(spark, [some[0], P.parse("{0:1}(e)")])]
    return spark.createDataFrame([(p.name(),) for p in found], "ancestor string")


@query("SELECT * FROM (VALUES ('o-x-o-x-o-x-o-x-o', 'x>o', 4::BIGINT, 4::BIGINT, 1::BIGINT), ('z-o-x-o-x-o-z', 'x>o', 2, 2, 1), ('z-o-x-o-x-o-z', 'z>o<x', 2, 2, 2)) t(chain, pattern, mni, gis, fis)")
def support_metrics(spark, d):
    """AGG-2, AGG-3, AGG-4, OPT-9: three metrics that differ on chains of vertices, all edges into o."""
    rows = []
    for chain, shape in (("o-x-o-x-o-x-o-x-o", "x>o"), ("z-o-x-o-x-o-z", "x>o"), ("z-o-x-o-x-o-z", "z>o<x")):
        labels = chain.split("-")
        vertices = [(f"v{i}", v) for i, v in enumerate(labels)]
        edges = [(f"v{i}", f"v{j}", "") for i, v in enumerate(labels) for j in (i - 1, i + 1) if v != "o" and 0 <= j < len(labels)]
        graph = Graph(spark.createDataFrame(vertices, "id string, label string"), spark.createDataFrame(edges, "src string, targ string, label string"))
        pattern = P.Pattern(("x", "o"), ((0, 1, ""),)) if shape == "x>o" else P.Pattern(("z", "o", "x"), ((0, 1, ""), (2, 1, "")))
        found = digraphs.find_embeddings(graph, pattern)
        found = cut(found.select(F.lit(shape).alias("key"), F.array(*found.columns).alias("ids")))
        rows.append((chain, shape, *[metric(found).first()["support"] for metric in (digraphs.mni, digraphs.gis, digraphs.fis)]))
    return spark.createDataFrame(rows, "chain string, pattern string, mni long, gis long, fis long")


@query(G_SQL + "SELECT a.src AS o, a.targ AS c, b.targ AS n FROM le a JOIN le b ON a.targ = b.src WHERE a.sl = '1-URGENT' AND a.label = 'placed_by' AND a.tl = 'BUILDING' AND b.label = 'in' AND b.tl = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def find_embeddings_degrees(spark, d):
    """FLT-9, JOIN-4: all embeddings, vertices of too small degrees left out before."""
    nation = _t(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    pattern = P.Pattern(("1-URGENT", "BUILDING", nation), ((0, 1, "placed_by"), (1, 2, "in")))
    rows = digraphs.find_embeddings(star_graph(spark, d), pattern, degree_filter=True)
    return rows.select(F.col("v0").alias("o"), F.col("v1").alias("c"), F.col("v2").alias("n"))


@query("SELECT true AS ok, count(*)::BIGINT AS n FROM nation UNION ALL SELECT false, 3 * count(*) FROM nation")
def embedding_exists(spark, d):
    """FLT-13: embeddings, and others with a wrong label, a missing edge or a repeated vertex."""
    graph = nation_graph(spark, d)
    pattern = P.Pattern(("N", "R"), ((0, 1, "of"),))
    rows = digraphs.find_embeddings(graph, pattern)
    wrong = rows.select("v1", "v0").union(rows.select("v0", F.lit("r9"))).union(rows.select("v0", "v0"))
    return digraphs.exists(graph, pattern, rows.union(wrong)).groupBy("ok").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS key, array_to_string(list_sort(list_distinct(list(n_regionkey::VARCHAR))), ' ') AS regions FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def attribute_sets(spark, d):
    """JOIN-13, REP-8: values of an attribute over the vertices of a pattern's embeddings."""
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    rows = c.select(F.col("c_mktsegment").alias("key"), F.array(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")).alias("ids"))
    vertices = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("attrs"))
    sets = digraphs.attribute_sets(rows, vertices, "region")
    return sets.select("key", F.array_join("labels", " ").alias("regions"))


# Further statistics -------------------------------------------------------------------------------------------------------


_METRICS_SQL = """WITH s AS (""" + _SETS + """), g AS (SELECT key, items, (key::BIGINT % 5)::VARCHAR AS c FROM s), k AS (SELECT count(DISTINCT c) AS n FROM g),
m AS (SELECT g.*, floor(('0x' || substr(md5('1|' || key), 1, 8))::BIGINT / 4294967296.0 * k.n)::BIGINT::VARCHAR AS r FROM g, k),
p AS (SELECT a.c AS ca, b.c AS cb, a.r AS ra, b.r AS rb, 1 - len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::DOUBLE AS d FROM m a JOIN m b ON a.key < b.key),
nc AS (SELECT c, count(*) AS n FROM m GROUP BY c), nr AS (SELECT r, count(*) AS n FROM m GROUP BY r)
SELECT (SELECT count(*) FROM m)::BIGINT AS items, (SELECT count(DISTINCT c) FROM m)::BIGINT AS clusters, round(sum(CASE WHEN ca = cb THEN d / x.n END), 6) AS intra, round(sum(CASE WHEN ca <> cb THEN d / (x.n * y.n) END), 6) AS inter, round(corr(d, (ca = cb)::INT::DOUBLE), 6) AS correlation,
  round(sum(CASE WHEN ra = rb THEN d / u.n END), 6) AS random_intra, round(sum(CASE WHEN ra <> rb THEN d / (u.n * w.n) END), 6) AS random_inter,
  round(abs(sum(CASE WHEN ca = cb THEN d / x.n END) - sum(CASE WHEN ra = rb THEN d / u.n END)), 6) AS difference_intra
FROM p JOIN nc x ON x.c = ca JOIN nc y ON y.c = cb JOIN nr u ON u.r = ra JOIN nr w ON w.r = rb"""


@query(_METRICS_SQL)
def cluster_metrics(spark, d):
    """REP-7: distances inside and across clusters, and those of a random partition."""
    sets = _user_sets(spark, d)
    clusters = sets.select("key", (F.col("key").cast("long") % 5).cast("string").alias("cluster"))
    row = reporters.cluster_metrics(clusters, sets, seed=1, items="labels")
    return row.select("items", "clusters", *[F.round(c, 6).alias(c) for c in ("intra", "inter", "correlation", "random_intra", "random_inter", "difference_intra")])


@query("SELECT arg_min(o_orderkey, struct_pack(v := o_totalprice, i := o_orderkey)) AS argmin, min(o_totalprice) AS least, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS argmax, max(o_totalprice) AS greatest, round(sum(o_totalprice), 2) AS total FROM orders")
def argmin_argmax(spark, d):
    """AGG-10."""
    row = estimates.extremes(_t(spark, d, "orders"), "o_orderkey", "o_totalprice")
    return row.withColumn("total", F.round("total", 2))


@query("SELECT round(avg(value), 9) AS mean, round(var_samp(value), 6) AS variance, -1.0::DOUBLE AS mean_of_none FROM events")
def sample_moments(spark, d):
    """AGG-9: mean and variance of a sample; the mean of none is -1."""
    events = _t(spark, d, "events")
    none = estimates.moments(events.where("false"), "value").first()["mean"]
    return estimates.moments(events, "value").select(F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"), F.lit(none).alias("mean_of_none"))


@query("WITH w AS (SELECT event_type AS key, count(*)::DOUBLE AS w FROM events GROUP BY 1), p AS (SELECT key, sum(w) OVER (ORDER BY key) AS high, sum(w) OVER (ORDER BY key) - w AS low FROM w), x AS (SELECT range AS draw, ('0x' || substr(md5('1|' || range::VARCHAR), 1, 8))::BIGINT / 4294967296.0 * (SELECT sum(w) FROM w) AS x FROM range(40)) SELECT draw::BIGINT AS draw, key FROM x JOIN p ON low <= x AND x < high")
def weighted_draws(spark, d):
    """SMP-12: draws with repeats by weight, by hashed numbers."""
    rows = _t(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("double").alias("w"))
    return walks.draw(rows, 40, 1, "key", replace=True, weight="w").select("draw", "key")


@query("SELECT n_nationkey::BIGINT AS key, (row_number() OVER (ORDER BY md5('3|' || n_nationkey::VARCHAR)[1:8], n_nationkey) - 1)::INT AS place FROM nation")
def permuted(spark, d):
    """SMP-12: a permutation by hashed numbers."""
    return walks.permutation(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key")), 3, "key")


@query()
def chain_quality(spark, d):
    """SMP-14: quality of seven chains on random layered graphs; the tests hold the uniform one to 0."""
    from .functions import theory

    found = theory.compare(3, ("urw", "fastmax", "fastmax2", "unisorb", "uniprox", "dprox", "musk"))
    return spark.createDataFrame([(m, *(float(q[k]) for k in ("stderr", "stddev", "max", "time"))) for m, q in found.items()], "chain string, stderr double, stddev double, max double, steps double")
