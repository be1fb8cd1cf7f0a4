"""Queries of trees, and their SQL. The tree: orders, each below the one with its key div 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.operators import trees
from brookloom.session import table


def _tree(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key > 0, F.expr("o_orderkey div 8")).alias("parent"), "o_orderdate", (key % 3 == 0).alias("kept"))


def _ring(spark, sf_dir):
    """The same tree, but its eight least keys run in a circle."""
    t = _tree(spark, sf_dir)
    return t.withColumn("parent", F.when(F.col("id") < 8, (F.col("id") + 1) % 8).otherwise(F.col("parent")))


def tree_depths(spark, sf_dir):
    return trees.rooted(_tree(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def cycle_breaks(spark, sf_dir):
    """The circle is opened at its least key; depths from there."""
    return trees.rooted(_ring(spark, sf_dir)).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


def kept_ancestor(spark, sf_dir):
    return trees.kept_ancestors(_tree(spark, sf_dir))


def parents_first(spark, sf_dir):
    """An order in which every row comes after its parent: by depth, then key; the first rows of it."""
    return trees.rooted(_tree(spark, sf_dir)).orderBy("depth", "id").limit(500).select("id", "parent", "depth")


def active_path(spark, sf_dir):
    return trees.active_paths(_tree(spark, sf_dir), "o_orderdate")


_T = "t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 8 END AS parent, o_orderdate FROM orders)"
_R = "t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey BETWEEN 1 AND 7 THEN (o_orderkey + 1) % 8 WHEN o_orderkey > 7 THEN o_orderkey // 8 END AS parent FROM orders)"
_P = "p(id, parent, depth, root) AS (SELECT id, parent, 0, id FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, t.parent, p.depth + 1, p.root FROM t JOIN p ON t.parent = p.id)"

QUERIES = {f.__name__: f for f in (tree_depths, cycle_breaks, kept_ancestor, parents_first, active_path)}
SQL = {
    "tree_depths": f"WITH RECURSIVE {_T}, {_P} SELECT depth, count(*) AS n, min(id) AS first, max(id) AS last FROM p GROUP BY depth",
    "cycle_breaks": f"WITH RECURSIVE {_R}, {_P} SELECT root, depth, count(*) AS n FROM p GROUP BY root, depth",
    "kept_ancestor": f"WITH RECURSIVE {_T}, w(id, pos) AS (SELECT id, id FROM t UNION ALL SELECT w.id, t.parent FROM w JOIN t ON t.id = w.pos WHERE w.pos % 3 <> 0 AND t.parent IN (SELECT id FROM t)), l AS (SELECT id, max(CASE WHEN pos % 3 = 0 THEN pos END) AS ancestor FROM w GROUP BY id) SELECT * FROM l",
    "parents_first": f"WITH RECURSIVE {_T}, {_P} SELECT id, CASE WHEN depth > 0 THEN parent END AS parent, depth FROM p ORDER BY depth, id LIMIT 500",
    "active_path": f"WITH RECURSIVE {_T}, {_P}, n AS (SELECT root, arg_max(p.id, (o_orderdate, p.id)) AS leaf FROM p JOIN t ON t.id = p.id WHERE p.id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) GROUP BY root), w(root, id) AS (SELECT root, leaf FROM n UNION ALL SELECT w.root, p.parent FROM w JOIN p ON p.id = w.id WHERE p.depth > 0) SELECT w.root, w.id, depth FROM w JOIN p USING (id)",
}
