"""Trees of rows with a parent: roots, depths, cycles, kept ancestors, active paths.

All walks jump pointers: in every round a row takes over its ancestor's ancestor, so a tree of depth d needs log2(d) joins and has
no limit on depth or rows. Rows that have arrived are not joined again; each round is a staged table.

Defined cases: a parent that is no row makes its row a root (an orphan); null ids are left out; repeated ids count once (the greatest
parent); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.session import staged, unstaged


def _edges(nodes: DataFrame) -> DataFrame:
    """(id, parent), parent null for roots and orphans."""
    once = nodes.filter("id is not null").groupBy("id").agg(F.max("parent").alias("parent"))
    known = once.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return once.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _walked(edges: DataFrame, stops: Column) -> tuple[DataFrame, bool]:
    """(id, up, dist, low, home) after the last round, and whether all rows arrived. A row that stops is its own ``up``; low is the least id on
    the way. Rows without parent stop. If some go on for more rounds than a path can have, they run in a cycle."""
    base = edges.select("id", "parent", (stops | F.col("parent").isNull()).alias("stop"))
    t = base.select(
        "id",
        F.when(F.col("stop"), F.col("id")).otherwise(F.col("parent")).alias("up"),
        F.when(F.col("stop"), 0).otherwise(1).cast("bigint").alias("dist"),
        F.when(F.col("stop"), F.col("id")).otherwise(F.least("id", "parent")).alias("low"),
        F.col("stop").alias("home"),
    )
    t = staged(t, "walk")
    # a row whose parent stops has arrived; the first join finds that out
    rounds, most = 0, max(2, t.count()).bit_length() + 1
    while True:
        rest = t.filter("not home")
        if rest.isEmpty():
            return t, True
        if rounds > most:
            return t, False
        a = t.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("dist").alias("a_dist"), F.col("low").alias("a_low"), F.col("home").alias("a_home"))
        moved = rest.join(a, rest["up"] == a["a_id"]).select("id", F.col("a_up").alias("up"), (F.col("dist") + F.col("a_dist")).alias("dist"), F.least("low", "a_low").alias("low"), F.col("a_home").alias("home"))
        nxt = staged(t.filter("home").unionByName(moved), "walk")
        unstaged(t)
        t, rounds = nxt, rounds + 1


def without_cycles(nodes: DataFrame) -> DataFrame:
    """(id, parent): the edges with every cycle opened at its least id, which becomes a root."""
    edges = staged(_edges(nodes), "edges")
    t, sound = _walked(edges, F.lit(False))
    if sound:
        return edges
    # rows that didn't arrive stand on a cycle by now, and their way has covered it
    on = t.filter("not home").select(F.col("up").alias("id")).distinct()
    cut = t.join(on, "id", "left_semi").filter("not home").select(F.col("low").alias("id"), F.lit(True).alias("cut")).distinct()
    return edges.join(cut, "id", "left").select("id", F.when(~F.coalesce("cut", F.lit(False)), F.col("parent")).alias("parent"))


def rooted(nodes: DataFrame) -> DataFrame:
    """(id, parent, root, depth) of the rows, cycles opened first."""
    edges = staged(without_cycles(nodes), "edges")
    t, _ = _walked(edges, F.lit(False))
    return edges.join(t.select("id", F.col("up").alias("root"), F.col("dist").alias("depth")), "id")


def kept_ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor): of rows (id, parent, kept) the nearest kept row on the way up, itself included; null if there is none."""
    keep = nodes.filter("id is not null").groupBy("id").agg(F.bool_or("kept").alias("kept"))
    edges = staged(without_cycles(nodes).join(keep, "id"), "edges")
    t, _ = _walked(edges, F.coalesce("kept", F.lit(False)))
    top = edges.select(F.col("id").alias("up"), "kept")
    return t.join(top, "up", "left").select("id", F.when(F.col("kept"), F.col("up")).alias("ancestor"))


def upward(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(id): the marked rows and all their ancestors. In every round marks jump twice as far as in the one before."""
    jump = staged(without_cycles(nodes).filter("parent is not null").select("id", F.col("parent").alias("up")), "jump")
    marks = staged(marked.select("id").distinct(), "marks")
    while not jump.isEmpty():
        more = staged(marks.join(jump, "id").select(F.col("up").alias("id")).unionByName(marks).distinct(), "marks")
        unstaged(marks)
        twice = jump.select(F.col("id").alias("up"), F.col("up").alias("top"))
        further = staged(jump.join(twice, "up").select("id", F.col("top").alias("up")), "jump")
        unstaged(jump)
        marks, jump = more, further
    return marks


def active_paths(nodes: DataFrame, order: str) -> DataFrame:
    """(root, id, depth): for every tree the way from its root to its newest leaf by (order, id)."""
    flat = staged(rooted(nodes).join(nodes.select("id", order), "id"), "rooted")
    inner = flat.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = flat.join(inner, "id", "left_anti")
    newest = leaves.groupBy("root").agg(F.max_by("id", F.struct(order, "id")).alias("id"))
    return flat.join(upward(flat.select("id", "parent"), newest), "id", "left_semi").select("root", "id", "depth")
