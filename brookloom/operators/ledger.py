"""Hash chains and Merkle trees over ordered rows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.operators.sequences import folded

#: Leaves of a subtree that one task hashes; a power of two, so subtrees are nodes of the whole tree.
SUBTREE = 1024


def leaf_hash(text: Column) -> Column:
    """SHA-256 of a zero byte and the text."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def _h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def root_of(nodes: list[bytes]) -> bytes:
    """The root over nodes of equal height (the last may be lower): the left part is the largest power of two below n."""
    if not nodes:
        return _h()
    level = list(nodes)
    while len(level) > 1:
        paired = [_h(b"\x01", level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) // 2 * 2 :]
    return level[0]


def proof_of(leaves: list[bytes], k: int) -> list[tuple[str, bytes]]:
    """The siblings of leaf k from the bottom, each with its side."""
    out, level = [], list(leaves)
    while len(level) > 1:
        if k ^ 1 < len(level):
            out.append(("left" if k & 1 else "right", level[k ^ 1]))
        paired = [_h(b"\x01", level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) // 2 * 2 :]
        k //= 2
    return out


def verify(leaf: bytes, proof: list[tuple[str, bytes]], root: bytes) -> bool:
    for side, other in proof:
        leaf = _h(b"\x01", other, leaf) if side == "left" else _h(b"\x01", leaf, other)
    return leaf == root


def merkle_roots(rows: DataFrame, key: str, order: str, leaf: str) -> DataFrame:
    """(key, leaves, root). Subtrees of SUBTREE leaves are hashed in parallel, their roots joined for each key."""
    w = Window.partitionBy(key).orderBy(order)
    kind = rows.schema[key].dataType.simpleString()
    placed = rows.select(key, order, leaf).withColumn("pos", F.row_number().over(w) - 1).withColumn("tree", F.expr(f"pos div {SUBTREE}"))

    def subtree(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        return pd.DataFrame({key: [p[key].iloc[0]], "tree": [p["tree"].iloc[0]], "n": [len(p)], "node": [root_of([bytes.fromhex(x) for x in p[leaf]])]})

    def join(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("tree")
        return pd.DataFrame({key: [p[key].iloc[0]], "leaves": [int(p["n"].sum())], "root": [root_of(list(p["node"])).hex()]})

    nodes = placed.groupBy(key, "tree").applyInPandas(subtree, f"{key} {kind}, tree bigint, n bigint, node binary")
    return nodes.groupBy(key).applyInPandas(join, f"{key} {kind}, leaves bigint, root string")


def chained(rows: DataFrame, key: str, order: str, row_hash: str) -> DataFrame:
    """(key, order, prev, hash): a running hash for each key: each row's hash covers the one before. Sequential within a key by nature."""

    def link(prev: str, r: tuple) -> tuple:
        now = hashlib.sha256(f"{prev}\n{r[1]}".encode()).hexdigest()
        return now, (r[0], prev, now)

    return folded(rows, key, order, lambda: "0" * 64, link, [row_hash], f"{order} {rows.schema[order].dataType.simpleString()}, prev string, hash string")


def chain_findings(chain: DataFrame, rows: DataFrame, key: str, order: str, row_hash: str) -> DataFrame:
    """(key, order, finding): rows whose stored link or hash is wrong. No fold is needed, since every row stores the hash before it."""
    w = Window.partitionBy(key).orderBy(order)
    joined = chain.join(rows.select(key, order, row_hash), [key, order])
    want = F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))
    own = F.sha2(F.concat_ws("\n", "prev", row_hash), 256)
    return joined.withColumn("finding", F.when(F.col("prev") != want, "link").when(F.col("hash") != own, "hash")).filter("finding is not null").select(key, order, "finding")
