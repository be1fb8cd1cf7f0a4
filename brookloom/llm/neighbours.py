"""Most similar vectors for every vector, by robust-pruned directed graphs.

Method: vectors are unit vectors; similarity is the cosine. Centres in two levels, fitted on a bounded sample, divide the collection
into shards of about SHARD vectors; every vector is indexed in the shards of its OVERLAP nearest centres and asks in as many of the nearest
as bring the share REACH of the sample's own neighbours together. Within a shard a directed graph is built as for Vamana: vectors are inserted in batches, a greedy beam search over the graph
so far proposes neighbours, robust pruning keeps a candidate only if no kept one is nearer to it by the relaxation ALPHA, and back
edges are added; a full list is pruned again. The search that inserts a vector is also its search for neighbours, and vectors that only
ask run a beam search over the finished graph. Whatever pair a search meets counts for both its ends, so a pair is lost only if
the searches of both miss it. The k best over the shards are kept.

All steps of a batch run in lockstep as array operations. Searches start at the best of HEADS random nodes. A shard too large (a hot
centre) is dealt by hash into sub-shards whose members are queries in every sub-shard. Equal vectors are one node: copies share
their neighbours, and each copy lists the copies with the least ids first.

Scale: vectors are routed through the upper centres to some lower ones, about UPPERS sqrt(centres) comparisons each. The sample is bounded by
SAMPLE_BYTES, at SAMPLE_EACH vectors a centre; from there on the number of centres stays and shards grow.

Defined cases: null vectors, those of another length, with non-finite numbers or all zero are not usable and left out; repeated ids
count once (one of the vectors if they differ, always the same); with fewer than k other vectors all are listed; ties go to the least id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.texts import spread
from brookloom.session import staged

SHARD = 1_500
OVERLAP = 2
#: Shards asked at least; more if the sample's neighbours lie further apart.
PROBES = 3
#: Share of the sample's neighbours that must meet in some shard, and the number of sample vectors whose neighbours are looked up.
REACH = 0.96
LOOKED_UP = 400
#: Rows that ask in one task; more are dealt over tasks, each with the whole index of the shard.
ASKED = 50_000
#: The sample on which centres are fitted: at least CENTRE_SAMPLE vectors, SAMPLE_EACH for each centre, never more than SAMPLE_BYTES.
CENTRE_SAMPLE = 20_000
SAMPLE_EACH = 8
SAMPLE_BYTES = 64 << 20
#: Up to this many centres every one is compared.
FLAT = 256
#: Of more, those below so many upper centres.
UPPERS = 12
DEGREE = 20
#: Edges from which a list is pruned to DEGREE again.
SLACK = 28
BEAM = 24
ALPHA = 1.2
HEADS = 512
STARTS = 12
BATCH = 256
PER_STEP = 4
#: Edges to a node that pruning never takes away.
KNOWN = 4
#: Members of a shard from which it is split.
LARGEST = 8 * SHARD * OVERLAP

def unit_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(id, v, node): the usable vectors at length one; v is binary (dim float32), node names it. Repeated ids come repeatedly."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for i, e in zip(b["id"], b["embedding"]):
                x = np.asarray(e, dtype=np.float64)
                if x.shape == (dim,) and np.isfinite(x).all():
                    top = np.abs(x).max()
                    if top > 0:
                        x = x / top
                        ids.append(i)
                        out.append((x / np.linalg.norm(x)).astype(np.float32).tobytes())
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "v": pd.Series(out, dtype=object)})

    base = rows.select("id", "embedding").filter(F.col("id").isNotNull() & (F.size("embedding") == dim))
    return spread(base).mapInPandas(run, f"id {id_type}, v binary").withColumn("node", F.xxhash64("v"))


def _means(X: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """At most ``count`` unit centres of unit vectors by spherical k-means, the same on every run."""
    C = X[np.random.default_rng(1).permutation(len(X))[:count]].copy()
    for _ in range(rounds):
        near = (X @ C.T).argmax(1)
        sums = np.zeros_like(C)
        np.add.at(sums, near, X)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        C = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), C)
    return C


class Centres:
    """Lower centres C in the order of their upper centre; those of upper centre u are C[first[u] : first[u + 1]]."""

    def __init__(self, sample: np.ndarray, count: int):
        if count <= FLAT:
            self.upper, self.C = sample[:0], _means(sample, count)
            self.first = np.array([0, len(self.C)])
            return
        self.upper = _means(sample, math.isqrt(count))
        home = (sample @ self.upper.T).argmax(1)
        parts = [_means(X, max(1, round(count * len(X) / len(sample)))) for u in range(len(self.upper)) if len(X := sample[home == u])]
        self.upper = self.upper[np.unique(home)]
        self.C = np.concatenate(parts)
        self.first = np.cumsum([0, *map(len, parts)])

    def nearest(self, X: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lower centres, nearest first; of many centres, those below the nearest UPPERS upper centres, or more until they hold four times as many."""
        if not len(self.upper):
            return np.argsort(-(X @ self.C.T), axis=1, kind="stable")[:, :k]
        size = np.diff(self.first)
        order = np.argsort(-(X @ self.upper.T), axis=1, kind="stable")
        held = np.cumsum(size[order], axis=1)
        asked = (held - size[order] < min(4 * k, len(self.C))) | (np.arange(len(size)) < UPPERS)
        sim = np.full((len(X), len(self.C)), -2.0, dtype=np.float32)
        for u in range(len(self.upper)):
            rows = np.flatnonzero((asked & (order == u)).any(1))
            if len(rows):
                sim[rows, self.first[u] : self.first[u + 1]] = X[rows] @ self.C[self.first[u] : self.first[u + 1]].T
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        r = np.arange(len(X))[:, None]
        return top[r, np.argsort(-sim[r, top], axis=1, kind="stable")]


def sampled(nodes: DataFrame, n: int, count: int, dim: int) -> np.ndarray:
    """Vectors with the least hashes, about as many as the centres need, however the nodes are spread over tasks."""
    want = min(max(CENTRE_SAMPLE, SAMPLE_EACH * count), SAMPLE_BYTES // (4 * dim))
    share = min(1.0, want / max(n, 1))
    low = F.col("h") <= min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
    rows = nodes.select("v", F.xxhash64("v", F.lit(1)).alias("h")).filter(low).sort("h").collect()  # bounded by SAMPLE_BYTES
    return np.frombuffer(b"".join(r["v"] for r in rows), dtype=np.float32).reshape(-1, dim)


def probes_needed(sample: np.ndarray, centres: Centres, n: int, k: int, overlap: int) -> int:
    """The fewest shards to ask so that REACH of the neighbours meet. Neighbours are looked up in the sample by comparison with all of it, at the
    ranks that stand for the k nearest of n; where the sample is much smaller they lie further off, so the number errs upwards."""
    count = len(centres.C)
    ranks = min(max(1, math.ceil(k * len(sample) / max(n, 1))), len(sample) - 1)
    if ranks < 1 or count <= overlap:
        return count
    asks = np.random.default_rng(4).permutation(len(sample))[:LOOKED_UP]
    sim = sample[asks] @ sample.T
    sim[np.arange(len(asks)), asks] = -2
    near = np.argpartition(-sim, ranks - 1, axis=1)[:, :ranks].ravel()
    one, other = np.repeat(centres.nearest(sample[asks], count), ranks, axis=0), centres.nearest(sample[near], count)
    meets = np.full(len(near), count)
    for x, y in ((one, other), (other, one)):
        for a in range(overlap):  # where the shards that hold y come in the order that x asks in
            meets = np.minimum(meets, (x == y[:, a : a + 1]).argmax(1) + 1)
    return max(overlap, int(np.sort(meets)[math.ceil(REACH * len(meets)) - 1]))


# --- one shard --------------------------------------------------------------------------------------------------------------------

_FINE = float(1 << 29)


def _packed(sim: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number that sorts by similarity and holds the node; its lowest bit is left for the mark that the node was expanded."""
    return (((sim.astype(np.float64) + 2.0) * _FINE).astype(np.int64) << 32) | (ids.astype(np.int64) << 1)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return ((keys & 0xFFFFFFFF) >> 1).astype(np.int32)


def _sims(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 32) / _FINE - 2.0).astype(np.float32)


def _best(sim: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Packed: the ``count`` best of each row."""
    count = min(count, sim.shape[1])
    if count <= 0:
        return np.zeros((len(sim), 0), dtype=np.int64)
    top = np.argpartition(-sim, count - 1, axis=1)[:, :count]
    return _packed(np.take_along_axis(sim, top, 1), ids[top])


def _beam(X: np.ndarray, G: np.ndarray, Q: np.ndarray, heads: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Beam search for all queries at once: the packed beams, worst first, 0 where there is none. G: adjacency, -1 where there is no edge.

    mark is a scratch array of queries x nodes zeros, flat; it is left as zeros again.
    """
    nq, n, degree = len(Q), len(X), G.shape[1]
    beam = np.zeros((nq, BEAM), dtype=np.int64)
    start = _best(Q @ X[heads].T, heads, min(STARTS, BEAM))
    beam[:, BEAM - start.shape[1] :] = start
    beam.sort(axis=1)
    mark[(np.arange(nq)[:, None] * n + _nodes(start)).ravel()] = 1
    live, k = np.arange(nq), beam
    codes = (np.arange(nq * PER_STEP * degree) % 32_000 + 2).astype(np.int16)
    while True:
        fresh = ((k & 1) == 0) & (k > 0)
        pick = fresh & (np.cumsum(fresh[:, ::-1], axis=1)[:, ::-1] <= PER_STEP)
        busy = pick.any(1)
        if not busy.all():
            beam[live[~busy]] = k[~busy]
            live, k, pick = live[busy], k[busy], pick[busy]
        if not len(live):
            break
        at = np.flatnonzero(pick)
        q, flat = at // BEAM, k.reshape(-1)
        edges = G[_nodes(flat[at])].astype(np.int64)
        flat[at] |= 1
        place = (np.maximum(edges, 0) + (live[q] * n)[:, None]).ravel()
        sel = np.flatnonzero((mark.take(place, mode="clip") == 0) & (edges.ravel() >= 0))
        place = place[sel]
        mark[place] = codes[: len(sel)]
        sel = sel[mark.take(place, mode="clip") == codes[: len(sel)]]  # a node once in a query: the last writer stays
        if not len(sel):
            continue
        owner = q[sel // degree]
        new = np.bincount(owner, minlength=len(k))
        width = int(new.max())
        put = owner * width + np.arange(len(owner)) - np.repeat(np.cumsum(new) - new, new)
        ids = np.zeros(len(k) * width, dtype=np.int64)
        ids[put] = edges.ravel()[sel]
        sim = np.matmul(X.take(ids, axis=0, mode="clip").reshape(len(k), width, -1), Q[live][:, :, None]).ravel()
        keys = np.zeros(len(k) * width, dtype=np.int64)
        keys[put] = _packed(sim[put], ids[put])
        both = np.concatenate([k, keys.reshape(len(k), width)], axis=1)
        both.sort(axis=1)
        k = np.ascontiguousarray(both[:, -BEAM:])
    mark[: nq * n] = 0
    return beam


def _prune(X: np.ndarray, p: np.ndarray, cand: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """Robust pruning for a batch of nodes p with candidate lists (-1: none, no node twice): at most DEGREE kept ones, padded with -1.

    Candidates come by distance, those marked in ``held`` before all others: they must not be lost.
    """
    out = np.full((len(p), DEGREE), -1, dtype=np.int32)
    if not cand.shape[1]:
        return out
    V = X[np.maximum(cand, 0)]
    d = np.maximum(1.0 - np.matmul(V, X[p][:, :, None])[:, :, 0], 0)
    d = np.where(cand >= 0, d, np.inf).astype(np.float32)
    by = np.argsort(d if held is None else d - 10.0 * held, axis=1)
    r = np.arange(len(p))[:, None]
    cand, d, V = cand[r, by], d[r, by], V[r, by]
    # squared distances: the relaxation counts twice
    apart = ALPHA * ALPHA * (1.0 - np.matmul(V, V.transpose(0, 2, 1)))
    alive, row = cand >= 0, np.arange(len(p))
    for j in range(DEGREE):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        out[:, j] = np.where(some, cand[row, first], -1)
        alive &= apart[row, first] > d
        alive[row, first] = False
    return out


class Shard:
    """The graph over the nodes X, and the pairs that its searches met."""

    def __init__(self, X: np.ndarray, seed: int = 2):
        self.X, n = X, len(X)
        self.G = np.full((n, SLACK), -1, dtype=np.int32)
        self.used, self.known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.heads = order[:HEADS]
        self.mark = np.zeros(BATCH * n, dtype=np.int16)
        self.met: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0
        while done < n:
            b = order[done : done + min(BATCH, n - done)]
            Q = X[b]
            if done < HEADS:
                keys = _best(Q @ X[order[:done]].T, order[:done], BEAM)
            else:
                keys = _beam(X, self.G, Q, self.heads, self.mark)
            among = Q @ Q.T  # the batch's members don't see each other in the graph
            np.fill_diagonal(among, -2)
            keys = np.concatenate([keys, _best(among, b, min(BEAM, len(b) - 1))], axis=1)
            keys.sort(axis=1)
            self.met.append((b, keys))
            best = keys[:, -BEAM:]
            own = _prune(X, b, np.where(best > 0, _nodes(best), -1))
            self.G[b, :DEGREE] = own
            self.used[b] = (own >= 0).sum(1)
            self.known += np.bincount(own[own >= 0], minlength=n)
            done += len(b)
            if done < n:
                self._back(b, own)

    def _back(self, b: np.ndarray, own: np.ndarray) -> None:
        """Edges back to the batch b: where there is no room the list is pruned. Edges from a node's nearest targets stay, and so do
        edges to nodes that few others know, or hubs would cut them off."""
        n = len(self.X)
        src, place, dst = np.repeat(b, DEGREE), np.tile(np.arange(DEGREE), len(b)), own.ravel()
        batch = np.zeros(n, dtype=bool)
        batch[b] = True
        new = dst >= 0
        inner = np.flatnonzero(new & batch[np.maximum(dst, 0)])
        new[inner[(self.G[dst[inner]] == src[inner][:, None]).any(1)]] = False
        src, place, dst = src[new], place[new], dst[new]
        by = np.argsort(dst, kind="stable")
        src, place, dst = src[by], place[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        turn = np.arange(len(dst)) - np.repeat(first, count)
        room = self.used[to] + count <= SLACK
        easy = np.repeat(room, count)
        self.G[dst[easy], np.repeat(self.used[to], count)[easy] + turn[easy]] = src[easy]
        self.known += np.bincount(src[easy], minlength=n)
        self.used[to[room]] += count[room]
        full = np.flatnonzero(~room)
        if not len(full):
            return
        extra = np.full((len(full), int(count[full].max())), -1, dtype=np.int32)
        near = np.zeros(extra.shape, dtype=bool)
        line = np.repeat(np.cumsum(~room) - 1, count)[~easy]
        extra[line, turn[~easy]], near[line, turn[~easy]] = src[~easy], place[~easy] < KNOWN
        for a in range(0, len(full), BATCH):
            t = to[full[a : a + BATCH]]
            wide = int(count[full[a : a + BATCH]].max())
            old = self.G[t]
            held = np.concatenate([self.known[np.maximum(old, 0)] <= KNOWN, near[a : a + BATCH, :wide]], axis=1)
            kept = _prune(self.X, t, np.concatenate([old, extra[a : a + BATCH, :wide]], axis=1), held)
            self.G[t] = -1
            self.G[t, :DEGREE] = kept
            self.used[t] = (kept >= 0).sum(1)
            self.known += np.bincount(kept[kept >= 0], minlength=n) - np.bincount(old[old >= 0], minlength=n)

    def ask(self, Q: np.ndarray) -> None:
        """Beam searches of vectors that aren't indexed here; they are numbered after the nodes, in order."""
        for a in range(0, len(Q), BATCH):
            q = Q[a : a + BATCH]
            self.met.append((np.arange(len(self.X) + a, len(self.X) + a + len(q)), _beam(self.X, self.G, q, self.heads, self.mark)))

    def pairs(self, k: int, asked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, similarity): for each node and query the k best others that any search met, from either end."""
        least = np.full(len(self.X) + asked, -2.0, dtype=np.float32)  # of each one's own k best
        A, B, S = [], [], []
        for b, keys in self.met:
            top = keys[:, -k:]
            if top.shape[1] == k:
                least[b] = np.where(top[:, 0] > 0, _sims(top[:, 0]), -2)
            q, c = np.nonzero(top)
            A.append(b[q]), B.append(_nodes(top[q, c])), S.append(_sims(top[q, c]))
        for b, keys in self.met:
            q, c = np.nonzero((keys > 0) & (_sims(keys) >= least[_nodes(keys)]))
            A.append(_nodes(keys[q, c])), B.append(b[q]), S.append(_sims(keys[q, c]))
        a, b, s = np.concatenate(A), np.concatenate(B), np.concatenate(S)
        by = np.lexsort((b, -s, a))
        a, b, s = a[by], b[by], s[by]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
        a, b, s = a[new], b[new], s[new]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
        few = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
        return a[few], b[few], s[few]


# --- the collection ---------------------------------------------------------------------------------------------------------------


def node_neighbours(nodes: DataFrame, k: int, dim: int, shard: int, overlap: int, probes: int) -> DataFrame:
    """(node, other, similarity): the k nearest distinct vectors of every node (node, v)."""
    n = nodes.count()
    want = max(1, min(-(-n // shard), SAMPLE_BYTES // (4 * dim * SAMPLE_EACH)))
    sample = sampled(nodes, n, want, dim)
    if not len(sample):
        return nodes.sparkSession.createDataFrame([], "node bigint, other bigint, similarity float")
    centres = Centres(sample, want)
    count = len(centres.C)
    probes = min(max(probes_needed(sample, centres, n, k, overlap), probes, overlap), count)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                near = centres.nearest(np.frombuffer(b"".join(part["v"]), dtype=np.float32).reshape(-1, dim), probes)
                indexed = np.tile(np.arange(probes) < overlap, len(part))
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), probes), "v": np.repeat(part["v"].to_numpy(), probes), "shard": near.ravel(), "indexed": indexed})

    # the sample tells which shards are too large
    where = np.concatenate([centres.nearest(sample[a : a + 4096], probes) for a in range(0, len(sample), 4096)])
    each = n / len(sample)
    inside, asking = np.bincount(where[:, :overlap].ravel(), minlength=count) * each, np.bincount(where.ravel(), minlength=count) * each

    def by_shard(numbers: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for p in numbers.items() for x in p])[F.col("shard")], F.lit(1)) if numbers else F.lit(1)

    parts = by_shard({c: math.ceil(inside[c] / (shard * overlap)) for c in range(count) if inside[c] > LARGEST})
    slices = by_shard({c: math.ceil(asking[c] / ASKED) for c in range(count) if asking[c] > ASKED})
    placed = nodes.mapInPandas(assign, "node bigint, v binary, shard int, indexed boolean")
    member = placed.withColumn("parts", parts).withColumn("slices", slices).withColumn("home", F.expr("cast(pmod(xxhash64(node), parts) as int)")).withColumn("turn", F.expr("cast(pmod(xxhash64(node, 1), slices) as int)"))
    # a member is indexed in its own part, there in every slice, and asks in all parts of its shard, in one slice
    each_part = member.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("indexed", F.col("indexed") & (F.col("part") == F.col("home")))
    each_slice = each_part.withColumn("slice", F.explode(F.when(F.col("indexed"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("turn"))))
    asked = each_slice.select("shard", "part", "slice", "node", "v", "indexed")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node")  # the same graph whatever the order of arrival
        V = np.frombuffer(b"".join(b["v"]), dtype=np.float32).reshape(-1, dim)
        held = b["indexed"].to_numpy()
        names = np.concatenate([b["node"].to_numpy()[held], b["node"].to_numpy()[~held]])
        none = np.zeros(0, dtype=np.int64)
        if held.any():
            graph = Shard(np.ascontiguousarray(V[held]))
            graph.ask(V[~held])
            one, other, sim = graph.pairs(k, int((~held).sum()))
        else:
            one, other, sim = none, none, none
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else none
        lists = [np.split(x, first[1:]) if len(one) else [] for x in (names[other], sim)]
        return pd.DataFrame({"node": names[one[first]], "others": pd.Series(lists[0], dtype=object), "sims": pd.Series(lists[1], dtype=object)})

    found = asked.groupBy("shard", "part", "slice").applyInPandas(run, "node bigint, others array<bigint>, sims array<float>")
    # one exchange by node serves the maximum and the ranking below
    each_pair = found.repartition("node").select("node", F.explode(F.arrays_zip("others", "sims")).alias("o")).groupBy("node", F.col("o.others").alias("other")).agg(F.max("o.sims").alias("similarity"))
    best = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    return each_pair.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def neighbours(rows: DataFrame, k: int = 5, dim: int = 64, shard: int = SHARD, overlap: int = OVERLAP, probes: int = PROBES) -> DataFrame:
    """(id, other, similarity, place): the k most similar other records of every usable record of rows (id, embedding).

    Copies come first (similarity 1, least ids), then the records of the nearest other vectors.
    """
    vectors = unit_vectors(rows, dim)  # made twice: names and vectors are stored apart, each once
    members = staged(vectors.groupBy("id").agg(F.max("node").alias("node")), "members")
    nodes = staged(vectors.groupBy("node").agg(F.min("v").alias("v")), "nodes")
    near = node_neighbours(nodes, k, dim, shard, overlap, probes)
    # of each node only its k + 1 records with the least ids can be listed by anyone
    listed = Window.partitionBy("node").orderBy("id")
    heads = members.select("node", "id").withColumn("n", F.row_number().over(listed)).filter(F.col("n") <= k + 1)
    copies = F.col("m.id") != F.col("h.id")
    same = members.select("node", "id").alias("m").join(heads.alias("h"), F.col("m.node") == F.col("h.node")).filter(copies).select(F.col("m.id").alias("id"), F.col("h.id").alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    ours = members.select("node", "id")
    theirs = heads.select(F.col("node").alias("other_node"), F.col("id").alias("other"))
    across = near.withColumnRenamed("other", "other_node").join(theirs, "other_node").select("node", "other", "similarity")
    least = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    across = across.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k).drop("n")
    both = same.unionAll(ours.join(across, "node").select("id", "other", "similarity"))
    place = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return both.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
