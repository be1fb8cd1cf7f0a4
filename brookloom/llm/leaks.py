"""Evaluation texts leaking into training text, by latent semantic retrieval.

Method: passages (windows of words) of documents and of evaluation items are TF-IDF vectors over the items' vocabulary; other words
can't be part of a leak. A randomised SVD, distributed over the documents' passages (each partition adds its part of A'(A X); only
matrices of vocabulary x RANK meet), gives a latent space. Every passage of every document is compared with every item passage by
cosine there. Where it reaches COARSE, the document passage is compared again at every place in it, in windows of the item passage's
length. A document and an item are a candidate pair if a passage reaches SAME at its best place, or SHARE of a field's passages reach
COSINE. Only candidates are checked on the whole texts: a run of at least RUN common words is a leak (``verbatim``); else a longest common subsequence of at
least LCS of the item's words, together with at least half of the answer's numbers and names, is a ``paraphrase``.

Windows are laid so that a run of 12 words holds a whole item passage (8 words, every 5th start), which lies within one document
passage (18 words, every 9th start) and equals one of its windows, at a cosine of 1.

Scale: the documents are read and tokenised once into a table of word numbers. Item passages, vocabulary and basis are bounded by the
items, whose texts are held on the driver; they are compared in blocks of ITEMS, each one pass over the word numbers. No shuffle of
documents.

Defined cases: a word is a run of letters and digits, lower-cased; null or short texts and items without 12 words in question or answer
give nothing; repeated documents and items each give their rows once by id; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.llm.texts import ALNUM, spread
from brookloom.session import staged

RUN = 12
ITEM_WINDOW, ITEM_STEP = 8, 5
BLOCK = 9  # a document passage is two neighbouring blocks of words
RANK = 96
COARSE = 0.65
COSINE = 0.75
SHARE = 0.4
SAME = 0.999
LCS = 0.6
ITEMS = 2_000
#: Words that are worked on at once: few enough for a core's cache.
CHUNK = 4_000
ROUNDS = 2


@dataclass
class Items:
    """A block of items: words by number, passages, owners."""

    ids: list[int]
    fields: list[list[np.ndarray]]
    key: list[set[int]]  # numbers and names of the answer
    vocabulary: dict[str, int]
    passages: list[np.ndarray]
    owner: np.ndarray  # the item of a passage, and the first passage of each field
    field_at: np.ndarray


def read_items(rows: list) -> Items:
    vocabulary: dict[str, int] = {}
    ids, fields, key, passages, owner, field_at = [], [], [], [], [], []
    for r in rows:
        own = []
        for text in (r["question"], r["answer"]):
            w = ALNUM.findall(text or "")
            if len(w) >= RUN:
                own.append(np.array([vocabulary.setdefault(x.lower(), len(vocabulary)) for x in w], dtype=np.int32))
        if not own:
            continue
        k = len(ids)
        ids.append(r["item_id"])
        fields.append(own)
        key.append({vocabulary.setdefault(x.lower(), len(vocabulary)) for x in ALNUM.findall(r["answer"] or "") if x[0].isdigit() or x[0].isupper()})
        for f in own:
            field_at.append(len(passages))
            for a in range(0, len(f) - ITEM_WINDOW + 1, ITEM_STEP):
                passages.append(f[a : a + ITEM_WINDOW])
                owner.append(k)
    return Items(ids, fields, key, vocabulary, passages, np.array(owner, dtype=np.int64), np.array(field_at, dtype=np.int64))


def numbered(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the words of each document by number, -1 outside the vocabulary; documents that can't hold a run are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.get
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"]):
                ids = np.fromiter((known(w, -1) for w in ALNUM.findall(text.lower())), dtype=np.int32)
                if np.count_nonzero(ids >= 0) >= RUN:
                    out.append((i, ids))
            yield pd.DataFrame(out, columns=["doc_id", "ids"])

    texts = docs.select("doc_id", "text").filter(F.char_length("text") >= 2 * RUN - 1)
    return spread(texts).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def _chunks(batches: Iterator[pd.DataFrame], own: np.ndarray, words: int = CHUNK) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, flat ids, first block of each document, document of each block). Documents are padded to whole blocks; own gives the block's
    number of a word, its last entry that of an unknown one."""
    held: list = []
    n = 0
    for b in batches:
        for i, ids in zip(b["doc_id"], b["ids"]):
            held.append((i, own[ids]))
            n += len(ids)
            if n >= words:
                yield _pack(held)
                held, n = [], 0
    if held:
        yield _pack(held)


def _pack(held: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    blocks = np.array([-(-len(ids) // BLOCK) for _, ids in held])
    flat = np.full(int(blocks.sum()) * BLOCK, -1, dtype=np.int32)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    for (_, ids), a in zip(held, first):
        flat[a * BLOCK : a * BLOCK + len(ids)] = ids
    return [i for i, _ in held], flat, first, np.repeat(np.arange(len(held)), blocks)


def _block_sums(flat: np.ndarray, M: np.ndarray) -> np.ndarray:
    """Sum of the rows of M over the known words of each block."""
    out = np.zeros((len(flat) // BLOCK, M.shape[1]), dtype=np.float32)
    for j in range(BLOCK):
        ids = flat[j::BLOCK]
        known = ids >= 0
        out[known] += M[ids[known]]
    return out


def _windows(sums: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Passages: each block with the next one of the same document."""
    out = sums.copy()
    same = owner[:-1] == owner[1:]
    out[:-1][same] += sums[1:][same]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 1e-9, n, 1)


def _scatter(flat: np.ndarray, Y: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
    """Adds A'Y without the weights to total: for each word the sum of Y over the passages that hold it."""
    held = Y.copy()
    same = owner[:-1] == owner[1:]
    held[1:][same] += Y[:-1][same]
    at = np.flatnonzero(flat >= 0)
    order = at[np.argsort(flat[at], kind="stable")]
    words = flat[order]
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    if len(starts):
        total[words[starts]] += np.add.reduceat(held[order // BLOCK], starts, axis=0)


def basis(tokens: DataFrame, items: Items, own: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Vocabulary x rank: the leading right singular directions of the TF-IDF passages of documents and items.

    Randomised subspace iteration. Item passages weigh as much as all document passages together, so the space keeps what tells
    items apart.
    """
    v = len(idf)
    rank = min(rank, v)
    X = np.linalg.qr(np.random.default_rng(5).standard_normal((v, rank)))[0]
    parts = max(1, int(tokens.sparkSession.sparkContext.defaultParallelism ** 0.5))
    for _ in range(ROUNDS):
        M = (idf[:, None] * X).astype(np.float32)

        def sketch(batches: Iterator[pd.DataFrame], M: np.ndarray = M) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(M)
            for _, flat, _, owner in _chunks(batches, own):
                _scatter(flat, _windows(_block_sums(flat, M), owner), owner, total)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % parts], "m": [total.tobytes()]})

        def add(p: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros_like(M)
            for m in p["m"]:
                total += np.frombuffer(m, dtype=np.float32).reshape(total.shape)
            return pd.DataFrame({"m": [total.tobytes()]})

        G = np.zeros((v, rank))
        for r in tokens.mapInPandas(sketch, "part int, m binary").groupBy("part").applyInPandas(add, "m binary").collect():  # at most `parts` matrices
            G += np.frombuffer(r["m"], dtype=np.float32).reshape(G.shape)
        E = np.zeros((v, rank))
        for p in items.passages:
            np.add.at(E, p, M[p].sum(axis=0))
        weight = np.linalg.norm(G) / max(np.linalg.norm(E), 1e-9) if G.any() else 1.0
        X = np.linalg.qr(idf[:, None] * (G + weight * E))[0]
    return X


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN known words."""
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    ok = np.ones(n, dtype=bool)
    x = ids.astype(np.uint64) + np.uint64(1)
    for j in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
        h ^= h >> np.uint64(29)
        ok &= ids[j : j + n] >= 0
    return np.unique(h[ok])


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


class _Checks:
    """Exact checks of a document against its candidate items."""

    def __init__(self, items: Items):
        self.items = items
        self.grams = [np.unique(np.concatenate([_grams(f) for f in fs])) for fs in items.fields]
        self.fields = [[(f.tolist(), *np.unique(f, return_counts=True)) for f in fs] for fs in items.fields]

    def verbatim(self, ids: np.ndarray, candidates: np.ndarray) -> set[int]:
        """Candidates that share a run with the document."""
        own = _grams(ids)
        out = set()
        for k in candidates.tolist() if len(own) else ():
            at = np.searchsorted(own, self.grams[k])
            if (own[np.minimum(at, len(own) - 1)] == self.grams[k]).any():
                out.add(k)
        return out

    def paraphrased(self, ids: np.ndarray, candidates: np.ndarray) -> set[int]:
        """Candidates of which enough words stand in the document in order, with half of the answer's numbers and names."""
        words = ids[ids >= 0]
        have = np.bincount(words, minlength=len(self.items.vocabulary))
        text, out = words.tolist(), set()
        for k in candidates.tolist():
            key = self.items.key[k]
            if key and 2 * sum(bool(have[w]) for w in key) < len(key):
                continue
            for f, once, times in self.fields[k]:
                if np.minimum(have[once], times).sum() >= LCS * len(f) and lcs_length(f, text) >= LCS * len(f):
                    out.add(k)
                    break
        return out


def _places(flat: np.ndarray, M: np.ndarray) -> np.ndarray:
    """The unit vector of the ITEM_WINDOW words from each place on."""
    V = np.zeros((len(flat) + ITEM_WINDOW - 1, M.shape[1]), dtype=np.float32)
    known = np.flatnonzero(flat >= 0)
    V[known] = M[flat[known]]
    out = V[: len(flat)].copy()
    for j in range(1, ITEM_WINDOW):
        out += V[j : j + len(flat)]
    return _unit(out)


def best_places(flat: np.ndarray, block_owner: np.ndarray, docs: int, Q: np.ndarray, M: np.ndarray, coarse: float) -> np.ndarray:
    """docs x item passages: the best cosine of a passage at any place of a document; 0 where no passage of the document reaches ``coarse``."""
    P = _unit(_windows(_block_sums(flat, M), block_owner))
    place = None
    best = np.zeros(docs * len(Q), dtype=np.float32)
    last = (np.searchsorted(block_owner, np.arange(docs), side="right") * BLOCK - ITEM_WINDOW)[block_owner]  # last start in the document
    for a in range(0, len(P), 1024):
        w, q = np.divmod(np.flatnonzero(P[a : a + 1024] @ Q.T >= coarse), len(Q))
        if len(w) and place is None:
            place = _places(flat, M)
        # the document passages in turn, each with the item passages that are near it
        w, first, count = np.unique(w + a, return_index=True, return_counts=True)
        for x, f, n in zip(w.tolist(), first.tolist(), count.tolist()):
            near = q[f : f + n]
            s = (place[x * BLOCK : min(x * BLOCK + 2 * BLOCK - ITEM_WINDOW, last[x]) + 1] @ Q[near].T).max(0)
            at = block_owner[x] * len(Q) + near
            best[at] = np.maximum(best[at], s)
    return best.reshape(docs, -1)


def candidates(best: np.ndarray, items: Items, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(for verbatim leaks, for paraphrases): docs x items."""
    item_at = np.searchsorted(items.owner, np.arange(len(items.ids)))
    same = np.maximum.reduceat(best, item_at, axis=1) >= SAME
    size = np.diff(np.r_[items.field_at, len(items.owner)])
    share = np.add.reduceat((best >= cosine).astype(np.float32), items.field_at, axis=1) / size
    return same, np.maximum.reduceat(share, np.searchsorted(items.owner[items.field_at], np.arange(len(items.ids))), axis=1) >= SHARE


def _leaks_of(tokens: DataFrame, items: Items, own: np.ndarray, idf: np.ndarray, kind: str, rank: int, coarse: float, cosine: float, paraphrases: bool) -> DataFrame:
    M = (idf[:, None] * basis(tokens, items, own, idf, rank)).astype(np.float32)
    Q = _unit(np.array([M[p].sum(axis=0) for p in items.passages], dtype=np.float32))
    checks = _Checks(items)
    ids_of = np.array(items.ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, flat, first, block_owner in _chunks(batches, own):
            best = best_places(flat, block_owner, len(docs), Q, M, coarse)
            same, alike = candidates(best, items, cosine)
            alike &= paraphrases
            top = np.maximum.reduceat(best, np.searchsorted(items.owner, np.arange(len(ids_of))), axis=1)
            out = []
            ends = np.r_[first[1:], len(block_owner)] * BLOCK
            for d in np.flatnonzero((same | alike).any(1)):
                ids = flat[first[d] * BLOCK : ends[d]]
                exact = checks.verbatim(ids, np.flatnonzero(same[d]))
                loose = checks.paraphrased(ids, np.array([k for k in np.flatnonzero(alike[d]) if k not in exact], dtype=np.int64))
                out += [(docs[d], ids_of[k], how, float(top[d, k])) for how, found in (("verbatim", exact), ("paraphrase", loose)) for k in sorted(found)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "cosine"])

    return tokens.mapInPandas(run, f"doc_id {kind}, item_id bigint, kind string, cosine float")


def leaks(docs: DataFrame, evals: DataFrame, rank: int = RANK, cosine: float = COSINE, coarse: float = COARSE, paraphrases: bool = True) -> DataFrame:
    """(doc_id, item_id, kind, cosine) of every leak found; the checks for paraphrases are spared if they aren't asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = evals.select("item_id", "question", "answer").filter("item_id is not null").orderBy("item_id", "question", "answer").collect()  # the held-out items
    blocks = [b for a in range(0, len(rows), ITEMS) if (b := read_items(rows[a : a + ITEMS])).ids]
    if not blocks:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, kind string, cosine float")
    vocabulary: dict[str, int] = {}
    for b in blocks:
        for w in b.vocabulary:
            vocabulary.setdefault(w, len(vocabulary))
    tokens = staged(numbered(docs, vocabulary), "numbered")
    n = tokens.count()
    df = np.zeros(len(vocabulary))
    for r in tokens.select(F.explode(F.array_distinct("ids")).alias("w")).filter("w >= 0").groupBy("w").count().collect():  # bounded by the items' vocabulary
        df[r["w"]] = r["count"]
    idf = np.log(1 + (n + 1) / (df + 1))
    out = None
    for b in blocks:
        at = np.array([vocabulary[w] for w in b.vocabulary], dtype=np.int64)
        own = np.full(len(vocabulary) + 1, -1, dtype=np.int32)
        own[at] = np.arange(len(at))
        found = _leaks_of(tokens, b, own, idf[at], kind, rank, coarse, cosine, paraphrases)
        out = found if out is None else out.unionAll(found)
    return out
