"""Ranking: BM25, cosine similarity, quantised vectors, reciprocal rank fusion, probes and merging.

Statistics always cover the whole collection; filters apply to what is ranked, after the statistics. Every ranking is totally
ordered. Scores are rounded to six digits where they leave a query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.session import staged, unstaged

K1, B = 1.2, 0.75


def term_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings: (id, term, tf), and the length of the unit."""
    toks = docs.select(F.col(id_col), words.tokens(F.col(text_col)).alias("toks")).withColumn("len", F.size("toks"))
    return toks.select(id_col, "len", F.explode("toks").alias("term")).groupBy(id_col, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n units, their total and mean length. Units without tokens count."""
    return docs.select(F.size(words.tokens(F.col(text_col))).alias("len")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.avg("len").alias("avgdl")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def doc_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, idf) of every term."""
    each = docs.select(F.explode(F.array_distinct(words.tokens(F.col(text_col)))).alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", accept: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score, matched) of the units with a query term.

    Two scans and no shuffle of units: term frequencies of the few query terms are columns, the statistics are one row.
    """
    terms = words.query_tokens(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")).limit(0)
    toks = docs.withColumn("_t", words.tokens(F.col(text_col))).select(
        *[c for c in docs.columns if c != text_col or accept is not None],
        F.size("_t").alias("_len"),
        *[_occurrences("_t", t).alias(f"_tf{i}") for i, t in enumerate(terms)],
    )
    stats = toks.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    ranked = toks if accept is None else toks.filter(accept)
    joined = ranked.crossJoin(F.broadcast(stats))  # stats is one row
    average = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)

    def part(i: int) -> Column:
        tf = F.col(f"_tf{i}")
        return F.when(tf > 0, idf(F.col("_n"), F.col(f"_df{i}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / average))).otherwise(0.0)

    score = reduce(lambda x, y: x + y, (part(i) for i in range(len(terms))))
    matched = F.array_compact(F.array(*[F.when(F.col(f"_tf{i}") > 0, F.lit(t)) for i, t in enumerate(terms)]))
    return joined.select(id_col, score.alias("score"), matched.alias("matched")).filter("score > 0")


def top(ranked: DataFrame, k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    return ranked.orderBy(F.desc(score), F.asc(id_col)).limit(k)


def prefix_terms(docs: DataFrame, prefix: str, most: int = 24, text_col: str = "text") -> DataFrame:
    """Dictionary terms that begin with the word being typed, in order."""
    t = docs.select(F.explode(words.tokens(F.col(text_col))).alias("term")).filter(F.col("term").startswith(prefix)).distinct()
    return t.orderBy("term").limit(most)


# --- a stored index ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Stored postings (id, term, tf, len), laid by ranges of terms so that a query reads the row groups of its terms, and the units' lengths."""

    postings: DataFrame
    lengths: DataFrame
    id_col: str


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Tokenises the units once; any number of searches read the result."""
    toks = staged(docs.select(F.col(id_col), words.tokens(F.col(text_col)).alias("toks")), "tokens")
    lengths = staged(toks.select(id_col, F.size("toks").alias("len")), "lengths")
    each = toks.select(id_col, F.size("toks").alias("len"), F.explode("toks").alias("term")).groupBy("term", id_col, "len").agg(F.count(F.lit(1)).alias("tf"))
    postings = staged(each.repartitionByRange("term").sortWithinPartitions("term", id_col), "postings")
    unstaged(toks)
    return Index(postings, lengths, id_col)


def changed(index: Index, gone: DataFrame, new: DataFrame | None = None, text_col: str = "text") -> Index:
    """The index without the units of ``gone`` (id) and with those of ``new``: as if it had been made of what is left."""
    ids = gone.select(F.col("id").alias(index.id_col))
    postings, lengths = (t.join(ids, index.id_col, "left_anti") for t in (index.postings, index.lengths))
    if new is not None:
        more = indexed(new, index.id_col, text_col)
        postings, lengths = postings.unionByName(more.postings), lengths.unionByName(more.lengths)
    return Index(postings, lengths, index.id_col)


def search(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) by BM25 from the postings of the query's terms."""
    terms = words.query_tokens(query)
    hits = index.postings.filter(F.col("term").isin(terms) if terms else F.lit(False))
    stats = index.lengths.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("_avg"))
    freq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))  # a row for each query term
    average = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)
    part = idf(F.col("_n"), F.col("_df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    return hits.join(F.broadcast(freq), "term").crossJoin(F.broadcast(stats)).groupBy(index.id_col).agg(F.sum(part).alias("score"))  # one row


def search_many(index: Index, questions: DataFrame, k: int, key: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, id, score, rank): the ``k`` best units for every question. Questions meet postings by term in one join, scores are summed before any
    ranking, and rankings keep ``k`` rows before they are exchanged."""
    asked = questions.select(F.col(key).alias("_q"), F.explode(F.array_distinct(words.tokens(F.col(text)))).alias("term"))
    stats = index.lengths.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("_avg"))
    freq = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    average = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)
    part = idf(F.col("_n"), F.col("_df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    weighed = asked.join(freq, "term").crossJoin(F.broadcast(stats)).join(index.postings, "term")  # stats is one row
    scored = weighed.groupBy("_q", index.id_col).agg(F.sum(part).alias("score"))
    best = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), index.id_col)  # equal units add up in any order
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumnRenamed("_q", key)


# --- vectors ----------------------------------------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def quantised(v: Column) -> Column:
    """(scale, data): symmetric 8-bit integers; rounding is half up. A zero vector has scale 0."""
    scale = F.array_max(F.transform(v, F.abs)) / 127
    data = F.transform(v, lambda x: F.when(scale > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / scale + 0.5)))).otherwise(0).cast("int"))
    return F.struct(scale.alias("scale"), data.alias("data"))


def dequantised(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x * q["scale"])


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """(id, similarity), the k most similar, above the threshold if there is one."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(id_col, cosine(doubles(F.col("embedding")), q).alias("similarity"))
    if threshold is not None:
        out = out.filter(F.col("similarity") > threshold)
    return top(out, k, id_col, "similarity")


def clamped(n: int | None, default: int, least: int, most: int) -> int:
    return max(least, min(default if n is None else n, most))


def nearest_of_model(vectors: DataFrame, query: list[float], k: int | None, dim: int, id_col: str = "vec_id", only: Column | None = None) -> DataFrame:
    """(id, similarity) among vectors of the model's dimension, 1 to 20 of them (5 unless said), if need be only where a condition holds. A query of
    another dimension is an error, vectors of another one are not compared."""
    if len(query) != dim:
        raise ValueError(f"the query has {len(query)} numbers, the model {dim}")
    rows = vectors.filter(F.size("embedding") == dim)
    return nearest(rows if only is None else rows.filter(only), query, clamped(k, 5, 1, 20), id_col)


# --- fusion -----------------------------------------------------------------------------------------------------------------------


def ranked_list(hits: DataFrame, key: str, order: list[Column], depth: int) -> DataFrame:
    """(key, rank) of the best ``depth`` hits; the limit comes before the window, so one task numbers ``depth`` rows at most."""
    best = hits.orderBy(*order).limit(depth)
    return best.select(F.col(key).alias("key"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(lists: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """(key, score, best): the sum of 1 / (k + rank) over the lists; an item repeated in a list counts once, at its better rank."""
    parts = [x.groupBy("key").agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    union = reduce(DataFrame.unionByName, parts)
    fused = union.groupBy("key").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.min(F.struct("list", "rank")).alias("seen"))
    out = fused.orderBy(F.desc("score"), "best", "seen", "key").drop("seen")
    return out if limit is None else out.limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int = 10, depth: int = 50) -> DataFrame:
    """Keyword and vector ranking of the documents, fused; vector hits without a document are dropped. Both rankings are made once and stored."""
    words_hits = staged(bm25(docs, query).select("doc_id", "score"), "keyword-hits")
    near = nearest(vectors, query_vector, depth).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = staged(near, "vector-hits")
    a = ranked_list(words_hits, "doc_id", [F.desc("score"), F.asc("doc_id")], depth)
    b = ranked_list(near, "vec_id", [F.desc("similarity"), F.asc("vec_id")], depth)
    fused = F.broadcast(rrf([a, b], limit=k))  # k rows
    scores = words_hits.join(fused.select(F.col("key").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("key"), F.col("score").alias("keyword_score"))
    return fused.join(scores, "key", "left").join(near.select(F.col("vec_id").alias("key"), "similarity"), "key", "left").select(F.col("key").alias("doc_id"), "score", "best", "keyword_score", "similarity")


def probe(docs: DataFrame, query: str) -> DataFrame:
    """One row: how well the collection answers a query: best score over the sum of idf (at most 1), coverage, hits. Two scans: the statistics,
    which also give the sum of idf, and the hits."""
    terms = words.query_tokens(query)
    if not terms:
        return docs.sparkSession.createDataFrame([(0.0, 0.0, 0, 0, 0)], "score double, coverage double, matched int, terms int, hits bigint")
    hits = staged(bm25(docs, query), "probe-hits")
    freq = docs.select(F.array_distinct(words.tokens(F.col("text"))).alias("t"))
    stats = freq.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("t", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    total = reduce(lambda x, y: x + y, [idf(F.col("n"), F.col(f"df{i}")) for i in range(len(terms))])
    best = hits.agg(F.min_by(F.struct("score", F.size("matched").alias("matched")), F.struct(-F.col("score"), "doc_id")).alias("b"), F.count(F.lit(1)).alias("hits"))
    return stats.select(total.alias("total")).crossJoin(best).select(  # two relations of one row
        F.coalesce(F.least(F.lit(1.0), F.col("b.score") / F.when(F.col("total") > 0, F.col("total"))), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("b.matched") / F.lit(len(terms)), F.lit(0.0)).alias("coverage"),
        F.coalesce("b.matched", F.lit(0)).alias("matched"),
        F.lit(len(terms)).alias("terms"),
        "hits",
    )


def probe_route(p: DataFrame, strong: float = 0.45, weak: float = 0.3, coverage: float = 0.5, min_terms: int = 2) -> DataFrame:
    need = F.least(F.lit(min_terms), F.col("terms"))
    grounded = (F.col("score") >= strong) & (F.col("coverage") >= coverage) & (F.col("matched") >= need) & (F.col("terms") > 0)
    return p.withColumn("route", F.when(grounded, "grounded").when(F.col("score") >= weak, "mixed").otherwise("free"))


def local_rank(hits: DataFrame, query: str, limit: int, title: str = "title", body: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Hits by contained query terms; in the title a term counts twice."""
    import re

    terms = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower()) if len(w) > 2 and w not in set(words.STOP_LOCAL)))
    if not terms:
        return hits.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    points = reduce(lambda x, y: x + y, [F.when(t.contains(w), 2).otherwise(0) + F.when(b.contains(w), 1).otherwise(0) for w in terms])
    score = points / F.lit(len(terms) * 3)
    ranked = hits.select(id_col, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(limit)
    return ranked.select(id_col, (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("rank"))


def merge_hits(pinned: DataFrame, workspace: DataFrame, knowledge: DataFrame, limit: int) -> DataFrame:
    """Two rankings (key, rank) share the places that pinned hits leave: each source gets at least half if it can fill them."""
    counts = (
        pinned.agg(F.count(F.lit(1)).alias("p"))
        .crossJoin(workspace.agg(F.count(F.lit(1)).alias("w")))
        .crossJoin(knowledge.agg(F.count(F.lit(1)).alias("k")))  # one row each
        .withColumn("room", F.greatest(F.lit(0), F.lit(limit) - F.col("p")))
        .withColumn("from_k", F.least(F.col("k"), F.greatest(F.col("room") - F.col("w"), F.ceil(F.col("room") / 2))))
        .withColumn("from_w", F.least(F.col("w"), F.col("room") - F.col("from_k")))
    )
    c = F.broadcast(counts)
    parts = [
        pinned.select("key", "rank", F.lit(0).alias("source")).filter(F.col("rank") <= limit),
        workspace.crossJoin(c).filter(F.col("rank") <= F.col("from_w")).select("key", "rank", F.lit(1).alias("source")),
        knowledge.crossJoin(c).filter(F.col("rank") <= F.col("from_k")).select("key", "rank", F.lit(2).alias("source")),
    ]
    return reduce(DataFrame.unionByName, parts)
