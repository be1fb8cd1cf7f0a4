"""Ranking queries over documents and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.operators import retrieval as r
from brookloom.session import table

QUERY = "Which risk may fail for the spare-parts catalogue and who keeps a copy?"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "title", "source")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _query_vector(spark, sf_dir):
    """The query vector is that of vec_id 7: one row by key."""
    return [float(x) for x in _vectors(spark, sf_dir).filter("vec_id = 7").select("embedding").first()[0]]


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def bm25_topk(spark, sf_dir):
    """The twenty best documents for a question."""
    return r.top(r.bm25(_docs(spark, sf_dir), QUERY), 20).select("doc_id", _r6("score"), F.concat_ws(" ", "matched").alias("matched"))


def bm25_indexed(spark, sf_dir):
    """The same ranking from stored postings, after documents left the index and came back."""
    docs = _docs(spark, sf_dir)
    index = r.indexed(docs)
    some = docs.filter("doc_id % 7 = 0")
    index = r.changed(index, some.select(F.col("doc_id").alias("id")), some)
    return r.top(r.search(index, QUERY), 20).select("doc_id", _r6("score"))


def bm25_filtered(spark, sf_dir):
    """Only German documents are ranked; the statistics stay those of all documents."""
    return r.top(r.bm25(_docs(spark, sf_dir), "Budget Vorhaben Vertrag Standorte", accept=F.col("lang") == "de"), 20).select("doc_id", _r6("score"))


def bm25_prefix(spark, sf_dir):
    return r.prefix_terms(_docs(spark, sf_dir), "cat")


def tf_postings(spark, sf_dir):
    return r.term_table(_docs(spark, sf_dir))


def df_idf(spark, sf_dir):
    return r.doc_frequencies(_docs(spark, sf_dir)).select("term", "df", _r6("idf"))


def corpus_stats(spark, sf_dir):
    return r.corpus_stats(_docs(spark, sf_dir)).select("n", F.col("total").cast("bigint").alias("total"), _r6("avgdl"))


def cosine_topk(spark, sf_dir):
    return r.nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10).select("vec_id", _r6("similarity"))


def model_search(spark, sf_dir):
    """The most similar vectors of one label, no more than twenty however many are asked for."""
    return r.nearest_of_model(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 500, 64, only=F.col("label") < 5).select("vec_id", _r6("similarity"))


def cosine_threshold(spark, sf_dir):
    return r.nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50, threshold=0.2).select("vec_id", _r6("similarity"))


def int8_quantize(spark, sf_dir):
    q = _vectors(spark, sf_dir).select("vec_id", r.quantised(r.doubles(F.col("embedding"))).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.data", F.lit(0), lambda s, x: s + x).cast("bigint").alias("total"), F.array_max("q.data").alias("most"), F.array_min("q.data").alias("least"))


def int8_cosine_topk(spark, sf_dir):
    q = F.array(*[F.lit(x) for x in _query_vector(spark, sf_dir)])
    v = _vectors(spark, sf_dir).select("vec_id", r.quantised(r.doubles(F.col("embedding"))).alias("q"))
    return r.top(v.select("vec_id", r.cosine(r.dequantised(F.col("q")), q).alias("similarity")), 10, "vec_id", "similarity").select("vec_id", _r6("similarity"))


def rrf_fusion(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    a = r.ranked_list(r.bm25(docs, QUERY), "doc_id", [F.desc("score"), F.asc("doc_id")], 50)
    b = r.ranked_list(r.bm25(docs, "supplier file night shift budget"), "doc_id", [F.desc("score"), F.asc("doc_id")], 50)
    return r.rrf([a, b], limit=20).select("key", _r6("score"), "best")


def hybrid_topk(spark, sf_dir):
    out = r.hybrid(_docs(spark, sf_dir), _vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir))
    return out.select("doc_id", _r6("score"), "best", _r6("keyword_score"), _r6("similarity"))


def probe(spark, sf_dir):
    return r.probe(_docs(spark, sf_dir), QUERY).select(_r6("score"), _r6("coverage"), "matched", "terms", "hits")


def probe_route(spark, sf_dir):
    return r.probe_route(r.probe(_docs(spark, sf_dir), QUERY)).select("route", "hits")


def local_rank(spark, sf_dir):
    return r.local_rank(_docs(spark, sf_dir), "budget of the risk register", 25)


def merge_hits(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    order = [F.desc("score"), F.asc("doc_id")]
    a = r.ranked_list(r.bm25(docs, QUERY), "doc_id", order, 4)
    b = r.ranked_list(r.bm25(docs, "Vertrag Budget"), "doc_id", order, 9)
    pinned = docs.filter("doc_id = 1").select(F.col("doc_id").alias("key"), F.lit(1).alias("rank"))
    return r.merge_hits(pinned, a, b, 6)


def _list(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_STOP = _list([*words.STOP_EN, *words.STOP_DE])
_TOK = f"list_filter(regexp_extract_all(replace(lower(replace(text, 'İ', 'i')), 'ı', 'i'), '{words.TOKEN}'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
_T = f"t AS (SELECT doc_id, lang, {_TOK} AS toks FROM documents)"


def _bm25(name, query, where="true"):
    """CTE of (doc_id, score, matched) for a query."""
    terms = words.query_tokens(query)
    q = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{name}q(pos, term) AS (VALUES {q}),
{name}s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
{name}p AS (SELECT doc_id, lang, len(toks) AS l, pos, term, len(list_filter(toks, lambda w: w = term)) AS tf FROM t, {name}q),
{name}d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM {name}p GROUP BY term),
{name} AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS score, string_agg(term, ' ' ORDER BY pos) AS matched, count(*) AS m
  FROM {name}p JOIN {name}d USING (term), {name}s WHERE tf > 0 AND {where} GROUP BY doc_id)"""


_QV = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"
_COS = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"
_RANK = "SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {} ORDER BY rank LIMIT {}"
_QUANT = """z AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings),
i AS (SELECT vec_id, scale, list_transform(e, lambda x: greatest(-127, least(127, floor(x / scale + 0.5)))::INTEGER) AS data FROM z)"""
_PROBE = f"""WITH {_T}, {_bm25("h", QUERY)}, x AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS total, count(*) AS terms FROM hd, hs),
b AS (SELECT score AS best, m FROM h ORDER BY score DESC, doc_id LIMIT 1), c AS (SELECT count(*) AS hits FROM h),
p AS (SELECT least(1.0, best / total) AS score, m / terms AS coverage, m::INTEGER AS matched, terms::INTEGER AS terms, hits FROM x, b, c)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_indexed, bm25_filtered, bm25_prefix, tf_postings, df_idf, corpus_stats, cosine_topk, model_search, cosine_threshold, int8_quantize, int8_cosine_topk, rrf_fusion, hybrid_topk, probe, probe_route, local_rank, merge_hits)}
SQL = {
    "bm25_topk": f"WITH {_T}, {_bm25('h', QUERY)} SELECT doc_id, round(score, 6) AS score, matched FROM h ORDER BY h.score DESC, doc_id LIMIT 20",
    "bm25_indexed": f"WITH {_T}, {_bm25('h', QUERY)} SELECT doc_id, round(score, 6) AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 20",
    "bm25_filtered": f"WITH {_T}, {_bm25('h', 'Budget Vorhaben Vertrag Standorte', chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'de' + chr(39))} SELECT doc_id, round(score, 6) AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 20",
    "bm25_prefix": f"WITH {_T} SELECT DISTINCT term FROM (SELECT unnest(toks) AS term FROM t) WHERE starts_with(term, 'cat') ORDER BY term LIMIT 24",
    "tf_postings": f"WITH {_T} SELECT doc_id, l AS len, term, count(*) AS tf FROM (SELECT doc_id, len(toks)::INTEGER AS l, unnest(toks) AS term FROM t) GROUP BY ALL",
    "df_idf": f"WITH {_T}, n AS (SELECT count(*) AS n FROM t), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n",
    "corpus_stats": f"WITH {_T} SELECT count(*) AS n, sum(len(toks))::BIGINT AS total, round(avg(len(toks)), 6) AS avgdl FROM t",
    "cosine_topk": f"WITH {_QV} SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings, qv ORDER BY {_COS} DESC, vec_id LIMIT 10",
    "model_search": f"WITH {_QV} SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings, qv WHERE label < 5 ORDER BY {_COS} DESC, vec_id LIMIT 20",
    "cosine_threshold": f"WITH {_QV} SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings, qv WHERE {_COS} > 0.2 ORDER BY {_COS} DESC, vec_id LIMIT 50",
    "int8_quantize": f"WITH {_QUANT} SELECT vec_id, round(scale, 9) AS scale, list_sum(data)::BIGINT AS total, list_max(data) AS most, list_min(data) AS least FROM i",
    "int8_cosine_topk": f"WITH {_QV}, {_QUANT}, e AS (SELECT vec_id, list_transform(data, lambda x: x * scale) AS embedding FROM i) SELECT vec_id, round({_COS}, 6) AS similarity FROM e, qv ORDER BY {_COS} DESC, vec_id LIMIT 10",
    "rrf_fusion": f"""WITH {_T}, {_bm25("ha", QUERY)}, {_bm25("hb", "supplier file night shift budget")}, ra AS ({_RANK.format("ha", 50)}), rb AS ({_RANK.format("hb", 50)}),
u AS (SELECT *, 0 AS list FROM ra UNION ALL SELECT *, 1 FROM rb)
SELECT key, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank)::INTEGER AS best FROM u GROUP BY key ORDER BY sum(1.0 / (60 + rank)) DESC, min(rank), min(list * 1000 + rank), key LIMIT 20""",
    "hybrid_topk": f"""WITH {_T}, {_bm25("ha", QUERY)}, {_QV}, near AS (SELECT * FROM (SELECT vec_id, {_COS} AS similarity FROM embeddings, qv ORDER BY similarity DESC, vec_id LIMIT 50) WHERE vec_id IN (SELECT doc_id FROM documents)),
ra AS ({_RANK.format("ha", 50)}), rb AS (SELECT vec_id AS key, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM near),
u AS (SELECT *, 0 AS list FROM ra UNION ALL SELECT *, 1 FROM rb),
f AS (SELECT key, sum(1.0 / (60 + rank)) AS score, min(rank)::INTEGER AS best FROM u GROUP BY key ORDER BY sum(1.0 / (60 + rank)) DESC, min(rank), min(list * 1000 + rank), key LIMIT 10)
SELECT key AS doc_id, round(f.score, 6) AS score, best, round(ha.score, 6) AS keyword_score, round(similarity, 6) AS similarity FROM f LEFT JOIN ha ON ha.doc_id = key LEFT JOIN near ON vec_id = key""",
    "probe": _PROBE + " SELECT round(score, 6) AS score, round(coverage, 6) AS coverage, matched, terms, hits FROM p",
    "probe_route": _PROBE + " SELECT CASE WHEN score >= 0.45 AND coverage >= 0.5 AND matched >= least(2, terms) AND terms > 0 THEN 'grounded' WHEN score >= 0.3 THEN 'mixed' ELSE 'free' END AS route, hits FROM p",
    "local_rank": """WITH q(term) AS (VALUES ('budget'), ('risk'), ('register')), s AS (
  SELECT doc_id, sum(CASE WHEN contains(lower(coalesce(title, '')), term) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), term) THEN 1 ELSE 0 END) / 9 AS score FROM documents, q GROUP BY doc_id)
SELECT doc_id, floor(score * 1000 + 0.5) / 1000 AS rank FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25""",
    "merge_hits": f"""WITH {_T}, {_bm25("ha", QUERY)}, {_bm25("hb", "Vertrag Budget")}, ra AS ({_RANK.format("ha", 4)}), rb AS ({_RANK.format("hb", 9)}),
c AS (SELECT greatest(0, 6 - (SELECT count(*) FROM documents WHERE doc_id = 1)) AS room, (SELECT count(*) FROM ra) AS w, (SELECT count(*) FROM rb) AS k),
m AS (SELECT *, least(k, greatest(room - w, ceil(room / 2))) AS fk FROM c)
SELECT doc_id AS key, 1 AS rank, 0 AS source FROM documents WHERE doc_id = 1
UNION ALL SELECT key, rank::INTEGER, 1 FROM ra, m WHERE rank <= least(w, room - fk) UNION ALL SELECT key, rank::INTEGER, 2 FROM rb, m WHERE rank <= fk""",
}
