"""Text, chunk, graph, ledger and tree queries, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookloom.functions import cuts, words
from brookloom.operators import ledger
from brookloom.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def fold_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(words.fold(F.col("text"))).alias("folded"))


def name_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("title is not null").select("doc_id", words.name_key(F.col("title")).alias("name_key"))


def fence_safe(spark, sf_dir):
    t = F.concat(F.lit("<<"), "source", F.lit(">>> <"), "text")
    return _docs(spark, sf_dir).filter("source is not null").select("doc_id", words.fence_safe(t).alias("text"))


def citation_labels(spark, sf_dir):
    """Labels [Doc: name, Chunk: n] in documents, with name and number."""
    label = F.explode(F.regexp_extract_all("text", F.lit(r"\[Doc: [^\],\n]+, Chunk: \d+\]"), F.lit(0)))
    rows = _docs(spark, sf_dir).select("doc_id", label.alias("label"))
    return rows.select("doc_id", F.regexp_extract("label", r"\[Doc: ([^\],\n]+), Chunk: (\d+)\]", 1).alias("name"), F.regexp_extract("label", r"\[Doc: ([^\],\n]+), Chunk: (\d+)\]", 2).cast("int").alias("chunk")).groupBy("name", "chunk").agg(F.count(F.lit(1)).alias("n"))


ONLY = {
    "en": ["the", "and", "for", "with", "which", "was", "before", "any", "keeps", "because"],
    "de": ["der", "die", "und", "für", "mit", "wird", "ohne", "bei", "ist", "weil"],
    "fr": ["le", "les", "du", "est", "pour", "avec", "avant", "aucun", "une", "car"],
    "es": ["el", "los", "las", "del", "para", "con", "porque", "debe", "según", "fue"],
}


def lang_guess(spark, sf_dir):
    """The guessed language of documents beside the stated one."""
    d = _docs(spark, sf_dir).filter("text is not null")
    g = words.guess_language(F.col("text"), ONLY, {"de": "ß", "es": "ñ¿"})
    return d.groupBy("lang", g.alias("guess")).agg(F.count(F.lit(1)).alias("n"))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "phone": r"\+\d{1,3}[ /-]?\d{2,5}[ /-]?\d{4,10}",
}


def pii_flags(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", *[F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(k) for k, p in PII.items()])


def amounts(spark, sf_dir):
    """Amounts of money in documents: number as written and currency."""
    rx = r"\d[\d.,]*\d (?:EUR|CHF)"
    a = F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", a.alias("amount")).groupBy(F.right("amount", F.lit(3)).alias("currency")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.max(F.length("amount")).alias("longest"))


def chunks(spark, sf_dir):
    """Windows of 500 characters that share 50, with their text's hash."""
    return cuts.exploded(_docs(spark, sf_dir), "doc_id", "text", cuts.windows, "idx int, start int, end int")


def sentences(spark, sf_dir):
    return cuts.exploded(_docs(spark, sf_dir), "doc_id", "text", cuts.sentences, "start int, end int")


def markdown_sections(spark, sf_dir):
    d = table(spark, sf_dir, "knowledge_documents").dropDuplicates(["id"])
    return cuts.exploded(d, "id", "raw_content", partial(cuts.markdown_sections, most=1500), "idx int, heading string, content string, words int")


def json_scalars(spark, sf_dir):
    """Paths and values of message metadata."""
    m = table(spark, sf_dir, "chat_history").dropDuplicates(["id"])
    return cuts.exploded(m, "id", "metadata", cuts.json_paths, "path string, value string").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


def csv_statements(spark, sf_dir):
    """Customers as small CSV texts, read again as statements."""
    body = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    text = table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("key,name,segment\n"), body).alias("text"))
    return cuts.exploded(text, "c_nationkey", "text", cuts.csv_statements, "statement string")


def csv_wide_to_long(spark, sf_dir):
    """A wide table as samples: one row for each column that has a value."""
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "series", "value").groupBy("series").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- graph ------------------------------------------------------------------------------------------------------------------------

NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


def _mentions(spark, sf_dir):
    """(doc_id, sentence, name): names of two words or more, each once in a sentence."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0))).alias("sentence", "s"))
    return s.select("doc_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(NAME), F.lit(0)))).alias("name"))


def phrase_counts(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("sentences"), F.count_distinct("doc_id").alias("documents"))


def _pairs(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    a, b = m.select("doc_id", "sentence", F.col("name").alias("a")), m.select("doc_id", "sentence", F.col("name").alias("b"))
    return a.join(b, ["doc_id", "sentence"]).filter("a < b")


def cooccurrence_pairs(spark, sf_dir):
    """Names that stand in one sentence, with their count and the first document."""
    return _pairs(spark, sf_dir).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def entity_degree(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("a", "b").distinct()
    return p.select(F.col("a").alias("name")).unionAll(p.select(F.col("b").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def weighted_degree(spark, sf_dir):
    """Names by the weight of their links: 2 where they stand in one sentence of several documents, 1 where in one only."""
    p = _pairs(spark, sf_dir).groupBy("a", "b").agg(F.when(F.count_distinct("doc_id") > 1, 2).otherwise(1).alias("w"))
    return p.select(F.col("a").alias("name"), "w").unionAll(p.select(F.col("b").alias("name"), "w")).groupBy("name").agg(F.sum("w").alias("degree"))


def entity_types(spark, sf_dir):
    """Entities by key with their type: what says more than "other" wins, a document of one's own over all, then the first seen."""
    m = _mentions(spark, sf_dir).withColumn("key", words.name_key(F.col("name")))
    kind = F.when(F.col("name").rlike("(?:AG|GmbH|Ltd|Labs)$"), "company").when(F.col("name").rlike("^(?:Project|Projekt|Projet|Proyecto|Programme|Programa|Pilot|Vorhaben) "), "project").otherwise("other")
    order = F.struct((F.col("kind") == "other").alias("o"), (F.col("doc_id") % 10 != 0).alias("m"), "doc_id", "sentence", "name")
    return m.withColumn("kind", kind).groupBy("key").agg(F.min_by("kind", order).alias("kind"), F.min_by("name", F.struct("doc_id", "sentence", "name")).alias("name"))


def entity_merge(spark, sf_dir):
    """Names that share a key are one entity: its first form, all forms and the documents."""
    m = _mentions(spark, sf_dir).withColumn("key", words.name_key(F.col("name")))
    return m.groupBy("key").agg(F.min_by("name", F.struct("doc_id", "sentence", "name")).alias("name"), F.count_distinct("name").alias("forms"), F.count_distinct("doc_id").alias("documents"))


# --- ledger -----------------------------------------------------------------------------------------------------------------------


def merkle_leaves(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ledger.leaf_hash(F.coalesce("text", F.lit(""))).alias("leaf"))


def merkle_root(spark, sf_dir):
    """The root over the documents of each source, in the order of doc_id."""
    rows = _docs(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", ledger.leaf_hash(F.coalesce("text", F.lit(""))).alias("leaf"))
    return ledger.merkle_roots(rows, "source", "doc_id", "leaf")


def _event_rows(spark, sf_dir):
    return table(spark, sf_dir, "event_log").select("source", "seq", F.sha2(F.concat_ws("\n", F.col("seq").cast("string"), "source", "dedupe", "type", F.coalesce("body", F.lit(""))), 256).alias("row"))


def hash_chain(spark, sf_dir):
    """A running hash over the events of each source: its length and head."""
    c = ledger.chained(_event_rows(spark, sf_dir), "source", "seq", "row")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "seq").alias("head"))


def chain_findings(spark, sf_dir):
    """Checking a chain in which the hash of every hundredth event was replaced."""
    rows = _event_rows(spark, sf_dir)
    c = ledger.chained(rows, "source", "seq", "row").withColumn("hash", F.when(F.col("seq") % 100 == 0, F.lit("f" * 64)).otherwise(F.col("hash")))
    return ledger.chain_findings(c, rows, "source", "seq", "row").groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


# --- trees ------------------------------------------------------------------------------------------------------------------------

def tree_siblings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 0, F.expr("o_orderkey div 8")).alias("parent"), "o_orderdate")
    w = Window.partitionBy("parent").orderBy("o_orderdate", "id")
    return o.select("id", "parent", F.row_number().over(w).alias("place"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


def tree_leaves(spark, sf_dir):
    """Orders without children, and newest child of those with some."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 0, F.expr("o_orderkey div 8")).alias("parent"), "o_orderdate")
    kids = o.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.max_by("id", F.struct("o_orderdate", "id")).alias("newest"), F.count(F.lit(1)).alias("children"))
    return o.select("id").join(kids, "id", "left").select("id", "newest", F.coalesce("children", F.lit(0)).alias("children"))


_FOLD = "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(lower(replace(regexp_replace(replace({}, chr(173), ''), '(\\p{{L}})-\\n(\\p{{L}})', '\\1\\2', 'g'), 'İ', 'i')), 'ı', 'i'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[‘’‚‛′]', '''', 'g'), '[“”„‟«»″]', '\"', 'g'), '[‐‑‒–—―]', '-', 'g')"
_KEY = "trim(regexp_replace(" + _FOLD + ", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_MENTIONS = f"""s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]+') AS x FROM documents)),
m AS (SELECT doc_id, sentence, unnest(list_distinct(regexp_extract_all(s, '{NAME}'))) AS name FROM s)"""


def _count(lang: str, letters: str | None) -> str:
    ws = ", ".join(f"'{w}'" for w in ONLY[lang])
    extra = f" + CASE WHEN regexp_matches(lower(text), '[{letters}]') THEN 1 ELSE 0 END" if letters else ""
    return f"(len(list_filter(w, lambda x: list_contains([{ws}], x))){extra})"


_GUESS = f"""WITH w AS (SELECT lang, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT lang, list_reverse_sort([{{'n': {_count("en", None)}, 'l': 'en'}}, {{'n': {_count("de", "ß")}, 'l': 'de'}}, {{'n': {_count("fr", None)}, 'l': 'fr'}}, {{'n': {_count("es", "ñ¿")}, 'l': 'es'}}]) AS r FROM w)
SELECT lang, CASE WHEN (r[1].n > 0 AND r[2].n = 0) OR (r[1].n >= 2 AND r[1].n >= 2 * r[2].n) THEN r[1].l END AS guess, count(*) AS n FROM c GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (fold_text, name_key, fence_safe, citation_labels, lang_guess, pii_flags, amounts, chunks, sentences, markdown_sections, json_scalars, csv_statements, csv_wide_to_long, phrase_counts, cooccurrence_pairs, entity_degree, weighted_degree, entity_types, entity_merge, merkle_leaves, merkle_root, hash_chain, chain_findings, tree_siblings, tree_leaves)}
SQL = {
    "fold_text": f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents",
    "name_key": f"SELECT doc_id, {_KEY.format('title')} AS name_key FROM documents WHERE title IS NOT NULL",
    "fence_safe": "SELECT doc_id, regexp_replace(regexp_replace('<<' || source || '>>> <' || text, '<{2,}', '<', 'g'), '>{2,}', '>', 'g') AS text FROM documents WHERE source IS NOT NULL",
    "citation_labels": "WITH l AS (SELECT unnest(regexp_extract_all(text, '\\[Doc: [^\\],\\n]+, Chunk: \\d+\\]')) AS label FROM documents) SELECT regexp_extract(label, '\\[Doc: ([^\\],\\n]+), Chunk: (\\d+)\\]', 1) AS name, regexp_extract(label, '\\[Doc: ([^\\],\\n]+), Chunk: (\\d+)\\]', 2)::INTEGER AS chunk, count(*) AS n FROM l GROUP BY ALL",
    "lang_guess": _GUESS,
    "pii_flags": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{p}'), false) AS {k}" for k, p in PII.items()) + " FROM documents",
    "amounts": "WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d.,]*\\d (?:EUR|CHF)')) AS amount FROM documents) SELECT right(amount, 3) AS currency, count(*) AS n, count(DISTINCT doc_id) AS documents, max(length(amount))::INTEGER AS longest FROM a GROUP BY 1",
    "json_scalars": "WITH m AS (SELECT DISTINCT ON (id) id, metadata FROM chat_history), k AS (SELECT id, metadata, unnest(json_keys(metadata)) AS path FROM m WHERE json_valid(metadata)) SELECT path, count(*) AS n, count(DISTINCT json_extract_string(metadata, '$.' || path)) AS values FROM k WHERE json_extract_string(metadata, '$.' || path) <> '' GROUP BY path",
    "csv_statements": "SELECT c_nationkey, 'key: ' || c_custkey || '; name: ' || c_name || '; segment: ' || c_mktsegment AS statement FROM customer",
    "csv_wide_to_long": "SELECT 'l_quantity' AS series, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), round(sum(l_tax), 2) FROM lineitem",
    "phrase_counts": f"WITH {_MENTIONS} SELECT name, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM m GROUP BY name",
    "cooccurrence_pairs": f"WITH {_MENTIONS} SELECT x.name AS a, y.name AS b, count(*) AS n, min(x.doc_id) AS first FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND x.name < y.name GROUP BY 1, 2",
    "entity_degree": f"WITH {_MENTIONS}, p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND x.name < y.name) SELECT name, count(*) AS degree FROM (SELECT a AS name FROM p UNION ALL SELECT b FROM p) GROUP BY name",
    "weighted_degree": f"WITH {_MENTIONS}, p AS (SELECT x.name AS a, y.name AS b, CASE WHEN count(DISTINCT x.doc_id) > 1 THEN 2 ELSE 1 END AS w FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND x.name < y.name GROUP BY 1, 2) SELECT name, sum(w)::BIGINT AS degree FROM (SELECT a AS name, w FROM p UNION ALL SELECT b, w FROM p) GROUP BY name",
    "entity_types": f"WITH {_MENTIONS}, k AS (SELECT *, {_KEY.format('name')} AS key, CASE WHEN regexp_matches(name, '(?:AG|GmbH|Ltd|Labs)$') THEN 'company' WHEN regexp_matches(name, '^(?:Project|Projekt|Projet|Proyecto|Programme|Programa|Pilot|Vorhaben) ') THEN 'project' ELSE 'other' END AS kind FROM m) SELECT key, arg_min(kind, (kind = 'other', doc_id % 10 <> 0, doc_id, sentence, name)) AS kind, arg_min(name, (doc_id, sentence, name)) AS name FROM k GROUP BY key",
    "entity_merge": f"WITH {_MENTIONS}, k AS (SELECT *, {_KEY.format('name')} AS key FROM m) SELECT key, arg_min(name, (doc_id, sentence, name)) AS name, count(DISTINCT name) AS forms, count(DISTINCT doc_id) AS documents FROM k GROUP BY key",
    "merkle_leaves": "SELECT doc_id, sha256('\\x00'::BLOB || encode(coalesce(text, ''))) AS leaf FROM documents",
    "merkle_root": "WITH RECURSIVE l AS (SELECT coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS pos, sha256('\\x00'::BLOB || encode(coalesce(text, ''))) AS h FROM documents), t(source, lvl, pos, h) AS (SELECT source, 0, pos, h FROM l UNION ALL SELECT source, lvl + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(arg_min(h, pos)) || unhex(arg_max(h, pos))) ELSE min(h) END FROM (SELECT *, max(pos) OVER (PARTITION BY source) AS top FROM t) WHERE top > 0 GROUP BY source, lvl, pos // 2) SELECT source, (SELECT count(*) FROM l WHERE l.source = t.source) AS leaves, arg_max(h, lvl) AS root FROM t WHERE pos = 0 GROUP BY source",
    "hash_chain": "WITH RECURSIVE r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY seq) AS n, sha256(concat_ws(chr(10), seq::VARCHAR, source, dedupe, type, coalesce(body, ''))) AS h FROM event_log), c(source, n, hash) AS (SELECT source, n, sha256(repeat('0', 64) || chr(10) || h) FROM r WHERE n = 1 UNION ALL SELECT c.source, r.n, sha256(c.hash || chr(10) || r.h) FROM c JOIN r ON r.source = c.source AND r.n = c.n + 1) SELECT source, max(n) AS n, arg_max(hash, n) AS head FROM c GROUP BY source",
    "chain_findings": "WITH b AS (SELECT source, seq, seq % 100 = 0 AS broken, lag(seq % 100 = 0) OVER (PARTITION BY source ORDER BY seq) AS after FROM event_log) SELECT CASE WHEN after THEN 'link' ELSE 'hash' END AS finding, count(*) AS n FROM b WHERE after OR broken GROUP BY 1",
    "tree_siblings": "WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 8 END AS parent, o_orderdate FROM orders) SELECT id, parent, row_number() OVER w AS place, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM o WINDOW w AS (PARTITION BY parent ORDER BY o_orderdate, id)",
    "tree_leaves": "WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 8 END AS parent, o_orderdate FROM orders), k AS (SELECT parent, arg_max(id, (o_orderdate, id)) AS newest, count(*) AS children FROM o WHERE parent IS NOT NULL GROUP BY parent) SELECT o.id, newest, coalesce(children, 0) AS children FROM o LEFT JOIN k ON k.parent = o.id",
}
