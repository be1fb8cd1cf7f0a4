"""Queries of answers as text, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from brookloom.operators import answer_texts as a
from brookloom.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "title", "source")


def canonical_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(a.canonical_text(F.col("text"))).alias("text"))


def blanked_labels(spark, sf_dir):
    t = a.blanked(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(t).alias("chars"), F.size(F.regexp_extract_all(t, F.lit(a.LOOSE), F.lit(0))).alias("labels"), (F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("["), F.lit("")))).alias("brackets"))


def label_places(spark, sf_dir):
    """Line and column of the first label of each document."""
    at = F.call_function("instr", F.col("text"), F.lit("[Doc:")) - 1
    return _docs(spark, sf_dir).withColumn("at", at).filter("at >= 0").select("doc_id", a.line_of(F.col("text"), F.col("at")).alias("p")).select("doc_id", "p.line", "p.column")


def personal_kinds(spark, sf_dir):
    """Texts with made-up mail addresses, cards (some with a wrong check digit) and numbers put behind them: what is removed."""
    n = F.col("doc_id")
    more = F.when(n % 4 == 0, " write to a.b@example.org").when(n % 4 == 1, " card 4539 1488 0343 6467").when(n % 4 == 2, " card 4539 1488 0343 6468").otherwise(" at 10.0.0.1")
    p = a.without_personal(F.concat(F.coalesce("text", F.lit("")), more))
    return _docs(spark, sf_dir).select((n % 4).alias("form"), p.alias("p")).groupBy("form").agg(F.count_if(F.array_contains("p.kinds", "mail")).alias("mail"), F.count_if(F.array_contains("p.kinds", "card")).alias("card"), F.count_if(F.array_contains("p.kinds", "ip")).alias("ip"))


def spoken_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(a.spoken(F.coalesce("text", F.lit("")))).alias("text"))


def text_blocks(spark, sf_dir):
    """Lines of documents by kind, and how many lead in the next."""
    return a.blocks(_docs(spark, sf_dir), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("leads").alias("leads"))


def published_sections(spark, sf_dir):
    """Documents published with a hashing embedder: sections, and the dimension of their vectors."""

    def embed(texts):
        return [[float(zlib.crc32(f"{k} {t}".encode()) % 1000) / 1000 for k in range(4)] for t in texts]

    d = table(spark, sf_dir, "knowledge_documents").groupBy("id").agg(F.max_by("title", "updated_at").alias("title"), F.max_by("raw_content", "updated_at").alias("markdown"))
    return a.published(d, embed).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("documents"))


def incremental_run(spark, sf_dir):
    s = table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"]).select(F.col("document_id").alias("doc"), F.col("section_index").alias("idx")).distinct()
    return a.next_run(s, s.filter("idx % 3 <> 0"), 60)


def projection_replay(spark, sf_dir):
    """A view of the newest sequence number by source, up to date half-way, taken further; a new version starts afresh."""
    log = table(spark, sf_dir, "event_log").select("source", "seq")
    project = lambda df: df.groupBy("source").agg(F.max("seq").alias("seq"))
    view = project(log.filter("seq <= 3000"))
    kept = a.replayed(view, log, project, 1, 1, 3000).groupBy("source").agg(F.max("seq").alias("seq")).withColumn("how", F.lit("further"))
    return kept.unionByName(a.replayed(view.limit(0), log, project, 1, 2, 3000).withColumn("how", F.lit("afresh")))


def service_states(spark, sf_dir):
    """Events as calls of their user's service, an hour's stretch folded into a second; an event of type error or search fails."""
    ev = table(spark, sf_dir, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 3600000").alias("at"), F.col("event_type").isin("error", "search").alias("failed"))
    once = ev.groupBy("user_id", "at").agg(F.bool_or("failed").alias("failed"))
    return a.service_states(once, "user_id", "at", "failed", 2).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def carried_values(spark, sf_dir):
    """Lines of documents without an amount that take over the one of the line before."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    s = lines.withColumn("amounts", F.regexp_extract_all("line", F.lit(r"\d[\d.,]*\d (?:EUR|CHF)"), F.lit(0)))
    return a.carried_values(s, ["doc_id"], "pos", "amounts").filter("carried is not null").select("doc_id", "pos", "carried")


_CANON = "text"
for _rx, _to in a.CANONICAL:
    _CANON = "regexp_replace({}, '{}', '{}', 'g')".format(_CANON, _rx.replace("'", "''"), _to.replace("$1", "\\1").replace("'", "''"))
_SPOKEN = "coalesce(text, '')"
for _short, _long in a.SPOKEN.items():
    _SPOKEN = f"replace({_SPOKEN}, '{_short}', '{_long}')"

QUERIES = {f.__name__: f for f in (canonical_texts, blanked_labels, label_places, personal_kinds, spoken_forms, text_blocks, published_sections, incremental_run, projection_replay, service_states, carried_values)}
SQL = {
    "canonical_texts": f"SELECT doc_id, md5(trim({_CANON})) AS text FROM documents",
    "blanked_labels": "SELECT doc_id, length(text)::INTEGER AS chars, CASE WHEN text IS NULL THEN -1 ELSE 0 END AS labels, (length(text) - length(replace(text, '[', '')))::INTEGER AS brackets FROM documents",
    "label_places": "WITH p AS (SELECT doc_id, left(text, instr(text, '[Doc:') - 1) AS h FROM documents WHERE instr(text, '[Doc:') > 0) SELECT doc_id, (length(h) - length(replace(h, chr(10), '')) + 1)::INTEGER AS line, (length(string_split(h, chr(10))[-1]) + 1)::INTEGER AS \"column\" FROM p",
    "spoken_forms": f"WITH s AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace({_SPOKEN}, ' {{2,}}', ' ', 'g') AS o FROM documents) SELECT doc_id, md5(CASE WHEN regexp_replace(o, '\\D', '', 'g') = regexp_replace(t, '\\D', '', 'g') THEN o ELSE t END) AS text FROM s",
    "text_blocks": "WITH l AS (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS t FROM documents), k AS (SELECT t, CASE WHEN regexp_matches(t, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(t, '^\\s*(?:[-*+]|\\d{1,3}[.)])\\s') THEN 'li' WHEN regexp_matches(t, '^\\s*\\|.*\\|\\s*$') THEN 'row' WHEN regexp_matches(t, '^\\s*>') THEN 'quote' ELSE 'p' END AS kind FROM l WHERE trim(t) <> '') SELECT kind, count(*) AS n, count(*) FILTER (WHERE ends_with(trim(t), ':')) AS leads FROM k GROUP BY kind",
    "incremental_run": "WITH c AS (SELECT DISTINCT document_id AS doc, section_index AS idx FROM knowledge_sections), l AS (SELECT doc, idx, count(*) OVER (PARTITION BY doc) AS n FROM c WHERE idx % 3 = 0) SELECT doc, idx FROM l ORDER BY n, doc, idx LIMIT 60",
    "projection_replay": "SELECT source, max(seq) AS seq, unnest(['further', 'afresh']) AS how FROM event_log GROUP BY source",
    "service_states": """WITH RECURSIVE c AS (SELECT user_id, epoch_us(ts) // 3600000 AS t, bool_or(event_type IN ('error', 'search')) AS bad FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM c),
s(user_id, n, fails, until, state) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, NULL::BIGINT, '' FROM c UNION ALL
 SELECT r.user_id, r.n, CASE WHEN until IS NOT NULL AND t < until THEN fails WHEN until IS NOT NULL THEN CASE WHEN bad THEN fails ELSE 0 END WHEN bad THEN fails + 1 ELSE 0 END,
  CASE WHEN until IS NOT NULL AND t < until THEN until WHEN until IS NOT NULL THEN CASE WHEN bad THEN t + 60000 END WHEN bad AND fails + 1 >= 2 THEN t + 60000 END,
  CASE WHEN until IS NOT NULL AND t < until THEN 'refused' WHEN until IS NOT NULL THEN CASE WHEN bad THEN 'trial failed' ELSE 'trial passed' END WHEN bad THEN 'failed' ELSE 'passed' END
 FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1) SELECT state, count(*) AS n FROM s WHERE n > 0 GROUP BY state""",
    "carried_values": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), a AS (SELECT doc_id, pos, regexp_extract_all(line, '\\d[\\d.,]*\\d (?:EUR|CHF)') AS x FROM l), b AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM a) SELECT doc_id, pos::INTEGER AS pos, y[1] AS carried FROM b WHERE len(x) = 0 AND len(y) = 1",
    "personal_kinds": "SELECT doc_id % 4 AS form, count(*) FILTER (WHERE doc_id % 4 = 0) AS mail, count(*) FILTER (WHERE doc_id % 4 = 1) AS card, count(*) FILTER (WHERE doc_id % 4 = 3) AS ip FROM documents GROUP BY 1",
}
