"""Queries of the store operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookloom.operators import retrieval as r
from brookloom.operators import receipts, store
from brookloom.plans.retrieval_queries import _TOK
from brookloom.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "event_log")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_documents").groupBy("id").agg(F.max_by(F.struct("title", "raw_content", "source_type", "is_public", "created_at", "owner_id"), "updated_at").alias("d")).select("id", "d.*")


def _sections(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"])


def _messages(spark, sf_dir):
    first = F.min_by(F.struct("role", "content", "session_id"), "created_at")
    return table(spark, sf_dir, "chat_history").filter("session_id is not null").groupBy("id").agg(first.alias("m"), F.min("created_at").alias("created_at")).select("id", "m.*", "created_at")


def store_scan(spark, sf_dir):
    return store.scan(_orders(spark, sf_dir), "o_orderkey", store.KeyRange(lower=100, upper=400, upper_open=True), limit=200)


def index_scan(spark, sf_dir):
    """Orders of one priority class by date, then key."""
    rows = _orders(spark, sf_dir).filter(store.KeyRange(prefix="1-").holds(F.col("o_orderpriority")))
    return store.scan(rows, "o_orderkey", by="o_orderdate", limit=100).select("o_orderkey", "o_orderdate")


def cursor_walk(spark, sf_dir):
    return store.scan(_orders(spark, sf_dir), "o_orderkey", by="o_custkey", descending=True, limit=50).select("o_orderkey", "o_custkey")


def array_key_range(spark, sf_dir):
    """Keys of two parts, by their first part."""
    rows = _orders(spark, sf_dir).withColumn("key", F.array(F.left("o_orderpriority", F.lit(1)), F.col("o_custkey").cast("string")))
    return rows.filter(store.KeyRange(head=("2",)).holds(F.col("key"))).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def offset_page(spark, sf_dir):
    return store.offset_page(_orders(spark, sf_dir), "o_orderkey", 3, 100).select("o_orderkey")


def committed_offsets(spark, sf_dir):
    """Positions by source after a replayed half and the rest of the log."""
    log = _log(spark, sf_dir).select("source", "seq")
    old = store.committed_positions(log.limit(0), log, "source", "seq")
    return store.committed_positions(old, log.filter("seq % 2 = 0"), "source", "seq")


def delete_cascade(spark, sf_dir):
    """The store without the documents of one type: what is left of documents and sections."""
    docs, sections = _docs(spark, sf_dir), _sections(spark, sf_dir)
    left = store.deleted({"documents": (docs, "id"), "sections": (sections, "document_id")}, docs.filter("source_type = 'web'").select("id"))
    return left["documents"].select(F.lit("document").alias("kind"), "id").unionByName(left["sections"].select(F.lit("section").alias("kind"), "id"))


def delete_range(spark, sf_dir):
    return store.without_range(_orders(spark, sf_dir), "o_orderkey", store.KeyRange(lower=50, upper=90_000)).select("o_orderkey")


def retention(spark, sf_dir):
    """Events of the last 20 days, at most thirty of each user; clicks count as read."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("read", F.col("event_type") == "click")
    last = ev.agg(F.max("ts").alias("now"))
    return store.retained(ev.crossJoin(F.broadcast(last)), F.col("ts"), F.col("now"), 20, 30, "read", "user_id", "event_id").select("event_id", "user_id")  # one row


def reachability(spark, sf_dir):
    places = F.explode(F.array(F.lit("none"), F.lit("local"), F.lit("cloud")))
    log = _log(spark, sf_dir).select(F.col("class").alias("data_class"), places.alias("place"))
    return log.groupBy("data_class", "place", store.may_reach(F.col("data_class"), F.col("place"), False).alias("may")).agg(F.count(F.lit(1)).alias("n"))


def live_versions(spark, sf_dir):
    """Rows derived from an older text of every fifth document are stale."""
    docs = _docs(spark, sf_dir).select("id", F.sha2(F.coalesce("raw_content", F.lit("")), 256).alias("sha"))
    derived = docs.select("id", F.when(F.pmod(F.length("sha") + F.ascii("id"), 5) == 0, F.lit("old")).otherwise(F.col("sha")).alias("sha"))
    return store.live(derived, docs, "id", "sha").select("id", "live")


def syncable_messages(spark, sf_dir):
    """Messages in threads (each below the one before); answers of some sessions are local only."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    m = _messages(spark, sf_dir).withColumn("parent", F.lag("id").over(w)).withColumn("local_only", F.ascii("id") % 3 == 0)
    return store.syncable(m.select("id", "parent", "role", "local_only"))


def memory_scope(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    scope = F.when(F.col("c_custkey") % 2 == 0, "global").otherwise(F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string")))
    project = F.when(F.col("c_nationkey") > 2, F.concat(F.lit("p"), (F.col("c_nationkey") % 5).cast("string")))
    mode = F.when(F.col("c_nationkey") % 3 == 0, "off").when(F.col("c_nationkey") % 3 == 1, "project").otherwise("all")
    return c.groupBy("c_nationkey").agg(F.count_if(store.in_scope(scope, project, mode)).alias("n"))


def valid_entries(spark, sf_dir):
    s = _sections(spark, sf_dir).withColumn("first", F.try_element_at("embedding", F.lit(1)))
    return s.groupBy(store.valid_entry(s, ["token_count", "first"], ["heading", "markdown_content"]).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def distinct_sources(spark, sf_dir):
    """Documents in the order in which a list of section hits names them."""
    s = _sections(spark, sf_dir).filter("contains(markdown_content, 'budget')").orderBy("section_index", "id").limit(60)
    hits = s.select("document_id", F.row_number().over(Window.orderBy("section_index", "id")).alias("pos"))  # sixty rows
    return store.distinct_sources(hits, "document_id", "pos")


def prefixed_texts(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "query").otherwise("passage")
    return _messages(spark, sf_dir).select("id", F.md5(store.prefixed(kind, F.coalesce("content", F.lit("")))).alias("text"))


def _chunks(spark, sf_dir):
    return _sections(spark, sf_dir).select(F.col("document_id").alias("doc"), F.col("section_index").alias("idx")).distinct()


def _vectors(spark, sf_dir):
    s = _sections(spark, sf_dir).filter("embedding is not null")
    return s.groupBy(F.col("document_id").alias("doc"), F.col("section_index").alias("idx")).agg(F.min_by("embedding", "id").alias("embedding")).withColumn("model", F.when(F.col("idx") % 4 == 3, "m1").otherwise("m2"))


def pending_vectors(spark, sf_dir):
    return store.pending_vectors(_chunks(spark, sf_dir), _vectors(spark, sf_dir), "m2", 300)


def accepted_vectors(spark, sf_dir):
    new = _vectors(spark, sf_dir).withColumn("idx", F.col("idx") + F.when(F.col("idx") % 5 == 4, 1000).otherwise(0))
    return store.accepted_vectors(new, _chunks(spark, sf_dir), 64).select("doc", "idx")


def model_switch(spark, sf_dir):
    return store.switched(_vectors(spark, sf_dir), "m2").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def pooled_vectors(spark, sf_dir):
    """The mean of the vectors of each label at length one: its first numbers."""
    e = table(spark, sf_dir, "embeddings")
    return store.pooled(e.withColumn("part", F.col("vec_id") % 10), "part", 8).select("part", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


def exported_chats(spark, sf_dir):
    """Conversations as JSON and back: messages that survive, by role."""
    out = store.exported(_messages(spark, sf_dir), "session_id", ["created_at", "id"], ["id", "role", "content"])
    back = store.imported(out, "session_id", {"id": "string", "role": "string", "content": "string"})
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"), F.max("place").alias("last"))


def run_history(spark, sf_dir):
    """The history of each user as versioned JSON, oldest first: its hash."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.exported(ev, "user_id", ["event_id"], ["event_id", "event_type"], version=1).select("user_id", F.md5("json").alias("json"))


def report_results(spark, sf_dir):
    """Stale section counts as results of a report, by level."""
    n = _sections(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    d = _docs(spark, sf_dir).join(n, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("n"))
    level = F.when(F.col("n") == 0, "error").otherwise("warning")
    result = store.sarif_result(F.lit("few_sections"), level, F.coalesce("title", F.lit("")), F.concat(F.lit("doc/"), "id"), F.lit(1), F.lit(1))
    return d.filter("n < 3").select("id", F.get_json_object(result, "$.level").alias("level"), F.get_json_object(result, "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), F.get_json_object(result, "$.partialFingerprints['statement/v1']").alias("finger"))


def inbox_marks(spark, sf_dir):
    items = _log(spark, sf_dir).select("seq", (F.col("class") == "public").alias("read"))
    return store.inbox(items, 500)


def stale_jobs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = ev.agg(F.max(F.unix_millis("ts")).alias("now"))
    jobs = ev.groupBy(F.col("user_id").alias("job")).agg(F.max(F.unix_millis("ts")).alias("beat_ms"), F.max_by("event_type", "event_id").alias("kind"))
    jobs = jobs.withColumn("state", F.when(F.col("kind") == "error", "failed").otherwise("running")).crossJoin(F.broadcast(last))  # one row
    return store.stale_jobs(jobs, F.col("now"), 3 * 3_600_000).select("job", "beat_ms")


def edge_visibility(spark, sf_dir):
    """Pairs of documents that share an owner and a type, both ends visible to a stranger."""
    d = _docs(spark, sf_dir)
    edges = d.filter("owner_id is not null").groupBy("owner_id", "source_type").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("a", "b")
    seen = d.filter("is_public").select("id")
    return edges.join(seen.withColumnRenamed("id", "a"), "a", "left_semi").join(seen.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def receipt_checks(spark, sf_dir):
    """Receipts of sources as answers that cite the first 60 characters of their documents; since then every seventh file changed, one excerpt in
    eleven was recorded wrongly and the lines of one source were altered."""
    d = table(spark, sf_dir, "documents").filter("source is not null and length(text) > 60")
    wrong = F.when(F.col("doc_id") % 11 == 0, F.lit("another text")).otherwise(F.left("text", F.lit(60)))
    cites = d.select(F.col("source").alias("id"), F.col("doc_id").alias("n"), F.concat(F.lit("[S"), "doc_id", F.lit("]")).alias("label"), wrong.alias("excerpt"), F.col("text").alias("file"), F.lit(0).alias("start"), F.lit(60).alias("end"))
    heads, lines = receipts.receipts(cites)
    altered = lines.withColumn("label", F.when(F.col("id") == "workspace-hall", F.lit("[S0]")).otherwise(F.col("label")))
    files = d.select(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return receipts.verified(heads, altered, files).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def after_removal(spark, sf_dir):
    """Document frequencies after documents left: as if they had never been there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    left = store.deleted({"d": (d, "doc_id")}, gone)["d"]
    return r.doc_frequencies(left).select("term", "df", F.round("idf", 6).alias("idf"))


_D = "d AS (SELECT id, arg_max(title, updated_at) AS title, arg_max(raw_content, updated_at) AS raw_content, arg_max(source_type, updated_at) AS source_type, arg_max(is_public, updated_at) AS is_public, any_value(owner_id) AS owner_id FROM knowledge_documents GROUP BY id)"
_S = "s AS (SELECT DISTINCT ON (id) * FROM knowledge_sections)"
_M = "m AS (SELECT id, arg_min(role, created_at) AS role, arg_min(content, created_at) AS content, arg_min(session_id, created_at) AS session_id, min(created_at) AS created_at FROM chat_history WHERE session_id IS NOT NULL GROUP BY id)"
_V = "v AS (SELECT document_id AS doc, section_index AS idx, arg_min(embedding, id) AS embedding, CASE WHEN section_index % 4 = 3 THEN 'm1' ELSE 'm2' END AS model FROM s WHERE embedding IS NOT NULL GROUP BY ALL), c AS (SELECT DISTINCT document_id AS doc, section_index AS idx FROM s)"

QUERIES = {f.__name__: f for f in (store_scan, index_scan, cursor_walk, array_key_range, offset_page, committed_offsets, delete_cascade, delete_range, retention, reachability, live_versions, syncable_messages, memory_scope, valid_entries, distinct_sources, prefixed_texts, pending_vectors, accepted_vectors, model_switch, pooled_vectors, exported_chats, run_history, report_results, inbox_marks, stale_jobs, edge_visibility, after_removal, receipt_checks)}
SQL = {
    "store_scan": "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400 ORDER BY o_orderkey LIMIT 200",
    "index_scan": "SELECT o_orderkey, o_orderdate FROM orders WHERE starts_with(o_orderpriority, '1-') ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "cursor_walk": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 50",
    "array_key_range": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE left(o_orderpriority, 1) = '2' GROUP BY 1",
    "offset_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300",
    "committed_offsets": "SELECT source, max(seq) AS seq FROM event_log GROUP BY source",
    "delete_cascade": f"WITH {_D}, {_S} SELECT 'document' AS kind, id FROM d WHERE source_type IS DISTINCT FROM 'web' UNION ALL SELECT 'section', id FROM s WHERE document_id NOT IN (SELECT id FROM d WHERE source_type = 'web')",
    "delete_range": "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey BETWEEN 50 AND 90000)",
    "retention": "WITH y AS (SELECT *, event_type = 'click' AS read FROM events WHERE date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) <= 20), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY read, event_id DESC) AS n FROM y) SELECT event_id, user_id FROM n WHERE n <= 30",
    "reachability": """WITH l AS (SELECT "class" AS data_class, unnest(['none', 'local', 'cloud']) AS place FROM event_log) SELECT data_class, place, CASE WHEN place = 'none' THEN true ELSE CASE data_class WHEN 'public' THEN true WHEN 'personal' THEN place = 'local' WHEN 'sensitive' THEN place = 'local' ELSE false END END AS may, count(*) AS n FROM l GROUP BY ALL""",
    "live_versions": f"WITH {_D} SELECT id, (64 + ascii(id)) % 5 <> 0 AS live FROM d",
    "syncable_messages": f"WITH {_M}, p AS (SELECT *, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, id) AS parent, ascii(id) % 3 = 0 AS lo FROM m), a AS (SELECT parent FROM p WHERE NOT lo AND role NOT IN ('user', 'system') AND parent IS NOT NULL) SELECT id FROM p WHERE NOT lo AND (role <> 'user' OR id IN (SELECT parent FROM a))",
    "memory_scope": "WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'global' ELSE 'p' || c_custkey % 5 END AS scope, CASE WHEN c_nationkey > 2 THEN 'p' || c_nationkey % 5 END AS project, c_nationkey % 3 AS mode FROM customer) SELECT c_nationkey, count(*) FILTER (WHERE CASE WHEN project IS NULL THEN scope = 'global' WHEN mode = 0 THEN false WHEN mode = 1 THEN scope = project ELSE scope IN ('global', project) END) AS n FROM c GROUP BY 1",
    "valid_entries": f"WITH {_S} SELECT coalesce(token_count IS NOT NULL AND isfinite(embedding[1]) AND length(heading) > 0 AND length(markdown_content) > 0, false) AS valid, count(*) AS n FROM s GROUP BY 1",
    "distinct_sources": f"WITH {_S}, h AS (SELECT document_id, row_number() OVER (ORDER BY section_index, id)::INTEGER AS pos FROM s WHERE contains(markdown_content, 'budget') ORDER BY section_index, id LIMIT 60), f AS (SELECT document_id, min(pos) AS pos FROM h GROUP BY 1) SELECT document_id, pos, row_number() OVER (ORDER BY pos, document_id)::INTEGER AS place FROM f",
    "prefixed_texts": f"WITH {_M} SELECT id, md5(CASE WHEN role = 'user' THEN 'query: ' ELSE 'passage: ' END || coalesce(content, '')) AS text FROM m",
    "pending_vectors": f"WITH {_S}, {_V} SELECT doc, idx FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc = c.doc AND v.idx = c.idx AND model = 'm2') ORDER BY doc, idx LIMIT 300",
    "accepted_vectors": f"WITH {_S}, {_V} SELECT doc, idx FROM v WHERE len(embedding) = 64 AND idx % 5 <> 4",
    "model_switch": f"WITH {_S}, {_V} SELECT model, count(*) AS n FROM v WHERE model = 'm2' GROUP BY 1",
    "pooled_vectors": "WITH m AS (SELECT vec_id % 10 AS part, [" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 9)) + "] AS m FROM embeddings GROUP BY 1) SELECT part, list_transform(m, lambda x: round(x / greatest(sqrt(list_dot_product(m, m)), 1e-12), 5)) AS embedding FROM m",
    "exported_chats": f"WITH {_M}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS place FROM m) SELECT role, count(*) AS n, sum(coalesce(length(content), 0))::BIGINT AS chars, max(place)::INTEGER AS last FROM p GROUP BY role",
    "run_history": """WITH e AS (SELECT user_id, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS m FROM events GROUP BY user_id) SELECT user_id, md5('{"version":1,"user_id":' || user_id || ',"messages":' || m || '}') AS json FROM e""",
    "report_results": f"WITH {_D}, {_S}, n AS (SELECT d.id, coalesce(title, '') AS title, count(s.id) AS n FROM d LEFT JOIN s ON s.document_id = d.id GROUP BY ALL) SELECT id, CASE WHEN n = 0 THEN 'error' ELSE 'warning' END AS level, 'doc/' || id AS uri, sha256('few_sections' || chr(10) || title) AS finger FROM n WHERE n < 3",
    "inbox_marks": """SELECT count(*) FILTER (WHERE seq > 500) AS new, count(*) FILTER (WHERE seq > 500 AND "class" <> 'public') AS unread, max(seq) AS mark FROM event_log""",
    "stale_jobs": "WITH j AS (SELECT user_id AS job, max(epoch_us(ts)) // 1000 AS beat_ms, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) SELECT job, beat_ms FROM j WHERE kind <> 'error' AND (SELECT max(epoch_us(ts)) // 1000 FROM events) - beat_ms > 10800000",
    "edge_visibility": f"WITH {_D}, e AS (SELECT min(id) AS a, max(id) AS b FROM d WHERE owner_id IS NOT NULL GROUP BY owner_id, source_type) SELECT a, b FROM e WHERE a < b AND a IN (SELECT id FROM d WHERE is_public) AND b IN (SELECT id FROM d WHERE is_public)",
    "receipt_checks": """WITH d AS (SELECT doc_id, source, text FROM documents WHERE source IS NOT NULL AND length(text) > 60), f AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END AS text FROM d)
SELECT CASE WHEN source = 'workspace-hall' THEN 'root_mismatch' WHEN text NOT IN (SELECT text FROM f) THEN 'file_changed' WHEN doc_id % 11 = 0 THEN 'text_changed' ELSE 'ok' END AS status, count(*) AS n FROM d GROUP BY 1""",
    "after_removal": f"WITH k AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), t AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM k), n AS (SELECT count(*) AS n FROM k) SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term",
}
