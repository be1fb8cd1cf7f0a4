"""Queries of answers and their sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookloom.functions import cuts, structured, words
from brookloom.operators import answers as a
from brookloom.operators import notes as note_ops
from brookloom.operators import retrieval as r
from brookloom.plans.log_queries import _SAMPLES
from brookloom.plans.retrieval_queries import _COS, _QV, _RANK, _TOK, QUERY, _bm25, _T
from brookloom.plans.text_queries import _KEY, _MENTIONS, _mentions
from brookloom.session import table
from brookloom.streaming import event_log as e

TERMS = words.query_tokens(QUERY)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "title", "source", "lang")


def _sections(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"])


def _labels(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(a.loose_labels(F.col("text"))).alias("label"))


def label_parts(spark, sf_dir):
    """Labels in any form, taken apart."""
    p = _labels(spark, sf_dir).select("label", a.parsed_label(F.col("label")).alias("p"))
    return p.groupBy(F.lower("p.doc").alias("doc"), F.col("p.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def _known(spark, sf_dir):
    """Sources: every second name that labels carry, with its least chunk."""
    p = _labels(spark, sf_dir).select(a.parsed_label(F.col("label")).alias("p")).select("p.doc", "p.chunk").filter("length(doc) % 2 = 0")
    return p.groupBy("doc").agg(F.min("chunk").alias("chunk")).select(F.concat_ws("#", "doc", "chunk").alias("source"), "doc", "chunk")


def label_sources(spark, sf_dir):
    """Labels, half of them cut down to the name, resolved against sources."""
    bare = F.regexp_replace("label", r", Chunk: \d+\]$", "]")
    labels = _labels(spark, sf_dir).select(F.when(F.length("label") % 2 == 0, bare).otherwise(F.col("label")).alias("label")).distinct()
    return a.resolved_labels(labels, _known(spark, sf_dir)).groupBy(F.col("source").isNotNull().alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


def expanded_labels(spark, sf_dir):
    """Short labels put behind texts and written out again."""
    labels = F.array(F.lit("[Doc: one.md, Chunk: 1]"), F.concat(F.lit("[Doc: "), F.coalesce("source", F.lit("x")), F.lit(", Chunk: 2]")))
    t = F.concat(F.left(F.coalesce("title", F.lit("")), F.lit(20)), F.when(F.col("doc_id") % 2 == 0, " [S2, S1; S3]").otherwise(" [S1][S9]"))
    return _docs(spark, sf_dir).select("doc_id", a.expanded_labels(t, labels).alias("text"))


def nearest_citation(spark, sf_dir):
    """Lines of documents with the label that is theirs or nearest."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    own = F.regexp_extract("line", r"\[Doc: [^\],\n]+, Chunk: \d+\]", 0)
    s = lines.withColumn("own", F.when(own != "", own))
    return a.nearest_cites(s, ["doc_id"], "pos", "own").groupBy("cite_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cited").alias("labels"))


def adjacent_rows(spark, sf_dir):
    """Messages with the role of the one before in their session."""
    m = table(spark, sf_dir, "chat_history").filter("session_id is not null").groupBy("session_id", "id").agg(F.min("created_at").alias("at"), F.min_by("role", "created_at").alias("role"))
    w = Window.partitionBy("session_id").orderBy("at", "id")
    return m.withColumn("before", F.lag("role").over(w)).groupBy("before", "role").agg(F.count(F.lit(1)).alias("n"))


def query_ranges(spark, sf_dir):
    """The sentence of each document that fits the question best."""
    ranges = a.query_ranges(F.col("text"), TERMS)
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.try_element_at(ranges, F.lit(1))).alias("best"), F.size(ranges).alias("n"))


def premises(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(a.premise(F.col("text"), TERMS, chars=400)).alias("premise"))


def extracted_answer(spark, sf_dir):
    """Sentences for the question from its ten best documents."""
    docs = _docs(spark, sf_dir)
    best = r.top(r.bm25(docs, QUERY), 10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # ten rows
    hits = docs.join(F.broadcast(best), "doc_id").select("rank", "text", F.concat(F.lit("D"), "doc_id").alias("label"))
    return a.extracted_answer(hits, TERMS, 8).select("place", "label", "score", F.md5("sentence").alias("sentence"))


def many_questions(spark, sf_dir):
    """The three best documents for every evaluation question."""
    index = r.indexed(_docs(spark, sf_dir))
    best = r.search_many(index, table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), F.col("question").alias("text")), 3)
    return best.select("id", "doc_id", "rank", F.round("score", 6).alias("score"))


def context_packs(spark, sf_dir):
    """Contexts for every evaluation question: how much of its five best documents each delivers."""
    docs = _docs(spark, sf_dir)
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), "question")
    best = r.search_many(r.indexed(docs), items.withColumnRenamed("question", "text"), 5)
    hits = best.join(docs.select("doc_id", "text"), "doc_id").join(items, "id")
    ranges = a.query_ranges(F.col("text"), F.array_distinct(words.tokens(F.col("question"))))
    p = a.packed(hits.withColumn("ranges", ranges), "id", "rank", "text", "ranges", "small")
    return p.groupBy("delivered").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("longest"))


def context_coverage(spark, sf_dir):
    """What a context of three texts and a budget of 500 characters delivers of each."""
    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.regexp_replace("text", "[<>]", " ").alias("text"))
    head = F.concat(F.lit("<<source s1>>\n"), F.left("text", F.lit(500)))
    context = F.when(F.length("text") <= 500, F.concat(F.lit("<<source s1>>\n"), "text", F.lit("\n<<end>>\n"))).otherwise(head)
    return d.groupBy(a.delivered(context, F.when(F.col("doc_id") % 7 == 0, "s2").otherwise("s1"), F.col("text")).alias("delivered")).agg(F.count(F.lit(1)).alias("n"))


def named_titles(spark, sf_dir):
    """Documents whose title the question names by two neighbouring words."""
    return _docs(spark, sf_dir).filter("title is not null").select("doc_id", a.names_title(F.lit("Is the export dialog of the release notes in the risk register?"), F.col("title")).alias("named")).filter("named")


def routes(spark, sf_dir):
    """Messages with made-up circumstances and the route that they take."""
    m = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    k = F.col("event_id")
    p = F.element_at(F.array(F.lit("free"), F.lit("mixed"), F.lit("grounded")), (k % 3 + 1).cast("int"))
    out = a.route(
        F.when(k % 11 == 0, "mixed").otherwise("auto"), F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 13 == 0, 0).otherwise(4),
        k % 17 == 0, k % 19 == 0, p, k % 23 != 0,
    )
    return m.select(out.alias("o")).groupBy("o.route", "o.reason").agg(F.count(F.lit(1)).alias("n"))


def gathered_sources(spark, sf_dir):
    """Five passages, three titles and two series for a question, labelled."""
    docs = _docs(spark, sf_dir)

    def ranked(df, order, key):
        best = df.orderBy(*order).limit(5)
        return best.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))  # five rows

    passages = ranked(r.bm25(docs, QUERY), [F.desc("score"), F.asc("doc_id")], "doc_id")
    titles = ranked(docs.filter("title is not null"), [F.asc("title"), F.asc("doc_id")], "doc_id")
    series = ranked(docs.filter("source is not null").select("source").distinct(), [F.asc("source")], "source")
    return a.gathered([("passage", passages, 5), ("note", titles, 3), ("reading", series, 2)])


def relevant_feeds(spark, sf_dir):
    s = e.feed_samples(table(spark, sf_dir, "event_log"))
    return a.relevant_series(e.latest(s, ["source", "series"], "happened", "seq"), "What do the pump powers and temperatures of the hub say?", 6).select("source", "series", "score")


def conversation_search(spark, sf_dir):
    """Sessions by their first question, whose first words count twice."""
    m = table(spark, sf_dir, "chat_history").filter("session_id is not null and role = 'user'").groupBy("session_id", "id").agg(F.min("created_at").alias("at"), F.min_by("content", "created_at").alias("content"))
    first = m.groupBy("session_id").agg(F.min_by("content", F.struct("at", "id")).alias("content"))
    title = F.left(F.coalesce("content", F.lit("")), F.lit(40))
    text = first.select(F.col("session_id").alias("doc_id"), F.concat_ws("\n", title, title, "content").alias("text"))
    return r.top(r.bm25(text, "budget of the project"), 15).select("doc_id", F.round("score", 6).alias("score"))


def filtered_after_search(spark, sf_dir):
    """Four times as many hits as asked for, then only those of one language."""
    docs = _docs(spark, sf_dir)
    wide = r.top(r.bm25(docs, QUERY), 50)
    return r.top(wide.join(docs.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), 12).select("doc_id", F.round("score", 6).alias("score"))


def head_chunks(spark, sf_dir):
    w = Window.partitionBy("document_id").orderBy("section_index", "id")
    return _sections(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 2").select("document_id", "id", "n")


def _web(spark, sf_dir):
    """Documents as answers found on the web: labels are the sources, segments the halves of the text."""
    labels = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[Doc: ([^\],\n]+), Chunk: \d+\]"), F.lit(1)))
    d = _docs(spark, sf_dir).filter("text is not null").select((F.col("doc_id") % 50).alias("grp"), F.col("doc_id").alias("pos"), "text", labels.alias("sources")).filter("size(sources) > 0")
    half = F.expr("cast(length(text) div 2 as int)")
    seg = F.array(F.struct(F.lit(0).alias("start"), half.alias("end"), F.array(F.lit(0)).alias("sources")), F.struct(half.alias("start"), F.length("text").alias("end"), F.array(F.lit(1), F.lit(7)).alias("sources")))
    return d.withColumn("segments", seg)


def merged_web(spark, sf_dir):
    return a.merged_answers(_web(spark, sf_dir), "grp", "pos", 5)


def web_segments(spark, sf_dir):
    w = _web(spark, sf_dir)
    return a.shifted_segments(w, a.merged_answers(w, "grp", "pos", 5), "grp", "pos").select("grp", "start", "end", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def fuzzy_tokens(spark, sf_dir):
    """Words of titles against words of section headings."""
    t = _docs(spark, sf_dir).select(F.explode(words.tokens(F.col("title"))).alias("token")).distinct()
    c = table(spark, sf_dir, "knowledge_documents").select(F.explode(words.tokens(F.col("title"))).alias("token")).distinct()
    return a.fuzzy_matches(t, c)


def title_overlap(spark, sf_dir):
    """The share of a title's words that its text holds."""
    o = a.overlap(words.tokens(F.col("title")), words.tokens(F.col("text")))
    return _docs(spark, sf_dir).filter("title is not null").select("doc_id", F.round(o, 6).alias("share"))


def clause_alignment(spark, sf_dir):
    """Sentences of documents and the label-bearing sentence of the same source that covers them best."""
    s = _docs(spark, sf_dir).filter("source is not null and doc_id % 2 = 0").select("source", F.concat_ws(" ", "title").alias("t"), "doc_id")
    own = s.select("source", F.col("doc_id").alias("statement"), words.tokens(F.col("t")).alias("tokens"))
    other = _docs(spark, sf_dir).filter("source is not null and doc_id % 2 = 1").select("source", F.col("doc_id").alias("clause"), words.tokens(F.col("title")).alias("tokens"))
    return a.aligned_clauses(own, other, "source")


def _passages(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk"), F.split(words.name_key(F.coalesce("text", F.lit(""))), " ").alias("passage_words")).filter("doc is not null")


def _triples(spark, sf_dir):
    """Claims made of titles: one in five cites nothing, in others a name is wrong or comes twice."""
    d = _docs(spark, sf_dir).filter("source is not null and title is not null")
    k = F.col("doc_id")
    name = F.regexp_extract(F.coalesce("text", F.lit("")), r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+", 0)
    return d.select(
        F.when(k % 5 == 0, "nowhere").otherwise(F.col("source")).alias("doc"), k.alias("chunk"), name.alias("subject"), F.lit("names").alias("predicate"),
        F.when(k % 5 == 1, name).when(k % 5 == 2, "Nobody Atall").otherwise(F.regexp_extract(F.coalesce("text", F.lit("")), r"\p{Lu}\p{Ll}+", 0)).alias("object"),
    )


def triple_reasons(spark, sf_dir):
    """Claims by why they are dropped."""
    return a.checked_triples(_triples(spark, sf_dir), _passages(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def graph_edges(spark, sf_dir):
    """Claims that hold, as edges between names that the list of entities resolves; no edge to itself."""
    ok = a.checked_triples(_triples(spark, sf_dir), _passages(spark, sf_dir)).filter("reason is null").select(words.name_key(F.col("subject")).alias("s"), words.name_key(F.col("object")).alias("o"))
    known = ok.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("s <> ''").select("s")
    ends = ok.select(F.col("o")).distinct()
    return ok.join(known, "s").join(ends, "o").filter("s <> o").groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))


def chunk_batches(spark, sf_dir):
    """Sections dealt into batches of six or 4 000 characters."""
    s = _sections(spark, sf_dir).withColumn("chars", F.length("markdown_content")).withColumn("order", F.row_number().over(Window.partitionBy("document_id").orderBy("section_index", "id")))
    return a.batches(s, "document_id", "order", "chars")


def top_phrases(spark, sf_dir):
    """The three names that stand in most lines of a document, first seen first."""
    m = _mentions(spark, sf_dir).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("sentence").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first", "name")
    return m.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("doc_id", "place", "name", "n")


def or_query(spark, sf_dir):
    """Titles as queries of alternatives."""
    return _docs(spark, sf_dir).filter("title is not null").select("doc_id", F.array_join(F.sort_array(F.array_distinct(words.tokens(F.col("title")))), " or ").alias("query"))


def union_of_lists(spark, sf_dir):
    """The words that titles of a source use, each once."""
    return _docs(spark, sf_dir).filter("source is not null").groupBy("source").agg(F.collect_set(F.lower(F.substring_index("title", " ", 1))).alias("w")).select("source", F.size("w").alias("n"), F.array_join(F.sort_array("w"), " ").alias("words"))


def defect_summary(spark, sf_dir):
    """Events as checked items: per type how many were caught, flagged or missed."""
    ev = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 30, "missed").when(F.col("value") < 60, "flagged").otherwise("caught").alias("outcome"))
    return ev.groupBy("event_type").pivot("outcome", ["caught", "flagged", "missed"]).agg(F.count(F.lit(1))).fillna(0)


def best_per_note(spark, sf_dir):
    """Documents as notes of their sources: each source's best passage and its share of the best of all."""
    hits = r.bm25(_docs(spark, sf_dir), QUERY).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").filter("source is not null")
    best = hits.groupBy("source").agg(F.max("score").alias("best"))
    top = best.agg(F.max("best").alias("top"))
    return best.crossJoin(F.broadcast(top)).select("source", F.round(note_ops.note_score(F.col("best"), F.col("top"), F.lit(0.0), F.lit(0.0), F.lit(0.0)), 6).alias("score"))  # one row


def conversation_list(spark, sf_dir):
    """The newest sessions; those with a system message are pinned."""
    m = table(spark, sf_dir, "chat_history").filter("session_id is not null")
    s = m.groupBy("session_id").agg(F.bool_or(F.col("role") == "system").alias("pinned"), F.max("created_at").alias("updated"))
    return s.orderBy(F.desc("pinned"), F.desc("updated"), "session_id").limit(40)


def healthy_first(spark, sf_dir):
    """Users by their least event, those with many errors last."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("pos"), (F.avg((F.col("event_type") == "error").cast("int")) > 0.25).alias("slow"))
    return u.orderBy("slow", "pos").limit(30)


def hybrid_25(spark, sf_dir):
    """The fusion of 25 candidates of each kind."""
    q = [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 7").select("embedding").first()[0]]
    return r.hybrid(_docs(spark, sf_dir), table(spark, sf_dir, "embeddings"), QUERY, q, k=10, depth=25).select("doc_id", F.round("score", 6).alias("score"), "best")


def fired_items(spark, sf_dir):
    """Events as due items at the newest time of all: fired or missed."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = ev.agg(F.max("ts").alias("now"))
    items = ev.crossJoin(F.broadcast(now)).select("event_id", F.col("ts").alias("next"), (F.col("event_type") != "error").alias("active"), "now")  # one row
    return a.fired(items, F.col("now"), 600).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rollback_findings(spark, sf_dir):
    """Anchors of a log that was cut off and changed since."""
    log = table(spark, sf_dir, "event_log").select("seq", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "source"), 256).alias("hash"))
    anchors = log.filter("seq % 500 = 0").select((F.expr("seq div 500")).alias("n"), "seq", "hash")
    changed = log.filter("seq < 5000").withColumn("hash", F.when(F.col("seq") % 1500 == 0, "x").otherwise(F.col("hash")))
    return a.rollbacks(anchors, changed)


def canonical_metadata(spark, sf_dir):
    """Message metadata in canonical form, by content."""
    m = table(spark, sf_dir, "chat_history").groupBy("id").agg(F.min_by("metadata", "created_at").alias("metadata"))
    c = cuts.exploded(m, "id", "metadata", lambda t: [(structured.canonical(t),)], "json string")
    return c.groupBy(F.length("json").alias("chars")).agg(F.count(F.lit(1)).alias("n"))


_LAB = r"\[(?:doc|dok|dokument|document|source|quelle)\s*:[^\]\n]{1,300}\]"
_L = f"l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){_LAB}')) AS label FROM documents), p AS (SELECT doc_id, label, regexp_replace(trim(label), '(?i)^\\[\\s*(?:doc|dok|dokument|document|source|quelle)\\s*:\\s*', '') AS body FROM l), q AS (SELECT doc_id, label, nullif(regexp_extract(body, '(?i),\\s*(?:chunk|abschnitt|teil|part)\\s*(?::\\s*)?(\\d{{1,6}})\\s*\\]$', 1), '')::INTEGER AS chunk, trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i),\\s*(?:chunk|abschnitt|teil|part)\\s*(?::\\s*)?\\d{{1,6}}\\s*\\]$', ''), '\\s*\\]$', ''), '\\s+', ' ', 'g')) AS doc FROM p)"
_S = "s AS (SELECT DISTINCT ON (id) * FROM knowledge_sections)"
_QT = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_SENT = "list_filter(regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+[\"'')\\]]*|\\n|$)'), lambda s: trim(s) <> '')"


def _tok(col: str) -> str:
    return _TOK.replace("text", col)


_SC = f"x AS (SELECT doc_id, {_SENT} AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS o FROM x), z AS (SELECT doc_id, o, trim(s) AS s, len(list_intersect({_tok("s")}, {_QT})) AS score FROM y)"
_BATCH = f"""WITH RECURSIVE {_S}, c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, id) AS o, length(markdown_content) AS c FROM s),
b(document_id, o, n, c, batch) AS (SELECT document_id, o, 1, c, 0 FROM c WHERE o = 1 UNION ALL
 SELECT c.document_id, c.o, CASE WHEN b.n >= 6 OR b.c + c.c > 4000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 6 OR b.c + c.c > 4000 THEN c.c ELSE b.c + c.c END, CASE WHEN b.n >= 6 OR b.c + c.c > 4000 THEN b.batch + 1 ELSE b.batch END
 FROM b JOIN c ON c.document_id = b.document_id AND c.o = b.o + 1)
SELECT document_id, o::INTEGER AS "order", batch::BIGINT AS batch FROM b"""

QUERIES = {f.__name__: f for f in (label_parts, label_sources, expanded_labels, nearest_citation, adjacent_rows, query_ranges, premises, extracted_answer, many_questions, context_packs, context_coverage, named_titles, routes, gathered_sources, relevant_feeds, conversation_search, filtered_after_search, head_chunks, merged_web, web_segments, fuzzy_tokens, title_overlap, clause_alignment, triple_reasons, graph_edges, chunk_batches, top_phrases, or_query, union_of_lists, defect_summary, best_per_note, conversation_list, healthy_first, hybrid_25, fired_items, rollback_findings, canonical_metadata)}
SQL = {
    "label_parts": f"WITH {_L} SELECT lower(doc) AS doc, chunk, count(*) AS n FROM q GROUP BY ALL",
    "expanded_labels": "SELECT doc_id, left(coalesce(title, ''), 20) || CASE WHEN doc_id % 2 = 0 THEN ' [Doc: ' || coalesce(source, 'x') || ', Chunk: 2][Doc: one.md, Chunk: 1][S3]' ELSE ' [Doc: one.md, Chunk: 1][S9]' END AS text FROM documents",
    "nearest_citation": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), o AS (SELECT doc_id, pos, nullif(regexp_extract(line, '\\[Doc: [^\\],\\n]+, Chunk: \\d+\\]'), '') AS own FROM l WHERE trim(line) <> ''), n AS (SELECT *, coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS near FROM o) SELECT CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'block' END AS cite_source, count(*) AS n, count(DISTINCT coalesce(own, near)) AS labels FROM n GROUP BY 1",
    "adjacent_rows": "WITH m AS (SELECT session_id, id, min(created_at) AS sent, arg_min(role, created_at) AS role FROM chat_history WHERE session_id IS NOT NULL GROUP BY 1, 2), l AS (SELECT role, lag(role) OVER (PARTITION BY session_id ORDER BY sent, id) AS before FROM m) SELECT before, role, count(*) AS n FROM l GROUP BY ALL",
    "query_ranges": f"WITH {_SC} SELECT d.doc_id, md5(arg_max(s, (score, -o))) AS best, count(s)::INTEGER AS n FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id",
    "premises": f"WITH {_SC}, h AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS n FROM z), c AS (SELECT doc_id, string_agg(s, ' ' ORDER BY o) AS t FROM h WHERE n <= 3 AND (score > 0 OR top = 0) GROUP BY doc_id) SELECT d.doc_id, md5(rtrim(left(coalesce(t, ''), 400))) AS premise FROM documents d LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL",
    "context_coverage": "SELECT CASE WHEN doc_id % 7 = 0 OR trim(left(regexp_replace(text, '[<>]', ' ', 'g'), 500)) = '' THEN 'omitted' WHEN length(text) <= 500 THEN 'full' ELSE 'partial' END AS delivered, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "routes": "WITH k AS (SELECT event_id AS k FROM events), o AS (SELECT CASE WHEN k % 11 = 0 THEN ('mixed', 'explicit_mode') WHEN k % 23 = 0 AND NOT (k % 5 = 0 AND k % 7 <> 0) THEN ('grounded', 'no_model') WHEN k % 7 = 0 THEN ('grounded', 'attachment') WHEN k % 5 = 0 THEN ('free', 'images_only') WHEN k % 13 = 0 THEN ('free', 'no_sources') WHEN k % 17 = 0 THEN ('grounded', 'reference') WHEN k % 19 = 0 THEN ('grounded', 'title') WHEN k % 3 = 0 THEN ('free', 'probe_none') WHEN k % 3 = 1 THEN ('mixed', 'probe_weak') ELSE ('grounded', 'probe_strong') END AS o FROM k) SELECT o[1] AS route, o[2] AS reason, count(*) AS n FROM o GROUP BY ALL",
    "head_chunks": f"WITH {_S}, n AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, id)::INTEGER AS n FROM s) SELECT * FROM n WHERE n <= 2",
    "title_overlap": f"WITH t AS (SELECT doc_id, list_distinct({_tok("title")}) AS a, {_tok("text")} AS b FROM documents WHERE title IS NOT NULL) SELECT doc_id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) END AS share FROM t",
    "clause_alignment": f"WITH t AS (SELECT source, doc_id, list_distinct({_tok("title")}) AS w FROM documents WHERE source IS NOT NULL AND title IS NOT NULL), p AS (SELECT a.doc_id AS statement, b.doc_id AS clause, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS n_s, len(b.w) AS n_c FROM t a JOIN t b ON a.source = b.source AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1), g AS (SELECT * FROM p WHERE shared >= 2 AND shared >= 0.6 * n_s AND shared >= 0.5 * n_c) SELECT statement, arg_max(clause, (shared, -clause)) AS clause, max(shared) AS shared FROM g GROUP BY statement",
    "chunk_batches": _BATCH,
    "or_query": f"SELECT doc_id, array_to_string(list_sort(list_distinct({_tok("title")})), ' or ') AS query FROM documents WHERE title IS NOT NULL",
    "union_of_lists": "WITH w AS (SELECT source, list_distinct(list(lower(split_part(title, ' ', 1)) ORDER BY title) FILTER (WHERE title IS NOT NULL)) AS w FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, coalesce(len(w), 0)::INTEGER AS n, coalesce(array_to_string(list_sort(w), ' '), '') AS words FROM w",
    "defect_summary": "SELECT event_type, count(*) FILTER (WHERE value >= 60) AS caught, count(*) FILTER (WHERE value >= 30 AND value < 60) AS flagged, count(*) FILTER (WHERE value < 30) AS missed FROM events GROUP BY event_type",
    "conversation_list": "SELECT session_id, bool_or(role = 'system') AS pinned, max(created_at) AS updated FROM chat_history WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY pinned DESC, updated DESC, session_id LIMIT 40",
    "healthy_first": "SELECT user_id, min(event_id) AS pos, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0.25 AS slow FROM events GROUP BY user_id ORDER BY slow, pos LIMIT 30",
    "fired_items": "WITH n AS (SELECT max(ts) AS now FROM events) SELECT CASE WHEN epoch_us(now) // 1000 - epoch_us(ts) // 1000 > 36000000 THEN 'missed' ELSE 'fired' END AS kind, count(*) AS n FROM events, n WHERE event_type <> 'error' GROUP BY 1",
    "rollback_findings": "WITH h AS (SELECT max(seq) AS head FROM event_log WHERE seq < 5000) SELECT seq // 500 AS n, CASE WHEN head < seq THEN 'head_older' ELSE 'hash_mismatch' END AS reason FROM event_log, h WHERE seq % 500 = 0 AND (head < seq OR (seq > 0 AND seq % 1500 = 0))",
    "filtered_after_search": f"WITH {_T}, {_bm25('h', QUERY)}, w AS (SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 50) SELECT w.doc_id, round(score, 6) AS score FROM w JOIN documents USING (doc_id) WHERE documents.lang = 'en' ORDER BY w.score DESC, w.doc_id LIMIT 12",
    "conversation_search": f"""WITH m AS (SELECT session_id, id, min(created_at) AS sent, arg_min(content, created_at) AS content FROM chat_history WHERE session_id IS NOT NULL AND role = 'user' GROUP BY 1, 2),
f AS (SELECT session_id, arg_min(content, (sent, id)) AS content FROM m GROUP BY 1), x AS (SELECT session_id AS doc_id, concat_ws(chr(10), left(coalesce(content, ''), 40), left(coalesce(content, ''), 40), content) AS text FROM f),
t AS (SELECT doc_id, '' AS lang, {_TOK} AS toks FROM x), {_bm25('h', 'budget of the project')} SELECT doc_id, round(score, 6) AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 15""",
    "best_per_note": f"WITH {_T}, {_bm25('h', QUERY)}, b AS (SELECT source, max(score) AS best FROM h JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source) SELECT source, round(0.6 * best / max(best) OVER (), 6) AS score FROM b",
    "gathered_sources": f"""WITH {_T}, {_bm25('h', QUERY)}, p AS (SELECT 0 AS k, 'passage' AS kind, doc_id::VARCHAR AS id, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h ORDER BY rank LIMIT 5),
n AS (SELECT 1 AS k, 'note' AS kind, doc_id::VARCHAR AS id, row_number() OVER (ORDER BY title, doc_id)::INTEGER AS rank FROM documents WHERE title IS NOT NULL ORDER BY rank LIMIT 3),
r AS (SELECT 2 AS k, 'reading' AS kind, source AS id, row_number() OVER (ORDER BY source)::INTEGER AS rank FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY rank LIMIT 2),
u AS (SELECT * FROM p UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r) SELECT '[S' || row_number() OVER (ORDER BY k, rank, id) || ']' AS label, kind, id, rank FROM u""",
    "hybrid_25": f"""WITH {_T}, {_bm25('ha', QUERY)}, {_QV}, near AS (SELECT * FROM (SELECT vec_id, {_COS} AS similarity FROM embeddings, qv ORDER BY similarity DESC, vec_id LIMIT 25) WHERE vec_id IN (SELECT doc_id FROM documents)),
ra AS ({_RANK.format('ha', 25)}), rb AS (SELECT vec_id AS key, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM near),
u AS (SELECT *, 0 AS list FROM ra UNION ALL SELECT *, 1 FROM rb),
f AS (SELECT key, sum(1.0 / (60 + rank)) AS score, min(rank)::INTEGER AS best FROM u GROUP BY key ORDER BY sum(1.0 / (60 + rank)) DESC, min(rank), min(list * 1000 + rank), key LIMIT 10)
SELECT key AS doc_id, round(score, 6) AS score, best FROM f""",
    "top_phrases": f"WITH {_MENTIONS}, c AS (SELECT doc_id, name, count(*) AS n, min(sentence) AS first FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, name)::INTEGER AS place FROM c) SELECT doc_id, place, name, n FROM r WHERE place <= 3",
    "merged_web": "WITH d AS (SELECT doc_id % 50 AS grp, doc_id AS pos, regexp_extract_all(text, '\\[Doc: ([^\\],\\n]+), Chunk: \\d+\\]', 1) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT grp, pos, unnest(l) AS source, generate_subscripts(l, 1) AS k FROM d), f AS (SELECT grp, source, min((pos, k)) AS f FROM e GROUP BY 1, 2), r AS (SELECT grp, source, row_number() OVER (PARTITION BY grp ORDER BY f, source)::INTEGER AS place FROM f) SELECT * FROM r WHERE place <= 5",
    "label_sources": f"""WITH {_L}, k AS (SELECT doc, min(chunk) AS chunk FROM q WHERE length(doc) % 2 = 0 GROUP BY doc), b AS (SELECT DISTINCT CASE WHEN length(label) % 2 = 0 THEN regexp_replace(label, ', Chunk: \\d+\\]$', ']') ELSE label END AS label, doc, CASE WHEN length(label) % 2 = 0 AND regexp_matches(label, ', Chunk: \\d+\\]$') THEN NULL ELSE chunk END AS chunk FROM q),
s AS (SELECT b.label, CASE WHEN b.chunk IS NULL THEN (SELECT count(*) FROM k WHERE lower(k.doc) = lower(b.doc)) = 1 ELSE EXISTS (SELECT 1 FROM k WHERE lower(k.doc) = lower(b.doc) AND k.chunk = b.chunk) END AS resolved FROM b) SELECT resolved, count(*) AS n FROM s GROUP BY 1""",
    "fuzzy_tokens": f"""WITH a AS (SELECT DISTINCT unnest({_tok('title')}) AS token FROM documents), b AS (SELECT DISTINCT unnest({_tok('title')}) AS candidate FROM knowledge_documents)
SELECT token, candidate FROM a, b WHERE token = candidate OR (length(token) >= 5 AND length(candidate) >= 5 AND left(token, greatest(5, greatest(length(token), length(candidate)) - 4)) = left(candidate, greatest(5, greatest(length(token), length(candidate)) - 4)))
 OR (length(token) >= 5 AND length(candidate) >= 8 AND (contains(candidate, token) OR (length(token) >= 8 AND contains(token, candidate))))""",
    "triple_reasons": f"""WITH d AS (SELECT doc_id AS k, source, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}+ \\p{{Lu}}\\p{{Ll}}+') AS name, regexp_extract(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}+') AS one FROM documents WHERE source IS NOT NULL AND title IS NOT NULL),
c AS (SELECT k, string_split({_KEY.format('t')}, ' ') AS w, {_KEY.format('name')} AS s, {_KEY.format("(CASE WHEN k % 5 = 1 THEN name WHEN k % 5 = 2 THEN 'Nobody Atall' ELSE one END)")} AS o FROM d),
n AS (SELECT k, s, o, s <> '' AND len(list_filter(string_split(s, ' '), lambda x: NOT list_contains(w, x))) = 0 AS has_s, o <> '' AND len(list_filter(string_split(o, ' '), lambda x: NOT list_contains(w, x))) = 0 AS has_o FROM c)
SELECT CASE WHEN k % 5 = 0 THEN 'cite' WHEN s = o THEN 'same' WHEN NOT has_s THEN 'subject' WHEN NOT has_o THEN 'object' END AS reason, count(*) AS n FROM n GROUP BY 1""",
    "named_titles": f"""WITH q AS (SELECT {_tok("'Is the export dialog of the release notes in the risk register?'")} AS q), t AS (SELECT doc_id, list_filter({_tok("regexp_replace(title, '(?i)\\.[a-z0-9]{1,5}$', '')")}, lambda w: length(w) >= 3) AS t FROM documents WHERE title IS NOT NULL)
SELECT doc_id, true AS named FROM t, q WHERE list_has_any(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1]))""",
    "graph_edges": f"""WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}+ \\p{{Lu}}\\p{{Ll}}+') AS name, regexp_extract(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}+') AS one FROM documents WHERE source IS NOT NULL AND title IS NOT NULL AND doc_id % 5 > 2),
c AS (SELECT k, string_split({_KEY.format('t')}, ' ') AS w, {_KEY.format('name')} AS s, {_KEY.format('one')} AS o FROM d)
SELECT s, o, count(*) AS n FROM c WHERE s <> '' AND o <> '' AND s <> o AND len(list_filter(string_split(s, ' '), lambda x: NOT list_contains(w, x))) = 0 AND len(list_filter(string_split(o, ' '), lambda x: NOT list_contains(w, x))) = 0 GROUP BY s, o""",
    "relevant_feeds": f"""WITH {_SAMPLES}, l AS (SELECT source, series, max(happened) AS happened FROM s GROUP BY 1, 2), p AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(series, '[._]') || regexp_split_to_array(source, '[._-]'), lambda x: length(x) >= 3), lambda x: regexp_replace(x, 's$', ''))) AS w FROM l),
q AS (SELECT source, series, happened, len(list_intersect(w, ['what', 'the', 'pump', 'power', 'and', 'temperature', 'hub', 'say']))::INTEGER AS score FROM p)
SELECT source, series, score FROM q WHERE score > 0 ORDER BY q.score DESC, happened DESC, source, series LIMIT 6""",
    "many_questions": f"""WITH {_T}, s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), p AS (SELECT doc_id, len(toks) AS l, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT item_id AS id, unnest(list_distinct({_tok('question')})) AS term FROM eval_items),
h AS (SELECT id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM h) SELECT id, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 3""",
}
