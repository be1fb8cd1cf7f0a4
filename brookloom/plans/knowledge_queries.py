"""Queries over the knowledge-base tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.operators import knowledge as k
from brookloom.operators import retrieval as r
from brookloom.session import table

TERMS = ["works", "council", "budget", "vertrag"]
ME = "0284875f-2446-4b5a-a8d0-9946d801594d"


def _docs(spark, sf_dir):
    return k.once(table(spark, sf_dir, "knowledge_documents"))


def _sections(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"])


def inner_join_titles(spark, sf_dir):
    s = _sections(spark, sf_dir).select("id", "document_id", "section_index", "heading")
    return s.join(_docs(spark, sf_dir).select(F.col("id").alias("document_id"), "title", "source_type"), "document_id").select("id", "title", "source_type", "section_index", "heading")


def lateral_first_section(spark, sf_dir):
    return k.with_first_section(_docs(spark, sf_dir), _sections(spark, sf_dir)).select("id", "title", "section_id", "heading", "section_index")


def semi_visible(spark, sf_dir):
    """Sections one may see: those of public documents and one's own."""
    return k.visible_children(_sections(spark, sf_dir), table(spark, sf_dir, "knowledge_documents"), ME).select("id", "document_id")


def anti_without_sections(spark, sf_dir):
    return _docs(spark, sf_dir).join(_sections(spark, sf_dir).select(F.col("document_id").alias("id")), "id", "left_anti").select("id", "title")


def list_documents(spark, sf_dir):
    return _docs(spark, sf_dir).orderBy(F.desc("created_at"), "id").limit(200).select("id", "title", "created_at")


def document_with_sections(spark, sf_dir):
    """Every document of one source type with its sections in order."""
    d = _docs(spark, sf_dir).filter("source_type = 'web'").select(F.col("id").alias("document_id"), "title")
    return d.join(_sections(spark, sf_dir), "document_id").select("document_id", "title", "section_index", "heading", F.length("markdown_content").alias("chars"))


def recent_knowledge(spark, sf_dir):
    return k.recent(_docs(spark, sf_dir), _sections(spark, sf_dir), 20).select("document_id", "title", "section_id", "section_index", F.length("content").alias("chars"))


def keyset_page(spark, sf_dir):
    return k.keyset_page(_sections(spark, sf_dir), "4", 100, F.col("embedding").isNull()).select("id", "document_id")


def section_payload(spark, sf_dir):
    p = k.section_payload(_sections(spark, sf_dir), 64)
    return p.select("id", "heading", "markdown_content", F.col("embedding").isNotNull().alias("has_vector"))


def fts_strict_or_shared(spark, sf_dir):
    out = k.search(_docs(spark, sf_dir), _sections(spark, sf_dir), TERMS, 20)
    return out.select("section_id", "document_id", "title", "section_index", "is_section", "shared", F.round("score", 6).alias("score"))


def websearch_matches(spark, sf_dir):
    """Sections that fit a query with a phrase, an exclusion and an alternative."""
    return _sections(spark, sf_dir).filter(k.websearch(F.col("markdown_content"), 'budget "of the" -council or "works council" -vertrag')).select("id")


def union_candidates(spark, sf_dir):
    """Distinct union of the sections that two searches propose."""
    s = _sections(spark, sf_dir).select("id", k.lexemes(F.col("markdown_content")).alias("w"))
    a, b = s.filter(F.array_contains("w", "budget")), s.filter(F.array_contains("w", "council"))
    return a.select("id").union(b.select("id")).distinct()


def union_all_hits(spark, sf_dir):
    s = _sections(spark, sf_dir).select("id", F.lit("section").alias("kind"), F.length("markdown_content").alias("chars"))
    return s.unionByName(_docs(spark, sf_dir).select("id", F.lit("document").alias("kind"), F.length("raw_content").alias("chars")))


def intersect_terms(spark, sf_dir):
    """How many search terms each section shares."""
    want = F.array(*[F.lit(t) for t in TERMS])
    return _sections(spark, sf_dir).select("id", F.size(F.array_intersect(k.lexemes(F.col("markdown_content")), want)).alias("shared")).filter("shared > 0")


def array_except_stopwords(spark, sf_dir):
    drop = F.array(*[F.lit(w) for w in words.STOP_SEARCH])
    w = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(words.WORD), F.lit(0))
    return _docs(spark, sf_dir).select("id", F.array_join(F.sort_array(F.array_except(w, drop)), " ").alias("words"))


def vector_search(spark, sf_dir):
    """Sections above a similarity, joined to their documents."""
    s = _sections(spark, sf_dir).filter("size(embedding) = 64 and forall(embedding, x -> not isnan(x) and abs(x) < 1e30) and exists(embedding, x -> x <> 0)")
    q = s.orderBy("id").select("embedding").first()  # the query vector: one row by key order
    near = r.nearest(s, [float(x) for x in q[0]], 20, "id", threshold=0.1)
    return near.join(s.select("id", "document_id"), "id").join(_docs(spark, sf_dir).select(F.col("id").alias("document_id"), "title"), "document_id").select("id", "title", F.round("similarity", 5).alias("similarity"))


def sections_per_document(spark, sf_dir):
    """Stated and actual numbers of sections."""
    n = _sections(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("section_index").alias("last"))
    d = _docs(spark, sf_dir).join(n.withColumnRenamed("document_id", "id"), "id", "left")
    return d.select("id", "total_sections", F.coalesce("n", F.lit(0)).alias("n"), "last", F.coalesce(F.col("total_sections") != F.coalesce("n", F.lit(0)), F.lit(True)).alias("stale"))


def tags_count(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode("tags").alias("tag"), "source_type").groupBy("tag", "source_type").agg(F.count(F.lit(1)).alias("n"))


def sha256_dups(spark, sf_dir):
    return k.duplicates_by_hash(_docs(spark, sf_dir), "raw_content", "id")


def chunk_context(spark, sf_dir):
    """Forty characters around the first mention of a word."""
    s = _sections(spark, sf_dir).select("id", F.col("markdown_content").alias("text"), (F.locate("budget", F.lower("markdown_content")) - 1).alias("start")).filter("start >= 0")
    return k.context_of(s.withColumn("end", F.col("start") + 6), 40).select("id", "start", "context")


def exploded_payload(spark, sf_dir):
    """Sections of each document as a JSON array, taken apart again by position."""
    s = _sections(spark, sf_dir)
    payload = s.groupBy(F.col("document_id").alias("doc_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "id", "heading"))), lambda x: F.struct(x["heading"].alias("heading"), x["id"].alias("content")))).alias("sections"))
    return k.exploded_payload(payload)


_D = "d AS (SELECT id, arg_max(title, updated_at) AS title, any_value(source_type) AS source_type, any_value(raw_content) AS raw_content, any_value(summary) AS summary, any_value(tags) AS tags, any_value(total_sections) AS total_sections, any_value(created_at) AS created_at, any_value(owner_id) AS owner_id, any_value(is_public) AS is_public FROM knowledge_documents GROUP BY id)"
_S = "s AS (SELECT DISTINCT ON (id) * FROM knowledge_sections)"
_F = "f AS (SELECT DISTINCT ON (document_id) * FROM s ORDER BY document_id, section_index, created_at, id)"
_LEX = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in words.STOP_SEARCH) + "], w)))"
_WANT = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_COS = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"

QUERIES = {f.__name__: f for f in (inner_join_titles, lateral_first_section, semi_visible, anti_without_sections, list_documents, document_with_sections, recent_knowledge, keyset_page, section_payload, fts_strict_or_shared, websearch_matches, union_candidates, union_all_hits, intersect_terms, array_except_stopwords, vector_search, sections_per_document, tags_count, sha256_dups, chunk_context, exploded_payload)}
SQL = {
    "inner_join_titles": f"WITH {_D}, {_S} SELECT s.id, title, source_type, section_index, heading FROM s JOIN d ON d.id = document_id",
    "lateral_first_section": f"WITH {_D}, {_S}, {_F} SELECT d.id, title, f.id AS section_id, heading, section_index FROM d LEFT JOIN f ON f.document_id = d.id",
    "semi_visible": f"WITH {_S} SELECT id, document_id FROM s WHERE EXISTS (SELECT 1 FROM knowledge_documents k WHERE k.id = document_id AND (is_public OR owner_id = '{ME}'))",
    "anti_without_sections": f"WITH {_D} SELECT id, title FROM d WHERE NOT EXISTS (SELECT 1 FROM knowledge_sections WHERE document_id = d.id)",
    "list_documents": f"WITH {_D} SELECT id, title, created_at FROM d ORDER BY created_at DESC, id LIMIT 200",
    "document_with_sections": f"WITH {_D}, {_S} SELECT document_id, title, section_index, heading, length(markdown_content)::INTEGER AS chars FROM d JOIN s ON d.id = document_id WHERE source_type = 'web'",
    "recent_knowledge": f"WITH {_D}, {_S}, n AS (SELECT * FROM d ORDER BY created_at DESC, id LIMIT 20) SELECT n.id AS document_id, title, s.id AS section_id, coalesce(section_index, 0) AS section_index, length(coalesce(markdown_content, summary, left(raw_content, 2000)))::INTEGER AS chars FROM n LEFT JOIN s ON s.document_id = n.id",
    "keyset_page": f"WITH {_S} SELECT id, document_id FROM s WHERE id > '4' AND embedding IS NULL ORDER BY id LIMIT 100",
    "section_payload": f"WITH {_S} SELECT id, left(trim(coalesce(heading, '')), 200) AS heading, left(markdown_content, 20000) AS markdown_content, coalesce(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))), false) AS has_vector FROM s",
    "fts_strict_or_shared": f"""WITH {_D}, {_S}, {_F},
sh AS (SELECT s.id AS section_id, document_id, title, section_index, true AS is_section, len(list_intersect({_LEX.format("concat_ws(' ', heading, markdown_content)")}, {_WANT}))::INTEGER AS shared FROM s JOIN d ON d.id = document_id),
dh AS (SELECT f.id AS section_id, d.id AS document_id, title, coalesce(section_index, 0) AS section_index, false AS is_section, len(list_intersect({_LEX.format("concat_ws(' ', title, summary)")}, {_WANT}))::INTEGER AS shared FROM d LEFT JOIN f ON f.document_id = d.id),
h AS (SELECT * FROM sh WHERE shared > 0 UNION ALL SELECT * FROM dh WHERE shared > 0), m AS (SELECT coalesce(bool_or(shared = 4), false) AS strict FROM h),
c AS (SELECT h.*, CASE WHEN strict THEN 1.0 ELSE shared + shared / (4.0 + shared) END AS score FROM h, m WHERE CASE WHEN strict THEN shared = 4 ELSE shared >= 2 AND (is_section OR section_id IS NULL) END)
SELECT section_id, document_id, title, section_index, is_section, shared, round(score, 6) AS score FROM c
WHERE is_section OR NOT EXISTS (SELECT 1 FROM c x WHERE x.is_section AND x.document_id = c.document_id) ORDER BY c.score DESC, title, section_index, document_id LIMIT 20""",
    "websearch_matches": f"WITH {_S}, l AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(markdown_content, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS l FROM s) SELECT id FROM l WHERE (contains(l, ' budget ') AND contains(l, ' of the ') AND NOT contains(l, ' council ')) OR (contains(l, ' works council ') AND NOT contains(l, ' vertrag '))",
    "union_candidates": f"WITH {_S}, w AS (SELECT id, {_LEX.format('markdown_content')} AS w FROM s) SELECT id FROM w WHERE list_contains(w, 'budget') UNION SELECT id FROM w WHERE list_contains(w, 'council')",
    "union_all_hits": f"WITH {_D}, {_S} SELECT id, 'section' AS kind, length(markdown_content)::INTEGER AS chars FROM s UNION ALL SELECT id, 'document', length(raw_content)::INTEGER FROM d",
    "intersect_terms": f"WITH {_S}, w AS (SELECT id, len(list_intersect({_LEX.format('markdown_content')}, {_WANT}))::INTEGER AS shared FROM s) SELECT * FROM w WHERE shared > 0",
    "array_except_stopwords": f"WITH {_D} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in words.STOP_SEARCH) + "], w)))), ' ') AS words FROM d",
    "vector_search": f"WITH {_D}, {_S}, g AS (SELECT * FROM s WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))), qv AS (SELECT embedding::DOUBLE[] AS q FROM g ORDER BY id LIMIT 1), n AS (SELECT id, document_id, {_COS} AS similarity FROM g, qv WHERE {_COS} > 0.1 ORDER BY similarity DESC, id LIMIT 20) SELECT n.id, title, round(similarity, 5) AS similarity FROM n JOIN d ON d.id = document_id",
    "sections_per_document": f"WITH {_D}, {_S}, n AS (SELECT document_id, count(*) AS n, max(section_index) AS last FROM s GROUP BY 1) SELECT id, total_sections, coalesce(n, 0) AS n, last, coalesce(total_sections <> coalesce(n, 0), true) AS stale FROM d LEFT JOIN n ON document_id = id",
    "tags_count": f"WITH {_D} SELECT tag, source_type, count(*) AS n FROM (SELECT unnest(tags) AS tag, source_type FROM d) GROUP BY ALL",
    "sha256_dups": f"WITH {_D} SELECT sha256(coalesce(raw_content, '')) AS sha256, min(id) AS keep, count(*) AS copies FROM d GROUP BY 1 HAVING count(*) > 1",
    "chunk_context": f"WITH {_S}, p AS (SELECT id, markdown_content AS t, instr(lower(markdown_content), 'budget')::INTEGER - 1 AS start FROM s) SELECT id, start, substring(t, greatest(0, start - 40) + 1, least(length(t), start + 46) - greatest(0, start - 40)) AS context FROM p WHERE start >= 0",
    "exploded_payload": f"WITH {_S} SELECT document_id AS doc_id, row_number() OVER (PARTITION BY document_id ORDER BY section_index, id)::INTEGER AS position, heading, id AS content FROM s",
}
