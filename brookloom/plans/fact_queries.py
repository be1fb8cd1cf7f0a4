"""Facts, verdicts and recurring times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from brookloom.functions import agenda, cuts, facts, structured
from brookloom.session import table


def fact_kinds(spark, sf_dir):
    """Facts of the documents: how many of each kind, and distinct keys."""
    f = facts.extracted(table(spark, sf_dir, "documents"), "doc_id", "text")
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.element_at("keys", 1)).alias("keys"))


def iso_dates(spark, sf_dir):
    """ISO dates in evaluation answers, by key."""
    f = facts.extracted(table(spark, sf_dir, "eval_items"), "item_id", "answer")
    return f.filter(F.col("surface").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("item_id", F.element_at("keys", 1).alias("key"))


def _statements(spark, sf_dir):
    """Sentences of section texts, each to be held against the whole text of its document."""
    s = table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"])
    cut = cuts.exploded(s, "id", "markdown_content", cuts.sentences, "start int, end int")
    texts = s.select("id", "document_id", "markdown_content")
    return cut.join(texts, "id").select(F.concat_ws("#", "id", "start").alias("statement"), "document_id", F.substring(F.col("markdown_content"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def fact_lookup(spark, sf_dir):
    """Facts of section sentences looked up in their document."""
    st = _statements(spark, sf_dir)
    claims = facts.extracted(st, "statement", "text").join(st.select("statement", "document_id"), "statement")
    docs = table(spark, sf_dir, "knowledge_documents").dropDuplicates(["id"]).select(F.col("id").alias("document_id"), "raw_content")
    sources = facts.extracted(docs, "document_id", "raw_content", source=True)
    return facts.looked_up(claims, sources, ["statement"], "document_id")


def verdict_counts(spark, sf_dir):
    """Statements by verdict: supported if all their facts stand in the document, unsupported if one is missing, unchecked without facts."""
    st = _statements(spark, sf_dir)
    found = fact_lookup(spark, sf_dir).groupBy("statement").agg(F.count_if(F.col("found") == "missing").alias("missing"), F.count(F.lit(1)).alias("facts"))
    v = st.join(found, "statement", "left").withColumn("verdict", F.when(F.col("facts").isNull(), "unchecked").when(F.col("missing") > 0, "unsupported").otherwise("supported"))
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def recurrence_next(spark, sf_dir):
    """Occurrences of one rule for each nation over sixty days that hold a clock change."""
    n = table(spark, sf_dir, "nation")
    rules = n.select(
        F.col("n_nationkey").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly")]), F.col("n_nationkey") % 3 + 1).alias("every"),
        F.lit("02:30").alias("at_time"),
        F.array(F.col("n_nationkey") % 7 + 1).alias("days"),
        F.when(F.col("n_nationkey") % 2 == 0, "last").otherwise(F.lit("31")).alias("day"),
        F.lit(None).cast("string").alias("on"),
        F.when(F.col("n_nationkey") % 2 == 0, "Europe/Berlin").otherwise(F.lit("America/New_York")).alias("zone"),
    )
    return agenda.upcoming(rules, datetime(2026, 3, 1), datetime(2026, 4, 30))


def calculator(spark, sf_dir):
    """Prices written as expressions and worked out from the text."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.format_string("%.2f*(1-%.2f)*(1+%.2f)", "l_extendedprice", "l_discount", "l_tax").alias("text"))
    worked = cuts.exploded(lines, "l_orderkey", "text", lambda t: [(structured.calculated(t),)], "price double")
    return worked.groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


def body_schema(spark, sf_dir):
    """Bodies of public samples against the contract of a sample: broken rules and how often."""
    log = table(spark, sf_dir, "event_log").filter((F.col("type") == "feed.sample") & (F.col("class") == "public"))
    schema = {"type": "object", "required": ["series", "value", "quality"], "properties": {"series": {"type": "string", "minLength": 1}, "value": {"type": "number"}, "unit": {"type": "string", "maxLength": 32}, "quality": {"enum": ["good", "uncertain", "bad"]}}}
    return structured.schema_findings(log, "seq", "body", schema).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_ZONES = """r AS (SELECT n_nationkey AS id, ['daily', 'weekly', 'monthly'][n_nationkey % 3 + 1] AS every, n_nationkey % 7 + 1 AS day, n_nationkey % 2 = 0 AS last FROM nation),
d AS (SELECT unnest(generate_series(DATE '2026-02-27', DATE '2026-05-02', INTERVAL 1 DAY))::DATE AS d),
o AS (SELECT id, last, d FROM r, d WHERE CASE every WHEN 'daily' THEN true WHEN 'weekly' THEN isodow(d) = day ELSE day(d) = day(last_day(d)) END)"""

QUERIES = {f.__name__: f for f in (fact_kinds, iso_dates, fact_lookup, verdict_counts, recurrence_next, calculator, body_schema)}
SQL = {
    # 02:30 is skipped on 29 March in Berlin and on 8 March in New York: then the first instant after the jump, 01:00 and 07:00 UTC
    "recurrence_next": f"""WITH {_ZONES}, t AS (SELECT id, d + CASE WHEN last THEN CASE WHEN d = DATE '2026-03-29' THEN INTERVAL 60 MINUTE WHEN d > DATE '2026-03-29' THEN INTERVAL 30 MINUTE ELSE INTERVAL 90 MINUTE END
 ELSE CASE WHEN d = DATE '2026-03-08' THEN INTERVAL 420 MINUTE WHEN d > DATE '2026-03-08' THEN INTERVAL 390 MINUTE ELSE INTERVAL 450 MINUTE END END AS happens FROM o)
SELECT id, happens AS "at" FROM t WHERE happens > TIMESTAMP '2026-03-01' AND happens <= TIMESTAMP '2026-04-30'""",
    "calculator": "SELECT l_orderkey % 100 AS part, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS total FROM lineitem GROUP BY 1",
    "iso_dates": "SELECT item_id, 'd:' || unnest(regexp_extract_all(regexp_replace(answer, '[“„«][^“”„«»\\n]{3,200}?[”“»]', ' ', 'g'), '\\b\\d{4}-\\d{2}-\\d{2}\\b')) AS key FROM eval_items",
}
