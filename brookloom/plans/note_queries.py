"""Queries of notes, names, merges and small expressions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookloom.operators import notes
from brookloom.session import table


def note_rank(spark, sf_dir):
    """Documents as notes: match by contained words, freshness by age, use by citations, spread by sources."""
    d = table(spark, sf_dir, "documents").filter("added_at is not null and text is not null")
    match = sum((F.when(F.lower("text").contains(w), 1).otherwise(0) for w in ("budget", "risk", "audit", "supplier")), F.lit(0))
    labels = F.size(F.regexp_extract_all("text", F.lit(r"\[Doc: "), F.lit(0)))
    m = d.select("doc_id", match.alias("match"), F.to_date("added_at").alias("day"), labels.alias("recalls"), (F.length("text") % 9).alias("days"))
    best = m.agg(F.max("match").alias("best"), F.max("day").alias("now"))
    s = m.crossJoin(F.broadcast(best))  # one row
    score = notes.note_score(F.col("match"), F.col("best"), notes.freshness(F.col("day"), F.col("now"), 30.0), notes.usage(F.col("recalls")), notes.spread(F.col("days")))
    return s.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def memory_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("added_at is not null and text is not null")
    shared = F.when(F.lower("text").contains("budget"), 1.0).otherwise(0.0)
    now = d.agg(F.max(F.to_date("added_at")).alias("now"))
    s = d.crossJoin(F.broadcast(now))  # one row
    score = (0.2 + shared) * notes.freshness(F.to_date("added_at"), F.col("now"), 60.0) * notes.use_weight(F.col("n_chars") / 10.0)
    return s.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def unique_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("title is not null").select("doc_id", F.concat("title", F.lit(".md")).alias("title"))
    return notes.unique_names(d, "title", "doc_id").select("doc_id", "unique")


def citation_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("title is not null").select("doc_id", "title")
    return notes.citations(d, "title", "doc_id").select("doc_id", "label")


def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return notes.put(o, new, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def compare_and_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("rev"))
    new = o.select((F.col("k") + 100).alias("k"), F.lit(2).alias("rev"))
    return notes.compare_and_set(o, new, "k", "rev").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def three_way_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    local = base.filter("c_custkey % 7 <> 0").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, F.concat("v", F.lit("-L"))).otherwise(F.col("v")))
    remote = base.filter("c_custkey % 11 <> 0").withColumn("v", F.when(F.col("c_custkey") % 5 == 0, F.concat("v", F.lit("-R"))).otherwise(F.col("v")))
    return notes.merged(base, local, remote, "c_custkey", "v")


def within_budget(spark, sf_dir):
    """Per customer, the orders that fit a budget, dearest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).alias("rank"), F.col("o_totalprice").cast("bigint").alias("size"))
    return notes.within_budget(o, "o_custkey", "rank", "size", 8, 600_000).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("taken"))


def spreadsheet_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(F.upper("p_name"), "([A-Z]{1,3})", 1).alias("name"))
    return p.select("p_partkey", notes.column_index(F.col("name")).alias("idx"))


def serial_dates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", notes.serial_date((F.col("p_partkey") * 7 % 50000).cast("int")).alias("day"))


def stripped_pii(spark, sf_dir):
    t = F.concat(F.lit("mail a.b"), F.col("c_custkey").cast("string"), F.lit("@example.org from 10.0.0."), (F.col("c_custkey") % 250).cast("string"), F.lit(", call +49 89 123456"), (F.col("c_custkey") % 10).cast("string"), F.lit(" or "), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", notes.stripped_pii(t).alias("text"))


def without_reasoning(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<think>x\ny</think> "), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("x</think>"), "c_name")).otherwise(F.concat("c_name", F.lit("<thinking>open")))
    return c.select("c_custkey", notes.without_reasoning(t).alias("text"))


def revenue_by_nation(spark, sf_dir):
    """A star join: revenue of one region's customers from suppliers of the same nation."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select("c_custkey", "c_nationkey")
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    n = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    j = lines.join(o, "o_orderkey").join(c.join(n, "c_nationkey"), "c_custkey").join(s, ["s_suppkey", "c_nationkey"])
    return j.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


_AGE = "greatest(0, date_diff('day', added_at::DATE, now))"
QUERIES = {f.__name__: f for f in (note_rank, memory_rank, unique_names, citation_numbers, upsert, compare_and_set, three_way_merge, within_budget, spreadsheet_columns, serial_dates, stripped_pii, without_reasoning, revenue_by_nation)}
SQL = {
    "note_rank": f"""WITH m AS (SELECT doc_id, added_at, (CASE WHEN contains(lower(text), 'budget') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'risk') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'audit') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'supplier') THEN 1 ELSE 0 END) AS match,
 len(regexp_extract_all(text, '\\[Doc: ')) AS recalls, length(text) % 9 AS days FROM documents WHERE added_at IS NOT NULL AND text IS NOT NULL), b AS (SELECT max(match) AS best, max(added_at)::DATE AS now FROM m),
s AS (SELECT doc_id, 0.6 * (CASE WHEN best > 0 THEN match / best ELSE 0 END) + 0.2 * pow(0.5::DOUBLE, {_AGE} / 30.0::DOUBLE) + 0.15 * (1 - exp(-recalls / 5.0::DOUBLE)) + 0.05 * least(1.0, days / 7.0::DOUBLE) AS score FROM m, b)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 6) DESC, doc_id LIMIT 50""",
    "memory_rank": f"""WITH n AS (SELECT max(added_at)::DATE AS now FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, (0.2::DOUBLE + CASE WHEN contains(lower(text), 'budget') THEN 1 ELSE 0 END) * pow(0.5::DOUBLE, {_AGE} / 60.0::DOUBLE)
 * (1 + least(1.0::DOUBLE, CASE WHEN n_chars / 10.0 > 1 THEN ln(n_chars / 10.0::DOUBLE) / ln(50.0::DOUBLE) ELSE 0 END)) AS score FROM documents, n WHERE added_at IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 6) DESC, doc_id LIMIT 50""",
    "within_budget": """WITH RECURSIVE o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, trunc(o_totalprice)::BIGINT AS s FROM orders),
t(k, r, room, n) AS (SELECT DISTINCT k, 0::BIGINT, 600000::BIGINT, 0 FROM o UNION ALL SELECT o.k, o.r, CASE WHEN n < 8 AND s <= room THEN room - s ELSE room END, CASE WHEN n < 8 AND s <= room THEN n + 1 ELSE n END FROM t JOIN o ON o.k = t.k AND o.r = t.r + 1)
SELECT k AS o_custkey, max(n)::BIGINT AS taken FROM t GROUP BY k HAVING max(n) > 0""",
    "unique_names": "WITH r AS (SELECT doc_id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY doc_id) AS n FROM documents WHERE title IS NOT NULL) SELECT doc_id, CASE WHEN n = 1 THEN title || '.md' ELSE title || ' (' || n || ').md' END AS \"unique\" FROM r",
    "citation_numbers": "SELECT doc_id, '[Doc: ' || trim(regexp_replace(title, '[\\[\\]\\n]+', ' ', 'g')) || ', Chunk: ' || row_number() OVER (PARTITION BY trim(regexp_replace(title, '[\\[\\]\\n]+', ' ', 'g')) ORDER BY doc_id) || ']' AS label FROM documents WHERE title IS NOT NULL",
    "upsert": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "compare_and_set": "SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN 2 > o.o_orderkey % 5 THEN 'update' ELSE 'refused' END AS outcome, count(*) AS n FROM orders x LEFT JOIN orders o ON o.o_orderkey = x.o_orderkey + 100 GROUP BY 1",
    "three_way_merge": """WITH x AS (SELECT c_custkey AS k, c_mktsegment AS b, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '-L' ELSE c_mktsegment END END AS l,
 CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '-R' ELSE c_mktsegment END END AS r FROM customer),
h AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN 'same' WHEN l IS NOT DISTINCT FROM b THEN 'remote' WHEN r IS NOT DISTINCT FROM b THEN 'local' ELSE 'both' END AS how FROM x)
SELECT k AS c_custkey, CASE how WHEN 'remote' THEN r WHEN 'both' THEN least(l, r) ELSE l END AS v, how FROM h WHERE CASE how WHEN 'remote' THEN r IS NOT NULL WHEN 'both' THEN true ELSE l IS NOT NULL END""",
    "spreadsheet_columns": "WITH p AS (SELECT p_partkey, regexp_extract(upper(p_name), '([A-Z]{1,3})', 1) AS name FROM part) SELECT p_partkey, list_reduce(list_prepend(0, list_transform(string_split(name, ''), lambda c: ascii(c) - 64)), lambda s, c: s * 26 + c)::BIGINT AS idx FROM p",
    "serial_dates": "WITH s AS (SELECT p_partkey, (p_partkey * 7 % 50000)::INTEGER AS n FROM part) SELECT p_partkey, CASE WHEN n = 60 THEN NULL ELSE DATE '1899-12-31' + CASE WHEN n > 60 THEN n - 1 ELSE n END END AS day FROM s",
    "stripped_pii": "SELECT c_custkey, 'mail [mail] from [ip], call [phone] or ' || c_name AS text FROM customer",
    "without_reasoning": "SELECT c_custkey, c_name AS text FROM customer",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
}
