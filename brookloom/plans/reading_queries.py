"""Queries of small readings and forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.functions import readings as r
from brookloom.functions import words
from brookloom.plans.retrieval_queries import _TOK
from brookloom.plans.text_queries import _FOLD
from brookloom.session import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "title", "source")


def round_significant(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(r.significant(F.col("l_extendedprice").cast("double"), 3), 4).alias("rounded"))


def approx_prices(spark, sf_dir):
    """Lines whose price is near a round one."""
    x = F.col("l_extendedprice").cast("double")
    return _lines(spark, sf_dir).groupBy(r.approximately(x, F.round(x, -3), 0.01).alias("near")).agg(F.count(F.lit(1)).alias("n"))


def read_values(spark, sf_dir):
    """Quantities written with a decimal comma, a point, a sign, or wrongly, and read again."""
    forms = F.element_at(F.array(F.lit("%d,50"), F.lit(" %d.25 "), F.lit("+%d"), F.lit("%de1"), F.lit("%d,000,1"), F.lit("n/a %d")), (F.col("l_orderkey") % 6 + 1).cast("int"))
    text = F.replace(forms, F.lit("%d"), F.col("l_quantity").cast("int").cast("string"))
    return _lines(spark, sf_dir).select((F.col("l_orderkey") % 6).alias("form"), r.number_of(text).alias("v")).groupBy("form").agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"))


def axis_ends(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(F.col("l_partkey") % 50).agg(F.max(F.col("l_extendedprice").cast("double")).alias("top")).select(F.round("top", 2).alias("top"), r.axis_end(F.col("top")).alias("axis_end"))


def luhn_checks(spark, sf_dir):
    """Event numbers as card numbers: which pass the check."""
    return _events(spark, sf_dir).groupBy(r.card_number(F.format_string("4%015d", "event_id")).alias("passes")).agg(F.count(F.lit(1)).alias("n"))


def token_budgets(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", r.stepped(F.col("value") * 10, 64, 256, 1024).alias("budget"))


def column_names(spark, sf_dir):
    return _lines(spark, sf_dir).select(F.col("l_partkey").cast("bigint").alias("n")).distinct().select("n", r.column_name(F.col("n")).alias("name"))


def size_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", r.size_text(F.octet_length("text").cast("bigint") * F.col("doc_id")).alias("size"))


def run_speeds(spark, sf_dir):
    """Events as runs of a model: waiting time, speed and duration by their values."""
    at = F.unix_millis("ts")
    m = r.speed(at, at + F.col("event_id") % 900, at + F.col("event_id") % 5000, F.col("event_id") % 300)
    return _events(spark, sf_dir).select("event_id", m.alias("m")).select("event_id", "m.first_ms", F.round("m.per_s", 6).alias("per_s"), "m.total_ms")


def read_times(spark, sf_dir):
    """Times of events as text of several forms, read again; a third has no zone and is Berlin time."""
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+0200'"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    )
    return _events(spark, sf_dir).select("event_id", F.date_format(r.time_of(text, "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss").alias("at"))


def local_texts(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", r.local_text(F.col("ts"), "America/New_York").alias("local"))


def written_times(spark, sf_dir):
    w = r.written_forms(F.col("ts"), "Europe/Berlin")
    return _events(spark, sf_dir).select("event_id", F.array_join(w["times"], " ").alias("times"), F.array_join(w["dates"], " ").alias("dates"))


def retry_waits(spark, sf_dir):
    """Headers that give seconds, a date or nonsense."""
    form = F.col("event_id") % 3
    text = F.when(form == 0, (F.col("event_id") % 120).cast("string")).when(form == 1, F.concat(F.lit("Wed, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    now = F.timestamp_seconds(F.unix_seconds("ts") - (F.col("event_id") % 50 - 20))
    return _events(spark, sf_dir).select("event_id", r.retry_after_ms(text, now).alias("wait_ms"))


def demo_signal(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", r.day_wave(F.unix_millis("ts"), 40.0, 7.5).alias("v"))


def derived_titles(spark, sf_dir):
    d = table(spark, sf_dir, "knowledge_documents").dropDuplicates(["id"])
    return d.select("id", F.md5(r.title_of(F.col("raw_content"), F.lit("untitled"))).alias("title"), F.md5(r.first_line(F.col("raw_content"))).alias("line"))


def derived_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "knowledge_documents").dropDuplicates(["id"])
    return d.select("id", r.summary_of(F.col("raw_content")).alias("summary"))


def passage_texts(spark, sf_dir):
    s = table(spark, sf_dir, "knowledge_sections").dropDuplicates(["id"])
    d = table(spark, sf_dir, "knowledge_documents").groupBy(F.col("id").alias("document_id")).agg(F.max_by("title", "updated_at").alias("title"))
    return s.join(d, "document_id").select("id", F.md5(r.passage_text(F.col("title"), F.col("heading"), F.col("markdown_content"))).alias("text"))


def ingest_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(r.ingest_markdown(F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("file")), F.coalesce("text", F.lit("")))).alias("md"))


def quoted_titles(spark, sf_dir):
    """Documents whose text quotes their own title, case and white space aside."""
    return _docs(spark, sf_dir).groupBy(F.coalesce(r.quoted_in(F.col("title"), F.col("text")), F.lit(False)).alias("quoted")).agg(F.count(F.lit(1)).alias("n"))


def series_names(spark, sf_dir):
    """Event types and users as topics, named by a template."""
    topic = F.concat(F.lit("Plant A/"), "event_type", F.lit("/u "), (F.col("user_id") % 20).cast("string"))
    return _events(spark, sf_dir).select(topic.alias("topic")).distinct().select("topic", r.series_name("{1}.{2}..{3}", F.col("topic")).alias("series"))


def greetings(spark, sf_dir):
    """Messages that only greet."""
    m = table(spark, sf_dir, "chat_history").dropDuplicates(["id"])
    t = F.when(F.length("content") % 5 == 0, F.concat(F.lit("Hello there, "), F.left("content", F.lit(9)))).otherwise(F.col("content"))
    return m.groupBy(F.coalesce(r.is_greeting(t), F.lit(False)).alias("greets")).agg(F.count(F.lit(1)).alias("n"))


BOILERPLATE = ["chunk", "quelle", "source", "sources", "document", "dokument"]


def content_token_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.explode(r.content_tokens(F.col("text"), BOILERPLATE)).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def disallowed_characters(spark, sf_dir):
    """First characters outside the set that a released sentence may hold."""
    return _docs(spark, sf_dir).select(r.first_disallowed(F.col("text")).alias("sign")).filter("sign is not null").groupBy("sign").agg(F.count(F.lit(1)).alias("n"))


def browsers(spark, sf_dir):
    agent = F.when(F.col("user_id") % 4 == 0, "Mozilla/5.0 Chrome/126.0 Safari/537.36 Edg/126.0").when(F.col("user_id") % 4 == 1, "Mozilla/5.0 Firefox/127.0").when(F.col("user_id") % 4 == 2, "Mozilla/5.0 Version/17.4 Mobile/15E Safari/604").otherwise("curl/8")
    return _events(spark, sf_dir).groupBy(r.browser_of(agent).alias("browser")).agg(F.count(F.lit(1)).alias("n"))


_NICE = "[" + ", ".join(str(float(x)) for x in r.NICE) + "]"
_SQ = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_STOPS = "[" + ", ".join("'" + w + "'" for w in words.STOP_LOCAL) + "]"
_FILL = "[" + ", ".join("'" + w + "'" for w in r.FILLER) + "]"
_ONCE = "SELECT DISTINCT ON (id) * FROM knowledge_documents"

QUERIES = {f.__name__: f for f in (round_significant, approx_prices, read_values, axis_ends, luhn_checks, token_budgets, column_names, size_texts, run_speeds, read_times, local_texts, written_times, retry_waits, demo_signal, derived_titles, derived_summaries, passage_texts, ingest_texts, quoted_titles, series_names, greetings, content_token_counts, disallowed_characters, browsers)}
SQL = {
    "round_significant": "WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS x FROM lineitem), f AS (SELECT *, power(10.0, floor(log10(abs(x))) - 2) AS f FROM l) SELECT l_orderkey, l_linenumber, round(floor(floor(x / f + 0.5) * f * 1e6 + 0.5) / 1e6, 4) AS rounded FROM f",
    "approx_prices": "WITH l AS (SELECT l_extendedprice::DOUBLE AS x FROM lineitem), p AS (SELECT x, round(x, -3) AS y FROM l) SELECT y <> 0 AND abs(x - y) <= 0.01 * greatest(abs(x), abs(y)) AS near, count(*) AS n FROM p GROUP BY 1",
    "read_values": "SELECT l_orderkey % 6 AS form, count(*) FILTER (WHERE l_orderkey % 6 < 4) AS n, round(sum(CASE l_orderkey % 6 WHEN 0 THEN l_quantity::INTEGER + 0.5 WHEN 1 THEN l_quantity::INTEGER + 0.25 WHEN 2 THEN l_quantity::INTEGER WHEN 3 THEN l_quantity::INTEGER * 10 END)::DOUBLE, 2) AS total FROM lineitem GROUP BY 1",
    "axis_ends": f"WITH t AS (SELECT max(l_extendedprice::DOUBLE) AS top FROM lineitem GROUP BY l_partkey % 50), p AS (SELECT top, power(10.0, floor(log10(top))) AS p FROM t) SELECT round(top, 2) AS top, round(coalesce(list_filter({_NICE}::DOUBLE[], lambda s: s * p >= top)[1], 10.0) * p, 9) AS axis_end FROM p",
    "luhn_checks": "WITH d AS (SELECT list_reverse(list_transform(string_split(printf('4%015d', event_id), ''), lambda c: c::INTEGER)) AS d FROM events), s AS (SELECT list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 0 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END)) AS s FROM d) SELECT s % 10 = 0 AS passes, count(*) AS n FROM s GROUP BY 1",
    "token_budgets": "SELECT event_id, (CASE WHEN value > 0 THEN greatest(256, least(1024, floor(value * 10 / 64)::INTEGER * 64)) ELSE 256 END)::INTEGER AS budget FROM events",
    "column_names": "WITH RECURSIVE p(n, rest, name) AS (SELECT DISTINCT l_partkey::BIGINT, l_partkey::BIGINT, '' FROM lineitem UNION ALL SELECT n, (rest - 1) // 26, chr((65 + (rest - 1) % 26)::INTEGER) || name FROM p WHERE rest > 0) SELECT n, name FROM p WHERE rest = 0",
    "size_texts": "WITH b AS (SELECT doc_id, strlen(text) * doc_id AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1024 ^ 4 THEN printf('%.1f TB', floor(n / 1024.0 ^ 4 * 10 + 0.5) / 10) WHEN n >= 1024 ^ 3 THEN printf('%.1f GB', floor(n / 1024.0 ^ 3 * 10 + 0.5) / 10) WHEN n >= 1024 ^ 2 THEN printf('%.1f MB', floor(n / 1024.0 ^ 2 * 10 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE n || ' B' END AS size FROM b",
    "run_speeds": "WITH m AS (SELECT event_id, event_id % 900 AS first_ms, event_id % 5000 AS total_ms, greatest(0, event_id % 300 - 1) AS rest, greatest(0, event_id % 5000 - event_id % 900) AS d FROM events) SELECT event_id, first_ms, round(CASE WHEN d > 0 AND rest > 0 THEN rest / (d / 1000.0) ELSE 0.0 END, 6) AS per_s, total_ms FROM m",
    "read_times": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime((date_trunc('minute', ts)::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS at FROM events",
    "local_texts": "SELECT event_id, strftime((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS \"local\" FROM events",
    "written_times": "WITH t AS (SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS t FROM events), f AS (SELECT event_id, t, strftime(t, '%H:%M:%S') AS f, strftime(t, '%H:%M') AS s FROM t) SELECT event_id, concat_ws(' ', CASE WHEN NOT ends_with(f, ':00') THEN f END, s, CASE WHEN starts_with(s, '0') THEN s[2:] END) AS times, array_to_string([strftime(t, '%Y-%m-%d'), strftime(t, '%d.%m.%Y')] || CASE WHEN strftime(t, '%-d.%-m.%Y') <> strftime(t, '%d.%m.%Y') THEN [strftime(t, '%-d.%-m.%Y')] ELSE [] END, ' ') AS dates FROM f",
    "retry_waits": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 120 * 1000 WHEN 1 THEN greatest(0, (event_id % 50 - 20) * 1000) END AS wait_ms FROM events",
    "demo_signal": "SELECT event_id, floor((40.0 + 7.5 * sin(epoch_ms(ts) % 86400000 / 86400000.0 * 2 * pi())) * 10 + 0.5) / 10 AS v FROM events",
    "derived_titles": f"""WITH d AS ({_ONCE}), l AS (SELECT id, raw_content, regexp_split_to_array(raw_content, '\\r\\n|\\n|\\r') AS l FROM d),
t AS (SELECT id, raw_content, trim(regexp_replace(list_filter(l, lambda x: regexp_matches(x, '^#\\s+\\S'))[1], '^#\\s+', '')) AS head, trim(regexp_replace(trim(list_filter(l, lambda x: trim(x) <> '')[1]), '^#+', '')) AS first, trim(string_split(trim(raw_content), chr(10))[1]) AS line FROM l)
SELECT id, md5(left(coalesce(head, nullif(first, ''), 'untitled'), 300)) AS title, md5(CASE WHEN length(line) > 60 THEN left(line, 59) || '…' ELSE line END) AS line FROM t""",
    "passage_texts": "WITH s AS (SELECT DISTINCT ON (id) * FROM knowledge_sections), d AS (SELECT id AS document_id, arg_max(title, updated_at) AS title FROM knowledge_documents GROUP BY id), p AS (SELECT s.id, title, coalesce(heading, '') AS h, coalesce(markdown_content, '') AS c FROM s JOIN d USING (document_id)) SELECT id, md5(concat_ws(chr(10), CASE WHEN title <> '' THEN title END, CASE WHEN h <> '' AND h <> trim(regexp_replace(string_split(c, chr(10))[1], '^#+', '')) THEN h END, c)) AS text FROM p",
    "ingest_texts": "SELECT doc_id, md5('# ' || coalesce(title, '') || chr(10) || chr(10) || '## Facts' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '## Metadata' || chr(10) || '- **Source:** ' || coalesce(source, 'file')) AS md FROM documents",
    "quoted_titles": f"SELECT coalesce({_SQ.format('title')} <> '' AND contains({_SQ.format('text')}, {_SQ.format('title')}), false) AS quoted, count(*) AS n FROM documents GROUP BY 1",
    "series_names": "SELECT DISTINCT 'Plant A/' || event_type || '/u ' || user_id % 20 AS topic, 'plant_a.' || lower(event_type) || '.u_' || user_id % 20 AS series FROM events",
    "greetings": f"""WITH m AS (SELECT DISTINCT ON (id) content AS c FROM chat_history), t AS (SELECT lower(trim(CASE WHEN length(c) % 5 = 0 THEN 'Hello there, ' || left(c, 9) ELSE c END)) AS t FROM m)
SELECT coalesce(regexp_matches(t, '{r.GREETS}') AND len(list_filter(regexp_extract_all(regexp_replace(t, '{r.GREETS}', ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w) AND NOT list_contains({_FILL}, w))) = 0, false) AS greets, count(*) AS n FROM t GROUP BY 1""",
    "content_token_counts": "WITH t AS (SELECT unnest(" + _TOK.replace("text", "regexp_replace(text, '(?i)\\[(?:doc|dok|dokument|document|source|quelle)\\s*:[^\\]\\n]{1,300}\\]', ' ', 'g')") + ") AS w FROM documents), f AS (SELECT " + _FOLD.format("w") + " AS token FROM t) SELECT token, count(*) AS n FROM f WHERE token NOT IN (" + ", ".join(f"'{w}'" for w in BOILERPLATE) + ") AND NOT regexp_matches(token, '\\p{N}') GROUP BY token",
    "disallowed_characters": "WITH d AS (SELECT regexp_extract(text, '" + r.disallowed().replace("'", "''") + "') AS sign FROM documents) SELECT sign, count(*) AS n FROM d WHERE sign <> '' GROUP BY sign",
    "browsers": "SELECT CASE user_id % 4 WHEN 0 THEN 'Edge 126' WHEN 1 THEN 'Firefox 127' WHEN 2 THEN 'Safari 17' ELSE 'unknown' END AS browser, count(*) AS n FROM events GROUP BY 1",
}
