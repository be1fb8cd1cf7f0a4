"""Queries over the event log, the events table and chat messages, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookloom.session import table
from brookloom.streaming import event_log as e


def _log(spark, sf_dir):
    return table(spark, sf_dir, "event_log")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_events(spark, sf_dir):
    return e.deduplicated(_log(spark, sf_dir)).select("source", "dedupe", "seq", "event_id", "type")


def append_new(spark, sf_dir):
    """Appending the second half of the log to the first: what is new, by type."""
    log = _log(spark, sf_dir)
    half = log.agg(F.expr("max(seq) div 2").alias("half"))
    old = log.crossJoin(F.broadcast(half)).filter("seq <= half").drop("half")  # one row
    new = log.crossJoin(F.broadcast(half)).filter("seq > half").drop("half")
    fresh, dup = e.append(old, new)
    return fresh.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("new")).unionByName(dup.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("duplicate")))


def latest_per_series(spark, sf_dir):
    s = e.feed_samples(_log(spark, sf_dir))
    return e.latest(s, ["source", "series"], "happened", "seq").select("source", "series", "seq", "value", "unit", "quality", "happened")


def sample_problems(spark, sf_dir):
    return e.sample_problems(_log(spark, sf_dir)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def state_changes(spark, sf_dir):
    """Samples whose quality differs from that of the sample before in the series."""
    s = e.feed_samples(_log(spark, sf_dir))
    return e.state_changes(s, ["source", "series"], ["seq"], "quality").select("seq", "source", "series", "before", "quality")


def stale_gaps(spark, sf_dir):
    return e.silences(_events(spark, sf_dir), ["user_id"], "ts", 86_400)


def _dense(spark, sf_dir):
    """The events with their days folded into one and an hour's stretch into a minute, dense enough for windows of 60 seconds to fill."""
    return _events(spark, sf_dir).select("event_id", "event_type", F.timestamp_micros(F.expr("unix_micros(ts) % 86400000000 div 60")).alias("ts"))


def error_rate_60s(spark, sf_dir):
    r = e.error_rates(_dense(spark, sf_dir), "ts", F.col("event_type") == "error", window_s=60, least=20)
    return r.select("event_id", F.col("events"), F.col("failures").cast("bigint").alias("failures"), F.round("rate", 6).alias("rate"))


def breaker_level(spark, sf_dir):
    r = e.error_rates(_dense(spark, sf_dir), "ts", F.col("event_type") == "error", window_s=60, least=20)
    return e.breaker_levels(r, "ts").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "level", "held")


def throttle(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", e.micros("ts").alias("at"))
    return e.throttled(rows, "user_id", "at", 6 * 3_600_000_000)


def rate_limit(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", e.micros("ts").alias("at"))
    return e.rate_limited(rows, "user_id", "at", 3, 24 * 3_600_000_000).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def seq_gaps(spark, sf_dir):
    return e.seq_gaps(_log(spark, sf_dir).filter("type <> 'chat.turn'"))


def event_log_scan(spark, sf_dir):
    """The next page of two types after a position."""
    return _log(spark, sf_dir).filter((F.col("seq") > 500) & F.col("type").isin("breaker.level", "agenda.fired")).orderBy("seq").limit(200).select("seq", "type", "source")


def class_ceiling(spark, sf_dir):
    """Events up to a data class, by type and strictest class seen."""
    rank = F.array_position(F.array(*[F.lit(c) for c in ("public", "personal", "sensitive", "secret")]), F.col("class"))
    log = _log(spark, sf_dir).withColumn("rank", rank).filter("rank <= 3")
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max_by("class", "rank").alias("strictest"))


def topic_filter(spark, sf_dir):
    """Series of the feed as topics: those a subscription takes."""
    t = e.feed_samples(_log(spark, sf_dir)).select(F.replace("series", F.lit("."), F.lit("/")).alias("topic")).distinct()
    return t.filter(e.topic_matches("+/power", F.col("topic")) | e.topic_matches("pump/#", F.col("topic")))


def row_hashes(spark, sf_dir):
    """A hash of each event with its domain and position."""
    text = F.concat_ws("\n", F.lit("event"), F.col("seq").cast("string"), "source", "dedupe", "type", "class", F.coalesce("body", F.lit("")))
    return _log(spark, sf_dir).select("seq", F.sha2(text, 256).alias("hash"))


def median_rate(spark, sf_dir):
    """Exact median of value by user; an error counts as 0."""
    v = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.median(v), 6).alias("median"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("failures"))


def history_rows(spark, sf_dir):
    """Per event type: runs, failures, the last twelve values, the newest successful value."""
    ev = _events(spark, sf_dir)
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = ev.withColumn("n", F.row_number().over(w)).filter("n <= 12")
    trend = last.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts"), F.col("event_id"), F.col("value")))), lambda x: F.format_string("%.2f", x["value"])), " ").alias("trend"))
    totals = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.round(F.median("value"), 6).alias("median"))
    return totals.join(trend, "event_type")


def keep_newest_n(spark, sf_dir):
    """Retention: the newest twenty events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 20").select("event_id", "user_id", "n")


def row_number_rank(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("event_type", "rank", "event_id", "value")


def json_pick(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k >= 50")


def json_paths(spark, sf_dir):
    """Keys of public bodies by type."""
    keys = F.explode(F.json_object_keys("body"))
    return _log(spark, sf_dir).filter("class = 'public' and body like '{%}'").select("type", keys.alias("key")).groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"))


def _messages(spark, sf_dir):
    rows = table(spark, sf_dir, "chat_history").filter("session_id is not null")
    return rows.groupBy("session_id", "id").agg(F.min("created_at").alias("created_at"), F.min_by("role", "created_at").alias("role"), F.min_by("content", "created_at").alias("content"), F.min_by("owner_id", "created_at").alias("owner_id"))


def sibling_nav(spark, sf_dir):
    """Position, count, previous and next message of each message in its session."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    n = Window.partitionBy("session_id")
    return _messages(spark, sf_dir).select("session_id", "id", F.row_number().over(w).alias("position"), F.count(F.lit(1)).over(n).alias("n"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


def first_user_turn(spark, sf_dir):
    m = _messages(spark, sf_dir).filter("role = 'user'")
    return m.groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("content"), F.count(F.lit(1)).alias("questions"))


def conversation_groups(spark, sf_dir):
    """Sessions by age at the newest message of all: today, within seven days, older."""
    s = _messages(spark, sf_dir).groupBy("session_id").agg(F.max("created_at").alias("last"))
    day = s.agg(F.to_date(F.max("last")).alias("today"))
    age = F.datediff("today", F.to_date("last"))
    group = F.when(age <= 0, "today").when(age <= 7, "week").otherwise("older")
    return s.crossJoin(F.broadcast(day)).groupBy(group.alias("age")).agg(F.count(F.lit(1)).alias("n"))  # one row


def owner_sessions(spark, sf_dir):
    """Messages and sessions by owner, with the newest session."""
    m = _messages(spark, sf_dir)
    return m.groupBy("owner_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"), F.max_by("session_id", F.struct("created_at", "id")).alias("newest"))


_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_M = "m AS (SELECT session_id, id, min(created_at) AS created_at, arg_min(role, created_at) AS role, arg_min(content, created_at) AS content, arg_min(owner_id, created_at) AS owner_id FROM chat_history WHERE session_id IS NOT NULL GROUP BY session_id, id)"
_SAMPLES = """j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS b FROM event_log WHERE type = 'feed.sample' AND "class" = 'public'),
s AS (SELECT seq, source, json_extract_string(b, '$.series') AS series, json_extract_string(b, '$.value')::DOUBLE AS value, json_extract_string(b, '$.unit') AS unit, coalesce(json_extract_string(b, '$.quality'), 'good') AS quality, happened FROM j
 WHERE json_extract_string(b, '$.series') IS NOT NULL AND json_extract_string(b, '$.value') IS NOT NULL)"""
_RATES = f"""e AS (SELECT event_id, event_type, epoch_us(ts) % 86400000000 // 60 AS us, make_timestamp(epoch_us(ts) % 86400000000 // 60) AS ts FROM events), r AS (SELECT event_id, ts, count(*) OVER w AS events, count(*) FILTER (WHERE event_type = 'error') OVER w AS failures FROM e
  WINDOW w AS (ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)), q AS (SELECT *, CASE WHEN events >= 20 THEN failures / events END AS rate FROM r)"""

QUERIES = {f.__name__: f for f in (dedup_events, append_new, latest_per_series, sample_problems, state_changes, stale_gaps, error_rate_60s, breaker_level, throttle, rate_limit, seq_gaps, event_log_scan, class_ceiling, topic_filter, row_hashes, median_rate, history_rows, keep_newest_n, row_number_rank, json_pick, json_paths, sibling_nav, first_user_turn, conversation_groups, owner_sessions)}
SQL = {
    "dedup_events": "SELECT source, dedupe, min(seq) AS seq, arg_min(event_id, seq) AS event_id, arg_min(type, seq) AS type FROM event_log GROUP BY source, dedupe",
    "append_new": """WITH h AS (SELECT max(seq) // 2 AS half FROM event_log), n AS (SELECT l.* FROM event_log l, h WHERE seq > half),
f AS (SELECT source, dedupe, min(seq) AS seq, arg_min(type, seq) AS type FROM n WHERE NOT EXISTS (SELECT 1 FROM event_log o, h WHERE o.seq <= half AND o.source = n.source AND o.dedupe = n.dedupe) GROUP BY 1, 2)
SELECT type, count(*) AS n, 'new' AS kind FROM f GROUP BY type UNION ALL SELECT type, count(*), 'duplicate' FROM n WHERE seq NOT IN (SELECT seq FROM f) GROUP BY type""",
    "latest_per_series": f"WITH {_SAMPLES} SELECT source, series, arg_max(seq, (happened, seq)) AS seq, arg_max(value, (happened, seq)) AS value, arg_max(unit, (happened, seq)) AS unit, arg_max(quality, (happened, seq)) AS quality, max(happened) AS happened FROM s GROUP BY source, series",
    "state_changes": f"WITH {_SAMPLES}, l AS (SELECT *, lag(quality) OVER (PARTITION BY source, series ORDER BY seq) AS before FROM s) SELECT seq, source, series, before, quality FROM l WHERE before IS NULL OR before <> quality",
    "stale_gaps": f"WITH {_E}, l AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM e) SELECT user_id, us + 86400000000 AS stale_from, nx AS stale_to FROM l WHERE nx - us > 86400000000",
    "error_rate_60s": f"WITH {_RATES} SELECT event_id, events, failures, round(rate, 6) AS rate FROM q",
    "breaker_level": f"WITH {_RATES}, v AS (SELECT date_trunc('hour', ts) AS h, max(CASE WHEN rate >= 0.8 THEN 3 WHEN rate >= 0.5 THEN 2 WHEN rate >= 0.3 THEN 1 ELSE 0 END) AS level FROM q GROUP BY 1) SELECT strftime(h, '%Y-%m-%d %H') AS hour, level, max(level) OVER (ORDER BY h) AS held FROM v",
    "throttle": "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), k(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY 1 UNION ALL SELECT k.user_id, min(e.us) FROM k JOIN e ON e.user_id = k.user_id AND e.us >= k.us + 21600000000 GROUP BY k.user_id, k.us) SELECT user_id, us AS \"at\" FROM k",
    "rate_limit": "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), k(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY 1 UNION ALL SELECT k.user_id, min(e.us) FROM k JOIN e ON e.user_id = k.user_id AND e.us >= k.us + 86400000000 GROUP BY k.user_id, k.us), n AS (SELECT k.user_id, k.us, count(*) AS n FROM k JOIN e ON e.user_id = k.user_id AND e.us >= k.us AND e.us < k.us + 86400000000 GROUP BY ALL) SELECT user_id, sum(least(n, 3))::BIGINT AS allowed, sum(greatest(n - 3, 0))::BIGINT AS refused FROM n GROUP BY user_id",
    "sample_problems": """WITH s AS (SELECT body, CASE WHEN json_valid(body) THEN body END AS b FROM event_log WHERE type = 'feed.sample' AND "class" = 'public'), p AS (SELECT CASE WHEN body IS NULL THEN 'no body' WHEN b IS NULL THEN 'broken json' WHEN json_extract_string(b, '$.series') IS NULL THEN 'no series' WHEN json_extract_string(b, '$.value') IS NULL THEN 'no value' END AS problem FROM s) SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "seq_gaps": "WITH l AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM event_log WHERE type <> 'chat.turn') SELECT prev AS after, seq - prev - 1 AS missing FROM l WHERE seq > prev + 1",
    "event_log_scan": "SELECT seq, type, source FROM event_log WHERE seq > 500 AND type IN ('breaker.level', 'agenda.fired') ORDER BY seq LIMIT 200",
    "class_ceiling": """WITH r AS (SELECT *, list_position(['public', 'personal', 'sensitive', 'secret'], "class") AS rank FROM event_log) SELECT type, count(*) AS n, arg_max("class", rank) AS strictest FROM r WHERE rank <= 3 GROUP BY type""",
    "topic_filter": f"WITH {_SAMPLES} SELECT DISTINCT replace(series, '.', '/') AS topic FROM s WHERE regexp_matches(series, '^[^.]*[.]power$') OR series = 'pump' OR starts_with(series, 'pump.')",
    "row_hashes": """SELECT seq, sha256(concat_ws(chr(10), 'event', seq::VARCHAR, source, dedupe, type, "class", coalesce(body, ''))) AS hash FROM event_log""",
    "median_rate": "SELECT user_id, round(median(CASE WHEN event_type = 'error' THEN 0.0 ELSE value END), 6) AS median, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id",
    "history_rows": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
t AS (SELECT event_type, string_agg(printf('%.2f', value), ' ' ORDER BY ts, event_id) AS trend FROM l WHERE n <= 12 GROUP BY 1)
SELECT event_type, count(*) AS runs, arg_max(value, (ts, event_id)) AS latest, round(median(value), 6) AS median, any_value(trend) AS trend FROM events JOIN t USING (event_type) GROUP BY event_type""",
    "keep_newest_n": "SELECT event_id, user_id, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20",
    "row_number_rank": "SELECT event_type, rank, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 10",
    "json_pick": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50",
    "json_paths": """SELECT type, key, count(*) AS n FROM (SELECT type, unnest(json_keys(body)) AS key FROM event_log WHERE "class" = 'public' AND body LIKE '{%}' AND json_valid(body)) GROUP BY ALL""",
    "sibling_nav": f"WITH {_M} SELECT session_id, id, row_number() OVER w AS position, count(*) OVER (PARTITION BY session_id) AS n, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM m WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)",
    "first_user_turn": f"WITH {_M} SELECT session_id, arg_min(content, (created_at, id)) AS content, count(*) AS questions FROM m WHERE role = 'user' GROUP BY session_id",
    "conversation_groups": f"WITH {_M}, s AS (SELECT session_id, max(created_at) AS last FROM m GROUP BY 1), d AS (SELECT max(last)::DATE AS today FROM s), g AS (SELECT date_diff('day', last::DATE, today) AS age FROM s, d) SELECT CASE WHEN age <= 0 THEN 'today' WHEN age <= 7 THEN 'week' ELSE 'older' END AS age, count(*) AS n FROM g GROUP BY 1",
    "owner_sessions": f"WITH {_M} SELECT owner_id, count(*) AS messages, count(DISTINCT session_id) AS sessions, arg_max(session_id, (created_at, id)) AS newest FROM m GROUP BY owner_id",
}
