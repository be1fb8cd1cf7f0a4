import random
from datetime import datetime, timedelta

from brookloom.llm import chats
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)


def expected(rows):
    """Plain restatement for small tables."""
    best = {}
    for sid, i, role, content, at in rows:
        if sid is not None and ((sid, i) not in best or at < best[sid, i][2]):
            best[sid, i] = (role, content, at)
    out, sessions = set(), {}
    for (sid, i), m in best.items():
        sessions.setdefault(sid, []).append((m[2], {"system": 0, "user": 1, "assistant": 2}[m[0]], i, m))
    for sid, ms in sessions.items():
        seq = [m[3] for m in sorted(ms, key=lambda m: m[:3]) if m[1]]
        if not any(any(c.isalnum() for c in (m[1] or "")) for m in seq):
            out.add((sid, "empty"))
        for k, m in enumerate(seq):
            if m[0] == "user" and (k + 1 == len(seq) or seq[k + 1][0] == "user"):
                out.add((sid, "missing_reply"))
            if m[0] == "assistant" and (k == 0 or seq[k - 1][0] == "assistant"):
                out.add((sid, "broken"))
    return out


def write(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "chat.parquet")
    df = spark.createDataFrame(rows, "session_id string, id string, role string, content string, created_at timestamp_ntz")
    df.withColumn("at", df.role).repartition(files).write.parquet(path)
    return path


def sample(seed, hot=0):
    r = random.Random(seed)
    rows = []
    for s in range(40):
        for k in range(hot if hot and s == 0 else r.randint(1, 8)):
            row = (f"s{s}", f"{s}-{k}", r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["hi", "", None, "…", "a b"]), T0 + timedelta(minutes=r.randint(0, 2000)))
            rows.append(row)
            if r.random() < 0.2:
                rows.append((*row[:4], row[4] + timedelta(minutes=r.randint(0, 9))))
    r.shuffle(rows)
    return rows


def found(spark, path, **options):
    return {(r.session_id, r.reason) for r in chats.reasons(chats.verdicts(chats.run(spark, path, **options))).collect()}


def test_against_restatement(spark, tmp_path):
    rows = sample(1)
    assert found(spark, write(spark, tmp_path, rows)) == expected(rows)


def test_late_rows_over_many_batches_and_hot_session(spark, tmp_path):
    rows = sample(2, hot=600)
    path = write(spark, tmp_path, rows, files=5)
    assert found(spark, path, files_per_batch=1, hot_limit=100, delay="1 minute", gap_ms=60_000) == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(None, "x", "user", "hi", T0), ("only-system", "y", "system", "hi", T0), ("tie", "a", "assistant", "yes", T0), ("tie", "b", "user", "well?", T0), ("no-id", None, "user", "q", T0), ("no-id", None, "assistant", "a", T0)]
    path = write(spark, tmp_path, rows)
    assert found(spark, path) == {("only-system", "empty")}
    got = chats.conversations(chats.run(spark, path), spark.read.parquet(path)).collect()
    assert sorted((r.session_id, r.turn, r.content) for r in got) == [("no-id", 1, "q"), ("no-id", 2, "a"), ("tie", 1, "well?"), ("tie", 2, "yes")]


def test_empty(spark, tmp_path):
    assert found(spark, write(spark, tmp_path, [])) == set()


def lone_fragments(messages):
    """Each message as a fragment of its own, as late rows would come."""
    one = [F.array(c).alias(n) for n, c in (("ids", "id"), ("ats", "at"), ("roles", "role"), ("solids", "solid"))]
    no = F.lit(False)
    return messages.select("session_id", F.lit(True).alias("closed"), no.alias("empty"), no.alias("missing_reply"), no.alias("broken"), F.lit(1).cast("bigint").alias("turns"), F.col("at").alias("began"), *one)


def test_full_buffers_and_freed_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chats, "FULL", 50)
    rows = sample(5, hot=300)
    path = write(spark, tmp_path, rows, files=4)
    frags = chats.run(spark, path, files_per_batch=1, each=20, delay="1 second", gap_ms=1000)
    per = {r.session_id: r["count"] for r in frags.groupBy("session_id").count().collect()}
    assert max(per.values()) > 2 and not frags.filter("not closed").isEmpty()
    assert {(r.session_id, r.reason) for r in chats.reasons(chats.verdicts(frags)).collect()} == expected(rows)


def test_lone_file(spark, tmp_path):
    rows = sample(6)
    part = next(p for p in __import__("pathlib").Path(write(spark, tmp_path, rows)).iterdir() if p.name.endswith(".parquet"))
    lone = tmp_path / "lone.parquet"
    lone.write_bytes(part.read_bytes())
    assert found(spark, str(lone)) == expected(rows)


def test_conversations_over_several_stretches(spark):
    n = 60_000
    k = F.col("k")
    rows = spark.range(n).select(
        F.format_string("s%05d", F.floor(F.col("id") / 6)).alias("session_id"), F.format_string("m%06d", "id").alias("id"), (F.col("id") % 6).alias("k")
    ).select("session_id", "id", F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("content"), F.timestamp_seconds(k * 60).alias("created_at"))
    messages = rows.select("session_id", "id", F.unix_micros("created_at").alias("at"), "role", F.lit(True).alias("solid"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are one stretch
    held = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        assert chats.ordered(messages).select("stretch").distinct().count() > 1
        got = chats.conversations(lone_fragments(messages), rows).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m")).collect()
    finally:
        spark.conf.set(setting, held)
    assert sum(len(r.m) for r in got) == n
    for r in got:
        first = int(r.session_id[1:]) * 6
        assert [(m.turn, m.role, m.content) for m in r.m] == [(t + 1, ("user", "assistant")[t % 2], f"text m{first + t:06}") for t in range(6)]
