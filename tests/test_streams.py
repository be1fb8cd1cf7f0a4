from datetime import datetime, timedelta

from brookloom.operators import ledger
from brookloom.streaming import event_log as e
from brookloom.streaming import late_events as late
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def log_of(spark, rows):
    data = [(n, s, d, t, T0 + timedelta(minutes=h), T0 + timedelta(minutes=r), "x") for n, (s, d, t, h, r) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, source string, dedupe string, type string, happened timestamp_ntz, recorded timestamp_ntz, first string")


def test_periods_close_by_source(spark):
    rows = [("a", "1", "t", 1, 2), ("a", "2", "t", 3, 14), ("b", "3", "t", 4, 24), ("b", "4", "t", 5, 800), ("a", "5", "t", 12, 16), ("b", "5", "t", 13, 26)]
    rows += [("a", "1", "t", 1, 99)]  # a repeat counts once
    log = log_of(spark, rows)
    got = {(r.start_us // 60_000_000 - 28401120): (r.first, r.corrections, r.final, r.too_late) for r in late.period_figures(log).collect()}
    assert got[0] == (2, 1, 3, 1) and got[10] == (1, 1, 2, 0)
    # with time to wait, the period is open until b passed its bound at minute 24
    waiting = {(r.start_us // 60_000_000 - 28401120): (r.first, r.closed_us // 60_000_000 - 28401120) for r in late.period_figures(log, idle_timeout_s=1200).collect()}
    assert waiting[0] == (3, 24)
    # a source with a wider bound holds the period longer
    wide = late.period_figures(log, bounds={"b": 900}).collect()
    assert max(r.closed_us - r.end_us for r in wide) == 900 * 1_000_000


def test_each_source_up_to_its_own_punctuation(spark):
    # a passes the end of the first period at minute 16; b, silent until minute 200, is idle by then, and what it brings is late
    rows = [("a", "1", "t", 1, 2), ("b", "2", "t", 3, 15), ("a", "3", "t", 4, 16), ("b", "4", "t", 5, 200), ("a", "5", "t", 12, 24), (None, "6", "t", 2, 3)]
    got = {(r.start_us // 60_000_000 - 28401120): (r.first, r.corrections, r.closed_us // 60_000_000 - 28401120) for r in late.source_figures(log_of(spark, rows), idle_timeout_s=1200).collect()}
    assert got == {0: (3, 2, 35), 10: (1, 0, 45)}
    # without punctuations nothing is late
    still = late.punctuations
    try:
        late.punctuations = lambda *a: still(*a).limit(0)
        assert [(r.first, r.corrections) for r in late.source_figures(log_of(spark, rows)).orderBy("start_us").collect()] == [(5, 0), (1, 0)]
    finally:
        late.punctuations = still


def test_diverted_by_the_punctuation_of_the_source(spark):
    # b's bound is wider: its events are on time up to minute 25, those of a up to minute 15 only, with or without b
    rows = [("a", "1", "t", 1, 2), ("a", "2", "t", 2, 16), ("b", "3", "t", 3, 16), ("b", "4", "t", 4, 26), (None, "5", "t", 5, 30), (None, "6", "t", 5, 15), ("\0", "6", "t", 5, 31)]
    rows += [("a", "7", "u", 6, 4000), ("c", "8", "u", 7, 800), ("a", "1", "t", 1, 99)]  # beyond the cut-off, the first arrival of c too; a repeat
    log = log_of(spark, rows)
    log = log.unionByName(log.filter("seq = 0").withColumn("dedupe", F.lit("9")).withColumn("recorded", F.lit("9999-01-01 00:00:00").cast("timestamp_ntz")))
    bounds = {"b": 900}
    out = late.source_diverted(log, bounds=bounds).collect()
    got = sorted((r.source or "-", r.type, r.late_us // 60_000_000, r.counts) for r in out if r.late_us < 10**15)
    assert got == [("\0", "t", 21, True), ("-", "t", 20, True), ("a", "t", 6, True), ("a", "u", 3990, False), ("b", "t", 16, True), ("c", "u", 790, False)]
    assert len(out) == 7 and [r.counts for r in out if r.late_us >= 10**15] == [False]
    # it is what isn't in the first figures, whether the cut-off lies beyond the bound or before it
    for cutoff in (12 * 3600, 600, 0):
        figures = late.source_figures(log, cutoff_s=cutoff, bounds=bounds).agg(F.sum("corrections"), F.sum("too_late"), F.sum("first")).first()
        kept = [r.counts for r in late.source_diverted(log, cutoff_s=cutoff, bounds=bounds).collect()]
        assert (kept.count(True), kept.count(False), 10 - len(kept)) == tuple(figures)


def test_diverted_query_follows_punctuations(spark, tmp_path):
    from brookloom.plans import late_queries

    rows = [("a", "1", "t", 1, 2), ("a", "2", "t", 2, 16), ("b", "3", "t", 3, 15), ("b", "4", "u", 4, 26), (None, "5", "t", 5, 30), ("a", "6", "u", 6, 4000), ("c", "7", "u", 7, 800)]
    log_of(spark, rows).write.parquet(str(tmp_path / "event_log.parquet"))
    query = lambda: sorted((r.type, r.counts, r.n) for r in late_queries.p1_diverted(spark, str(tmp_path)).collect())
    still = late.punctuations
    try:
        assert query() == [("t", True, 2), ("u", False, 2), ("u", True, 1)]
        late.punctuations = lambda *a: still(*a).limit(0)  # without them only the cut-off diverts
        assert query() == [("u", False, 2)]
    finally:
        late.punctuations = still


def test_late_edges(spark):
    log = log_of(spark, [("a", "1", "t", 1, 2), (None, "1", "t", 1, 2), ("a", None, "t", 1, 2), ("a", None, "t", 1, 2)])
    nulls = log.unionByName(log.limit(1).withColumn("happened", F.lit(None).cast("timestamp_ntz")))
    r = late.period_figures(nulls).collect()
    assert len(r) == 1 and r[0].final == 4 and late.rejected(nulls).count() == 1
    r = late.source_figures(nulls).collect()
    assert len(r) == 1 and r[0].final == 4 and late.source_figures(log.limit(0)).count() == 0
    assert late.period_figures(log.limit(0)).count() == 0 and late.diverted(log.limit(0)).count() == 0


def test_stream_of_figures_ends_at_the_batch_figures(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = []
    for i in range(300):
        happened = r.randint(0, 120)
        rows.append((f"s{i % 4}", str(i), r.choice("tu"), happened, happened + r.choice([0, 1, 3, 9, 30, 200, 900])))
    rows.sort(key=lambda x: x[4])
    rows += [(*x[:4], x[4]) for x in rows[:20]]
    rows.sort(key=lambda x: x[4])
    rows += [("s0", "end", "t", 4000, 4000)]
    log = log_of(spark, rows)
    src = str(tmp_path / "in")
    for part in range(4):
        log.filter(f"seq div 85 = {part}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = late.stream_figures(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {}
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault((x.type, x.start_us), {})[x.kind] = x.figure
    want = {(x.type, x.start_us): (x.first, x.final) for x in late.period_figures(log).collect() if x.end_us // 60_000_000 - 28401120 < 3000}
    assert {k: (v["first"], v["final"]) for k, v in got.items() if "final" in v} == want


def test_stream_closes_when_all_sources_passed(spark, tmp_path):
    rows = [("a", "1", "t", 1, 2), ("b", "2", "t", 3, 14), ("a", "3", "t", 4, 16), ("b", "4", "u", 5, 17), ("a", "5", "t", 20, 19), ("a", "6", "t", 2, 40), ("a", "x", "v", 3000, 3000)]
    log = log_of(spark, rows)
    src = str(tmp_path / "in")
    for n in range(len(rows)):
        log.filter(f"seq = {n}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = late.stream_figures(stream, disorder="0 seconds", sources=["a", "b"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.type, r.kind, r.figure) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.start_us // 60_000_000 == 28401120}
    assert got == {("t", "first", 2), ("t", "correction", 3), ("u", "first", 0), ("u", "correction", 1), ("t", "correction", 4), ("t", "final", 4), ("u", "final", 1)}


def test_stream_latest_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", f"{i % 40}", "t", (i * 7) % 50, i) for i in range(90)]
    log = log_of(spark, rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        log.filter(f"seq div 30 = {part}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(e.upsert_latest(out, ["source"], "happened", "seq")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(f"{out}/v2").select("source", "seq").collect()}
    assert got == {tuple(r) for r in e.latest(log, ["source"], "happened", "seq").select("source", "seq").collect()}


def test_throttle_and_rate_limit(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 5, 10, 11, 25)], "k string, at long")
    assert [r["at"] for r in e.throttled(df, "k", "at", 10).orderBy("at").collect()] == [0, 10, 25]
    assert [(r.place, r.allowed) for r in e.rate_limited(df, "k", "at", 2, 12).orderBy("at").collect()] == [(1, True), (2, True), (3, False), (4, False), (1, True)]


def test_topics(spark):
    df = spark.createDataFrame([("a/b",), ("a",), ("a/b/c",), ("$sys/x",)], "t string")
    hits = lambda f: sorted(r.t for r in df.filter(e.topic_matches(f, F.col("t"))).collect())
    assert hits("a/+") == ["a/b"] and hits("a/#") == ["a", "a/b", "a/b/c"] and hits("#") == ["a", "a/b", "a/b/c"] and hits("$sys/#") == ["$sys/x"]


def test_merkle(spark):
    import hashlib

    for n in (1, 2, 3, 5, 8, 13):
        leaves = [hashlib.sha256(bytes([0, k])).digest() for k in range(n)]

        def mth(d):
            if len(d) == 1:
                return d[0]
            k = 1
            while k * 2 < len(d):
                k *= 2
            return hashlib.sha256(b"\x01" + mth(d[:k]) + mth(d[k:])).digest()

        assert ledger.root_of(leaves) == mth(leaves)
        assert all(ledger.verify(leaves[i], ledger.proof_of(leaves, i), mth(leaves)) for i in range(n))
        assert not ledger.verify(b"x" * 32, ledger.proof_of(leaves, 0), mth(leaves))


def test_append_remembers_for_ever(spark, tmp_path):
    rows = [("a", "1", "t", 0, 0), ("a", "2", "t", 0, 5000), ("a", "1", "t", 0, 90_000), ("b", "1", "t", 0, 90_001), ("b", "1", "t", 0, 90_002)]
    log = log_of(spark, rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(5):
        log.filter(f"seq = {n}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(e.append_to(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/*").collect()) == [0, 1, 3]
