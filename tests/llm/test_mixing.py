from brookloom.llm import mixing


def frames(spark):
    docs = [(i, " ".join(["w"] * (i % 90 + 1)), "a", "x") for i in range(2000)]
    docs += [(10000 + i, "one two three four", "b", "x") for i in range(300)]
    docs += [(20000, None, "a", "x"), (20001, " ", "b", "x"), (20002, "x y", None, "x"), (20003, "x y", "other", "x")]
    targets = [("a", 0.5, 2), ("b", 0.3, 3), ("none", 0.2, 4)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


def test_mix(spark):
    docs, targets = frames(spark)
    report = {r.source: r for r in mixing.shares(docs, targets, block=64).collect()}
    own = {"a": sum(i % 90 + 1 for i in range(2000)), "b": 1200, "none": 0}
    assert {k: r.own for k, r in report.items()} == own
    assert [k for k, r in sorted(report.items()) if r.short] == ["b", "none"]
    total = sum(own.values())
    assert abs(report["a"].slots * 64 - 0.5 * total) < 3 * 64
    rows = mixing.mix(docs, targets, block=64).collect()
    placed, used = {}, {}
    for r in rows:
        placed[r.source] = placed.get(r.source, 0) + r.to_token - r.from_token
        used.setdefault((r.doc_id, r["pass"]), []).append((r.from_token, r.to_token))
        assert r["pass"] < {"a": 2, "b": 3}[r.source]
    assert placed == {k: r.placed for k, r in report.items() if r.placed}
    for parts in used.values():  # within a pass no token is used twice
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    by_slot = {}
    for r in rows:
        by_slot[r.slot] = by_slot.get(r.slot, 0) + r.to_token - r.from_token
    assert max(by_slot.values()) == 64


def test_low_discrepancy(spark):
    _, targets = frames(spark)
    report = targets.selectExpr("*", "640000L as total")
    slots = sorted(mixing.schedule(report, 64).collect(), key=lambda r: r.slot)
    seen = {}
    for k, r in enumerate(slots):
        assert r.slot == k and r["rank"] == seen.get(r.source, 0)
        seen[r.source] = seen.get(r.source, 0) + 1
        assert abs(seen.get("a", 0) - 0.5 * (k + 1)) < 6


def test_empty(spark):
    docs, targets = frames(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert all(not r.short and r.placed == 0 for r in mixing.shares(docs.limit(0), targets).collect())


def test_tokenizer(spark):
    docs, targets = frames(spark)
    n = mixing.sized(docs, targets, "/opt/tokenizers/byte_bpe_50k.tiktoken").groupBy("source").sum("tokens").collect()
    assert {r.source for r in n} == {"a", "b"}
