from datetime import UTC, datetime

import pytest
from brookloom.functions import agenda, facts


def keys(text, source=False):
    return [k for f in facts.facts(text, source) for k in f[4]]


@pytest.mark.parametrize(
    "text,key",
    [
        ("It cost 480.000 EUR", "n:480000"), ("It cost 480,000 EUR", "n:480000"), ("um 12,5 %", "n:12.5"), ("1.234,56 EUR", "n:1234.56"), ("0,9 Millionen Stück", "n:900000"),
        ("am 28.08.2026", "d:2026-08-28"), ("on August 28, 2026", "d:2026-08-28"), ("le 28 août 2026", "d:2026-08-28"), ("el 28 de agosto de 2026", "d:2026-08-28"), ("since May 2023", "m:2023-05"), ("am 3. März", "d:--03-03"),
        ("at 2.30 pm", "t:14:30"), ("um 08:15 Uhr", "t:08:15"), ("rule R-02", "c:r02"), ("rule R02", "c:r02"), ("version 4.2.1", "v:4.2.1"), ("he said “keep it simple”", "q:keep it simple"),
    ],
)
def test_keys(text, key):
    assert key in keys(text)


def test_modes():
    assert keys("3 people") == [] and keys("3 %") == ["n:3"]
    assert set(keys("480.000", True)) == {"n:480000", "n:480"} and keys("480.000 EUR") == ["n:480000"]
    assert "n:2026" in keys("28.08.2026", True) and "m:2026-08" in keys("28.08.2026", True)
    assert keys("31.02.2026 ") != ["d:2026-02-31"] and keys("") == []
    assert len(facts.facts("1,2,3," * 20000)) >= 0


def test_lookup(spark):
    c = spark.createDataFrame([("s1", "d", "It cost 480.000 EUR on 28.08.2026."), ("s2", "d", "It cost 99 EUR."), ("s3", "d", None)], "statement string, document_id string, text string")
    s = spark.createDataFrame([("d", "On August 28, 2026 they paid 480,000 EUR.")], "document_id string, text string")
    claims = facts.extracted(c, "statement", "text").join(c.select("statement", "document_id"), "statement")
    got = {(r.statement, r.found) for r in facts.looked_up(claims, facts.extracted(s, "document_id", "text", True), ["statement"], "document_id").collect()}
    assert got == {("s1", "exact"), ("s2", "missing")}


def test_clock_changes():
    assert agenda.instant_of(datetime(2026, 3, 29, 2, 30), "Europe/Berlin") == datetime(2026, 3, 29, 1, 0, tzinfo=UTC)
    assert agenda.instant_of(datetime(2026, 10, 25, 2, 30), "Europe/Berlin") == datetime(2026, 10, 25, 0, 30, tzinfo=UTC)


def test_runs():
    after = datetime(2026, 1, 31, 12, tzinfo=UTC)
    run = lambda **r: [t.isoformat()[:16] for t in agenda.runs(r, after, "UTC", 2)]
    assert run(every="monthly", at="08:00", day=31) == ["2026-02-28T08:00", "2026-03-31T08:00"]
    assert run(every="weekly", at="12:00", days=[6]) == ["2026-02-07T12:00", "2026-02-14T12:00"]
    assert run(every="once", at="08:00", on="2026-01-31") == [] and run(every="hourly", at="08:00") == [] and run(every="daily", at="25:00") == []


def test_more_dates_and_times():
    from brookloom.functions import facts as f

    keys = lambda t, **k: [x[4] for x in f.facts(t, **k)]
    assert keys("on 03/04/2024") == [["d:2024-04-03", "d:2024-03-04"]] and keys("on 25/04/2024") == [["d:2024-04-25"]]
    assert keys("by 04/2025") == [["m:2025-04"]] and keys("am 4.5. kam") == [["d:--05-04"]] and keys("on May 4 it came") == [["d:--05-04"]]
    assert keys("um 14 Uhr") == [["t:14:00"]] and keys("on Monday") == [["w:1"]] and keys("am Dienstag") == [["w:2"]]
    assert keys("in May") == [["m:--05"]] and keys("it may rain") == [] and keys("it may rain", source=True) == [["m:--05"]]
    assert "m:--08" in keys("28 August 2026", source=True)[0]
