from brookloom.functions import readings as r
from brookloom.operators import answer_texts as a
from brookloom.operators import answers as o
from pyspark.sql import functions as F


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_canonical_text(spark):
    t = "# Head\n\n**Bold** and _thin_ ​words here — “quoted”\r\n- item `code`\n> said"
    assert one(spark, a.canonical_text(F.col("t")), t) == 'Head\n\nBold and thin words here - "quoted"\nitem code\nsaid'
    assert one(spark, a.canonical_text(F.col("t")), None) is None and one(spark, a.canonical_text(F.col("t")), "") == ""


def test_personal_data(spark):
    got = one(spark, a.without_personal(F.col("t")), "a@b.org, 4539 1488 0343 6467, 4539 1488 0343 6468, 10.0.0.1, a@b.org")
    assert got.text == "[mail], [card], 4539 1488 0343 6468, [ip], [mail]" and got.kinds == ["mail", "card", "ip"]


def test_spoken_keeps_numbers(spark):
    assert one(spark, a.spoken(F.col("t")), "z. B. 5%") == "zum Beispiel 5 percent"


def test_lines_and_blanks(spark):
    text = "one\ntwo [Doc: a.md, Chunk: 1] x\nthree"
    got = one(spark, a.blanked(F.col("t")), text)
    assert len(got) == len(text) and "[" not in got and got.endswith(" x\nthree")
    p = one(spark, a.line_of(F.col("t"), F.lit(8)), text)
    assert (p.line, p["column"]) == (2, 5)


def test_summary(spark):
    t = "# T\n\n- list\n\nFirst paragraph\nin two lines.\n\nSecond."
    assert one(spark, r.summary_of(F.col("t")), t) == "First paragraph in two lines."
    assert one(spark, r.summary_of(F.col("t"), 14), "A paragraph, that is cut") == "A paragraph …"
    assert one(spark, r.summary_of(F.col("t")), "# only\n- marks") == ""


def test_extraction_and_segments(spark):
    hits = spark.createDataFrame([(1, "The budget rose. The budget rose sharply. None here.", "A"), (2, "A budget plan. The budget rose.", "B")], "rank int, text string, label string")
    got = [(x.place, x.label, x.sentence) for x in o.extracted_answer(hits, ["budget", "rose"], 5).orderBy("place").collect()]
    assert got == [(1, "A", "The budget rose."), (2, "A", "The budget rose sharply."), (3, "B", "A budget plan.")]
    rows = [("g", 1, "abcd", ["u", "v"], [(0, 2, [0]), (2, 4, [1, 5])]), ("g", 2, "  ", ["w"], [(0, 1, [0])]), ("g", 3, "xyz", ["v"], [(1, 3, [0])])]
    web = spark.createDataFrame(rows, "grp string, pos int, text string, sources array<string>, segments array<struct<start:int,end:int,sources:array<int>>>")
    merged = o.merged_answers(web.filter("trim(text) <> ''"), "grp", "pos")
    seg = sorted((x.start, x.end, x.sources) for x in o.shifted_segments(web, merged, "grp", "pos").collect())
    assert seg == [(0, 2, [1]), (2, 4, [2]), (7, 9, [2])]


def test_packs(spark):
    long = "Alpha is one. " * 40 + "The budget is 5. " + "Beta is two. " * 40
    rows = [("q", 1, "short text", ["short text"]), ("q", 2, long, ["The budget is 5.", *["Alpha is one."] * 40]), ("q", 3, None, None), ("q", 4, "x" * 900, ["x" * 900]), ("q", 5, "y" * 900, ["y" * 900]), ("z", 1, "<<<a>>> [[b]]", ["a"])]
    df = spark.createDataFrame(rows, "id string, rank int, text string, ranges array<string>")
    got = {(r.id, r["rank"]): (r.label, r.delivered, r.line) for r in o.packed(df, "id", "rank", "text", "ranges", "small", 1000).collect()}
    assert got["q", 1] == ("[S1]", "full", "[S1] short text") and got["q", 3] == (None, "omitted", None)
    assert got["q", 2][1] == "partial" and "The budget is 5." in got["q", 2][2] and len(got["q", 2][2]) <= 710
    assert got["q", 4][:2] == ("[S3]", "partial") and got["z", 1][2] == "[S1] <a> [b]"
    assert sum(len(v[2]) + 1 for k, v in got.items() if k[0] == "q" and v[2]) <= 1000
    assert [o.pack_size(n) for n in (2_000, 8_000, 100_000)] == ["small", "mid", "large"]
