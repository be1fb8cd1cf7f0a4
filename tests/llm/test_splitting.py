import random

import pytest
from brookloom.llm.splitting import Limits, oversized, piece_texts, pieces, split
from brookloom.llm.texts import SOLID


def check(text, limits):
    out = split(text, limits)
    words = [m.span() for m in SOLID.finditer(text)]
    if not words:
        assert out == []
        return out
    covered = set()
    for k, (a, b, n, repeated, kind) in enumerate(out):
        assert b - a <= limits.chars and n <= limits.words
        covered.update(range(a, b))
        if k:
            pa, pb, pn, _, _ = out[k - 1]
            assert a > pa and b > pb and (repeated == 0 or a < pb)
            shared = [w for w in words if w[0] >= a and w[1] <= pb]
            assert len(shared) <= limits.overlap
    assert all(i in covered for a, b in words for i in range(a, b))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_any_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "bc", "word", ".", "! ", " ", "  ", "\n", "\n\n", " ", "x" * r.randint(1, 60), "ß😀"]) for _ in range(r.randint(0, 400)))
    check(text, Limits(r.randint(3, 40), r.randint(20, 120), r.randint(0, 8)))


def test_overlap_is_exact():
    text = " ".join(f"w{i}" for i in range(1000))
    out = check(text, Limits(300, 100000, 30))
    assert [p[3] for p in out] == [0, 30, 30, 30] and [p[2] for p in out][:3] == [300, 300, 300]


def test_boundaries_win_in_order():
    text = "One two three. Four five\nsix seven\n\neight nine ten eleven twelve"
    assert split(text, Limits(8, 1000, 0))[0][4] == "paragraph"
    assert split(text, Limits(6, 1000, 0))[0][4] == "line"
    assert split(text, Limits(4, 1000, 0))[0][4] == "sentence"


def test_long_word_and_blank():
    assert split(None, Limits(3, 9)) == [] and split(" \n ", Limits(3, 9)) == []
    out = check("x" * 100, Limits(3, 9, 2))
    assert len(out) >= 12 and out[0][4] == "hard"


def test_frame(spark):
    rows = spark.createDataFrame(
        [("section", "a", "w " * 301, 1), ("section", "a", "w " * 301, 1), ("section", "b", None, 1), ("section", "c", "short", 1), ("document", "a", "x" * 12001, 1), ("section", None, "w " * 400, 1)],
        "kind string, id string, text string, piece int",
    )
    got = {(r.kind, r.id) for r in pieces(rows, oversized_only=True).collect()}
    assert got == {("section", "a"), ("document", "a")}
    assert pieces(rows.limit(0)).count() == 0


def test_repeated_id_with_other_texts(spark):
    long, longer = " ".join(f"a{i}" for i in range(700)), " ".join(f"b{i}" for i in range(900))
    df = spark.createDataFrame([("section", "x", long), ("section", "x", longer), ("section", "x", longer), ("section", "x", "short")], "kind string, id string, text string")
    got = pieces(df).collect()
    assert sorted(r.piece for r in got) == list(range(len(split(longer, Limits(300, 2400)))))
    assert {(r.start, r.end) for r in got} == {p[:2] for p in split(longer, Limits(300, 2400))}
    assert [(r.kind, r.id) for r in oversized(df).collect()] == [("section", "x")]
    assert all("b" in r.text and "a" not in r.text for r in piece_texts(df).collect())
