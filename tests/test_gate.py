import random
import time

import pytest
from brookloom.functions import cuts
from brookloom.functions import gate as g

SOURCES = {"[S1]": "The hall holds 1,250 people and cost 4.5 million EUR in 2023. Form P-861 is needed. About twelve staff work there.", "[S2]": "Der Umbau kostete zweihundertfünfzig Franken je Platz, also 48 % mehr."}


@pytest.mark.parametrize(
    "word,n",
    [("zweiundzwanzig", 22), ("dreihundertfünfzig", 350), ("zwölftausend", 12000), ("hundert", 100), ("einundneunzig", 91), ("zweihundertfünfunddreißigtausendvierhundert", 235400), ("tausendeins", 1001), ("haus", None), ("undzwanzig", None), ("zweizwei", None), ("einundzwei", None)],
)
def test_german_numbers(word, n):
    assert g.german_number(word) == n


@pytest.mark.parametrize(
    "text,want",
    [
        ("twenty-three people", [(23, True)]),
        ("one hundred and five", [(105, True)]),
        ("two thousand three hundred", [(2300, True)]),
        ("a million euros", [(1_000_000, True)]),
        ("three ideas", [(3, False)]),
        ("three days", [(3, True)]),
        ("half of it", [(0.5, True)]),
        ("zwei Millionen Franken", [(2_000_000, True)]),
        ("one two three", [(1, False), (2, False), (3, False)]),
        ("no number here", []),
    ],
)
def test_number_words(text, want):
    assert [(v, c) for _, _, v, c in g.number_words(text)] == want


CASES = [
    ("The hall holds 1250 people [S1].", ""),
    ("The hall holds 1,250 people [S1].", ""),
    ("It holds twelve hundred and fifty people [S1].", ""),
    ("It holds 1,350 people [S1].", "unsupported_number"),
    ("It holds 1250 people.", "unsupported_number"),
    ("A dozen staff work there [S1].", ""),
    ("Thirteen staff work there [S1].", "number_word"),
    ("Use form P-861 [S1].", ""),
    ("Use form P-862 [S1].", "identifier"),
    ("It holds 12 50 people [S1].", "joined"),
    ("See https://example.org for it [S1].", "link"),
    ("See this [S7].", "unknown_source"),
    ("It is 48% more, 250 francs [S2].", ""),
    ("Both hold: 1250 and 250 [S1, S2].", ""),
    ("Nothing is claimed here.", ""),
    ("A tab​bed word [S1].", "chars"),
    ("[S1]", None),
]


@pytest.mark.parametrize("text,reason", CASES)
def test_rules(text, reason):
    index = {k.lower(): g.indexed(v) for k, v in SOURCES.items()}
    j = g.judged(text, index)
    assert (None if j is None else j[0]) == reason


def test_web_segments():
    text = "In all 40 halls were built. Another 50 are planned."
    assert [g.judged(text, {}, segments=[(0, 27)])[0], g.judged(text[:27], {}, segments=[(0, 27)])[0]] == ["web_ungrounded", ""]


def test_units_do_not_depend_on_the_cuts():
    text = "The plan is dated 4.5.2024. Dr. Holt signed it! Who else? See No. 5.\nA new line begins here. End"
    want = [text[a:b] for a, b in cuts.sentences(text)]
    r = random.Random(4)
    for _ in range(30):
        at = sorted(r.sample(range(1, len(text)), 12))
        pieces = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        assert list(g.units(pieces)) == want


def test_time_budgets():
    """80 000 characters are judged within the budgets."""
    index = {k.lower(): g.indexed(v) for k, v in SOURCES.items()}
    line = ("The hall holds 1,250 people and form P-861 is needed [S1]. " * 1400)[:80_000]

    def best(f):
        took = []
        for _ in range(4):
            t = time.perf_counter()
            f()
            took.append(time.perf_counter() - t)
        return min(took)

    assert best(lambda: [g.judged(line[a:b], index) for a, b in cuts.sentences(line)]) < 0.5
    for odd in ("12 " * 26_000, "a-1-" * 20_000, "zweiund" * 11_000, "one hundred and " * 5_000, "[S1" * 26_000, "1.1.1." * 13_000):
        assert best(lambda odd=odd: g.judged(odd[:80_000], index)) < 1.0
