import pytest
from brookloom.functions import checks as c

SOURCE = """The northern depot of Tarno opened on 4 May 2023 and holds 1,250 pallets. Mira Holt runs the northern depot since 2019.
Energy costs of the depot rose by 12 % to 48,300 EUR in 2024. Visitors may not enter the cold store without a badge.
The fire drill took place before the audit of the cold store. The new scanner handles more parcels than the old scanner.
Das Lager in Tarno wurde nicht verkauft, weil der Vertrag bis 2030 läuft. Die Heizkosten des Lagers sind 2024 gesunken."""
E = c.evidence([SOURCE])

FAITHFUL = [
    "The depot in Tarno opened on 2023-05-04.",
    "The northern depot holds 1250 pallets.",
    "Since 2019 the northern depot is run by Mira Holt.",
    "Energy costs rose by 12% in 2024.",
    "Visitors may not enter the cold store without a badge.",
    "The fire drill took place before the audit.",
    "Das Lager in Tarno wurde nicht verkauft.",
    "Die Heizkosten des Lagers sind gesunken.",
]
CHANGED = [
    ("The northern depot holds 1350 pallets.", "unsupported", "number_missing"),
    ("The depot in Tarno opened on 5 May 2023.", "unsupported", "date_missing"),
    ("Since 2019 the northern depot is run by Nils Berg.", "unsupported", "name_missing"),
    ("Energy costs of the depot fell by 12 % to 48,300 EUR in 2024.", "weak", "direction"),
    ("Visitors may enter the cold store without a badge.", "weak", "negation"),
    ("The fire drill took place after the audit of the cold store.", "weak", "order"),
    ("The new scanner handles fewer parcels than the old scanner.", "weak", "comparison"),
    ("Das Lager in Tarno wurde verkauft.", "weak", "negation"),
    ("Die Heizkosten des Lagers sind 2024 gestiegen.", "weak", "direction"),
    ("The northern depot of Tarno opened on 4 May 2023 and holds 48,300 pallets.", "weak", "misplaced_value"),
    ("Lorries queue daily along several muddy country lanes nearby.", "weak", "few_words"),
]


@pytest.mark.parametrize("text", FAITHFUL)
def test_faithful_statements_stand(text):
    assert c.ground(text, E)[0] == "supported"


@pytest.mark.parametrize("text,verdict,reason", CHANGED)
def test_changes_are_found(text, verdict, reason):
    got = c.ground(text, E)
    assert got[0] == verdict and reason in got[1]


def test_unchecked_and_edges():
    assert [c.ground(t, E)[0] for t in ("", "Who runs it?", "So be it.", "## Costs")] == ["unchecked"] * 4
    assert c.ground("It costs 700 EUR.", c.evidence([None, ""]))[0] == "unsupported"


def test_frame(spark):
    rows = [(1, FAITHFUL[1], [SOURCE]), (2, CHANGED[0][0], [SOURCE]), (3, None, [SOURCE]), (4, CHANGED[0][0], None)]
    got = {r.id: (r.verdict, r.reasons) for r in c.grounded(spark.createDataFrame(rows, "id long, text string, sources array<string>"), "id", "text", "sources").collect()}
    assert got[1] == ("supported", []) and got[2][0] == "unsupported" and got[4][0] == "unsupported" and set(got) == {1, 2, 4}
