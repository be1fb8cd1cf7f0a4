import pytest
from brookloom.llm.encoding import DECODERS, garble, garbled, restore

GOOD = [
    "Château Brânel kostet 5 € – „ja“, sagte Æng å; ½ – ¾ ™ © ®, 5 × 3 m ± 2 °C.",
    "SÃO TELMAR, Ýrna, Łaskor, Dvořín, Ñandor, Åsvin",
    "Ελνα και Γέφυρα",
    "Рівне, Гітара, В доме «Старт»",
    "├──┬──┐\n│  │  │\n└──┴──┘",
    "🚚 ok ✓ 汉字 日本",
    "﻿plain",
    "",
]


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_stays(text):
    assert restore(text) == (text, 0, 0)


@pytest.mark.parametrize("decoder", DECODERS[:6])
@pytest.mark.parametrize("text", ["Die Prüfung für größere Übersicht kostet 5 €", "L’été à Málaga: ¿qué pasó? «sí»", "“Keep it”, s'élève à 1 042 CHF"])
def test_round_trip(decoder, text):
    assert restore(garble(text, decoder))[0] == text
    assert restore("Größe bleibt. " + garble(text, decoder))[0] == "Größe bleibt. " + text


def test_twice_and_bytes_and_lost():
    t = "zählte 415 Paletten – „gut“ für 3 €"
    assert restore(garble(garble(t, "cp1252"), "cp1252"))[0] == t
    assert restore("5 \x80 und \x93so\x94")[0] == "5 € und “so”"
    assert restore("f�r") == ("f�r", 0, 1)


def test_frame(spark):
    rows = spark.createDataFrame([(1, "fÃ¼r", "x"), (2, None, "x"), (3, "", "x"), (4, "für", "x"), (5, "a" * 300000 + "Ã©", "x"), (5, "Ã©", "x")], "doc_id long, text string, restored string")
    got = garbled(rows).collect()
    assert sorted((r.doc_id, r.restored, len(r.text)) for r in got) == [(1, 1, 3), (5, 1, 1), (5, 1, 300001)]
    assert garbled(rows.limit(0)).count() == 0


def test_wider_repertoire():
    from brookloom.llm import encoding as e

    for text in ("Tiếng Việt rất khó", "Știință și țară", "CO₂ und H₂O", "Gdańsk", "cost ₹500 ₺20", "a 🤔 b"):
        for d in ("cp1252", "latin-1", "cp850"):
            assert e.restore(e.garble(text, d))[0] == text, (text, d)
    for text in ("Gdańsk", "Tiếng Việt", "H₂O ┌──┐", "Україна «об’єкт»", "x™ Å– y"):
        assert e.restore(text)[1] == 0, text
