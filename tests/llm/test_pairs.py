from datetime import datetime, timedelta

import pytest
from brookloom.llm import pairs as p

CASES = [
    ("Who runs the depot?", None, "empty"),
    ("Who runs the depot?", "…\n•", "empty"),
    ("Who runs the depot?", "> Who runs the depot?", "copy"),
    ("Wer leitet das Lager?", "Du fragst: Wer leitet das Lager?", "copy"),
    ("Wer leitet das Lager?", "WER LEITET DAS LAGER", "copy"),
    ("Who runs the depot?", "Who runs the depot? Ada Brix has run it since May.", None),
    ("When does it start?", "12 May 2025", None),
    ("What does it cost?", "1.500 €", None),
    ("Who runs the depot?", "I'm sorry, but I can't help with that. Is there anything else?", "refusal"),
    ("Qui dirige le dépôt ?", "Je préfère ne pas aborder ce sujet.", "refusal"),
    ("Wer leitet das Lager?", "Keine der 9 Quellen nennt dazu einen Namen.", None),
    ("Who runs the depot?", "I am not able to open the photo, yet the text says enough. Ada Brix runs it.", None),
    ("Who runs the depot?", "Das Lager wird seit 2019 von Ada Brix geleitet.", "language"),
    ("Who runs the depot? Please answer in German.", "Das Lager wird seit 2019 von Ada Brix geleitet.", None),
    ("Who runs the depot?", "Ada Brix runs it. «Das Lager wird seit 2019 von ihr geleitet.»", None),
    ("Who runs the depot?", "Ada Brix has run it since 2019, because the", "truncated"),
    ("Who runs the depot?", "Ada Brix runs it. [Doc: a.pdf, Chunk:", "truncated"),
    ("Who runs the depot?", "Ada Brix runs it. [Doc: a.pdf, Chunk: 3]", None),
    ("Who runs the depot?", "Ada Brix runs it.\n\n- North hall, Tarno\n- South hall, Belo", None),
    ("Who runs the depot?", 'Ada Brix runs it.\n\n```json\n{\n "a": 1\n}\n```', None),
    ("Who runs the depot?", 'Ada Brix runs it.\n\n```json\n{\n "a": 1', "truncated"),
    ("Who runs the depot?", "Ada Brix runs it:\n\n1. She has the key.\n2.", "truncated"),
]


@pytest.mark.parametrize("question,answer,want", CASES)
def test_defect(question, answer, want):
    assert p.defect(question, answer, p.model()) == want


def test_held_out_accuracy():
    good = total = 0
    for q, a, y in p.training_pairs(600, seed=77):
        X, lexical, _ = p.features(q, a)
        if len(X) == len(y):
            total += 1
            W, H, T = p.model()
            good += p.decode(p._scores(X, lexical, W, H), T) == y
    assert total > 400 and good / total > 0.97


def test_long_and_odd_texts():
    m = p.model()
    assert p.defect("q?", "word " * 60000 + "end.", m) is None
    assert p.defect("?", "x", m) in (None, "truncated")
    p.defect("a" * 100000, "```" * 1001, m)


def test_frame(spark):
    t = datetime(2025, 1, 1)
    rows = [("s", "1", "user", "Who runs it?", 0), ("s", "2", "assistant", "", 1), ("s", "2", "assistant", "later", 9), ("s", "3", "user", "…", 2), ("s", "4", "assistant", "", 3)]
    rows += [("t", "5", "user", "Who runs it?", 0), ("t", "6", "system", "x", 1), ("t", "7", "assistant", None, 2), (None, "8", "user", "Who?", 0), (None, "9", "assistant", "", 1), ("u", "10", "assistant", "", 1)]
    df = spark.createDataFrame([(s, i, r, c, t + timedelta(minutes=m), "x") for s, i, r, c, m in rows], "session_id string, id string, role string, content string, created_at timestamp_ntz, defect string")
    assert sorted(map(tuple, p.judged(df).collect())) == [("2", "empty"), ("7", "empty")]
    assert p.judged(df.limit(0)).count() == 0


#: Written for this test; the training grammar makes none of them. Some were looked at while the word classes were chosen, so they are no blind test.
HELD_OUT_REFUSALS = {
    "en": ["I have to pass on this question.", "That's not a conversation I'm willing to have.", "You'd be better served by speaking with a colleague about this.", "I don't feel comfortable answering that.", "Nobody will get a reply to that out of me.", "Sorry, it isn't my place to say.", "I would ask you to take this up with a human.", "Let's not go there."],
    "de": ["Darauf kann ich Ihnen keine Antwort geben.", "Hierüber darf ich keine Angaben machen.", "Leider gehört so etwas nicht in meinen Bereich.", "Ich möchte mich aus diesem Thema heraushalten.", "Mir ist nicht erlaubt, darüber zu sprechen.", "Dafür fragen Sie bitte einen Menschen, ich sage dazu nichts.", "Ich fürchte, da bin ich der falsche Ansprechpartner.", "Das überschreitet meine Befugnisse."],
    "fr": ["Je ne répondrai pas à cette question.", "Il m'est interdit d'en parler.", "Ce n'est pas à moi de répondre à cela.", "Je ne souhaite pas m'exprimer sur ce sujet.", "Je préfère laisser cette demande à un collègue.", "Désolé, je ne peux rien dire là-dessus."],
    "es": ["No voy a contestar a esta pregunta.", "No me corresponde responder a eso.", "Sobre este asunto no puedo decir nada.", "Me temo que no puedo ayudarle con esto.", "Prefiero callarme en este punto.", "Eso debería verlo un compañero, yo no respondo."],
}
HELD_OUT_ANSWERS = {
    "en": ["Nobody in Velden may use the printer after 18:00.", "The excerpts are silent on who pays for it.", "Ask Tomas Reuel, the head of the Velden branch.", "It can't be done before 2 June, the plan says.", "Sorry, there are two figures: 40 and 45 pallets."],
    "de": ["Niemand in Velden darf den Drucker nach 18 Uhr benutzen.", "Wer dafür zahlt, lassen die Auszüge offen.", "Vor dem 2. Juni geht es laut Plan nicht.", "Leider gibt es zwei Zahlen: 40 und 45 Paletten.", "Zuständig ist Tomas Reuel von der Filiale Velden."],
    "fr": ["Personne à Velden ne peut utiliser l'imprimante après 18 h.", "Les extraits ne disent pas qui paie.", "Ce n'est pas possible avant le 2 juin, selon le plan.", "Malheureusement, il y a deux chiffres : 40 et 45 palettes."],
    "es": ["Nadie en Velden puede usar la impresora después de las 18 h.", "Los extractos no dicen quién paga.", "Según el plan, no es posible antes del 2 de junio.", "Lamentablemente hay dos cifras: 40 y 45 palés."],
}
ASKED = {"en": "Who pays for the printer in Velden?", "de": "Wer zahlt für den Drucker in Velden?", "fr": "Qui paie l'imprimante de Velden ?", "es": "¿Quién paga la impresora de Velden?"}


def held_out(weights):
    right = [p.defect(ASKED[k], t, weights) == "refusal" for k, ts in HELD_OUT_REFUSALS.items() for t in ts]
    kept = [p.defect(ASKED[k], t, weights) is None for k, ts in HELD_OUT_ANSWERS.items() for t in ts]
    return sum(right) / len(right), sum(kept) / len(kept)


def test_sentences_outside_the_grammar():
    found, kept = held_out(p.model())
    assert found >= 0.85 and kept >= 0.85


def test_ablation():
    """What the word classes and hashed words add: without both, form alone hardly tells a refusal."""
    data = p.training_pairs()
    form = held_out(p.fit(data, without=("hashed", *p.CLASSES, *("+".join(x) for x in p.TOGETHER), "plain", "mostly_plain", "strange", "many_strange", "named", "digit", "courtesy_after")))
    assert min(form) < 0.8
