"""Broken prompt and response pairs.

Method: the answer is cut into clauses (sentences, list items, blocks). A linear-chain conditional random field tags each clause as
answer, refusal, echo, foreign or unfinished. Its features are the clause's form and place, its likeness to the question, the classes of
its words (CLASSES, alone and together), the share of words that belong to no class, and its words, word pairs and word beginnings,
hashed. No phrase decides: all weights are learned. The share of words that each tag covers then decides on the pair's one defect.
An answer without letter or digit is ``empty`` and has no clauses.

The field is trained from a bounded sample of labelled pairs that this module composes (``training_pairs``, EXAMPLES of them): refusals from
a grammar of their parts, answers from sentences of its own. No row of the data is used for training, so results don't depend on the
data's size or order. Sentences that the grammar doesn't make are held out in the tests.

Defined cases: null content is a blank message; a user message without letter or digit opens no pair; repeated rows of an id count
once, at the earliest created_at; a session of any length is paired by ranges, never in one task; rows without session_id are left
out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm import chats
from brookloom.llm.texts import ALNUM
from brookloom.session import staged

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
EXAMPLES = 6000
#: Hashed word features.
HASHED = 1 << 13

#: Frequent words of each language that are rare in the others.
COMMON = {
    "en": "the of and to is was were for with by at that which has have had from are be will should may not an its it this under after before between until hours people because although said on who what when why how does can you tell me please answer ask",
    "de": "der die das und ist war wurde wurden für mit von dem den des ein eine einen nicht auf zu im um bei nach zwischen weil obwohl bis sich wird soll kann muss durch aus als über siehe uhr wer was wann warum wie welche ich sie bitte",
    "fr": "le les des du et est été une pour avec par dans que qui au aux sur ce cette sont ont après avant entre jusqu car bien il elle se pas selon doit peut quel quelle quand pourquoi quoi vous je veuillez dirige",
    "es": "el los las en y es fue una para con por que del al se su según entre hasta porque aunque desde está han debe puede como más cuál quién cuándo qué cuánto usted donde dirige pregunte son dura",
    "it": "il gli della delle che è sono per con non una dal nel alla perché anche fino questo",
    "pt": "os das dos uma não para com por foi são está até também pelo pela você",
    "nl": "het een niet voor zijn wordt werd naar ook bij deze maar",
}
_LANG = {}
for _l, _ws in COMMON.items():
    for _w in _ws.split():
        _LANG.setdefault(_w, []).append(_l)

#: Names of languages as requests mention them.
NAMED = {
    "en": r"english|englisch|anglais|inglés|ingles",
    "de": r"german|deutsch|allemand|alemán|aleman",
    "fr": r"french|französisch|français|francés|frances",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano",
    "it": r"italian|italienisch|italien|italiano",
    "pt": r"portuguese|portugiesisch|portugais|portugués|portugues",
    "nl": r"dutch|niederländisch|néerlandais|neerlandés|holandés",
}
_ASKS = re.compile(r"\b(?:answer|reply|respond|write|need|antworte\w*|schreib\w*|antwort|répond\w*|répons\w*|écri\w+|contest\w+|respond\w+|respuesta|escrib\w+|in|auf|en)\b", re.I)

#: Words by their part in speaking about the exchange itself, in four languages.
CLASSES = {
    "self": "i me my myself we our us ich mir mich mein meine meinen meiner meinem meinerseits wir uns unser je j moi mon ma mes nous notre m yo me mí mi mis conmigo nos puedo debo prefiero quiero voy niego rechazo lamento siento podré abstengo pienso deseo",
    "able": "can could able allowed permitted may authorised authorized position unable cannot let lets would will kann könnte darf dürfen dürfte möchte mag werde imstande lage befugt erlaubt muss peux puis pourrai pourrais peut autorisé autorisée permis mesure habilité habilitée dois souhaite veux puedo podré podría puede permite permiten permitido autorizado autorizada condiciones debo deseo",
    "not": "not t cannot no never nothing neither nor unable none without nicht kein keine keinen keiner keinerlei nie niemals nichts ne pas n rien jamais aucun aucune no ni nunca nada ningún ninguna tampoco sin",
    "act": "help assist assistance answer answers answering reply respond response discuss discussing say comment speak talk tell share provide give address explain disclose support offer helfen weiterhelfen hilfe beantworten beantwortet beantworte antworten antwort äußern sagen reden sprechen auskunft eingehen mitteilen besprechen geben stellung nehmen erörtern aider aide répondre réponse réponds dire parler aborder discuter fournir donner commenter prononcer évoquer traiter renseigner ayudar ayuda responder contestar respuesta decir hablar comentar tratar dar facilitar opinar abordar pronunciarme informar",
    "decline": "decline declining declined refuse refusing reject pass limits rather prefer abstain withhold stay avoid silent skip drop away ablehnen lehne ablehne verweigern verweigere lieber still schweigen schweige verzichte passen enthalten enthalte aussparen décliner refuser refuse décline préfère préférerais abstiens abstenir taire silence tairai éviter rechazar rechazo declinar declino niego negar prefiero preferiría abstengo abstenerme callar callo evitar",
    "asked": "this that it question questions request requests topic topics subject matter matters such kind sort point das dies diese dieser diesem dazu dabei hierzu hierauf darauf darüber hierüber davon daran frage fragen anfrage anfragen thema themen solche solchen punkt cette ce cela ça ceci demande demandes question questions sujet sujets genre point là y esta este estas estos eso esto ello pregunta preguntas petición solicitud asunto asuntos tema temas tipo",
    "role": "role scope remit human humans person people colleague someone somebody assistant purpose tasks duties bounds outside beyond rules side aufgaben aufgabe mensch menschen person zuständigkeit rolle assistent assistenten kollege kollegin rahmen regeln außerhalb seite bereich rôle humain personne quelqu collègue assistant assistante cadre limites domaine compétence dépasse règles part cometido persona humana humano colega alguien asistente fuera alcance límites normas función papel parte ámbito",
    "regret": "sorry unfortunately afraid regret regrettably apologies apologise thank thanks leider tut leid bedaure bedauere bedauerlicherweise danke entschuldigung désolé désolée malheureusement regrette regrettablement merci navré navrée excuses siento lamento desgracia desgraciadamente lamentablemente gracias perdón disculpe disculpas",
    "you": "you your yours sie ihnen ihr ihre dir dich du vous te votre vos usted ustedes le les te su",
    "offer": "else another instead perhaps please contact understand understanding hope mind anything sonst noch bitte wenden verständnis anderes stelle vielleicht autre veuillez contacter adressez compréhension chose souhaitez peut être plutôt algo más otro otra consulte diríjase comprensión favor quizá tal vez",
    "source": "sources source excerpt excerpts file files document documents record records list quelle quellen auszug auszüge dokument dokumente unterlagen datei dateien extrait extraits fichier fichiers fuente fuentes extracto extractos documento documentos archivo archivos",
}
_CLASS: dict[str, int] = {}
for _k, (_c, _ws) in enumerate(CLASSES.items()):
    for _w in _ws.split():
        _CLASS[_w] = _CLASS.get(_w, 0) | 1 << _k
_BIT = {c: 1 << k for k, c in enumerate(CLASSES)}
#: Classes that mean more together.
TOGETHER = (("self", "not", "act"), ("self", "not", "able"), ("not", "act", "asked"), ("not", "able", "act"), ("decline", "self"), ("decline", "asked"), ("decline", "act"), ("role", "asked"), ("role", "self"), ("not", "act", "role"), ("regret", "not"), ("source", "not"))

_QUOTED = re.compile(r"«(?:[^«»\n]|«[^«»\n]*»)*»|“(?:[^“”\n]|“[^“”\n]*”)*”|„[^“”\n]*[“”]|\"[^\"\n]*\"")
_JOINED = chr(0x2060)  # stands for a blank inside a quotation: it ends no sentence there and no cue is read across it
_LABEL = re.compile(r"\s*\[(?:Doc:[^\]\n]*|S\d+|\d+)\]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+(?=[^\s])")
_MARK = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])(?:\s+|$)")
_FENCE = re.compile(r"^\s*```", re.M)
_ENDS = re.compile(r"[.!?…。][\"'”’»“)\]*_`]*$")
_LIGHT = {"de", "del", "of", "le", "la", "el", "der", "den", "am", "on", "d", "du", "von", "al", "the", "and", "und", "et", "y", "chf", "eur", "usd", "per", "pro", "par"}
_MONTHS = set(
    "january february march april may june july august september october november december januar februar märz april mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in ALNUM.findall(text)]


def votes(words: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for w in words:
        for lang in _LANG.get(w, ()):
            out[lang] = out.get(lang, 0.0) + 1.0 / len(_LANG[w])
    return out


def languages_of(question: str) -> tuple[str | None, set[str]]:
    """The question's own language, and all in which it may be answered."""
    v = votes(words_of(question))
    if "¿" in question or "¡" in question:
        v["es"] = v.get("es", 0) + 2
    own = max(sorted(v), key=v.get) if v else None
    allowed = {own} if own else set()
    if _ASKS.search(question):
        allowed |= {lang for lang, names in NAMED.items() if re.search(rf"\b(?:{names})\b", question, re.I)}
    return own, allowed


def clauses(answer: str) -> list[tuple[str, str]]:
    """(kind, text) of the clauses in order; kind is sentence, item, numbered or block. Complete labels are not clauses."""
    out: list[tuple[str, str]] = []
    block: list[str] | None = None
    for line in answer.split("\n"):
        if line.lstrip().startswith("```"):
            if block is None:
                block = [line]
            else:
                out.append(("block", "\n".join([*block, line])))
                block = None
            continue
        if block is not None:
            block.append(line)
            continue
        line = _QUOTED.sub(lambda m: m.group().replace(" ", _JOINED), _LABEL.sub("", line).strip())
        if not line:
            continue
        quoted = line.startswith(">")
        mark = _MARK.match(line)
        kind = "sentence" if not mark else "numbered" if mark.group().strip()[0].isdigit() else "item"
        body = line[mark.end() :] if mark else line
        if not body:
            out.append((kind, line))
            continue
        for part in _SENTENCE.split(body):
            if part.strip():
                out.append(("quote" if quoted else kind, part.strip()))
    if block is not None:
        out.append(("block", "\n".join(block)))
    return out


def bare_value(words: list[str], text: str) -> bool:
    """A date, an amount, a name: few words, none of them an ordinary lower-case word."""
    if not words or len(words) > 8 or text.rstrip()[-1] in ",:;&-–(":
        return False
    raw = ALNUM.findall(text)
    return all(w[0].isupper() or w[0].isdigit() or w.lower() in _LIGHT or w.lower() in _MONTHS or w.lower() in ("km", "kg", "h", "min") for w in raw) and raw[-1].lower() not in _LIGHT - {"chf", "eur", "usd"}


FEATURES = [
    *"bias courtesy_after echo echo_last quoted_question lead foreign foreign_clear foreign_only all_foreign own_language last open_end open_block open_label weak_end bare_value_alone item_odd only_mark inside_quote".split(),
    *CLASSES, *("+".join(x) for x in TOGETHER), *"digit plain mostly_plain strange many_strange named alone".split(),
]
_AT = {f: k for k, f in enumerate(FEATURES)}
_MASKS = [sum(_BIT[c] for c in x) for x in TOGETHER]


_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞĀ-Ž]")


@lru_cache(maxsize=1 << 16)
def _known(raw: str) -> tuple[str, int, tuple[str, ...], bool, tuple[int, ...]]:
    """Of a word: lower case, classes, languages, whether it belongs to none, its places among the hashed features (the word if it belongs to
    any, and its beginning; the same in every process)."""
    w = raw.lower()
    mask, langs = _CLASS.get(w, 0), tuple(_LANG.get(w, ()))
    begins = zlib.crc32(b"^" + w[:5].encode()) % HASHED
    return w, mask, langs, not mask and not langs, (zlib.crc32(w.encode()) % HASHED, begins) if mask or langs else (begins,)


def _lexical(known: list[tuple]) -> np.ndarray:
    """Hashed features of a clause: words, their beginnings, neighbours that both belong to a class."""
    out = {h for k in known for h in k[4]}
    out.update(zlib.crc32(f"{x[0]} {y[0]}".encode()) % HASHED for x, y in zip(known, known[1:]) if x[1] and y[1])
    return np.fromiter(out, dtype=np.int64, count=len(out))


def _votes(known: list[tuple]) -> dict[str, float]:
    out: dict[str, float] = {}
    for k in known:
        for lang in k[2]:
            out[lang] = out.get(lang, 0.0) + 1.0 / len(k[2])
    return out


def features(question: str, answer: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A row of features, the hashed features and the number of words of each clause."""
    parts = clauses(answer)
    q = words_of(question)
    qset = set(q)
    own, allowed = languages_of(question)
    fences = len(_FENCE.findall(answer))
    tail = answer.rstrip()
    open_label = tail.rfind("[") > tail.rfind("]")
    X = np.zeros((len(parts), len(FEATURES)))
    size = np.zeros(len(parts))
    lexical = []
    refused = False
    items = [t for k, t in parts if k == "item"]
    # (all words, those outside quotations, their votes) of each clause
    seen = []
    for kind, text in parts:
        known = [_known(x) for x in ALNUM.findall(text)]
        plain = [] if kind in ("block", "quote") else [_known(x) for x in ALNUM.findall(_QUOTED.sub(" ", text))] if _QUOTED.search(text) else known
        seen.append((known, plain, _votes(plain)))
    whole: dict[str, float] = {}
    for _, _, v in seen:
        for x, n in v.items():
            whole[x] = whole.get(x, 0.0) + n
    all_foreign = own is not None and max([n for x, n in whole.items() if x not in allowed], default=0) >= 2 * max([whole.get(x, 0) for x in allowed], default=0) + 1
    for i, (kind, text) in enumerate(parts):
        f: dict[str, float] = {"bias": 1}
        known, plain, v = seen[i]
        w = [k[0] for k in known]
        size[i] = len(w)
        last = i == len(parts) - 1
        lexical.append(_lexical(known) if kind not in ("block", "quote") else np.zeros(0, dtype=np.int64))
        if kind != "block":
            f["inside_quote"] = len(plain) < 0.3 * len(w)
            held = 0
            for k in plain:
                held |= k[1]
            for c, bit in _BIT.items():
                f[c] = bool(held & bit)
            for x, m in zip(TOGETHER, _MASKS):
                f["+".join(x)] = held & m == m
            strange = sum(k[3] for k in known)
            f["digit"] = bool(_DIGIT.search(text))
            f["plain"] = bool(w) and strange <= 0.1 * len(w)
            f["mostly_plain"] = bool(w) and strange <= 0.3 * len(w)
            f["strange"], f["many_strange"] = strange >= 2, strange >= 4
            f["named"] = any(_CAPITAL.match(x) for x, k in zip(ALNUM.findall(text)[1:], known[1:]) if k[3])
            f["alone"] = len(parts) == 1
            f["courtesy_after"] = bool(held & _BIT["offer"]) and refused
            refused |= bool(f["plain"] and held & (_BIT["decline"] | _BIT["not"] | _BIT["role"]))
            if w and q:
                head, colon, rest = text.partition(":")
                said = words_of(rest) if colon and 0 < len(words_of(head)) <= 5 and words_of(rest) else w  # after a short lead-in
                inside = sum(1 for x in said if x in qset) / len(said)
                named = text.endswith("?") and all(x in qset for x in w)  # the subject alone, asked back
                joined, asked = " ".join(w), " ".join(q)
                f["echo"] = named or inside >= 0.95 and (len(set(said) & qset) >= 0.6 * len(qset) or (len(w) >= 3 and joined in asked and not bare_value(w, text)))
                f["quoted_question"] = not f["echo"] and len(q) >= 4 and asked in joined
            f["lead"] = text.endswith(":") and len(w) <= 5 and not last
            good, bad = max([v.get(x, 0) for x in allowed], default=0), max([n for x, n in v.items() if x not in allowed], default=0)
            f["own_language"] = good > bad
            f["foreign"] = own is not None and bad > good
            f["foreign_clear"] = own is not None and bad >= good + 2
            f["foreign_only"] = own is not None and bad >= 1.5 and not good
            f["all_foreign"] = all_foreign
        f["last"] = last
        f["echo_last"] = last and bool(f.get("echo"))
        if last:
            f["open_block"] = fences % 2
            f["open_label"] = open_label
            f["only_mark"] = kind in ("item", "numbered") and not w or bool(_MARK.fullmatch(text))
            bare = text.strip("*_`> ")
            if kind not in ("item", "block"):
                alone = len(parts) == 1 and bare_value(w, bare)
                f["bare_value_alone"] = alone
                f["open_end"] = not alone and not _ENDS.search(bare)
            elif kind == "item":
                commas = [t.count(",") for t in items[:-1]]
                f["item_odd"] = not _ENDS.search(bare) and bool(commas) and text.count(",") < min(commas)
            f["weak_end"] = kind != "block" and (bool(bare) and (bare[-1] in ",:;&-–(" or (not _ENDS.search(bare) and bool(w) and w[-1] in _LANG and w[-1] not in _MONTHS)))
        for name, x in f.items():
            if x:
                X[i, _AT[name]] = x
    return X, lexical, size


# --- the field --------------------------------------------------------------------------------------------------------------------


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _scores(X: np.ndarray, lexical: list[np.ndarray], W: np.ndarray, H: np.ndarray) -> np.ndarray:
    return X @ W + np.array([H[x].sum(0) for x in lexical])


def _gradient(E: np.ndarray, y: np.ndarray, T: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of one sequence by its scores and transitions, by the forward-backward algorithm."""
    n, k = E.shape
    A, B = np.zeros((n, k)), np.zeros((n, k))
    A[0] = E[0]
    for t in range(1, n):
        A[t] = E[t] + _logsumexp(A[t - 1][:, None] + T, 0)
    for t in range(n - 2, -1, -1):
        B[t] = _logsumexp(T + (E[t + 1] + B[t + 1])[None, :], 1)
    z = _logsumexp(A[-1], 0)
    gold = np.zeros((n, k))
    gold[np.arange(n), y] = 1
    gE = gold - np.exp(A + B - z)
    gT = np.zeros((k, k))
    for t in range(n - 1):
        gT[y[t], y[t + 1]] += 1
        gT -= np.exp(A[t][:, None] + T + (E[t + 1] + B[t + 1])[None, :] - z)
    return gE, gT


#: Which tags words speak for; an echo and a broken end are matters of form.
_WORDED = np.array([1.0, 1.0, 0.0, 1.0, 0.0])
Weights = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(pairs: list[tuple[str, str, list[int]]], rounds: int = 5, rate: float = 0.2, decay: float = 1e-4, seed: int = 3, without: tuple[str, ...] = ()) -> Weights:
    """Weights, hashed weights and transitions by stochastic gradient ascent with adaptive steps. The hashed ones move half as fast, so classes
    carry what they can. ``without``: features left out, for ablations ("hashed" for all hashed ones)."""
    off = [_AT[f] for f in without if f in _AT]
    data = []
    for q, a, y in pairs:
        X, lexical, _ = features(q, a)
        X[:, off] = 0
        if len(X) == len(y) and len(y):
            data.append((X, lexical, np.array(y)))
    W, H, T = np.zeros((len(FEATURES), len(TAGS))), np.zeros((HASHED, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    sW, sH, sT = np.full_like(W, 1e-6), np.full_like(H, 1e-2), np.full_like(T, 1e-6)
    r = random.Random(seed)
    for _ in range(rounds):
        r.shuffle(data)
        for X, lexical, y in data:
            gE, gT = _gradient(_scores(X, lexical, W, H), y, T)
            gW = X.T @ gE - decay * W
            gT -= decay * T
            sW += gW**2
            sT += gT**2
            W += rate * gW / np.sqrt(sW)
            T += rate * gT / np.sqrt(sT)
            if "hashed" not in without:
                for x, g in zip(lexical, gE):
                    sH[x] += (g * _WORDED) ** 2
                    H[x] += 0.5 * rate * g * _WORDED / np.sqrt(sH[x]) - decay * H[x]
    return W, H, T


def decode(E: np.ndarray, T: np.ndarray) -> list[int]:
    """The best tags by scores and transitions (Viterbi)."""
    best, back = E[0], []
    for e in E[1:]:
        s = best[:, None] + T
        back.append(s.argmax(0))
        best = s.max(0) + e
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


#: Sentences for training: questions, answers, courtesy, lead-ins, bare values.
SEED = {
    "en": {
        "q": ["Who should I ask about the archive?", "How do I request a new form from finance?", "Can you help me with the plan of Tarno?", "What happened to the job list?", "Which risks does the file plan.md name?", "Who runs the north depot?", "When will the new archive be opened in Tarno?", "How much does the ferry ticket cost?", "Why was the meeting with Orlan Ltd moved?", "Can you name the main risks of Project Selka?"],
        "a": ["The depot is run by Mira Holt since 2019.", "The ticket costs 14.50 EUR in total.", "It was moved because the hall was closed.", "None of the 12 sources names a date for this.", "Staff in Tarno may use the hall for up to 40 hours per week.", "I can't see the newest list, but the last file is clear.", "Sorry for the late reply.", "Unfortunately the plan changed once.", "Version 3.2 of the form adds a second page and removes 4 old fields."],
        "c": ["Is there anything else I can do?", "Please ask a person in charge instead.", "Perhaps we can pick another topic."],
        "l": ["You asked:", "Your question:", "So the question is:"],
        "v": ["14 May 2024", "12,300 EUR", "Mira Holt", "2024-05-14"],
    },
    "de": {
        "q": ["Wen soll ich zum Archiv fragen?", "Wie beantrage ich ein neues Formular?", "Kannst du mir bei Projekt Selka helfen?", "Was ist mit der Liste in Tarno passiert?", "Was ist der Termin von Vorhaben Selka?", "Wer leitet das Lager im Norden?", "Wann wird das neue Archiv in Tarno eröffnet?", "Wie viel kostet die Fahrkarte für die Fähre?", "Warum wurde das Treffen mit Orlan GmbH verlegt?", "Welche Risiken hat Projekt Selka?"],
        "a": ["Das Lager wird seit 2019 von Mira Holt geleitet.", "Die Karte kostet insgesamt 14,50 EUR.", "Es wurde verlegt, weil der Saal geschlossen war.", "Keine der 12 Quellen nennt dazu ein Datum.", "In Tarno öffnet der Saal um 08:30 Uhr, freitags um 10:00 Uhr.", "Die Liste kann ich nicht öffnen, der Text sagt aber genug.", "Leider wurde der Plan einmal geändert.", "Version 3.2 des Formulars ergänzt eine Seite und ersetzt 4 alte Felder."],
        "c": ["Kann ich sonst noch etwas tun?", "Bitte wenden Sie sich an eine zuständige Person.", "Vielleicht ein anderes Thema?"],
        "l": ["Deine Frage:", "Du fragst:", "Die Frage lautet:"],
        "v": ["14. Mai 2024", "12.300 EUR", "Mira Holt", "14.05.2024"],
    },
    "fr": {
        "q": ["À qui dois-je m'adresser pour les archives ?", "Comment puis-je demander un nouveau formulaire ?", "Pouvez-vous m'aider pour Projet Selka ?", "Que s'est-il passé avec la liste de Tarno ?", "Pour quelle date le plan doit-il être prêt ?", "Qui dirige le dépôt du nord ?", "Quand les archives de Tarno seront-elles ouvertes ?", "Combien coûte le billet du ferry ?", "Pourquoi la réunion avec Orlan SA a-t-elle été déplacée ?", "Quels sont les risques de Projet Selka ?"],
        "a": ["Le dépôt est dirigé par Mira Holt depuis 2019.", "Le billet coûte 14,50 EUR au total.", "Elle a été déplacée, car la salle était fermée.", "Aucune des 12 sources ne donne de date.", "Le contrat en cite 364, à la demande de Mira Holt, en vue de délais plus courts.", "À Tarno, la salle ouvre à 08:30, le vendredi à 10:00.", "Malheureusement, le plan a changé une fois.", "Désolé pour ce retard.", "La version 3.2 du formulaire ajoute une page et retire 4 anciens champs."],
        "c": ["Puis-je faire autre chose pour vous ?", "Adressez-vous à une personne responsable.", "Parlons d'un autre sujet."],
        "l": ["Vous demandez :", "Votre question :", "La question est donc :"],
        "v": ["14 mai 2024", "12 300 EUR", "Mira Holt", "2024-05-14"],
    },
    "es": {
        "q": ["¿A quién debo preguntar por el archivo?", "¿Cómo pido un formulario nuevo?", "¿Puede ayudarme con Proyecto Selka?", "¿Qué pasó con la lista de Tarno?", "¿Para qué fecha debe estar listo el plan?", "¿Quién dirige el depósito del norte?", "¿Cuándo se abre el nuevo archivo en Tarno?", "¿Cuánto cuesta el billete del ferry?", "¿Por qué fue aplazada la reunión con Orlan SA?", "¿Qué riesgos tiene Proyecto Selka?"],
        "a": ["El depósito lo dirige Mira Holt desde 2019.", "El billete cuesta 14,50 EUR en total.", "Fue aplazada porque la sala estaba cerrada.", "Ninguna de las 12 fuentes da una fecha.", "En Tarno, la sala abre a las 08:30, los viernes a las 10:00.", "Por desgracia, el plan cambió una vez.", "Perdón por el retraso.", "La versión 3.2 del formulario añade una página y elimina 4 campos antiguos."],
        "c": ["¿Puedo hacer algo más?", "Diríjase a una persona responsable.", "Quizá podamos hablar de otro tema."],
        "l": ["Usted pregunta:", "Su pregunta:", "La pregunta es:"],
        "v": ["14 de mayo de 2024", "12.300 EUR", "Mira Holt", "2024-05-14"],
    },
}
#: Refusals by their parts: an opening, a core with its slots, sometimes an ending.
GRAMMAR = {
    "en": {
        "open": ["", "", "I'm sorry, but ", "Sorry, ", "Unfortunately ", "Unfortunately, ", "I am afraid ", "Thanks for the question, but ", "As an assistant, ", "Regrettably, ", "I apologise, but ", "Thank you, but "],
        "core": ["{i} {neg} {act} {obj}", "{i} {neg} {act} {obj}", "{i} {neg} {act} {obj}", "{obj} is {off}", "{obj} is not something {i} can {act} you with", "{obj} is better left to {who}", "{no} will be given by me", "there will be {no} from me", "{i} {down} {obj}", "{i} {down} to {act} {obj}", "my rules do not let me {act} {obj}", "{i} would sooner leave {obj} to {who}", "you should take {obj} to {who}", "it is wiser that {i} do not {act} {obj}", "it is better not to {act} {obj}", "{who} should deal with {obj}, not me", "{obj} belongs to {who}", "{i} keep out of {obj}", "I'll keep silent about {obj}"],
        "i": ["I", "I", "we", "this assistant"], "neg": ["cannot", "can't", "am not able to", "am not allowed to", "will not", "won't", "would rather not", "prefer not to", "am in no position to", "may not", "could not possibly", "do not wish to", "am not permitted to", "shall not"],
        "act": ["help with", "answer", "respond to", "discuss", "comment on", "talk about", "say anything on", "give information about", "provide details on", "share anything on", "speak about", "address", "explain", "assist with", "go into", "get into"],
        "obj": ["this", "that", "it", "this question", "that request", "this topic", "the matter", "such questions", "what you ask", "a request of this kind", "that subject"],
        "off": ["off the table", "outside my scope", "beyond my role", "outside what I can discuss", "not within my remit", "not for me to answer", "against my rules", "not part of my job", "nothing I may speak about"],
        "no": ["no answer", "no reply", "no comment", "no help", "no response"], "down": ["refuse", "decline", "turn down", "pass on", "reject", "abstain from", "must refuse", "have to decline"], "who": ["a human", "a person", "a colleague", "someone in charge", "the people responsible"],
        "end": ["Can I do something else for you?", "Is there another topic I can help with?", "Please contact a person instead.", "I hope for your understanding.", "Let us turn to something else.", "Maybe someone else can help."],
    },
    "de": {
        "open": ["", "", "Tut mir leid, ", "Es tut mir leid, aber ", "Leider ", "Leider: ", "Ich bedaure, ", "Danke für die Anfrage, aber ", "Entschuldigung, ", "Bedauerlicherweise "],
        "core": ["{obj} {mod} ich nicht {act}", "{obj} {mod} ich nicht {act}", "{obj} {mod} ich {down}", "ich {mod} {obj} nicht {act}", "ich {mod} {obj} leider nicht {act}", "{zu} {mod} ich nichts {tell}", "{zu} gebe ich keine {info}", "{zu} gibt es von mir keine {info}", "{zu} {mod} ich {still}", "{obj} ist nicht {mine}", "{obj} liegt außerhalb {scope}", "{obj} sollte {who} übernehmen", "da sollte besser {who} antworten", "ich bin nicht befugt, {obj} zu {act}", "ich bin nicht in der Lage, {obj} zu {act}", "von meiner Seite kommt {zu} keine {info}", "ich verzichte {zu} auf eine {info}", "ich enthalte mich {zu}", "bei {dat} kann ich nicht helfen", "auf {obj} gehe ich nicht ein"],
        "obj": ["das", "dies", "diese Frage", "diese Anfrage", "so etwas", "dieses Thema", "solche Fragen"], "dat": ["dieser Frage", "diesem Thema", "so etwas", "solchen Anfragen"], "mod": ["kann", "darf", "möchte", "werde", "will", "muss", "mag"], "act": ["beantworten", "besprechen", "erörtern", "kommentieren", "behandeln", "klären"],
        "down": ["ablehnen", "verweigern", "zurückweisen", "abweisen"], "zu": ["dazu", "hierzu", "zu dieser Frage", "zu diesem Thema", "darüber"], "tell": ["sagen", "mitteilen", "erzählen", "beitragen"], "info": ["Auskunft", "Antwort", "Angaben", "Stellungnahme", "Hilfe"], "still": ["schweigen", "lieber schweigen", "nicht reden", "nicht sprechen", "nicht Stellung nehmen"], "mine": ["meine Aufgabe", "mein Bereich", "für mich gedacht", "meine Sache"], "scope": ["meiner Rolle", "meines Rahmens", "meiner Zuständigkeit"], "who": ["ein Kollege", "eine Kollegin", "eine Person", "jemand anderes", "ein Mensch"],
        "end": ["Kann ich etwas anderes für Sie tun?", "Ich bitte um Ihr Verständnis.", "Bitte fragen Sie eine andere Stelle.", "Vielleicht geht es um ein anderes Thema.", "Wenden Sie sich bitte an einen Menschen."],
    },
    "fr": {
        "open": ["", "", "Désolé, ", "Je suis désolée, mais ", "Malheureusement, ", "Merci, mais ", "Merci pour la question, mais ", "Je regrette, ", "Navré, ", "Excusez-moi, mais "],
        "core": ["je ne {mod} pas {act} {obj}", "je ne {mod} pas {act} {obj}", "je ne suis pas {allowed} à {act} {obj}", "je ne suis pas en mesure de {act} {obj}", "je {down} de {act} {obj}", "je {prefer} ne pas {act} {obj}", "je {prefer} ne rien dire {sur}", "je ne dirai rien {sur}", "je n'ai pas le droit de {act} {obj}", "il n'y aura pas de réponse {sur}", "aucune réponse ne viendra de moi {sur}", "{subj} {off}", "{subj} n'est pas de mon ressort", "{subj} doit être traité par {who}", "c'est à {who} de répondre", "il vaut mieux en parler à {who}", "mieux vaut {act} {obj} avec {who}", "je m'abstiens de {act} {obj}", "je garde le silence {sur}", "je dois {downinf} {demand}", "je {down2} {demand}"],
        "mod": ["peux", "puis", "pourrai", "veux", "souhaite", "dois"], "act": ["répondre à", "traiter", "discuter", "commenter", "aborder", "évoquer", "donner des détails sur", "parler de"], "obj": ["cela", "ceci", "cette question", "cette demande", "ce sujet", "ce point", "ce genre de question"], "allowed": ["autorisé", "autorisée", "habilité"], "down": ["refuse", "décide", "préfère éviter"], "prefer": ["préfère", "préférerais", "dois"], "sur": ["à ce sujet", "là-dessus", "sur ce point", "sur cette question", "à propos de cela"], "subj": ["cela", "ce sujet", "cette demande", "ce genre de demande"], "off": ["sort de mon cadre", "est hors de mes limites", "ne fait pas partie de mes tâches", "dépasse mes compétences", "n'entre pas dans mon rôle"], "who": ["une personne", "un humain", "un collègue", "quelqu'un d'autre"], "downinf": ["refuser", "décliner", "écarter"], "down2": ["refuse", "décline", "écarte"], "demand": ["cette demande", "cette question", "ce sujet"],
        "end": ["Puis-je vous aider pour autre chose ?", "Merci de votre compréhension.", "Veuillez demander à une autre personne.", "Peut-être un autre sujet ?", "Contactez plutôt un responsable."],
    },
    "es": {
        "open": ["", "", "Lo siento, ", "Lo lamento, pero ", "Lamentablemente, ", "Por desgracia, ", "Gracias por la pregunta, pero ", "Disculpe, ", "Perdón, pero ", "Gracias, pero "],
        "core": ["no {mod} {act} {obj}", "no {mod} {act} {obj}", "no {mod} {act} {obj}", "no se me permite {act} {obj}", "no estoy {allowed} para {act} {obj}", "no estoy en condiciones de {act} {obj}", "{prefer} no {act} {obj}", "{prefer} no decir nada {sobre}", "no diré nada {sobre}", "no habrá respuesta de mi parte {sobre}", "{subj} {off}", "{subj} no es asunto mío", "{subj} debe tratarlo {who}", "es mejor que responda {who}", "me abstengo de {act} {obj}", "me niego a {act} {obj}", "guardo silencio {sobre}", "debo {downinf} {demand}", "{down} {demand}", "mis normas no me dejan {act} {obj}"],
        "mod": ["puedo", "podré", "debo", "quiero", "voy a", "pienso", "deseo"], "act": ["responder a", "contestar", "tratar", "comentar", "hablar de", "dar detalles sobre", "opinar sobre", "ayudar con", "abordar"], "obj": ["eso", "esto", "esa pregunta", "esta petición", "este tema", "este asunto", "preguntas así"], "allowed": ["autorizado", "autorizada"], "prefer": ["prefiero", "preferiría"], "sobre": ["sobre eso", "al respecto", "sobre este tema", "sobre esta pregunta"], "subj": ["eso", "este tema", "esa petición", "este tipo de preguntas"], "off": ["queda fuera de mis funciones", "no entra en mi ámbito", "supera mi papel", "está fuera de mis límites", "no forma parte de mis tareas"], "who": ["una persona", "un colega", "alguien responsable", "un humano"], "downinf": ["declinar", "rehusar", "rechazar"], "down": ["rechazo", "declino", "no acepto"], "demand": ["esta petición", "esta pregunta", "este asunto"],
        "end": ["¿Le ayudo con otra cosa?", "Gracias por su comprensión.", "Consulte mejor a una persona.", "Quizá otro tema.", "Hable con alguien responsable, por favor."],
    },
}
#: Answers that speak like refusals and are none.
NEAR = {
    "en": ["The sources do not answer this question.", "There is nothing on this in the excerpts.", "No document says who is responsible.", "I could not find the answer in the files.", "Staff may not discuss prices with visitors.", "Nobody is allowed to enter the hall without a badge.", "Orlan Ltd declined the offer and prefers another date.", "Sorry, the first figure was wrong: it is 412 EUR.", "Thank you for asking: the hall opens at 08:30.", "Unfortunately the depot in Tarno cannot take more orders.", "The team refused to sign form P-12.", "It was moved on 3 May 2024 because nobody was in charge of it.", "This question was answered by Mira Holt on 4 May.", "You can ask Mira Holt instead, who runs the archive.", "I can't open the newest list, but the plan names 3 risks.", "Please contact Mira Holt, who is in charge of Project Selka."],
    "de": ["Die Quellen beantworten diese Frage nicht.", "Dazu steht in den Auszügen nichts.", "Kein Dokument nennt eine zuständige Person.", "In den Dateien habe ich keine Antwort gefunden.", "Besucher dürfen den Saal nicht betreten.", "Orlan GmbH lehnte das Angebot ab und möchte einen anderen Termin.", "Entschuldigung, die erste Zahl war falsch: es sind 412 EUR.", "Danke für die Frage: der Saal öffnet um 08:30 Uhr.", "Leider kann das Lager in Tarno keine Aufträge mehr annehmen.", "Diese Frage hat Mira Holt am 4. Mai beantwortet.", "Es wurde am 3. Mai 2024 verlegt, weil niemand dafür zuständig war.", "Fragen Sie Mira Holt, die das Archiv leitet.", "Bitte wenden Sie sich an Mira Holt, zuständig für Projekt Selka.", "Die neue Liste kann ich nicht sehen, der Plan nennt aber 3 Risiken."],
    "fr": ["Les sources ne répondent pas à cette question.", "Il n'y a rien à ce sujet dans les extraits.", "Aucun document ne nomme la personne responsable.", "Je n'ai pas trouvé la réponse dans les fichiers.", "Les visiteurs ne peuvent pas entrer dans la salle.", "Orlan SA a refusé l'offre et préfère une autre date.", "Désolé, le premier chiffre était faux : c'est 412 EUR.", "Merci de votre question : la salle ouvre à 08:30.", "Malheureusement, le dépôt de Tarno ne peut plus accepter de commandes.", "Mira Holt a répondu à cette question le 4 mai.", "Il a été déplacé le 3 mai 2024, car personne n'en était chargé.", "Elle a été fermée le 9 mars 2023 parce que personne n'était là.", "Demandez à Mira Holt, qui dirige les archives.", "Contactez Mira Holt, responsable de Projet Selka.", "Je ne vois pas la nouvelle liste, mais le plan cite 3 risques."],
    "es": ["Las fuentes no responden a esta pregunta.", "No hay nada sobre eso en los extractos.", "Ningún documento nombra a la persona responsable.", "No he encontrado la respuesta en los archivos.", "Los visitantes no pueden entrar en la sala.", "Orlan SA rechazó la oferta y prefiere otra fecha.", "Perdón, la primera cifra era falsa: son 412 EUR.", "Gracias por la pregunta: la sala abre a las 08:30.", "Por desgracia, el depósito de Tarno no puede aceptar más pedidos.", "Mira Holt respondió a esta pregunta el 4 de mayo.", "Fue movido el 3 de mayo de 2024 porque nadie estaba a cargo.", "Pregunte a Mira Holt, que dirige el archivo.", "Consulte a Mira Holt, responsable de Proyecto Selka.", "No puedo ver la nueva lista, pero el plan cita 3 riesgos."],
}


def refusal(r: random.Random, lang: str) -> str:
    g = GRAMMAR[lang]
    text = r.choice(g["core"])
    while m := re.search(r"\{(\w+)\}", text):
        text = text[: m.start()] + r.choice(g[m.group(1)]) + text[m.end() :]
    text = r.choice(g["open"]) + text
    return text[0].upper() + text[1:] + "."


REQUESTS = {"en": "Please answer in {}.", "de": "Bitte auf {} antworten.", "fr": "Répondez en {}, s'il vous plaît.", "es": "Responda en {}, por favor."}
REQUESTED = {"en": {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}, "de": {"en": "Englisch", "de": "Deutsch", "fr": "Französisch", "es": "Spanisch"}, "fr": {"en": "anglais", "de": "allemand", "fr": "français", "es": "espagnol"}, "es": {"en": "inglés", "de": "alemán", "fr": "francés", "es": "español"}}


def training_pairs(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, list[int]]]:
    """Composed pairs with the tag of every clause."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lang = r.choice(list(SEED))
        s = SEED[lang]
        q = r.choice(s["q"])
        body = [r.choice(s["a"] if r.random() < 0.7 else NEAR[lang]) for _ in range(r.randint(1, 4))]
        shape = r.choice(["answer", "answer", "refusal", "copy", "foreign", "asked", "cut", "cut", "value", "list", "list_cut", "label_cut", "block", "block_cut", "echo_answer", "quote", "quote_only", "near", "near", "refusal", "refusal"])
        if shape == "answer":
            a, y = " ".join(body), [ANSWER] * len(body)
            if r.random() < 0.4:
                a += r.choice([" [Doc: plan.md, Chunk: 3]", "[Doc: a.pdf, Chunk: 1][Doc: b.csv, Chunk: 2]"])
        elif shape == "refusal":
            a, y = refusal(r, lang), [REFUSAL]
            if r.random() < 0.3:
                a, y = f"{r.choice([q, q.rstrip('¿?. ').split()[-1] + '?'])} {a}", [ECHO, REFUSAL]
            if r.random() < 0.1:
                a, y = f"{a} {refusal(r, lang)}", [*y, REFUSAL]
            if r.random() < 0.5:
                a, y = f"{a} {r.choice(s['c'] + GRAMMAR[lang]['end'])}", [*y, REFUSAL]
        elif shape == "copy":
            form = r.choice(["{}", "> {}", "**{}**", "{}\n{}", "lead", "bare"])
            if form == "lead":
                a, y = f"{r.choice(s['l'])} {q}", [ECHO]
            elif form == "bare":
                a, y = q.strip("¿?. "), [ECHO]
            else:
                a = form.format(*[q] * form.count("{}"))
                a = a.upper() if form == "**{}**" else r.choice([a, a.lower()])
                y = [ECHO] * form.count("{}")
        elif shape in ("foreign", "asked"):
            other = r.choice([x for x in SEED if x != lang])
            body = [r.choice([t for t in SEED[other]["a"]]) for _ in range(r.randint(1, 3))]
            a, y = " ".join(body), [FOREIGN] * len(body)
            if shape == "asked":
                q, y = f"{q} {REQUESTS[lang].format(REQUESTED[lang][other])}", [ANSWER] * len(body)
        elif shape == "cut":
            words = r.choice(s["a"]).split()
            cut = " ".join(words[: r.randint(2, max(2, len(words) - 2))]).rstrip(".,")
            cut += r.choice(["", ",", ""]) if r.random() < 0.7 else " " + r.choice({"en": ["because the", "the"], "de": ["weil die", "der"], "fr": ["car les", "le"], "es": ["porque el", "la"]}[lang])
            lead = " ".join(body[: r.randint(0, 2)])
            a = f"{lead} {cut}".strip()
            y = [ANSWER] * (len(clauses(a)) - 1) + [UNFINISHED]
            if bare_value(words_of(clauses(a)[-1][1]), clauses(a)[-1][1]):
                continue
        elif shape == "value":
            a, y = r.choice(s["v"]), [ANSWER]
        elif shape in ("list", "list_cut"):
            dash = r.random() < 0.5
            rows = [f"- {r.choice(('Item', 'Old shelf', 'North hall'))}, {r.choice(('Selka', 'Tarno 4', 'Mira Holt'))}" for _ in range(r.randint(2, 4))] if dash else [f"{k + 1}. {t}" for k, t in enumerate(body)]
            y = [ANSWER] * (1 + len(rows))
            if shape == "list_cut":
                rows[-1] = "- Item" if dash else f"{len(rows)}. {' '.join(rows[-1].split()[1:4]).rstrip('.')}"
                if r.random() < 0.3:
                    rows[-1] = "-" if dash else f"{len(rows)}."
                y[-1] = UNFINISHED
            a = body[0] + "\n\n" + "\n".join(rows)
        elif shape == "label_cut":
            a, y = " ".join(body) + r.choice([" [Doc: plan.md, Chunk:", " [Doc: plan.md", " [Doc:"]), None
            y = [ANSWER] * (len(clauses(a)) - 1) + [UNFINISHED]
        elif shape in ("block", "block_cut"):
            a = body[0] + '\n\n```json\n{\n "x": 5,\n "code": "A-1"\n}\n```'
            y = [ANSWER, ANSWER if shape == "block" else UNFINISHED]
            if shape == "block_cut":
                a = a[: -r.randint(4, 20)]
        elif shape == "echo_answer":
            a, y = f"{q} {body[0]}", [ECHO, ANSWER]
        elif shape in ("quote", "quote_only"):
            other = r.choice([x for x in SEED if x != lang])
            a, y = f"{body[0]} «{r.choice(SEED[other]['a'])}»", [ANSWER, ANSWER]
        else:
            lines = [r.choice(NEAR[lang]), *body[: r.randint(0, 2)]]
            a, y = " ".join(lines), [ANSWER] * len(lines)
        out.append((q, a, y))
    return out


@lru_cache(maxsize=1)
def model() -> Weights:
    return fit(training_pairs())


def defect(question: str, answer: str | None, weights: Weights) -> str | None:
    """The pair's defect, from the words that the tags cover."""
    if answer is None or not ALNUM.search(answer):
        return "empty"
    X, lexical, size = features(question, answer)
    if not len(X):  # labels alone
        return "truncated" if answer.rstrip().rfind("[") > answer.rstrip().rfind("]") else None
    W, H, T = weights
    tags = decode(_scores(X, lexical, W, H), T)
    cover = np.zeros(len(TAGS))
    aside = X[:, [FEATURES.index("lead"), FEATURES.index("inside_quote")]].any(axis=1)
    aside &= not aside.all()
    for t, n, skip in zip(tags, size, aside):
        cover[t] += 0 if skip else max(n, 1)
    if tags[-1] == UNFINISHED:
        return "truncated"
    if cover[REFUSAL] and not cover[ANSWER] and not cover[FOREIGN]:
        return "refusal"
    if cover[ECHO] and not cover[ANSWER] and not cover[FOREIGN]:
        return "copy"
    return "language" if cover[FOREIGN] > cover[ANSWER] else None


def question_answers(rows: DataFrame) -> DataFrame:
    """(id, question, answer): each user message that holds a letter or digit with the assistant message directly after it."""
    name = F.coalesce("id", F.concat(F.lit("row-"), F.xxhash64("created_at", "role", "content").cast("string")))
    once = (
        rows.filter(F.col("session_id").isNotNull())
        .select("session_id", name.alias("id"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("at"), "role", "content")
        .groupBy("session_id", "id")
        .agg(F.min_by(F.struct("role", "content"), "at").alias("m"), F.min("at").alias("at"))
        .select("session_id", "id", "at", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
        .filter(F.col("role").isin("user", "assistant"))
    )
    placed = staged(chats.ordered(once), "ordered")  # stored once: stretches must be the same on both sides of the join
    inside = Window.partitionBy("session_id", "stretch").orderBy("at", "place", "id")
    here = placed.withColumn("before", F.lag(F.struct("role", "content")).over(inside))
    # the first message of a stretch follows the last one of the stretch before; a session has at most one stretch for each partition
    tails = placed.groupBy("session_id", "stretch").agg(F.max_by(F.struct("role", "content"), F.struct("at", "place", "id")).alias("tail"))
    seam = Window.partitionBy("session_id").orderBy("stretch")
    seams = tails.withColumn("seam", F.lag("tail").over(seam)).filter("seam is not null").select("session_id", "stretch", "seam")
    joined = here.join(seams, ["session_id", "stretch"], "left").withColumn("before", F.coalesce("before", "seam"))
    return joined.filter((F.col("role") == "assistant") & (F.col("before.role") == "user") & F.col("before.content").rlike(r"[\p{L}\p{N}]")).select("id", F.col("before.content").alias("question"), F.col("content").alias("answer"))


def judged(rows: DataFrame) -> DataFrame:
    """(id, defect) of the defective pairs of message rows."""
    weights = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, defect(q, a, weights)) for i, q, a in zip(b["id"], b["question"], b["answer"])]
            yield pd.DataFrame([x for x in out if x[1]], columns=["id", "defect"])

    return question_answers(rows).mapInPandas(run, "id string, defect string")
