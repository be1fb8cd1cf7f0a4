import random

from brookloom.llm import leaks as k


def data():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 12, 15]))), " ".join(r.choice(vocab) for _ in range(r.choice([0, 11, 30, 60])))) for i in range(25)]
    docs = []
    for d in range(300):
        w = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if r.random() < 0.4:
            src = r.choice(items)[1 + (d % 2)].split()
            n = r.randint(8, 25)
            a = r.randint(0, max(0, len(src) - n))
            at = r.randint(0, len(w))
            w[at:at] = src[a : a + n]
        docs.append((d, (", " if d % 3 else "\n").join(w).upper() if d % 5 == 0 else " ".join(w)))
    return items, docs


def truth(items, docs):
    grams = lambda t: {tuple(w[i : i + 12]) for w in [[x.lower() for x in k.ALNUM.findall(t or "")]] for i in range(len(w) - 11)}
    eg = [(i, grams(q) | grams(a)) for i, q, a in items]
    return {(d, i) for d, t in docs for g in [grams(t)] for i, e in eg if g & e}


def test_against_brute_force(spark):
    items, docs = data()
    df = spark.createDataFrame([(*d, "x") for d in [*docs, (900, None), (901, "")]], "doc_id long, text string, item_id string")
    ev = spark.createDataFrame([*items, (99, None, None), (98, "", "short")], "item_id long, question string, answer string")
    got = {(r.doc_id, r.item_id) for r in k.leaks(df, ev, rank=64).filter("kind = 'verbatim'").collect()}
    want = truth(items, docs)
    assert want and got == want
    assert k.leaks(df.limit(0), ev).count() == 0 and k.leaks(df, ev.limit(0)).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(k, "ITEMS", 7)
    items, docs = data()
    got = k.leaks(spark.createDataFrame(docs[:120], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string"), rank=64)
    assert {(r.doc_id, r.item_id) for r in got.filter("kind = 'verbatim'").collect()} == truth(items, docs[:120])


def test_paraphrase(spark):
    item = "The harbour crane of Tarno was repaired in March 2024 by Mira Holt and her crew for 4500 EUR after the storm"
    text = "The old harbour crane of Tarno was finally repaired in March 2024 by Mira Holt and all her crew, for 4500 EUR, soon after the storm"
    df = spark.createDataFrame([(1, text), (2, "Something else entirely that has many words but none of them are shared with it at all")], "doc_id long, text string")
    ev = spark.createDataFrame([(5, "Who?", item)], "item_id long, question string, answer string")
    assert [(r.doc_id, r.item_id, r.kind) for r in k.leaks(df, ev).collect()] == [(1, 5, "paraphrase")]


def test_lcs():
    assert k.lcs_length([1, 2, 3, 4], [2, 9, 4, 1]) == 2 and k.lcs_length([], [1]) == 0


def rewritten(r, words, vocab, share):
    out = []
    for w in words:
        x = r.random()
        if x < share / 3:
            continue
        out += [r.choice(vocab)] if x < 2 * share / 3 else [w, r.choice(vocab)] if x < share else [w]
    return out


def test_paraphrases_against_all_pairs(spark):
    """Candidates of the latent search against the longest common subsequence of every pair."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(1500)]
    items = [(i, "", " ".join(r.choice(vocab) for _ in range(r.randint(20, 60)))) for i in range(30)]
    docs = []
    for d in range(300):
        w = [r.choice(vocab) for _ in range(r.randint(20, 90))]
        if d % 2:
            w[r.randint(0, len(w)) :] = rewritten(r, r.choice(items)[2].split(), vocab, r.choice([0.2, 0.3, 0.4]))
        docs.append((d, " ".join(w)))
    got = {(x.doc_id, x.item_id) for x in k.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string")).collect()}
    want = {(d, i) for d, t in docs for i, _, a in items if k.lcs_length(a.split(), t.split()) >= k.LCS * len(a.split())}
    assert len(want) > 80 and got <= want | truth(items, docs)
    assert len(got & want) >= 0.95 * len(want)


def test_short_answer_is_checked(spark):
    item = "please state who signed the long agreement between the harbour office and the northern depot in spring"
    df = spark.createDataFrame([(1, "x " + item.replace("long ", "very old ").replace("spring", "autumn") + " and it was Mira Holt"), (2, item.replace("long ", "very old ").replace("spring", "autumn"))], "doc_id long, text string")
    ev = spark.createDataFrame([(5, item, "Mira Holt")], "item_id long, question string, answer string")
    got = {(x.doc_id, x.kind) for x in k.leaks(df, ev).collect()}
    assert got == {(1, "paraphrase")} or got == {(1, "verbatim"), (2, "verbatim")}
