import random
from itertools import combinations

from brookloom.llm import duplicates as d


def brute(rows, like):
    sets = {}
    for kind, i, text, _ in rows:
        if text is None or i is None:
            continue
        w = [x.lower() for x in d.ALNUM.findall(text)]
        if len(w) >= max(like.words, like.least_words):
            sets[kind, i] = {tuple(w[k : k + like.words]) for k in range(len(w) - like.words + 1)}
    return {(a[0], *sorted((a[1], b[1]))) for a, b in combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) * like.den >= like.num * len(sets[a] | sets[b])}


def sample():
    r = random.Random(5)
    rows, vocab = [], [f"w{i}é" for i in range(400)]
    for g in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([10, 19, 20, 60, 300]))]
        for c in range(r.randint(1, 4)):
            edited = [r.choice(vocab) if r.random() < 0.05 * c else w for w in words]
            if r.random() < 0.3:
                edited = edited[len(edited) // 4 :] + edited[: len(edited) // 4]
            sep = r.choice([" ", ", ", "\r\n"])
            rows.append((r.choice(["section", "document"]), f"{g:03}-{c}", sep.join(edited).upper() if r.random() < 0.3 else sep.join(edited), "x"))
    rows += [rows[0], rows[5], ("section", "null", None, "x"), ("section", None, "a b c " * 20, "x"), ("section", "empty", "", "x")]
    rows += [("section", f"copy{k:02}", "same text again and again " * 9 + "end", "x") for k in range(25)]
    return rows


def test_pairs_and_groups(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "kind string, id string, text string, class string")
    want = brute(rows, d.STATED)
    got = [tuple(r) for r in d.record_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {}
    for r in d.groups(df).collect():
        parent[r.kind, r.id] = r.group
    assert all(parent[k, a] == parent[k, b] for k, a, b in want)
    alike = {(k, x) for k, a, b in want for x in (a, b)}
    assert all(g == i for (k, i), g in parent.items() if (k, i) not in alike)


def test_empty(spark):
    df = spark.createDataFrame([], "kind string, id string, text string")
    assert d.record_pairs(df).count() == 0 and d.groups(df).count() == 0


def test_recall_at_the_threshold(spark):
    r = random.Random(1)
    rows = []
    for k in range(300):
        n = 160
        common = [r.getrandbits(60) for _ in range(96)]
        for side in range(2):
            s = d.np.array(common + [r.getrandbits(60) for _ in range((n - 96) // 2)], dtype=d.np.uint64)
            f = d.fingerprint(s)
            rows.append((k * 2 + side, "section", len(s), [int(x) for x in (f & d._U(0xFFFFFFFF)).astype(d.np.uint32).view(d.np.int32)]))
    classes = spark.createDataFrame(rows, "class long, kind string, size int, symbols array<int>")
    met = {(p.a, p.b) for p in d.candidates(classes).collect()}
    assert sum((2 * k, 2 * k + 1) in met for k in range(300)) >= 297 and len(met) < 310
