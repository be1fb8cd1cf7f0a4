import random

import pytest
from brookloom.functions import cuts


@pytest.mark.parametrize("seed", range(30))
def test_windows_on_any_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "word", ". ", " ", "\n", "\n\n", "!", "ß😀", "x" * r.randint(1, 40)]) for _ in range(r.randint(0, 300)))
    size = r.randint(4, 60)
    overlap = r.randint(0, size - 1)
    out = cuts.windows(text, size, overlap)
    seen = set()
    for k, (i, a, b) in enumerate(out):
        assert i == k and 0 < b - a <= size and not text[a].isspace() and not text[b - 1].isspace()
        seen.update(range(a, b))
    assert all(i in seen for i, c in enumerate(text) if not c.isspace())


def test_windows_prefer_paragraphs():
    text = "a" * 80 + "\n\n" + "b" * 10 + ". " + "c" * 50
    assert cuts.windows(text, 100, 0)[0][2] == 80
    assert cuts.windows("word " * 30, 100, 10)[1][1] == 90
    with pytest.raises(ValueError):
        cuts.windows("x", 5, 5)


def test_sentences():
    s = lambda t: [t[a:b] for a, b in cuts.sentences(t)]
    assert s("Am 3. März beginnt es. Danach mehr.") == ["Am 3. März beginnt es.", "Danach mehr."]
    assert s("See fig. 3 etc. and so on! Yes?") == ["See fig. 3 etc. and so on!", "Yes?"]
    assert s("one\ntwo. three") == ["one", "two.", "three"] and s("") == []


def test_markdown_sections():
    out = cuts.markdown_sections("intro\n\n# A\ntext one\n\n```\n# no heading\n```\n## B\n" + "w " * 30, most=40)
    assert [o[1] for o in out][:3] == ["", "A", "B"] and out[-1][1] == "B" and all(len(o[2]) <= 40 for o in out)


def test_csv_json_html():
    assert cuts.csv_statements('id;name\n1;"a;b"\n2;\n') == ["id: 1; name: a;b", "id: 2"]
    assert cuts.csv_statements("1,2\n3,4") == ["1,2", "3,4"] and cuts.csv_statements("") == []
    assert cuts.json_paths('{"a": [1, {"b": ""}, true], "c": null, "d": "x"}') == [("a[0]", "1"), ("a[2]", "true"), ("d", "x")]
    assert cuts.json_paths("{broken") == []
    text = cuts.html_text("<html><head><title>T &amp; U</title><style>x</style></head><body><h2>Top</h2><ul><li>one<li>two</ul><script>no</script><table><tr><td>a<td>b</tr></table></body></html>")
    assert "# T & U" in text and "## Top" in text and "- one" in text and "a | b" in text and "no" not in text
    assert cuts.normalised("﻿a\r\nb\rc\x00") == "a\nb\nc"
