import hashlib
import random
import re

from corvina.llm import doc_merkle


def run(spark, rows, schema="doc_id long, text string"):
    return doc_merkle.fingerprints(spark.createDataFrame(rows, schema).repartition(3)).collect()


def brute(texts, ids):
    order = sorted(ids, reverse=True)
    out = {}
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        out[i] = t[: len(t) - half] + n[:half]
    return out


def test_edited_text_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(doc_merkle, "RANGE_ROWS", 8)
    rng = random.Random(4)
    texts = {i * 7 - 50: " ".join(rng.choice(["eins", "zwei.", "drei\n", "vièr", "😀"]) for _ in range(rng.randrange(90))) for i in range(120)}
    got = {r.doc_id: r for r in run(spark, list(texts.items()))}
    want = brute(texts, texts)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_likeness_and_roots(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    page = ". ".join(" ".join(words[i : i + 8]) for i in range(0, 900, 8)) + "."
    other = ". ".join(" ".join(words[i : i + 9][::-1]) for i in range(0, 900, 9)) + "."
    got = {r.doc_id: r for r in run(spark, [(5, page), (4, other), (3, page)])}
    assert got[5].fingerprint == got[3].fingerprint != got[4].fingerprint
    assert 0.4 < got[5].near_edited < 0.6 and got[5].near_next < 0.1
    assert got[3].near_next == 1.0  # the next of the last is the first, with an equal text


def test_edge_rows(spark):
    got = run(spark, [(None, "b"), (1, None), (2, ""), (2, ""), (None, None)], "doc_id long, text string")
    assert len(got) == 5 and all(r.edited_sha256 for r in got)
    one = run(spark, [(1, "abcd")])
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert run(spark, []) == []
    extra = run(spark, [(1, "x", "a", 3)], "doc_id long, text string, fingerprint string, tie int")
    assert len(extra) == 1


def test_long_and_repeated_text(spark):
    got = {r.doc_id: r for r in run(spark, [(2, "A " * 60000), (1, "b" * 100000)])}
    assert 0.4 < got[2].near_edited < 0.6


def test_no_python_in_the_plan(spark):
    df = doc_merkle.fingerprints(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edits_are_located(spark):
    text = "One. Two. Three.\nFour. Five.\n\nSix. Seven.\nEight.\n\nNine."
    right = {1: text, 2: text.replace("Five", "5"), 3: text.replace("Eight", "8").replace("One", "1"), 4: text + "\n\nTen.", 5: text.replace("\n\nNine.", ""), 6: None, 7: "x", 8: ""}
    left = [(k, text, "k") for k in (1, 2, 3, 4, 5)] + [(6, "", "k"), (7, None, "k"), (8, "\n", "k"), (9, "alone", "k"), (None, "n", "k")]
    a = spark.createDataFrame(left, "doc_id long, text string, section string")
    b = spark.createDataFrame([*right.items(), (None, "m")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section, r.paragraph, -1 if r.leaf is None else r.leaf) for r in doc_merkle.compare(a, b).collect())
    assert got == [(2, 0, 1, 1), (3, 0, 0, 0), (3, 1, 1, 0), (4, 3, 0, 0), (5, 2, 0, 0), (7, 0, 0, 0), (8, 0, 1, -1)]
    plan = doc_merkle.compare(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edits_against_brute_force(spark):
    rng = random.Random(9)

    def parts(t):
        return {(i, j, k): leaf for i, s in enumerate(t.split("\n\n")) for j, p in enumerate(s.split("\n")) for k, leaf in enumerate(re.findall(doc_merkle.LEAF, p))}

    def text():
        return "".join(rng.choice(["ab. ", "cd! ", "word ", "\n", "\n\n"]) for _ in range(rng.randrange(30)))

    pairs = {}
    for i in range(80):
        x = text()
        at = rng.randrange(len(x) + 1)
        pairs[i] = x, rng.choice([x, text(), x[:at] + "z" + x[at:]])
    a, b = (spark.createDataFrame([(i, p[k]) for i, p in pairs.items()], "doc_id long, text string") for k in (0, 1))
    got = {}
    for r in doc_merkle.compare(a, b).collect():
        if r.leaf is not None:
            got.setdefault(r.doc_id, set()).add((r.section, r.paragraph, r.leaf))
    for i, (x, y) in pairs.items():
        x, y = parts(x), parts(y)
        assert got.get(i, set()) == {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
