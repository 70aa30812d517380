import random
import re

import pytest
from corvina.llm import ngram_join


def shingles(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, threshold=0.8):
    """n_links and class of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            same = sets[a] == sets[b]
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, least.get(root(i), -1), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).capitalize() + rng.choice(["", ".", "\n"]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, schema="doc_id long, text string"):
    out = ngram_join.join(spark.createDataFrame(rows, schema).repartition(3)).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    import corvina.llm._links as links

    rows = corpus(3, groups=3, words=90)
    monkeypatch.setattr(links, "BLOCK", 2)
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (3, text), (3, text), (4, None), (5, ""), (6, " \n"), (7, "short one"), (8, "Short, one!"), (9, "short two"), (None, "zzz yyy")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, "a b", "k", "n")], "doc_id long, text string, key string, node string") == [(1, 1, 0)]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.VALUES


def test_representatives(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns
    want = {c for _, c, _ in brute(rows)}
    assert {r.doc_id for r in kept.collect()} == want
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "d e f"), (None, "d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.representatives(twice).collect()) == [(0, "d e f"), (1, "a b c")]


def test_representatives_of_repeated_ids(spark):
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", " ".join(f"w{i}" for i in range(60)))
    rows = [(1, a), (2, a), (2, b), (5, c), (5, c + " more"), (5, c.upper()), (7, b), (8, None), (8, ""), (None, a), (None, "only here")]
    out = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((r.doc_id or 0, r.text or "") for r in out)
    assert [x for x in got if x[0] != 5] == [(0, "only here"), (1, a), (2, b), (8, "")]
    assert len([x for x in got if x[0] == 5]) == 1
