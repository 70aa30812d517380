import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.llm import source_divergence as sd
from corvina.llm.queries import ORACLE, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _expected(rows, min_docs):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(SMALL))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def scale(n):
            total = sum(n.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c + 2) // total for t, c in n.items()}

        p, q = {s: scale(own[s]) for s in sources}, scale(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources - {s}]
            best = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


def _corpus(n=400, seed=3):
    r = random.Random(seed)
    words = ["Alpha", "alpha", "beta", "Été", "été", "x\x00y", "naïve", "ΣΑΣ", "k1k", "日本", "--", "O'Neil", "[caps]", "ĸ", "😀", *(chr(97 + i) * 3 for i in range(20))]
    rows = [(r.choice(["en", "en", "en", "de", None]), r.choice(["a", "a", "b", "ç", None, "z9"]), " ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 12)))) for _ in range(n)]
    return [*rows, ("fr", "only", "un mot"), ("fr", "other", None), ("nothing", "s", ""), ("nothing", None, None), ("en", "late", "..."), *[("en", "a", "beta beta gamma")] * 30]


@pytest.mark.parametrize(("terms", "sources"), [(8192, 128), (5, 2), (1, 1)])
def test_against_whole_numbers(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(sd, "TERMS", terms)
    monkeypatch.setattr(sd, "SOURCES", sources)
    rows = _corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("t"), "n": F.lit(1), "block": F.lit(0)})
    got = sd.divergence(docs).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == _expected(rows, 10)


def test_given_documents_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in QUERIES["op12_divergence"](spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert got == set(con.execute(ORACLE["op12_divergence"]).fetchall())


def test_ties_go_by_item_and_few_terms(spark):
    rows = [("en", s, " ".join(f"w{c}" for c in s)) for s in ("abc", "bcd", "cde") for _ in range(12)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in sd.divergence(docs).collect()} == _expected(rows, 10)
    assert {tuple(r) for r in sd.divergence(docs, 1000).collect()} == _expected(rows, 1000)
    assert sd.divergence(docs.limit(0)).count() == 0


def test_a_tile_takes_terms_over_batches(monkeypatch):
    monkeypatch.setattr(sd, "TERMS", 3)
    head = {"lang": "l", "block": 0, "i": 0, "j": 0, "side": 0, "term": None, "lang_n": 100, "terms": 7, "here": 8}
    rows = [head | {"source": s, "n": n} for s, n in (("b", 40), ("a", 60))]
    cells = [head | {"source": s, "term": t, "n": n, "lang_n": 20, "terms": None, "here": None} for t in "pqrstuv" for s, n in (("a", 5 + ord(t) % 3), ("b", 9))]

    def batches(step):
        return [pa.RecordBatch.from_pylist((rows + cells)[i : i + step], schema) for i in range(0, 16, step)]

    schema = pa.schema([(c, pa.string() if c in ("lang", "source", "term") else pa.int64()) for c in ("lang", "block", "i", "j", "side", "source", "term", "n", "lang_n", "terms", "here")])
    results = [[b.to_pylist() for b in sd._tiles(iter(batches(step)))] for step in (1, 3, 16)]
    assert results[0] == results[1] == results[2] and results[0][0]


def test_long_division_is_exact():
    import numpy as np

    r = random.Random(5)
    for _ in range(300):
        total = r.randint(1, 8 * 10**15)
        count, terms = r.randint(0, total), r.randint(1, 1000)
        assert sd.scaled(np.array([count]), np.array([total]), terms).tolist() == [1 + 10**9 * (count + 2) // (total + 2 * terms)]
