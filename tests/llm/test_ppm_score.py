import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.llm import ppm_score
from corvina.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = ["abracadabra", "Abra cadabra, ABRA!", None, "", "abracadabra", "ça va\tété  ça\n", "  x \x00 y", "zzzzzz", "a" * 50, "abrab\x0bcad", "qrst abra"]


class Model:
    """The same model with dictionaries, one symbol at a time."""

    def __init__(self, texts: list[bytes], order: int):
        self.order, self.next = order, defaultdict(Counter)
        for text in texts:
            whole = b"\xff" * order + text + b"\xff"
            for i in range(order, len(whole)):
                for k in range(order + 1):
                    self.next[whole[i - k : i]][whole[i]] += 1

    def probability(self, context: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: n for s, n in self.next.get(context[len(context) - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            total = 2 * sum(seen.values())
            if symbol in seen:
                return p * (2 * seen[symbol] - 1) / total
            p *= len(seen) / total
            excluded |= set(seen)
        return p / (256 - len(excluded))

    def score(self, text: bytes) -> float:
        whole = b"\xff" * self.order + text + b"\xff"
        return sum(math.log10(self.probability(whole[i - self.order : i], whole[i])) for i in range(self.order, len(whole)))


def _lower(text):
    return (text or "").encode().lower()


def _words(text):
    return [w for w in _lower(text).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]


def _expected(rows, order):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    model = Model([_lower(t) for t in train], order)
    counts = Counter(w for t in train for w in _words(t))
    counts[None] = len(train)
    counts += Counter()
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*_words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, base, model.score(_lower(t))))
    return out


def _check(rows, expected):
    key = lambda r: (r[0] is None, r[0], r[6])
    got = sorted((tuple(r) for r in rows), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [0, 1, 3, 6])
def test_against_dictionaries(spark, order):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(44)] + [(None, "abra"), (None, "abra"), (7, "zzz"), (7, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("block", F.lit(1))
    _check(ppm_score.score(docs, order).collect(), _expected(rows, order))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = QUERIES["op11_scores"](spark, SF).collect()
    expected = _expected(rows, ppm_score.ORDER)
    assert any(e[1] for e in expected)
    _check(got, expected)


def test_probabilities_of_a_context_sum_to_one():
    model = Model([_lower(t) for t in TEXTS], 3)
    for context in (b"abr", b"\xff\xff\xff", b"qqq", b"aaa"):
        assert sum(model.probability(context, s) for s in range(256)) == pytest.approx(1)


def test_no_training_and_no_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame([(i, "ab c") for i in held], "doc_id long, text string")
    for r in ppm_score.score(docs).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0)
        assert r.score == pytest.approx(-5 * math.log10(256))
    assert ppm_score.score(docs.limit(0)).count() == 0


def test_held_out_scores_beat_the_base(spark):
    rows = QUERIES["op11_scores"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_windows_and_answers_do_not_depend_on_their_size(monkeypatch):
    texts = pa.array(["", "abc", "", "x" * 100, "déjà"], pa.large_string())
    whole = [np.concatenate(x) for x in zip(*ppm_score.windows(texts, 2), strict=True)]
    monkeypatch.setattr(ppm_score, "WINDOW", 7)
    parts = [np.concatenate(x) for x in zip(*ppm_score.windows(texts, 2), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert np.bincount(whole[1]).tolist() == [len(t.encode()) + 1 for t in texts.to_pylist()]
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000))
    answers = ppm_score.Answers(grams, grams * 0.5)
    assert (answers(grams[::-1]) == grams[::-1] * 0.5).all()
    assert answers(np.array([1 << 50, 3])).tolist() == [ppm_score.USUAL] * 2


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    once = {r.doc_id: r.score for r in ppm_score.score(docs).collect()}
    dealt = {r.doc_id: r.score for r in ppm_score.score(docs.repartition(7)).collect()}
    assert once == dealt


def _disk(spark):
    """Bytes of each file that the session's shuffles and checkpoints have."""
    sc = spark.sparkContext._jsc.sc()
    blocks = sc.env().blockManager().diskBlockManager().getAllFiles()
    folder = Path(sc.getCheckpointDir().get().removeprefix("file:"))
    return {f.toString(): f.length() for f in map(blocks.apply, range(blocks.size()))} | {str(f): f.stat().st_size for f in folder.rglob("*") if f.is_file()}


def test_an_ngram_takes_few_bytes_of_disk(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    texts = pa.array([(r.text or "").lower() for r in docs.collect()], pa.large_string())
    distinct = len(np.unique(np.concatenate([g for g, _ in ppm_score.windows(texts, ppm_score.ORDER)])))
    monkeypatch.setattr(ppm_score, "BLOCK", 1 << 18)  # many blocks, that ask for many n-grams twice
    monkeypatch.setattr(ppm_score, "RANGE", 1 << 18, raising=False)
    before = _disk(spark)
    assert len(ppm_score.score(docs).collect()) == len(texts)
    assert sum(n for f, n in _disk(spark).items() if f not in before) < 48 * distinct  # 76 with a row for each n-gram and word


@pytest.mark.parametrize("order", [0, 3, 4, 6])
def test_what_is_squeezed_comes_back(order):
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 8 * (order + 1), 3000))
    keys = np.sort(ppm_score.branch_first(grams, order))
    assert (np.sort(ppm_score.branch_back(keys, order)) == grams).all()
    for numbers in (keys, np.diff(keys, prepend=0), keys[:0], np.array([0, -1, 1 << 62])):
        assert (ppm_score.unsqueezed(ppm_score.squeezed(numbers)) == numbers).all()
    words = [b"a", "\u00e7a".encode(), b"\x00", b"\xff" * 1000]
    assert ppm_score.unsqueezed_words(ppm_score.squeezed_words(words)) == words
    c, t = np.arange(len(keys)) % 3, np.unique(keys >> 8, return_inverse=True)[1] % 5 + 2
    first = np.append(True, np.diff(keys >> 8) > 0)
    parts = [np.diff(keys, prepend=0), c, t[first], np.full((c == 0).sum(), -2.5).view(np.int64)]
    found, logp = ppm_score.probabilities(*map(ppm_score.squeezed, parts), order)
    assert (found == ppm_score.branch_back(keys, order)).all()
    assert logp == pytest.approx([math.log10((2 * x - 1) / (2 * y)) if x else -2.5 for x, y in zip(c, t, strict=True)])
