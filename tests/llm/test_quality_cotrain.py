import random

import numpy as np
import pytest
from corvina.llm import quality_cotrain
from pyspark.sql import functions as F


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 80))).capitalize() + "."
        bad = i % 4 == 0
        if bad:
            text = [" ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 60), text.upper().replace(" ", "!! "), text.replace(" ", " | ")][i // 4 % 4]
        source = ("junk" if rng.random() < 0.8 else "web") if bad else ("web" if rng.random() < 0.8 else "junk")
        rows.append((i, text, "en", source, len(text), int(not bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 3 == 0], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[5] for r in rows}


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    got = quality_cotrain.score(docs, quality_cotrain.train(docs, labels)).collect()
    held = [r for r in got if r.doc_id % 3]
    assert len(got) == len(truth)
    assert np.mean([r.keep == bool(truth[r.doc_id]) for r in held]) > 0.97
    assert all(0 <= p <= 1 for r in got for p in (r.p_content, r.p_metadata, r.score))


def test_good_keeps_rows_whole(tables):
    docs, labels, truth = tables
    model = quality_cotrain.train(docs, labels)
    wide = docs.selectExpr("*", "'x' as score", "1 as keep")
    kept = quality_cotrain.good(wide, model)
    assert kept.schema == wide.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_cotrain.score(docs, model).filter("keep").collect()}


def two_views(seed, n=6000, width=12):
    """Views that are independent given the label; most of each is noise."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.6).astype(float)
    made = []
    for strength in (1.6, 1.6):
        x = rng.standard_normal((n, width))
        x[:, :3] += strength * (y[:, None] - 0.5)
        made.append(x)
    return made[0], made[1], y


def test_rounds_help():
    gains = []
    for seed in range(6):
        a, b, y = two_views(seed)
        test = slice(3000, None)
        right = []
        for rounds in (0, quality_cotrain.ROUNDS):
            model = quality_cotrain.cotrain((a[:60], b[:60]), y[:60], lambda views, a=a, b=b: quality_cotrain.handed(views, a[60:3000], b[60:3000]), rounds)
            p = model.probabilities(a[test], b[test])
            right.append([((x >= 0.5) == y[test]).mean() for x in p])
        gains.append(np.array(right[1]) - np.array(right[0]))
        assert right[1][2] >= max(right[1][:2])
    assert (np.mean(gains, 0)[:2] > 0.01).all() and np.mean(gains, 0)[2] > 0


def test_sums_on_spark_equal_those_of_all_rows_at_once(spark, tables):
    docs, labels, _ = tables
    table = quality_cotrain._tabled(docs.repartition(5))
    model = quality_cotrain.train(docs, labels, rounds=0)
    views = (model.content, model.metadata)
    got = quality_cotrain._gathered(table, views)
    want = quality_cotrain.handed(views, *quality_cotrain._both(table.toArrow().combine_chunks().to_batches()[0]))
    assert sum(h.number for sums in want for h in sums) > 100
    for x, y in zip(sum(got, []), sum(want, []), strict=True):
        assert x.number == y.number and np.allclose(x.gradient, y.gradient) and np.allclose(x.hessian, y.hessian)


def test_repeated_ids_train_alike_in_any_order(spark, tables):
    docs, labels, _ = tables
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" ### ### ###"))))
    a, b = (quality_cotrain.train(x, labels) for x in (again.repartition(2), again.repartition(7, "text")))
    assert np.allclose(a.content.weights, b.content.weights) and np.allclose(a.metadata.weights, b.metadata.weights)


def test_edge_rows(spark, tables):
    docs, labels, _ = tables
    model = quality_cotrain.train(docs, labels)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "web", 0), (1, "", "en", "web", 0), (2, "é" * 200000, "", "", -5)], docs.schema)
    assert quality_cotrain.score(odd, model).count() == 4
    assert quality_cotrain.score(docs.limit(0), model).count() == 0
    bare = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert quality_cotrain.score(bare, model).count() == 1
    none = quality_cotrain.train(docs, labels.limit(0))
    assert quality_cotrain.score(docs, none).select("score").distinct().count() == 1
    several = labels.unionByName(labels.selectExpr("doc_id", "cast(null as int) quality", "toxic")).unionByName(labels)
    assert quality_cotrain.score(docs, quality_cotrain.train(docs, several)).filter("keep").count() > 0
    assert quality_cotrain.score(bare, quality_cotrain.train(docs.limit(0), labels)).count() == 1
