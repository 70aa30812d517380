import corpus_pipeline
from corvina.llm import ngram_join, quality_cotrain, secret_scan
from corvina.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, len(QUERIES) + 1)]


def test_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.quality(spark, docs, SF).cache()
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.95 * len(labels)
    second = corpus_pipeline.near_duplicates(spark, first, SF).cache()
    assert {r.doc_id for r in second.collect()} == {r.class_id for r in ngram_join.join(first).collect()}
    third = corpus_pipeline.secrets(spark, second, SF).cache()
    assert third.columns == docs.columns and third.count() == second.count()
    assert secret_scan.scan(third).filter("n_assign + n_access + n_hex > 0").count() == 0
    pieces = corpus_pipeline.packing(spark, third, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in third.collect()}
    assert sorted(r[:] for r in corpus_pipeline.run(spark, SF).select("doc_id", "length", "ids_crc32").collect()) != []


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]
    assert quality_cotrain.LABELLED == 8000
