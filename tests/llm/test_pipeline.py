"""The pipeline against its stages done by hand, and what each stage must keep."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kinetrail.llm import byte_bpe, exact_dedup, language_id, mixing, queries, simhash
from kinetrail.llm.common import documents


def test_stages_by_hand(spark, corpus, folder):
    at = folder(corpus)
    docs = documents(spark, at)
    langs = {r.doc_id for r in language_id.identify(docs, docs.where(~language_id.held_out())).where("lang_pred != 'und'").collect()}
    docs = docs.where(docs.doc_id.isin(langs))
    docs = docs.where(docs.doc_id.isin([r.doc_id for r in exact_dedup.exact_groups(docs).where("kept").collect()]))
    docs = docs.where(docs.doc_id.isin([r.doc_id for r in simhash.near_groups(docs).where("component_id = doc_id").collect()]))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode_decode(docs).collect()}
    want = sorted((r.doc_id, r.lang, r.source, len(ids[r.doc_id]), ids[r.doc_id], hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect() for _ in range(copies[r.doc_id]))
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == want and want


def test_stages_keep_columns_and_clean_rows(spark, sf):
    docs = documents(spark, sf)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        if name == "language_id":
            assert out.count() == n  # every document of this table has letters
        if name == "exact_dedup":
            assert out.select("text").distinct().count() == out.count() == docs.select("text").distinct().count()


def test_empty_pipeline(spark, no_rows, folder):
    assert corpus_pipeline.run(spark, folder(no_rows)).count() == 0


def test_awkward_pipeline(spark, awkward, folder):
    assert corpus_pipeline.run(spark, folder(awkward)).count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 13)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]


def test_language_stage_without_labels(spark, tmp_path):
    rows = [(0, "Ein Satz mit Worten darin", None, "a", 25), (1, "x", None, "a", 1), (2, "12 !!", None, "a", 5), (3, None, None, "b", 0), (4, "", None, "b", 0), (5, "Another clean text of some words", None, "b", 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in language_id.language_stage(spark, docs, "").collect()) == [0, 1, 5]
    labelled = docs.withColumn("lang", F.lit("en"))
    assert sorted(x.doc_id for x in language_id.language_stage(spark, labelled, "").collect()) == [0, 1, 5]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {0, 5}
