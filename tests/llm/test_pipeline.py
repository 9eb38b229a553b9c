"""The corpus pipeline: every stage on all its predecessor kept, and its decisions take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import SPACE, empty, fixture_rows, frame, shingles


def test_stages_filter_what_they_should(spark, tmp_path):
    rows = [(i, f"{r[1]} tail{i}" if r[1] and i % 2 else r[1], r[2], r[3], r[4]) for i, r in enumerate(fixture_rows())]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    sf_dir = str(tmp_path)
    first = stages["quality_classifier"](spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() <= docs.count()
    exact = stages["exact_dedup"](spark, docs, sf_dir)
    assert exact.columns == docs.columns and exact.count() == len({SPACE.sub("", r[1] or "") for r in rows})
    near = stages["ngram_jaccard_join"](spark, exact, sf_dir).collect()
    sets = [shingles(r.text) for r in near]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not (a | b) or len(a & b) / len(a | b) < 0.8
    mixed = stages["source_mixing"](spark, exact, sf_dir)
    assert mixed.columns == docs.columns
    ids = {r.doc_id for r in exact.select("doc_id").collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= ids
    packed = stages["packing"](spark, mixed, sf_dir)
    assert packed.agg(F.max("length")).first()[0] <= 1024
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == packed.columns and whole.count() > 0


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
