"""Every trusted document counts, however many there are."""

import pytest
from pyspark.sql import functions as F

from tessera.llm.quality_rules import N_BUCKETS, log_ratios


def test_all_of_many_trusted_documents_count(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    ratios = log_ratios(docs, docs.select("doc_id")).first().ratios
    assert len(ratios) == N_BUCKETS and ratios == pytest.approx([0.0] * N_BUCKETS, abs=1e-12)  # target and raw are one


def test_buckets_follow_the_input():
    from tessera.llm.quality_rules import bucket_count

    assert bucket_count(0) == bucket_count(4 * N_BUCKETS) == N_BUCKETS
    assert bucket_count(4 * N_BUCKETS + 1) == bucket_count(16 * N_BUCKETS) == 2 * N_BUCKETS < bucket_count(10**9)
