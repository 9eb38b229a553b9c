"""A corpus pipeline of five stages over ``documents``, each one of the training-data operators.

Each stage works on all that its predecessor kept, is written as Parquet in the shared folder and is
read back as the next one's ``docs``.  SQL cannot express the classifier, so there is no oracle; the
tests hold every stage against a brute-force version.

All stages take null and empty texts as texts without words, texts of any length whole, and extra columns
under any name as they are; an empty table stays empty.  What each makes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_cnn import quality_scores
from tessera.llm.common import write_table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.lsh_forest import near_dedup
from tessera.llm.mixing import poisson_mix
from tessera.llm.packing import packed_pieces
from tessera.session import table


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts.

    Null and empty texts get one score and go or stay together, as do repeated rows.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _same_columns(quality_scores(docs, labels).where("predicted = 1"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, ties by the least doc_id.

    Null and empty texts are one group; of repeated rows one stays.
    """
    return _same_columns(exact_dedup(docs).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id; null comes last.

    Texts without words are one class; of repeated rows one stays.
    """
    return _same_columns(near_dedup(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards source weights of the square root of their sizes, in a global shuffle.

    A null source is one source; rows that agree in doc_id, or in text where they have none, get equal counts.  A count of 0
    leaves a document out: that is the method.
    """
    return _same_columns(poisson_mix(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences of 1024 ids.

    A null or empty text is one piece with the end id; repeated rows are packed each time.
    """
    return packed_pieces(docs, 1024)


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
