"""A corpus pipeline of five stages, each one operator of loom.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Stages are
written as Parquet to the shared folder and read again, so a lost executor costs a stage at most.

Odd rows, in every stage: a null text counts as empty; rows that share an id are judged each by their
own text, but for near copies, where one set stands for an id and a row without an id is linked with
nothing and stays; other columns pass through, whatever their names (encoding returns its own); no rows
give no rows.  Empty texts fail the rules of the first stage, so later ones meet them only by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loom.llm import exact_dedup, near_dedup, pieces, quality_rules, source_mix
from loom.llm.common import materialise, new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    kept = exact_dedup.distinct_documents(docs, index, "documents")
    index.close()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8), the document with the smallest doc_id."""
    return near_dedup.distinct_documents(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once per pass; a document at the end of a run of blocks is cut to its words."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the decoded text of every row of the mix."""
    return pieces.encoded(docs, ("n_tokens", "ids", "decoded"), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing to target weights", mix), ("SentencePiece", encode)]

#: Minimum hashes, seeded orders and ids have no SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
