"""A training-data pipeline: reject, deduplicate, cut repeats, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
all but the last return the columns of documents.  run() writes every stage's result to
the shared folder and reads it back for the next.  No stage can be put in SQL as a
whole, so ORACLE_SQL is None; tests/llm/test_brute.py holds every stage against a plain
recomputation.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbor.llm import packing, secrets, simhash, suffix, toxicity
from arbor.llm._common import documents, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more
    over five-word shingles: the one of least id."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that repeat."""
    return suffix.dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every byte of the remaining texts lies in fixed-size bins."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("simhash", drop_near_copies), ("suffix_array", cut_repeats),
          ("secrets", redact_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
