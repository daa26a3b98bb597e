"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

A stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents, the
last adds `rate`, the mixing rate of the document, in place of a column of that name (documents of rate 0 go). Stages handle null texts, null
ids and repeated rows as their operators in pairlens.llm state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import decontam, lines, mixing, ngram_join, queries, toxicity
from pairlens.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, queries.toxic_labels(queries.read(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in one of them."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts (shingles of 5 words, similarity 0.8)."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminate(docs, queries.read(spark, sf_dir, "benchmark"))


def add_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which mixing takes them; those it never takes go."""
    mixture = mixing.fit(docs, queries.domains(queries.read(spark, sf_dir, "labels")), queries.TARGETS)
    return mixing.document_rates(docs, mixture).where("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("soft_mixing", add_rates),
]

#: Learned scores and substitution-tolerant overlaps are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
