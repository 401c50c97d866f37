"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import near_dedup, packing, quality_rules, rule_ensemble, secrets
from loomgraph.llm.common import read_table, remainder, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more.  It learns from the labelled documents of the table."""
    train = remainder(F.col("doc_id"), 4) != 2
    model = rule_ensemble.train_ensemble(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", train)
    scored = rule_ensemble.with_score(docs, model, score_col="\x01score")
    return scored.where(F.col("`\x01score`") >= 0.7).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their text, without the lines that fail; n_chars follows the text."""
    return counted(quality_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_dedup.deduplicate(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    return counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs)


def counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_lines),
    ("near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the first stage fits a model, the third follows links to a fixed point, the last packs step by step.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Tables between stages go to the shared folder that spark.checkpoint.dir names; only where
    it is unset and the session runs in one process, as in tests, to a folder of their own.

    An empty `documents` gives an empty result.  Columns other than doc_id and text pass through the stages whatever their
    names; the last stage returns its own.  A null or empty text, a text of any length, a null id, repeated rows: each
    stage's operator says in its docstring what becomes of them.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
