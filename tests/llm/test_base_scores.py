"""op3's base columns come before its network; training and scoring take a task for each chunk."""

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import gru_lm, queries
from loomgraph.llm.common import remainder

BASE = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, None if i % 17 == 0 else "" if i % 13 == 0 else " ".join(f"W{(i * j) % 97}" for j in range(i % 60))) for i in range(150)]
    rows += [rows[5], (None, "w1 w2"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def bag(df):
    return sorted(map(str, df.select(*BASE[:-1], F.round("base_score", 5)).collect()))


def test_base_columns_need_no_training(spark, folder, monkeypatch):
    want = bag(queries.op3_gru_scoring(spark, folder))

    def never(*_):
        raise AssertionError("the base columns trained a network")

    monkeypatch.setattr(gru_lm, "trained", never)
    got = queries.base_op3_gru_scoring(spark, folder)
    assert tuple(got.columns) == BASE and bag(got) == want and len(want) == 153


def test_a_task_for_each_chunk(spark, folder, monkeypatch):
    seen = []
    trained = gru_lm.trained
    monkeypatch.setattr(gru_lm, "trained", lambda chunks, *rest: (seen.append(chunks.rdd.getNumPartitions()), trained(chunks, *rest))[1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    many = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0]
    chunks = -(-many // 2000)
    out = gru_lm.score_documents(docs, remainder(F.col("doc_id"), 10) == 0, chunk=2000)
    assert chunks > 4 and seen == [chunks, chunks] and out.rdd.getNumPartitions() == chunks


def test_base_columns_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert gru_lm.base_scores(none, F.lit(False)).count() == 0
