"""Joins on no unique key: whole results, and no task that makes most of them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.engine import Engine
from loomgraph.operators import relation
from loomgraph.sources.graphs import Triples
from loomgraph.terms import iri


@pytest.fixture
def closely(monkeypatch):
    """Small tables are treated as large ones are."""
    for name, value in (("CLOSELY", 1), ("BLOCK", 16), ("STANDS", 64), ("TASKS", 8)):
        monkeypatch.setattr(relation, name, value, raising=False)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Most rows in one nation; nulls, a nation of its own on either side, and equal balances."""
    at = str(tmp_path_factory.mktemp("shop"))
    nation = lambda i, other: None if i % 31 == 0 else other if i % 29 == 0 else 1 if i % 5 == 0 else 0
    segments = ("none", "BUILDING", None)
    customers = [(i, f"c{i}", nation(i, 7), 1.0, segments[i % 7] if i % 7 < 3 else "AUTO") for i in range(200)]
    suppliers = [(i, f"s{i}", nation(i, 9), None if i % 13 == 0 else float(i % 50)) for i in range(210)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{at}/supplier.parquet")
    return at, customers, suppliers


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_rows_that_only_multiply_are_counted(spark, closely, shop):
    at, customers, suppliers = shop
    found = queries.queries()["pattern_repeat"](spark, at)
    each = Counter(s[2] for s in suppliers)
    want = Counter()
    for c in customers:
        if c[2] is not None and c[4] not in ("none", None):
            want[f"urn:t:nation/{c[2]}"] += each[c[2]]
    assert Counter(r["x"] for r in found.collect()) == +want
    assert largest_share(found) < 0.5


@pytest.mark.parametrize("select", ["?n", "?n ?a", "?b", "(1 AS ?one)"])
def test_one_side_or_both_are_counted(spark, closely, tmp_path, select):
    """Terms of any kind as keys; a solution stands as often as before."""
    node = lambda x: iri(f"urn:t:{x}")
    triples = [(node(f"{kind}{i}"), node(f"in_{kind}"), node(f"n{i % 3}")) for kind in "ab" for i in range(40)]
    Triples.of(spark, triples).df.write.parquet(str(tmp_path / "t"))
    text = queries.PREFIXES + f"SELECT {select} {{ ?a :in_a ?n . ?b :in_b ?n }}"
    found = Engine(spark, Triples(spark.read.parquet(str(tmp_path / "t")))).sparql(text)
    want = Counter()
    for i in range(40):
        for j in range(40):
            if i % 3 == j % 3:
                row = {"?n": f"urn:t:n{i % 3}", "?a": f"urn:t:a{i}", "?b": f"urn:t:b{j}", "(1 AS ?one)": "1"}
                want[tuple(row[v] for v in (select.split() if select[0] == "?" else [select]))] += 1
    assert Counter(tuple(map(str, r)) for r in found.collect()) == want


def test_pairs_of_one_key_are_joined_in_blocks(spark, closely, shop):
    at, _, suppliers = shop
    found = queries.queries()["join_theta"](spark, at)
    there = [s for s in suppliers if None not in s]
    want = Counter((f"urn:t:supplier/{a[0]}", f"urn:t:supplier/{b[0]}") for a in there for b in there if a[2] == b[2] and a[3] > b[3])
    assert Counter((r["a"], r["b"]) for r in found.collect()) == want
    assert largest_share(found) < 0.5


def test_blocks_of_unlike_sides_and_terms_of_any_kind(spark, closely, tmp_path):
    node = lambda x: iri(f"urn:t:{x}")
    triples = [(node(f"{kind}{i}"), node(f"in_{kind}"), node(f"n{i % 2}")) for kind, n in (("a", 6), ("b", 400)) for i in range(n)]
    Triples.of(spark, triples).df.write.parquet(str(tmp_path / "t"))
    graph = Triples(spark.read.parquet(str(tmp_path / "t")))
    found = Engine(spark, graph).sparql(queries.PREFIXES + "SELECT ?a ?b { ?a :in_a ?n . ?b :in_b ?n }")
    want = Counter((f"urn:t:a{i}", f"urn:t:b{j}") for i in range(6) for j in range(400) if i % 2 == j % 2)
    assert Counter((r["a"], r["b"]) for r in found.collect()) == want


def test_patterns_on_one_row_are_read_in_one_scan_before_they_meet_others(spark, shop):
    found = queries.queries()["join_theta"](spark, shop[0])
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
