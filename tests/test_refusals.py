"""What is refused, checked or kept as it is: views, queries over them, options, updates."""

import pytest

from loomgraph import terms as T
from loomgraph.engine import Engine
from loomgraph.plans import algebra as A
from loomgraph.plans.views import View
from loomgraph.sources.graphs import Catalog, Triples

X = T.iri("urn:x")
VIEW = "CONSTRUCT { ?s <urn:q> ?o } WHERE { ?s <urn:p> ?o }"


@pytest.fixture
def graph(spark):
    return Triples.of(spark, [(X, T.iri("urn:p"), T.iri("urn:y")), (T.iri("urn:y"), T.iri("urn:p"), X), (X, T.iri("urn:p"), X)])


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?s { ?s <urn:p> ?o }",
        "CONSTRUCT { \"lit\" <urn:q> ?o } WHERE { ?s <urn:p> ?o }",
        "CONSTRUCT { ?s \"lit\" ?o } WHERE { ?s <urn:p> ?o }",
        "CONSTRUCT { [] <urn:q> ?o } WHERE { ?s <urn:p> ?o }",
        "CONSTRUCT { _:b <urn:q> ?o } WHERE { ?s <urn:p> ?o }",
        "CONSTRUCT { <<( ?s <urn:p> ?o )>> <urn:q> ?o } WHERE { ?s <urn:p> ?o }",
        *(f"CONSTRUCT {{ ?s <urn:q> ?x }} WHERE {{ ?s <urn:p> ?o BIND({f} AS ?x) }}" for f in ("RAND()", "UUID()", "STRUUID()", "BNODE()")),
        "CONSTRUCT { ?s <urn:q> ?o } WHERE { ?s <urn:p> ?o FILTER EXISTS { ?s <urn:p> ?z FILTER(RAND() > 0.5) } }",
    ],
)
def test_views_that_are_refused(text):
    with pytest.raises(ValueError):
        View.from_construct(text)


def test_a_view_needs_a_query():
    with pytest.raises(ValueError):
        View.from_construct([])


@pytest.mark.parametrize("pattern", ["?s <urn:q>+ ?o", "?s <urn:q>* ?o", "GRAPH ?g { ?s <urn:q> ?o }", "?s <urn:q> ?o FILTER EXISTS { ?s <urn:q>+ ?o }"])
def test_queries_over_a_view_that_are_refused(spark, graph, pattern):
    engine = Engine(spark, graph, View.from_construct(VIEW))
    for ask in (engine.sparql, engine.rewrite):
        with pytest.raises(ValueError):
            ask(f"SELECT * {{ {pattern} }}")
    with pytest.raises(ValueError):
        engine.update(f"INSERT {{ ?s <urn:z> ?o }} WHERE {{ {pattern} }}")


def test_closures_in_services_and_sources_are_allowed(spark, graph):
    engine = Engine(spark, Catalog(graph, {}, {"urn:svc": graph}), View.from_construct(VIEW))
    assert engine.sparql("SELECT ?o { SERVICE <urn:svc> { <urn:x> <urn:p>+ ?o } }").count() == 2
    for text, n in (("SELECT ?s { ?s <urn:p>+ <urn:y> }", 2), ("SELECT ?s ?o { ?s <urn:p>* ?o }", 4), ("SELECT ?s { ?s <urn:p>* <urn:none> }", 1), ("SELECT ?s { ?s <urn:p>+ ?s }", 2)):
        assert Engine(spark, graph).sparql(text).count() == n


@pytest.mark.parametrize("depth", [-1, 1.5, "2", True])
def test_argument_depth_is_checked(spark, graph, depth):
    with pytest.raises(ValueError, match="non-negative integer"):
        Engine(spark, graph, argument_depth=depth)


def test_argument_depth_limits_nesting(spark):
    t = X
    for _ in range(3):
        t = T.triple(X, T.iri("urn:p"), t)
    g = Triples.of(spark, [(X, T.iri("urn:t"), t)])
    for depth, known in ((None, True), (3, True), (2, False), (0, False)):
        for text in ("SELECT ?n { ?s <urn:t> ?x BIND(<internal://blank>(?x) AS ?n) }", f"SELECT ?n {{ BIND(<internal://blank>({t}) AS ?n) }}"):
            row = Engine(spark, g, mint="literal", argument_depth=depth).sparql(text).first()
            assert (row["n"] is not None) == known


def test_a_repeated_variable_is_one_term(spark, graph):
    assert [r.s for r in Engine(spark, graph).sparql("SELECT ?s { ?s <urn:p> ?s }").collect()] == ["urn:x"]
    assert Engine(spark, graph, View.from_construct(VIEW)).sparql("SELECT ?s { ?s ?p ?s }").count() == 1


def test_unstable_arguments_are_evaluated_once(spark, graph):
    text = "SELECT (COUNT(DISTINCT ?n) AS ?k) (COUNT(*) AS ?all) { ?s <urn:p> ?o BIND(RAND() AS ?r) BIND(<internal://blank>(?r) AS ?n) BIND(<internal://blank>(?r) AS ?m) FILTER(sameTerm(?n, ?m)) }"
    row = Engine(spark, graph, mint="literal").sparql(text).first()
    assert row["k"] == row["all"] == 3


def test_ranges_narrow_what_a_function_gives(spark, graph):
    same = {"urn:f": lambda t: t}
    text = "SELECT ?v { ?s <urn:p> ?o BIND(<urn:f>(?o) AS ?v) ?v <urn:p> ?z }"
    assert Engine(spark, graph, functions=same).sparql(text).count() == Engine(spark, graph, functions=same, ranges={"urn:f": [T.IRI]}).sparql(text).count() > 0
    assert Engine(spark, graph, functions=same, ranges={"urn:f": [T.LITERAL]}).sparql(text).count() == 0


def test_rewrites_change_a_query(spark, graph):
    def reversed_(node):
        return A.BGP(tuple(A.Triple(t.o, t.p, t.s) for t in node.patterns)) if isinstance(node, A.BGP) else A.rebuilt(node, reversed_)

    text = "SELECT ?o { <urn:y> <urn:p> ?o }"
    assert [r.o for r in Engine(spark, graph).sparql(text).collect()] == ["urn:x"]
    assert [r.o for r in Engine(spark, graph, rewrites=[reversed_]).sparql(text).collect()] == ["urn:x"]
    assert "<urn:y> ." in Engine(spark, graph, rewrites=[reversed_]).rewrite(text)


def test_order_over_kinds_of_terms(spark):
    p = T.iri("urn:p")
    terms = [T.literal("b", T.STRING), T.literal("10", T.INTEGER), T.literal("9", T.INTEGER), T.iri("urn:b"), T.iri("urn:a"), T.blank("n")]
    g = Triples.of(spark, [(T.iri(f"urn:s{i}"), p, t) for i, t in enumerate(terms)])
    got = [r.o for r in Engine(spark, g).sparql("SELECT ?o { ?s <urn:p> ?o OPTIONAL { ?s <urn:none> ?x } } ORDER BY ?x ?o").collect()]
    assert got[0] == "n" and got[1:3] == ["urn:a", "urn:b"] and got.index("9") < got.index("10")
    assert [r.o for r in Engine(spark, g).sparql("SELECT ?o { ?s <urn:p> ?o } ORDER BY DESC(?o) LIMIT 1").collect()] == [got[-1]]


def test_group_concat_of_distinct_values(spark, graph):
    row = Engine(spark, graph).sparql("SELECT (GROUP_CONCAT(DISTINCT ?k ; SEPARATOR = \"|\") AS ?g) { ?s <urn:p> ?o BIND(\"k\" AS ?k) }").first()
    assert row["g"] == "k"


def test_update_data_takes_no_variables(spark, graph):
    with pytest.raises(ValueError):
        Engine(spark, graph).update("INSERT DATA { ?x <urn:p> 1 }")


def test_load_reads_turtle_and_parquet(spark, graph, tmp_path):
    graph.df.write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.ttl").write_text("<urn:a> <urn:p> <urn:b> .\n")
    after = Engine(spark, Triples.of(spark, [])).update(f"LOAD <{tmp_path}/t.parquet> ; LOAD <{tmp_path}/t.ttl> INTO GRAPH <urn:g>")
    assert after.default.frame(spark).count() == 3 and after.named["urn:g"].frame(spark).count() == 1
