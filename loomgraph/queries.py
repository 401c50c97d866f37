"""Queries over the shared tables, one or more for each operator, and the SQL that each must agree with.

The tables are seen as triples: a row is a node ``urn:t:<table>/<key>``, a column a property ``urn:t:<column>``, a foreign
key an object IRI.  Rows of lineitem are also reified statements that an order contains a part, which is what the views
over triple terms read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph import terms as T
from loomgraph.engine import Engine
from loomgraph.plans.views import View
from loomgraph.sources.graphs import Catalog, Property, TableGraph, Triples, UnionGraph

NS = "urn:t:"
PREFIXES = f"PREFIX : <{NS}> PREFIX rdf: <{T.RDF}> PREFIX xsd: <{T.XSD}>\n"


def prop(name: str, **how) -> Property:
    return Property(T.iri(NS + name), **how)


def columns(*names: str) -> list[Property]:
    return [prop(n, column=n) for n in names]


def table(spark: SparkSession, sf_dir: str, name: str, subject: str, *properties: Property, unique: bool = True) -> TableGraph:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kind = Property(T.iri(T.RDF + "type"), constant=T.iri(NS + name))
    return TableGraph(name, df, NS + subject, (kind, *properties), unique)


def graphs() -> dict[str, Callable[[SparkSession, str], TableGraph]]:
    """Each table as triples, opened when asked for."""
    t = lambda name, subject, *p: lambda spark, sf_dir: table(spark, sf_dir, name, subject, *p)
    line = "line/{l_orderkey}/{l_linenumber}/{l_partkey}/{l_suppkey}"
    return {
        "region": t("region", "region/{r_regionkey}", *columns("r_regionkey", "r_name")),
        "nation": t("nation", "nation/{n_nationkey}", *columns("n_nationkey", "n_name"), prop("n_region", template=NS + "region/{n_regionkey}")),
        "customer": t("customer", "customer/{c_custkey}", *columns("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), prop("c_nation", template=NS + "nation/{c_nationkey}")),
        "supplier": t("supplier", "supplier/{s_suppkey}", *columns("s_suppkey", "s_name", "s_acctbal"), prop("s_nation", template=NS + "nation/{s_nationkey}")),
        "part": t("part", "part/{p_partkey}", *columns("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        "orders": t("orders", "order/{o_orderkey}", *columns("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), prop("o_customer", template=NS + "customer/{o_custkey}")),
        "lineitem": t(
            "lineitem", line, *columns("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber"),
            Property(T.iri(T.RDF + "subject"), template=NS + "order/{l_orderkey}"), Property(T.iri(T.RDF + "predicate"), constant=T.iri(NS + "contains")), Property(T.iri(T.RDF + "object"), template=NS + "part/{l_partkey}"),
            prop("l_supplier", template=NS + "supplier/{l_suppkey}"),
        ),
        "events": t("events", "event/{event_id}", *columns("event_id", "ts", "event_type", "value"), prop("e_user", template=NS + "user/{user_id}")),
        "documents": t("documents", "document/{doc_id}", *columns("doc_id", "lang", "source", "n_chars")),
        "labels": t("labels", "document/{doc_id}", *columns("quality", "toxic")),
    }


def source(spark: SparkSession, sf_dir: str, *names: str) -> UnionGraph:
    known = graphs()
    return UnionGraph(tuple(known[n](spark, sf_dir) for n in names or known))


#: Views that queries are asked over.
REIFIED = PREFIXES + "CONSTRUCT { ?t rdf:reifies <<( ?s ?p ?o )>> } WHERE { ?t rdf:subject ?s ; rdf:predicate ?p ; rdf:object ?o }"
PLAIN = PREFIXES + "CONSTRUCT WHERE { ?s ?p ?o }"
CONTAINS = PREFIXES + "CONSTRUCT { ?s ?p ?o } WHERE { ?t rdf:subject ?s ; rdf:predicate ?p ; rdf:object ?o }"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Those asked over views, which can also be run by way of their text over the source.
OVER_VIEWS: dict[str, Callable[..., DataFrame]] = {}


def query(name: str, text: str, sql: str | None, *tables: str, view: list[str] | None = None, generalized: bool = False, **how) -> None:
    """Registers a query over the named tables, directly or over views."""

    def run(spark: SparkSession, sf_dir: str, rewritten: bool = False) -> DataFrame:
        views = View.from_construct([PREFIXES + v if not v.startswith("PREFIX") else v for v in view], generalized) if view else None
        engine = Engine(spark, source(spark, sf_dir, *tables), views, **how)
        if rewritten:  # the same by way of text over the source
            return Engine(spark, engine.catalog, generalized=generalized, mint=engine.options.mint, mint_name=engine.options.mint_name).sparql(engine.rewrite(PREFIXES + text))
        return engine.sparql(PREFIXES + text)

    run.__name__ = name
    _QUERIES[name] = run
    if view:
        OVER_VIEWS[name] = run
    if sql:
        _SQL[name] = sql


def special(name: str, sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scans and sources -----------------------------------------------------------------------------------------------

query("triple_term_pattern", "SELECT ?s ?o ?q { ?t rdf:reifies <<( ?s :contains ?o )>> . ?t :l_quantity ?q }",
      "SELECT 'urn:t:order/'||l_orderkey AS s, 'urn:t:part/'||l_partkey AS o, l_quantity AS q FROM lineitem", "lineitem", view=[REIFIED, PLAIN])
query("pattern_scan", "SELECT ?o ?price { ?o :o_totalprice ?price }", "SELECT 'urn:t:order/'||o_orderkey AS o, o_totalprice AS price FROM orders", "orders")
query("bgp_join", "SELECT ?o ?n { ?o :o_customer ?c . ?c :c_nation ?x . ?x :n_name ?n }",
      "SELECT 'urn:t:order/'||o_orderkey AS o, n_name AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey", "orders", "customer", "nation")
query("unit", "SELECT (1 AS ?one) ?x {}", "SELECT 1::BIGINT AS one, NULL::VARCHAR AS x", "region")
query("empty", "SELECT ?r { ?r :r_name ?n FILTER(false) }", "SELECT r_name AS r FROM region WHERE false", "region")
query("reified_sugar", "SELECT ?s ?o ?q { << ?s :contains ?o >> :l_quantity ?q ; :l_returnflag \"R\" }",
      "SELECT 'urn:t:order/'||l_orderkey AS s, 'urn:t:part/'||l_partkey AS o, l_quantity AS q FROM lineitem WHERE l_returnflag='R'", "lineitem", view=[REIFIED, PLAIN])
query("values_inline", "SELECT ?r ?x { VALUES (?n ?x) { (\"ASIA\" 1) (\"EUROPE\" 2) (\"EUROPE\" 2) (UNDEF 3) } ?r :r_name ?n }",
      "SELECT 'urn:t:region/'||r_regionkey AS r, x FROM (VALUES ('ASIA',1::BIGINT),('EUROPE',2),('EUROPE',2)) v(n,x) JOIN region ON r_name=n UNION ALL SELECT 'urn:t:region/'||r_regionkey, 3 FROM region", "region")
query("view_scan_contains", "SELECT ?o ?p { ?o :contains ?p }", "SELECT 'urn:t:order/'||l_orderkey AS o, 'urn:t:part/'||l_partkey AS p FROM lineitem", "lineitem", view=[CONTAINS])
query("view_scan_variable_predicate", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p",
      "SELECT 'urn:t:contains' AS p, count(*) AS n FROM lineitem UNION ALL SELECT p, n FROM (SELECT unnest(['urn:t:n_nationkey','urn:t:n_name','urn:t:n_region','" + T.RDF + "type']) AS p, count(*) AS n FROM nation GROUP BY 1)",
      "lineitem", "nation", view=[CONTAINS, "CONSTRUCT { ?s ?p ?o } WHERE { ?s a :nation ; ?p ?o }"])
query("select_star", "SELECT * { ?r :r_name ?name ; :r_regionkey ?key }", "SELECT r_regionkey::BIGINT AS key, r_name AS name, 'urn:t:region/'||r_regionkey AS r FROM region", "region")
query("pattern_repeat", "SELECT ?x { ?x :near ?x }", "SELECT 'urn:t:nation/'||c_nationkey AS x FROM customer JOIN supplier ON c_nationkey=s_nationkey", "customer", "supplier",
      view=["CONSTRUCT { ?n :near ?m } WHERE { ?c :c_nation ?n . ?s :s_nation ?m . ?c :c_mktsegment ?g FILTER(?g != \"none\") }"])
query("pattern_repeat_scan", "SELECT ?l { ?l ?q ?l }", "SELECT 'urn:t:region/'||r_regionkey AS l FROM region", "region", view=["CONSTRUCT { ?r :itself ?r . ?r :name ?n } WHERE { ?r :r_name ?n }"])
query("pattern_ground", "SELECT ?r { ?r :r_name ?n . :region/0 a :region }".replace(":region/0", "<urn:t:region/0>"), "SELECT 'urn:t:region/'||r_regionkey AS r FROM region WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey=0)", "region")
query("pattern_constant_subject", "SELECT ?n ?b { <urn:t:customer/7> :c_name ?n ; :c_acctbal ?b }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey=7", "customer")

# --- projections and filters ------------------------------------------------------------------------------------------

query("project", "SELECT ?p ?nothing { ?p :p_name ?n ; :p_size ?s }", "SELECT 'urn:t:part/'||p_partkey AS p, NULL::VARCHAR AS nothing FROM part", "part")
query("subselect_scope", "SELECT ?c ?b { { SELECT ?c { ?c :c_mktsegment ?b } } ?c :c_acctbal ?b }", "SELECT 'urn:t:customer/'||c_custkey AS c, c_acctbal AS b FROM customer", "customer")
query("bind_extend", "SELECT ?l ?net { ?l :l_extendedprice ?e ; :l_discount ?d BIND(?e * (1 - ?d) AS ?net) }",
      "SELECT 'urn:t:line/'||l_orderkey||'/'||l_linenumber||'/'||l_partkey||'/'||l_suppkey AS l, l_extendedprice*(1-l_discount) AS net FROM lineitem", "lineitem")
query("bind_error_keeps_row", "SELECT ?r ?x { ?r :r_name ?n BIND(?n + 1 AS ?x) }", "SELECT 'urn:t:region/'||r_regionkey AS r, NULL::VARCHAR AS x FROM region", "region")
query("filter_basic", "SELECT ?l ?q { ?l :l_quantity ?q ; :l_discount ?d FILTER(?q > 45 && ?d >= 0.05) }",
      "SELECT 'urn:t:line/'||l_orderkey||'/'||l_linenumber||'/'||l_partkey||'/'||l_suppkey AS l, l_quantity AS q FROM lineitem WHERE l_quantity>45 AND l_discount>=0.05", "lineitem")
query("filter_date", "SELECT ?o { ?o :o_orderdate ?d FILTER(?d >= \"1997-01-01T00:00:00\"^^xsd:dateTime) }", "SELECT 'urn:t:order/'||o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'", "orders")
query("exists_semi", "SELECT ?c { ?c :c_name ?n FILTER EXISTS { ?o :o_customer ?c ; :o_orderstatus \"F\" } }",
      "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F')", "customer", "orders")
query("not_exists_anti", "SELECT ?c { ?c :c_name ?n FILTER NOT EXISTS { ?o :o_customer ?c ; :o_orderstatus \"F\" } }",
      "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F')", "customer", "orders")
query("exists_correlated_filter", "SELECT ?c { ?c :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > ?b * 40) } }",
      "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > c_acctbal*40)", "customer", "orders")
query("exists_nested", "SELECT ?c { ?c :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?c FILTER NOT EXISTS { ?o :o_totalprice ?t FILTER(?t < ?b * 20) } } }",
      "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey=c_custkey AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey=o.o_orderkey AND p.o_totalprice < c_acctbal*20))", "customer", "orders")
query("exists_expr", "SELECT ?d ?labelled { ?d :lang ?l BIND(EXISTS { ?d :quality ?q } AS ?labelled) }",
      "SELECT 'urn:t:document/'||doc_id AS d, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=documents.doc_id) AS labelled FROM documents", "documents", "labels")
query("exists_in_disjunction", "SELECT ?d { ?d :lang ?l FILTER(?l = \"de\" || EXISTS { ?d :toxic 1 }) }",
      "SELECT 'urn:t:document/'||doc_id AS d FROM documents WHERE lang='de' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=documents.doc_id AND toxic=1)", "documents", "labels")
query("unstable_guard", "SELECT ?r (?x = ?y AS ?same) (?x = ?z AS ?other) { ?r :r_name ?n BIND(RAND() AS ?x) BIND(?x AS ?y) BIND(RAND() AS ?z) FILTER(?x + 1 > ?y) }", "SELECT 'urn:t:region/'||r_regionkey AS r, true AS same, false AS other FROM region", "region")
query("bnode_scope", "SELECT ?r (sameTerm(?a, ?b) AS ?same) (sameTerm(?a, ?c) AS ?other) { ?r :r_name ?n BIND(BNODE(?n) AS ?a) BIND(BNODE(?n) AS ?b) BIND(BNODE(\"x\") AS ?c) }", "SELECT 'urn:t:region/'||r_regionkey AS r, true AS same, false AS other FROM region", "region")
query("bnode_by_solution", "SELECT (COUNT(DISTINCT ?a) AS ?n) { ?c :c_mktsegment ?m BIND(BNODE(?m) AS ?a) }", "SELECT count(*) AS n FROM customer", "customer")
query("exists_maybe_bound", "SELECT ?d { ?d :lang ?l OPTIONAL { ?d :toxic ?x } FILTER EXISTS { ?e :quality ?y ; :toxic ?x } }",
      "SELECT 'urn:t:document/'||d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id WHERE CASE WHEN toxic IS NULL THEN EXISTS (SELECT 1 FROM labels) ELSE EXISTS (SELECT 1 FROM labels m WHERE m.toxic=l.toxic) END", "documents", "labels")

# --- joins -------------------------------------------------------------------------------------------------------------

query("join_inner", "SELECT ?s ?l ?q { { ?l :l_supplier ?s } { ?l :l_quantity ?q } }",
      "SELECT 'urn:t:supplier/'||l_suppkey AS s, 'urn:t:line/'||l_orderkey||'/'||l_linenumber||'/'||l_partkey||'/'||l_suppkey AS l, l_quantity AS q FROM lineitem", "lineitem")
query("join_compat", "SELECT ?d ?q { { ?d :lang \"fr\" OPTIONAL { ?d :quality ?q } } VALUES ?q { 0 1 } }",
      "SELECT 'urn:t:document/'||d.doc_id AS d, v.q FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id JOIN (VALUES (0::BIGINT),(1)) v(q) ON l.quality IS NULL OR l.quality=v.q WHERE lang='fr'", "documents", "labels")
query("join_cross", "SELECT ?a ?b { ?a :r_name ?x . ?b :n_name ?y }", "SELECT 'urn:t:region/'||r_regionkey AS a, 'urn:t:nation/'||n_nationkey AS b FROM region, nation", "region", "nation")
query("join_theta", "SELECT ?a ?b { ?a :s_acctbal ?x ; :s_nation ?n . ?b :s_acctbal ?y ; :s_nation ?n FILTER(?x > ?y) }",
      "SELECT 'urn:t:supplier/'||a.s_suppkey AS a, 'urn:t:supplier/'||b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey=b.s_nationkey AND a.s_acctbal>b.s_acctbal", "supplier")
query("optional_left", "SELECT ?d ?q { ?d :lang ?l OPTIONAL { ?d :quality ?q } }",
      "SELECT 'urn:t:document/'||d.doc_id AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id", "documents", "labels")
query("optional_cond", "SELECT ?d ?q { ?d :n_chars ?n OPTIONAL { ?d :quality ?q FILTER(?n > 2000 && ?q = 1) } }",
      "SELECT 'urn:t:document/'||d.doc_id AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id AND n_chars>2000 AND quality=1", "documents", "labels")
query("optional_nested", "SELECT ?n ?r ?c { ?r :r_name ?x OPTIONAL { ?n :n_region ?r OPTIONAL { ?c :c_nation ?n ; :c_acctbal ?b FILTER(?b > 9900) } } }",
      "SELECT 'urn:t:nation/'||n_nationkey AS n, 'urn:t:region/'||r_regionkey AS r, 'urn:t:customer/'||c_custkey AS c FROM region LEFT JOIN (nation LEFT JOIN customer ON c_nationkey=n_nationkey AND c_acctbal>9900) ON n_regionkey=r_regionkey", "region", "nation", "customer")
query("optional_exists_cond", "SELECT ?n ?r { ?r :r_name ?x OPTIONAL { ?n :n_region ?r FILTER EXISTS { ?s :s_nation ?n ; :s_acctbal ?b FILTER(?b > 5000) } } }",
      "SELECT 'urn:t:nation/'||n_nationkey AS n, 'urn:t:region/'||r_regionkey AS r FROM region LEFT JOIN nation ON n_regionkey=r_regionkey AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal>5000)", "region", "nation", "supplier")
query("minus_anti", "SELECT ?c { ?c :c_name ?n MINUS { ?o :o_customer ?c ; :o_orderstatus \"F\" } }",
      "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')", "customer", "orders")
query("minus_disjoint", "SELECT ?c { ?c :c_name ?n MINUS { ?x :r_name ?y } }", "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer", "customer", "region")
query("minus_undef", "SELECT ?d ?q { { ?d :lang \"es\" OPTIONAL { ?d :quality ?q } } MINUS { VALUES (?d2 ?q) { (1 1) (UNDEF 0) } } }",
      "SELECT 'urn:t:document/'||d.doc_id AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id WHERE lang='es' AND quality IS NULL", "documents", "labels")

# --- aggregation ----------------------------------------------------------------------------------------------------

query("group_by", "SELECT ?f ?s (SUM(?q) AS ?sum_q) (COUNT(*) AS ?n) { ?l :l_returnflag ?f ; :l_linestatus ?s ; :l_quantity ?q } GROUP BY ?f ?s",
      "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_q, count(*) AS n FROM lineitem GROUP BY ALL", "lineitem")
query("group_by_unbound_key", "SELECT ?q (COUNT(*) AS ?n) { ?d :lang ?l OPTIONAL { ?d :quality ?q } } GROUP BY ?q",
      "SELECT quality::BIGINT AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id GROUP BY 1", "documents", "labels")
query("agg_global", "SELECT (COUNT(?o) AS ?n) (SUM(?t) AS ?s) { ?o :o_totalprice ?t FILTER(?t < 0) }", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_totalprice<0", "orders")
query("agg_count", "SELECT ?c (COUNT(?q) AS ?n) (COUNT(DISTINCT ?q) AS ?d) { ?x :lang ?c OPTIONAL { ?x :quality ?q } } GROUP BY ?c",
      "SELECT lang AS c, count(quality) AS n, count(DISTINCT quality) AS d FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id GROUP BY 1", "documents", "labels")
query("agg_count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) { { SELECT ?f ?s { ?l :l_returnflag ?f ; :l_linestatus ?s } } }", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)", "lineitem")
query("agg_sum", "SELECT ?n (SUM(?b) AS ?total) { ?c :c_nation ?n ; :c_acctbal ?b } GROUP BY ?n", "SELECT 'urn:t:nation/'||c_nationkey AS n, sum(c_acctbal) AS total FROM customer GROUP BY 1", "customer")
query("agg_avg", "SELECT ?n (AVG(?b) AS ?mean) { ?c :c_nation ?n ; :c_acctbal ?b } GROUP BY ?n", "SELECT 'urn:t:nation/'||c_nationkey AS n, avg(c_acctbal) AS mean FROM customer GROUP BY 1", "customer")
query("agg_sum_error", "SELECT ?l (SUM(?q) AS ?s) { ?d :lang ?l OPTIONAL { ?d :quality ?q } } GROUP BY ?l",
      "SELECT lang AS l, CASE WHEN count(*)=count(quality) THEN sum(quality)::BIGINT END AS s FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id GROUP BY 1", "documents", "labels")
query("agg_minmax", "SELECT ?s (MIN(?t) AS ?low) (MAX(?t) AS ?high) (MAX(?d) AS ?last) { ?o :o_orderstatus ?s ; :o_totalprice ?t ; :o_orderdate ?d } GROUP BY ?s",
      "SELECT o_orderstatus AS s, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_orderdate) AS last FROM orders GROUP BY 1", "orders")
query("agg_sample", "SELECT ?c (SAMPLE(?n) AS ?name) { ?c :c_name ?n } GROUP BY ?c", "SELECT 'urn:t:customer/'||c_custkey AS c, c_name AS name FROM customer", "customer")
query("agg_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?names) { ?x :n_region ?r ; :n_name ?n } GROUP BY ?r",
      "SELECT 'urn:t:region/'||n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1", "nation")
query("agg_distinct", "SELECT ?f (SUM(DISTINCT ?q) AS ?s) (COUNT(DISTINCT ?p) AS ?n) { ?l :l_returnflag ?f ; :l_quantity ?q ; rdf:object ?p } GROUP BY ?f",
      "SELECT l_returnflag AS f, sum(DISTINCT l_quantity) AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1", "lineitem")
query("having", "SELECT ?c (COUNT(?o) AS ?n) { ?o :o_customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)", "SELECT 'urn:t:customer/'||o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>12", "orders")
query("agg_expr", "SELECT ?y (SUM(?e * (1 - ?d)) AS ?revenue) { ?l :l_extendedprice ?e ; :l_discount ?d ; :l_shipdate ?t } GROUP BY (YEAR(?t) AS ?y)",
      "SELECT year(l_shipdate) AS y, sum(l_extendedprice*(1-l_discount)) AS revenue FROM lineitem GROUP BY 1", "lineitem")
query("agg_exists", "SELECT ?n (SUM(IF(EXISTS { ?o :o_customer ?c ; :o_orderstatus \"F\" }, 1, 0)) AS ?k) { ?c :c_nation ?n } GROUP BY ?n",
      "SELECT 'urn:t:nation/'||c_nationkey AS n, sum(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F') THEN 1 ELSE 0 END)::BIGINT AS k FROM customer GROUP BY 1", "customer", "orders")

# --- order, slices, sets -----------------------------------------------------------------------------------------------

query("order_by", "SELECT ?c ?b { ?c :c_acctbal ?b } ORDER BY DESC(?b) ?c", "SELECT 'urn:t:customer/'||c_custkey AS c, c_acctbal AS b FROM customer", "customer")
query("limit_offset", "SELECT ?c { ?c :c_name ?n } ORDER BY ?n LIMIT 10 OFFSET 5", "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer ORDER BY c_name LIMIT 10 OFFSET 5", "customer")
query("topk", "SELECT ?c ?b { ?c :c_acctbal ?b ; :c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 20", "SELECT 'urn:t:customer/'||c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "customer")
query("subselect_topk", "SELECT ?o ?c { { SELECT ?c { ?c :c_acctbal ?b ; :c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 5 } ?o :o_customer ?c }",
      "SELECT 'urn:t:order/'||o_orderkey AS o, 'urn:t:customer/'||o_custkey AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)", "customer", "orders")
query("union_bag", "SELECT ?x { { ?s :s_acctbal ?x } UNION { ?c :c_acctbal ?x } }", "SELECT s_acctbal AS x FROM supplier UNION ALL SELECT c_acctbal FROM customer", "supplier", "customer")
query("union_unbound", "SELECT ?s ?c { { ?s :s_name ?x } UNION { ?c :c_name ?x } }", "SELECT 'urn:t:supplier/'||s_suppkey AS s, NULL AS c FROM supplier UNION ALL SELECT NULL, 'urn:t:customer/'||c_custkey FROM customer", "supplier", "customer")
query("distinct", "SELECT DISTINCT ?n ?s { ?c :c_nation ?n ; :c_mktsegment ?s }", "SELECT DISTINCT 'urn:t:nation/'||c_nationkey AS n, c_mktsegment AS s FROM customer", "customer")
query("reduced", "SELECT REDUCED ?s { ?c :c_mktsegment ?s }", "SELECT c_mktsegment AS s FROM customer", "customer")

# --- paths -------------------------------------------------------------------------------------------------------------

query("path_link", "SELECT ?s ?o { ?s <urn:t:n_region> ?o }", "SELECT 'urn:t:nation/'||n_nationkey AS s, 'urn:t:region/'||n_regionkey AS o FROM nation", "nation")
query("path_inverse", "SELECT ?r ?n { ?r ^:n_region ?n }", "SELECT 'urn:t:region/'||n_regionkey AS r, 'urn:t:nation/'||n_nationkey AS n FROM nation", "nation")
query("path_seq", "SELECT ?o ?r { ?o :o_customer/:c_nation/:n_region ?r }",
      "SELECT 'urn:t:order/'||o_orderkey AS o, 'urn:t:region/'||n_regionkey AS r FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey", "orders", "customer", "nation")
query("path_seq_bag", "SELECT ?r ?m { ?r ^:n_region/^:c_nation/:c_mktsegment ?m }", "SELECT 'urn:t:region/'||n_regionkey AS r, c_mktsegment AS m FROM nation JOIN customer ON c_nationkey=n_nationkey", "customer", "nation")
query("path_alt", "SELECT ?x ?n { ?x :c_nation|:s_nation ?n }", "SELECT 'urn:t:customer/'||c_custkey AS x, 'urn:t:nation/'||c_nationkey AS n FROM customer UNION ALL SELECT 'urn:t:supplier/'||s_suppkey, 'urn:t:nation/'||s_nationkey FROM supplier", "customer", "supplier")
query("path_negated", "SELECT ?o ?x { ?o a :orders ; !(rdf:type|:o_orderkey|:o_totalprice|:o_orderdate|:o_customer) ?x }",
      "SELECT DISTINCT 'urn:t:order/'||o_orderkey AS o, x FROM (SELECT o_orderkey, o_orderstatus AS x FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders)", "orders")
query("path_opt_vv", "SELECT ?a ?b { ?a a :nation ; :n_region? ?b }", "SELECT 'urn:t:nation/'||n_nationkey AS a, 'urn:t:region/'||n_regionkey AS b FROM nation UNION SELECT 'urn:t:nation/'||n_nationkey, 'urn:t:nation/'||n_nationkey FROM nation", "nation")
query("path_opt_vt", "SELECT ?a { ?a :n_region? <urn:t:region/1> }", "SELECT 'urn:t:nation/'||n_nationkey AS a FROM nation WHERE n_regionkey=1 UNION SELECT 'urn:t:region/1'", "nation")
query("path_opt_tt", "SELECT ?n { ?x :r_name ?n . <urn:t:nation/0> :n_region? <urn:t:nation/0> . <urn:t:nation/0> :n_region? <urn:t:region/0> }",
      "SELECT r_name AS n FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey=0 AND n_regionkey=0)", "region", "nation")
query("path_closure_body", "SELECT ?x ?r { ?x :within ?r }",
      "SELECT 'urn:t:customer/'||c_custkey AS x, 'urn:t:nation/'||c_nationkey AS r FROM customer UNION SELECT 'urn:t:customer/'||c_custkey, 'urn:t:region/'||n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey UNION SELECT 'urn:t:nation/'||n_nationkey, 'urn:t:region/'||n_regionkey FROM nation",
      "customer", "nation", view=["CONSTRUCT { ?x :within ?r } WHERE { ?x (:c_nation|:n_region)+ ?r }"])

# --- views -------------------------------------------------------------------------------------------------------------

query("view_multi_template", "SELECT ?x ?y { ?x :knows ?y }", "SELECT 'urn:t:customer/'||c_custkey AS x, 'urn:t:nation/'||c_nationkey AS y FROM customer UNION ALL SELECT 'urn:t:nation/'||c_nationkey, 'urn:t:customer/'||c_custkey FROM customer",
      "customer", view=["CONSTRUCT { ?c :knows ?n . ?n :knows ?c } WHERE { ?c :c_nation ?n }"])
query("view_single_head", "SELECT ?c { ?c a :Rich }", "SELECT 'urn:t:customer/'||c_custkey AS c FROM customer WHERE c_acctbal>9000", "customer", view=["CONSTRUCT { ?c a :Rich } WHERE { ?c :c_acctbal ?b FILTER(?b > 9000) }"])
query("view_merge", "SELECT ?x ?n { ?x :name ?n . ?x :balance ?b FILTER(?b < 0) }", "SELECT 'urn:t:customer/'||c_custkey AS x, c_name AS n FROM customer WHERE c_acctbal<0 UNION ALL SELECT 'urn:t:supplier/'||s_suppkey, s_name FROM supplier WHERE s_acctbal<0",
      "customer", "supplier", view=["CONSTRUCT { ?c :name ?n ; :balance ?b } WHERE { ?c :c_name ?n ; :c_acctbal ?b }", "CONSTRUCT { ?c :name ?n ; :balance ?b } WHERE { ?c :s_name ?n ; :s_acctbal ?b }"])
query("view_optional_body", "SELECT ?d ?q { ?d :rated ?q }", "SELECT 'urn:t:document/'||doc_id AS d, quality::BIGINT AS q FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)", "documents", "labels", view=["CONSTRUCT { ?d :rated ?q } WHERE { ?d :lang ?l OPTIONAL { ?d :quality ?q } }"])
query("view_type_test", "SELECT ?x ?y { ?x :valueOf ?y }", "SELECT 'urn:t:region/'||n_regionkey AS x, 'urn:t:nation/'||n_nationkey AS y FROM nation", "nation", view=["CONSTRUCT { ?o :valueOf ?s } WHERE { ?s :n_region|:n_name ?o }"])
query("view_generalized", "SELECT ?x ?y { ?x :valueOf ?y }", "SELECT 'urn:t:region/'||n_regionkey AS x, 'urn:t:nation/'||n_nationkey AS y FROM nation UNION ALL SELECT n_name, 'urn:t:nation/'||n_nationkey FROM nation",
      "nation", view=["CONSTRUCT { ?o :valueOf ?s } WHERE { ?s :n_region|:n_name ?o }"], generalized=True)
query("view_bag", "SELECT ?n ?m { ?n :serves ?m }", "SELECT 'urn:t:nation/'||c_nationkey AS n, c_mktsegment AS m FROM customer", "customer", view=["CONSTRUCT { ?n :serves ?m } WHERE { ?c :c_nation ?n ; :c_mktsegment ?m }"])
query("view_dedup", "SELECT ?n ?m { ?n :serves ?m }", "SELECT DISTINCT 'urn:t:nation/'||c_nationkey AS n, c_mktsegment AS m FROM customer", "customer", view=["CONSTRUCT { ?n :serves ?m } WHERE { ?c :c_nation ?n ; :c_mktsegment ?m }"], dedup=True)
query("view_dedup_ground", "SELECT ?r { ?r :r_name ?n . :shop :is :open }", "SELECT 'urn:t:region/'||r_regionkey AS r FROM region WHERE EXISTS (SELECT 1 FROM nation)", "region", "nation",
      view=["CONSTRUCT { :shop :is :open } WHERE { ?n :n_name ?x }", "CONSTRUCT { ?r :r_name ?n } WHERE { ?r :r_name ?n }"], dedup=True)
query("view_triple_term_annotations", "SELECT ?o (SUM(?e) AS ?v) { ?t rdf:reifies <<( ?o :contains ?p )>> ; :l_extendedprice ?e ; :l_returnflag \"R\" . ?p :p_brand ?b FILTER(STRSTARTS(?b, \"Brand#1\")) } GROUP BY ?o",
      "SELECT 'urn:t:order/'||l_orderkey AS o, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_returnflag='R' AND starts_with(p_brand, 'Brand#1') GROUP BY 1", "lineitem", "part", view=[REIFIED, PLAIN])
query("view_triple_term_accessors", "SELECT ?who (COUNT(*) AS ?n) { ?t rdf:reifies ?x BIND(OBJECT(?x) AS ?who) FILTER(isTRIPLE(?x) && PREDICATE(?x) = :contains) } GROUP BY ?who",
      "SELECT 'urn:t:part/'||l_partkey AS who, count(*) AS n FROM lineitem GROUP BY 1", "lineitem", view=[REIFIED])

# --- functions ------------------------------------------------------------------------------------------------------

query("fn_logic", "SELECT ?o { ?o :o_orderstatus ?s ; :o_totalprice ?t FILTER(!(?s = \"F\") && (?t > 100000 || ?s = \"P\") || ?t + \"x\" > 1) }",
      "SELECT 'urn:t:order/'||o_orderkey AS o FROM orders WHERE o_orderstatus<>'F' AND (o_totalprice>100000 OR o_orderstatus='P')", "orders")
query("fn_compare", "SELECT ?p ?a ?b ?c ?d { ?p :p_size ?s ; :p_name ?n BIND(?s = 5.0 AS ?a) BIND(?s != 7 AS ?b) BIND(?s <= 10 AS ?c) BIND(?n > \"m\" AS ?d) }",
      "SELECT 'urn:t:part/'||p_partkey AS p, p_size=5 AS a, p_size<>7 AS b, p_size<=10 AS c, p_name>'m' AS d FROM part", "part")
query("fn_in", "SELECT ?p { ?p :p_size ?s ; :p_brand ?b FILTER(?s IN (1, 2, 3) && ?b NOT IN (\"Brand#11\", \"Brand#12\")) }", "SELECT 'urn:t:part/'||p_partkey AS p FROM part WHERE p_size IN (1,2,3) AND p_brand NOT IN ('Brand#11','Brand#12')", "part")
query("fn_arithmetic", "SELECT ?p ?a ?b ?c ?d ?e { ?p :p_size ?s ; :p_retailprice ?r BIND(?s + 1 AS ?a) BIND(?r - ?s AS ?b) BIND(?r * 2 AS ?c) BIND(?r / 4e0 AS ?d) BIND(-?s AS ?e) }",
      "SELECT 'urn:t:part/'||p_partkey AS p, p_size::BIGINT+1 AS a, p_retailprice-p_size AS b, p_retailprice*2 AS c, p_retailprice/4 AS d, -(p_size::BIGINT) AS e FROM part", "part")
query("fn_round", "SELECT ?c ?a ?b ?d ?e { ?c :c_acctbal ?x BIND(ABS(?x) AS ?a) BIND(CEIL(?x) AS ?b) BIND(FLOOR(?x) AS ?d) BIND(ROUND(?x) AS ?e) }",
      "SELECT 'urn:t:customer/'||c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS d, floor(c_acctbal+0.5) AS e FROM customer", "customer")
query("fn_dates", "SELECT ?o ?y ?m ?d ?h ?i { ?o :o_orderdate ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?i) }",
      "SELECT 'urn:t:order/'||o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS i FROM orders", "orders")
query("fn_timezone", "SELECT ?x ?z ?t { VALUES ?x { \"2020-01-01T00:00:00Z\" \"2020-01-01T00:00:00-05:30\" } BIND(TZ(xsd:dateTime(?x)) AS ?z) BIND(TIMEZONE(xsd:dateTime(?x)) AS ?t) }",
      "SELECT * FROM (VALUES ('2020-01-01T00:00:00Z','Z','PT0S'),('2020-01-01T00:00:00-05:30','-05:30','-PT5H30M')) v(x,z,t)", "region")
query("fn_strings", "SELECT ?n ?a ?b ?c ?d ?e { ?n :n_name ?x BIND(STRLEN(?x) AS ?a) BIND(LCASE(?x) AS ?b) BIND(UCASE(?b) AS ?c) BIND(SUBSTR(?x, 2, 3) AS ?d) BIND(CONCAT(?x, \"-\", STR(?n)) AS ?e) }",
      "SELECT 'urn:t:nation/'||n_nationkey AS n, length(n_name) AS a, lower(n_name) AS b, upper(n_name) AS c, substr(n_name,2,3) AS d, n_name||'-urn:t:nation/'||n_nationkey AS e FROM nation", "nation")
query("fn_before_after", "SELECT ?p ?a ?b ?c { ?p :p_brand ?x BIND(STRBEFORE(?x, \"#\") AS ?a) BIND(STRAFTER(?x, \"#\") AS ?b) BIND(STRBEFORE(?x, \"zz\") AS ?c) }",
      "SELECT 'urn:t:part/'||p_partkey AS p, split_part(p_brand,'#',1) AS a, split_part(p_brand,'#',2) AS b, '' AS c FROM part", "part")
query("fn_contains", "SELECT ?p { ?p :p_type ?t ; :p_brand ?b FILTER(CONTAINS(?t, \"A\") && STRSTARTS(?b, \"Brand\") && STRENDS(?b, \"3\")) }", "SELECT 'urn:t:part/'||p_partkey AS p FROM part WHERE contains(p_type,'A') AND starts_with(p_brand,'Brand') AND ends_with(p_brand,'3')", "part")
query("fn_regex", "SELECT ?p ?r { ?p :p_brand ?b FILTER(REGEX(?b, \"^brand#[12]\", \"i\")) BIND(REPLACE(?b, \"([0-9])([0-9])\", \"$2$1\") AS ?r) }",
      "SELECT 'urn:t:part/'||p_partkey AS p, regexp_replace(p_brand,'([0-9])([0-9])','\\2\\1','g') AS r FROM part WHERE regexp_matches(p_brand,'^brand#[12]','i')", "part")
query("fn_hashes", "SELECT ?n ?a ?b ?c { ?n :n_name ?x BIND(MD5(?x) AS ?a) BIND(SHA1(?x) AS ?b) BIND(SHA256(?x) AS ?c) }", "SELECT 'urn:t:nation/'||n_nationkey AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation", "nation")
query("fn_encode_uri", "SELECT ?x ?e { VALUES ?x { \"a b*~/é\" \"x+y\" } BIND(ENCODE_FOR_URI(?x) AS ?e) }", "SELECT * FROM (VALUES ('a b*~/é','a%20b%2A~%2F%C3%A9'),('x+y','x%2By')) v(x,e)", "region")
query("fn_terms", "SELECT ?n ?a ?b ?c ?d { ?n :n_name ?x BIND(isIRI(?n) AS ?a) BIND(isLITERAL(?x) AS ?b) BIND(isBLANK(?x) AS ?c) BIND(isNUMERIC(?x) AS ?d) }", "SELECT 'urn:t:nation/'||n_nationkey AS n, true AS a, true AS b, false AS c, false AS d FROM nation", "nation")
query("fn_datatype", "SELECT ?p ?a ?b { ?p :p_size ?s ; :p_name ?n BIND(DATATYPE(?s) AS ?a) BIND(DATATYPE(?n) AS ?b) }", f"SELECT 'urn:t:part/'||p_partkey AS p, '{T.INTEGER}' AS a, '{T.STRING}' AS b FROM part", "part")
query("fn_lang", "SELECT ?v ?a ?b ?c { VALUES ?v { \"x\"@en-GB \"y\"@fr \"z\" } BIND(LANG(?v) AS ?a) BIND(LANGMATCHES(LANG(?v), \"en\") AS ?b) BIND(hasLANG(?v) AS ?c) }",
      "SELECT * FROM (VALUES ('x','en-gb',true,true),('y','fr',false,true),('z','',false,false)) t(v,a,b,c)", "region")
query("fn_strdt_strlang", "SELECT ?n ?a ?b { ?n :n_name ?x BIND(DATATYPE(STRDT(?x, :code)) AS ?a) BIND(LANG(STRLANG(?x, \"EN\")) AS ?b) }", "SELECT 'urn:t:nation/'||n_nationkey AS n, 'urn:t:code' AS a, 'en' AS b FROM nation", "nation")
query("fn_iri", "SELECT ?n ?i { ?n :n_nationkey ?k BIND(IRI(CONCAT(\"urn:t:nation/\", STR(?k))) AS ?i) FILTER(?i = ?n) }", "SELECT 'urn:t:nation/'||n_nationkey AS n, 'urn:t:nation/'||n_nationkey AS i FROM nation", "nation")
query("fn_triple", "SELECT ?n ?s ?o { ?n :n_region ?r BIND(TRIPLE(?n, :n_region, ?r) AS ?t) BIND(SUBJECT(?t) AS ?s) BIND(OBJECT(?t) AS ?o) FILTER(isTRIPLE(?t)) }",
      "SELECT 'urn:t:nation/'||n_nationkey AS n, 'urn:t:nation/'||n_nationkey AS s, 'urn:t:region/'||n_regionkey AS o FROM nation", "nation")
query("fn_bound_coalesce_if", "SELECT ?d ?b ?c ?i { ?d :lang ?l OPTIONAL { ?d :quality ?q } BIND(BOUND(?q) AS ?b) BIND(COALESCE(?q, -1) AS ?c) BIND(IF(?q = 1, \"good\", \"bad\") AS ?i) }",
      "SELECT 'urn:t:document/'||d.doc_id AS d, quality IS NOT NULL AS b, coalesce(quality,-1)::BIGINT AS c, CASE WHEN quality=1 THEN 'good' WHEN quality<>1 THEN 'bad' END AS i FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id", "documents", "labels")
query("fn_sameterm", "SELECT ?a ?b { ?a :n_region ?x . ?b :n_region ?y FILTER(sameTerm(?x, ?y)) }", "SELECT 'urn:t:nation/'||a.n_nationkey AS a, 'urn:t:nation/'||b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey", "nation")
query("fn_casts", "SELECT ?n ?a ?b ?c ?d ?e { ?n :n_nationkey ?k ; :n_name ?x BIND(xsd:double(?k) AS ?a) BIND(xsd:string(?k) AS ?b) BIND(xsd:integer(\"042\") AS ?c) BIND(xsd:boolean(?k) AS ?d) BIND(xsd:integer(?x) AS ?e) }",
      "SELECT 'urn:t:nation/'||n_nationkey AS n, n_nationkey::DOUBLE AS a, n_nationkey::VARCHAR AS b, 42::BIGINT AS c, n_nationkey<>0 AS d, NULL::BIGINT AS e FROM nation", "nation")
query("fn_now", "SELECT ?r { ?r :r_name ?n FILTER(YEAR(NOW()) > 2000) }", "SELECT 'urn:t:region/'||r_regionkey AS r FROM region", "region")
query("fn_uuid", "SELECT ?r ?k { ?r :r_name ?n BIND(STRLEN(STRUUID()) AS ?k) FILTER(isIRI(UUID()) && RAND() < 1) }", "SELECT 'urn:t:region/'||r_regionkey AS r, 36::BIGINT AS k FROM region", "region")
query("fn_ebv", "SELECT ?p { ?p :p_size ?s ; :p_name ?n FILTER(?s - 5) FILTER(?n) }", "SELECT 'urn:t:part/'||p_partkey AS p FROM part WHERE p_size<>5 AND length(p_name)>0", "part")


@special("fn_named", "SELECT 'urn:t:nation/'||n_nationkey AS n, reverse(n_name) AS r FROM nation")
def fn_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    reverse = lambda t: F.when(t.isNotNull(), T.make_struct(T.LITERAL, F.reverse(t["v"]), T.STRING))
    engine = Engine(spark, source(spark, sf_dir, "nation"), functions={NS + "reverse": reverse})
    return engine.sparql(PREFIXES + "SELECT ?n ?r { ?n :n_name ?x BIND(:reverse(?x) AS ?r) }")


# --- constructed nodes ---------------------------------------------------------------------------------------------

_MINT = "CONSTRUCT { ?o :entry ?e } WHERE { ?t rdf:subject ?o ; :l_linenumber ?n BIND(<internal://blank>(?o, ?n) AS ?e) }"
_ENC = "',iri,'||length('urn:t:order/'||l_orderkey)||':urn:t:order/'||l_orderkey||',literal,'||length(l_linenumber::VARCHAR)||':'||l_linenumber||',40:http://www.w3.org/2001/XMLSchema#integer,0:,0:'"
query("mint_iri", "SELECT ?o ?e { ?o :entry ?e }", f"SELECT 'urn:t:order/'||l_orderkey AS o, 'urn:n:'||sha1({_ENC}) AS e FROM lineitem", "lineitem", view=[_MINT], mint="iri", mint_name="urn:n:")
query("mint_literal", "SELECT ?o ?e { ?o :entry ?e }", f"SELECT 'urn:t:order/'||l_orderkey AS o, {_ENC} AS e FROM lineitem", "lineitem", view=[_MINT], mint="literal")
query("mint_encoding", "SELECT ?r ?e { ?r :r_name ?n BIND(<internal://blank>(?n, ?unbound, 1 + \"x\") AS ?e) }", "SELECT 'urn:t:region/'||r_regionkey AS r, ',literal,'||length(r_name)||':'||r_name||',39:http://www.w3.org/2001/XMLSchema#string,0:,0:,unbound,unbound' AS e FROM region", "region", mint="literal")
query("mint_node", "SELECT (COUNT(DISTINCT ?e) AS ?n) { ?o :entry ?e FILTER(isBLANK(?e)) }", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", "lineitem", view=[_MINT])

# --- forms, datasets, services, updates -----------------------------------------------------------------------------

query("ask_form", "ASK { ?c :c_acctbal ?b FILTER(?b > 9990) }", "SELECT count(*)>0 AS result FROM customer WHERE c_acctbal>9990", "customer")
query("construct_form", "CONSTRUCT { ?n :hasCustomer ?c . ?c :label ?x } WHERE { ?c :c_nation ?n ; :c_mktsegment ?x }",
      "SELECT 'urn:t:nation/'||c_nationkey AS s, 'urn:t:hasCustomer' AS p, 'urn:t:customer/'||c_custkey AS o FROM customer UNION SELECT 'urn:t:customer/'||c_custkey, 'urn:t:label', c_mktsegment FROM customer", "customer")
query("construct_where", "CONSTRUCT WHERE { ?n :n_region <urn:t:region/2> }", "SELECT 'urn:t:nation/'||n_nationkey AS s, 'urn:t:n_region' AS p, 'urn:t:region/2' AS o FROM nation WHERE n_regionkey=2", "nation")
query("describe_form", "DESCRIBE ?r { ?r :label \"ASIA\" }",
      "SELECT 'urn:t:region/'||r_regionkey AS s, p, o FROM (SELECT r_regionkey, unnest(['urn:t:r_regionkey','urn:t:r_name','" + T.RDF + "type']) AS p, unnest([r_regionkey::VARCHAR, r_name, 'urn:t:region']) AS o FROM region WHERE r_name='ASIA')",
      "region", view=["CONSTRUCT { ?r :label ?n } WHERE { ?r :r_name ?n }"])


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    known = {name: graphs()[name](spark, sf_dir) for name in ("region", "nation", "supplier", "customer")}
    return Catalog(UnionGraph((known["region"],)), {NS + "g/nations": known["nation"], NS + "g/suppliers": known["supplier"]}, {NS + "svc": known["customer"]})


@special("graph_body", "SELECT 'urn:t:g/nations' AS g, count(*) AS n FROM nation UNION ALL SELECT 'urn:t:g/suppliers', count(*) FROM supplier")
def graph_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View.from_construct(PREFIXES + "CONSTRUCT { ?s :in ?g } WHERE { GRAPH ?g { ?s a ?t } }")
    return Engine(spark, _catalog(spark, sf_dir), view).sparql(PREFIXES + "SELECT ?g (COUNT(?s) AS ?n) { ?s :in ?g } GROUP BY ?g")


@special("from_dataset", "SELECT n_name AS n FROM nation UNION ALL SELECT s_name FROM supplier")
def from_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _catalog(spark, sf_dir)).sparql(PREFIXES + "SELECT ?n FROM <urn:t:g/nations> FROM <urn:t:g/suppliers> { ?s :n_name|:s_name ?n }")


@special("service_named", "SELECT 'urn:t:region/'||r_regionkey AS r, count(*) AS n FROM region, customer WHERE c_acctbal>9000 GROUP BY 1")
def service_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View.from_construct(PREFIXES + "CONSTRUCT { ?r :label ?n } WHERE { ?r :r_name ?n }")
    text = "SELECT ?r (COUNT(*) AS ?n) { ?r :label ?x SERVICE :svc { ?c :c_acctbal ?b FILTER(?b > 9000) } SERVICE SILENT :gone { ?a ?b2 ?c2 } } GROUP BY ?r"
    return Engine(spark, _catalog(spark, sf_dir), view).sparql(PREFIXES + text)


def _updated(spark: SparkSession, sf_dir: str, text: str, *tables: str, view: str | None = None) -> DataFrame:
    views = View.from_construct(PREFIXES + view) if view else None
    after = Engine(spark, source(spark, sf_dir, *tables), views).update(PREFIXES + text)
    return Engine(spark, after).sparql("SELECT ?s ?p ?o { ?s ?p ?o }", out="lex")


_REGION = "SELECT 'urn:t:region/'||r_regionkey AS s, unnest(['urn:t:r_regionkey','urn:t:r_name','" + T.RDF + "type']) AS p, unnest([r_regionkey::VARCHAR, r_name, 'urn:t:region']) AS o FROM region"


@special("update_insert", f"{_REGION} UNION SELECT 'urn:t:region/'||r_regionkey, 'urn:t:seen', r_name FROM region")
def update_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, "INSERT { ?r :seen ?n } WHERE { ?r :label ?n }", "region", view="CONSTRUCT { ?r :label ?n } WHERE { ?r :r_name ?n }")


@special("update_delete", f"SELECT * FROM ({_REGION}) WHERE NOT (p='urn:t:r_name' AND o<>'ASIA')")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, "DELETE { ?r :r_name ?n } WHERE { ?r :r_name ?n FILTER(?n != \"ASIA\") }", "region")


@special("update_data", f"SELECT * FROM ({_REGION}) WHERE NOT (s='urn:t:region/0' AND p='urn:t:r_regionkey') UNION SELECT 'urn:t:x', 'urn:t:y', 'z'")
def update_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, "INSERT DATA { :x :y \"z\" } ; DELETE DATA { <urn:t:region/0> :r_regionkey 0 }", "region")


@special("update_seq", "SELECT 'urn:t:region/'||r_regionkey AS s, 'urn:t:b' AS p, r_name AS o FROM region")
def update_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, "INSERT { ?r :a ?n } WHERE { ?r :r_name ?n } ; DELETE { ?r ?p ?n } WHERE { ?r ?p ?n FILTER(?p != :a) } ; DELETE { ?r :a ?n } INSERT { ?r :b ?n } WHERE { ?r :a ?n }", "region")


@special("update_graphs", "SELECT 'urn:t:g/a' AS g, n_name AS n FROM nation WHERE n_regionkey=1 UNION ALL SELECT 'urn:t:g/'||n_regionkey, n_name FROM nation WHERE n_nationkey < 10")
def update_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates and data that name graphs, WITH and USING."""
    catalog = Catalog(Triples.of(spark, []), {NS + "g/nations": source(spark, sf_dir, "nation")})
    text = """INSERT { GRAPH :a { ?n :name ?x } } USING <urn:t:g/nations> WHERE { ?n :n_name ?x ; :n_region <urn:t:region/1> } ;
        WITH <urn:t:g/nations> INSERT { GRAPH ?g { ?n :name ?x } } WHERE { ?n :n_name ?x ; :n_nationkey ?k ; :n_region ?r FILTER(?k < 10) BIND(IRI(CONCAT("urn:t:g/", STRAFTER(STR(?r), "region/"))) AS ?g) } ;
        INSERT DATA { GRAPH <urn:t:g/a> { :gone :name "gone" } } ; INSERT { GRAPH <urn:t:g/a> { ?n :name ?x } } WHERE { GRAPH :a { ?n :name ?x } } ;
        DELETE DATA { GRAPH <urn:t:g/a> { :gone :name "gone" } } ; WITH :a DELETE { ?n :name ?x } WHERE { ?n :name ?x } ; DELETE WHERE { GRAPH <urn:t:g/nations> { ?n :n_name ?x } }"""
    after = Engine(spark, catalog).update(PREFIXES + text)
    return Engine(spark, after).sparql(PREFIXES + "SELECT ?g (?x AS ?n) { GRAPH ?g { ?s :name ?x } }")


@special("from_named", "SELECT 'urn:t:g/nations' AS g, count(*) AS n FROM nation")
def from_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _catalog(spark, sf_dir)).sparql(PREFIXES + "SELECT ?g (COUNT(?s) AS ?n) FROM NAMED <urn:t:g/nations> { GRAPH ?g { ?s a ?t } } GROUP BY ?g")


@special("mint_encoding_triples", """SELECT * FROM (VALUES ('<ex://a>', ',iri,6:ex://a'), ('a,b:c', ',literal,5:a,b:c,39:http://www.w3.org/2001/XMLSchema#string,0:,0:'), ('ltr', ',literal,1:a,56:http://www.w3.org/1999/02/22-rdf-syntax-ns#dirLangString,2:en,3:ltr'),
 ('triple', ',triple,iri,6:ex://a,iri,6:ex://p,literal,1:o,53:http://www.w3.org/1999/02/22-rdf-syntax-ns#langString,2:en,0:'), ('nested', ',triple,iri,6:ex://a,iri,6:ex://p,triple,iri,6:ex://b,iri,6:ex://q,iri,6:ex://c')) AS t(name, node)""")
def mint_encoding_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings of terms of every kind, read from a table of triples."""
    a, p = T.iri("ex://a"), T.iri("ex://p")
    terms = {"<ex://a>": a, "a,b:c": T.literal("a,b:c", T.STRING), "ltr": T.Term(T.LITERAL, "a", T.RDF + "dirLangString", "en", "ltr"), "triple": T.triple(a, p, T.Term(T.LITERAL, "o", T.RDF + "langString", "en")), "nested": T.triple(a, p, T.triple(T.iri("ex://b"), T.iri("ex://q"), T.iri("ex://c")))}
    graph = Triples.of(spark, [(T.iri(f"{NS}{i}"), q, o) for i, (name, term) in enumerate(terms.items()) for q, o in ((T.iri(NS + "name"), T.literal(name, T.STRING)), (T.iri(NS + "term"), term))])
    return Engine(spark, graph, mint="literal").sparql(PREFIXES + "SELECT ?name ?node { ?s :name ?name ; :term ?x BIND(<internal://blank>(?x) AS ?node) }")


@special("mint_encoding_built", "SELECT ',triple,iri,'||length('urn:t:region/'||r_regionkey)||':urn:t:region/'||r_regionkey||',iri,7:urn:t:q,triple,iri,7:urn:t:a,iri,7:urn:t:r,literal,'||length(r_name)||':'||r_name||',39:http://www.w3.org/2001/XMLSchema#string,0:,0:' AS n FROM region")
def mint_encoding_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple terms that the query builds, over a table of triples, nested."""
    graph = Triples(source(spark, sf_dir, "region").frame(spark))
    return Engine(spark, graph, mint="literal").sparql(PREFIXES + "SELECT ?n { ?s :r_name ?v BIND(<internal://blank>(TRIPLE(?s, :q, TRIPLE(:a, :r, ?v))) AS ?n) }")


@special("update_admin", "SELECT count(*)*3 AS n FROM nation")
def update_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    after = Engine(spark, catalog).update(PREFIXES + "CLEAR DEFAULT ; COPY <urn:t:g/nations> TO <urn:t:g/copy> ; CREATE GRAPH :new ; ADD <urn:t:g/copy> TO DEFAULT ; MOVE :new TO <urn:t:g/suppliers> ; DROP GRAPH <urn:t:g/nations>")
    return Engine(spark, after).sparql("SELECT (COUNT(*) AS ?n) { ?s ?p ?o FILTER(?p != rdf:type) }".replace("rdf:type", f"<{T.RDF}type>"))


@special("src_triples", "SELECT 'urn:t:region/'||n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def src_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic table of triples instead of the tables themselves."""
    frame = source(spark, sf_dir, "nation").frame(spark)
    return Engine(spark, Triples(frame)).sparql(PREFIXES + "SELECT ?r (COUNT(?x) AS ?n) { ?x :n_region ?r ; :n_name ?y } GROUP BY ?r")


@special("src_table", "SELECT event_type AS e, avg(value) AS v, count(DISTINCT user_id) AS u FROM events GROUP BY 1")
def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, source(spark, sf_dir, "events")).sparql(PREFIXES + "SELECT ?e (AVG(?x) AS ?v) (COUNT(DISTINCT ?w) AS ?u) { ?n :event_type ?e ; :value ?x ; :e_user ?w } GROUP BY ?e")


@special("src_table_non_unique", "SELECT DISTINCT 'urn:t:user/'||user_id AS s, event_type AS t FROM events")
def src_table_non_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = TableGraph("users", df, NS + "user/{user_id}", (prop("did", column="event_type"),), unique=False)
    return Engine(spark, users).sparql(PREFIXES + "SELECT ?s ?t { ?s :did ?t }")
