"""Registered queries of rules, entailment, shapes, mappings, templates and updates over the driver tables."""

from pyspark.sql import functions as F

from .engine import BASE, Engine, tables_source
from .operators.datalog import delete_quads, insert_quads, materialise_rules, parse_rules
from .operators.ottr import expand_table
from .operators.owl import entail
from .operators.rml import Mapper
from .operators.shacl import validate
from .operators.update import ChangeLog, Store
from .operators.vqs import Config, class_counts, edge_counts, index_table
from .plans.store import shared_dir
from .sources.quads import QuadSource, quads_of
from .sources.rdf import nquads_lines, read_ntriples
from .sources.results import json_bindings

EX = f"prefix ex: <{BASE}> "

def graph(spark, sf_dir, properties, classes=(), tables=None):
    """A quad table of some properties and classes of the driver tables."""
    source = tables_source(spark, sf_dir, tables)
    return QuadSource.from_quads(spark, quads_of(source, [BASE + p for p in properties], [BASE + c for c in classes]))


def with_text(spark, source, turtle):
    """The source with a Turtle text's statements added."""
    more = QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . " + turtle)
    return source.with_quads(source.quads.unionByName(more.quads).distinct(), more.terms)


def ask(source, text):
    return Engine(source).sparql(text)


NATIONS = ("c_nation", "n_region")


def datalog_transitive(spark, sf_dir):
    rules = parse_rules(EX + "ex:in[?x, ?y] :- ex:c_nation[?x, ?y] . ex:in[?x, ?y] :- ex:n_region[?x, ?y] . ex:in[?x, ?z] :- ex:in[?x, ?y], ex:in[?y, ?z] .")
    return ask(materialise_rules(graph(spark, sf_dir, NATIONS), rules), "SELECT ?x ?y WHERE { ?x :in ?y }")


def datalog_negation_stratified(spark, sf_dir):
    rules = parse_rules(EX + "ex:HasOrder[?c] :- ex:o_customer[?o, ?c] . ex:Idle[?c] :- ex:Customer[?c], NOT ex:HasOrder[?c] . ex:Watched[?n] :- ex:Idle[?c], ex:c_nation[?c, ?n] .")
    src = graph(spark, sf_dir, ("o_customer", "c_nation"), ("Customer",))
    return ask(materialise_rules(src, rules), "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x a ?k FILTER(?k IN (:HasOrder, :Idle, :Watched)) } GROUP BY ?k")


def datalog_filter_inequality(spark, sf_dir):
    rules = parse_rules(EX + "ex:Rich[?s] :- ex:s_acctbal[?s, ?b], FILTER(?b > 5000) . ex:peer[?a, ?b] :- ex:Rich[?a], ex:Rich[?b], ex:s_nation[?a, ?n], ex:s_nation[?b, ?n], ?a != ?b .")
    return ask(materialise_rules(graph(spark, sf_dir, ("s_acctbal", "s_nation")), rules), "SELECT ?a ?b WHERE { ?a :peer ?b }")


def datalog_conversation_chain(spark, sf_dir):
    """Reachability along turns: the reply chain is data, its closure a recursive rule."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda c: F.concat(F.lit("http://ex/conversations/"), F.col("conv_id").cast("string"), F.lit("/"), c.cast("string"))
    from .functions.terms import IRI as KIND
    from .functions.terms import Val, term

    nxt = turns.withColumnRenamed("turn", "after").withColumn("turn", F.col("after") - 1)
    rows = turns.join(nxt, ["conv_id", "turn"]).select(term(KIND, node(F.col("turn"))).alias("s"), Val.const(("iri", BASE + "next")).term().alias("p"), term(KIND, node(F.col("after"))).alias("o"))
    rules = parse_rules(EX + "ex:later[?x, ?y] :- ex:next[?x, ?y] . ex:later[?x, ?z] :- ex:later[?x, ?y], ex:next[?y, ?z] .")
    return ask(materialise_rules(QuadSource.from_quads(spark, rows), rules), "SELECT ?x ?y WHERE { ?x :later ?y }")


def owl_hierarchy_domain_range(spark, sf_dir):
    src = with_text(spark, graph(spark, sf_dir, ("c_nation", "s_nation")), "ex:c_nation rdfs:domain ex:Buyer ; rdfs:range ex:Country ; rdfs:subPropertyOf ex:livesIn . ex:s_nation rdfs:subPropertyOf ex:livesIn . ex:Buyer rdfs:subClassOf ex:Partner . ex:Partner rdfs:subClassOf ex:Agent .")
    return ask(entail(src), "SELECT ?k (COUNT(*) AS ?n) WHERE { { ?x a ?k FILTER(?k IN (:Buyer, :Partner, :Agent, :Country)) } UNION { ?x :livesIn ?y BIND(:livesIn AS ?k) } } GROUP BY ?k")


def owl_chain_symmetric_inverse(spark, sf_dir):
    src = with_text(spark, graph(spark, sf_dir, NATIONS), "ex:inRegion owl:propertyChainAxiom (ex:c_nation ex:n_region) . ex:hosts owl:inverseOf ex:c_nation .")
    return ask(entail(src), "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x ?p ?y FILTER(?p IN (:inRegion, :hosts)) } GROUP BY ?p")


def owl_class_expressions(spark, sf_dir):
    src = with_text(
        spark,
        graph(spark, sf_dir, ("o_customer", "o_orderstatus"), ("Customer", "Order")),
        "[] rdfs:subClassOf ex:Open ; owl:onProperty ex:o_orderstatus ; owl:hasValue 'O' . [] owl:onProperty ex:o_customer ; owl:someValuesFrom ex:Customer ; rdfs:subClassOf ex:Placed . ex:Live owl:intersectionOf (ex:Open ex:Placed) .",
    )
    return ask(entail(src), "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x a ?k FILTER(?k IN (:Open, :Placed, :Live)) } GROUP BY ?k")


def owl_same_as(spark, sf_dir):
    src = with_text(spark, graph(spark, sf_dir, ("n_region", "n_nationkey")), "ex:n_region a owl:FunctionalProperty . <http://ex/nation/0> ex:n_region <http://ex/region/zero> .")
    return ask(entail(src), "SELECT ?x ?y WHERE { ?x owl:sameAs ?y FILTER(?x != ?y) }")


SHAPES = f"@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <{BASE}> . "


def _shacl(shape, tables):
    return lambda spark, sf_dir: validate(tables_source(spark, sf_dir, tables), SHAPES + shape).select("focus", "value", "component")


SHACL = {
    "shacl_range_datatype_in": (
        "ex:S sh:targetClass ex:Order ; sh:property [ sh:path ex:o_totalprice ; sh:maxInclusive 450000.0 ; sh:datatype xsd:double ] , [ sh:path ex:o_orderstatus ; sh:in ('O' 'F') ] .",
        ["orders"],
        "SELECT 'http://ex/orders/' || o_orderkey AS focus, o_totalprice::VARCHAR AS value, 'maxInclusive' AS component FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'http://ex/orders/' || o_orderkey, o_orderstatus, 'in' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
    ),
    "shacl_mincount_inverse_path": (
        "ex:S sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:o_customer ] ; sh:minCount 3 ; sh:maxCount 15 ] .",
        ["customer", "orders"],
        "SELECT 'http://ex/customer/' || c_custkey AS focus, NULL::VARCHAR AS value, CASE WHEN n < 3 THEN 'minCount' ELSE 'maxCount' END AS component FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE n < 3 OR n > 15",
    ),
    "shacl_pattern_length": (
        "ex:S sh:targetClass ex:Part ; sh:property [ sh:path ex:p_brand ; sh:pattern '^Brand#[1-3]' ] , [ sh:path ex:p_name ; sh:minLength 8 ] .",
        ["part"],
        "SELECT 'http://ex/part/' || p_partkey AS focus, p_brand AS value, 'pattern' AS component FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]') UNION ALL SELECT 'http://ex/part/' || p_partkey, p_name, 'minLength' FROM part WHERE length(p_name) < 8",
    ),
    "shacl_class_nodekind": (
        "ex:S sh:targetSubjectsOf ex:c_nation ; sh:property [ sh:path ex:c_nation ; sh:class ex:Nation ; sh:nodeKind sh:IRI ] , [ sh:path ex:c_name ; sh:nodeKind sh:IRI ] .",
        ["customer", "nation"],
        "SELECT 'http://ex/customer/' || c_custkey AS focus, c_name AS value, 'nodeKind' AS component FROM customer",
    ),
    "shacl_lessthan": (
        "ex:S sh:targetClass ex:Part ; sh:property [ sh:path ex:p_size ; sh:lessThan ex:p_partkey ] .",
        ["part"],
        "SELECT 'http://ex/part/' || p_partkey AS focus, p_size::VARCHAR AS value, 'lessThan' AS component FROM part WHERE NOT p_size < p_partkey",
    ),
    "shacl_or_not_xone": (
        "ex:S sh:targetClass ex:Supplier ; sh:or ( [ sh:property [ sh:path ex:s_acctbal ; sh:minInclusive 0.0 ] ] [ sh:property [ sh:path ex:s_nationkey ; sh:maxExclusive 10 ] ] ) ; sh:not [ sh:property [ sh:path ex:s_nationkey ; sh:hasValue 3 ] ] .",
        ["supplier"],
        "SELECT 'http://ex/supplier/' || s_suppkey AS focus, 'http://ex/supplier/' || s_suppkey AS value, 'or' AS component FROM supplier WHERE s_acctbal < 0 AND s_nationkey >= 10 UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/supplier/' || s_suppkey, 'not' FROM supplier WHERE s_nationkey = 3",
    ),
    "shacl_qualified": (
        "ex:S sh:targetClass ex:Nation ; sh:property [ sh:path [ sh:inversePath ex:s_nation ] ; sh:qualifiedValueShape [ sh:property [ sh:path ex:s_acctbal ; sh:minInclusive 5000.0 ] ] ; sh:qualifiedMinCount 2 ] .",
        ["nation", "supplier"],
        "SELECT 'http://ex/nation/' || n_nationkey AS focus, NULL::VARCHAR AS value, 'qualifiedMinCount' AS component FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 5000 GROUP BY n_nationkey HAVING COUNT(s_suppkey) < 2",
    ),
    "shacl_closed": (
        "ex:S sh:targetClass ex:Region ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path ex:r_name ; sh:minCount 1 ] .",
        ["region"],
        "SELECT 'http://ex/region/' || r_regionkey AS focus, r_regionkey::VARCHAR AS value, 'closed' AS component FROM region",
    ),
    "shacl_sparql": (
        "ex:S sh:targetClass ex:Customer ; sh:sparql [ sh:select 'SELECT $this ?value WHERE { $this <http://ex/c_acctbal> ?value ; <http://ex/c_mktsegment> \"BUILDING\" FILTER(?value < 0) }' ] .",
        ["customer"],
        "SELECT 'http://ex/customer/' || c_custkey AS focus, c_acctbal::VARCHAR AS value, 'sparql' AS component FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'",
    ),
}

MAPPING = """@prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
<urn:N> rml:logicalSource [ rml:source "nation" ] ; rml:subjectMap [ rml:template "http://ex/N/{n_nationkey}" ; rml:class ex:Land ] ;
  rml:predicateObjectMap [ rml:predicate ex:label ; rml:objectMap [ rml:reference "n_name" ; rml:language "en" ] ] ,
    [ rml:predicate ex:part ; rml:objectMap [ rml:parentTriplesMap <urn:R> ; rml:joinCondition [ rml:child "n_regionkey" ; rml:parent "r_regionkey" ] ] ] .
<urn:R> rml:logicalSource [ rml:source "region" ] ; rml:subjectMap [ rml:template "http://ex/R/{r_regionkey}" ] ;
  rml:predicateObjectMap [ rml:predicate ex:label ; rml:objectMap [ rml:functionExecution [ rml:function ex:toLowerCase ; rml:input [ rml:inputValueMap [ rml:reference "r_name" ] ] ] ] ] ."""


def _tables(spark, sf_dir, *names):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def rml_join_generated_triples(spark, sf_dir):
    quads = Mapper(spark, MAPPING, sf_dir, _tables(spark, sf_dir, "nation", "region")).quads()
    return nquads_lines(quads).select(F.col("value").alias("line"))


def ottr_table_zipmin(spark, sf_dir):
    from .functions.terms import IRI as KIND
    from .functions.terms import LIT, STRING, term

    df = _tables(spark, sf_dir, "nation")["nation"]
    text = f"@prefix ex: <{BASE}> . ex:Row[?n, ?names] :: {{ ottr:Triple(?n, rdf:type, ex:Nation), cross | ottr:Triple(?n, ex:alias, ++?names), zipMin | ottr:Triple(?n, ++(ex:first, ex:second, ex:third), ++?names) }} ."
    string = lambda c: term(LIT, c, F.lit(STRING))
    quads = expand_table(df, text, BASE + "Row", [term(KIND, F.concat(F.lit("http://ex/N/"), F.col("n_nationkey").cast("string"))), F.array(string(F.col("n_name")), string(F.lower("n_name")))])
    return nquads_lines(quads).select(F.col("value").alias("line"))


def _small(spark, sf_dir):
    return graph(spark, sf_dir, ("n_name", "n_region"), ("Nation",), ["nation"])


def update_delete_insert(spark, sf_dir):
    store = Store(_small(spark, sf_dir), prefixes={"": BASE})
    store.update("DELETE { ?n :n_name ?x } INSERT { ?n :renamed ?y } WHERE { ?n :n_name ?x ; :n_region <http://ex/region/1> BIND(CONCAT('new ', ?x) AS ?y) } ; INSERT DATA { GRAPH :log { :job :did 'rename' } }")
    return ask(store.source, "SELECT ?p (COUNT(*) AS ?n) WHERE { { ?s ?p ?o } UNION { GRAPH ?g { ?s ?p ?o } } } GROUP BY ?p")


def update_graph_management(spark, sf_dir):
    store = Store(_small(spark, sf_dir), prefixes={"": BASE})
    store.update("INSERT { GRAPH :names { ?n :n_name ?x } } WHERE { ?n :n_name ?x } ; COPY GRAPH :names TO GRAPH :copy ; MOVE GRAPH :copy TO GRAPH :moved ; CLEAR DEFAULT")
    return ask(store.source, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


CLOSURE = EX + "ex:in[?x, ?y] :- ex:n_region[?x, ?y] . ex:in[?x, ?z] :- ex:in[?x, ?y], ex:part[?y, ?z] ."


def incremental_insert(spark, sf_dir):
    rules = parse_rules(CLOSURE)
    full = materialise_rules(_small(spark, sf_dir), rules)
    new = QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . <http://ex/region/2> ex:part ex:world .")
    return ask(insert_quads(full, rules, new.quads, new.terms), "SELECT ?x ?y WHERE { ?x :in ?y }")


def incremental_delete(spark, sf_dir):
    rules = parse_rules(CLOSURE)
    base = with_text(spark, _small(spark, sf_dir), "<http://ex/region/2> ex:part ex:world . <http://ex/region/3> ex:part ex:world .")
    gone = QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . <http://ex/region/2> ex:part ex:world .")
    return ask(delete_quads(materialise_rules(base, rules), rules, gone.quads, fallback=1.0), "SELECT ?x ?y WHERE { ?x :in ?y }")


def changelog_replay(spark, sf_dir):
    import uuid

    log = ChangeLog(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")
    store = Store(_small(spark, sf_dir), prefixes={"": BASE}, log=log)
    store.update("INSERT { ?n :tag ?x } WHERE { ?n :n_name ?x } ; DELETE { ?n :tag ?x } WHERE { ?n :tag ?x ; :n_region <http://ex/region/0> }")
    log.compact()
    return ask(log.replay(), "SELECT ?n ?x WHERE { ?n :tag ?x }")


def ntriples_round_trip(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/nt-{uuid.uuid4().hex}"
    nquads_lines(quads_of(tables_source(spark, sf_dir, ["customer", "nation"]), [BASE + "c_name", BASE + "c_nation", BASE + "c_acctbal"])).write.text(path)
    source = QuadSource.from_quads(spark, read_ntriples(spark, path))
    return ask(source, "SELECT ?n (xsd:double(?b) AS ?bal) WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_nation <http://ex/nation/5> }")


def quads_star_join(spark, sf_dir):
    source = graph(spark, sf_dir, ("o_orderstatus", "o_orderpriority", "o_customer", "c_mktsegment"), ("Order",), ["orders", "customer"])
    return ask(source, "SELECT ?seg ?st (COUNT(*) AS ?n) WHERE { ?o a :Order ; :o_orderstatus ?st ; :o_orderpriority '1-URGENT' ; :o_customer ?c . ?c :c_mktsegment ?seg } GROUP BY ?seg ?st")


def vqs_class_counts(spark, sf_dir):
    return class_counts(tables_source(spark, sf_dir, ["nation", "region", "customer"]))


def vqs_edge_counts(spark, sf_dir):
    return edge_counts(tables_source(spark, sf_dir, ["nation", "region", "customer"]))


def vqs_index_table(spark, sf_dir):
    config = Config(BASE + "Region", ((BASE + "r_name", Config(None)),))
    tree = Config(BASE + "Nation", ((BASE + "n_region", config), (BASE + "n_name", Config(None))))
    return index_table(tables_source(spark, sf_dir, ["nation", "region"]), tree)


def result_json_bindings(spark, sf_dir):
    df = Engine(tables_source(spark, sf_dir, ["nation"])).sparql("SELECT ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k }", "terms")
    return json_bindings(df).select(F.col("value").alias("binding"))


SQL = {
    "datalog_transitive": "SELECT 'http://ex/customer/' || c_custkey AS x, 'http://ex/nation/' || c_nationkey AS y FROM customer UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/region/' || n_regionkey FROM nation UNION ALL SELECT 'http://ex/customer/' || c_custkey, 'http://ex/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "datalog_negation_stratified": "WITH i AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT 'http://ex/HasOrder' AS k, COUNT(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'http://ex/Idle', COUNT(*) FROM i HAVING COUNT(*) > 0 UNION ALL SELECT 'http://ex/Watched', COUNT(DISTINCT c_nationkey) FROM i HAVING COUNT(*) > 0",
    "datalog_filter_inequality": "SELECT 'http://ex/supplier/' || a.s_suppkey AS a, 'http://ex/supplier/' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_acctbal > 5000 AND b.s_acctbal > 5000",
    "datalog_conversation_chain": "WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id AS c, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT c, x, y FROM e UNION SELECT r.c, r.x, e.y FROM r JOIN e ON r.c = e.c AND r.y = e.x) SELECT 'http://ex/conversations/' || c || '/' || x AS x, 'http://ex/conversations/' || c || '/' || y AS y FROM r",
    "owl_hierarchy_domain_range": "SELECT 'http://ex/' || k AS k, n FROM (SELECT unnest(['Buyer', 'Partner', 'Agent']) AS k, (SELECT COUNT(*) FROM customer) AS n UNION ALL SELECT 'Country', (SELECT COUNT(DISTINCT c_nationkey) FROM customer) UNION ALL SELECT 'livesIn', (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier))",
    "owl_chain_symmetric_inverse": "SELECT 'http://ex/inRegion' AS p, COUNT(*) AS n FROM customer UNION ALL SELECT 'http://ex/hosts', COUNT(*) FROM customer",
    "owl_class_expressions": "SELECT 'http://ex/Open' AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'http://ex/Placed', COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'http://ex/Live', COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
    "owl_same_as": "SELECT 'http://ex/region/' || n_regionkey AS x, 'http://ex/region/zero' AS y FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'http://ex/region/zero', 'http://ex/region/' || n_regionkey FROM nation WHERE n_nationkey = 0",
    "rml_join_generated_triples": "SELECT '<http://ex/N/' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Land> .' AS line FROM nation UNION ALL SELECT '<http://ex/N/' || n_nationkey || '> <http://ex/label> \"' || n_name || '\"@en .' FROM nation UNION ALL SELECT '<http://ex/N/' || n_nationkey || '> <http://ex/part> <http://ex/R/' || n_regionkey || '> .' FROM nation UNION ALL SELECT '<http://ex/R/' || r_regionkey || '> <http://ex/label> \"' || lower(r_name) || '\" .' FROM region",
    "ottr_table_zipmin": "WITH n AS (SELECT '<http://ex/N/' || n_nationkey || '> ' AS s, '\"' || n_name || '\" .' AS a, '\"' || lower(n_name) || '\" .' AS b FROM nation) SELECT s || '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Nation> .' AS line FROM n UNION ALL SELECT s || '<http://ex/alias> ' || a FROM n UNION ALL SELECT s || '<http://ex/alias> ' || b FROM n UNION ALL SELECT s || '<http://ex/first> ' || a FROM n UNION ALL SELECT s || '<http://ex/second> ' || b FROM n",
    "update_delete_insert": "SELECT 'http://ex/n_name' AS p, COUNT(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'http://ex/renamed', COUNT(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'http://ex/n_region', COUNT(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', COUNT(*) FROM nation UNION ALL SELECT 'http://ex/did', 1",
    "update_graph_management": "SELECT unnest(['http://ex/names', 'http://ex/moved']) AS g, (SELECT COUNT(*) FROM nation) AS n",
    "incremental_insert": "SELECT 'http://ex/nation/' || n_nationkey AS x, 'http://ex/region/' || n_regionkey AS y FROM nation UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/world' FROM nation WHERE n_regionkey = 2",
    "incremental_delete": "SELECT 'http://ex/nation/' || n_nationkey AS x, 'http://ex/region/' || n_regionkey AS y FROM nation UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/world' FROM nation WHERE n_regionkey = 3",
    "changelog_replay": "SELECT 'http://ex/nation/' || n_nationkey AS n, n_name AS x FROM nation WHERE n_regionkey <> 0",
    "ntriples_round_trip": "SELECT c_name AS n, c_acctbal AS bal FROM customer WHERE c_nationkey = 5",
    "quads_star_join": "SELECT c_mktsegment AS seg, o_orderstatus AS st, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2",
    "vqs_class_counts": "SELECT 'http://ex/Nation' AS class, COUNT(*) AS n FROM nation UNION ALL SELECT 'http://ex/Region', COUNT(*) FROM region UNION ALL SELECT 'http://ex/Customer', COUNT(*) FROM customer",
    "vqs_edge_counts": "SELECT 'http://ex/Customer' AS c, 'http://ex/c_nation' AS p, 'http://ex/Nation' AS d, COUNT(*) AS triples, COUNT(DISTINCT c_custkey) AS subjects, COUNT(DISTINCT c_nationkey) AS objects FROM customer UNION ALL SELECT 'http://ex/Nation', 'http://ex/n_region', 'http://ex/Region', COUNT(*), COUNT(DISTINCT n_nationkey), COUNT(DISTINCT n_regionkey) FROM nation",
    "vqs_index_table": "SELECT 'http://ex/nation/' || n_nationkey AS v0, 'http://ex/region/' || n_regionkey AS v1, r_name AS v2, n_name AS v3 FROM nation JOIN region ON n_regionkey = r_regionkey",
    "result_json_bindings": "SELECT '{\"n\":{\"type\":\"literal\",\"value\":\"' || n_name || '\"},\"k\":{\"type\":\"literal\",\"value\":\"' || n_nationkey || '\",\"datatype\":\"http://www.w3.org/2001/XMLSchema#integer\"}}' AS binding FROM nation",
}


def queries():
    out = {k: globals()[k] for k in SQL}
    return out | {k: _shacl(shape, tables) for k, (shape, tables, _) in SHACL.items()}


def oracle_sql():
    return SQL | {k: sql for k, (_, _, sql) in SHACL.items()}
