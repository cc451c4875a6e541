"""Rules, entailment, shapes, mappings, templates, updates and streams."""

import os

import pytest

from quadrille.engine import BASE, Engine, tables_source
from quadrille.operators import datalog
from quadrille.operators.datalog import KEY, Contradiction, Program, Rule, delete_quads, insert_quads, materialise_rules, naive, parse_rules, stratify
from quadrille.operators.ottr import expand_document
from quadrille.operators.owl import Ontology, entail
from quadrille.operators.rml import confine, map_quads
from quadrille.operators.shacl import Shapes, Validator, validate
from quadrille.operators.update import Conflict, Store
from quadrille.operators.vqs import Config, NavGraph, estimated_answers, greedy_search, lookup, random_search
from quadrille.plans import store
from quadrille.sources.quads import QuadSource
from quadrille.sources.rdf import nquads_lines
from quadrille.streaming.ingest import maintain, quad_stream

P = "@prefix ex: <http://ex/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
CLOSURE = "prefix ex: <http://ex/> ex:t[?x,?y] :- ex:p[?x,?y] . ex:t[?x,?z] :- ex:t[?x,?y], ex:p[?y,?z] ."


def rows(source, text):
    return sorted((tuple(r) for r in Engine(source).sparql(text).collect()), key=str)


def same(a, b):
    return a.quads.select(*KEY).exceptAll(b.quads.select(*KEY)).isEmpty() and b.quads.select(*KEY).exceptAll(a.quads.select(*KEY)).isEmpty()


@pytest.fixture(scope="module")
def chain(spark):
    return QuadSource.from_text(spark, P + "ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:p ex:a . ex:c ex:p ex:d .")


def test_seminaive_equals_naive_and_grouped_shapes(chain):
    rules = parse_rules(CLOSURE + " ex:A1[?x] :- ex:p[?x,?y] . ex:A2[?x] :- ex:t[?x,?y] . ex:A3[?x] :- ex:t[?x,?y] . ex:A4[?x] :- ex:p[?x,?y] .")
    assert same(materialise_rules(chain, rules), naive(chain, rules))


def test_rule_filters_subjects_before_a_join_on_a_shared_value(spark):
    text = " ".join(f"ex:s{i} ex:in ex:n{i % 2} ." for i in range(40)) + " ex:s0 a ex:Rich . ex:s2 a ex:Rich . ex:s3 a ex:Rich ."
    src = QuadSource.from_text(spark, P + text)
    rules = parse_rules("prefix ex: <http://ex/> ex:peer[?a, ?b] :- ex:Rich[?a], ex:Rich[?b], ex:in[?a, ?n], ex:in[?b, ?n], ?a != ?b .")
    program = Program(src, rules)
    seen, join = [], datalog.P.join

    def counted(a, b, *more):
        out = join(a, b, *more)
        seen.append(out.df.count())
        return out

    datalog.P.join = counted
    try:
        assert program.heads(rules[0], None, src.quads).count() == 2
    finally:
        datalog.P.join = join
    assert max(seen) <= 5  # pairs of rich subjects, not of all that share a value


def test_many_rows_are_spread_by_their_number(spark, monkeypatch):
    text = P + "ex:a ex:p ex:b . ex:b ex:p ex:c . ex:c ex:p ex:a . ex:c ex:p ex:d . ex:d ex:p ex:e . ex:e ex:p ex:f ."
    want = materialise_rules(QuadSource.from_text(spark, text), parse_rules(CLOSURE))
    monkeypatch.setattr(store, "ROWS", 1)
    again = QuadSource.from_text(spark, text)
    assert len(again.quads.inputFiles()) > 2
    assert same(materialise_rules(again, parse_rules(CLOSURE)), want)


def test_large_dictionaries_are_hashed_not_sorted(spark, chain):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Engine(chain).sparql(f"SELECT ?x ?y WHERE {{ ?x <{BASE}p> ?y }}")
        assert df.count() == 4
        assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_incremental_equals_from_scratch(spark, chain):
    rules = parse_rules(CLOSURE)
    new = QuadSource.from_text(spark, P + "ex:d ex:p ex:e .")
    grown = insert_quads(materialise_rules(chain, rules), rules, new.quads, new.terms)
    scratch = materialise_rules(chain.with_quads(chain.quads.unionByName(new.quads), new.terms), rules)
    assert same(grown, scratch)
    gone = QuadSource.from_text(spark, P + "ex:b ex:p ex:c .")
    left = chain.quads.unionByName(new.quads).join(gone.quads.select(*KEY), KEY, "left_anti")
    want = materialise_rules(QuadSource(spark, left, grown.terms), rules)
    assert same(delete_quads(grown, rules, gone.quads, fallback=10.0), want)
    assert same(delete_quads(grown, rules, gone.quads, fallback=0.0), want)


def test_stratification(chain):
    assert [len(s) for s in stratify(parse_rules("prefix ex: <http://ex/> ex:A[?x] :- ex:B[?x], NOT ex:C[?x] . ex:C[?x] :- ex:D[?x] ."))] == [1, 1]
    with pytest.raises(ValueError):
        stratify(parse_rules("prefix ex: <http://ex/> ex:A[?x] :- ex:B[?x], NOT ex:C[?x] . ex:C[?x] :- ex:B[?x], NOT ex:A[?x] ."))
    with pytest.raises(ValueError):
        parse_rules("prefix ex: <http://ex/> ex:A[?x] :- NOT ex:B[?x] .")
    with pytest.raises(Contradiction):
        materialise_rules(chain, parse_rules("prefix ex: <http://ex/> false :- ex:p[?x, ex:d] ."))
    assert parse_rules("[?s, <http://x/p>, ?o] ?g :- [?s, <http://x/q>, ?o] ?g .")[0].head[3] == ("var", "g") and Rule


def test_owl_rules(spark):
    src = QuadSource.from_text(spark, P + "ex:s a owl:SymmetricProperty . ex:q a owl:TransitiveProperty . ex:p rdfs:subPropertyOf ex:q . ex:C owl:equivalentClass [ owl:onProperty ex:p ; owl:someValuesFrom ex:D ] . ex:E rdfs:subClassOf [ owl:onProperty ex:p ; owl:allValuesFrom ex:F ] . ex:a ex:p ex:b ; ex:s ex:z . ex:b a ex:D ; ex:p ex:c . ex:a a ex:E .")
    out = entail(src)
    assert rows(out, "SELECT ?x { ?x a :C }") == [("http://ex/a",)] and rows(out, "SELECT ?x { ?x a :F }") == [("http://ex/b",)]
    assert ("http://ex/a", "http://ex/c") in rows(out, "SELECT ?x ?y { ?x :q ?y }") and rows(out, "SELECT ?x { ?x :s :a }") == [("http://ex/z",)]
    with pytest.raises(Contradiction):
        entail(QuadSource.from_text(spark, P + "ex:A owl:disjointWith ex:B . ex:x a ex:A , ex:B ."))


def test_shacl_constraints(spark):
    src = QuadSource.from_text(spark, P + 'ex:a a ex:P ; ex:age 5 ; ex:name "A"@en, "AA"@en ; ex:k ex:b ; ex:lo 3 ; ex:hi 2 . ex:b a ex:P2 ; ex:age "x" ; ex:k 3 . ex:P2 rdfs:subClassOf ex:P .')
    shapes = P + """ex:S a sh:NodeShape ; sh:targetClass ex:P ; sh:property [ sh:path ex:age ; sh:datatype xsd:integer ; sh:minInclusive 10 ] , [ sh:path ex:name ; sh:minCount 1 ; sh:uniqueLang true ] ,
      [ sh:path ex:k ; sh:class ex:P ; sh:nodeKind sh:IRI ] , [ sh:path ex:lo ; sh:lessThan ex:hi ; sh:severity sh:Warning ; sh:message "lo<hi" ] ; sh:not [ sh:property [ sh:path ex:hi ; sh:hasValue 2 ] ] ."""
    got = {(r.focus[-1], r.component, r.value, r.severity) for r in validate(src, shapes).collect()}
    b = "http://ex/a"
    assert got == {("a", "minInclusive", "5", "Violation"), ("a", "uniqueLang", None, "Violation"), ("b", "datatype", "x", "Violation"), ("b", "minInclusive", "x", "Violation"), ("b", "minCount", None, "Violation"), ("b", "class", "3", "Violation"), ("b", "nodeKind", "3", "Violation"), ("a", "lessThan", "3", "Warning"), ("a", "not", b, "Violation")}
    with pytest.raises(ValueError):
        Validator(src, Shapes.from_text(P + "ex:S sh:targetClass ex:P ; sh:node ex:S ."))
    assert validate(src, P + "ex:S sh:targetClass ex:P ; sh:deactivated true ; sh:property [ sh:path ex:z ; sh:minCount 1 ] .").count() == 0


def test_rml_sources(spark, tmp_path):
    for name, text in (("p.csv", "id,name,boss\n1,Ann Lee,\n2,Bob,1\n"), ("s.json", '{"data":{"students":[{"id":"7","name":"Zed"},{"id":"8"}]}}'), ("x.xml", "<s><student><id>3</id><name>Xi</name></student><student><id>4</id></student></s>")):
        (tmp_path / name).write_text(text)
    ns = "@prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex/> . "
    table = lambda f, kind, it: f'rml:logicalSource [ rml:source "{f}" ; rml:referenceFormulation rml:{kind} ; rml:iterator "{it}" ]'
    mapping = ns + f"""<urn:p> {table("p.csv", "CSV", "")} ; rml:subjectMap [ rml:template "http://ex/P/{{name}}" ; rml:class ex:Person ] ; rml:predicateObjectMap [ rml:predicate ex:boss ; rml:objectMap [ rml:parentTriplesMap <urn:p> ; rml:joinCondition [ rml:child "boss" ; rml:parent "id" ] ] ] .
      <urn:s> {table("s.json", "JSONPath", "$.data.students[*]")} ; rml:subjectMap [ rml:template "http://ex/S/{{id}}" ] ; rml:predicateObjectMap [ rml:predicate ex:name ; rml:objectMap [ rml:reference "name" ; rml:language "en" ] ] .
      <urn:x> {table("x.xml", "XPath", "/s/student")} ; rml:subjectMap [ rml:reference "name" ; rml:termType rml:BlankNode ] ; rml:predicateObjectMap [ rml:predicate ex:id ; rml:objectMap [ rml:reference "id" ; rml:datatype <http://www.w3.org/2001/XMLSchema#integer> ] ] ."""
    lines = {r.value for r in nquads_lines(map_quads(spark, mapping, str(tmp_path))).collect()}
    assert lines == {"<http://ex/P/Ann%20Lee> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Person> .", "<http://ex/P/Bob> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Person> .", "<http://ex/P/Bob> <http://ex/boss> <http://ex/P/Ann%20Lee> .", '<http://ex/S/7> <http://ex/name> "Zed"@en .', '_:Xi <http://ex/id> "3"^^<http://www.w3.org/2001/XMLSchema#integer> .'}
    with pytest.raises(PermissionError):
        confine(str(tmp_path), "../other.csv")


def test_ottr(spark):
    text = """@prefix ex: <http://ex/> . ex:Person[ottr:IRI ?p, ? xsd:string ?n] :: { ottr:Triple(?p, rdf:type, ex:P), ex:Named(?p, ?n) } . ex:Named[?p, ?n = "x"] :: { ottr:Triple(?p, ex:name, ?n) } .
      ex:Types[?p, ?ts] :: { cross | ottr:Triple(?p, ex:t, ++?ts) } . ex:Pairs[?a, ?b] :: { zipMin | ex:Named(++?a, ++?b) } .
      ex:Person(ex:c, "Carol") . ex:Types(ex:c, (ex:A, ex:B)) . ex:Pairs((ex:x, ex:y, ex:z), ("X", "Y")) . ex:Named(ex:w, none) ."""
    lines = {r.value for r in nquads_lines(expand_document(spark, text)).collect()}
    t = lambda s, p, o: f"<http://ex/{s}> <http://ex/{p}> {o} ."
    assert lines == {"<http://ex/c> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/P> .", t("c", "name", '"Carol"'), t("c", "t", "<http://ex/A>"), t("c", "t", "<http://ex/B>"), t("x", "name", '"X"'), t("y", "name", '"Y"'), t("w", "name", '"x"')}
    with pytest.raises(ValueError):
        expand_document(spark, "@prefix ex: <http://ex/> . ex:R[?x] :: { ex:R(?x) } . ex:R(ex:a) .")


def test_updates_and_transactions(spark, tmp_path):
    store = Store(QuadSource.from_text(spark, P + "ex:a ex:p 1 ."), prefixes={"": BASE}, allow_load=str(tmp_path))
    store.update("INSERT DATA { :b :p 2 . GRAPH :g { :x :y :z } } ; DELETE { ?s :p ?o } INSERT { ?s :q ?o } WHERE { ?s :p ?o FILTER(?o > 1) }")
    assert rows(store.source, "SELECT ?s ?o { ?s :q ?o }") == [("http://ex/b", "2")]
    tx, other = store.begin(), store.begin()
    tx.update("DELETE WHERE { ?s :q ?o }").commit()
    assert rows(store.source, "ASK { ?s :q ?o }") == [(False,)]
    with pytest.raises(Conflict):
        other.update("CLEAR ALL").commit()
    before = store.source
    with pytest.raises(PermissionError):
        store.update("CLEAR ALL ; LOAD <file:///etc/passwd>")
    assert store.source is before
    (tmp_path / "d.ttl").write_text("<http://ex/n> <http://ex/m> 'loaded' .")
    store.update(f"LOAD <file://{tmp_path}/d.ttl> INTO GRAPH :h ; COPY :h TO :i ; DROP GRAPH :g")
    assert rows(store.source, "SELECT ?g { GRAPH ?g { ?s ?p ?o } }") == [("http://ex/h",), ("http://ex/i",)]


def test_stream_keeps_closure(spark, tmp_path):
    rules = parse_rules(CLOSURE)
    store = Store(materialise_rules(QuadSource.from_text(spark, P + "ex:a ex:p ex:b ."), rules), rules)
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "1.nq").write_text("<http://ex/b> <http://ex/p> <http://ex/c> .\n# note\n")
    q = maintain(store, quad_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert ("http://ex/a", "http://ex/c") in rows(store.source, "SELECT ?x ?y { ?x :t ?y }")


def test_vqs(spark):
    nav = NavGraph.from_source(QuadSource.from_text(spark, P + "ex:p rdfs:domain ex:A ; rdfs:range ex:B ."))
    assert nav.outgoing("http://ex/A") == [("http://ex/p", "http://ex/B")]
    leaf, other = Config("B"), Config("C")
    a, b = Config("A", (("p", leaf),)), Config("A", (("p", leaf), ("q", other)))
    counts, edges = {"A": 10, "B": 5, "C": 2}, {("A", "p", "B"): 20, ("A", "q", "C"): 10}
    assert estimated_answers(counts, edges, a) == 20
    log = {Config("A"): 5, a: 3, b: 1}
    assert greedy_search([a, b], log, counts, edges, 100) == [b] and random_search([a, b], log, counts, edges, 25) == [b]
    df = spark.createDataFrame([("x", "1"), ("x", None), ("y", "2")], "v0 string, v1 string")
    assert [r.v1 for r in lookup(df, "v1", v0="x").collect()] == ["1"]


def test_key_check(spark):
    tables_source(spark, "/root/testdata/sf0.001", ["orders", "nation"]).check_keys()
    bad = tables_source(spark, "/root/testdata/sf0.001", ["orders"])
    bad.tables[0].keys = ["o_orderstatus"]
    with pytest.raises(ValueError):
        bad.check_keys()


def test_components_against_search(spark):
    import random

    from quadrille.plans.fixpoint import components

    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.id: r.rep for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in low.items() if any(x != y and low[y] == r for y in low)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_updates_fold_their_layers(spark):
    store = Store(QuadSource.from_text(spark, P + "ex:a ex:p 0 ."), prefixes={"": BASE})
    for i in range(1, 11):
        store.update(f"DELETE {{ :a :p ?o }} INSERT {{ :a :p {i} . :b{i} :q ?o }} WHERE {{ :a :p ?o }}")
    assert rows(store.source, "SELECT ?o { :a :p ?o }") == [("10",)]
    assert rows(store.source, "SELECT ?s ?o { ?s :q ?o FILTER(?o < 2) }") == [("http://ex/b1", "0"), ("http://ex/b2", "1")]
    assert store.layers < 8 and store.source.layers < 8


def test_long_recursion_folds_its_rounds(spark):
    text = P + " ".join(f"ex:n{i} ex:p ex:n{i + 1} ." for i in range(20))
    src = QuadSource.from_text(spark, text)
    assert Engine(src).sparql("SELECT ?y { :n0 :p+ ?y }").count() == 20
    full = materialise_rules(src, parse_rules("prefix ex: <http://ex/> ex:t[?x,?y] :- ex:p[?x,?y] . ex:t[?x,?z] :- ex:t[?x,?y], ex:p[?y,?z] ."))
    assert Engine(full).sparql("SELECT ?x ?y { ?x :t ?y }").count() == 210


def test_manchester_text_is_checked_and_round_trips():
    from quadrille.sources.manchester import Document, ManchesterFault, Printer

    text = """Prefix: : <http://ex/>
Ontology: <http://ex/o>
ObjectProperty: near
    Characteristics: Symmetric
    SubPropertyChain: p o q
DataProperty: age
    Range: <http://www.w3.org/2001/XMLSchema#integer>[>= 0, < 150]
Class: Dog
    SubClassOf: Animal, tail max 1 Tail and (eats some (Meat or not Plant))
    DisjointWith: Cat
Individual: fido
    Types: Dog
    Facts: near rex, age 7, not near tom
"""
    once = Printer([q[:3] for q in Document(text).parse()]).text()
    assert Printer([q[:3] for q in Document(once).parse()]).text() == once
    for word in ("Symmetric", "SubPropertyChain", "max 1", " some ", "not <http://ex/near>", "DisjointWith"):
        assert word in once
    for bad in ("Class: x:y", "Prefix: : <http://ex/> Class: A SubClassOf: B some", "Frame: A"):
        with pytest.raises((ManchesterFault, KeyError)):
            Document(bad).parse()


def test_canonical_labels_do_not_depend_on_names(spark):
    from quadrille.sources.canonical import canonical_lines
    from quadrille.sources.rdf import quads_from_text

    text = "@prefix ex: <http://ex/> . _:{0} ex:p _:{1} . _:{1} ex:p _:{2} . _:{2} ex:q 'end' . _:{3} ex:p _:{3} . ex:s ex:p _:{0} ."
    a, b = (sorted(r.value for r in canonical_lines(quads_from_text(spark, text.format(*n))).collect()) for n in ("wxyz", "zyxw"))
    assert a == b and len(a) == 5 and sum("_:c14n" in x for x in a) == 5


def test_counts_of_a_path_are_taken_once_and_spread(spark, monkeypatch):
    src = QuadSource.from_text(spark, P + "ex:a a ex:C . ex:b a ex:C . ex:c a ex:C . " + " ".join(f"ex:o{i} ex:of ex:{'a' if i < 5 else 'b'} ." for i in range(7)))
    shape = P + "ex:S sh:targetClass ex:C ; sh:property [ sh:path [ sh:inversePath ex:of ] ; sh:minCount 1 ; sh:maxCount 3 ] ."
    monkeypatch.setattr(store, "ROWS", 1)
    report = validate(src, shape)
    assert sorted((r.focus, r.component) for r in report.collect()) == [("http://ex/a", "maxCount"), ("http://ex/c", "minCount")]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2  # only the lookups of terms are left


def test_axioms_are_found_by_id_before_terms_are_joined(spark, monkeypatch):
    src = QuadSource.from_text(spark, P + "ex:A rdfs:subClassOf ex:B . ex:p a owl:FunctionalProperty . ex:x a ex:A ; ex:p ex:y .")
    met, as_terms = [], QuadSource.as_terms

    def counted(self, derived=None):
        met.append(self.quads.count())
        return as_terms(self, derived)

    monkeypatch.setattr(QuadSource, "as_terms", counted)
    assert len(Ontology.from_source(src).triples) == 2
    assert met == [2]
