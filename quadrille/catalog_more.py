"""Registered queries of readers, writers, terms, shapes, entailment and store operations, each with the DuckDB SQL of its rows."""

import hashlib
import os
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from .catalog_rules import BASE, EX, SHAPES, ask, graph, with_text
from .engine import Engine, tables_source
from .operators.datalog import Contradiction, delete_quads, delete_rules, insert_rules, materialise_rules, naive, parse_rules, provenance, stratify
from .operators.ottr import expand_document, parse_wottr
from .operators.owl import entail, inconsistent
from .operators.rml import confine, map_quads
from .operators.shacl import Shapes, Validator, validate
from .operators.update import Conflict, Store
from .operators.vqs import Config, NavGraph, class_counts, edge_counts, estimated_answers, greedy_search, random_search
from .plans.store import shared_dir
from .sources.quads import QuadSource, quads_of
from .sources.canonical import canonical_lines
from .sources.manchester import manchester_text, read_manchester
from .sources.rdf import JsonLd, load, nquads_lines, quads_from_text, save
from .sources.results import csv_lines, table_text, tsv_lines, xml_rows

XSD = "http://www.w3.org/2001/XMLSchema#"

#: name: (query over the tables, SQL)
SPARQL = {
    "nested_groups": (
        "SELECT ?k WHERE { ?c :c_custkey ?k { ?c :c_mktsegment 'BUILDING' { ?c :c_nationkey ?n FILTER(?n < 5) } } }",
        "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5",
    ),
    "fn_bound": (
        "SELECT ?k (BOUND(?o) AS ?b) WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?p FILTER(?p > 400000) } }",
        "SELECT c_custkey AS k, o_orderkey IS NOT NULL AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000",
    ),
    "fn_unary_signs": (
        "SELECT ?k (-?b AS ?minus) (+?b AS ?plus) (-?k AS ?j) WHERE { ?s :s_suppkey ?k ; :s_acctbal ?b }",
        "SELECT s_suppkey AS k, -s_acctbal AS minus, s_acctbal AS plus, -s_suppkey AS j FROM supplier",
    ),
    "fn_iri_uri": (
        "SELECT ?k (IRI(CONCAT('http://ex/x/', STR(?k))) AS ?i) (isIRI(URI('http://ex/u')) AS ?u) WHERE { ?n :n_nationkey ?k }",
        "SELECT n_nationkey AS k, 'http://ex/x/' || n_nationkey AS i, true AS u FROM nation",
    ),
    "fn_bnode": (
        "SELECT (COUNT(DISTINCT ?b) AS ?n) (MIN(isBlank(?b)) AS ?blank) WHERE { ?x :n_nationkey ?k BIND(BNODE() AS ?b) }",
        "SELECT COUNT(*) AS n, true AS blank FROM nation",
    ),
    "fn_strdt": (
        f"SELECT ?k (STR(STRDT(?n, <{BASE}kind>)) AS ?s) (DATATYPE(STRDT(?n, <{BASE}kind>)) AS ?d) (isLiteral(STRDT('1', xsd:integer)) AS ?l) WHERE {{ ?x :n_nationkey ?k ; :n_name ?n }}",
        f"SELECT n_nationkey AS k, n_name AS s, '{BASE}kind' AS d, true AS l FROM nation",
    ),
    "fn_strlang": (
        "SELECT ?k (LANG(STRLANG(?n, 'fr')) AS ?l) (LANGMATCHES(LANG(STRLANG(?n, 'fr')), 'FR') AS ?m) (LANGMATCHES(LANG(?n), '*') AS ?none) WHERE { ?x :n_nationkey ?k ; :n_name ?n }",
        "SELECT n_nationkey AS k, 'fr' AS l, true AS m, false AS none FROM nation",
    ),
    "fn_uuid": (
        "SELECT (COUNT(DISTINCT ?u) AS ?n) (MIN(STRLEN(?u)) AS ?len) (MIN(STRSTARTS(STR(?i), 'urn:uuid:')) AS ?ok) WHERE { ?x :n_nationkey ?k BIND(STRUUID() AS ?u) BIND(UUID() AS ?i) }",
        "SELECT COUNT(*) AS n, 36 AS len, true AS ok FROM nation",
    ),
    "fn_rand_now": (
        "SELECT ?k (?r >= 0 && ?r < 1 AS ?ok) (YEAR(NOW()) > 2000 AS ?late) (NOW() = NOW() AS ?once) WHERE { ?x :n_nationkey ?k BIND(RAND() AS ?r) }",
        "SELECT n_nationkey AS k, true AS ok, true AS late, true AS once FROM nation",
    ),
    "fn_seconds": (
        "SELECT ?k (SECONDS(?d) AS ?s) WHERE { ?e :event_id ?k ; :ts ?d }",
        "SELECT event_id AS k, (microsecond(ts) / 1e6)::DECIMAL(8,6) AS s FROM events",
    ),
    "fn_timezone": (
        "SELECT ?k (TZ('2020-01-02T03:04:05Z'^^xsd:dateTime) AS ?z) (TIMEZONE('2020-01-02T03:04:05Z'^^xsd:dateTime) AS ?t) WHERE { ?x :r_regionkey ?k }",
        "SELECT r_regionkey AS k, 'Z' AS z, 'PT0S' AS t FROM region",
    ),
    "fn_sha384_sha512": (
        "SELECT (SHA384('abc') AS ?a) (SHA512('abc') AS ?b) WHERE { }",
        f"SELECT '{hashlib.sha384(b'abc').hexdigest()}' AS a, '{hashlib.sha512(b'abc').hexdigest()}' AS b",
    ),
    "cast_decimal_float_datetime": (
        "SELECT ?k (xsd:decimal(?k) AS ?d) (xsd:float(?k) AS ?f) (YEAR(xsd:dateTime('2021-05-06T07:08:09')) AS ?y) (xsd:decimal('x') AS ?bad) WHERE { ?n :n_nationkey ?k }",
        "SELECT n_nationkey AS k, n_nationkey::DECIMAL(38,10) AS d, n_nationkey::FLOAT AS f, 2021 AS y, NULL::DECIMAL(38,10) AS bad FROM nation",
    ),
    "group_by_empty_input": (
        "SELECT ?r (COUNT(*) AS ?n) WHERE { ?x :n_regionkey ?r FILTER(?r > 99) } GROUP BY ?r",
        "SELECT n_regionkey AS r, COUNT(*) AS n FROM nation WHERE n_regionkey > 99 GROUP BY 1",
    ),
    "order_total_unbound_first": (
        "SELECT ?k ?p WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?p FILTER(?p > 300000) } } ORDER BY ?p DESC(?k) LIMIT 40",
        "SELECT c_custkey AS k, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 ORDER BY o_totalprice NULLS FIRST, c_custkey DESC LIMIT 40",
    ),
    "path_exact_repeat": (
        "SELECT ?x ?y WHERE { ?x (:s_nation|:n_region){2} ?y }",
        "SELECT 'http://ex/supplier/' || s_suppkey AS x, 'http://ex/region/' || n_regionkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "sum_of_large_integers": (
        "SELECT (SUM(?v) AS ?s) (COUNT(?v) AS ?n) WHERE { ?x :n_nationkey ?k BIND(?k * 100000000000000000 AS ?v) }",
        "SELECT (CASE WHEN SUM(n_nationkey::HUGEINT * 100000000000000000) <= 9223372036854775807 THEN SUM(n_nationkey::HUGEINT * 100000000000000000) END)::BIGINT AS s, COUNT(*) AS n FROM nation",
    ),
    "service_silent": (
        "SELECT ?k WHERE { ?x :n_nationkey ?k SERVICE SILENT <http://nowhere.invalid/> { ?x ?p ?o } }",
        "SELECT n_nationkey AS k FROM nation",
    ),
}


def _runner(text):
    return lambda spark, sf_dir: Engine(tables_source(spark, sf_dir)).sparql(text)


def outcomes(spark, **found):
    """Rows (check, outcome)."""
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "check string, outcome string")


def outcome_sql(**want):
    return "SELECT unnest([" + ", ".join(f"'{k}'" for k in want) + "]) AS \"check\", unnest([" + ", ".join(f"'{v}'" for v in want.values()) + "]) AS outcome"


def refused(error, call):
    try:
        call()
    except error:
        return "refused"
    return "accepted"


def folder(spark):
    return f"{shared_dir(spark)}/more-{uuid.uuid4().hex}"


# readers and writers
def _nations(spark, sf_dir):
    return quads_of(tables_source(spark, sf_dir, ["nation", "customer"]), [BASE + p for p in ("n_name", "n_region", "c_nation", "c_acctbal")], [BASE + "Nation"])


def as_array(spark, path):
    """JSON-LD documents of the lines written to a path: an array of each part of it."""

    def arrays(batches):
        import pyarrow as pa

        start = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([start + lines[0], *("," + x for x in lines[1:])], pa.string())], names=["value"])
                start = ","
        if start == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    to = f"{folder(spark)}/array.jsonld"
    spark.read.text(path).mapInArrow(arrays, "value string").write.text(to)
    return to


def _round_trip(fmt):
    def run(spark, sf_dir):
        """Written in one format and read back: names and largest balance of the customers of a nation."""
        path = f"{folder(spark)}/data.{fmt}"
        save(_nations(spark, sf_dir), path, fmt)
        if fmt == "jsonld":
            path = as_array(spark, path)
        return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?n (COUNT(?c) AS ?k) (MAX(xsd:double(STR(?b))) AS ?most) WHERE { ?x a :Nation ; :n_name ?n . ?c :c_nation ?x ; :c_acctbal ?b } GROUP BY ?n")

    return run


ROUND_SQL = "SELECT n_name AS n, COUNT(*) AS k, MAX(c_acctbal) AS most FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"


def _named(spark, sf_dir):
    """Each nation's name in a graph of its region."""
    q = quads_of(tables_source(spark, sf_dir, ["nation"]), [BASE + "n_name"])
    r = quads_of(tables_source(spark, sf_dir, ["nation"]), [BASE + "n_region"]).select(F.col("s.lex").alias("i"), F.col("o").alias("r"))
    return q.join(r, F.col("s.lex") == F.col("i")).select("s", "p", "o", F.col("r").alias("g"))


def _named_round_trip(fmt):
    def run(spark, sf_dir):
        path = f"{folder(spark)}/data.{fmt}"
        save(_named(spark, sf_dir), path, fmt)
        if fmt == "jsonld":
            path = as_array(spark, path)
        return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?g ?n WHERE { GRAPH ?g { ?x :n_name ?n } }")

    return run


NAMED_SQL = "SELECT 'http://ex/region/' || n_regionkey AS g, n_name AS n FROM nation"


def from_two_graphs(spark, sf_dir):
    return ask(QuadSource.from_quads(spark, _named(spark, sf_dir)), "SELECT ?n FROM <http://ex/region/1> FROM <http://ex/region/2> WHERE { ?x :n_name ?n }")


def from_named_graphs(spark, sf_dir):
    return ask(QuadSource.from_quads(spark, _named(spark, sf_dir)), "SELECT ?g ?n FROM NAMED <http://ex/region/1> FROM NAMED <http://ex/region/3> WHERE { GRAPH ?g { ?x :n_name ?n } }")


def path_in_any_graph(spark, sf_dir):
    """Closures stay inside their graph: the ring of each region's nations."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    line = F.concat(F.lit("<http://ex/nation/"), F.col("n_nationkey"), F.lit("> <http://ex/next> <http://ex/nation/"), F.col("n_nationkey") + 5, F.lit("> <http://ex/region/"), F.col("n_nationkey") % 5, F.lit("> ."))
    path = f"{folder(spark)}/steps.nq"
    nation.select(line.alias("value")).write.text(path)
    return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x :next+ ?y } } GROUP BY ?g")


def turtle_with_base(spark, sf_dir):
    """Relative IRIs of a Turtle document joined with the tables' IRIs."""
    text = "@base <http://ex/> . @prefix : <#> . " + " ".join(f"<nation/{k}> :tag 'tag{k % 3}' ." for k in range(25))
    src = graph(spark, sf_dir, ("n_name",), (), ["nation"])
    more = QuadSource.from_text(spark, text)
    return ask(src.with_quads(src.quads.unionByName(more.quads), more.terms), "SELECT ?n ?t WHERE { ?x :n_name ?n ; <http://ex/#tag> ?t }")


def jsonld_registered_context(spark, sf_dir):
    """A context from the registry, as a document loader that fetches nothing."""
    JsonLd.REGISTRY["http://ex/context"] = {"@context": {"@vocab": BASE, "of": {"@type": "@id"}}}
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()  # five regions
    text = "[" + ",".join(f'{{"@context": "http://ex/context", "@id": "http://ex/r/{r.r_regionkey}", "title": "{r.r_name}", "of": "http://ex/world"}}' for r in names) + "]"
    return ask(QuadSource.from_quads(spark, quads_from_text(spark, text, "jsonld")), "SELECT ?t WHERE { ?x :title ?t ; :of :world }")


def triple_terms(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.concat(F.lit("<http://ex/report/"), F.col("n_nationkey"), F.lit("> <http://ex/says> <<( <http://ex/nation/"), F.col("n_nationkey"), F.lit("> <http://ex/in> <http://ex/region/"), F.col("n_regionkey"), F.lit("> )>> ."))
    path = f"{folder(spark)}/terms.nt"
    nation.select(line.alias("value")).write.text(path)
    return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?r ?n WHERE { ?r :says <<( ?n :in <http://ex/region/2> )>> }")


def triple_terms_nested(spark, sf_dir):
    """A statement about a statement, matched through both."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    inner = F.concat(F.lit("<<( <http://ex/nation/"), F.col("n_nationkey"), F.lit("> <http://ex/in> <http://ex/region/"), F.col("n_regionkey"), F.lit("> )>>"))
    path = f"{folder(spark)}/nested.nt"
    nation.select(F.concat(F.lit("<http://ex/log> <http://ex/holds> <<( _:x <http://ex/says> "), inner, F.lit(" )>> .")).alias("value")).write.text(path)
    return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?n ?g WHERE { :log :holds <<( ?who :says <<( ?n :in ?g )>> )>> }")


def results_csv(spark, sf_dir):
    df = Engine(tables_source(spark, sf_dir, ["nation"])).sparql("SELECT ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k } ORDER BY ?k", "terms")
    return csv_lines(df, header=True).select(F.trim(F.col("value")).alias("line"))


def results_tsv(spark, sf_dir):
    df = Engine(tables_source(spark, sf_dir, ["nation"])).sparql("SELECT ?x ?n WHERE { ?x :n_name ?n }", "terms")
    return tsv_lines(df, header=True).select(F.trim(F.col("value")).alias("line"))


def results_xml(spark, sf_dir):
    df = Engine(tables_source(spark, sf_dir, ["nation"])).sparql("SELECT ?x ?n WHERE { ?x :n_name ?n }", "terms")
    c = xml_rows(df)
    return c.select(F.regexp_replace(F.col(c.columns[0]), r"\s*\n\s*", "").alias("row"))


def results_table(spark, sf_dir):
    text = table_text(Engine(tables_source(spark, sf_dir, ["region"])).sparql("SELECT ?n WHERE { ?x :r_name ?n } ORDER BY ?n"))
    return spark.createDataFrame([(w,) for w in re.findall(r"[A-Z][A-Z ]+[A-Z]", text)], "n string")


# RML
RML = "@prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex/> . "


def _rml_file(kind, formulation, iterator):
    def run(spark, sf_dir):
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
        root = folder(spark).removeprefix("file://")
        out = nation.coalesce(1).write
        if kind == "csv":
            out.option("header", True).csv(f"file://{root}/n.csv")
        elif kind == "json":
            out.json(f"file://{root}/n.jsonl")
        else:
            out.format("xml").option("rootTag", "all").option("rowTag", "land").save(f"file://{root}/n.xml")
        name = {"csv": "n.csv", "json": "n.jsonl", "xml": "n.xml"}[kind]
        mapping = RML + f'<urn:n> rml:logicalSource [ rml:source "{name}" ; rml:referenceFormulation rml:{formulation} ; rml:iterator "{iterator}" ] ; rml:subjectMap [ rml:template "http://ex/N/{{n_nationkey}}" ; rml:class ex:Land ] ; rml:predicateObjectMap [ rml:predicate ex:label ; rml:objectMap [ rml:reference "n_name" ] ] , [ rml:predicate ex:from ; rml:objectMap [ rml:constant ex:file ] ] .'
        return nquads_lines(map_quads(spark, mapping, root)).select(F.col("value").alias("line"))

    return run


RML_SQL = "SELECT '<http://ex/N/' || n_nationkey || unnest(['> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Land> .', '> <http://ex/label> \"' || n_name || '\" .', '> <http://ex/from> <http://ex/file> .']) AS line FROM nation"


def read_only_database(spark, df, table, columns):
    """JDBC url of a Derby database with the rows of df as a table.

    The driver fills a database in a local folder through its own connection, row by row, and packs it as an archive: one
    JVM at a time may open a Derby folder, and a database in memory is seen by one JVM only, but any number may read an archive.
    """
    at = tempfile.mkdtemp(prefix="quadrille-derby-")
    jvm = spark.sparkContext._jvm
    jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    names = [c.split()[0] for c in columns.split(", ")]
    db = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{at}/db;create=true")
    db.setAutoCommit(False)
    quoted = ", ".join('"' + n + '" ' + c.split(" ", 1)[1] for n, c in zip(names, columns.split(", ")))
    db.createStatement().execute(f"CREATE TABLE {table} ({quoted})")
    row = db.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' for _ in names)})")
    for r in df.select(*names).toLocalIterator():
        for i, v in enumerate(r, 1):
            row.setObject(i, v)
        row.executeUpdate()
    db.commit()
    db.close()
    try:
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{at}/db;shutdown=true")
    except Py4JJavaError as e:  # Derby tells of a shutdown by an exception
        if e.java_exception.getSQLState() != "08006":
            raise
    root = folder(spark).removeprefix("file://")
    os.makedirs(root)
    shutil.make_archive(f"{root}/db", "zip", at, "db")
    shutil.rmtree(at)
    return f"jdbc:derby:jar:({root}/db.zip)db"


def rml_sql_query_and_join(spark, sf_dir):
    """A SQL query as logical source, joined with a table by a parent triples map."""
    mapping = RML + """<urn:c> rml:logicalSource [ rml:query "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000" ] ; rml:subjectMap [ rml:template "http://ex/C/{c_custkey}" ] ;
      rml:predicateObjectMap [ rml:predicate ex:home ; rml:objectMap [ rml:parentTriplesMap <urn:n> ; rml:joinCondition [ rml:child "c_nationkey" ; rml:parent "n_nationkey" ] ] ] .
      <urn:n> rml:logicalSource [ rml:tableName "nation" ] ; rml:subjectMap [ rml:template "http://ex/N/{n_nationkey}" ] ; rml:predicateObjectMap [ rml:predicate ex:kind ; rml:objectMap [ rml:constant "land" ] ] ."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "nation")}
    return nquads_lines(map_quads(spark, mapping, sf_dir, tables)).select(F.col("value").alias("line"))


def rml_database_source(spark, sf_dir):
    """A query of a database as logical source; the database is a read-only archive in the shared folder, which every executor can open."""
    url = read_only_database(spark, spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"), "regions", "r_regionkey INT, r_name VARCHAR(64)")
    mapping = RML + f"""@prefix d2rq: <http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#> .
      <urn:r> rml:logicalSource [ rml:source [ d2rq:jdbcDSN "{url}" ; d2rq:jdbcDriver "org.apache.derby.iapi.jdbc.AutoloadedDriver" ] ; rml:query "SELECT * FROM regions WHERE \\"r_regionkey\\" > 1" ] ;
      rml:subjectMap [ rml:template "http://ex/R/{{r_regionkey}}" ] ; rml:predicateObjectMap [ rml:predicate ex:label ; rml:objectMap [ rml:reference "r_name" ] ] ."""
    return nquads_lines(map_quads(spark, mapping, sf_dir)).select(F.col("value").alias("line"))


def explain_patterns(spark, sf_dir):
    e = Engine(graph(spark, sf_dir, ("o_customer", "c_mktsegment"), (), ["orders", "customer"]))
    return e.explain_patterns("SELECT ?o WHERE { ?o :o_customer ?c . OPTIONAL { ?c :c_mktsegment 'BUILDING' ; ?p ?x } }")


def refusals(spark, sf_dir):
    """What must not be let through: unsafe rules, negative cycles, paths out of the folder, remote sources, recursive shapes."""
    tables = tables_source(spark, sf_dir, ["region"])
    store = Store(QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . ex:a ex:p 1 ."), prefixes={"": BASE})
    return outcomes(
        spark,
        unsafe_rule=refused(ValueError, lambda: parse_rules(EX + "ex:A[?x] :- NOT ex:B[?x] .")),
        negative_cycle=refused(ValueError, lambda: stratify(parse_rules(EX + "ex:A[?x] :- ex:D[?x], NOT ex:C[?x] . ex:C[?x] :- ex:D[?x], NOT ex:A[?x] ."))),
        separate_constants=refused(ValueError, lambda: stratify(parse_rules(EX + "ex:p[?x, ex:one] :- ex:D[?x], NOT ex:p[?x, ex:two] . ex:q[?x, ex:two] :- ex:D[?x] ."))),
        path_out=refused(PermissionError, lambda: confine("/tmp/inside", "../other.csv")),
        service=refused(PermissionError, lambda: Engine(tables).sparql("SELECT * { SERVICE <http://nowhere.invalid/> { ?s ?p ?o } }")),
        remote_load=refused(PermissionError, lambda: store.update("LOAD <http://nowhere.invalid/x.ttl>")),
        recursive_shape=refused(ValueError, lambda: Validator(tables, Shapes.from_text(SHAPES + "ex:S sh:targetClass ex:P ; sh:node ex:S ."))),
        recursive_template=refused(ValueError, lambda: expand_document(spark, "@prefix ex: <http://ex/> . ex:R[?x] :: { ex:R(?x) } . ex:R(ex:a) .")),
    )


def explain_and_timeout(spark, sf_dir):
    e = Engine(tables_source(spark, sf_dir, ["region"]))
    text = e.explain("SELECT ?n WHERE { ?x :r_name ?n FILTER(?n > 'B') }")
    return outcomes(spark, scan="Scan parquet" in text, pushed="PushedFilters" in text and "r_name" in text, rows=len(e.sparql_with_timeout("SELECT ?n WHERE { ?x :r_name ?n }", 600)))


# rules
def datalog_facts_and_constants(spark, sf_dir):
    rules = parse_rules(EX + "ex:Home[<http://ex/region/2>] . ex:Near[?x] :- ex:n_region[?x, ?r], ex:Home[?r] .")
    return ask(materialise_rules(graph(spark, sf_dir, ("n_region",), (), ["nation"]), rules), "SELECT ?x ?k WHERE { ?x a ?k FILTER(?k IN (:Home, :Near)) }")


def datalog_naive(spark, sf_dir):
    rules = parse_rules(EX + "ex:in[?x, ?y] :- ex:c_nation[?x, ?y] . ex:in[?x, ?z] :- ex:in[?x, ?y], ex:n_region[?y, ?z] .")
    return ask(naive(graph(spark, sf_dir, ("c_nation", "n_region"), (), ["customer", "nation"]), rules), "SELECT ?y (COUNT(?x) AS ?n) WHERE { ?x :in ?y } GROUP BY ?y")


def datalog_graph_terms(spark, sf_dir):
    """Rules with a graph variable: what a graph says stays in that graph."""
    rules = parse_rules("[?s, <http://ex/called>, ?o] ?g :- [?s, <http://ex/n_name>, ?o] ?g .")
    return ask(materialise_rules(QuadSource.from_quads(spark, _named(spark, sf_dir)), rules), "SELECT ?g ?n WHERE { GRAPH ?g { ?x :called ?n } }")


def datalog_contradiction(spark, sf_dir):
    src = graph(spark, sf_dir, ("n_region",), (), ["nation"])
    return outcomes(spark, absent=refused(Contradiction, lambda: materialise_rules(src, parse_rules(EX + "false :- ex:n_region[?x, ex:nowhere] ."))), present=refused(Contradiction, lambda: materialise_rules(src, parse_rules(EX + "false :- ex:n_region[?x, <http://ex/region/1>] ."))))


IDLE = EX + "ex:Idle[?c] :- ex:Customer[?c], NOT ex:Has[?c] ."


def _orders(spark, sf_dir):
    return graph(spark, sf_dir, ("o_customer",), ("Customer",), ["customer", "orders"])


def incremental_rule_insert(spark, sf_dir):
    """A rule that feeds a negated one is added: what no longer holds goes."""
    rules = parse_rules(IDLE)
    return ask(insert_rules(materialise_rules(_orders(spark, sf_dir), rules), rules, parse_rules(EX + "ex:Has[?c] :- ex:o_customer[?o, ?c] .")), "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x a ?k FILTER(?k IN (:Idle, :Has)) } GROUP BY ?k")


def incremental_rule_delete(spark, sf_dir):
    rules = parse_rules(EX + "ex:Has[?c] :- ex:o_customer[?o, ?c] . ex:Kept[?c] :- ex:Customer[?c] .")
    return ask(delete_rules(materialise_rules(_orders(spark, sf_dir), rules), rules, rules[:1]), "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x a ?k FILTER(?k IN (:Kept, :Has)) } GROUP BY ?k")


def incremental_rebuild(spark, sf_dir):
    """A deletion above the fallback share rebuilds the closure from the base quads."""
    rules = parse_rules(EX + "ex:in[?x, ?y] :- ex:n_region[?x, ?y] . ex:in[?x, ?z] :- ex:in[?x, ?y], ex:part[?y, ?z] .")
    base = with_text(spark, graph(spark, sf_dir, ("n_region",), (), ["nation"]), " ".join(f"<http://ex/region/{k}> ex:part ex:world ." for k in range(5)))
    gone = QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . " + " ".join(f"<http://ex/region/{k}> ex:part ex:world ." for k in range(1, 5)))
    return ask(delete_quads(materialise_rules(base, rules), rules, gone.quads, fallback=0.0), "SELECT ?x ?y WHERE { ?x :in ?y }")


# entailment
def owl_symmetric_transitive(spark, sf_dir):
    src = with_text(spark, graph(spark, sf_dir, ("c_nation", "n_region"), (), ["customer", "nation"]), "ex:near a owl:SymmetricProperty . ex:c_nation rdfs:subPropertyOf ex:within . ex:n_region rdfs:subPropertyOf ex:within . ex:within a owl:TransitiveProperty . <http://ex/nation/1> ex:near <http://ex/nation/2> .")
    return ask(entail(src), "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x ?p ?y FILTER(?p IN (:near, :within)) } GROUP BY ?p")


def owl_values_and_unions(spark, sf_dir):
    src = with_text(
        spark,
        graph(spark, sf_dir, ("n_region",), ("Nation",), ["nation"]),
        "ex:Nation rdfs:subClassOf [ owl:onProperty ex:n_region ; owl:allValuesFrom ex:Area ] . [] owl:unionOf (ex:Area ex:Nation) ; rdfs:subClassOf ex:Place . ex:Area rdfs:subClassOf [ owl:onProperty ex:kind ; owl:hasValue ex:big ] .",
    )
    return ask(entail(src), "SELECT ?k (COUNT(DISTINCT ?x) AS ?n) WHERE { { ?x a ?k FILTER(?k IN (:Area, :Place)) } UNION { ?x :kind :big BIND(:kind AS ?k) } } GROUP BY ?k")


def owl_data_properties(spark, sf_dir):
    src = with_text(spark, graph(spark, sf_dir, ("n_name", "r_name"), (), ["nation", "region"]), "ex:n_name rdfs:domain ex:Land ; rdfs:subPropertyOf ex:label . ex:r_name rdfs:subPropertyOf ex:label .")
    return ask(entail(src), "SELECT ?k (COUNT(*) AS ?n) WHERE { { ?x a ?k FILTER(?k = :Land) } UNION { ?x :label ?y BIND(:label AS ?k) } } GROUP BY ?k")


def owl_contradictions(spark, sf_dir):
    """Disjoint classes, a forbidden property and members of the empty class."""
    src = graph(spark, sf_dir, ("n_region",), ("Nation",), ["nation"])
    clash = lambda text: refused(Contradiction, lambda: entail(with_text(spark, src, text)))
    return outcomes(
        spark,
        disjoint=clash("ex:Nation owl:disjointWith ex:Area . ex:n_region rdfs:domain ex:Area ."),
        apart=clash("ex:Nation owl:disjointWith ex:Area . ex:n_region rdfs:range ex:Area ."),
        max_zero=clash("ex:Nation rdfs:subClassOf [ owl:onProperty ex:n_region ; owl:maxCardinality 0 ] ."),
        nothing=inconsistent(with_text(spark, src, "ex:x a owl:Nothing .")).df.count(),
    )


# shapes
def _shacl(shape, tables):
    return lambda spark, sf_dir: validate(tables_source(spark, sf_dir, tables), SHAPES + shape).select("focus", "value", "component")


SHACL = {
    "shacl_xone": (
        "ex:S sh:targetClass ex:Supplier ; sh:xone ( [ sh:property [ sh:path ex:s_acctbal ; sh:minInclusive 0.0 ] ] [ sh:property [ sh:path ex:s_nationkey ; sh:maxExclusive 10 ] ] ) .",
        ["supplier"],
        "SELECT 'http://ex/supplier/' || s_suppkey AS focus, 'http://ex/supplier/' || s_suppkey AS value, 'xone' AS component FROM supplier WHERE (s_acctbal >= 0) = (s_nationkey < 10)",
    ),
    "shacl_and_node": (
        "ex:S sh:targetClass ex:Nation ; sh:property [ sh:path ex:n_region ; sh:node ex:R ] ; sh:and ( [ sh:property [ sh:path ex:n_nationkey ; sh:minInclusive 2 ] ] [ sh:property [ sh:path ex:n_nationkey ; sh:maxInclusive 20 ] ] ) . ex:R a sh:NodeShape ; sh:property [ sh:path ex:r_name ; sh:pattern '^A' ] .",
        ["nation", "region"],
        "SELECT 'http://ex/nation/' || n_nationkey AS focus, 'http://ex/region/' || n_regionkey AS value, 'node' AS component FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT starts_with(r_name, 'A') UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/nation/' || n_nationkey, 'and' FROM nation WHERE n_nationkey NOT BETWEEN 2 AND 20",
    ),
    "shacl_has_value": (
        "ex:S sh:targetClass ex:Order ; sh:property [ sh:path ex:o_orderstatus ; sh:hasValue 'F' ] .",
        ["orders"],
        "SELECT 'http://ex/orders/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'hasValue' AS component FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "shacl_equals_disjoint": (
        "ex:S sh:targetClass ex:Nation ; sh:property [ sh:path ex:n_nationkey ; sh:disjoint ex:n_regionkey ] . ex:T sh:targetClass ex:Region ; sh:property [ sh:path ex:r_regionkey ; sh:equals ex:r_regionkey ] .",
        ["nation", "region"],
        "SELECT 'http://ex/nation/' || n_nationkey AS focus, n_nationkey::VARCHAR AS value, 'disjoint' AS component FROM nation WHERE n_nationkey = n_regionkey",
    ),
    "shacl_less_or_equal": (
        "ex:S sh:targetClass ex:Nation ; sh:property [ sh:path ex:n_nationkey ; sh:lessThanOrEquals ex:n_regionkey ] .",
        ["nation"],
        "SELECT 'http://ex/nation/' || n_nationkey AS focus, n_nationkey::VARCHAR AS value, 'lessThanOrEquals' AS component FROM nation WHERE NOT n_nationkey <= n_regionkey",
    ),
}


def _labelled(spark, sf_dir):
    """Nation names as literals tagged by region: two names in one language for every third nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tag = F.when(F.col("n_regionkey") == 0, "fr").when(F.col("n_regionkey") == 1, "en-GB").otherwise("en")
    line = lambda text: F.concat(F.lit("<http://ex/nation/"), F.col("n_nationkey"), F.lit('> <http://ex/label> "'), text, F.lit('"@'), tag, F.lit(" ."))
    kind = F.concat(F.lit("<http://ex/nation/"), F.col("n_nationkey"), F.lit("> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Nation> ."))
    path = f"{folder(spark)}/labels.nt"
    rows = nation.select(line(F.col("n_name"))).union(nation.where("n_nationkey % 3 = 0").select(line(F.lower("n_name")))).union(nation.select(kind))
    rows.toDF("value").write.text(path)
    return QuadSource.from_quads(spark, load(spark, path))


def shacl_languages(spark, sf_dir):
    shape = SHAPES + "ex:S sh:targetClass ex:Nation ; sh:property [ sh:path ex:label ; sh:languageIn ( 'en' ) ; sh:uniqueLang true ] ."
    return validate(_labelled(spark, sf_dir), shape).select("focus", "value", "component")


def shacl_severity_message(spark, sf_dir):
    shape = SHAPES + "ex:S sh:targetClass ex:Region ; sh:property [ sh:path ex:r_regionkey ; sh:maxInclusive 2 ; sh:severity sh:Warning ; sh:message 'too far' ] . ex:T sh:targetClass ex:Region ; sh:deactivated true ; sh:property [ sh:path ex:none ; sh:minCount 1 ] ."
    return validate(tables_source(spark, sf_dir, ["region"]), shape).select("focus", "severity", "message")


# templates
def ottr_none_defaults_types(spark, sf_dir):
    """An optional argument left out, a default value, and typed parameters."""
    text = """@prefix ex: <http://ex/> . ex:Person[ottr:IRI ?p, ? xsd:string ?n] :: { ottr:Triple(?p, rdf:type, ex:P), ex:Named(?p, ?n) } . ex:Named[?p, ?n = "x"] :: { ottr:Triple(?p, ex:name, ?n) } .
      ex:Person(ex:c, "Carol") . ex:Person(ex:d, none) . ex:Named(ex:w, none) ."""
    return nquads_lines(expand_document(spark, text)).select(F.col("value").alias("line"))


WOTTR = """@prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix ex: <http://ex/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:Area a ottr:Template ; ottr:parameters ( [ ottr:variable _:a ; ottr:type ottr:IRI ] [ ottr:variable _:names ; ottr:modifier ottr:optional ] [ ottr:variable _:k ; ottr:default "area" ] ) ;
  ottr:pattern [ ottr:of ottr:Triple ; ottr:values ( _:a rdf:type ex:Area ) ] , [ ottr:of ottr:Triple ; ottr:modifier ottr:cross ; ottr:arguments ( [ ottr:value _:a ] [ ottr:value ex:name ] [ ottr:value _:names ; ottr:modifier ottr:listExpand ] ) ] , [ ottr:of ottr:Triple ; ottr:values ( _:a ex:kind _:k ) ] .
"""


def ottr_rdf_templates(spark, sf_dir):
    """Templates and instances written as RDF: one instance per region, with two names each."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()  # five regions
    text = WOTTR + " ".join(f'[] ottr:of ex:Area ; ottr:values ( <http://ex/R/{r.r_regionkey}> ( "{r.r_name}" "{r.r_name.lower()}" ) ottr:none ) .' for r in regions)
    return nquads_lines(expand_document(spark, parse_wottr(text))).select(F.col("value").alias("line"))


# stores
def update_delete_data_and_load(spark, sf_dir):
    root = folder(spark).removeprefix("file://")
    spark.createDataFrame([("<http://ex/n> <http://ex/m> 'loaded' .",)], "value string").coalesce(1).write.text(f"file://{root}/in.ttl")
    store = Store(graph(spark, sf_dir, ("o_orderstatus",), (), ["orders"]), prefixes={"": BASE}, allow_load=root)
    store.update(f"CREATE GRAPH :h ; INSERT DATA {{ :a :p 1 . :b :p 2 }} ; DELETE DATA {{ :a :p 1 }} ; LOAD <file://{root}/in.ttl> INTO GRAPH :h")
    return ask(store.source, "SELECT ?p (COUNT(*) AS ?n) WHERE { { ?s ?p ?o } UNION { GRAPH :h { ?s ?p ?o } } } GROUP BY ?p")


def update_orders(spark, sf_dir):
    """A modification of many quads: orders of a status are marked and lose it."""
    store = Store(graph(spark, sf_dir, ("o_orderstatus", "o_orderpriority"), (), ["orders"]), prefixes={"": BASE})
    store.update("DELETE { ?o :o_orderstatus 'F' } INSERT { ?o :done ?p } WHERE { ?o :o_orderstatus 'F' ; :o_orderpriority ?p } ; INSERT DATA { :job :did 'mark' }")
    return ask(store.source, "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")


def graph_store_protocol(spark, sf_dir):
    names = quads_of(tables_source(spark, sf_dir, ["region"]), [BASE + "r_name"])
    store = Store(graph(spark, sf_dir, ("n_name",), (), ["nation"]), prefixes={"": BASE})
    store.put_graph(names, BASE + "g")
    store.post_graph(quads_of(tables_source(spark, sf_dir, ["region"]), [BASE + "r_regionkey"]), BASE + "g")
    store.put_graph(names, BASE + "h")
    there = store.has_graph(BASE + "h")
    store.delete_graph(BASE + "h")
    return outcomes(spark, posted=store.get_graph(BASE + "g").count(), default=store.get_graph().count(), there=there, gone=store.has_graph(BASE + "h"))


def transactions(spark, sf_dir):
    store = Store(graph(spark, sf_dir, ("r_name",), (), ["region"]), prefixes={"": BASE})
    first, second, third = store.begin(), store.begin(), store.begin()
    first.update("INSERT DATA { :a :p 1 }").commit()
    late = refused(Conflict, lambda: second.update("CLEAR ALL").commit())
    third.rollback()
    before = store.source
    failed = refused(PermissionError, lambda: store.update("CLEAR ALL ; LOAD <file:///etc/hostname>"))
    return outcomes(spark, quads=store.source.quads.count(), late=late, failed=failed, unchanged=store.source is before)


# query index
def vqs_navigation_and_search(spark, sf_dir):
    tables = tables_source(spark, sf_dir, ["nation", "region", "customer"])
    nav = NavGraph.from_source(QuadSource.from_text(spark, f"@prefix ex: <{BASE}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . ex:n_region rdfs:domain ex:Nation ; rdfs:range ex:Region . ex:c_nation rdfs:domain ex:Customer ; rdfs:range ex:Nation ."))
    counts = {r["class"]: r.n for r in class_counts(tables).collect()}  # a row per class
    edges = {(r.c, r.p, r.d): r.triples for r in edge_counts(tables).collect()}  # a row per kind of edge
    region = Config(BASE + "Region")
    one = Config(BASE + "Nation", ((BASE + "n_region", region),))
    two = Config(BASE + "Customer", ((BASE + "c_nation", one),))
    log = {one: 3, two: 1}
    rows = Engine(tables).sparql(two.sparql()).count()
    return outcomes(
        spark,
        outgoing=len(nav.outgoing(BASE + "Nation")),
        estimate_is_count=int(estimated_answers(counts, edges, two)) == rows,
        greedy=len(greedy_search([one, two], log, counts, edges, 10**9)),
        random=len(random_search([one, two], log, counts, edges, 10**9)),
        prefixes=len(two.prefixes()),
    )


ONTOLOGY = """Prefix: : <http://ex/>
Ontology: <http://ex/onto>
ObjectProperty: near
    Characteristics: Symmetric
ObjectProperty: inRegion
    SubPropertyChain: c_nation o n_region
Class: Rich
    EquivalentTo: c_acctbal some Amount
Class: Land
    SubClassOf: Place, n_region only Area
Class: Nation
    SubClassOf: Land
Individual: home
    Types: Land, near value away
    Facts: near <http://ex/nation/3>
Individual: away
    SameAs: <http://ex/nation/4>
"""


def manchester_entailment(spark, sf_dir):
    """A Manchester ontology, its individuals included, over the tables."""
    src = graph(spark, sf_dir, ("c_nation", "n_region"), ("Nation",), ["customer", "nation"])
    more = QuadSource.from_quads(spark, read_manchester(spark, ONTOLOGY))
    return ask(entail(src.with_quads(src.quads.unionByName(more.quads).distinct(), more.terms)), "SELECT ?k (COUNT(DISTINCT ?x) AS ?n) WHERE { { ?x a ?k FILTER(?k IN (:Place, :Area)) } UNION { ?x :inRegion ?y BIND(:inRegion AS ?k) } UNION { ?x :near :home BIND(:near AS ?k) } } GROUP BY ?k")


def manchester_round_trip(spark, sf_dir):
    """Nations as individuals, written as frames and read back."""
    quads = quads_of(tables_source(spark, sf_dir, ["nation"]), [BASE + "n_name", BASE + "n_region"], [BASE + "Nation"])
    back = QuadSource.from_quads(spark, read_manchester(spark, manchester_text(quads)))
    return ask(back, "SELECT ?x ?n ?r WHERE { ?x a :Nation ; :n_name ?n ; :n_region ?r }")


def canonical_blank_nodes(spark, sf_dir):
    """Nations as blank nodes: labels follow the order of their first-degree hashes."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = f"{folder(spark)}/blank.nt"
    nation.select(F.concat(F.lit("_:x"), F.col("n_nationkey"), F.lit(' <http://ex/name> "'), F.col("n_name"), F.lit('" .')).alias("value")).write.text(path)
    return canonical_lines(load(spark, path)).select(F.col("value").alias("line"))


def canonical_alike_nodes(spark, sf_dir):
    """Blank nodes that only their neighbours tell apart get the same labels however they are named."""
    lines = "_:{0} <http://ex/p> _:{1} . _:{1} <http://ex/p> _:{2} . _:{2} <http://ex/p> _:{0} . _:{3} <http://ex/p> _:{4} . _:{4} <http://ex/p> _:{3} ."
    made = [sorted(r.value for r in canonical_lines(quads_from_text(spark, lines.format(*names))).collect()) for names in ("abcde", "ebdca", "dcaeb")]  # five quads each
    return outcomes(spark, quads=len(made[0]), alike=made[0] == made[1] == made[2], labels=all("_:c14n" in x for x in made[0]))


def provenance_index(spark, sf_dir):
    """Which rule and which quads gave each derived quad."""
    rules = parse_rules(EX + "ex:in[?x, ?y] :- ex:c_nation[?x, ?y] . ex:in[?x, ?z] :- ex:in[?x, ?y], ex:n_region[?y, ?z] .")
    full = materialise_rules(graph(spark, sf_dir, ("c_nation", "n_region"), (), ["customer", "nation"]), rules)
    rows = provenance(full, rules)
    used = rows.withColumn("used", F.explode("body")).join(full.quads.select(*[F.col(c).alias(f"u_{c}") for c in "gspo"]), (F.col("used.g") == F.col("u_g")) & (F.col("used.s") == F.col("u_s")) & (F.col("used.p") == F.col("u_p")) & (F.col("used.o") == F.col("u_o")))
    return used.groupBy("rule").agg(F.count_distinct("s", "o").alias("derived"), F.count(F.lit(1)).alias("uses"))


def path_cycle(spark, sf_dir):
    """Nodes on a cycle: nations linked in a ring by their keys, others on a chain."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    nxt = F.when(F.col("n_nationkey") < 7, (F.col("n_nationkey") + 1) % 7).otherwise(F.col("n_nationkey") + 1)
    path = f"{folder(spark)}/ring.nt"
    nation.select(F.concat(F.lit("<http://ex/nation/"), F.col("n_nationkey"), F.lit("> <http://ex/next> <http://ex/nation/"), nxt, F.lit("> .")).alias("value")).write.text(path)
    return ask(QuadSource.from_quads(spark, load(spark, path)), "SELECT ?x WHERE { ?x :next+ ?x }")


SQL = {
    "turtle_round_trip": ROUND_SQL,
    "trig_round_trip": ROUND_SQL,
    "jsonld_round_trip": ROUND_SQL,
    "nquads_named_graphs": NAMED_SQL,
    "trig_named_graphs": NAMED_SQL,
    "jsonld_named_graphs": NAMED_SQL,
    "explain_patterns": "SELECT unnest(['?o <http://ex/o_customer> ?c', '?c <http://ex/c_mktsegment> \"BUILDING\"', '?c ?p ?x']) AS pattern, unnest(['predicate range', 'predicate range', 'full scan']) AS access, unnest([(SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM customer), (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer)]) AS estimate",
    "rml_database_source": "SELECT '<http://ex/R/' || r_regionkey || '> <http://ex/label> \"' || r_name || '\" .' AS line FROM region WHERE r_regionkey > 1",
    "from_two_graphs": "SELECT n_name AS n FROM nation WHERE n_regionkey IN (1, 2)",
    "from_named_graphs": NAMED_SQL + " WHERE n_regionkey IN (1, 3)",
    "path_in_any_graph": "SELECT 'http://ex/region/' || a.n_nationkey % 5 AS g, SUM((24 - a.n_nationkey) // 5 + 1)::BIGINT AS n FROM nation a GROUP BY 1",
    "turtle_with_base": "SELECT n_name AS n, 'tag' || (n_nationkey % 3) AS t FROM nation",
    "jsonld_registered_context": "SELECT r_name AS t FROM region",
    "triple_terms_nested": "SELECT 'http://ex/nation/' || n_nationkey AS n, 'http://ex/region/' || n_regionkey AS g FROM nation",
    "triple_terms": "SELECT 'http://ex/report/' || n_nationkey AS r, 'http://ex/nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 2",
    "results_csv": "SELECT 'n,k' AS line UNION ALL SELECT n_name || ',' || n_nationkey FROM nation",
    "results_tsv": "SELECT '?x\t?n' AS line UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>\t\"' || n_name || '\"' FROM nation",
    "results_xml": "SELECT '<result><binding name=\"x\"><uri>http://ex/nation/' || n_nationkey || '</uri></binding><binding name=\"n\"><literal>' || n_name || '</literal></binding></result>' AS row FROM nation",
    "results_table": "SELECT r_name AS n FROM region",
    "rml_csv_source": RML_SQL,
    "rml_json_source": RML_SQL,
    "rml_xml_source": RML_SQL,
    "rml_sql_query_and_join": "SELECT '<http://ex/C/' || c_custkey || '> <http://ex/home> <http://ex/N/' || c_nationkey || '> .' AS line FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT '<http://ex/N/' || n_nationkey || '> <http://ex/kind> \"land\" .' FROM nation",
    "refusals": outcome_sql(unsafe_rule="refused", negative_cycle="refused", separate_constants="accepted", path_out="refused", service="refused", remote_load="refused", recursive_shape="refused", recursive_template="refused"),
    "explain_and_timeout": outcome_sql(scan="True", pushed="True", rows=5),
    "datalog_facts_and_constants": "SELECT 'http://ex/region/2' AS x, 'http://ex/Home' AS k UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/Near' FROM nation WHERE n_regionkey = 2",
    "datalog_naive": "SELECT 'http://ex/nation/' || c_nationkey AS y, COUNT(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'http://ex/region/' || n_regionkey, COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "datalog_graph_terms": NAMED_SQL,
    "datalog_contradiction": outcome_sql(absent="accepted", present="refused"),
    "incremental_rule_insert": "SELECT 'http://ex/Has' AS k, COUNT(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'http://ex/Idle', COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING COUNT(*) > 0",
    "incremental_rule_delete": "SELECT 'http://ex/Kept' AS k, COUNT(*) AS n FROM customer",
    "incremental_rebuild": "SELECT 'http://ex/nation/' || n_nationkey AS x, 'http://ex/region/' || n_regionkey AS y FROM nation UNION ALL SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/world' FROM nation WHERE n_regionkey = 0",
    "owl_symmetric_transitive": "SELECT 'http://ex/near' AS p, 2 AS n UNION ALL SELECT 'http://ex/within', 2 * (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM nation)",
    "owl_values_and_unions": "SELECT 'http://ex/' || k AS k, n FROM (SELECT 'Area' AS k, COUNT(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'kind', COUNT(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'Place', COUNT(DISTINCT n_regionkey) + COUNT(*) FROM nation)",
    "owl_data_properties": "SELECT 'http://ex/Land' AS k, COUNT(*) AS n FROM nation UNION ALL SELECT 'http://ex/label', (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM region)",
    "owl_contradictions": outcome_sql(disjoint="refused", apart="accepted", max_zero="refused", nothing=1),
    "shacl_languages": "SELECT 'http://ex/nation/' || n_nationkey AS focus, n_name AS value, 'languageIn' AS component FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'http://ex/nation/' || n_nationkey, lower(n_name), 'languageIn' FROM nation WHERE n_regionkey = 0 AND n_nationkey % 3 = 0 UNION ALL SELECT 'http://ex/nation/' || n_nationkey, NULL, 'uniqueLang' FROM nation WHERE n_nationkey % 3 = 0",
    "shacl_severity_message": "SELECT 'http://ex/region/' || r_regionkey AS focus, 'Warning' AS severity, 'too far' AS message FROM region WHERE r_regionkey > 2",
    "ottr_none_defaults_types": "SELECT unnest(['<http://ex/c> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/P> .', '<http://ex/c> <http://ex/name> \"Carol\" .', '<http://ex/d> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/P> .', '<http://ex/d> <http://ex/name> \"x\" .', '<http://ex/w> <http://ex/name> \"x\" .']) AS line",
    "ottr_rdf_templates": "SELECT '<http://ex/R/' || r_regionkey || unnest(['> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Area> .', '> <http://ex/name> \"' || r_name || '\" .', '> <http://ex/name> \"' || lower(r_name) || '\" .', '> <http://ex/kind> \"area\" .']) AS line FROM region",
    "update_delete_data_and_load": "SELECT 'http://ex/o_orderstatus' AS p, COUNT(*) AS n FROM orders UNION ALL SELECT unnest(['http://ex/p', 'http://ex/m']), 1",
    "update_orders": "SELECT 'http://ex/o_orderstatus' AS p, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'http://ex/done', COUNT(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'http://ex/o_orderpriority', COUNT(*) FROM orders UNION ALL SELECT 'http://ex/did', 1",
    "graph_store_protocol": outcome_sql(posted=10, default=25, there="True", gone="False"),
    "transactions": outcome_sql(quads=6, late="refused", failed="refused", unchanged="True"),
    "vqs_navigation_and_search": outcome_sql(outgoing=1, estimate_is_count="True", greedy=2, random=2, prefixes=3),
    "manchester_entailment": "SELECT 'http://ex/' || k AS k, n FROM (SELECT 'Place' AS k, COUNT(*) + 2 AS n FROM nation UNION ALL SELECT 'Area', COUNT(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'inRegion', COUNT(*) FROM customer UNION ALL SELECT 'near', 3)",
    "manchester_round_trip": "SELECT 'http://ex/nation/' || n_nationkey AS x, n_name AS n, 'http://ex/region/' || n_regionkey AS r FROM nation",
    "canonical_blank_nodes": "SELECT '_:c14n' || (row_number() OVER (ORDER BY sha256('_:a <http://ex/name> \"' || n_name || '\" .' || chr(10))) - 1) || ' <http://ex/name> \"' || n_name || '\" .' AS line FROM nation",
    "canonical_alike_nodes": outcome_sql(quads=5, alike="True", labels="True"),
    "provenance_index": "SELECT 0 AS rule, COUNT(*) AS derived, COUNT(*) AS uses FROM customer UNION ALL SELECT 1, COUNT(*), 2 * COUNT(*) FROM customer",
    "path_cycle": "SELECT 'http://ex/nation/' || n_nationkey AS x FROM nation WHERE n_nationkey < 7",
}

MADE = {
    "turtle_round_trip": _round_trip("ttl"),
    "trig_round_trip": _round_trip("trig"),
    "jsonld_round_trip": _round_trip("jsonld"),
    "nquads_named_graphs": _named_round_trip("nq"),
    "trig_named_graphs": _named_round_trip("trig"),
    "jsonld_named_graphs": _named_round_trip("jsonld"),
    "rml_csv_source": _rml_file("csv", "CSV", ""),
    "rml_json_source": _rml_file("json", "JSONPath", "$"),
    "rml_xml_source": _rml_file("xml", "XPath", "/all/land"),
}


def queries():
    out = {k: MADE[k] if k in MADE else globals()[k] for k in SQL}
    return {k: _runner(q) for k, (q, _) in SPARQL.items()} | out | {k: _shacl(shape, tables) for k, (shape, tables, _) in SHACL.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in SPARQL.items()} | SQL | {k: sql for k, (_, _, sql) in SHACL.items()}
