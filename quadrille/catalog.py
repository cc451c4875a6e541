"""The registered queries of the engine, each with the DuckDB SQL that gives the same rows."""

from .engine import Engine, tables_source

#: name: (query, SQL)
SPARQL = {
    "bgp_star_lineitem": (
        "SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (COUNT(*) AS ?n) WHERE { ?l a :LineItem ; :l_returnflag ?flag ; :l_linestatus ?status ; :l_quantity ?q } GROUP BY ?flag ?status",
        "SELECT l_returnflag AS flag, l_linestatus AS status, SUM(l_quantity) AS sum_qty, COUNT(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "bgp_filter_revenue": (
        "SELECT (ROUND(SUM(?p * ?d) * 100) / 100 AS ?revenue) WHERE { ?l :l_extendedprice ?p ; :l_discount ?d ; :l_quantity ?q ; :l_shipdate ?s FILTER(?s >= '1997-01-01T00:00:00'^^xsd:dateTime && ?s < '2021-01-01T00:00:00'^^xsd:dateTime && ?q < 24) }",
        "SELECT floor(SUM(l_extendedprice * l_discount) * 100 + 0.5) / 100 AS revenue FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '2021-01-01' AND l_quantity < 24",
    ),
    "join_chain_orders_customer_nation": (
        "SELECT ?name (COUNT(?o) AS ?n) (ROUND(SUM(?p)) AS ?total) WHERE { ?o :o_customer ?c ; :o_totalprice ?p . ?c :c_nation ?k . ?k :n_name ?name } GROUP BY ?name",
        "SELECT n_name AS name, COUNT(*) AS n, floor(SUM(o_totalprice) + 0.5) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "join_multicolumn": (
        "SELECT ?c ?s WHERE { ?c :c_nation ?n ; :c_custkey ?k . ?s :s_nation ?n ; :s_suppkey ?k }",
        "SELECT 'http://ex/customer/' || c_custkey AS c, 'http://ex/supplier/' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey",
    ),
    "join_theta_filter": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?a :n_regionkey ?r ; :n_nationkey ?x . ?b :n_regionkey ?r ; :n_nationkey ?y FILTER(?x < ?y) }",
        "SELECT COUNT(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "join_cartesian_small": (
        "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b }",
        "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b",
    ),
    "optional_customer_orders": (
        "SELECT ?k (COUNT(?o) AS ?n) WHERE { ?c :c_custkey ?k OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?p FILTER(?p > 200000) } } GROUP BY ?k",
        "SELECT c_custkey AS k, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1",
    ),
    "optional_outer_filter_variable": (
        "SELECT ?k ?p WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?p FILTER(?p > ?b * 40) } }",
        "SELECT c_custkey AS k, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40",
    ),
    "minus_customers_without_big_orders": (
        "SELECT ?k WHERE { ?c :c_custkey ?k MINUS { ?o :o_customer ?c ; :o_totalprice ?p FILTER(?p > 150000) } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    ),
    "minus_disjoint_noop": (
        "SELECT ?n WHERE { ?x :n_name ?n MINUS { ?y :r_name ?m } }",
        "SELECT n_name AS n FROM nation",
    ),
    "exists_open_orders": (
        "SELECT ?k WHERE { ?c :c_custkey ?k FILTER EXISTS { ?o :o_customer ?c ; :o_orderstatus 'O' } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    ),
    "not_exists_correlated_filter": (
        "SELECT ?k WHERE { ?s :s_suppkey ?k ; :s_nationkey ?n ; :s_acctbal ?b FILTER NOT EXISTS { ?t :s_nationkey ?n ; :s_acctbal ?b2 FILTER(?b2 > ?b) } }",
        "SELECT s_suppkey AS k FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > s.s_acctbal)",
    ),
    "exists_in_disjunction": (
        "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :o_customer ?c ; :o_orderpriority '1-URGENT' }) }",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "union_customer_supplier": (
        "SELECT ?x ?b WHERE { { ?x :c_acctbal ?b } UNION { ?x :s_acctbal ?b } }",
        "SELECT 'http://ex/customer/' || c_custkey AS x, c_acctbal AS b FROM customer UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, s_acctbal FROM supplier",
    ),
    "union_three_arms_constrained": (
        "SELECT ?n (COUNT(?x) AS ?c) WHERE { { ?x :c_nation ?k } UNION { ?x :s_nation ?k } UNION { ?x :c_nation ?k ; :c_mktsegment 'BUILDING' } ?k :n_name ?n } GROUP BY ?n",
        "SELECT n_name AS n, COUNT(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') u JOIN nation ON k = n_nationkey GROUP BY 1",
    ),
    "values_undef_join": (
        "SELECT ?k ?s ?t WHERE { VALUES (?s ?t) { ('BUILDING' 1) (UNDEF 2) ('MACHINERY' UNDEF) } ?c :c_custkey ?k ; :c_mktsegment ?s ; :c_nationkey ?t }",
        "SELECT c_custkey AS k, c_mktsegment AS s, c_nationkey AS t FROM customer JOIN (VALUES ('BUILDING', 1), (NULL, 2), ('MACHINERY', NULL)) v(a, b) ON (a IS NULL OR a = c_mktsegment) AND (b IS NULL OR b = c_nationkey)",
    ),
    "bind_arithmetic": (
        "SELECT ?k ?v WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p BIND(ROUND(?p / 3 + 1) * 2 AS ?v) }",
        "SELECT o_orderkey AS k, floor(o_totalprice / 3 + 1 + 0.5) * 2 AS v FROM orders",
    ),
    "group_count": (
        "SELECT ?t (COUNT(*) AS ?n) WHERE { ?e :event_type ?t } GROUP BY ?t",
        "SELECT event_type AS t, COUNT(*) AS n FROM events GROUP BY 1",
    ),
    "group_alias_expression": (
        "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "having_sum": (
        "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_custkey ?c ; :o_totalprice ?p } GROUP BY ?c HAVING(COUNT(?o) > 12 && MAX(?p) > 300000)",
        "SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 300000",
    ),
    "implicit_aggregates": (
        "SELECT (SUM(?q) AS ?s) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (ROUND(AVG(?p) * 100) / 100 AS ?mean) (COUNT(?p) AS ?n) WHERE { ?l :l_quantity ?q ; :l_extendedprice ?p }",
        "SELECT SUM(l_quantity) AS s, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, floor(AVG(l_extendedprice) * 100 + 0.5) / 100 AS mean, COUNT(*) AS n FROM lineitem",
    ),
    "implicit_group_empty_input": (
        "SELECT (COUNT(?p) AS ?n) (SUM(?p) AS ?s) WHERE { ?l :p_retailprice ?p FILTER(?p < 0) }",
        "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s",
    ),
    "group_concat_names": (
        "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x :n_region/:r_name ?r ; :n_name ?n } GROUP BY ?r",
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "count_distinct": (
        "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_customer ?c } GROUP BY ?s",
        "SELECT o_orderstatus AS s, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    ),
    "sum_distinct_arithmetic": (
        "SELECT ?r (SUM(DISTINCT ?k) + COUNT(*) AS ?v) WHERE { ?n :n_regionkey ?r ; :n_nationkey ?k } GROUP BY ?r",
        "SELECT n_regionkey AS r, (SUM(DISTINCT n_nationkey) + COUNT(*))::BIGINT AS v FROM nation GROUP BY 1",
    ),
    "sample_of_single": (
        "SELECT ?k (SAMPLE(?n) AS ?name) WHERE { ?x :n_nationkey ?k ; :n_name ?n } GROUP BY ?k",
        "SELECT n_nationkey AS k, n_name AS name FROM nation",
    ),
    "subquery_max_per_group": (
        "SELECT ?seg ?k WHERE { ?c :c_mktsegment ?seg ; :c_acctbal ?m ; :c_custkey ?k { SELECT ?seg (MAX(?b) AS ?m) WHERE { ?d :c_mktsegment ?seg ; :c_acctbal ?b } GROUP BY ?seg } }",
        "SELECT c_mktsegment AS seg, c_custkey AS k FROM customer WHERE c_acctbal = (SELECT MAX(c_acctbal) FROM customer d WHERE d.c_mktsegment = customer.c_mktsegment)",
    ),
    "nested_aggregate": (
        "SELECT (MAX(?n) AS ?most) WHERE { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c } GROUP BY ?c }",
        "SELECT MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey)",
    ),
    "order_limit_offset_topk": (
        "SELECT ?k ?p WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 5",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    ),
    "order_by_expression_hidden": (
        "SELECT ?n WHERE { ?x :n_name ?n ; :n_nationkey ?k } ORDER BY DESC(?k * 2) LIMIT 7",
        "SELECT n_name AS n FROM nation ORDER BY n_nationkey DESC LIMIT 7",
    ),
    "select_distinct": (
        "SELECT DISTINCT ?b ?t WHERE { ?p :p_brand ?b ; :p_type ?t }",
        "SELECT DISTINCT p_brand AS b, p_type AS t FROM part",
    ),
    "select_star": (
        "SELECT * WHERE { ?x :r_name ?name ; :r_regionkey ?key }",
        "SELECT 'http://ex/region/' || r_regionkey AS x, r_name AS name, r_regionkey AS key FROM region",
    ),
    "ask_exists": ("ASK { ?o :o_orderstatus 'F' ; :o_totalprice ?p FILTER(?p > 1000) }", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000) AS ask"),
    "construct_triples": (
        "CONSTRUCT { ?c :livesIn ?n . ?n :name ?name } WHERE { ?c :c_nation ?n . ?n :n_name ?name }",
        "SELECT '<http://ex/customer/' || c_custkey || '>' AS s, '<http://ex/livesIn>' AS p, '<http://ex/nation/' || c_nationkey || '>' AS o FROM customer UNION SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://ex/name>', '\"' || n_name || '\"' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    ),
    "describe_resource": (
        "DESCRIBE <http://ex/region/2>",
        "SELECT '<http://ex/region/2>' AS s, '<http://ex/r_name>' AS p, '\"' || r_name || '\"' AS o FROM region WHERE r_regionkey = 2 UNION ALL SELECT '<http://ex/region/2>', '<http://ex/r_regionkey>', '\"2\"^^<http://www.w3.org/2001/XMLSchema#integer>' UNION ALL SELECT '<http://ex/region/2>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex/Region>'",
    ),
    "variable_predicate_statistics": (
        "SELECT ?p (COUNT(*) AS ?n) (COUNT(DISTINCT ?s) AS ?subjects) WHERE { ?s a :Supplier ; ?p ?o } GROUP BY ?p",
        "SELECT p, COUNT(*) AS n, COUNT(DISTINCT k) AS subjects FROM (SELECT s_suppkey AS k, unnest(['http://ex/s_suppkey', 'http://ex/s_name', 'http://ex/s_nationkey', 'http://ex/s_acctbal', 'http://ex/s_nation', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM supplier) GROUP BY 1",
    ),
    "class_statistics": (
        "SELECT ?c (COUNT(?s) AS ?n) WHERE { ?s a ?c } GROUP BY ?c",
        "SELECT 'http://ex/Region' AS c, COUNT(*) AS n FROM region UNION ALL SELECT 'http://ex/Nation', COUNT(*) FROM nation UNION ALL SELECT 'http://ex/Customer', COUNT(*) FROM customer UNION ALL SELECT 'http://ex/Supplier', COUNT(*) FROM supplier UNION ALL SELECT 'http://ex/Part', COUNT(*) FROM part UNION ALL SELECT 'http://ex/Order', COUNT(*) FROM orders UNION ALL SELECT 'http://ex/LineItem', COUNT(*) FROM lineitem UNION ALL SELECT 'http://ex/Event', COUNT(*) FROM events UNION ALL SELECT 'http://ex/Document', COUNT(*) FROM documents UNION ALL SELECT 'http://ex/Label', COUNT(*) FROM labels UNION ALL SELECT 'http://ex/Turn', COUNT(*) FROM conversations",
    ),
    # functions
    "fn_string_tests": (
        "SELECT ?k WHERE { ?p :p_partkey ?k ; :p_name ?n ; :p_brand ?b FILTER(STRSTARTS(?b, 'Brand#1') && CONTAINS(?n, 'a') && !STRENDS(?n, 'z')) }",
        "SELECT p_partkey AS k FROM part WHERE starts_with(p_brand, 'Brand#1') AND contains(p_name, 'a') AND NOT ends_with(p_name, 'z')",
    ),
    "fn_strlen_case": (
        "SELECT ?k (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) WHERE { ?c :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, length(c_name) AS len, upper(c_name) AS up, lower(c_name) AS low FROM customer",
    ),
    "fn_substr_concat": (
        "SELECT ?k (CONCAT(SUBSTR(?n, 3, 4), '-', SUBSTR(?n, 10)) AS ?v) WHERE { ?c :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, substring(c_name, 3, 4) || '-' || substring(c_name, 10) AS v FROM customer",
    ),
    "fn_strbefore_strafter": (
        "SELECT ?k (STRBEFORE(?n, '#') AS ?a) (STRAFTER(?n, '#') AS ?b) (STRAFTER(?n, '~') AS ?none) WHERE { ?c :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS none FROM customer",
    ),
    "fn_regex_replace": (
        "SELECT ?k (REPLACE(?n, '[0-9]+', 'N') AS ?v) WHERE { ?c :c_custkey ?k ; :c_name ?n FILTER REGEX(?n, 'customer#0+1', 'i') }",
        "SELECT c_custkey AS k, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS v FROM customer WHERE regexp_matches(c_name, 'customer#0+1', 'i')",
    ),
    "fn_regex_prefix": ("SELECT (COUNT(*) AS ?n) WHERE { ?p :p_type ?t FILTER REGEX(?t, '^S') }", "SELECT COUNT(*) AS n FROM part WHERE starts_with(p_type, 'S')"),
    "fn_hashes": (
        "SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s2) WHERE { ?x :n_nationkey ?k ; :n_name ?n }",
        "SELECT n_nationkey AS k, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation",
    ),
    "fn_encode_for_uri": (
        "SELECT ?k (ENCODE_FOR_URI(?n) AS ?v) WHERE { ?c :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, url_encode(c_name) AS v FROM customer",
    ),
    "fn_date_parts": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) WHERE { ?e :event_id ?k ; :ts ?d }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi FROM events",
    ),
    "fn_numeric": (
        "SELECT ?k (ABS(-?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(-?b) AS ?r) WHERE { ?s :s_suppkey ?k ; :s_acctbal ?b }",
        "SELECT s_suppkey AS k, abs(-s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(-s_acctbal + 0.5) AS r FROM supplier",
    ),
    "fn_if_coalesce": (
        "SELECT ?k (IF(?b > 5000, 'rich', 'poor') AS ?v) (COALESCE(?none, ?seg) AS ?w) WHERE { ?c :c_custkey ?k ; :c_acctbal ?b ; :c_mktsegment ?seg }",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS v, c_mktsegment AS w FROM customer",
    ),
    "fn_in_not_in": (
        "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_mktsegment ?s ; :c_nationkey ?n FILTER(?s IN ('BUILDING', 'FURNITURE') && ?n NOT IN (1, 2, 3)) }",
        "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)",
    ),
    "fn_terms": (
        "SELECT ?k (STR(?n) AS ?s) (DATATYPE(?k) AS ?dt) (isIRI(?n) AS ?i) (isLiteral(?k) AS ?l) (isNumeric(?k) AS ?num) (LANG(?name) AS ?lang) (sameTerm(?n, ?n) AS ?same) WHERE { ?n :n_nationkey ?k ; :n_name ?name }",
        "SELECT n_nationkey AS k, 'http://ex/nation/' || n_nationkey AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, true AS i, true AS l, true AS num, '' AS lang, true AS same FROM nation",
    ),
    "fn_strlang_langmatches": (
        "SELECT ?k WHERE { ?d :doc_id ?k ; :lang ?l FILTER LANGMATCHES(?l, 'en') }",
        "SELECT doc_id AS k FROM documents WHERE lower(lang) = 'en' OR lower(lang) LIKE 'en-%'",
    ),
    "cast_types": (
        "SELECT ?k (xsd:integer(?b) AS ?i) (xsd:double(?k) AS ?d) (xsd:string(?k) AS ?s) (xsd:boolean(?k) AS ?t) (xsd:integer(SUBSTR(?n, 10)) AS ?x) WHERE { ?c :c_custkey ?k ; :c_acctbal ?b ; :c_name ?n }",
        "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, c_custkey::DOUBLE AS d, c_custkey::VARCHAR AS s, c_custkey <> 0 AS t, substring(c_name, 10)::BIGINT AS x FROM customer",
    ),
    "error_semantics": (
        "SELECT ?k (xsd:integer(?n) AS ?bad) (1 / (?k - ?k) AS ?div) WHERE { ?x :n_nationkey ?k ; :n_name ?n FILTER(xsd:integer(?n) > 1 || ?k < 5) }",
        "SELECT n_nationkey AS k, NULL::BIGINT AS bad, NULL::DECIMAL(38,6) AS div FROM nation WHERE n_nationkey < 5",
    ),
    # paths
    "path_sequence": (
        "SELECT ?k ?r WHERE { ?c :c_custkey ?k ; :c_nation/:n_region/:r_name ?r }",
        "SELECT c_custkey AS k, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "path_alternative_inverse": (
        "SELECT ?n (COUNT(?x) AS ?c) WHERE { ?k :n_name ?n ; ^(:c_nation|:s_nation) ?x } GROUP BY ?n",
        "SELECT n_name AS n, COUNT(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1",
    ),
    "path_plus": (
        "SELECT ?x ?y WHERE { ?x (:c_nation|:n_region)+ ?y . ?x a :Customer }",
        "SELECT 'http://ex/customer/' || c_custkey AS x, 'http://ex/nation/' || c_nationkey AS y FROM customer UNION ALL SELECT 'http://ex/customer/' || c_custkey, 'http://ex/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "path_star_from_constant": (
        "SELECT ?y WHERE { <http://ex/customer/7> (:c_nation|:n_region)* ?y }",
        "SELECT 'http://ex/customer/7' AS y UNION ALL SELECT 'http://ex/nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'http://ex/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7",
    ),
    "path_star_to_constant": (
        "SELECT (COUNT(?x) AS ?n) WHERE { ?x (:c_nation|:n_region)+ <http://ex/region/1> }",
        "SELECT (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) + (SELECT COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) AS n",
    ),
    "path_repeat": (
        "SELECT ?x ?y WHERE { ?x (:s_nation|:n_region){1,2} ?y . ?x a :Supplier }",
        "SELECT 'http://ex/supplier/' || s_suppkey AS x, 'http://ex/nation/' || s_nationkey AS y FROM supplier UNION ALL SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "path_optional": (
        "SELECT ?y WHERE { <http://ex/nation/4> :n_region? ?y }",
        "SELECT 'http://ex/nation/4' AS y UNION ALL SELECT 'http://ex/region/' || n_regionkey FROM nation WHERE n_nationkey = 4",
    ),
    "path_negated_set": (
        "SELECT ?o WHERE { <http://ex/region/3> !(a|:r_regionkey) ?o }",
        "SELECT r_name AS o FROM region WHERE r_regionkey = 3",
    ),
}


def _runner(text):
    return lambda spark, sf_dir: Engine(tables_source(spark, sf_dir)).sparql(text)


def queries():
    return {k: _runner(q) for k, (q, _) in SPARQL.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in SPARQL.items()}
