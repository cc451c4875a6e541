"""Result formats: SPARQL JSON, XML, CSV and TSV of a query's N-Triples output, line by line."""

from pyspark.sql import functions as F

from ..functions.terms import BNODE, LIT, STRING
from .rdf import parse_term


def _quote(x):
    """JSON string of a column."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def json_bindings(df):
    """A JSON binding object per row of an output="terms" result; unbound variables are left out."""
    cells = []
    for c in df.columns:
        t = parse_term(F.col(c))
        kind = F.when(t["kind"] == LIT, "literal").when(t["kind"] == BNODE, "bnode").otherwise("uri")
        more = F.when(t["lang"] != "", F.concat(F.lit(',"xml:lang":'), _quote(t["lang"]))).when((t["dt"] != "") & (t["dt"] != STRING), F.concat(F.lit(',"datatype":'), _quote(t["dt"]))).otherwise("")
        cells.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}":{{"type":"'), kind, F.lit('","value":'), _quote(t["lex"]), more, F.lit("}"))))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def sparql_json(df):
    """The whole result document as text; for results that fit the driver."""
    rows = ",".join(r.value for r in json_bindings(df).toLocalIterator())
    head = ",".join(f'"{c}"' for c in df.columns)
    return f'{{"head":{{"vars":[{head}]}},"results":{{"bindings":[{rows}]}}}}'


def ask_json(value):
    return f'{{"head":{{}},"boolean":{"true" if value else "false"}}}'


def _xml(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_rows(df):
    """A <result> element per row."""
    cells = []
    for c in df.columns:
        t = parse_term(F.col(c))
        attr = F.when(t["lang"] != "", F.concat(F.lit(' xml:lang="'), t["lang"], F.lit('"'))).when((t["dt"] != "") & (t["dt"] != STRING), F.concat(F.lit(' datatype="'), _xml(t["dt"]), F.lit('"'))).otherwise("")
        body = F.when(t["kind"] == LIT, F.concat(F.lit("<literal"), attr, F.lit(">"), _xml(t["lex"]), F.lit("</literal>"))).when(t["kind"] == BNODE, F.concat(F.lit("<bnode>"), t["lex"], F.lit("</bnode>"))).otherwise(F.concat(F.lit("<uri>"), _xml(t["lex"]), F.lit("</uri>")))
        cells.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<binding name="{c}">'), body, F.lit("</binding>"))))
    return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *cells), F.lit("</result>")).alias("value"))


def sparql_xml(df):
    rows = "".join(r.value for r in xml_rows(df).toLocalIterator())
    head = "".join(f'<variable name="{c}"/>' for c in df.columns)
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>{rows}</results></sparql>'


def ask_xml(value):
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{"true" if value else "false"}</boolean></sparql>'


def headed(lines, text):
    """Lines after a header line."""
    return lines.sparkSession.createDataFrame([(text,)], "value string").unionAll(lines)


def csv_lines(df, header=False):
    """CSV rows of an output="terms" result: plain values, quoted where needed; the header, where wanted, names the columns."""
    def cell(c):
        t = parse_term(F.col(c))
        v = F.when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"])).otherwise(t["lex"])
        return F.coalesce(F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v), F.lit(""))

    lines = df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value"))
    return headed(lines, ",".join(df.columns)) if header else lines


def tsv_lines(df, header=False):
    """TSV rows: the terms themselves."""
    lines = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns]).alias("value"))
    return headed(lines, "\t".join("?" + c for c in df.columns)) if header else lines


def table_text(df, rows=20):
    """The first rows as a text table."""
    return df._jdf.showString(rows, 80, False)
