"""How a query variable sits in a DataFrame, and values over such columns.

A `Rep` is the static knowledge about a variable: an IRI built from a template and key columns, a literal of one
datatype in a native column, a whole term struct, or a dictionary id.  A null (first) column means unbound.  Joins of
equal Reps compare native columns; different Reps meet in the narrowest common form, or are known to be disjoint.
"""

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import functions as F

from .names import RDF, XSD

IRI, BNODE, LIT, TRIPLE = 1, 2, 3, 4
TERM = "struct<kind:int,lex:string,dt:string,lang:string>"
INTEGERS = {XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")}
RANKS = dict.fromkeys(INTEGERS, 1) | {XSD + "decimal": 2, XSD + "float": 3, XSD + "double": 4}
STRING, BOOLEAN, DATETIME, DATE = XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date"
BY_SPARK = {"bigint": XSD + "integer", "int": XSD + "integer", "smallint": XSD + "integer", "tinyint": XSD + "integer", "double": XSD + "double", "float": XSD + "float", "string": STRING, "boolean": BOOLEAN, "timestamp": DATETIME, "timestamp_ntz": DATETIME, "date": DATE}


@dataclass(frozen=True)
class Rep:
    """kind is iri, lit, term or id; template has a {} for each key column (None: one column with the whole IRI)."""

    kind: str
    template: str | None = None
    dt: str | None = None
    lang: str | None = None

    @property
    def width(self):
        return self.template.count("{}") if self.kind == "iri" and self.template is not None else 1


ANY, ID, WHOLE = Rep("term"), Rep("id"), Rep("iri")


def literal(dt, lang=None):
    return Rep("lit", None, dt, lang)


def spark_dt(kind):
    """Datatype IRI of a Spark column type name."""
    return XSD + "decimal" if kind.startswith("decimal") else BY_SPARK.get(kind, STRING)


def term(kind, lex, dt=None, lang=None):
    none = F.lit("")
    return F.struct(F.lit(kind).cast("int").alias("kind"), lex.cast("string").alias("lex"), (dt if dt is not None else none).alias("dt"), (lang if lang is not None else none).alias("lang"))


def lexical(col, dt):
    """Lexical form of a native column."""
    if dt == DATETIME:
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return col.cast("string")


class Val:
    """A value expression: a Rep and its columns, with whatever form is asked for derived from them."""

    def __init__(self, rep, *cols):
        self.rep, self.cols = rep, cols

    # constructors
    @staticmethod
    def const(t):
        kind = t[0]
        if kind == "iri":
            return Val(WHOLE, F.lit(t[1]))
        if kind == "lit":
            _, lex, dt, lang = t
            native = {1: "decimal(38,0)", 2: "decimal(38,18)", 3: "double", 4: "double"}.get(RANKS.get(dt), "boolean" if dt == BOOLEAN else None)
            if RANKS.get(dt) == 1 and re.fullmatch(r"[+-]?\d{1,18}", lex):
                return Val(literal(dt), F.lit(int(lex)).cast("bigint"))
            if native and RANKS.get(dt) != 1:
                return Val(literal(dt), F.lit(lex).try_cast(native))
            if dt == DATETIME and re.fullmatch(r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?", lex):
                return Val(literal(dt), F.lit(lex).cast("timestamp_ntz"))
            if dt == DATE and re.fullmatch(r"\d{4}-\d\d-\d\d", lex):
                return Val(literal(dt), F.lit(lex).cast("date"))
            return Val(literal(dt, lang), F.lit(lex))
        if kind == "triple":
            return Val(ANY, term(TRIPLE, F.concat_ws(" ", F.lit("<<("), *[Val.const(x).nt() for x in t[1:]], F.lit(")>>"))))
        raise ValueError(f"not a constant: {t!r}")

    @staticmethod
    def string(col):
        return Val(literal(STRING), col)

    @staticmethod
    def boolean(col):
        return Val(literal(BOOLEAN), col)

    @staticmethod
    def integer(col):
        return Val(literal(XSD + "integer"), col.cast("bigint"))

    @property
    def col(self):
        return self.cols[0]

    @property
    def rank(self):
        """Static numeric rank, 0 for a known non-number, None where only the row knows."""
        return None if self.rep.kind in ("term", "id") else RANKS.get(self.rep.dt, 0)

    def bound(self):
        return self.col.isNotNull()

    def iri(self):
        """The whole IRI of a static IRI."""
        if self.rep.template is None:
            return self.col
        pieces = self.rep.template.split("{}")
        out = [F.lit(pieces[0])]
        for c, rest in zip(self.cols, pieces[1:]):
            out += [encode(c), F.lit(rest)]
        return F.concat(*out)

    def term(self):
        r = self.rep
        if r.kind == "term":
            return self.col
        if r.kind == "iri":
            t = term(IRI, self.iri())
        elif r.kind == "lit":
            t = term(LIT, lexical(self.col, r.dt), F.lit(r.dt), F.lit(r.lang or ""))
        else:
            raise TypeError("an id must be decoded first")
        return F.when(self.bound(), t)

    def id(self):
        return self.col if self.rep.kind == "id" else term_id(self.term())

    def kind(self):
        k = self.rep.kind
        return self.col["kind"] if k == "term" else F.when(self.bound(), F.lit(IRI if k == "iri" else LIT))

    def lex(self):
        k = self.rep.kind
        return self.col["lex"] if k == "term" else self.iri() if k == "iri" else lexical(self.col, self.rep.dt)

    def dt(self):
        return self.col["dt"] if self.rep.kind == "term" else F.when(self.bound(), F.lit(self.rep.dt or ""))

    def lang(self):
        return self.col["lang"] if self.rep.kind == "term" else F.when(self.bound(), F.lit(self.rep.lang or ""))

    def ranks(self):
        """Numeric rank as a column; null for non-numbers."""
        if self.rank is not None:
            return F.lit(self.rank or None).cast("int")
        d = self.dt()
        return F.when(d == XSD + "integer", 1).when(d == XSD + "double", 4).when(d == XSD + "decimal", 2).when(d == XSD + "float", 3).when(d.isin(sorted(INTEGERS)), 1)

    def number(self):
        """Numeric value; a native column where the type is static, else a double, null for non-numbers."""
        if self.rank == 0:
            return F.lit(None).cast("double")
        if self.rank:
            return self.col
        x = F.when(self.lex() == "INF", float("inf")).when(self.lex() == "-INF", float("-inf")).otherwise(self.lex().try_cast("double"))
        return F.when(self.ranks().isNotNull(), x)

    def text(self):
        """Lexical form of a string literal (plain, tagged or xsd:string), else null."""
        if self.rep.kind == "lit":
            return self.col if self.rep.dt in (STRING, RDF + "langString") else F.lit(None).cast("string")
        if self.rep.kind == "iri":
            return F.lit(None).cast("string")
        return F.when((self.kind() == LIT) & self.dt().isin(STRING, RDF + "langString"), self.lex())

    def same_tag(self, col):
        """A string with this value's tag."""
        if self.rep.kind == "term":
            return Val(ANY, F.when(col.isNotNull(), term(LIT, col, self.dt(), self.lang())))
        return Val(self.rep if self.rep.kind == "lit" else literal(STRING), col)

    def truth(self):
        """Effective boolean value; null is an error."""
        r = self.rep
        if r.kind == "lit":
            if r.dt == BOOLEAN:
                return self.col
            if self.rank:
                return (self.col != 0) & ~F.isnan(self.col.cast("double"))
            return F.length(self.col) > 0 if r.dt in (STRING, RDF + "langString") else F.lit(None).cast("boolean")
        if r.kind == "iri":
            return F.lit(None).cast("boolean")
        n = self.number()
        return F.when(self.dt() == BOOLEAN, self.lex().isin("true", "1")).when(self.ranks().isNotNull(), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(self.text().isNotNull(), F.length(self.lex()) > 0)

    def nt(self):
        """N-Triples form."""
        t = self.term()
        body = F.concat(F.lit('"'), escape(t["lex"]), F.lit('"'))
        return (
            F.when(t["kind"] == IRI, F.concat(F.lit("<"), t["lex"], F.lit(">")))
            .when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"]))
            .when(t["kind"] == TRIPLE, t["lex"])
            .when(t["lang"] != "", F.concat(body, F.lit("@"), t["lang"]))
            .when(t["dt"] == STRING, body)
            .when(t["kind"] == LIT, F.concat(body, F.lit("^^<"), t["dt"], F.lit(">")))
        )

    def native(self):
        """The plain value for a result table: native column, whole IRI, or lexical form."""
        return self.col if self.rep.kind == "lit" else self.lex()


def escape(col):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def encode(col):
    """A key value inside an IRI: percent-encoded but for unreserved characters."""
    s = col.cast("string")
    safe = s.rlike(r"^[A-Za-z0-9._~-]*$")
    return F.when(safe, s).otherwise(F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def term_id(t):
    """Stateless 64-bit id of a term struct."""
    return F.when(t.isNotNull(), F.xxhash64(t["kind"], t["lex"], t["dt"], t["lang"]))


def template_keys(template, iri):
    """Key texts of an IRI that fits the template, else None."""
    m = re.fullmatch("([^/]*)".join(re.escape(p) for p in template.split("{}")), iri)
    return None if not m else [unquote(x) for x in m.groups()]


def fill(template, values):
    out = template
    for v in values:
        out = out.replace("{}", quote(str(v), safe="~"), 1)
    return out


def disjoint(a, b):
    """True when no term can have both Reps."""
    kinds = {a.kind, b.kind}
    if kinds & {"term", "id"}:
        return False
    if len(kinds) == 2:
        return True
    if a.kind == "lit":
        return (a.dt, a.lang) != (b.dt, b.lang)
    if a.template is not None and b.template is not None and a.template != b.template:
        x, y = a.template.split("{}")[0], b.template.split("{}")[0]
        return not (x.startswith(y) or y.startswith(x))
    return False


def common(a, b):
    """The narrowest Rep that holds terms of both."""
    if a == b:
        return a
    if "id" in (a.kind, b.kind):
        return ID
    if a.kind == b.kind == "iri":
        return WHOLE
    return ANY


def convert(val, rep):
    """A Val in another Rep that can hold it."""
    if val.rep == rep:
        return val
    if rep.kind == "id":
        return Val(ID, val.id())
    if rep == WHOLE:
        return Val(WHOLE, val.iri())
    return Val(ANY, val.term())
