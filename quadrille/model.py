"""The quad relation, its vocabulary, and column expressions over terms.

One flat row per statement: s, s_kind, p, o, o_kind, o_lang, o_dt, g, g_kind.  Kinds: 0 IRI, 1 blank
node, 2 literal.  A null ``g`` is the default graph.  Flat string columns keep predicates visible to
Parquet and keys cheap to hash; everything here is a Catalyst expression, no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IRI, BNODE, LITERAL = 0, 1, 2
QUAD = ["s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt", "g", "g_kind"]
SCHEMA = "s string, s_kind tinyint, p string, o string, o_kind tinyint, o_lang string, o_dt string, g string, g_kind tinyint"
TRIPLE = QUAD[:7]
NIL = "http://www.openrdf.org/schema/sesame#nil"

#: Namespaces of the shared vocabularies.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "sesame": "http://www.openrdf.org/schema/sesame#",
    "void": "http://rdfs.org/ns/void#",
    "dct": "http://purl.org/dc/terms/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "schema": "http://schema.org/",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "gn": "http://www.geonames.org/ontology#",
    "prov": "http://www.w3.org/ns/prov#",
    "fn": "http://www.w3.org/2005/xpath-functions#",
}


class Vocabulary:
    """Shared terms written out in full or, as some datasets keep them, in short form."""

    def __init__(self, short: bool = False):
        self.short = short

    def __call__(self, name: str) -> str:
        if self.short or ":" not in name:
            return name
        prefix, local = name.split(":", 1)
        return NAMESPACES[prefix] + local if prefix in NAMESPACES else name


FULL, SHORT = Vocabulary(), Vocabulary(short=True)

#: Classes whose instances, and properties whose statements, make up the schema (TBox).
TBOX_CLASSES = (
    "rdfs:Class rdfs:Datatype rdf:Property owl:AllDisjointClasses owl:AllDisjointProperties owl:AnnotationProperty owl:AsymmetricProperty owl:Class owl:DatatypeProperty "
    "owl:FunctionalProperty owl:InverseFunctionalProperty owl:IrreflexiveProperty owl:ObjectProperty owl:Ontology owl:ReflexiveProperty owl:Restriction owl:SymmetricProperty owl:TransitiveProperty"
).split()
TBOX_PROPERTIES = (
    "rdf:first rdf:rest rdfs:domain rdfs:range rdfs:subClassOf rdfs:subPropertyOf owl:allValuesFrom owl:cardinality owl:complementOf owl:datatypeComplementOf owl:disjointUnionOf owl:disjointWith "
    "owl:equivalentClass owl:equivalentProperty owl:hasKey owl:hasSelf owl:hasValue owl:imports owl:intersectionOf owl:inverseOf owl:maxCardinality owl:maxQualifiedCardinality owl:members owl:minCardinality "
    "owl:minQualifiedCardinality owl:onClass owl:onDataRange owl:onDataType owl:onProperties owl:onProperty owl:oneOf owl:propertyChainAxiom owl:propertyDisjointWith owl:qualifiedCardinality owl:someValuesFrom "
    "owl:unionOf owl:versionIRI owl:withRestrictions"
).split()


def quads(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A small relation from (s, p, o[, g]) in N-Triples-like text, or from full rows."""
    return spark.createDataFrame([r if len(r) == 9 else quad(*r) for r in rows], SCHEMA)


def quad(s: str, p: str, o: str, g: str | None = None) -> tuple:
    """A row from terms: ``_:x`` blank node, ``"v"``, ``"v"@lang`` or ``"v"^^dt`` literal, else IRI."""
    kind = lambda t: BNODE if t.startswith("_:") else IRI
    lang = dt = None
    if o.startswith('"'):
        label, _, tail = o[1:].rpartition('"')
        lang = tail[1:] if tail.startswith("@") else None
        dt = tail[2:] if tail.startswith("^^") else None
        return (s, kind(s), p, label, LITERAL, lang, dt, g, None if g is None else kind(g))
    return (s, kind(s), p, o, kind(o), None, None, g, None if g is None else kind(g))


def as_quads(df: DataFrame) -> DataFrame:
    """The nine columns, whatever else ``df`` has."""
    return df.select(*QUAD)


def bag_union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [as_quads(f) for f in frames])


def nothing(df: DataFrame) -> DataFrame:
    """NIL: no statement, same schema."""
    return as_quads(df).where(F.lit(False))


def valid(df: DataFrame) -> DataFrame:
    """Statements in which every term is of a kind its place allows; others are dropped, not errors."""
    return df.where((F.col("s_kind") < LITERAL) & (F.col("o_kind") <= LITERAL) & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & F.coalesce(F.col("g_kind") < LITERAL, F.lit(True)))


# -- column expressions --------------------------------------------------------------------------


def namespace(c: Column) -> Column:
    """The IRI up to and including its last '#', else its last '/', else its last ':'."""
    return F.regexp_extract(c, r"(?s)^(.*#|[^#]*/|[^#/]*:)", 1)


def local_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^(.*#|[^#]*/|[^#/]*:)", "")


def is_iri(kind: Column) -> Column:
    return kind == IRI


def format_term(value: Column, kind: Column, lang: Column | None = None, dt: Column | None = None) -> Column:
    """N-Quads text of a term, escaped."""
    lit = lambda: F.concat(F.lit('"'), escape_literal(value), F.lit('"'))
    iri = F.concat(F.lit("<"), escape_iri(value), F.lit(">"))
    if lang is None:
        return F.when(kind == IRI, iri).when(kind == BNODE, value)
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull(), F.concat(F.lit("^^<"), escape_iri(dt), F.lit(">"))).otherwise("")
    return F.when(kind == IRI, iri).when(kind == BNODE, value).otherwise(F.concat(lit(), tail))


def escape_literal(c: Column) -> Column:
    out = c
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def escape_iri(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\>"))
    for code in (0, 9, 10, 13):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return out


def quad_line(nil: str = NIL) -> Column:
    """The statement as a line of TQL/N-Quads."""
    return F.concat_ws(
        " ", format_term(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), escape_iri(F.col("p")), F.lit(">")),
        format_term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dt")), F.when(F.col("g").isNotNull(), format_term(F.col("g"), F.col("g_kind"))), F.lit("."),
    )


def term_rank(value: Column, kind: Column, ranked: Sequence[str] = (), prefixes: dict[str, str] | None = None) -> list[Column]:
    """Sort keys of the term order: IRIs (by rank of their namespace, then text with known
    namespaces shortened), blank nodes, literals."""
    ns = namespace(value)
    rank = F.lit(len(ranked))
    for i, n in reversed(list(enumerate(ranked))):
        rank = F.when(value.startswith(n), i).otherwise(rank)
    text = value
    for prefix, uri in (prefixes or {}).items():
        text = F.when(ns == uri, F.concat(F.lit(prefix + ":"), local_name(value))).otherwise(text)
    return [kind, F.when(kind == IRI, rank).otherwise(0), F.when(kind == IRI, text).otherwise(value)]
