"""More queries with their DuckDB equivalents: contexts, sources, aggregates, paths, number functions, chains, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sparql
from quadrille.model import QUAD, SHORT, TRIPLE, as_quads, quad, quads
from quadrille.operators import setops, stats
from quadrille.queries.reference import _BRANCHES, _COUNTED, _FLAT, _FORMULAS, _SET_NAMES, ALL, D, PREFIXES, pipe, q
from quadrille.rules.engine import apply_rules
from quadrille.rules.rulesets import ruleset
from quadrille.sources import read_quads, write_quads
from quadrille.storage import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# -- set operators that tell contexts apart --------------------------------------------------------


def _in_contexts(op: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        branches = ["@transform '+p {}'".format(" ".join("d:" + x[len(D) :] if x.startswith(D) else x for x in ps)) for ps in _BRANCHES]
        return pipe(spark, sf_dir, "{ " + " , ".join(branches) + " }" + op)

    f.__name__ = f"setop_contexts_{_SET_NAMES[op]}"
    counted = _COUNTED.replace(_FLAT, ALL)
    query(counted + f"SELECT {ALL} FROM (SELECT {ALL}, unnest(generate_series(1, CAST({_FORMULAS[op]} AS BIGINT))) FROM m)")(f)


for _op in _FORMULAS:
    _in_contexts(_op)


# -- statistics by source --------------------------------------------------------------------------

_SOURCE = "x:source"
_LINKED = (
    f"WITH linked AS (SELECT {ALL} FROM quads UNION SELECT DISTINCT g, CAST(0 AS TINYINT), '{_SOURCE}', 'x:' || substr(md5(g), 1, 1), CAST(0 AS TINYINT), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::TINYINT "
    f"FROM quads WHERE g_kind = 0), u AS (SELECT NULL::VARCHAR source, * FROM linked UNION ALL SELECT l.o, k.* FROM linked k JOIN (SELECT DISTINCT s, o FROM linked WHERE p = '{_SOURCE}') l ON l.s = k.g) "
)


def _with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register and, for each graph, a statement that links it to one of sixteen sources."""
    data = q(spark, sf_dir)
    links = data.where("g_kind = 0").select(F.col("g").alias("s")).distinct().withColumn("o", F.concat(F.lit("x:"), F.substring(F.md5("s"), 1, 1)))
    zero, none = F.lit(0).cast("tinyint"), F.lit(None).cast("string")
    links = links.select("s", zero.alias("s_kind"), F.lit(_SOURCE).alias("p"), "o", zero.alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"), none.alias("g"), F.lit(None).cast("tinyint").alias("g_kind"))
    return setops.inject(data, links)


@query(
    _LINKED + "SELECT source, p AS property, count(*) triples, count(DISTINCT (s, s_kind)) distinct_subjects, count(DISTINCT s) FILTER (WHERE s_kind = 0) entities, "
    "count(DISTINCT (o, o_kind, o_lang, o_dt)) FILTER (WHERE NOT (p = 'rdf:type' AND o_kind = 0)) distinct_objects FROM u GROUP BY source, p"
)
def stats_properties_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property partitions of the whole and of each source its graphs are linked to."""
    return stats.property_stats(_with_links(spark, sf_dir), 0, _SOURCE, vocab=SHORT).select("source", "property", "triples", "distinct_subjects", "entities", "distinct_objects")


@query(
    _LINKED + ", ty AS (SELECT DISTINCT source, s, o AS class FROM u WHERE p = 'rdf:type' AND o_kind = 0) "
    "SELECT ty.source, class, count(DISTINCT u.o) FILTER (WHERE p = 'rdf:type' AND o_kind = 0) classes, count(DISTINCT p) FILTER (WHERE NOT (p = 'rdf:type' AND o_kind = 0)) properties "
    "FROM ty JOIN u ON u.s = ty.s AND u.source IS NOT DISTINCT FROM ty.source GROUP BY ALL"
)
def stats_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct types and properties of the members of each class, by source."""
    return stats.cooccurrence(_with_links(spark, sf_dir), _SOURCE, vocab=SHORT)


@query(
    "WITH r AS (SELECT p, o_kind, min(CASE WHEN o_kind = 2 THEN NULL ELSE '<' || replace(replace(s, '\\', '\\\\'), '>', '\\>') END) first_s FROM quads WHERE s_kind = 0 GROUP BY p, o_kind) "
    "SELECT p AS property, count(*) kinds FROM r GROUP BY p"
)
def stats_example_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kinds of objects the example of each property shows."""
    lines = F.size(F.split(F.regexp_replace("example", r"(?s) \.\n<", " .\u0000<"), "\u0000"))
    return stats.property_examples(q(spark, sf_dir)).select("property", lines.cast("long").alias("kinds"))


# -- SPARQL ----------------------------------------------------------------------------------------


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return sparql.select(q(spark, sf_dir), text, SHORT, PREFIXES)


_INTS = "t AS (SELECT DISTINCT s, p, o FROM quads WHERE o_kind = 2 AND o_dt = 'xsd:integer' AND regexp_full_match(o, '[0-9]{1,9}'))"


@query(
    f"WITH {_INTS} SELECT p, '\"' || sum(CAST(o AS BIGINT)) || '\"^^xsd:integer' t, '\"' || arg_min(o, lpad(CAST(o AS BIGINT)::VARCHAR, 12, '0') || o) || '\"^^xsd:integer' a, "
    "'\"' || arg_max(o, lpad(CAST(o AS BIGINT)::VARCHAR, 12, '0') || o) || '\"^^xsd:integer' b, '\"' || (sum(CAST(o AS BIGINT)) * 1000 // count(*)) || '.0\"^^xsd:decimal' m, "
    "'\"' || count(DISTINCT o) || '\"^^xsd:integer' n, '\"' || sum(DISTINCT CAST(o AS BIGINT)) || '\"^^xsd:integer' d, '\"' || min(o) || '\"^^xsd:integer' x FROM t GROUP BY p"
)
def sparql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(
        spark, sf_dir,
        "SELECT ?p (SUM(?n) AS ?t) (MIN(?n) AS ?a) (MAX(?n) AS ?b) (FLOOR(AVG(?n) * 1000) AS ?m) (COUNT(DISTINCT ?n) AS ?n) (SUM(DISTINCT ?n) AS ?d) (SAMPLE(?n) AS ?x) "
        "WHERE { ?s ?p ?n FILTER(datatype(?n) = xsd:integer && regex(str(?n), '^[0-9]{1,9}$')) } GROUP BY ?p",
    )


@query(f"SELECT s x, '\"' || string_agg(o, '|' ORDER BY o) || '\"' g FROM (SELECT DISTINCT s, o FROM quads WHERE p = '{D}name' AND o_kind = 2) GROUP BY s")
def sparql_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "SELECT ?x (GROUP_CONCAT(DISTINCT ?n; separator='|') AS ?g) WHERE { ?x d:name ?l FILTER(isLiteral(?l)) BIND(STR(?l) AS ?n) } GROUP BY ?x")


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT s a, CASE WHEN o_kind < 2 THEN o ELSE '\"' || o || '\"' || CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang WHEN o_dt IS NOT NULL THEN '^^' || o_dt ELSE '' END END b FROM quads WHERE p = '{D}within'), "
    "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a x, b y FROM r UNION SELECT a, a FROM e UNION SELECT b, b FROM e"
)
def sparql_path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where anything of a containment link lies, itself included."""
    return select(spark, sf_dir, "SELECT DISTINCT ?x ?y WHERE { { ?x d:within ?l } UNION { ?l d:within ?x } ?x d:within* ?y }")


@query(
    f"WITH e AS (SELECT DISTINCT s a, CASE WHEN o_kind < 2 THEN o ELSE '\"' || o || '\"' || CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang WHEN o_dt IS NOT NULL THEN '^^' || o_dt ELSE '' END END b FROM quads WHERE p = '{D}within') "
    f"SELECT a x, b y FROM e UNION SELECT a, a FROM e"
)
def sparql_path_maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "SELECT DISTINCT ?x ?y WHERE { ?x d:within ?l . ?x d:within? ?y }")


_DECS = "t AS (SELECT DISTINCT s, p, o, CAST(o AS DECIMAL(18, 4)) v FROM quads WHERE o_kind = 2 AND o_dt = 'xsd:decimal' AND regexp_full_match(o, '-?[0-9]{1,7}[.][0-9]{1,3}'))"


@query(
    f"WITH {_DECS}, w AS (SELECT s, p, o, floor(v) f, ceil(v) c, floor(v + 0.5) r, abs(v) a, CAST(v * 2 + 1 AS DECIMAL(18, 4)) e FROM t), n AS (SELECT *, rtrim(rtrim(CAST(e AS VARCHAR), '0'), '.') t, rtrim(rtrim(CAST(a AS VARCHAR), '0'), '.') z FROM w) "
    "SELECT s, p, '\"' || CAST(f AS BIGINT) || '.0\"^^xsd:decimal' f, '\"' || CAST(c AS BIGINT) || '.0\"^^xsd:decimal' c, '\"' || CAST(r AS BIGINT) || '.0\"^^xsd:decimal' r, "
    "'\"' || t || CASE WHEN contains(t, '.') THEN '' ELSE '.0' END || '\"^^xsd:decimal' e, '\"' || z || CASE WHEN contains(z, '.') THEN '' ELSE '.0' END || '\"^^xsd:decimal' a FROM n"
)
def fn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(
        spark, sf_dir,
        "SELECT ?s ?p (FLOOR(?v) AS ?f) (CEIL(?v) AS ?c) (ROUND(?v) AS ?r) (?v * 2 + 1 AS ?e) (ABS(?v) AS ?a) WHERE { ?s ?p ?v FILTER(datatype(?v) = xsd:decimal && regex(str(?v), '^-?[0-9]{1,7}[.][0-9]{1,3}$')) }",
    )


# -- rules -----------------------------------------------------------------------------------------


def _chain(k: int) -> str:
    joins = " ".join(f"JOIN w w{i} ON w{i}.s = w{i - 1}.o" for i in range(1, k))
    return f"SELECT DISTINCT w0.s s, 'x:up{k}' p, w{k - 1}.o o FROM w w0 {joins}"


@query(f"WITH w AS (SELECT DISTINCT s, o FROM quads WHERE p = '{D}within' AND o_kind < 2) " + " UNION ALL ".join(_chain(k) for k in range(1, 6)))
def rules_owl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property chains of one to five steps up the containment links, by the chain rules of owl2rl."""
    rows = []
    for k in range(1, 6):
        rows.append((f"x:up{k}", "owl:propertyChainAxiom", f"_:c{k}x0"))
        for i in range(k):
            rows += [(f"_:c{k}x{i}", "rdf:first", D + "within"), (f"_:c{k}x{i}", "rdf:rest", f"_:c{k}x{i + 1}" if i < k - 1 else "rdf:nil")]
    data = setops.inject(q(spark, sf_dir).where((F.col("p") == D + "within") & (F.col("o_kind") < 2)), quads(spark, [quad(*r) for r in rows]))
    rules = [r for r in ruleset("owl2rl", SHORT) if "spo" in r.id]
    return apply_rules(data, rules, vocab=SHORT).where(F.col("p").startswith("x:up") & (F.col("p") != "owl:propertyChainAxiom")).where("o NOT LIKE '\\_:c_x_'").select("s", "p", "o").distinct()


# -- files -----------------------------------------------------------------------------------------


def _round_trip(name: str, extension: str, columns: list[str]) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}.{extension}"
        write_quads(as_quads(q(spark, sf_dir)), path)
        return read_quads(spark, path).select(*columns).distinct()

    f.__name__ = f"roundtrip_{name}"
    f.__doc__ = f"The register written to .{extension} and read back; reading documents puts language tags in lower case."
    lower = "" if name == "nq_gz" else " REPLACE (lower(o_lang) AS o_lang)"
    query(f"SELECT DISTINCT *{lower} FROM (SELECT {', '.join(columns)} FROM quads)")(f)


for _name, _extension, _columns in (("nq_gz", "nq.gz", QUAD), ("trig", "trig", QUAD), ("jsonld", "jsonld", QUAD), ("trix", "trix", QUAD), ("ttl_bz2", "ttl.bz2", TRIPLE), ("rdf_gz", "rdf.gz", TRIPLE)):
    _round_trip(_name, _extension, _columns)
