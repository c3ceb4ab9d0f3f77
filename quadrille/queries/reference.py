"""Queries for the quad operators, over the whole register of quads, with DuckDB equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sparql
from quadrille.model import LITERAL, NAMESPACES, QUAD, SHORT, TRIPLE, as_quads, bag_union, quad, quads
from quadrille.operators import mapreduce, rdfs, script, semantic, setops, stats, transform, unique
from quadrille.plans.pipeline import Pipeline
from quadrille.rules.engine import apply_rules
from quadrille.rules.model import parse_dlog, parse_rules
from quadrille.rules.rulesets import ruleset
from quadrille.sources.lines import parse_statements, to_lines
from quadrille.storage import read

D = "http://kb.tidal.example/def/"
PREFIXES = {"d": D, "id": "http://kb.tidal.example/id/", "gr": "http://kb.tidal.example/graph/"}
ALL = ", ".join(QUAD)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_quads(read(spark, sf_dir, "quads"))


def pipe(spark: SparkSession, sf_dir: str, spec: str) -> DataFrame:
    return Pipeline(spark, SHORT, PREFIXES).run(spec, q(spark, sf_dir))


# -- flagship: filtering and comparison ---------------------------------------------------------------


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their open orders as quads."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    fact = lambda df, s, p, o: df.select(s.alias("s"), F.lit(0).cast("tinyint").alias("s_kind"), F.lit(p).alias("p"), F.lit(o).alias("o"), F.lit(0).cast("tinyint").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_lang", "o_dt", "g")], F.lit(None).cast("tinyint").alias("g_kind"))
    of = lambda c: F.concat(F.lit("x:customer/"), c.cast("string"))
    return bag_union(fact(customer, of(F.col("c_custkey")), "rdf:type", "x:Customer"), fact(orders.where("o_orderstatus = 'O'"), of(F.col("o_custkey")), "x:hasOpenOrder", "x:yes"))


@query(
    "SELECT 'x:customer/' || c_custkey s, CAST(0 AS TINYINT) s_kind, 'rdf:type' p, 'x:Customer' o, CAST(0 AS TINYINT) o_kind, NULL::VARCHAR o_lang, NULL::VARCHAR o_dt, 'x:sel' g, CAST(0 AS TINYINT) g_kind "
    "FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an open order: filter, rewrite, set difference, distinct."""
    run = Pipeline(spark, SHORT, {"x": "x:"})
    return run.run("{ @transform '+p rdf:type +o x:Customer =c x:sel' , @transform '+p x:hasOpenOrder =p rdf:type =o x:Customer =c x:sel' }d @unique", order_quads(spark, sf_dir))


# -- transform ------------------------------------------------------------------------------------------


def _transform(name: str, spec: str, where: str, cols: str = ALL) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pipe(spark, sf_dir, f"@transform '{spec}'")

    f.__name__ = name
    query(f"SELECT {cols} FROM quads WHERE {where}")(f)


_transform("transform_filter", "+p rdf:type -o d:Barge", f"p = 'rdf:type' AND NOT (o = '{D}Barge' AND o_kind = 0)")
_transform("transform_replace", "+p d:name =p rdfs:label =c d:sel", f"p = '{D}name'", f"s, s_kind, 'rdfs:label' p, o, o_kind, o_lang, o_dt, '{D}sel' g, CAST(0 AS TINYINT) g_kind")
_transform("transform_iri", "+o <*> -s _:*", "o_kind = 0 AND s_kind <> 1")
_transform("transform_bnode", "+so _:*", "s_kind = 1 AND o_kind = 1")
_transform("transform_lang", "+o *@*", "o_kind = 2 AND o_lang IS NOT NULL")
_transform("transform_lang_en", "+o *@en", "o_kind = 2 AND o_lang = 'en'")
_transform("transform_plain", "+o *", "o_kind = 2 AND o_lang IS NULL AND (o_dt IS NULL OR o_dt = 'xsd:string')")
_transform("transform_datatype", "+o *^^xsd:integer", "o_kind = 2 AND o_dt = 'xsd:integer'")
_transform("transform_datatypes", "+o *^^*", "o_kind = 2 AND o_dt IS NOT NULL")
_transform("transform_namespace", "+p d:*", f"starts_with(p, '{D}')")
_transform("transform_prefix", f"+o <{PREFIXES['id']}area/1*>", f"o_kind = 0 AND starts_with(o, '{PREFIXES['id']}area/1')")
_transform("transform_default_graph", "+c sesame:nil", "g IS NULL OR (g = 'sesame:nil' AND g_kind = 0)")
_transform("transform_to_default_graph", "+p rdfs:label =c sesame:nil", "p = 'rdfs:label'", "s, s_kind, p, o, o_kind, o_lang, o_dt, NULL::VARCHAR g, NULL::TINYINT g_kind")

_PATTERNS = [(None, "rdf:type", D + "Barge", None, "barge"), (None, "rdf:type", None, None, "typed"), (None, "rdfs:label", None, None, "named"), (None, D + "name", None, None, "named"), (None, None, None, PREFIXES["gr"] + "g1", "in g1")]


@query(
    f"SELECT DISTINCT {ALL}, v AS value FROM quads, LATERAL (SELECT unnest([CASE WHEN p = 'rdf:type' AND o = '{D}Barge' THEN 'barge' END, CASE WHEN p = 'rdf:type' THEN 'typed' END, "
    f"CASE WHEN p IN ('rdfs:label', '{D}name') THEN 'named' END, CASE WHEN g = '{PREFIXES['gr']}g1' THEN 'in g1' END]) v) WHERE v IS NOT NULL"
)
def matcher_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.match_patterns(q(spark, sf_dir), _PATTERNS)


@query(f"SELECT o s, o_kind s_kind, '{D}contains' p, s o, s_kind o_kind, NULL::VARCHAR o_lang, NULL::VARCHAR o_dt, g, g_kind FROM quads WHERE p = '{D}within' AND o_kind < 2")
def statement_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.template(transform.transform(q(spark, sf_dir), "+p d:within", PREFIXES, SHORT), "=o", f"<{D}contains>", "=s")


@query(f"SELECT s, s_kind, p, upper(o) o, o_kind, o_lang, o_dt, g, g_kind FROM quads WHERE p = '{D}name' AND o_kind = 2")
def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "if p == d:name and l_is_literal(o):\n    emit(s, p, literal(o.upper(), l, d), c)\n".replace("l_is_literal(o)", "not isinstance(o, Term)")
    return script.script(q(spark, sf_dir), source, vocab=SHORT, prefixes=PREFIXES)


@query(
    f"SELECT {ALL} FROM quads WHERE s IN (SELECT o FROM quads WHERE p = '{D}within' AND o_kind < 2) OR p IN (SELECT o FROM quads WHERE p = '{D}within' AND o_kind = 0) "
    f"OR (o_kind < 2 AND o IN (SELECT o FROM quads WHERE p = '{D}within' AND o_kind < 2))"
)
def loadset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that mention a node in which something lies."""
    data = q(spark, sf_dir)
    inside = script.load_set(data.where((F.col("p") == D + "within") & (F.col("o_kind") < LITERAL)), "o")
    return script.match_set(data, inside)


# -- set operators ----------------------------------------------------------------------------------------

_BRANCHES = [["rdf:type", "rdfs:label", D + "motto"], ["rdf:type", D + "name"], ["rdf:type", "rdfs:label", D + "name", D + "within"]]
_FLAT = f"s, s_kind, p, o, o_kind, o_lang, o_dt, '{D}m' g, CAST(0 AS TINYINT) g_kind"
_COUNTED = "WITH b AS (" + " UNION ALL ".join(
    f"SELECT {_FLAT}, {i} b FROM quads WHERE p IN ({', '.join(repr(x) for x in ps)})" for i, ps in enumerate(_BRANCHES)
) + f"), m AS (SELECT {ALL}, " + ", ".join(f"count(*) FILTER (WHERE b = {i}) m{i}" for i in range(3)) + f" FROM b GROUP BY {ALL}) "
_FORMULAS = {
    "a": "m0 + m1 + m2", "u": "1", "U": "greatest(m0, m1, m2)", "i": "CASE WHEN least(m0, m1, m2) > 0 THEN 1 ELSE 0 END", "I": "least(m0, m1, m2)", "d": "CASE WHEN m0 > 0 AND m1 + m2 = 0 THEN 1 ELSE 0 END",
    "D": "greatest(0, m0 - m1 - m2)", "s": "CASE WHEN least(m0, m1, m2) = 0 THEN 1 ELSE 0 END", "S": "greatest(m0, m1, m2) - least(m0, m1, m2)",
    "2+": "CASE WHEN (m0 > 0)::INT + (m1 > 0)::INT + (m2 > 0)::INT >= 2 THEN 1 ELSE 0 END", "1-": "CASE WHEN m0 + m1 + m2 <= 1 THEN 1 ELSE 0 END",
}
_SET_NAMES = {
    "a": "sum", "u": "union", "U": "union_all", "i": "intersection", "I": "intersection_all", "d": "difference", "D": "difference_all", "s": "symmetric", "S": "symmetric_all", "2+": "at_least", "1-": "at_most",
}


def _set_query(op: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        branches = ["@transform '+p {} =c d:m'".format(" ".join("d:" + x[len(D) :] if x.startswith(D) else x for x in ps)) for ps in _BRANCHES]
        return pipe(spark, sf_dir, "{ " + " , ".join(branches) + " }" + op)

    f.__name__ = f"setop_{_SET_NAMES[op]}"
    query(_COUNTED + f"SELECT {ALL} FROM (SELECT {ALL}, unnest(generate_series(1, CAST({_FORMULAS[op]} AS BIGINT))) FROM m)")(f)


for _op in _FORMULAS:
    _set_query(_op)


# -- distinct, fusion -----------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT {ALL} FROM quads")
def unique_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe(spark, sf_dir, "@unique")


_FREE = f"WITH u AS (SELECT DISTINCT {ALL} FROM quads), f AS (SELECT * FROM u WHERE s NOT IN (SELECT g FROM u WHERE g IS NOT NULL)) "


@query(_FREE + f"SELECT {', '.join(TRIPLE)}, count(g) n, bool_or(g IS NULL) in_default, min(g) g FROM f GROUP BY {', '.join(TRIPLE)}")
def unique_merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What graph fusion decides by: in how many graphs a triple stands, and whether in the default graph."""
    return unique.fused(q(spark, sf_dir))[0].select(*TRIPLE, "n", "in_default", "g")


@query(
    _FREE + f"SELECT {', '.join(TRIPLE)}, CASE WHEN bool_or(g IS NULL) THEN '' WHEN count(g) = 1 THEN min(g) ELSE 'fused' END place FROM f GROUP BY {', '.join(TRIPLE)} "
    f"UNION ALL SELECT {', '.join(TRIPLE)}, coalesce(g, '') FROM u WHERE s IN (SELECT g FROM u WHERE g IS NOT NULL)"
)
def unique_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused statements; names of fusion graphs are hashes, so they only show as such here."""
    out = pipe(spark, sf_dir, "@unique -m")
    fused = F.col("g").rlike("[/#:][0-9a-f]{20,32}\\z")
    return out.select(*TRIPLE, F.when(fused, "fused").otherwise(F.coalesce("g", F.lit(""))).alias("place"))


# -- map / reduce -----------------------------------------------------------------------------------------------


@query(f"SELECT {ALL} FROM quads WHERE s IN (SELECT s FROM quads WHERE p = 'rdf:type')")
def mapreduce_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements of subjects that have a type."""
    return pipe(spark, sf_dir, "@mapreduce -e '+p rdf:type' s")


@query(f"SELECT {ALL} FROM quads WHERE s NOT IN (SELECT s FROM quads WHERE p NOT IN ('owl:sameAs', 'rdfs:label'))")
def mapreduce_forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects about which nothing but sameAs and labels is said."""
    return pipe(spark, sf_dir, "@mapreduce -a '+p owl:sameAs rdfs:label' s")


@query("SELECT k node, count(*) n FROM (SELECT s k FROM quads UNION ALL SELECT o FROM quads WHERE o_kind < 2 AND o <> s) GROUP BY k")
def mapreduce_entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = q(spark, sf_dir).select(F.explode(mapreduce.keys("e")).alias("node"))
    return keyed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT {ALL} FROM quads WHERE p <> 'rdf:type' UNION ALL SELECT {ALL} FROM quads WHERE p = 'rdf:type'")
def mapreduce_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types go around the reducer, everything else is deduplicated by key (s, p)."""
    return pipe(spark, sf_dir, "@mapreduce -b '+p rdf:type' -u sp")


# -- canonicalisation --------------------------------------------------------------------------------------------

_SAME = (
    "RECURSIVE e AS (SELECT s a, o b FROM quads WHERE p = 'owl:sameAs' AND o_kind < 2 AND s <> o UNION SELECT o, s FROM quads WHERE p = 'owl:sameAs' AND o_kind < 2 AND s <> o), "
    "k AS (SELECT n, min(k) k FROM (SELECT s n, s_kind k FROM quads UNION SELECT o, o_kind FROM quads WHERE o_kind < 2) GROUP BY n), "
    "top AS (SELECT a member, a seed FROM e UNION SELECT e.b, r.seed FROM top r JOIN e ON e.a = r.member), "
    "c AS (SELECT t.member, min_by(t.seed, (k.k, t.seed)) canon FROM top t JOIN k ON k.n = t.seed GROUP BY t.member), "
    "al AS (SELECT member term, canon, k.k canon_kind FROM c JOIN k ON k.n = canon WHERE member <> canon)"
)


@query(f"WITH {_SAME} SELECT term, canon, canon_kind FROM al")
def smush_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.canonical_terms(q(spark, sf_dir), vocab=SHORT)


@query(
    f"WITH {_SAME}, w AS (SELECT q.*, a.canon sc, a.canon_kind sk, b.canon oc, b.canon_kind ok, c.canon pc, d.canon gc, d.canon_kind gk FROM quads q LEFT JOIN al a ON a.term = q.s LEFT JOIN al b ON b.term = q.o AND q.o_kind < 2 "
    "LEFT JOIN al c ON c.term = q.p AND c.canon_kind = 0 LEFT JOIN al d ON d.term = q.g) "
    "SELECT coalesce(sc, s) s, coalesce(sk, s_kind) s_kind, coalesce(pc, p) p, coalesce(oc, o) o, coalesce(ok, o_kind) o_kind, o_lang, o_dt, coalesce(gc, g) g, coalesce(gk, g_kind) g_kind FROM w "
    "WHERE NOT (p = 'owl:sameAs' AND o_kind < 2) UNION ALL SELECT sc, sk, p, s, s_kind, o_lang, o_dt, coalesce(gc, g), coalesce(gk, g_kind) FROM w WHERE p = 'owl:sameAs' AND o_kind < 2 AND s <> o AND sc IS NOT NULL "
    "UNION ALL SELECT oc, ok, p, o, o_kind, o_lang, o_dt, coalesce(gc, g), coalesce(gk, g_kind) FROM w WHERE p = 'owl:sameAs' AND o_kind < 2 AND s <> o AND oc IS NOT NULL"
)
def smush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe(spark, sf_dir, "@smush")


# -- schema, inference --------------------------------------------------------------------------------------------

_AXIOMS = [
    (D + "Barge", "rdfs:subClassOf", D + "Vessel"), (D + "Vessel", "rdfs:subClassOf", D + "Thing"), (D + "Weir", "rdfs:subClassOf", D + "Structure"), (D + "Structure", "rdfs:subClassOf", D + "Thing"),
    (D + "within", "rdfs:subPropertyOf", D + "near"), (D + "near", "rdfs:subPropertyOf", D + "related"), (D + "near", "rdfs:domain", D + "Area"), (D + "within", "rdfs:range", D + "Area"),
    (D + "Area", "rdfs:subClassOf", D + "Thing"), (D + "berths", "rdfs:domain", D + "Harbour"), (D + "Harbour", "rdfs:subClassOf", D + "Structure"), (D + "Harbour", "rdf:type", "owl:Class"), (D + "borders", "rdf:type", "owl:SymmetricProperty"),
]
_AX = "ax(s, p, o) AS (VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in _AXIOMS) + ")"
_CLOSED = (
    f"WITH RECURSIVE {_AX}, sc AS (SELECT s a, o b FROM ax WHERE p = 'rdfs:subClassOf' UNION SELECT sc.a, ax.o FROM sc JOIN ax ON ax.p = 'rdfs:subClassOf' AND ax.s = sc.b), "
    "sp AS (SELECT s a, o b FROM ax WHERE p = 'rdfs:subPropertyOf' UNION SELECT sp.a, ax.o FROM sp JOIN ax ON ax.p = 'rdfs:subPropertyOf' AND ax.s = sp.b), "
    f"props AS (SELECT {ALL} FROM quads UNION SELECT s, s_kind, b, o, o_kind, o_lang, o_dt, g, g_kind FROM quads JOIN sp ON p = a), "
    "ty AS (SELECT s, s_kind, o c, g FROM props WHERE p = 'rdf:type' AND o_kind < 2 UNION SELECT q.s, q.s_kind, ax.o, q.g FROM props q JOIN ax ON ax.p = 'rdfs:domain' AND ax.s = q.p "
    "UNION SELECT q.o, q.o_kind, ax.o, q.g FROM props q JOIN ax ON ax.p = 'rdfs:range' AND ax.s = q.p WHERE q.o_kind < 2), "
    "types AS (SELECT * FROM ty UNION SELECT ty.s, ty.s_kind, sc.b, ty.g FROM ty JOIN sc ON sc.a = ty.c) "
)


def axioms(spark: SparkSession) -> DataFrame:
    return quads(spark, [quad(*a) for a in _AXIOMS])


@query(f"WITH {_AX} SELECT s, CAST(0 AS TINYINT) s_kind, p, o, CAST(0 AS TINYINT) o_kind, NULL::VARCHAR o_lang, NULL::VARCHAR o_dt, NULL::VARCHAR g, NULL::TINYINT g_kind FROM ax")
def tbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema in the register with some axioms put in."""
    return semantic.tbox(setops.inject(q(spark, sf_dir), axioms(spark)), SHORT)


@query(
    "SELECT term, role, n, false defined FROM (SELECT p term, 'property' AS role, count(*) n FROM quads GROUP BY p UNION ALL SELECT o, 'class', count(*) FROM quads WHERE p = 'rdf:type' AND o_kind = 0 GROUP BY o)"
)
def vocabulary_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.vocabulary_use(q(spark, sf_dir), SHORT)


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdfs.rdfs(q(spark, sf_dir), axioms(spark), ["rdfs4a", "rdfs4b", "rdfs8", "rdfs6", "rdfs10", "rdfd2", "rdfs1"], vocab=SHORT)


@query(_CLOSED + f"SELECT DISTINCT s, c, g FROM types WHERE starts_with(c, '{D}')")
def rdfs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of everything under a small schema: super-properties, domains, ranges, super-classes.

    Without the rules that make rows for every term or property; ``rdfs_all`` has them all.
    """
    return _inferred(spark, sf_dir).where((F.col("p") == "rdf:type") & F.col("o").startswith(D)).select("s", F.col("o").alias("c"), "g")


@query(_CLOSED + "SELECT * FROM props WHERE p <> 'rdf:type'")
def rdfs_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir).where("p <> 'rdf:type'")


@query()
def rdfs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inference of the RDFS operator under the small schema; nothing is excluded."""
    return rdfs.rdfs(q(spark, sf_dir), axioms(spark), vocab=SHORT)


def _ruled(spark: SparkSession, sf_dir: str, rules: str, mode: str = "none", graph: str | None = None, partition: str = "none", **options) -> DataFrame:
    return apply_rules(q(spark, sf_dir), parse_rules(rules, SHORT, PREFIXES), mode, graph, partition, **options)


_T = ", ".join(TRIPLE)
_RDF = f"SELECT DISTINCT {ALL} FROM quads"
_NEW = "CAST(0 AS TINYINT) s_kind"


def _kinds(s: str, o: str) -> str:
    k = lambda c: f"CAST(CASE WHEN starts_with({c}, '_:') THEN 1 ELSE 0 END AS TINYINT)"
    return f"{s} s, {k(s)} s_kind, %s p, {o} o, {k(o)} o_kind, NULL::VARCHAR o_lang, NULL::VARCHAR o_dt"


@query(
    f"WITH RECURSIVE l AS (SELECT DISTINCT s a, o b FROM quads WHERE p = '{D}within' AND o_kind < 2), t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a s, b o FROM t"
)
def rules_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything an area lies in, directly or not; rounds double the distance."""
    out = _ruled(spark, sf_dir, "trans : ?x d:within ?z <- ?x d:within ?y ; ?y d:within ?z")
    return out.where((F.col("p") == D + "within") & (F.col("o_kind") < LITERAL)).select("s", "o").distinct()


@query(
    f"{_RDF} UNION SELECT {_kinds('o', 's') % repr(D + 'borders')}, NULL, NULL FROM quads WHERE p = '{D}borders' AND o_kind < 2 "
    f"UNION SELECT {_kinds('s', 'o') % repr(D + 'borders')}, NULL, NULL FROM quads WHERE p = '{D}borders' AND o_kind < 2"
)
def rules_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, "sym : ?y d:borders ?x <- ?x d:borders ?y")


@query(f"{_RDF} UNION SELECT {_kinds('o', 's') % repr(D + 'within')}, NULL, NULL FROM quads WHERE p = '{D}encloses' AND o_kind < 2")
def rules_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, "inv : ?y d:within ?x <- ?x d:encloses ?y")


@query(f"SELECT DISTINCT a.s, b.o, b.o_kind, b.o_lang, b.o_dt FROM quads a JOIN quads b ON b.s = a.o AND a.o_kind < 2 WHERE a.p = '{D}borders' AND b.p = '{D}within' AND a.s <> b.o")
def rules_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ruled(spark, sf_dir, "chain once : ?x d:nearIn ?z <- ?x d:borders ?y ; ?y d:within ?z ; ?x != ?z")
    return out.where(F.col("p") == D + "nearIn").select("s", "o", "o_kind", "o_lang", "o_dt")


_CHAIN = "pair once : ?x d:pair ?z <- ?x d:name ?y ; ?x rdf:type ?z"
_JOINED = f"FROM quads a JOIN quads b ON b.s = a.s WHERE a.p = '{D}name' AND b.p = 'rdf:type'"


@query(f"SELECT DISTINCT b.s, b.o, '{PREFIXES['gr']}all' g {_JOINED}")
def rules_graph_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _CHAIN, "global", PREFIXES["gr"] + "all").where(F.col("p") == D + "pair").select("s", "o", "g")


@query(f"SELECT DISTINCT b.s, b.o, a.g {_JOINED} AND a.g IS NOT DISTINCT FROM b.g")
def rules_graph_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _CHAIN, "separate").where(F.col("p") == D + "pair").select("s", "o", "g")


@query(f"SELECT DISTINCT b.s, b.o, coalesce(a.g, b.g) g {_JOINED} AND (a.g IS NULL OR b.g IS NULL OR a.g = b.g)")
def rules_graph_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _CHAIN, "star").where(F.col("p") == D + "pair").select("s", "o", "g")


@query(f"SELECT DISTINCT b.s, b.o {_JOINED} AND a.g IS NOT DISTINCT FROM b.g")
def rules_partition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _CHAIN, partition="graph").where(F.col("p") == D + "pair").select("s", "o")


@query(f"SELECT DISTINCT b.s, b.o {_JOINED}")
def rules_partition_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _CHAIN, partition="entity").where(F.col("p") == D + "pair").select("s", "o")


@query(
    f"SELECT DISTINCT {ALL} FROM quads WHERE NOT (p = '{D}remark' AND s IN (SELECT s FROM quads WHERE p = 'rdf:type')) UNION SELECT DISTINCT s, s_kind, '{D}noted', o, o_kind, o_lang, o_dt, NULL::VARCHAR, NULL::TINYINT "
    f"FROM quads WHERE p = '{D}remark' AND s IN (SELECT s FROM quads WHERE p = 'rdf:type')"
)
def rules_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move the remarks of typed subjects to another property: insert and delete in one rule."""
    return _ruled(spark, sf_dir, "move once : ?x d:noted ?r - ?x d:remark ?r <- ?x d:remark ?r ; ?x rdf:type ?c")


@query(_CLOSED + f"SELECT DISTINCT s, c FROM types WHERE starts_with(c, '{D}')")
def rules_rhodf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules of rhodf (2a to 4b) to their fixpoint: same types as the one-pass RDFS operator, over all graphs.

    ``rules_rhodf_all`` has all fifteen.
    """
    out = apply_rules(setops.inject(q(spark, sf_dir), axioms(spark)), [r for r in ruleset("rhodf", SHORT) if r.id.rpartition("-")[2] in ("2a", "2b", "3a", "3b", "4a", "4b")], vocab=SHORT)
    known = [a[0] for a in _AXIOMS]
    return out.where((F.col("p") == "rdf:type") & F.col("o").startswith(D) & ~(F.col("s").isin(known) & F.col("o").isin("owl:Class"))).select("s", F.col("o").alias("c")).distinct()


@query()
def rules_rhodf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rhodf ruleset to its fixpoint, all statements."""
    return apply_rules(setops.inject(q(spark, sf_dir), axioms(spark)), ruleset("rhodf", SHORT), vocab=SHORT)


@query()
def rules_rdfs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rdfs ruleset to its fixpoint, all statements."""
    return apply_rules(setops.inject(q(spark, sf_dir), axioms(spark)), ruleset("rdfs", SHORT), vocab=SHORT)


@query(f"SELECT DISTINCT s, b.o {_JOINED.replace('b.s = a.s', 'b.s = a.s')}".replace("DISTINCT s,", "DISTINCT b.s,"))
def rules_dlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parse_dlog(f"PREFIX d: <{D}>\nPREFIX t: <urn:t:>\nd:pair(x, z) :- d:name(x, y), t:type(x, z).\n")
    rules = [r.__class__(r.id, r.insert, tuple((s, "rdf:type" if p == "urn:t:type" else p, o) for s, p, o in r.where), fixpoint=False) for r in rules]
    return apply_rules(q(spark, sf_dir), rules).where(F.col("p") == D + "pair").select("s", "o")


# -- queries over the relation ---------------------------------------------------------------------------------------


def _sparql(name: str, text: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.select(q(spark, sf_dir), text, SHORT, PREFIXES)

    f.__name__ = f"sparql_{name}"
    query(sql)(f)


_ENC = "CASE WHEN {0}.o_kind = 2 THEN '\"' || {0}.o || '\"' || CASE WHEN {0}.o_lang IS NOT NULL THEN '@' || {0}.o_lang WHEN {0}.o_dt IS NOT NULL THEN '^^' || {0}.o_dt ELSE '' END ELSE {0}.o END"
_TR = f"WITH t AS (SELECT DISTINCT s, p, {_ENC.format('quads')} o, o_kind FROM quads) "
_INT = lambda e: f"'\"' || {e} || '\"^^xsd:integer'"

_sparql("bgp", "SELECT ?x ?c ?n WHERE { ?x a ?c ; d:name ?n }", _TR + f"SELECT a.s x, a.o c, b.o n FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'rdf:type' AND b.p = '{D}name'")
_sparql(
    "optional", "SELECT ?x ?n ?m WHERE { ?x d:name ?n . OPTIONAL { ?x d:motto ?m } }",
    _TR + f"SELECT a.s x, a.o n, b.o m FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '{D}motto' WHERE a.p = '{D}name'",
)
_sparql("union", "SELECT ?x ?y WHERE { { ?x d:within ?y } UNION { ?y d:encloses ?x } }", _TR + f"SELECT s x, o y FROM t WHERE p = '{D}within' UNION ALL SELECT o, s FROM t WHERE p = '{D}encloses'")
_sparql("minus", "SELECT ?x ?n WHERE { ?x d:name ?n MINUS { ?x d:tidal ?t } }", _TR + f"SELECT s x, o n FROM t WHERE p = '{D}name' AND s NOT IN (SELECT s FROM t WHERE p = '{D}tidal')")
_sparql("exists", "SELECT ?x ?n WHERE { ?x d:name ?n FILTER EXISTS { ?x d:toll ?t } }", _TR + f"SELECT s x, o n FROM t WHERE p = '{D}name' AND s IN (SELECT s FROM t WHERE p = '{D}toll')")
_sparql("not_exists", "SELECT ?x ?n WHERE { ?x d:name ?n FILTER NOT EXISTS { ?x d:toll ?t } }", _TR + f"SELECT s x, o n FROM t WHERE p = '{D}name' AND s NOT IN (SELECT s FROM t WHERE p = '{D}toll')")
_sparql(
    "path_plus", "SELECT DISTINCT ?x ?y WHERE { ?x d:within+ ?y }",
    f"WITH RECURSIVE t AS (SELECT DISTINCT s, {_ENC.format('quads')} o FROM quads WHERE p = '{D}within'), r AS (SELECT s, o FROM t UNION SELECT r.s, t.o FROM r JOIN t ON t.s = r.o) SELECT s x, o y FROM r",
)
_sparql(
    "path_sequence", "SELECT DISTINCT ?x ?y WHERE { ?x d:borders/(d:within|^d:encloses) ?y }",
    _TR + f"SELECT DISTINCT a.s x, b.y FROM t a JOIN (SELECT s x, o y FROM t WHERE p = '{D}within' UNION SELECT o, s FROM t WHERE p = '{D}encloses') b ON a.o = b.x WHERE a.p = '{D}borders'",
)
_sparql(
    "group_having", "SELECT ?c (COUNT(?x) AS ?n) (COUNT(DISTINCT ?x) AS ?d) WHERE { ?x a ?c } GROUP BY ?c HAVING (COUNT(?x) > 1)",
    _TR + f"SELECT o c, {_INT('count(*)')} n, {_INT('count(DISTINCT s)')} d FROM t WHERE p = 'rdf:type' GROUP BY o HAVING count(*) > 1",
)
_sparql("order_limit", "SELECT ?x ?n WHERE { ?x d:name ?n . FILTER(isIRI(?x)) } ORDER BY ?x ?n LIMIT 50 OFFSET 10", _TR + f"SELECT s x, o n FROM t WHERE p = '{D}name' AND NOT starts_with(s, '_:') ORDER BY s, regexp_replace(regexp_replace(o, '^\"', ''), '\"[^\"]*\\z', ''), o LIMIT 50 OFFSET 10")
_sparql("values", f"SELECT ?x ?c WHERE {{ VALUES ?c {{ d:Barge d:Weir }} ?x a ?c }}", _TR + f"SELECT s x, o c FROM t WHERE p = 'rdf:type' AND o IN ('{D}Barge', '{D}Weir')")
_sparql(
    "bind", "SELECT ?x ?u ?k WHERE { ?x d:name ?n . FILTER(isLiteral(?n)) BIND(UCASE(STR(?n)) AS ?u) BIND(STRLEN(STR(?n)) AS ?k) }",
    f"WITH t AS (SELECT DISTINCT s, o, o_lang, o_dt FROM quads WHERE p = '{D}name' AND o_kind = 2) SELECT s x, '\"' || upper(o) || '\"' u, {_INT('length(o)')} k FROM t",
)
_sparql("graph", "SELECT DISTINCT ?x ?g WHERE { GRAPH ?g { ?x a ?c ; d:name ?y } }", f"SELECT DISTINCT a.s x, a.g FROM quads a JOIN quads b ON a.s = b.s AND a.g = b.g WHERE a.p = 'rdf:type' AND b.p = '{D}name'")
_sparql(
    "filter_numbers", "SELECT ?x ?b WHERE { ?x d:berths ?b . FILTER(?b >= 100 && ?b < 200) }",
    f"SELECT DISTINCT s x, '\"' || o || '\"^^' || o_dt b FROM quads WHERE p = '{D}berths' AND o_kind = 2 AND o_lang IS NULL AND o_dt IN ('xsd:integer', 'xsd:decimal', 'xsd:double', 'xsd:float', 'xsd:int', 'xsd:long') "
    "AND try_cast(trim(o) AS DOUBLE) >= 100 AND try_cast(trim(o) AS DOUBLE) < 200",
)


@query(f"SELECT DISTINCT s, s_kind, '{D}title' p, o, o_kind, o_lang, o_dt, NULL::VARCHAR g, NULL::TINYINT g_kind FROM quads WHERE p = '{D}name'")
def sparql_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.construct(q(spark, sf_dir), "CONSTRUCT { ?x d:title ?n } WHERE { ?x d:name ?n }", SHORT, PREFIXES)


@query(f"SELECT DISTINCT {ALL} FROM quads WHERE s = '{PREFIXES['gr']}g1' OR s = '{PREFIXES['id']}area/1' OR o = '{PREFIXES['id']}area/1' AND o_kind = 0")
def sparql_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.describe(q(spark, sf_dir), "DESCRIBE <http://kb.tidal.example/id/area/1> gr:g1", SHORT, PREFIXES)


@query(f"SELECT EXISTS (SELECT 1 FROM quads a JOIN quads b ON a.s = b.s WHERE a.p = '{D}toll' AND b.p = '{D}motto') AS answer")
def sparql_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(sparql.ask(q(spark, sf_dir), "ASK { ?x d:toll ?t ; d:motto ?m }", SHORT, PREFIXES),)], "answer boolean")


# -- functions -------------------------------------------------------------------------------------------------------

_LABELS = "FROM (SELECT DISTINCT s, o FROM quads WHERE p = 'rdfs:label' AND o_kind = 2)"
_STR = lambda e: f"'\"' || {e} || '\"'"
_BOOL = lambda e: f"'\"' || CASE WHEN {e} THEN 'true' ELSE 'false' END || '\"^^xsd:boolean'"


def _functions(name: str, binds: dict[str, tuple[str, str]], triple: str = "?x rdfs:label ?n", source: str = _LABELS) -> None:
    text = "SELECT DISTINCT ?x " + " ".join(f"?{k}" for k in binds) + f" WHERE {{ {triple} FILTER(isLiteral(?n)) " + " ".join(f"BIND({e} AS ?{k})" for k, (e, _) in binds.items()) + " }"
    _sparql_as(f"fn_{name}", text, f"SELECT DISTINCT s x, {', '.join(f'{s} {k}' for k, (_, s) in binds.items())} {source}")


def _sparql_as(name: str, text: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.select(q(spark, sf_dir), text, SHORT, PREFIXES)

    f.__name__ = name
    query(sql)(f)


_functions("string", {
    "len": ("STRLEN(STR(?n))", _INT("length(o)")), "sub": ("SUBSTR(STR(?n), 2, 3)", _STR("substr(o, 2, 3)")), "up": ("UCASE(STR(?n))", _STR("upper(o)")), "low": ("LCASE(STR(?n))", _STR("lower(o)")),
    "st": ("STRSTARTS(STR(?n), \"B\")", _BOOL("starts_with(o, 'B')")), "en": ("STRENDS(STR(?n), \"m\")", _BOOL("ends_with(o, 'm')")), "co": ("CONTAINS(STR(?n), \"oo\")", _BOOL("contains(o, 'oo')")),
    "be": ("STRBEFORE(STR(?n), \" \")", _STR("CASE WHEN contains(o, ' ') THEN split_part(o, ' ', 1) ELSE '' END")),
    "af": ("STRAFTER(STR(?n), \" \")", _STR("CASE WHEN contains(o, ' ') THEN substr(o, instr(o, ' ') + 1) ELSE '' END")), "cc": ("CONCAT(STR(?n), \"-\", STR(?n))", _STR("o || '-' || o")),
})
_functions("regex", {"rx": ("REGEX(STR(?n), \"^b.*m$\", \"i\")", _BOOL("regexp_matches(o, '(?i)^b.*m$')")), "rp": ("REPLACE(STR(?n), \"[aeiou]\", \"_\")", _STR("regexp_replace(o, '[aeiou]', '_', 'g')"))})
_functions("hash", {"m": ("MD5(STR(?n))", _STR("md5(o)")), "s1": ("SHA1(STR(?n))", _STR("sha1(o)")), "s2": ("SHA256(STR(?n))", _STR("sha256(o)"))})
_DATES = f"FROM (SELECT DISTINCT s, o FROM quads WHERE p = '{D}opened' AND o_kind = 2 AND regexp_full_match(o, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))"
_functions("date", {"y": ("YEAR(?n)", _INT("CAST(substr(o, 1, 4) AS INT)")), "m": ("MONTH(?n)", _INT("CAST(substr(o, 6, 2) AS INT)")), "dd": ("DAY(?n)", _INT("CAST(substr(o, 9, 2) AS INT)"))}, "?x d:opened ?n . FILTER(REGEX(STR(?n), \"^[0-9]{4}-[0-9]{2}-[0-9]{2}$\"))", _DATES)
_NUMS = f"FROM (SELECT DISTINCT s, o FROM quads WHERE p = '{D}berths' AND o_kind = 2 AND regexp_full_match(o, '-?[0-9]{{1,9}}'))"
_functions("cast", {
    "i": ("xsd:integer(?n)", _INT("CAST(o AS BIGINT)")), "ab": ("ABS(xsd:integer(?n))", _INT("abs(CAST(o AS BIGINT))")), "pl": ("xsd:integer(?n) + 1", _INT("CAST(o AS BIGINT) + 1")),
    "io": ("IF(xsd:integer(?n) > 50, \"big\", \"small\")", _STR("CASE WHEN CAST(o AS BIGINT) > 50 THEN 'big' ELSE 'small' END")),
}, "?x d:berths ?n . FILTER(REGEX(STR(?n), \"^-?[0-9]{1,9}$\"))", _NUMS)
_TERMS_SQL = "FROM (SELECT DISTINCT s, o, o_kind, o_lang, o_dt FROM quads WHERE p = 'rdfs:label' AND o_kind = 2)"
_functions("terms", {
    "la": ("LANG(?n)", _STR("coalesce(o_lang, '')")), "dt": ("DATATYPE(?n)", "CASE WHEN o_lang IS NOT NULL THEN 'rdf:langString' ELSE coalesce(o_dt, 'xsd:string') END"),
    "lm": ("LANGMATCHES(LANG(?n), \"en\")", _BOOL("lower(coalesce(o_lang, '')) = 'en' OR starts_with(lower(coalesce(o_lang, '')), 'en-')")),
}, "?x rdfs:label ?n .", _TERMS_SQL)

# -- statistics ------------------------------------------------------------------------------------------------------

_U = f"WITH u AS (SELECT DISTINCT {ALL} FROM quads) "
_CNT = "count(*) triples, CAST(0 AS BIGINT) tbox_triples, count(*) abox_triples, count(*) FILTER (WHERE p = 'rdf:type' AND o_kind = 0) type_triples, count(*) FILTER (WHERE p = 'owl:sameAs') same_as_triples"


@query(_U + f"SELECT NULL::VARCHAR source, count(DISTINCT s) FILTER (WHERE s_kind = 0) entities, {_CNT}, count(DISTINCT o) FILTER (WHERE p = 'rdf:type' AND o_kind = 0) classes, count(DISTINCT p) FILTER (WHERE NOT (p = 'rdf:type' AND o_kind = 0)) properties FROM u")
def stats_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_stats(q(spark, sf_dir), vocab=SHORT)


_BY_SUBJECT = f"ps AS (SELECT s, s_kind, {_CNT}, count(DISTINCT p) preds FROM u GROUP BY s, s_kind), ty AS (SELECT DISTINCT s, o FROM u WHERE p = 'rdf:type' AND o_kind = 0) "


@query(
    _U.rstrip() + ", " + _BY_SUBJECT + "SELECT NULL::VARCHAR source, ty.o AS class, count(*) FILTER (WHERE s_kind = 0) entities, CAST(sum(triples) AS BIGINT) triples, CAST(sum(tbox_triples) AS BIGINT) tbox_triples, "
    "CAST(sum(abox_triples) AS BIGINT) abox_triples, CAST(sum(type_triples) AS BIGINT) type_triples, CAST(sum(same_as_triples) AS BIGINT) same_as_triples, sum(preds) / count(*) FILTER (WHERE s_kind = 0) average_properties "
    "FROM ty JOIN ps ON ps.s = ty.s GROUP BY ty.o HAVING count(*) FILTER (WHERE s_kind = 0) >= 5"
)
def stats_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_stats(q(spark, sf_dir), 5, vocab=SHORT)


@query(ORACLE["stats_classes"].replace("sum(preds) / count(*) FILTER (WHERE s_kind = 0)", "sum(preds) / nullif(count(*) FILTER (WHERE s_kind = 0), 0)").replace(" HAVING count(*) FILTER (WHERE s_kind = 0) >= 5", ""))
def stats_classes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class, those with few entities or none, too."""
    return stats.class_stats(q(spark, sf_dir), vocab=SHORT)


@query(
    _U.rstrip() + ", c AS (SELECT p AS property, count(*) triples, count(DISTINCT s) distinct_subjects, count(DISTINCT s) FILTER (WHERE s_kind = 0) entities, "
    "count(DISTINCT (o, o_kind, coalesce(o_lang, ''), coalesce(o_dt, ''))) FILTER (WHERE NOT (p = 'rdf:type' AND o_kind = 0)) distinct_objects, bool_and(o_kind = 2) al, bool_or(o_kind = 2) sl FROM u GROUP BY p) "
    "SELECT NULL::VARCHAR source, property, triples, distinct_subjects, entities, distinct_objects, CASE WHEN al THEN 'owl:DatatypeProperty' WHEN NOT sl THEN 'owl:ObjectProperty' ELSE 'rdf:Property' END detected_type, "
    "triples = distinct_subjects functional, triples = distinct_objects inverse_functional FROM c"
)
def stats_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.property_stats(q(spark, sf_dir), vocab=SHORT)


@query()
def stats_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe(spark, sf_dir, "@stats -n urn:stats:")


@query(
    "SELECT DISTINCT ns FROM (SELECT regexp_extract(t, '(?s)^(.*#|[^#]*/|[^#/]*:)', 1) ns FROM (SELECT s t FROM quads WHERE s_kind = 0 UNION ALL SELECT p FROM quads UNION ALL SELECT o FROM quads WHERE o_kind = 0 "
    "UNION ALL SELECT o_dt FROM quads WHERE o_dt IS NOT NULL UNION ALL SELECT g FROM quads WHERE g_kind = 0)) WHERE ns <> ''"
)
def prefix_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.used_namespaces(q(spark, sf_dir))


# -- reading and writing ----------------------------------------------------------------------------------------------


@query(
    f"SELECT {ALL.replace('g, g_kind', '')} CASE WHEN g = 'sesame:nil' THEN NULL ELSE g END g, CASE WHEN g = 'sesame:nil' THEN NULL ELSE g_kind END g_kind FROM quads"
    .replace("o_dt, CASE", "o_dt, CASE")
)
def roundtrip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement written as a line and read back."""
    return parse_statements(to_lines(q(spark, sf_dir)), nil="sesame:nil")


@query(None)
def read_tql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lenient reader over raw lines: malformed ones are dropped without a word."""
    return parse_statements(read(spark, sf_dir, "tql_lines"), "raw_line", "sesame:nil")


@query("SELECT pred, term, count(*) n FROM coded_quads JOIN dict_terms ON pred = code GROUP BY pred, term")
def decode_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary decoding of a heavily skewed column: counted first, decoded once per code."""
    counts = read(spark, sf_dir, "coded_quads").groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(read(spark, sf_dir, "dict_terms"), F.col("pred") == F.col("code")).select("pred", "term", "n")


@query(
    "SELECT s.term s, p.term p, o.term o, g.term g FROM coded_quads JOIN dict_terms s ON s.code = subj JOIN dict_terms p ON p.code = pred JOIN dict_terms o ON o.code = obj LEFT JOIN dict_terms g ON g.code = ctx"
)
def decode_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coded quad back to terms.

    Predicates and graphs are skewed but few: only the dictionary rows of codes in use are looked up, and
    broadcast if they are within a checked bound.  Subjects and objects are joined by shuffling.
    """
    out = read(spark, sf_dir, "coded_quads").select("subj", "pred", "obj", "ctx")
    terms = read(spark, sf_dir, "dict_terms").select("code", "term")
    for col, name in (("pred", "p"), ("ctx", "g"), ("subj", "s"), ("obj", "o")):
        table = terms.select(F.col("code").alias(col), F.col("term").alias(name))
        if col in ("pred", "ctx"):
            used = table.join(out.select(col).distinct(), col, "left_semi")
            table = F.broadcast(used) if used.limit(100_001).count() <= 100_000 else used
        out = out.join(table, col, "left" if col == "ctx" else "inner")
    return out.select("s", "p", "o", "g")


__all__ = ["QUERIES", "ORACLE", "flagship", "NAMESPACES", "reduce", "unique"]
