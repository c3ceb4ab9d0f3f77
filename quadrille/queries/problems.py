"""Queries of the general problems: hierarchies, wide tables, rejected lines, frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import hierarchy, rejects, skew, widen
from quadrille.storage import Scratch, read

DEF = "http://kb.tidal.example/def/"
WITHIN, ENCLOSES = DEF + "within", DEF + "encloses"


def containment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) from both directions of writing, in one scan."""
    q = read(spark, sf_dir, "quads").where(F.col("p").isin(WITHIN, ENCLOSES) & F.col("o_kind").isin(0, 1))
    up = F.col("p") == WITHIN
    return q.select(F.when(up, F.col("s")).otherwise(F.col("o")).alias("child"), F.when(up, F.col("o")).otherwise(F.col("s")).alias("parent"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(containment_links(spark, sf_dir))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy.resolve_hierarchy(containment_links(spark, sf_dir), with_paths=True)
    return nodes.select("node", "root", "node_depth", F.array_join("path", "\n").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_hierarchy(containment_links(spark, sf_dir), with_paths=True))


def p3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).where("node_depth = -1").select("node")


def _eav(spark: SparkSession, sf_dir: str):
    return read(spark, sf_dir, "quads"), widen.attribute_specs(read(spark, sf_dir, "attribute_specs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen.unreadable(*_eav(spark, sf_dir))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, specs = _eav(spark, sf_dir)
    out = widen.widen(rows, specs)
    # Numbers as exact text: engines print decimals of unequal scale differently.
    cast = [widen.exact_text(out, c).alias(c) if k in ("integer", "decimal") else F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for _, c, k in specs]
    return out.select("s", *cast)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows, and a number with 12 decimals, one of 45 digits and one of 30 and 20 for every hundredth of their entities' rows."""
    q = read(spark, sf_dir, "quads").select("quad_id", "s", "p", "o", "o_kind")
    long = F.when(F.col("quad_id") % 300 == 0, "0.123456789012").when(F.col("quad_id") % 300 == 100, "-00" + "123456789" * 5).otherwise("9" * 30 + ".50000000000000000001")
    planted = q.where("quad_id % 100 = 0").select((F.col("quad_id") + 1_000_000_000).alias("quad_id"), "s", F.lit(DEF + "toll").alias("p"), long.alias("o"), F.lit(2).cast("tinyint").alias("o_kind"))
    return q.unionByName(planted)


def p5_long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tolls of all entities, among them planted ones that no number column holds."""
    specs = [x for x in widen.attribute_specs(read(spark, sf_dir, "attribute_specs")) if x[1] == "toll"]
    out = widen.widen(_planted(spark, sf_dir), specs)
    return out.select("s", widen.exact_text(out, "toll").alias("toll"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(read(spark, sf_dir, "tql_lines")).select("file_no", "line_no")


def p6_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(read(spark, sf_dir, "tql_lines"))


def p6_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.good_quads(read(spark, sf_dir, "tql_lines"))


def _per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = read(spark, sf_dir, "coded_quads").select(F.lit("pred").alias("field_name"), F.col("pred").alias("code"), "subj")
    types = read(spark, sf_dir, "stat_records").where("rec_type IS NOT NULL").select(F.lit("rec_type").alias("field_name"), F.col("rec_type").alias("code"), F.lower("subject").alias("subject"))
    return skew.per_key(pred, "field_name", "code", "subj").unionByName(skew.per_key(types, "field_name", "code", "subject"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts of every code are made whole; the frequent codes are read off them.
    counts = Scratch(spark, "codes").table(_per_code(spark, sf_dir))
    return skew.frequent(counts, 20).select("field_name", "code")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_code(spark, sf_dir).drop("group_rows")


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct subjects by predicate term, through the join with the dictionary."""
    quads = read(spark, sf_dir, "coded_quads").select("pred", "subj")
    return skew.eager_join(quads, read(spark, sf_dir, "dict_terms"), ("pred", "code"), by=["term"], distinct="subj")


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_cycles, p5_found, p5_wide, p5_long_numbers, p6_found, p6_rejects, p6_quads, p7_found, p7_counts, p7_terms)}

_LINKS = f"""links AS (
  SELECT child, min(parent) parent FROM (
    SELECT s child, o parent FROM quads WHERE p = '{WITHIN}' AND o_kind IN (0, 1)
    UNION SELECT o, s FROM quads WHERE p = '{ENCLOSES}' AND o_kind IN (0, 1)) GROUP BY child),
nodes AS (SELECT child node FROM links UNION SELECT parent FROM links),
tree AS (
  SELECT node, node root, 0 depth, node path FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, t.root, t.depth + 1, t.path || chr(10) || l.child FROM tree t JOIN links l ON l.parent = t.node)"""
_FOUND = f"WITH RECURSIVE {_LINKS} SELECT n.node, coalesce(t.root, '') root, CAST(coalesce(t.depth, -1) AS INTEGER) node_depth"
_NODES = "FROM nodes n LEFT JOIN tree t ON t.node = n.node"

_TRIM = "trim(o, ' ' || chr(9))"
_READ = f"""rows_read AS (
  SELECT q.s, a.p, a.col_name, q.quad_id, {_TRIM} v, q.o_kind = 2 AND CASE a.col_kind
    WHEN 'string' THEN {_TRIM} <> ''
    WHEN 'integer' THEN regexp_full_match({_TRIM}, '[+-]?[0-9]+')
    WHEN 'decimal' THEN regexp_full_match({_TRIM}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')
    WHEN 'date' THEN regexp_full_match({_TRIM}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {_TRIM} NOT LIKE '0000%' AND try_cast({_TRIM} AS DATE) IS NOT NULL
    ELSE lower({_TRIM}) IN ('true', 'false', '1', '0') END ok
  FROM quads q JOIN attribute_specs a ON a.p = q.p)"""
_COLS = {
    "name": "string", "pilot_code": "string", "berths": "integer", "keepers": "integer", "depth_metres": "decimal", "quay_length": "decimal", "opened": "date", "last_dredged": "date",
    "tidal": "boolean", "duty_free": "boolean", "motto": "string", "tonnage": "integer", "toll": "decimal", "surveyed": "date", "night_pilot": "boolean", "dial_code": "string",
}


def _wide_column(col: str, kind: str) -> str:
    v = f"max(v) FILTER (WHERE col_name = '{col}')"
    v = {"string": v, "integer": _number(v), "decimal": _number(v), "date": f"CAST(CAST({v} AS DATE) AS VARCHAR)", "boolean": f"lower({v}) IN ('true', '1')"}[kind]
    return f"{v} AS {col}"


def _number(v: str) -> str:
    """A readable number as shortest exact text."""
    whole, part = f"ltrim(regexp_extract({v}, '^[+-]?([0-9]*)', 1), '0')", f"rtrim(regexp_extract({v}, '[.]([0-9]*)$', 1), '0')"
    body = f"(CASE WHEN {whole} = '' THEN '0' ELSE {whole} END || CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END)"
    return f"CASE WHEN {v} LIKE '-%' AND {body} <> '0' THEN '-' ELSE '' END || {body}"


_ESC = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^uU])"
_IRI = rf"<(?:[^\x00-\x1f>\\]|{_ESC})*>"
_LET = r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}\x{0370}-\x{037D}\x{037F}-\x{1FFF}"
_QUO = rf'"(?:[^"\\]|{_ESC})*"' + rf"|'(?:[^'\\]|{_ESC})*'"
_TERMS = rf"{_IRI}|_:[{_LET}0-9_][{_LET}0-9_\x{{00B7}}\x{{0300}}-\x{{036F}}\-]*|({_QUO})(@[A-Za-z]+(-[A-Za-z0-9\-]*[A-Za-z0-9])?|\^\^{_IRI})?|(?s:.)"
_VALUE = {
    "integer": "regexp_full_match(v, '[+-]?[0-9]+')",
    "decimal": "regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')",
    "date": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND v NOT LIKE '0000%' AND try_cast(v AS DATE) IS NOT NULL",
    "boolean": "v IN ('true', 'false', '1', '0')",
}
_LINES = f"""WITH l AS (SELECT file_no, line_no, raw_line, regexp_replace(raw_line, '\\r\\z', '') t FROM tql_lines),
k AS (SELECT *, list_filter(regexp_extract_all(t, '{_TERMS.replace("'", "''")}'), lambda x: x <> ' ' AND x <> chr(9)) k FROM l),
f AS (SELECT *, array_to_string(list_transform(k, lambda x: CASE WHEN x = '.' THEN '.' WHEN length(x) < 2 THEN 'x' WHEN x[1] = '<' THEN 'i' WHEN x[1] = '_' THEN 'b' ELSE 'l' END), '') kinds,
  regexp_extract(k[3], '\\^\\^<xsd:(integer|decimal|date|boolean)>\\z', 1) dt, regexp_extract(k[3], '(?s)^.(.*).\\^\\^<xsd:[a-z]+>\\z', 1) v FROM k)
SELECT file_no, line_no FROM f WHERE raw_line IS NULL OR NOT (len(k) = 0 OR k[1] = '#' OR (regexp_full_match(kinds, '[ib]i[ibl][ib]?[.]')
  AND CASE dt {" ".join(f"WHEN '{d}' THEN {c}" for d, c in _VALUE.items())} ELSE true END))"""

_BN = rf"_:[{_LET}0-9_][{_LET}0-9_\x{{00B7}}\x{{0300}}-\x{{036F}}\-]*"
_GROUPS = (
    rf"(?s)^[ \t]*({_IRI}|{_BN})[ \t]*({_IRI})[ \t]*(?:(?:({_IRI})|({_QUO})(?:(@[A-Za-z]+(?:-[A-Za-z0-9\-]*[A-Za-z0-9])?)|\^\^({_IRI}))?)[ \t]*({_IRI}|{_BN})?"
    rf"|({_BN})(?:[ \t]*({_IRI})|[ \t]+({_BN}))?)[ \t]*\.[ \t]*\z"
)


def _plain(v: str, literal: bool) -> str:
    """Escapes resolved, in SQL."""
    named = "WHEN y[2] = 'n' THEN chr(10) WHEN y[2] = 't' THEN chr(9) WHEN y[2] = 'r' THEN chr(13) WHEN y[2] = 'b' THEN chr(8) WHEN y[2] = 'f' THEN chr(12) " if literal else ""
    return (
        f"CASE WHEN contains({v}, '\\') THEN array_to_string(list_transform(regexp_extract_all({v}, '(?s)\\\\u[0-9A-Fa-f]{{4}}|\\\\U[0-9A-Fa-f]{{8}}|\\\\.|[^\\\\]+'), "
        f"lambda y: CASE WHEN y[1] <> '\\' THEN y WHEN y[2] IN ('u', 'U') THEN chr(CAST('0x' || y[3:] AS INTEGER)) {named}ELSE y[2:] END), '') ELSE {v} END"
    )


_TERM_TEXT = lambda c: f"CASE WHEN {c}[1] = '<' THEN {_plain(f'{c}[2:-2]', False)} ELSE {c} END"
_QUADS = (
    "WITH bad AS (" + _LINES + "), m AS (SELECT file_no, line_no, regexp_extract(regexp_replace(raw_line, '\\r\\z', ''), '" + _GROUPS.replace("'", "''") + "', ['s', 'p', 'i', 'q', 'l', 'd', 'ga', 'b', 'gb', 'gc']) x "
    "FROM tql_lines ANTI JOIN bad USING (file_no, line_no)), y AS (SELECT file_no, line_no, x.s s, x.p p, x.i || x.b || x.q o, x.l l, x.d d, x.ga || x.gb || x.gc g FROM m WHERE x.p <> ''), "
    f"z AS (SELECT *, CASE WHEN g <> '' THEN {_TERM_TEXT('g')} END gt FROM y) "
    f"SELECT file_no, line_no, {_TERM_TEXT('s')} s, CAST(CASE WHEN s[1] = '<' THEN 0 ELSE 1 END AS TINYINT) s_kind, {_TERM_TEXT('p')} p, "
    f"CASE WHEN o[1] IN ('<', '_') THEN {_TERM_TEXT('o')} ELSE {_plain('o[2:-2]', True)} END o, CAST(CASE WHEN o[1] = '<' THEN 0 WHEN o[1] = '_' THEN 1 ELSE 2 END AS TINYINT) o_kind, "
    f"nullif(l[2:], '') o_lang, CASE WHEN d <> '' THEN {_TERM_TEXT('d')} END o_dt, CASE WHEN gt NOT IN ('sesame:nil', 'http://www.openrdf.org/schema/sesame#nil') THEN gt END g, "
    "CAST(CASE WHEN gt NOT IN ('sesame:nil', 'http://www.openrdf.org/schema/sesame#nil') THEN CASE WHEN g[1] = '<' THEN 0 ELSE 1 END END AS TINYINT) g_kind FROM z"
)

ORACLE = {
    "p6_quads": _QUADS,
    "p3_found": f"{_FOUND} {_NODES}",
    "p3_paths": f"{_FOUND}, t.path {_NODES}",
    "p3_cycles": f"WITH RECURSIVE {_LINKS} SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM tree)",
    "p3_descendants": f"WITH RECURSIVE {_LINKS}, up AS (SELECT parent ancestor, child node, 1 distance FROM links WHERE child IN (SELECT node FROM tree) "
    "UNION ALL SELECT l.parent, u.node, u.distance + 1 FROM up u JOIN links l ON l.child = u.ancestor) SELECT ancestor, node, CAST(distance AS INTEGER) distance FROM up",
    "p5_found": f"WITH {_READ} SELECT p, s FROM rows_read GROUP BY p, s HAVING NOT bool_or(ok)",
    "p5_wide": f"WITH {_READ}, best AS (SELECT s, col_name, max_by(v, quad_id) FILTER (WHERE ok) v FROM rows_read GROUP BY s, col_name) "
    f"SELECT s, {', '.join(_wide_column(c, k) for c, k in _COLS.items())} FROM best GROUP BY s",
    "p5_long_numbers": f"WITH planted AS (SELECT quad_id, s, p, o, o_kind FROM quads UNION ALL SELECT quad_id + 1000000000, s, '{DEF}toll', CASE quad_id % 300 WHEN 0 THEN '0.123456789012' "
    f"WHEN 100 THEN '-00' || repeat('123456789', 5) ELSE repeat('9', 30) || '.50000000000000000001' END, 2 FROM quads WHERE quad_id % 100 = 0), {_READ.replace('FROM quads q', 'FROM planted q')}, "
    f"best AS (SELECT s, max_by(v, quad_id) FILTER (WHERE ok) v FROM rows_read WHERE col_name = 'toll' GROUP BY s) SELECT s, {_number('v')} AS toll FROM best",
    "p6_found": _LINES,
    "p7_found": "WITH c AS (SELECT 'pred' field_name, pred code, count(*) n FROM coded_quads GROUP BY pred UNION ALL SELECT 'rec_type', rec_type, count(*) FROM stat_records "
    "WHERE rec_type IS NOT NULL GROUP BY rec_type) SELECT field_name, code FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) total FROM c) WHERE n * 20 >= total",
    "p7_counts": "SELECT 'pred' field_name, pred code, count(*) n_rows, count(DISTINCT subj) n_distinct FROM coded_quads GROUP BY pred "
    "UNION ALL SELECT 'rec_type', rec_type, count(*), count(DISTINCT lower(subject)) FROM stat_records WHERE rec_type IS NOT NULL GROUP BY rec_type",
    "p7_terms": "SELECT term, count(*) n_rows, count(DISTINCT subj) n_distinct FROM coded_quads JOIN dict_terms ON pred = code GROUP BY term",
}
