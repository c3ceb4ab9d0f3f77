"""owl:sameAs canonicalisation, schema extraction, prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import FULL, IRI, LITERAL, NAMESPACES, QUAD, TBOX_CLASSES, TBOX_PROPERTIES, Vocabulary, as_quads, namespace, term_rank
from quadrille.operators.closure import component_labels
from quadrille.operators.hotjoin import BROADCAST_ROWS, hot_left_join
from quadrille.storage import Scratch



def same_as_link(vocab: Vocabulary = FULL) -> Column:
    return (F.col("p") == vocab("owl:sameAs")) & (F.col("o_kind") < LITERAL) & (F.col("s") != F.col("o"))


def canonical_terms(df: DataFrame, ranked: Sequence[str] = (), vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(term, canon, canon_kind) for the terms that have another canonical form: the first of their
    class in the term order (``ranked`` namespaces come first)."""
    scratch = Scratch(df.sparkSession, "smush")
    links = df.where(same_as_link(vocab)).select(F.col("s").alias("a"), F.col("s_kind").alias("a_kind"), F.col("o").alias("b"), F.col("o_kind").alias("b_kind"))
    labels = component_labels(links, scratch)
    kinds = links.select(F.col("a").alias("node"), F.col("a_kind").alias("kind")).unionByName(links.select(F.col("b").alias("node"), F.col("b_kind").alias("kind")))
    members = labels.join(kinds.groupBy("node").agg(F.min("kind").alias("kind")), "node")
    order = F.struct(*term_rank(F.col("node"), F.col("kind"), ranked, prefixes), F.col("node"))
    best = members.groupBy("label").agg(F.min_by(F.struct("node", "kind"), order).alias("best"))
    out = members.join(best, "label").where(F.col("node") != F.col("best.node"))
    return scratch.table(out.select(F.col("node").alias("term"), F.col("best.node").alias("canon"), F.col("best.kind").cast("tinyint").alias("canon_kind")))


def smush(df: DataFrame, ranked: Sequence[str] = (), vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Rewrite every term to the canonical term of its sameAs class; sameAs statements become
    ``canonical sameAs alias``, one for each rewritten end.

    Statements linking a term to itself and links without a rewritten end vanish; sameAs with a
    literal is an ordinary statement; duplicates are not removed.
    """
    df = as_quads(df)
    alias = canonical_terms(df, ranked, vocab, prefixes)
    scratch, out = Scratch(df.sparkSession, "smush"), df
    count = lambda table: table.limit(BROADCAST_ROWS + 1).count()
    many = count(alias) > BROADCAST_ROWS
    for col in ("p", "g", "s", "o"):
        table, n = alias, None
        if many and col in ("p", "g"):  # their few distinct values are looked up apart, whatever the number of aliases
            table = scratch.table(alias.join(df.select(F.col(col).alias("term")).distinct(), "term", "left_semi"))
            n = count(table)
        table = table.select(F.col("term").alias(col), F.col("canon").alias(f"{col}_canon"), F.col("canon_kind").alias(f"{col}_ck"))
        if col == "p":
            table = table.where(F.col("p_ck") == IRI)
        if not many or (n is not None and n <= BROADCAST_ROWS):
            out = out.join(F.broadcast(table), col, "left")
        else:  # beyond what may be broadcast: shuffled, hot terms apart
            out = hot_left_join(scratch.table(out), table, col)
    # A literal that reads like a term isn't one.
    literal = F.col("o_kind") == LITERAL
    out = out.withColumns({c: F.when(~literal, F.col(c)) for c in ("o_canon", "o_ck")})
    new = lambda c: F.coalesce(f"{c}_canon", c)
    kind = lambda c: F.coalesce(f"{c}_ck", f"{c}_kind")
    link = same_as_link(vocab) | ((F.col("p") == vocab("owl:sameAs")) & (F.col("o_kind") < LITERAL))
    graph = [new("g").alias("g"), kind("g").alias("g_kind")]
    plain = out.where(~link).select(new("s").alias("s"), kind("s").alias("s_kind"), new("p").alias("p"), new("o").alias("o"), kind("o").alias("o_kind"), "o_lang", "o_dt", *graph)
    ends = F.array(*[F.when(F.col(f"{c}_canon").isNotNull(), F.struct(F.col(f"{c}_canon").alias("to"), F.col(f"{c}_ck").alias("to_kind"), F.col(c).alias("of"), F.col(f"{c}_kind").alias("of_kind"))) for c in ("s", "o")])
    links = out.where(link & (F.col("s") != F.col("o"))).select("p", "o_lang", "o_dt", *graph, F.explode(F.array_compact(ends)).alias("e"))
    links = links.select(F.col("e.to").alias("s"), F.col("e.to_kind").alias("s_kind"), "p", F.col("e.of").alias("o"), F.col("e.of_kind").alias("o_kind"), "o_lang", "o_dt", "g", "g_kind")
    return plain.unionByName(links).select(*QUAD)


def is_tbox(vocab: Vocabulary = FULL) -> Column:
    classes, properties = [vocab(x) for x in TBOX_CLASSES], [vocab(x) for x in TBOX_PROPERTIES]
    return F.col("p").isin(properties) | ((F.col("p") == vocab("rdf:type")) & F.col("o").isin(classes) & (F.col("o_kind") == IRI))


def tbox(df: DataFrame, vocab: Vocabulary = FULL) -> DataFrame:
    """The statements that make up the schema."""
    return as_quads(df).where(is_tbox(vocab))


def vocabulary_use(df: DataFrame, vocab: Vocabulary = FULL) -> DataFrame:
    """(term, role, n, defined): classes and properties in use, and whether the schema defines them."""
    used = df.select(F.explode(F.array_compact(F.array(
        F.struct(F.col("p").alias("term"), F.lit("property").alias("role")),
        F.when((F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI), F.struct(F.col("o").alias("term"), F.lit("class").alias("role"))),
    ))).alias("x")).groupBy("x.term", "x.role").agg(F.count(F.lit(1)).alias("n"))
    known = tbox(df, vocab).select(F.col("s").alias("term")).distinct().withColumn("defined", F.lit(True))
    return used.join(known, "term", "left").withColumn("defined", F.coalesce("defined", F.lit(False)))


def used_namespaces(df: DataFrame) -> DataFrame:
    """(ns) of every IRI in s, p, o, g and literal datatypes, once."""
    col = lambda c, k: F.when(k, namespace(F.col(c)))
    terms = F.array(col("s", F.col("s_kind") == IRI), col("p", F.lit(True)), col("o", F.col("o_kind") == IRI), col("o_dt", F.lit(True)), col("g", F.col("g_kind") == IRI))
    return df.select(F.explode(F.array_distinct(F.array_compact(terms))).alias("ns")).where("ns <> ''").distinct()


def prefix_bindings(df: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """(prefix, ns) for the namespaces in use that the prefix table (prefix to namespace) knows."""
    spark = df.sparkSession
    rows = list((table or NAMESPACES).items())
    return F.broadcast(spark.createDataFrame(rows, "prefix string, ns string")).join(used_namespaces(df), "ns", "left_semi").select("prefix", "ns")


def read_prefix_file(text: str) -> dict[str, str]:
    """``ns prefix…`` lines to prefix -> namespace; the first entry of a prefix counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        ns, *names = line.split() or [""]
        for name in names if not ns.startswith("#") else ():
            out.setdefault(name, ns)
    return out
