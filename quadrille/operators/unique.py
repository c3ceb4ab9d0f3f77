"""Duplicate elimination and fusion of equal statements across graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import IRI, QUAD, TRIPLE, as_quads, namespace


def unique(df: DataFrame) -> DataFrame:
    """Each statement once; context counts, nulls are equal."""
    return as_quads(df).distinct()


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a set of strings, from its least and greatest member."""
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    return F.substring(low, F.lit(1), F.array_max(same))


def fused(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements with their fusion state, held back descriptions, distinct statements)."""
    base = unique(df)
    graphs = base.where("g IS NOT NULL").select(F.col("g").alias("s")).distinct()
    held = base.join(graphs, "s", "left_semi").select(*QUAD)
    free = base.join(graphs, "s", "left_anti").select(*QUAD)
    # Order-free, mergeable states instead of lists of graphs: a statement may stand in very many.
    state = free.groupBy(*TRIPLE).agg(
        F.count("g").alias("n"), F.bool_or(F.col("g").isNull()).alias("in_default"), F.min("g").alias("g"), F.min("g_kind").alias("g_kind"),
        F.bit_xor(F.xxhash64("g")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("fusion"), F.col("g"))).alias("h2"),
        F.min(namespace(F.col("g"))).alias("ns_low"), F.max(namespace(F.col("g"))).alias("ns_high"),
    )
    return state, held, free


def fusion_graph() -> Column:
    """Name of the graph that stands for a set of graphs."""
    ns = common_prefix(F.col("ns_low"), F.col("ns_high"))
    ns = F.when(ns == "", "urn:graph:").when(ns.rlike(r"[/#:]\z"), ns).otherwise(F.concat(ns, F.lit("/")))
    return F.concat(ns, F.lower(F.hex("h1")), F.lower(F.hex("h2")))


def unique_merge(df: DataFrame) -> DataFrame:
    """Merge equal triples of several graphs into one statement.

    A statement that is also in the default graph stays there alone; one in a single graph
    stays as it is; one in several goes to a fusion graph named after the set of its graphs.
    Statements about graphs are not merged; those about the sources of a fusion graph are copied
    with the fusion graph as subject, in their own context, each triple once (least context).
    An empty input gives nothing; extra columns are dropped.
    """
    state, held, free = fused(df)
    many = ~F.col("in_default") & (F.col("n") > 1)
    named = state.withColumn("fusion", F.when(many, fusion_graph()))
    g = F.when(F.col("in_default"), F.lit(None)).otherwise(F.coalesce("fusion", "g"))
    kind = F.when(F.col("in_default"), F.lit(None)).when(many, F.lit(IRI)).otherwise(F.col("g_kind"))
    merged = named.select(*TRIPLE, g.alias("g"), kind.cast("tinyint").alias("g_kind"))
    # Which graphs went into which: only for graphs that are described at all.
    described = free.join(held.select(F.col("s").alias("g")).distinct(), "g", "left_semi")
    on = [described[c].eqNullSafe(named[c]) for c in TRIPLE]
    sources = described.join(named.where("fusion IS NOT NULL"), on).select(described["g"].alias("s"), "fusion").distinct()
    copies = held.join(sources, "s").groupBy("fusion", *TRIPLE[2:]).agg(F.min(F.struct("g", "g_kind")).alias("at"))
    copies = copies.select(F.col("fusion").alias("s"), F.lit(IRI).cast("tinyint").alias("s_kind"), *TRIPLE[2:], F.col("at.g").alias("g"), F.col("at.g_kind").alias("g_kind"))
    return merged.unionByName(held).unionByName(copies)
