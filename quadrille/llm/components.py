"""Consolidating pairwise matches into groups by alternating large-star and small-star.

Links are kept as rows (hi, lo), hi > lo.  A large-star step points every larger neighbour of a node at
the least node around it, a small-star step every smaller one; the two keep the components as
they are and end when nothing changes, with every node linked to the least node of its component.
Each step is one map-side combined minimum per node and one join, in which a node with a large
share of all links - the centre of a giant group becomes one - is handled apart (``hot_join``).
The driver sees one row of checksums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_join
from quadrille.storage import Scratch, fingerprint


def _least(rows: DataFrame, node: str, other: str) -> DataFrame:
    return rows.groupBy(F.col(node).alias("key")).agg(F.min(other).alias("least"))


def large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(hi, lo) links to the same components: each node's larger neighbours move to its least one."""
    both = links.select(F.explode(F.array(F.struct(F.col("hi").alias("key"), F.col("lo").alias("near")), F.struct(F.col("lo").alias("key"), F.col("hi").alias("near")))).alias("x")).select("x.*")
    least = scratch.table(_least(both, "key", "near").withColumn("least", F.least("key", "least")))
    # Only larger neighbours move, so the join needs each link once, from its smaller end.
    out = hot_join(links.withColumnRenamed("lo", "key"), least, "key")
    return out.select("hi", F.col("least").alias("lo")).distinct()


def small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(hi, lo) links to the same components: each node and its smaller neighbours move to the least."""
    least = scratch.table(_least(links, "hi", "lo"))
    out = hot_join(links.withColumnRenamed("hi", "key"), least, "key")
    moved = out.where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select(F.col("key").alias("hi"), F.col("least").alias("lo"))).distinct()


def numbered(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, id) for the terms in links: ids are in the order of the terms, so least id is least term."""
    terms = links.select(F.explode(F.array("hi", "lo")).alias("term")).distinct()
    return scratch.table(terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("id", F.monotonically_increasing_id()))


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs to (member, rep): ``rep`` is the least member of the group, for all other members.

    Direction and repetition don't matter; null ends and self-links are ignored (a node only linked to
    itself is in no group); order is by code point for strings; extra columns are ignored; no pairs
    give no rows.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    named = scratch.table(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    # The rounds work on numbers in the order of the terms instead of the terms themselves.
    terms, links = numbered(named, scratch), named
    for col in ("hi", "lo"):
        table = terms.select(F.col("term").alias(col), F.col("id").alias("number"))
        links = scratch.table(hot_join(links, table, col).drop(col).withColumnRenamed("number", col))
    links = links.select("hi", "lo")
    mark = fingerprint(links)
    while mark[0]:
        mid = scratch.table(large_star(links, scratch))
        new = scratch.table(small_star(mid, scratch))
        scratch.keep_only(new, terms)
        before, mark, links = mark, fingerprint(new), new
        if mark == before:
            break
    reps = hot_join(links, terms.select(F.col("id").alias("lo"), F.col("term").alias("rep")), "lo")
    return reps.join(terms.select(F.col("id").alias("hi"), F.col("term").alias("member")), "hi").select("member", "rep")
