"""Fixpoints over binary relations: components for canonicalisation, transitive closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_join, hot_left_join
from quadrille.storage import Scratch


def component_labels(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) pairs to (node, label): equal labels for nodes linked directly or indirectly.

    Every round each node hooks to the least label around it and then jumps to its label's label,
    which halves the remaining distances; ends when no label changes.  The centre of a star and the label of a giant
    component are hot keys and handled apart.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, n = scratch.counted(both.where("a <> b").distinct(), hot="b")
    labels, mark, hot = scratch.marked(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "label")
    while mark[0]:
        around = hot_join(edges, labels.withColumnRenamed("node", "b"), "b", n["hot"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        # A root that sees a smaller label hands it to all that carry the root as label.
        hooked = scratch.table(labels.join(around, "node", "left").select("node", "label", F.least("label", "around").alias("least")))
        moved = hooked.groupBy("label").agg(F.min("least").alias("to"))
        step, _, hot = scratch.marked(hot_left_join(hooked, moved, "label", hot).select("node", F.least("least", "to").alias("label")), "label")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        before = mark
        new, mark, hot = scratch.marked(hot_left_join(step, jump, "label", hot).select("node", F.coalesce("further", "label").alias("label")), "label")
        scratch.drop(labels, hooked, step)
        labels = new
        if mark == before:
            break
    scratch.drop(edges)
    return labels


def transitive(pairs: DataFrame, scratch: Scratch, reflexive: bool = False) -> DataFrame:
    """(a, b) pairs to their transitive closure, semi-naively: a round joins only the pairs the last one found,
    with all known on either side, so paths of length up to 2^k are there after k rounds and no pair is joined twice."""
    delta = known = scratch.table(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    fresh = known.count()
    while fresh:
        ahead = delta.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        behind = known.alias("x").join(delta.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        new, n = scratch.counted(ahead.unionByName(behind).distinct().join(known, ["a", "b"], "left_anti"))
        fresh = n["rows"]
        if fresh:
            merged = scratch.table(known.unionByName(new))
            scratch.drop(known, delta)
            known, delta = merged, new
    if reflexive:
        ends = known.select("a").unionByName(known.select(F.col("b").alias("a")))
        return known.unionByName(ends.select("a", F.col("a").alias("b"))).distinct()
    return known
