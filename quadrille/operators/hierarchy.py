"""Parent-child links to full hierarchies by tree contraction.

Every round rakes all leaves and splices an independent set of the nodes that have exactly one
child, so bushy trees and long chains both shrink by a constant factor a round: the number of rounds
is logarithmic in the number of nodes, not proportional to the depth.  What a round takes away is
recorded with the node it hangs from; reading the records backwards from the roots recovers root,
depth and path of every node.  A cycle is never raked: splicing shrinks it to a self-loop, which
marks its nodes and all below them as never reaching a root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_join
from quadrille.storage import Scratch

#: Tables of resolved nodes before they are merged.
MANY = 6


def clean_links(links: DataFrame) -> DataFrame:
    """Distinct (child, parent) without nulls; of several parents of a child the smallest one."""
    return links.where("child IS NOT NULL AND parent IS NOT NULL").groupBy("child").agg(F.min("parent").alias("parent"))


def resolve_hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """(child, parent) rows to one row per node: (node, root, node_depth[, path]).

    ``root`` is the last node on the way up and ``node_depth`` the number of links to it; a root has
    itself and 0.  Nodes whose way up runs into a cycle (self-links included) have root '' and depth
    -1; their path is null.  ``path`` lists the nodes from the root down to the node itself.
    Null ends are ignored, repeated links count once, a child with several parents keeps the smallest
    (code point order); extra columns are ignored; no links give an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    via = F.array().cast("array<string>") if with_paths else F.lit(None).cast("array<string>")
    links = links.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))
    base = scratch.table(clean_links(links))
    loops = [base.where("child = parent").select(F.col("child").alias("node"))]
    edges = scratch.table(base.where("child <> parent").select("child", "parent", F.lit(1).cast("long").alias("hops"), via.alias("via")))
    rounds: list[tuple[DataFrame, dict]] = []
    while True:
        kids = edges.groupBy(F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("kids"), F.min("child").alias("only"))
        turn = len(rounds)
        order = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        splice = (F.col("kids") == 1) & (F.col("only") != F.col("parent")) & (order("child") < order("parent")) & (order("child") < order("only"))
        # A two-node cycle has only == parent; it is spliced by plain order.
        pair = (F.col("kids") == 1) & (F.col("only") == F.col("parent")) & (F.col("child") < F.col("parent"))
        act = F.when(F.col("kids").isNull(), "rake").when(splice | pair, "splice").otherwise("stay")
        is_ = lambda a: F.col("act") == a
        seen, n = scratch.counted(edges.join(kids, "child", "left").withColumn("act", act), hot="parent", rake=is_("rake"), splice=is_("splice"))
        if not n["rows"]:
            break
        rounds.append((seen, n))
        gone = seen.where("act = 'splice'")
        # Both sides hold each child once: the only child of a spliced node moves to that node's parent.
        moved = gone.select(
            F.col("only").alias("child"), F.col("child").alias("mid"), F.col("parent").alias("up"), F.col("hops").alias("up_hops"), F.col("via").alias("up_via")
        )
        nxt = seen.where("act = 'stay'").select("child", "parent", "hops", "via").join(moved, "child", "left")
        nxt = scratch.table(
            nxt.select(
                "child",
                F.coalesce("up", "parent").alias("parent"),
                (F.col("hops") + F.coalesce("up_hops", F.lit(0))).alias("hops"),
                (F.when(F.col("mid").isNull(), F.col("via")).otherwise(F.concat("up_via", F.array("mid"), "via")) if with_paths else F.col("via")).alias("via"),
            )
        )
        if n["splice"]:  # only splicing closes a cycle
            loops.append(nxt.where("child = parent").select(F.col("child").alias("node")))
        edges = nxt.where("child <> parent")
    # Roots: ends of links that are nobody's child, and what is left of each cycle.
    tops = base.select(F.col("parent").alias("node")).distinct().join(base.select(F.col("child").alias("node")), "node", "left_anti")
    cyclic = reduce(DataFrame.unionByName, loops).distinct()
    start = lambda df, root, depth: df.select("node", root.alias("root"), F.lit(depth).cast("long").alias("node_depth"), (F.array("node") if with_paths and depth == 0 else F.lit(None).cast("array<string>")).alias("path"))
    known = [scratch.table(start(tops, F.col("node"), 0).unionByName(start(cyclic, F.lit(""), -1)))]

    def hang(rows: DataFrame, hot: list) -> None:
        """Resolve recorded rows from the nodes they hang from."""
        up = reduce(DataFrame.unionByName, known).select(F.col("node").alias("parent"), "root", "node_depth", "path")
        rows = rows.select("child", "parent", "hops", "via")
        out = hot_join(rows, up, "parent", hot)
        depth = F.when(F.col("node_depth") < 0, F.lit(-1)).otherwise(F.col("node_depth") + F.col("hops"))
        path = F.concat("path", "via", F.array("child")) if with_paths else F.col("path")
        known.append(scratch.table(out.select(F.col("child").alias("node"), "root", depth.cast("long").alias("node_depth"), path.alias("path"))))
        if len(known) > MANY:  # later rounds hold more nodes, so merging the earlier ones stays cheap
            old = known[:]
            known[:] = [scratch.table(reduce(DataFrame.unionByName, old))]
            scratch.drop(*old)

    for seen, n in reversed(rounds):
        for act in ("splice", "rake"):
            if n[act]:
                hang(seen.where(F.col("act") == act), n["hot"])
        scratch.drop(seen)
    scratch.keep_only(*known)
    out = reduce(DataFrame.unionByName, known).withColumn("node_depth", F.col("node_depth").cast("int"))
    return out if with_paths else out.drop("path")


def descendants(nodes: DataFrame) -> DataFrame:
    """(node, path, …) from :func:`resolve_hierarchy` to one row per pair (ancestor, node, distance).

    Pairs instead of lists: the descendants of one node may be a large part of all nodes and would not
    fit one row.  Nodes on or below a cycle have no path and give no pair.
    """
    at = nodes.where("path IS NOT NULL AND node_depth > 0").select(
        "node", "node_depth", F.posexplode(F.slice("path", F.lit(1), F.col("node_depth"))).alias("level", "ancestor")
    )
    return at.select("ancestor", "node", (F.col("node_depth") - F.col("level")).cast("int").alias("distance"))
