"""The eleven set operators over statement bags, context included.

Each needs the multiplicity of every distinct statement in every branch: the branches are
reduced to counts before one shuffle, the operator is a column formula over the counts, and a result
multiplicity above one is unfolded at the end.  Nulls equal nulls.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import QUAD, as_quads, bag_union, nothing


def formula(op: str, m: Sequence[Column]) -> Column:
    """Multiplicity of the result from the branches' multiplicities."""
    zero = F.lit(0)
    total = reduce(lambda a, b: a + b, m)
    present = reduce(lambda a, b: a + b, [F.when(x > 0, 1).otherwise(0) for x in m])
    most = F.greatest(*m) if len(m) > 1 else m[0]
    least = F.least(*m) if len(m) > 1 else m[0]
    rest = reduce(lambda a, b: a + b, m[1:]) if len(m) > 1 else zero
    one = lambda c: F.when(c, 1).otherwise(0)
    if op == "a":
        return total
    if op == "u":
        return one(total > 0)
    if op == "U":
        return most
    if op == "i":
        return one(least > 0)
    if op == "I":
        return least
    if op == "d":
        return one((m[0] > 0) & (rest == 0))
    if op == "D":
        return F.greatest(zero, m[0] - rest)
    if op == "s":
        return one((present > 0) & (present < len(m)))
    if op == "S":
        return most - least
    if x := re.fullmatch(r"(\d+)\+", op):  # in at least n branches
        return one(present >= int(x[1]))
    if x := re.fullmatch(r"(\d+)-", op):  # at most n times in all
        return one(total <= int(x[1]))
    raise ValueError(f"unknown set operator {op!r}")


def combine(op: str, branches: Sequence[DataFrame]) -> DataFrame:
    """Merge branches: a sum, u/U union, i/I intersection, d/D difference, s/S symmetric difference
    (capitals keep multiplicities), ``n+`` in at least n branches, ``n-`` at most n times in all.

    No branch is an error; empty branches count as zero multiplicities.
    """
    if not branches:
        raise ValueError("no branches")
    if op == "a":
        return bag_union(*branches)
    if op == "u":
        return bag_union(*branches).distinct()
    slots = [f"m{i}" for i in range(len(branches))]
    flat = [
        as_quads(b).select(*QUAD, *[F.lit(int(i == k)).alias(n) for k, n in enumerate(slots)]) for i, b in enumerate(branches)
    ]
    counts = reduce(DataFrame.unionByName, flat).groupBy(*QUAD).agg(*[F.sum(n).alias(n) for n in slots])
    out = counts.select(*QUAD, formula(op, [F.col(n) for n in slots]).cast("int").alias("times")).where("times > 0")
    if op in ("U", "I", "D", "S"):
        return out.select(*QUAD, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
    return out.drop("times")


def check(op: str) -> str:
    """The operator's name, or an error for a name that isn't one."""
    formula(op, [F.lit(1), F.lit(1)])
    return op


def inject(df: DataFrame, *sources: DataFrame) -> DataFrame:
    return bag_union(df, *sources)


__all__ = ["combine", "formula", "check", "inject", "nothing"]
