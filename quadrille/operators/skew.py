"""Per-key results although a few keys hold most rows: aggregate before anything meets on one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import salted_join
from quadrille.storage import Scratch


def _same(a: str, b: str, names: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]


def eager_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str], by: Sequence[str] = (), sums: Sequence[str] = (), distinct: str | None = None, keep: Sequence[str] = (), sides: bool = False,
) -> DataFrame:
    """``left JOIN right ON left.a = right.b``, grouped, never joined row by row.

    Groups are the columns ``keep`` of left and ``by`` of right.  Result: these, n_rows (joined pairs), with
    ``sides`` also n_left and n_right (rows of either side that took part), sum_<c> for the columns ``sums`` of
    left, and n_distinct if ``distinct`` names a column of left.

    Both inputs are reduced by the join key before anything is shuffled: left to one state (count, sums) per
    key, ``keep`` and distinct value - spread evenly however unequal the keys are -, right to one count per
    key and ``by``.  The compact states are joined; a left count is multiplied by the right count, a left sum
    scaled by it, and the rest rolled up.  Distinct values of a group with one key are counted in its state;
    only where several keys meet in one group are the states' values joined, hot keys salted, and counted once.

    SQL's rules hold: null keys join nothing, null values are left out of sums and distinct counts,
    null group columns are a group; empty inputs give no rows; other columns may have any names.
    """
    a, b = on
    scratch = Scratch(left.sparkSession, "eager")
    mine, theirs = [f"keep_{i}" for i in range(len(keep))], [f"by_{i}" for i in range(len(by))]
    names = mine + theirs
    back = [F.col(n).alias(c) for n, c in zip(names, [*keep, *by])]
    right = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("key"), *[F.col(c).alias(n) for c, n in zip(by, theirs)]).agg(F.count(F.lit(1)).alias("right_n"))
    left = left.where(F.col(a).isNotNull()).select(
        F.col(a).alias("key"), *[F.col(c).alias(n) for c, n in zip(keep, mine)], *[F.col(c).alias(f"sum_{c}") for c in sums], *([F.col(distinct).alias("value")] if distinct else [])
    )
    state = left.groupBy("key", *mine, *(["value"] if distinct else [])).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums])
    if distinct:
        if a not in keep:
            state = scratch.table(state)
        total = [F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums], F.count("value").alias("values")]
        compact = state.groupBy("key", *mine).agg(*total)
    else:
        compact = state
    met = scratch.table(compact.join(right, "key"))
    out = met.groupBy(*names).agg(
        F.sum(F.col("n") * F.col("right_n")).alias("n_rows"), F.sum("n").alias("n_left"), F.sum("right_n").alias("n_right"),
        *[F.sum(F.col(f"sum_{c}") * F.col("right_n")).alias(f"sum_{c}") for c in sums], *([F.sum("values").alias("values"), F.count(F.lit(1)).alias("keys")] if distinct else []),
    )
    if not by and not keep:
        out = out.where("n_rows IS NOT NULL")
    cols = ["n_rows", *(["n_left", "n_right"] if sides else []), *[f"sum_{c}" for c in sums]]
    if not distinct:
        return out.select(*back, *cols)
    if a in keep:
        return out.select(*back, *cols, F.col("values").alias("n_distinct"))
    out = scratch.table(out)
    several = out.where("keys > 1").select(*names)
    if not several.limit(1).count():
        return out.select(*back, *cols, F.col("values").alias("n_distinct"))
    pairs = met.alias("m").join(several.alias("x"), _same("m", "x", names), "left_semi") if names else met
    pairs = pairs.select("key", *names)
    values = state.where("value IS NOT NULL").select("key", *[F.col(n).alias(f"own_{n}") for n in mine], "value")
    apart = salted_join(values, scratch.table(pairs), "key")
    for n in mine:
        apart = apart.where(F.col(n).eqNullSafe(F.col(f"own_{n}")))
    apart = apart.select(*names, "value").distinct().groupBy(*names).agg(F.count("value").alias("n_distinct"))
    both = out.alias("x").join(apart.alias("y"), _same("x", "y", names), "left") if names else out.alias("x").join(apart.alias("y"))
    count = F.when(F.col("keys") > 1, F.coalesce("n_distinct", F.lit(0))).otherwise(F.col("values"))
    return both.select(*[F.col(f"x.{n}").alias(c) for n, c in zip(names, [*keep, *by])], *cols, count.alias("n_distinct"))


def per_key(df: DataFrame, group: str, key: str, distinct: str) -> DataFrame:
    """(group, key, n_rows, n_distinct, group_rows): rows and distinct values per key, and all rows of its group.

    The rows of a key are joined with all rows of their group by :func:`eager_join`, so the share a key
    has comes out with its counts.  Null keys are a key of their own; null values count as rows only; a
    null group joins nothing; an empty table gives no rows.
    """
    out = eager_join(df.select(group, key, distinct), df.select(group), (group, group), keep=[group, key], distinct=distinct, sides=True)
    return out.select(group, key, F.col("n_left").alias("n_rows"), "n_distinct", F.col("n_right").alias("group_rows"))


def frequent(counts: DataFrame, part: int) -> DataFrame:
    """Rows of a :func:`per_key` result that hold at least 1/``part`` of their group's rows."""
    return counts.where(F.col("n_rows") * part >= F.col("group_rows"))
