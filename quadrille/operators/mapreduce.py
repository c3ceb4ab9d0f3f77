"""Grouping statements by keys and reducing each group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import LITERAL, QUAD, SCHEMA, as_quads
from quadrille.operators.transform import predicate


def keys(mapper: str | Column | Sequence) -> Column:
    """Array of keys of a statement: ``e`` subject and resource object, one or more of ``spoc`` those
    components together, a column (or array column), or several mappers, whose keys are united.

    The default graph is a key of its own.
    """
    if isinstance(mapper, Column):
        return mapper
    if not isinstance(mapper, str):
        return reduce(F.array_union, [keys(m) for m in mapper])
    text = {"s": F.col("s"), "p": F.col("p"), "c": F.coalesce("g", F.lit("")), "o": F.concat_ws("\x1f", "o", F.col("o_kind").cast("string"), F.coalesce("o_lang", F.lit("")), F.coalesce("o_dt", F.lit("")))}
    if mapper == "e":
        o = F.when(F.col("o_kind") < LITERAL, F.array("s", "o")).otherwise(F.array("s"))
        return F.array_distinct(o)
    if not mapper or set(mapper) - set("spoc"):
        raise ValueError(f"unknown mapper {mapper!r}")
    if mapper == "o":  # a resource is one key, be it met as subject or object
        return F.array(F.when(F.col("o_kind") < LITERAL, F.col("o")).otherwise(text["o"]))
    return F.array(F.concat_ws("\x1e", *[text[c] for c in mapper]))


Reducer = Callable[[str, pd.DataFrame], pd.DataFrame]


def map_reduce(
    df: DataFrame, mapper: str | Column | Sequence, reducer: Reducer | None = None, exists: Column | str | None = None, forall: Column | str | None = None,
    bypass: Column | str | None = None, dedup: bool = False,
) -> DataFrame:
    """Map statements to keys, keep groups by ∃/∀ conditions, reduce them; bypassed statements go straight to the output.

    ``exists`` keeps a group if some member satisfies it, ``forall`` if all do: both are boolean
    aggregates, combined before the shuffle and joined back, so no group is ever gathered.  A statement
    with two keys comes out once per group it is kept in.  Only ``reducer`` - a function of
    (key, statements of the group) - needs whole groups; the function must be fit for its largest one.
    """
    column = lambda c: predicate(c) if isinstance(c, str) else c
    df, direct = as_quads(df), None
    if bypass is not None:
        direct = df.where(column(bypass))
        df = df.where(~F.coalesce(column(bypass), F.lit(False)))
    pairs = df.select(*QUAD, F.explode(keys(mapper)).alias("key"))
    if dedup:
        pairs = pairs.distinct()
    if exists is not None or forall is not None:
        some = F.bool_or(F.coalesce(column(exists), F.lit(False))) if exists is not None else F.lit(True)
        every = F.bool_and(F.coalesce(column(forall), F.lit(False))) if forall is not None else F.lit(True)
        kept = pairs.groupBy("key").agg(some.alias("some"), every.alias("every")).where("some AND every").select("key")
        pairs = pairs.join(kept, "key", "left_semi")
    if reducer is None:
        out = as_quads(pairs)
    else:
        out = pairs.groupBy("key").applyInPandas(lambda key, pdf: reducer(key[0], pdf.drop(columns="key"))[QUAD], SCHEMA)
    return out if direct is None else out.unionByName(direct)


def in_order(*reducers: Reducer) -> Reducer:
    """Apply reducers one after another to what the one before left."""

    def run(key: str, pdf: pd.DataFrame) -> pd.DataFrame:
        for r in reducers:
            pdf = r(key, pdf)
        return pdf

    return run
