"""Joins and exchanges in which a few keys hold most rows.

Hot keys are found by a frequent-items sketch that tasks build as they scan and that merges in one small
row: no shuffle and at most ``1/HOT_SHARE`` keys on the driver, whatever the size of the data.  A hot key
the sketch should miss makes a longer task, never another result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of all rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 256
#: Rows any task can take even if they all have one key: keys with fewer aren't hot.
LIGHT = 64
#: Entries of the sketch: counts are off by less than 1/2300 of all rows.
TRACKED = 8192
#: Rows that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Copies of the other side's rows of a hot key in a salted join.
SALTS = 64


def top_keys(key: Column | str) -> Column:
    """Aggregate: the sketch's most frequent keys with their counts, for :func:`hot_of`."""
    return F.call_function("approx_top_k", F.col(key) if isinstance(key, str) else key, F.lit(round(1 / HOT_SHARE)), F.lit(TRACKED))


def hot_of(top, n: int) -> list:
    """The hot keys among ``top`` of ``n`` rows; null is never hot."""
    return [x["item"] for x in top or [] if x["item"] is not None and x["count"] > max(LIGHT, n * HOT_SHARE)]


def hot_keys(df: DataFrame, key: Column | str) -> list:
    """The keys with more than ``HOT_SHARE`` of the rows of ``df``, by the sketch; null is never hot."""
    seen = df.agg(top_keys(key).alias("top"), F.count(F.lit(1)).alias("n")).first()
    return hot_of(seen["top"], seen["n"])


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique ``key``) on ``key`` without one task per hot key.

    The rows of ``right`` for the hot keys of ``left`` - at most 256 rows - are broadcast, so rows of hot keys are
    never shuffled; the rest is an ordinary join, as is the whole if no key is hot.  Null keys match
    nothing.  ``left`` is read up to three times, so let it be a table.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    head = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key)
    return head.unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


def salted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, repeated on both sides, without one task per hot key of ``left``.

    Rows of a hot key are spread over ``SALTS`` tasks, each of which gets the key's rows of ``right``; nothing is
    broadcast and nothing dropped.  Both sides are read twice, so let them be tables.
    """
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    spread = left.where(is_hot).withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int"))
    copies = right.where(is_hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = F.coalesce(~is_hot, F.lit(False))
    return spread.join(copies, [key, "salt"]).drop("salt").unionByName(left.where(rest).join(right.where(rest), key))


def hot_left_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """:func:`hot_join` that keeps the rows of ``left`` without a match, with nulls."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    head = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")
    return head.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, "left"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count finds at most ``rows`` rows; let it be a table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
