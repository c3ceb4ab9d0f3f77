"""Distinct counts of huge identifier sets by mergeable bit matrices.

A sketch is a matrix of ``ROWS`` x ``RANKS`` bits.  The hash of an identifier picks a row
(stochastic averaging) and its trailing zeros a rank; that bit is set.  Repetition changes nothing and
the sketch of a union is the bitwise union, so sketches of days, groups or machines merge without loss.
A matrix is kept as one (group, row, bits) record per row that has a bit: sketching and
merging are then ``bit_or`` aggregations - combined before the shuffle, spread over ROWS keys a
group, so neither the size of a set nor a dominant group makes a long task.

The count is the maximum likelihood estimate: with n identifiers a bit of rank r stays clear with
probability exp(-n q_r), q_r = 2^-(r+1)/ROWS, so the column sums are all the likelihood needs.  The
inverse Fisher information, less the Poisson noise of n itself, gives the variance: a
relative standard error of about 0.65/sqrt(ROWS) for large sets and far less for small ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.storage import shared_folder, write_text

#: Rows of a matrix (a power of two below 2^16): relative standard error 1.01 %.
ROWS = 4096
#: Columns; the last takes all higher ranks.  Good for 2^40 x ROWS identifiers.
RANKS = 48
#: Half width of the reported interval in standard errors: 99.7 % coverage.
Z = 3.0


def md5_hash(value: Column) -> Column:
    """60 bits of MD5 as a number: slower, but every SQL engine has it."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def sketch(df: DataFrame, value: Column, by: dict[str, Column], rows: int = ROWS, hashed=F.xxhash64) -> DataFrame:
    """Partial result: (columns of ``by``, row, bits), one record per matrix row with a bit set.

    A null ``value`` sets no bit but keeps its group (row 0, no bits), so a group of nulls counts 0.
    ``by`` expressions may be null: null is a group of its own.  An empty table gives an empty sketch.
    """
    h = hashed(value)
    row = F.when(value.isNotNull(), h.bitwiseAND(rows - 1)).otherwise(0)
    high = F.shiftrightunsigned(h, int(np.log2(rows)))
    # The lowest set bit of the rest of the hash, itself the bit to set; capped at the last rank.
    low = high.bitwiseAND(-high)
    top = 1 << (RANKS - 1)
    bit = F.when(value.isNull(), F.lit(0)).when((low == 0) | (low > top), F.lit(top)).otherwise(low)
    df = df.select(*[c.alias(n) for n, c in by.items()], row.cast("int").alias("row"), bit.cast("long").alias("bits"))
    return df.groupBy(*by, "row").agg(F.bit_or("bits").alias("bits"))


def merge(*sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bitwise union of sketches, rolled up to the columns ``by``."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy(*by, "row").agg(F.bit_or("bits").alias("bits"))


def merge_sets(base: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Sketches of several grouping sets at once; ``grouped`` tells by ``dims`` order which hold.

    A dimension that a set leaves out is null in its records and not in ``grouped``, so a null value
    of a dimension and a total never mix.
    """
    plans = [F.struct(F.lit(",".join(d for d in dims if d in s)).alias("grouped"), *[(F.col(d) if d in s else F.when(F.lit(False), F.col(d))).alias(d) for d in dims]) for s in sets]
    flat = base.select(F.explode(F.array(*plans)).alias("x"), "row", "bits").select("x.*", "row", "bits")
    return flat.groupBy("grouped", *dims, "row").agg(F.bit_or("bits").alias("bits"))


def column_sums(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the number of rows that have each rank's bit, four 16-bit sums to a long."""
    packs = []
    for k in range(0, RANKS, 4):
        parts = [F.shiftleft(F.shiftright("bits", k + j).bitwiseAND(1), 16 * j) for j in range(4)]
        packs.append(F.sum(parts[0] + parts[1] + parts[2] + parts[3]).alias(f"pack_{k // 4}"))
    return sketches.groupBy(*by).agg(*packs).select(*by, F.array(*[f"pack_{k}" for k in range(RANKS // 4)]).alias("packs"))


def most_likely(sums: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors from column sums (groups x RANKS)."""
    rank = np.arange(1, RANKS + 1, dtype=float)
    rank[-1] = RANKS - 1  # the last column also takes all higher ranks
    q = np.exp2(-rank) / rows
    c = sums.astype(float)
    none = c.sum(axis=1) == 0
    lo, hi = np.full(len(c), -2.0), np.full(len(c), np.log(2.0) * (RANKS + np.log2(rows)))

    def slope(n: np.ndarray) -> np.ndarray:
        x = np.minimum(n[:, None] * q, 700)
        return (q * (c / -np.expm1(-x) - rows)).sum(axis=1)

    for _ in range(60):  # the score falls in n, so bisection on log n is safe
        mid = (lo + hi) / 2
        up = slope(np.exp(mid)) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    n = np.where(none, 0.0, np.exp((lo + hi) / 2))
    x = np.clip(n[:, None] * q, 1e-300, 700)
    info = (rows * q * q * np.exp(-x) / -np.expm1(-x)).sum(axis=1)
    var = np.where(none, 0.0, np.maximum(1 / np.maximum(info, 1e-300) - n, n * n / (6 * rows)))
    return n, np.sqrt(var)


def estimate(sketches: DataFrame, by: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(columns of ``by``, bits_set, estimate, std_error, low, high) per group.

    ``low`` and ``high`` are the estimate -/+ ``Z`` standard errors widened by one; the number of bits
    set is a certain lower bound and so is never undercut.
    """
    packed = column_sums(sketches, by)
    fields = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in by), "bits_set long, estimate double, std_error double, low double, high double"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packs = np.array(pdf["packs"].tolist(), dtype=np.int64).reshape(-1, RANKS // 4)
            sums = ((packs[:, :, None] >> np.array([0, 16, 32, 48])) & 0xFFFF).reshape(-1, RANKS)
            n, se = most_likely(sums, rows)
            out = pdf[list(by)].copy()
            out["bits_set"] = sums.sum(axis=1)
            out["estimate"], out["std_error"] = n, se
            out["low"] = np.maximum(out["bits_set"], np.floor(n - Z * se) - (n > 0))
            out["high"] = np.ceil(n + Z * se) + (n > 0)
            yield out

    return packed.mapInPandas(finish, schema)


def day_partials(records: DataFrame, rows: int = ROWS, hashed=F.xxhash64) -> DataFrame:
    """The storable daily sketches of (day, predicate, rec_type); letter case of subjects is ignored."""
    by = {"day": F.to_date("seen_at"), "predicate": F.col("predicate"), "rec_type": F.col("rec_type")}
    return sketch(records, F.lower("subject"), by, rows, hashed)


DIMS = ("day", "predicate", "rec_type")


class PartialStore:
    """Day sketches kept in a folder: batches are appended as they come in, later rows of a day included.

    Each batch is written once, by day, and never changed; sketches of one group from several batches merge by
    bitwise union whenever they are read, so appending the same records twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = ROWS, hashed=F.xxhash64):
        self.spark, self.rows, self.hashed = spark, rows, hashed
        self.path = path or f"{shared_folder(spark)}/partials-{uuid.uuid4().hex}"
        if path is None:
            write_text(spark, f"{self.path}/.begun", "", remove_at_exit=self.path)

    def append(self, records: DataFrame) -> None:
        """Sketch ``records`` - any days, any number of times - and add the sketches to the folder."""
        parts = day_partials(records, self.rows, self.hashed)
        # One file a day as long as it is small; adaptive execution cuts days that are large.
        parts.hint("rebalance", "day").withColumn("on", F.col("day").cast("string")).write.mode("append").partitionBy("on").parquet(self.path)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(day, predicate, rec_type, row, bits) of the days from ``first`` to ``last``: only their folders are read."""
        out = self.spark.read.schema("day DATE, predicate INT, rec_type INT, `row` INT, bits BIGINT, `on` STRING").parquet(self.path)
        for bound, keep in ((first, F.col("on") >= first), (last, F.col("on") <= last)):
            out = out if bound is None else out.where(keep)
        return out.drop("on")


def all_groups(partials: DataFrame) -> DataFrame:
    """Sketches of every combination of day, predicate and record type, totals included.

    First the four combinations within each day, then each of those merged over the days: a day's
    partial result is read once and the second step works on sketches only.
    """
    inner = [s for k in range(3) for s in combinations(DIMS[1:], k)]
    daily = merge_sets(partials, DIMS, [("day", *s) for s in inner])
    # A (day, …) sketch also belongs to the same combination without the day.
    over = F.explode(F.array(F.struct(F.lit(True).alias("by_day"), F.col("day")), F.struct(F.lit(False).alias("by_day"), F.lit(None).cast("date").alias("day"))))
    both = daily.select("grouped", "predicate", "rec_type", "row", "bits", over.alias("x")).select(
        F.when(F.col("x.by_day"), F.col("grouped")).otherwise(F.regexp_replace("grouped", "^day,?", "")).alias("grouped"), "x.day", "predicate", "rec_type", "row", "bits"
    )
    return both.groupBy("grouped", *DIMS, "row").agg(F.bit_or("bits").alias("bits"))


def distinct_counts(records: DataFrame, rows: int = ROWS) -> DataFrame:
    """Estimated distinct subjects with error bounds for all combinations of day, predicate, type."""
    return estimate(all_groups(day_partials(records, rows)), ["grouped", *DIMS], rows)


def counts_with_partials(store: PartialStore) -> DataFrame:
    """The counts of all groups and, next to them, the partial results they were merged from.

    (grouped, day, predicate, rec_type, bits_set, estimate, std_error, low, high, row, bits): rows with an
    estimate are counts; rows with ``bits`` are the stored day sketches, to be merged by bitwise union with those
    of other days or other machines.
    """
    partials = store.read()
    counts = estimate(all_groups(partials), ["grouped", *DIMS], store.rows)
    return counts.unionByName(merge(partials, by=DIMS).withColumn("grouped", F.lit(",".join(DIMS))), allowMissingColumns=True)
