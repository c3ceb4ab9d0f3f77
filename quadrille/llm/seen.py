"""Has this key been seen before?  A log-structured store of key hashes in sorted runs.

A store is a folder that can be left and reopened.  Keys that came in are kept as immutable runs of distinct
keys.  A run is cut into blocks by ranges of the hash - one Parquet file a block, sorted by hash and
key - and the manifest keeps the least and greatest hash of each block as fences.  Runs are levelled: when
a level has ``FANOUT`` runs, the next probe first merges them into one run of the next level, so a store
of N keys has O(log N) runs.

A batch is range-partitioned the same way once, sorted once and merge joined with each run; a block that no
hash of the batch falls into is not read.  Runs are read in the order they were written in: neither a
probe nor a merge sorts or shuffles what the store holds, and no key set is ever held in memory.  The hash
orders and prunes; a hit counts only if the full key agrees, so answers carry no hash error.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_keys
from quadrille.storage import Scratch, read_text, remove, shared_folder, write_text

#: Runs of one level before they are merged into the next.
FANOUT = 2
#: Batches a bounded table is fed in by default, in order of arrival.
BATCHES = 4
#: Rows a block from which on a batch is taken to reach every block, so that its fences aren't worth a look.
DENSE = 16
#: What a null position sorts as: before everything else.
FIRST = -(1 << 63)
#: Codes of the default graph, or rows of hot keys, that are handled as literals or broadcast; more are joined.
FEW = 1000
#: Keys whose rows ``n_checked`` of :func:`error_rate` counts: those whose MD5 ends in this digit, a sixteenth of all.
CHECKED = "0"


@contextmanager
def _runs_as_written(spark: SparkSession) -> Iterator[None]:
    """Within it scans of runs report their order, blocks alone co-partition joins, and rows are written as they come."""
    wanted = {
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.maxConcurrentOutputFileWriters": "8",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def key_text(keys: Sequence[Column]) -> Column:
    """One text per key: its parts, nulls as ``~``, with bars between them."""
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys])


def md5_hash(keys: Sequence[Column]) -> Column:
    """60 bits of MD5 in the high bits of a long: slower, but every SQL engine has it."""
    return F.shiftleft(F.conv(F.substring(F.md5(key_text(keys)), 1, 15), 16, 10).cast("long"), 4)


class SeenStore:
    """Levelled sorted runs of distinct keys in the folder ``path``: reopened if it holds a store, else begun.

    ``kinds`` are the types of the key columns.  ``blocks`` is how many ranges the hashes are cut into,
    ``hash_bits`` how many bits order the keys; both stay as they were when the store was begun.
    """

    def __init__(self, spark: SparkSession, path: str, kinds: Sequence[str], blocks: int | None = None, hash_bits: int = 64, hashed=None):
        self.spark, self.path, self.hashed = spark, path.rstrip("/"), hashed or (lambda keys: F.xxhash64(*keys, F.concat_ws("", *[k.isNull().cast("string") for k in keys])))
        held = read_text(spark, f"{self.path}/manifest.json")
        self.state = json.loads(held) if held else {
            "kinds": list(kinds), "blocks": blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), "hash_bits": hash_bits, "runs": []
        }
        if self.state["kinds"] != list(kinds):
            raise ValueError(f"the store holds keys of {self.state['kinds']}, not {list(kinds)}")
        self.blocks, self.hash_bits = self.state["blocks"], self.state["hash_bits"]
        self.keys = [f"k{i}" for i in range(len(kinds))]
        self.cols = ["block", "h", *self.keys, "nulls"]
        self.scratch = Scratch(spark, "seen")
        # Files are laid out by the engine's bucket of a number: for each bucket one number that falls into it.
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(self.blocks))
        of = spark.range(self.blocks * 40 + 400).groupBy(bucket.alias("b")).agg(F.min("id").alias("id")).orderBy("b").collect()
        if len(of) != self.blocks:
            raise RuntimeError("no number found for some block")
        self.labels = [int(r["id"]) for r in of]

    # -- runs --------------------------------------------------------------------------------------

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))

    def _schema(self) -> str:
        return "block INT, h BIGINT, " + ", ".join(f"{k} {kind}" for k, kind in zip(self.keys, self.state["kinds"])) + ", nulls INT"

    def _write(self, rows: DataFrame, split: str | None = None) -> str:
        """Write block by block in the order the rows come in; the folder's name."""
        name = f"run-{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.blocks, "block").option("path", f"{self.path}/{name}").format("parquet")
        table = "w_" + uuid.uuid4().hex
        (writer.partitionBy(split) if split else writer).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return name

    @staticmethod
    def _table(entry: dict) -> str:
        return "r_" + re.sub(r"\W", "_", entry["name"])

    def run(self, entry: dict) -> DataFrame:
        """One run as a table whose blocks and order the planner knows."""
        table = self._table(entry)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} ({self._schema()}) USING parquet CLUSTERED BY (block) SORTED BY ({', '.join(self.cols)}) INTO {self.blocks} BUCKETS LOCATION '{self.path}/{entry['name']}'"
            )
        return self.spark.table(table)

    def runs(self) -> list[DataFrame]:
        return [self.run(e) for e in self.state["runs"]]

    def _enter(self, name: str, level: int) -> None:
        """Put a written run into the manifest with its fences: least and greatest hash and rows of each block."""
        entry = {"name": name, "level": level}
        found = self.run(entry).groupBy("block").agg(F.min("h"), F.max("h"), F.count(F.lit(1))).collect()
        entry["fences"] = {str(r[0]): [r[1], r[2]] for r in found}
        entry["rows"] = sum(r[3] for r in found)
        if entry["rows"]:
            self.state["runs"].append(entry)

    def compact(self) -> None:
        """Merge the runs of every full level into one run of the next.

        Runs share no key, so a full outer merge join of two is their sorted union: it runs block by block,
        and nothing is shuffled or sorted.
        """
        level = 0
        while level <= max((e["level"] for e in self.state["runs"]), default=-1):
            full = [e for e in self.state["runs"] if e["level"] == level]
            while len(full) >= FANOUT:
                a, b = full.pop(0), full.pop(0)
                with _runs_as_written(self.spark):
                    merged = self.run(a).withColumn("a", F.lit(1)).join(self.run(b).withColumn("b", F.lit(1)).hint("merge"), self.cols, "full_outer").select(*self.cols)
                    name = self._write(merged)
                    self._enter(name, level + 1)
                self.state["runs"] = [e for e in self.state["runs"] if e not in (a, b)]
                self._save()
                for e in (a, b):
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._table(e)}")
                    remove(self.spark, f"{self.path}/{e['name']}")
            level += 1

    # -- batches -----------------------------------------------------------------------------------

    def prepare(self, rows: DataFrame, keys: Sequence[Column], position: Column) -> DataFrame:
        """(block, h, k0…, nulls, pos, whole): null parts become a neutral value plus a bit in ``nulls``, so that
        null equals null and nothing else; ``whole`` is the hash with all its bits."""
        blank = lambda kind: F.lit("") if kind == "string" else F.lit(0).cast(kind)
        parts = [F.coalesce(k.cast(kind), blank(kind)).alias(f"k{i}") for i, (k, kind) in enumerate(zip(keys, self.state["kinds"]))]
        nulls = reduce(lambda a, b: a + b, [F.when(k.isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)])
        out = rows.select(*parts, nulls.cast("int").alias("nulls"), F.coalesce(position.cast("long"), F.lit(FIRST)).alias("pos"), self.hashed(keys).alias("whole"))
        # The range: the hash's high 31 bits, in the order of the signed number, scaled to the number of blocks.
        high = F.shiftrightunsigned(F.col("whole").bitwiseXOR(F.lit(FIRST)), 33)
        at = F.shiftright(high * F.lit(self.blocks), 31).cast("int")
        h = F.shiftright("whole", 64 - self.hash_bits) if self.hash_bits < 64 else F.col("whole")
        return out.select(F.element_at(F.array(*[F.lit(x) for x in self.labels]), at + 1).alias("block"), h.alias("h"), *self.keys, "nulls", "pos", "whole")

    def _within(self, entry: dict, reach: dict[str, list[int]] | None) -> DataFrame | None:
        """A run without the blocks, and the hashes at either end, that a batch doesn't reach; None if none is left."""
        run = self.run(entry)
        if reach is None:
            return run
        both = [b for b, (lo, hi) in entry["fences"].items() if b in reach and reach[b][0] <= hi and reach[b][1] >= lo]
        if not both:
            return None
        low, high = min(reach[b][0] for b in both), max(reach[b][1] for b in both)
        return run.where(F.col("block").isin([int(b) for b in both]) & F.col("h").between(low, high))

    def probe(self, batch: DataFrame, add: bool = True) -> DataFrame:
        """(pos) of the rows of ``batch``, a frame of :meth:`prepare`, whose key the store holds or an earlier
        position of the batch has; the keys the store lacked are added as a run.

        Rows of one key on one position aren't earlier than each other.  Rows of a hot key never meet
        in one task: its first position is found by an aggregation that combines before the shuffle, goes through the
        store alone, and its rows get their answers from it.
        """
        self.compact()
        size = batch.agg(F.count(F.lit(1))).first()[0] if self.state["runs"] else None
        reach = None
        if size is not None and size < DENSE * self.blocks:
            reach = {str(r[0]): [r[1], r[2]] for r in batch.groupBy("block").agg(F.min("h"), F.max("h")).collect()}
        hot = hot_keys(batch, "whole")
        is_hot, answers = F.col("whole").isin(hot), []
        feed = batch.select(*self.cols, "pos", F.lit(False).alias("lone"))
        if hot:
            heads = self.scratch.table(batch.where(is_hot).groupBy(*self.cols).agg(F.min("pos").alias("pos")))
            feed = batch.where(~is_hot).select(*self.cols, "pos", F.lit(False).alias("lone")).unionByName(heads.withColumn("lone", F.lit(True)))
        key = Window.partitionBy(*self.cols).orderBy("pos")
        rows = feed.repartition(self.blocks, "block").withColumns({"nth": F.row_number().over(key), "rank": F.rank().over(key)})
        known = [r for e in self.state["runs"] if (r := self._within(e, reach)) is not None]
        for n, run in enumerate(known):
            rows = rows.join(run.withColumn(f"hit{n}", F.lit(True)).hint("merge"), self.cols, "left")
        hit = reduce(Column.__or__, [F.col(f"hit{n}").isNotNull() for n in range(len(known))], F.lit(False))
        state = F.when(hit | (F.col("rank") > 1), F.when(F.col("lone"), 2).otherwise(1)).when(F.col("nth") == 1, 0)
        rows = rows.select(*self.cols, "pos", state.alias("state")).where("state IS NOT NULL")
        with _runs_as_written(self.spark):
            name = self._write(rows, split="state")
            if add:
                self._enter(f"{name}/state=0", 0)
        self._save()
        marked = self.spark.read.schema(f"{self._schema()}, pos BIGINT, state INT").parquet(f"{self.path}/{name}")
        answers = [marked.where("state = 1").select("pos")]
        if hot:
            # Heads the store held: all their rows are seen; of the others all but the first position.
            held = marked.where("state = 2").select(*self.cols, F.lit(True).alias("held"))
            heads = self.scratch.table(heads.withColumnRenamed("pos", "first").join(held, self.cols, "left"))
            few = heads.count() <= FEW
            all_rows = batch.where(is_hot).join(F.broadcast(heads) if few else heads, self.cols)
            answers.append(all_rows.where("held OR pos > first").select("pos"))
        return reduce(DataFrame.unionByName, answers)


def edges(rows: DataFrame, position: Column, batches: int) -> list[int]:
    """Positions that cut ``rows`` into about equal batches, by approximate quantiles in one pass."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    cut = rows.agg(F.percentile_approx(position, shares, 10_000)).first()[0] or []
    return sorted({int(x) for x in cut})


def feed(store: SeenStore, rows: DataFrame, keys: Sequence[Column], position: Column, batches: int) -> DataFrame:
    """Feed ``rows`` batch by batch in order of ``position``; (pos) of those seen before, from one table."""
    cuts, parts = edges(rows, position, batches), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else position > low) & (F.lit(True) if high is None else position <= high)
        part = rows.where(inside if low is not None else inside | position.isNull())
        parts.append(store.probe(store.prepare(part, keys, position)))
    return reduce(DataFrame.unionByName, parts)


def open_store(rows: DataFrame, keys: Sequence[Column], hash_bits: int = 64, hashed=None) -> SeenStore:
    """A new store in the shared folder for the keys of ``rows``; its files go when the driver ends."""
    spark = rows.sparkSession
    kinds = [k for _, k in rows.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).dtypes]
    path = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    write_text(spark, f"{path}/.begun", "", remove_at_exit=path)
    return SeenStore(spark, path, kinds, hash_bits=hash_bits, hashed=hashed)


def seen_before(rows: DataFrame, keys: Sequence[Column], position: Column, batches: int = BATCHES, hash_bits: int = 64) -> DataFrame:
    """Positions (column ``pos``) of the rows whose key stood in a row with a smaller position.

    Null key parts equal each other; null positions come before all others and among each other are
    neither earlier nor later, as are rows on the same position.  Every row on a later position is
    returned, repeated rows as often as they stand there.  An empty table gives no rows.  For batches
    that come in over time keep a :class:`SeenStore`.
    """
    out = feed(open_store(rows, keys, hash_bits), rows, keys, position, batches)
    return out.select(F.when(F.col("pos") != FIRST, F.col("pos")).alias("pos"))


def error_rate(rows: DataFrame, keys: Sequence[Column], position: Column, batches: int = BATCHES, hash_bits: int = 64, hashed=None) -> DataFrame:
    """One row: hash_bits, n_rows, n_seen, n_keys, wrong_by_hash, rate_by_hash, n_checked, wrong_verified, rate_verified.

    ``wrong_by_hash`` is how many rows would be wrongly called seen if equal hashes were taken for equal keys:
    each key after the first of its hash makes one such row; it is counted on the store's runs.
    ``wrong_verified`` is measured: for all rows the answers are worked out again from the least position of
    each full key, without store or hash, and the rows on which the two disagree are counted; rows of one
    position are compared by number, so one by one if positions are unique.  ``rate_verified`` is their share
    of ``n_rows``.  ``n_checked`` is, as in the SQL, the number of rows of the keys whose MD5 ends in
    ``CHECKED``; it doesn't limit what is verified.
    """
    scratch = Scratch(rows.sparkSession, "rate")
    store = open_store(rows, keys, hash_bits, hashed)
    answers = scratch.table(feed(store, rows, keys, position, batches))
    seen = answers.agg(F.count(F.lit(1)).alias("n_seen"))
    per_hash = reduce(DataFrame.unionByName, [r.select("h") for r in store.runs()], rows.sparkSession.createDataFrame([], "h long")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    keys_row = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("wrong_by_hash"))
    names = [f"k{i}" for i in range(len(keys))]
    full = rows.select(*[k.alias(n) for k, n in zip(keys, names)], F.coalesce(position.cast("long"), F.lit(FIRST)).alias("pos"))
    # One row a key and position, then the rows at the least position of each key: no group meets in one task.
    places = full.groupBy(*names, "pos").agg(F.count(F.lit(1)).alias("n"))
    firsts = places.groupBy(*names).agg(F.min("pos").alias("pos"), F.min_by("n", "pos").alias("n")).select("pos", (-F.col("n")).alias("n"))
    # Of the rows of a position those that aren't first are seen; less the answers nothing must be left.
    each = lambda df, n: df.select("pos", F.lit(n).cast("long").alias("n"))
    left = each(full, 1).unionByName(firsts).unionByName(each(answers, -1)).groupBy("pos").agg(F.sum("n").alias("n"))
    wrong = left.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("wrong_verified"))
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.substring(F.md5(key_text(keys)), -1, 1) == CHECKED).alias("n_checked"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return total.join(seen).join(keys_row).join(wrong).select(
        F.lit(hash_bits).alias("hash_bits"), "n_rows", "n_seen", "n_keys", "wrong_by_hash", rate("wrong_by_hash", "n_rows").alias("rate_by_hash"), "n_checked", "wrong_verified",
        rate("wrong_verified", "n_rows").alias("rate_verified"),
    )
