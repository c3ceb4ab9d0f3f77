"""Shared-folder tables: how every iterative operator cuts lineage.

All intermediate tables are Parquet files below the folder the cluster names in
``spark.checkpoint.dir``.  They survive the loss of any executor, carry size statistics into
the next plan (so adaptive execution can pick join strategies) and are removed as soon as the
operator no longer needs them; what a returned DataFrame still reads is removed when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_of, top_keys


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local-mode session may fall back to a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="quadrille-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/") + "/quadrille-" + spark.sparkContext.applicationId


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one operator call, each written once to the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self._paths: dict[int, tuple[str, str | None]] = {}

    def _new(self) -> str:
        path = f"{shared_folder(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        fs, p = _path(self.spark, path)
        fs.deleteOnExit(p)
        return path

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here."""
        path = self._new()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, None)
        out._scratch = self  # keeps id() unique while the frame lives
        return out

    def counted(self, df: DataFrame, hot: str | None = None, **sums: Column) -> tuple[DataFrame, dict]:
        """:meth:`table` with sums over the rows, and the hot keys of column ``hot``, taken while they are written."""
        seen = Observation()
        top = [top_keys(hot).alias("hot")] if hot else []
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in sums.items()], *top))
        found = {k: v if k == "hot" else int(v or 0) for k, v in seen.get.items()}
        return out, found | ({"hot": hot_of(found["hot"], found["rows"])} if hot else {})

    def marked(self, df: DataFrame, hot: str) -> tuple[DataFrame, tuple, list]:
        """:meth:`table` with its :func:`fingerprint` and the hot keys of ``hot``, taken while it is written."""
        seen, h = Observation(), F.xxhash64(*df.columns)
        sums = [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("mix"), F.sum(h.bitwiseAND((1 << 40) - 1)).alias("total"), top_keys(hot).alias("hot")]
        out = self.table(df.observe(seen, *sums))
        got = seen.get
        return out, (int(got["rows"]), int(got["mix"] or 0), int(got["total"] or 0)), hot_of(got["hot"], got["rows"])

    def bucketed(self, df: DataFrame, buckets: int, keys: Sequence[str], split: str | None = None) -> DataFrame:
        """Write ``df`` hash-bucketed and sorted by ``keys``: joins on exactly these keys with
        another frame hash-partitioned into ``buckets`` parts need no exchange of this side, and if every
        bucket is one file no sort either (the session is set to let scans report that)."""
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        path, name = self._new(), "q_" + uuid.uuid4().hex
        writer = df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet")
        (writer.partitionBy(split) if split else writer).saveAsTable(name)
        out = self.spark.table(name)
        self._paths[id(out)] = (path, name)
        out._scratch = self
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, name = self._paths.pop(id(df), (None, None))
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path:
                fs, p = _path(self.spark, path)
                fs.delete(p, True)

    def keep_only(self, *frames: DataFrame) -> None:
        """Drop every table except those that ``frames`` are."""
        stay = {id(f) for f in frames}
        for key in [k for k in self._paths if k not in stay]:
            path, name = self._paths.pop(key)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            fs, p = _path(self.spark, path)
            fs.delete(p, True)


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Row count and order-free checksums; equal for equal row sets.  One small row to the driver."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND((1 << 40) - 1))).first()
    return int(row[0]), int(row[1] or 0), int(row[2] or 0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system; None if there is none."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, remove_at_exit: str | None = None) -> None:
    """Write a small text file, replacing an old one by a rename; ``remove_at_exit``: a folder that goes when the driver ends."""
    fs, p = _path(spark, path)
    new = _path(spark, f"{path}.new")[1]
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(new, p)
    if remove_at_exit:
        fs.deleteOnExit(_path(spark, remove_at_exit)[1])
