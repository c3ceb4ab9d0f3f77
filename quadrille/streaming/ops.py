"""Structured Streaming for the operators that work statement by statement.

Reading lines, transforming, schema extraction, prefix use, writing and rule application against a fixed schema
need no memory of earlier statements and run unchanged on a stream.  Deduplication needs a bound on
that memory: ``unique_within`` forgets statements older than a watermark - new here, not a batch operator's twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadrille.model import FULL, QUAD, SCHEMA, Vocabulary
from quadrille.operators import semantic, transform
from quadrille.sources.lines import parse_statements, to_lines


def stream_lines(spark: SparkSession, directory: str, files_per_batch: int | None = None) -> DataFrame:
    """Quads of line files as they appear in a directory."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_statements(reader.load(directory))


def stream_parquet(spark: SparkSession, directory: str, extra: str = "") -> DataFrame:
    """Quads of Parquet files as they appear; ``extra`` columns (DDL) such as the arrival time stay."""
    return spark.readStream.schema(SCHEMA + (", " + extra if extra else "")).parquet(directory)


def transform_stream(df: DataFrame, spec: str, vocab: Vocabulary = FULL) -> DataFrame:
    return transform.transform(df, spec, vocab=vocab)


def tbox_stream(df: DataFrame, vocab: Vocabulary = FULL) -> DataFrame:
    return semantic.tbox(df, vocab)


def unique_within(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Statements not met within ``delay`` of event time."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(QUAD)


def write_stream(df: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """Append lines to a directory, exactly once."""
    return to_lines(df).writeStream.format("text").option("path", directory).option("checkpointLocation", checkpoint).outputMode("append").start()


def each_batch(df: DataFrame, operator: Callable[[DataFrame], DataFrame], directory: str, checkpoint: str) -> StreamingQuery:
    """Apply any batch operator to every micro-batch on its own (e.g. RDFS under a fixed schema)."""

    def run(batch: DataFrame, n: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{directory}/batch={n}")

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
