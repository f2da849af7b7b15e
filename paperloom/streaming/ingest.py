"""Ingest and state as Structured Streaming: files in, edits folded, logs tailed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import edits as E


def stream_table(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files, or one such file, as a stream.

    The path is given as a pattern (its last letter in brackets), since a plain path must
    be a folder.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def file_queue(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Uploaded files as queue items, durable over restarts through the checkpoint."""
    f = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = S.basename(F.col("path"))
    return f.where(~name.endswith(".json") & ~name.contains("_crop_")).select("path", name.alias("filename"), "modificationTime", "length")


def run_queue(items: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on each micro-batch in turn until what is there has been worked off."""
    return items.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last value of each field so far; a complete-mode aggregation over the edit stream."""
    return E.collapse(edits)


def log_counts(logs: DataFrame, late: str | None = "2 days", window: str = "1 day") -> DataFrame:
    """(start, level, n): distinct events per day; state ends once ``late`` has passed.

    With ``late=None`` no event is too late and no window closes: for complete mode over
    a finite table.
    """
    level = F.upper(F.coalesce("level", F.lit("INFO")))
    d = logs.withColumn("level", level)
    d = (d.withWatermark("ts", late) if late else d).dropDuplicates(["ts", "level", "msg"])
    return d.groupBy(F.window("ts", window), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")
