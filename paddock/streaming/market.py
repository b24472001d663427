"""Structured Streaming over the market points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.market import RUNNER, movement_columns
from ..operators.sinks import upsert
from ..sources.versioned import Versions

KEY = [*RUNNER, "captured_at"]


def pre_race(stream: DataFrame) -> DataFrame:
    """Points captured before the start with a share of 0 to 100; the filter decides, not the watermark."""
    return stream.where("agf_percent between 0 and 100 and captured_at < starts_at")


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(KEY)


def newest_candidates(stream: DataFrame) -> DataFrame:
    """Newest point before the start of every runner, in update or complete mode."""
    return pre_race(stream).groupBy(*RUNNER).agg(F.max("captured_at").alias("captured_at"), F.max_by("agf_percent", "captured_at").alias("agf_percent"))


def capture_rate(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("captured_at", delay).groupBy(F.window("captured_at", width).alias("w")).agg(F.count("*").alias("points")).select("w.start", "w.end", "points")


def running_movement(stream: DataFrame, window_minutes: int = 90) -> DataFrame:
    """Score and direction of every runner's movement, updated as points arrive.

    Needs points without repeats (`deduplicated`). A point at or after the start, or from before the window,
    changes nothing, however late it comes: the filter decides, not the watermark.
    """
    at = F.col("captured_at")
    inside = pre_race(stream).where(at >= F.timestamp_seconds(F.unix_micros("starts_at") / 1e6 - 60 * window_minutes))
    by = inside.groupBy(*RUNNER).agg(
        F.count("*").alias("sample_size"), F.min_by("agf_percent", F.struct(at, "agf_percent")).alias("first_agf"), F.max_by("agf_percent", F.struct(at, "agf_percent")).alias("latest_agf"),
        (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("span"),
    )
    return by.select(*RUNNER, "sample_size", *movement_columns())


def stored_days(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame | None:
    """The rows of the table at `path`, partitioned by race_date, of the days in the batch; None before the table exists."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    days = [r[0] for r in batch.select("race_date").distinct().collect()]  # the days of one micro-batch
    return spark.read.schema(batch.schema).parquet(path).where(F.col("race_date").isin(days))


def insert_new(path: str):
    """A foreachBatch sink that appends the rows whose key the table at `path` lacks; only the batch's days are read."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(KEY)
        if (known := stored_days(batch.sparkSession, path, batch)) is not None:
            fresh = fresh.join(known.select(*KEY), KEY, "left_anti")
        fresh.write.mode("append").partitionBy("race_date").parquet(path)

    return write


def upsert_into(path: str, keys: list[str], version: str):
    """A foreachBatch sink that keeps the newest version of each key in the versioned table `rows` under `path`, by race_date.

    Every batch is one commit, numbered by its id: a replayed batch finds its commit and does nothing, and one that fails
    before its commit leaves the table as it was. Only the batch's days are read and written. `current` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = Versions(batch.sparkSession, path)
        if table.version() >= batch_id or batch.isEmpty():
            return
        days = [str(r[0]) for r in batch.select("race_date").distinct().collect()]  # the days of one micro-batch
        known = table.read("rows", days)
        merged = upsert(batch.limit(0) if known is None else known, batch, keys, version)
        table.commit(batch_id, {"rows": merged}, {"rows": "race_date"}, {"rows": days})

    return write


def current(spark: SparkSession, path: str) -> DataFrame | None:
    return Versions(spark, path).read("rows")


__all__ = ["capture_rate", "current", "deduplicated", "insert_new", "newest_candidates", "pre_race", "running_movement", "upsert_into"]
