"""Training snapshots, ticket snapshots, pipeline counters and the rebuild after results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..sources.cards import snapshot_rows
from .market import feature_columns
from .sinks import content_key, newest_candidate

RACE = ["race_date", "city", "race_number"]


def promoted(candidates: DataFrame, frozen: DataFrame, now: Column) -> DataFrame:
    """The newest candidate before the start of each race that has started and isn't frozen yet."""
    newest = newest_candidate(candidates, RACE).where(F.col("starts_at") <= now)
    return newest.join(frozen.select(*RACE).distinct(), RACE, "left_anti")


def training_rows(chosen: DataFrame, points: DataFrame) -> DataFrame:
    """Snapshot runners with the last market share at or before the snapshot's own `captured_at`; nothing captured later is read.

    The cut is applied before the aggregate, so a runner has one row of features whatever its series' length.
    """
    runner = [*RACE, "horse_number"]
    rows = snapshot_rows(chosen)
    cuts = chosen.select(*RACE, F.col("captured_at").alias("cut"))
    seen = points.select(*runner, "captured_at", "agf_percent").join(cuts, RACE).where("captured_at <= cut")
    last = seen.groupBy(*runner).agg(F.max(F.struct("captured_at", "agf_percent"))["agf_percent"].alias("agf_percent"), F.count("*").alias("points"))
    return rows.join(last, runner, "left").withColumn("points", F.coalesce("points", F.lit(0)).cast("long"))


def training_set(chosen: DataFrame, runners: DataFrame, points: DataFrame, picks: DataFrame) -> DataFrame:
    """The whole feature vector of every runner of the chosen races, as of each race's own cut; one aggregate over all observations.

    chosen(race_id, starts_at, captured_at): promoted candidates, whose `captured_at` is the cut. runners(race_id,
    horse_number, form_score, field_score) and observations of later than the cut change nothing: they are left out
    before the aggregate. points(race_id, horse_number, captured_at, agf_percent), picks(race_id, horse_number,
    captured_at, source_key, source_rank, is_banko). A runner without observations has NULL shares and no picks.
    """
    key = ["race_id", "horse_number"]
    static = runners.select(*key, "form_score", "field_score", F.lit(True).alias("listed"))
    seen = static.unionByName(points.select(*key, "captured_at", "agf_percent"), allowMissingColumns=True).unionByName(picks.select(*key, "captured_at", "source_key", "source_rank", "is_banko"), allowMissingColumns=True)
    cuts = chosen.select("race_id", "starts_at", F.col("captured_at").alias("cutoff"))
    known = seen.join(cuts, "race_id").where(F.col("listed") | (F.col("captured_at") <= F.col("cutoff")))
    vector = known.groupBy(*key).agg(
        F.max("cutoff").alias("cut"), F.bool_or("listed").alias("listed"), *feature_columns(), F.count("agf_percent").alias("points"), F.count("source_key").alias("picks"), F.countDistinct("source_key").alias("sources"),
        F.count_if(F.col("is_banko")).alias("bankos"), rounded(F.avg("source_rank"), 4).alias("mean_rank"), F.max("form_score").alias("form_score"), F.max("field_score").alias("field_score"),
    )
    return vector.where("listed").drop("listed")


def ticket_snapshots(tickets: DataFrame, windows: DataFrame, starts: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Tickets of windows whose six starts are known and ahead, with a key; those stored already are left out.

    tickets(card, sixfold_number, profile, ...), windows(card, sixfold_number, race_id), starts(race_id, starts_at), stored(snapshot_key).
    """
    legs = windows.join(starts, "race_id", "left").groupBy("card", "sixfold_number")
    open_ = legs.agg(F.count("starts_at").alias("known"), F.min("starts_at").alias("first_start")).where((F.col("known") == 6) & (F.col("first_start") > now))
    keyed = tickets.join(open_.drop("known"), ["card", "sixfold_number"]).withColumn("snapshot_key", content_key("card", "sixfold_number", *(["budget"] if "budget" in tickets.columns else []), "profile"))
    return keyed.join(stored.select("snapshot_key").distinct(), "snapshot_key", "left_anti")


def pipeline_counters(candidates: DataFrame, tickets: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counts over candidates, tickets and result runs, with the latest times; empty tables count 0."""
    a = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("captured_at") >= F.col("starts_at")).alias("invalid_timing"), F.max("captured_at").alias("latest_capture"))
    b = tickets.agg(F.count("*").alias("tickets"), F.count_if(F.col("evaluated_at").isNull()).alias("pending"), F.max("generated_at").alias("latest_generation"))
    by = [F.count_if(F.col("status") == s).alias(name) for s, name in (("ok", "ok"), ("ok_with_warnings", "warnings"), ("error", "errors"))]
    c = runs.agg(F.count("*").alias("runs"), *by, F.max("last_attempt_at").alias("latest_attempt"), F.max("last_success_at").alias("latest_success"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def stage_errors(runs: DataFrame, most: int = 20) -> DataFrame:
    """(race_date, city, stage, error) of the `most` newest runs (the report's size); details that can't be read have no rows."""
    newest = runs.orderBy(F.col("last_attempt_at").desc_nulls_last(), "race_date", "city").limit(most)
    stages = F.from_json("detail", "struct<stages:map<string,struct<status:string,error:string>>>")["stages"]
    return newest.select("race_date", "city", F.explode(stages).alias("stage", "s")).where("s.status = 'error'").select("race_date", "city", "stage", F.col("s.error").alias("error"))


def rebuild(spark: SparkSession, stages: list[tuple[str, Callable[[], DataFrame]]], folder: str | None = None) -> DataFrame:
    """(place, stage, status, rows, error): every stage is run and, with a folder, written there; one that fails is reported and the others go on."""
    done = []
    for place, (name, stage) in enumerate(stages):
        seen = Observation()
        try:
            writer = stage().observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
            writer.parquet(f"{folder}/{name}") if folder else writer.format("noop").save()
            done.append((place, name, "ok", seen.get["n"], None))
        except Exception as failure:  # a stage of its own: whatever breaks it is its status
            done.append((place, name, "error", None, type(failure).__name__))
    return spark.createDataFrame(done, "place bigint, stage string, status string, rows bigint, error string")


def restated(rows: DataFrame, classified: DataFrame, moved_to: Column) -> DataFrame:
    """A classified date repair applied: moved mappings get their new date, duplicates go, those under review stay.

    rows(mapping, race_date, ...), classified(mapping, classification).
    """
    kind = F.col("classification")
    both = rows.join(classified.select("mapping", "classification"), "mapping", "left").where(F.coalesce(kind != "DELETE_DUPLICATE_SOURCE", F.lit(True)))
    return both.withColumn("race_date", F.when(kind == "MOVE_SOURCE_TO_TARGET", moved_to).otherwise(F.col("race_date"))).select(rows.columns)
