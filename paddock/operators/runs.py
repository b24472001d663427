"""Run reports, source reports and whole validity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import city_fold
from ..functions.numeric import rounded

STATUSES = ["ok", "error", "skipped"]
CLOCK = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
TRACKS = ("Kum", "Cim", "Sentetik")


def local_today(now: Column, hours: int = 3) -> Column:
    """The day of an instant at the fixed local offset."""
    return F.to_date(now + F.make_dt_interval(hours=F.lit(hours)))


def within_days(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows of the local today and the `days` before it, and all later ones."""
    return rows.where(F.col("race_date") >= F.date_sub(local_today(now), days))


def value_gaps(races: DataFrame, runners: DataFrame, signals: DataFrame) -> DataFrame:
    """Per city: runners, those without share, form, hp, weight or jockey, and field signals with and without a score. One signal a runner at most."""
    rows = runners.join(races.select("race_id", "city"), "race_id").join(signals.select("race_id", "horse_number", "score", F.lit(True).alias("_signal")), ["race_id", "horse_number"], "left")
    return rows.groupBy("city").agg(
        F.count("*").alias("runners"), F.count_if(F.col("agf_bp").isNull()).alias("no_share"), F.count_if(F.coalesce("recent_form_raw", F.lit("")) == "").alias("no_form"), F.count_if(F.col("hp").isNull()).alias("no_hp"),
        F.count_if(F.col("weight").isNull()).alias("no_weight"), F.count_if(F.col("jockey_id").isNull()).alias("no_jockey"), F.count("_signal").alias("signal_rows"), F.count("score").alias("scored_rows"),
    )


def pick_updates(picks: DataFrame) -> DataFrame:
    """Per race and per source, in one pass: picks, distinct sources, horses and races, latest update. The other key is NULL."""
    each = picks.select("race_id", "source_key", "horse_number", "updated_at")
    return each.groupingSets([["race_id"], ["source_key"]], "race_id", "source_key").agg(
        F.count("*").alias("picks"), F.count_distinct("source_key").alias("sources"), F.count_distinct(F.struct("race_id", "horse_number")).alias("horses"), F.count_distinct("race_id").alias("races"), F.max("updated_at").alias("latest_update")
    )


def source_report(picks: DataFrame, races: DataFrame) -> DataFrame:
    """Per source (NULL city: all cities) and per source and city: picks, distinct runners, races and cities."""
    rows = picks.join(races.select("race_id", "city"), "race_id").select("source_key", F.col("city").alias("city"), F.col("city").alias("_city"), "race_id", "horse_number")
    return rows.groupingSets([["source_key", "city"], ["source_key"]], "source_key", "city").agg(
        F.count("*").alias("picks"), F.count_distinct("race_id", "horse_number").alias("runners"), F.count_distinct("race_id").alias("races"), F.count_distinct("_city").alias("cities")
    )


def label_state(audit: DataFrame, races: DataFrame, runners: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per state (OK, PENDING or the reason of a skip): races, runners, last attempt. attempts(race_id, last_attempt_at)."""
    n = runners.groupBy("race_id").agg(F.count("*").alias("n"))
    rows = races.select("race_id").join(audit.select("race_id", "reason"), "race_id", "left").join(n, "race_id", "left").join(attempts, "race_id", "left")
    return rows.groupBy(F.coalesce("reason", F.lit("PENDING")).alias("state")).agg(F.count("*").alias("races"), F.sum(F.coalesce("n", F.lit(0))).alias("runners"), F.max("last_attempt_at").alias("last_attempt"))


STAGES = "struct<stages:map<string,struct<status:string,error:string>>>"


def stage_summary(runs: DataFrame) -> DataFrame:
    """Per stage of the runs' details: ok, error, skipped and unknown ones (any other status or none), and its latest error."""
    each = runs.select("last_attempt_at", F.explode(F.from_json("detail", STAGES)["stages"]).alias("stage", "s"))
    status = F.coalesce("s.status", F.lit(""))
    counts = [F.count_if(status == x).alias(x) for x in STATUSES]
    failed = F.when(status == "error", F.struct("last_attempt_at", "s.error"))
    return each.groupBy("stage").agg(*counts, F.count_if(~status.isin(*STATUSES)).alias("unknown"), F.max(failed)["error"].alias("latest_error")).withColumn("failing", F.col("error") > 0)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per status of runs (unknown: none of the known ones): runs, unreadable details, first and last attempt."""
    known = F.when(F.col("status").isin("ok", "ok_with_warnings", "error"), F.col("status")).otherwise("unknown")
    bad = F.col("detail").isNotNull() & F.from_json("detail", STAGES)["stages"].isNull()
    return runs.groupBy(known.alias("status")).agg(F.count("*").alias("runs"), F.count_if(bad).alias("unreadable"), F.min("last_attempt_at").alias("first_attempt"), F.max("last_attempt_at").alias("last_attempt"))


def latest_runs(runs: DataFrame, most: int = 10) -> DataFrame:
    """The `most` newest runs of each status (the report's size), newest first."""
    order = Window.partitionBy("status").orderBy(F.col("last_attempt_at").desc_nulls_last(), "race_date", "city")
    return runs.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("status", "place", "race_date", "city", "last_attempt_at", "last_success_at")


def acquisition_report(log: DataFrame) -> DataFrame:
    """log(scope, stage, ok, fallback, browser, duration_ms) -> per scope: its stages that succeeded at least once, whether a fallback or a browser was used, failures, mean duration."""
    return log.groupBy("scope").agg(
        F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("stage")))), ",").alias("successful_stages"), F.bool_or("fallback").alias("fallback_used"),
        F.bool_or("browser").alias("browser_used"), F.count_if(~F.col("ok")).alias("failures"), rounded(F.avg("duration_ms"), 2).alias("mean_ms"),
    )


def card_checks(cards: DataFrame) -> DataFrame:
    """cards(race_id, race_date, city, race_number, time, distance_meters, track) -> (race_id, code), the clock text and folded duplicates included."""
    same = Window.partitionBy("race_date", city_fold(F.coalesce("city", F.lit(""))), "race_number")
    rows = cards.withColumn("_same", F.count("*").over(same))
    missing = F.coalesce(F.trim("city"), F.lit("")) == ""
    codes = F.array_compact(F.array(
        F.when(missing, "CITY_MISSING"), F.when(F.lower(F.trim("city")) == "karma", "COMPOSITE_MEETING"), F.when(~F.coalesce(F.col("race_number") > 0, F.lit(False)), "RACE_NUMBER_INVALID"),
        F.when(~F.coalesce(F.col("time").rlike(CLOCK), F.lit(False)), "TIME_INVALID"), F.when(F.col("distance_meters").isNull(), "DISTANCE_MISSING"), F.when(~F.coalesce(F.col("track").isin(*TRACKS), F.lit(False)), "TRACK_MISSING"),
        F.when((F.col("_same") > 1) & ~missing, "DUPLICATE_RACE"),
    ))
    return rows.select("race_id", F.explode(codes).alias("code"))


def result_checks(results: DataFrame) -> DataFrame:
    """results(document, race_date: text, race_number, horse_number, finish_position) -> (document, race_number, code).

    A race is repeated where one of its runners is; a meeting's date is checked once a document, with a NULL race.
    """
    dates = results.groupBy("document").agg(F.bool_and(F.coalesce(F.try_to_date("race_date", "yyyy-MM-dd").isNotNull() & F.col("race_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))).alias("dated"))
    by = results.groupBy("document", "race_number").agg(
        F.count("*").alias("n"), F.size(F.collect_set("horse_number")).cast("long").alias("different"), F.count_if(F.coalesce(F.col("finish_position") < 0, F.lit(True))).alias("bad"), F.count_if(F.col("finish_position") == 1).alias("winners")
    )
    codes = F.array_compact(F.array(F.when(F.col("n") < 2, "TOO_FEW_RUNNERS"), F.when(F.col("n") != F.col("different"), "DUPLICATE_RACE_OR_RUNNER"), F.when(F.col("bad") > 0, "BAD_PLACE"), F.when(F.col("winners") == 0, "NO_WINNER")))
    return by.select("document", "race_number", F.explode(codes).alias("code")).unionByName(dates.where("not dated").select("document", F.lit(None).cast("long").alias("race_number"), F.lit("DATE_INVALID").alias("code")))


def frozen_documents(races: DataFrame, runners: DataFrame, picks: DataFrame, started_before: Column) -> DataFrame:
    """(race_id, document, n_runners, n_picks): a document a started race with its runners in order, each with its picks."""
    said = picks.groupBy("race_id", "horse_number").agg(F.array_sort(F.collect_list(F.struct("source_key", "source_rank"))).alias("picks"))
    rows = runners.join(said, ["race_id", "horse_number"], "left").withColumn("picks", F.coalesce("picks", F.array()))
    docs = rows.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("horse_number", "horse_id", "finish_position", "picks"))).alias("runners"), F.sum(F.size("picks")).alias("n_picks"))
    started = races.where(F.col("starts_at") < started_before).join(docs, "race_id")
    return started.select("race_id", F.to_json(F.struct("runners")).alias("document"), F.size("runners").cast("long").alias("n_runners"), "n_picks")


def meeting_sketches(races: DataFrame, runners: DataFrame, lg_k: int = 12) -> DataFrame:
    """(race_date, city, runners, horses, jockeys): a row a meeting, distinct horses and jockeys as HyperLogLog sketches of 2^`lg_k` registers.

    A table of these is what days, months and cities are counted from; the runners are not read again.
    """
    return runners.join(races.select("race_id", "race_date", "city"), "race_id").groupBy("race_date", "city").agg(
        F.count("*").alias("runners"), F.hll_sketch_agg("horse_id", lg_k).alias("horses"), F.hll_sketch_agg("jockey_id", lg_k).alias("jockeys")
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """(race_date, city, runners, horses, jockeys) by meeting, by day (NULL city) and in all, estimated from the sketches of meetings.

    The standard error is 1.04 / sqrt(2^lg_k), 1.6 % at 12; five of it bound nearly every row. NULLs aren't counted.
    """
    return sketches.rollup("race_date", "city").agg(
        F.sum("runners").alias("runners"), F.hll_sketch_estimate(F.hll_union_agg("horses")).alias("horses"), F.hll_sketch_estimate(F.hll_union_agg("jockeys")).alias("jockeys")
    )
