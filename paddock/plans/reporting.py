"""Registered run, source and validity reports with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports, runs
from ..operators.sinks import content_key
from ..sources import racing
from .oracles import FIELD, r
from .registry import audit, instant, result_runs, six_windows

KEY = ["race_id", "horse_number"]


def value_gaps(s: SparkSession, d: str) -> DataFrame:
    """Weights are missing at every ninth runner, signals at every fourth race."""
    runners = racing.runners(s, d).withColumn("weight", F.when((F.col("race_id") + F.col("horse_number")) % 9 != 0, F.col("weight")))
    places = racing.past_places(s, d).where("race_id % 4 <> 0")
    return runs.value_gaps(racing.races(s, d), runners, places.select(*KEY, F.when(F.size("places") > 0, F.size("places")).alias("score")))


def updated_picks(s: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds("starts_at") - 60 * (10 + 15 * F.col("k")))
    return racing.picks(s, d).join(racing.races(s, d).select("race_id", "starts_at"), "race_id").withColumn("updated_at", at)


def label_state(s: SparkSession, d: str) -> DataFrame:
    races = racing.races(s, d)
    return runs.label_state(audit(s, d), races, racing.runners(s, d), races.where("race_id % 3 <> 0").select("race_id", F.col("starts_at").alias("last_attempt_at")))


def odd_runs(s: SparkSession, d: str) -> DataFrame:
    """The result runs, some of a status that nobody knows."""
    return result_runs(s, d).withColumn("status", F.when(F.dayofmonth("race_date") + F.length("city") > 8, F.col("status")).otherwise(F.lit("lost")))


def acquisition(s: SparkSession, d: str) -> DataFrame:
    e = racing.read(s, d, "events")
    log = e.select((F.col("user_id") % 10).alias("scope"), F.col("event_type").alias("stage"), (F.col("value") < 80).alias("ok"), (F.col("value") < 2).alias("fallback"), (F.col("event_id") % 1000 == 7).alias("browser"), F.floor("value").alias("duration_ms"))
    return runs.acquisition_report(log)


def card_checks(s: SparkSession, d: str) -> DataFrame:
    """Cards with clock texts, some of them wrong, cities of other spelling, composite and missing ones, and races of one number."""
    k = F.col("race_id")
    city = F.when(k % 31 == 0, "  ").when(k % 29 == 0, " Karma").when(k % 2 == 0, F.lower("city")).otherwise(F.col("city"))
    time = F.when(k % 23 == 0, "24:00").when(k % 19 == 0, F.lit(None)).otherwise(F.date_format("starts_at", "HH:mm"))
    number = F.when(k % 17 == 0, F.lit(1)).otherwise(F.col("race_number"))
    return runs.card_checks(racing.races(s, d).select("race_id", "race_date", city.alias("city"), number.alias("race_number"), time.alias("time"), "distance_meters", F.when(k % 13 != 0, F.col("track")).alias("track")))


def result_checks(s: SparkSession, d: str) -> DataFrame:
    """A document a meeting: some with dates of another form, some with a race under another's number."""
    k = F.col("race_id")
    rows = racing.results(s, d).join(racing.races(s, d).select("race_id", "race_date", "city", "race_number"), "race_id")
    day = F.when(F.length("city") % 5 == 0, F.date_format("race_date", "dd.MM.yyyy")).otherwise(F.col("race_date").cast("string"))
    number = F.when((k % 41 == 0) & (F.col("race_number") > 1), F.col("race_number") - 1).otherwise(F.col("race_number"))
    place = F.when(k % 37 == 0, -F.col("finish_position")).otherwise(F.col("finish_position"))
    return runs.result_checks(rows.select(F.concat_ws("|", F.col("race_date").cast("string"), "city").alias("document"), day.alias("race_date"), number.alias("race_number"), "horse_number", place.alias("finish_position")))


def duplicates(s: SparkSession, d: str) -> DataFrame:
    """Windows and snapshot keys that are stored twice: every seventh race's card."""
    w = six_windows(s, d)
    key = ["race_date", "city", "sixfold_number", "place"]
    windows = w.select(*key, "race_id").unionByName(w.where("race_id % 7 = 0").select(*key, "race_id"))
    keyed = racing.races(s, d).select("race_id", content_key("race_date", "city", "race_number").alias("snapshot_key"))
    snapshots = keyed.unionByName(keyed.where("race_id % 5 = 0"))
    return reports.violations({"duplicate_windows": reports.repeated(windows, key), "duplicate_snapshot_keys": reports.repeated(snapshots, ["snapshot_key"])})


def frozen(s: SparkSession, d: str) -> DataFrame:
    made = runs.frozen_documents(racing.races(s, d), racing.runners(s, d), racing.picks(s, d), instant())
    return made.select("race_id", "n_runners", "n_picks", F.size(F.from_json("document", "struct<runners:array<struct<picks:array<struct<source_key:string>>>>>")["runners"]).cast("long").alias("in_document"))


def sketched(s: SparkSession, d: str) -> DataFrame:
    """Exact runners by meeting, day and in all, and whether the sketched counts of horses and jockeys are within eight in a hundred of the exact ones."""
    races, runners = racing.races(s, d), racing.runners(s, d)
    merged = runs.merged_sketches(runs.meeting_sketches(races, runners))
    rows = runners.join(races.select("race_id", "race_date", "city"), "race_id")
    exact = rows.rollup("race_date", "city").agg(F.count_distinct("horse_id").alias("true_horses"), F.count_distinct("jockey_id").alias("true_jockeys"))
    both = merged.alias("m").join(exact.alias("e"), F.col("m.race_date").eqNullSafe(F.col("e.race_date")) & F.col("m.city").eqNullSafe(F.col("e.city")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.08 * F.col(b)
    return both.select("m.race_date", "m.city", "runners", "true_horses", "true_jockeys", (near("horses", "true_horses") & near("jockeys", "true_jockeys")).alias("within"))


def queries() -> dict:
    return {
        "value_gaps": value_gaps,
        "pick_updates": lambda s, d: runs.pick_updates(updated_picks(s, d)),
        "source_report": lambda s, d: runs.source_report(racing.picks(s, d), racing.races(s, d)),
        "label_state": label_state,
        "stage_summary": lambda s, d: runs.stage_summary(result_runs(s, d)),
        "run_summary": lambda s, d: runs.run_summary(odd_runs(s, d)),
        "latest_runs": lambda s, d: runs.latest_runs(result_runs(s, d)),
        "acquisition_report": acquisition,
        "card_checks": card_checks,
        "result_checks": result_checks,
        "duplicate_checks": duplicates,
        "frozen_documents": frozen,
        "recent_days": lambda s, d: runs.within_days(racing.races(s, d), F.lit("1995-06-30 21:30:00").cast("timestamp"), 61).select("race_id", "race_date"),
        "meeting_sketches": sketched,
    }


def bodies() -> dict[str, tuple[str, str]]:
    """name -> (common table expressions after those of the tables, query)."""
    from .oracles import LATEST, WINDOWS

    picks = "p as (select k.*, starts_at - to_minutes((10 + 15 * k)::int) as updated_at from picks k join races using (race_id))"
    ran = f"{LATEST}, u as (select race_date, city, k, max(starts_at) as t from races join latest using (race_date, city) group by all), v as (select *, case when k % 4 = 0 then 'error' when k % 4 = 1 then 'ok_with_warnings' else 'ok' end as status from u)"
    fold = "regexp_replace(translate(upper(translate(city, 'iı', 'İI')), 'İIĞÜŞÖÇ', 'IIGUSOC'), '[^A-Z0-9]', '', 'g')"
    codes = lambda *pairs: f"unnest(list_filter([{', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for c, n in pairs)}], lambda x: x is not null))"
    count = "count(*) as picks, count(distinct source_key) as sources, count(distinct (race_id, horse_number)) as horses, count(distinct race_id) as races, max(updated_at) as latest_update"
    return {
        "value_gaps": (FIELD, "select city, count(*) as runners, count(*) filter (agf_bp is null) as no_share, count(*) filter (recent_form_raw = '') as no_form, count(*) filter (hp is null) as no_hp, count(*) filter ((race_id + horse_number) % 9 = 0) as no_weight, "
            "count(*) filter (jockey_id is null) as no_jockey, count(*) filter (race_id % 4 <> 0) as signal_rows, count(field_score) filter (race_id % 4 <> 0) as scored_rows from runners join races using (race_id) left join fields using (race_id, horse_number) group by city"),
        "pick_updates": (picks, f"select race_id, null::varchar as source_key, {count} from p group by race_id union all select null, source_key, {count} from p group by source_key"),
        "source_report": ("", "select source_key, city, count(*) as picks, count(distinct (race_id, horse_number)) as runners, count(distinct race_id) as races, count(distinct cities) as cities from (select *, city as cities from picks join races using (race_id)) group by grouping sets ((source_key, city), (source_key))"),
        "stage_summary": (ran, "select stage, count(*) filter (k % n <> 0) as ok, count(*) filter (k % n = 0) as error, 0::bigint as skipped, 0::bigint as unknown, max(case when k % n = 0 then 'timeout' end) as latest_error, count(*) filter (k % n = 0) > 0 as failing "
            "from v, (values ('labels', 4), ('priors', 8)) s(stage, n) where k % 12 <> 0 group by stage"),
        "run_summary": (ran, "select case when day(race_date) + length(city) > 8 then status else 'unknown' end as status, count(*) as runs, count(*) filter (k % 12 = 0) as unreadable, min(t) as first_attempt, max(t) as last_attempt from v group by 1"),
        "latest_runs": (ran, "select status, row_number() over (partition by status order by t desc, race_date, city) as place, race_date, city, t as last_attempt_at, case when k % 4 <> 0 then t end as last_success_at from v qualify place <= 10"),
        "acquisition_report": ("", f"select user_id % 10 as scope, count(*) as runs, coalesce(array_to_string(list_sort(list(distinct event_type) filter (value < 80)), ','), '') as successful_stages, bool_or(value < 2) as fallback_used, bool_or(event_id % 1000 = 7) as browser_used, "
            f"count(*) filter (not value < 80) as failures, {r('avg(floor(value))', 2)} as mean_ms from events group by 1"),
        "card_checks": ("q as (select race_id, race_date, case when race_id % 31 = 0 then '  ' when race_id % 29 = 0 then ' Karma' when race_id % 2 = 0 then lower(city) else city end as city, case when race_id % 17 = 0 then 1 else race_number end as race_number, distance_meters from races), "
            f"w as (select *, count(*) over (partition by race_date, {fold}, race_number) as same from q)",
            "select race_id, " + codes(("race_id % 31 = 0", "CITY_MISSING"), ("lower(trim(city)) = 'karma'", "COMPOSITE_MEETING"), ("race_id % 23 = 0 or race_id % 19 = 0", "TIME_INVALID"), ("distance_meters is null", "DISTANCE_MISSING"), ("race_id % 13 = 0", "TRACK_MISSING"), ("same > 1 and race_id % 31 <> 0", "DUPLICATE_RACE")) + " as code from w"),
        "result_checks": ("q as (select race_date::varchar || '|' || city as document, city, case when race_id % 41 = 0 and race_number > 1 then race_number - 1 else race_number end as race_number, horse_number, case when race_id % 37 = 0 then -finish_position else finish_position end as p from results join races using (race_id)), "
            "g as (select document, race_number, count(*) as n, count(distinct horse_number) as m, count(*) filter (p < 0) as bad, count(*) filter (p = 1) as won from q group by all)",
            "select document, race_number, " + codes(("n < 2", "TOO_FEW_RUNNERS"), ("n <> m", "DUPLICATE_RACE_OR_RUNNER"), ("bad > 0", "BAD_PLACE"), ("won = 0", "NO_WINNER")) + " as code from g union all select distinct document, null, 'DATE_INVALID' from q where length(city) % 5 = 0"),
        "duplicate_checks": (WINDOWS, "select 'duplicate_windows' as \"check\", count(*) as violations from windows where race_id % 7 = 0 union all select 'duplicate_snapshot_keys', count(*) from races where race_id % 5 = 0"),
        "frozen_documents": ("said as (select race_id, count(*) as n from picks group by race_id)", "select race_id, count(*) as n_runners, coalesce(max(n), 0) as n_picks, count(*) as in_document from races join runners using (race_id) left join said using (race_id) where starts_at < timestamp '1995-06-15 12:00:00' group by race_id"),
        "recent_days": ("", "select race_id, race_date from races where race_date >= date '1995-05-01'"),
        "meeting_sketches": ("", "select race_date, city, count(*) as runners, count(distinct horse_id) as true_horses, count(distinct jockey_id) as true_jockeys, true as within from runners join races using (race_id) group by rollup (race_date, city)"),
    }


def after(out: dict[str, str], tables: str) -> dict[str, str]:
    """Queries over the SQL of others."""
    return {
        "label_state": f"with {tables}, n as (select race_id, count(*) as n from runners group by race_id), audited as ({out['label_audit']}) select coalesce(reason, 'PENDING') as state, count(*) as races, sum(coalesce(n, 0))::bigint as runners, "
        "max(case when race_id % 3 <> 0 then starts_at end) as last_attempt from races left join audited using (race_id) left join n using (race_id) group by 1"
    }
