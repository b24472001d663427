"""Further registered queries with their SQL: write semantics, names, histories, dossiers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numeric, signals
from ..operators import gaps, market, reports, scoring, sinks, tickets
from ..sources import pages, racing
from ..sources.stored import dealt, once
from .oracles import AGES, WINDOWS, clamp, r
from .registry import CARDS, instant, ticket_legs

KEY = ["race_id", "horse_number"]
SHARES = "share_points"


def table_pages(s: SparkSession, d: str) -> DataFrame:
    """A page a horse with its past races, newest first, beside a smaller table; written from the tables."""
    cell = lambda *xs: F.concat(*[F.concat(F.lit("<td> "), F.coalesce(x.cast("string"), F.lit("")), F.lit("</td>")) for x in xs])
    rows = racing.runners(s, d).join(racing.races(s, d).select("race_id", "race_date", "city", "distance_meters", "track"), "race_id")
    row = F.concat(F.lit("<tr>"), cell(F.date_format("race_date", "dd.MM.yyyy"), F.col("city"), F.col("distance_meters"), F.col("track"), F.col("finish_position"), F.col("hp")), F.lit("</tr>"))
    head = "<table><tr><th>Tarih</th><th>Şehir</th><th>Msf</th><th>Pist</th><th>S</th><th>HP</th></tr>"
    by = rows.groupBy("horse_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("race_date", "race_id", "horse_number", row.alias("row"))))["row"], "").alias("rows"))
    return by.select(F.col("horse_id").cast("string").alias("page_id"), F.concat(F.lit("<table><tr><td>x</td></tr></table>"), F.lit(head), "rows", F.lit("</table>")).alias("html"))


def form_history(s: SparkSession, d: str) -> DataFrame:
    """Past races read from the horses' pages, and the form score of the five newest by date and place."""
    rows = pages.history_rows(table_pages(s, d)).where("finish_position > 0")
    order = F.row_number().over(market.Window.partitionBy("page_id").orderBy(F.col("race_date").desc(), "finish_position", "distance_meters", "city"))
    newest = rows.withColumn("n", order)
    by = newest.groupBy("page_id").agg(F.count("*").alias("races"), F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "finish_position"))))["finish_position"].alias("places"))
    score, trend = scoring.history_form(F.col("places"))
    return by.select(F.col("page_id").cast("long").alias("horse_id"), "races", F.array_join("places", ",").alias("places"), score.alias("score"), trend.alias("trend"))


def stored(s: SparkSession, d: str) -> DataFrame:
    return racing.runners(s, d).select(*KEY, F.coalesce("agf_bp", F.lit(0)).alias("value"))


def insert_ignored(s: SparkSession, d: str) -> DataFrame:
    """Every second share point is stored; all of them come again, twice."""
    points = racing.share_points(s, d).select(*KEY, "captured_at", "agf_percent")
    known = points.where((F.unix_seconds("captured_at") / 60 + F.col("race_id")) % 2 == 0)
    return sinks.insert_ignore(known, points.unionByName(points), [*KEY, "captured_at"])


def reconciled(s: SparkSession, d: str) -> DataFrame:
    """Runners of the races that the official results know."""
    return sinks.reconcile(racing.runners(s, d).select(*KEY), racing.results(s, d).select("race_id"), ["race_id"])


def composite(s: SparkSession, d: str) -> DataFrame:
    """Every seventh meeting's city is written as the composite programme."""
    meetings = racing.races(s, d)
    return sinks.without_composite(meetings.withColumn("city", F.when(F.col("race_id") % 7 == 0, " Karma ").otherwise(F.col("city")))).select("race_id", "city")


def retained(s: SparkSession, d: str) -> DataFrame:
    meetings = racing.races(s, d).select("race_id", "race_date")
    return sinks.retain(meetings, racing.results(s, d).select("race_id").distinct(), ["race_id"], F.date_sub(F.lit("1995-06-15").cast("date"), 30))


def instants(s: SparkSession, d: str) -> DataFrame:
    """Starts from local day and clock text; every ninth clock is no time. The same starts moved by a day."""
    clock = F.when(F.col("race_id") % 9 == 0, "24:75").otherwise(F.date_format("starts_at", "HH:mm"))
    at = names.local_instant(F.col("race_date"), clock)
    return racing.races(s, d).select("race_id", at.alias("at"), names.re_dated(at, F.date_add("race_date", 1)).alias("moved"))


def entity_names(s: SparkSession, d: str) -> DataFrame:
    h, j = F.col("horse_id").cast("string"), F.col("jockey_id").cast("string")
    url = F.when(F.col("horse_id") % 3 != 0, F.concat(F.lit("https://a.b/q?x=1&queryparameter_atid="), h, F.lit("#t")))
    ride = F.when(F.col("jockey_id") % 2 == 0, F.concat(F.lit("https://a.b/q?JokeyId="), j, F.lit("&y=2")))
    name, rider = F.concat(F.lit("  kır  İsi "), h, F.lit(" (7)")), F.concat(F.lit("jokey  "), j)
    return racing.runners(s, d).select(
        *KEY, names.horse_key(url, name).alias("horse_key"), names.jockey_key(ride, rider).alias("jockey_key"), names.display_name(name).alias("display"), names.label_name(name).alias("label"), names.repair_name(name).alias("repair"),
    )


def pick_categories(s: SparkSession, d: str) -> DataFrame:
    return racing.picks(s, d).groupBy("source_key", F.coalesce(signals.category(), F.lit("none")).alias("category")).agg(F.count("*").alias("picks"))


def health(s: SparkSession) -> DataFrame:
    return racing.sources(s).withColumn("status", F.when(F.col("source_key") == "src3", "error").otherwise("healthy"))


def combined_fields(s: SparkSession, d: str) -> DataFrame:
    """Measured field scores with the weight of the runner as a stand-in for what experts say, where it is whole; not a number counts as none."""
    past = racing.past_places(s, d).select(*KEY, scoring.field_score(F.col("places")).alias("measured"))
    said = numeric.finite(F.when(F.col("horse_id") % 5 == 0, F.lit(float("nan"))).when(F.col("horse_id") % 5 == 1, F.lit(float("inf"))).when(F.col("horse_id") % 5 < 4, F.col("weight")))
    rows = racing.runners(s, d).select(*KEY, said.alias("said")).join(past, KEY)
    return rows.select(*KEY, scoring.combined_field(F.col("measured"), F.col("said")).alias("field_score"))


def ticket_inputs(s: SparkSession, d: str) -> DataFrame:
    """Inputs of every window: some budgets, multipliers and numbers of legs are wrong."""
    k = F.col("races")
    by = ticket_legs(s, d).groupBy("card").agg(F.sum("race_id").alias("races"))
    inputs = by.select(
        "card", F.when(k % 13 == 0, 5).otherwise(6).alias("legs"), F.when(k % 7 == 0, -1.0).when(k % 7 == 1, 1.0).when(k % 7 == 2, float("nan")).otherwise(500.0).alias("budget"),
        F.when(k % 5 == 0, 1.5).when(k % 5 == 1, 0.0).otherwise(2.0).alias("multiplier"), F.lit(1.25).alias("unit"),
    )
    legs = ticket_legs(s, d).select("card", "leg", F.when(F.col("race_id") % 11 != 0, F.col("horse_number")).alias("horse_number"))
    return tickets.invalid_inputs(inputs, legs)


def ticket_costs(s: SparkSession, d: str) -> DataFrame:
    """Cost of taking half of every leg, and the band of that budget."""
    by = ticket_legs(s, d).groupBy("card", "city", "leg").agg(F.ceil(F.count("*") / 2).alias("n")).groupBy("card", "city").agg(F.array_sort(F.collect_list(F.struct("leg", "n")))["n"].alias("sizes"))
    cost = tickets.ticket_cost(F.col("sizes"), tickets.unit_price(F.col("city"), F.contains("city", F.lit(" "))), 2)
    return by.select("card", cost.alias("cost"), tickets.budget_band(cost).alias("band"))


def result_cells(s: SparkSession, d: str) -> DataFrame:
    """Official result rows as cells: runner with its number, place or words; a second table a race repeats it otherwise."""
    rows = racing.results(s, d)
    place = F.when(F.col("finish_position") == 0, "Koşmaz").otherwise(F.concat(F.col("finish_position").cast("string"), F.lit(".")))
    runner = F.when(F.col("race_id") % 29 == 0, F.col("name")).otherwise(F.concat("name", F.lit("("), F.col("horse_number").cast("string"), F.lit(") KG SK")))
    first = rows.select(F.lit("p").alias("page_id"), F.col("race_id").alias("race_no"), F.lit(1).alias("table_no"), runner.alias("runner"), place.alias("place"))
    return pages.result_rows(first.unionByName(first.withColumn("table_no", F.lit(2)).withColumn("place", F.lit("9"))))


def pages_changed(s: SparkSession, d: str) -> DataFrame:
    """Pages against an earlier crawl in which every fourth had other content and every fifth wasn't there."""
    p = racing.read(s, d, "pages")
    now, n = pages.fingerprint(p, "page_id", "url", "html"), F.col("page_id")
    before = pages.fingerprint(p.where("page_id % 5 <> 0").withColumn("html", F.when(n % 4 == 0, "").otherwise(F.col("html"))), "page_id", "url", "html")
    return pages.changed(now, before, "page_id")


def stage_statuses(s: SparkSession, d: str) -> DataFrame:
    k = F.col("race_id")
    text = F.to_json(F.create_map(F.lit("labels"), F.when(k % 4 == 0, "error").otherwise("ok"), F.lit("priors"), F.when(k % 3 == 0, "skipped").otherwise("ok")))
    return reports.stage_report(racing.races(s, d).select(F.col("city").alias("scope"), F.when(k % 10 == 0, "{").otherwise(text).alias("stages")))


def field_state(s: SparkSession, d: str) -> DataFrame:
    k = F.col("race_id")
    state = racing.races(s, d).select("race_id", F.when(k % 7 == 0, "no-data").when(k % 5 != 0, "healthy").alias("status"), instant().alias("last_attempt_at"), F.when(k % 7 != 0, instant()).alias("last_success_at"))
    scores = racing.past_places(s, d).select(*KEY, scoring.field_score(F.col("places")).alias("score"))
    return reports.field_coverage(racing.races(s, d), scores, state)


def ledger(s: SparkSession, d: str) -> DataFrame:
    """A ticket a window and profile; every third window isn't evaluated."""
    by = ticket_legs(s, d).groupBy("card").agg(F.sum("race_id").alias("k"), F.count("*").alias("n"))
    profiles = F.explode(F.array(*[F.lit(p) for p in tickets.PROFILES])).alias("profile")
    done = F.col("k") % 3 != 0
    rows = by.select("card", "k", "n", profiles).select("profile", instant().alias("generated_at"), F.when(done, instant()).alias("evaluated_at"), (done & (F.col("n") % 7 == 0)).alias("six_of_six"), (done & (F.col("n") % 3 == 0)).alias("five_of_six"))
    return reports.ticket_ledger(rows)


def runner_dossiers(s: SparkSession, d: str) -> DataFrame:
    points = racing.share_points(s, d)
    order = market.Window.partitionBy(*KEY).orderBy(F.col("captured_at").desc(), "agf_percent")
    latest = points.withColumn("place", F.row_number().over(order)).where("place <= 30")
    scores = racing.past_places(s, d).select(*KEY, scoring.field_score(F.col("places")).alias("score"))
    found = reports.dossiers(racing.runners(s, d).select(*KEY), racing.picks(s, d), latest, scores, KEY)
    said = F.array_join(F.transform("picks", lambda p: F.concat_ws("/", p["source_key"], p["source_rank"])), ",")
    return found.select(*KEY, said.alias("picks"), F.array_join(F.transform("points", lambda p: F.unix_seconds(p["captured_at"])), ",").alias("points"), "field_score")


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return reports.history_outcomes(racing.runners(s, d).select(*KEY), racing.results(s, d))


def chain(s: SparkSession, d: str) -> DataFrame:
    """Four layers of the dates; some starts lie on another day, some captures after the start."""
    races, k = racing.races(s, d), F.col("race_id")
    moved = lambda n: F.when(k % n == 0, F.col("starts_at") + F.expr("interval 1 day")).otherwise(F.col("starts_at")).alias("starts_at")
    taken = races.select("race_date", "city", moved(37), F.when(k % 41 == 0, F.col("starts_at") + F.expr("interval 2 days")).otherwise(F.col("starts_at") - F.expr("interval 5 minutes")).alias("captured_at"))
    return reports.date_chain({"meetings": races.select("race_date", "city").distinct(), "races": races.select("race_date", "city", moved(31)), "candidates": taken, "learning": races.where("race_number <= 6").select("race_date", "city", moved(43))})


def adjustments(s: SparkSession, d: str) -> DataFrame:
    """Mean absolute difference between the learned and the base score."""
    from .registry import adjusted

    rows = adjusted(s, d)
    return rows.agg(F.count("*").alias("runners"), numeric.rounded(F.avg(F.abs(F.round(F.col("adjustment") * 100).cast("long")).cast("double")) / 100, 6).alias("mean_absolute_adjustment"))


def progress(s: SparkSession, d: str) -> DataFrame:
    """Races and runners by city: in all, labelled, pending."""
    done = racing.results(s, d).select("race_id").distinct().withColumn("done", F.lit(True))
    n = racing.runners(s, d).groupBy("race_id").agg(F.count("*").alias("n"))
    rows = racing.races(s, d).select("race_id", "city").join(n, "race_id", "left").join(done, "race_id", "left")
    return rows.groupBy("city").agg(F.count("*").alias("races"), F.count("done").alias("labelled"), F.coalesce(F.sum("n"), F.lit(0)).alias("runners"), F.coalesce(F.sum(F.when(F.col("done"), F.col("n"))), F.lit(0)).alias("labelled_runners"))


def race_coverage(s: SparkSession, d: str) -> DataFrame:
    """Per race: runners, and how many have a share, form, a pick, a market point, a field score; stored once a session, so that its joins by runner take all sides where they lie."""
    return once(s, d, "race_coverage", CARDS, lambda: covered(s, d), by=None, deal=False)


def covered(s: SparkSession, d: str) -> DataFrame:
    runners = racing.runners(s, d)
    field = dealt(racing.past_places(s, d).where(F.size("places") > 0).select(*KEY))
    kinds = {"picks": racing.picks(s, d), "market": racing.share_points(s, d), "field": field}
    rows = runners.select(*KEY, "agf_bp", "recent_form_raw")
    for name, df in kinds.items():
        rows = rows.join(df.select(*KEY).distinct().withColumn(name, F.lit(True)), KEY, "left")
    return rows.groupBy("race_id").agg(F.count("*").alias("runners"), F.count("agf_bp").alias("with_share"), F.count_if(F.col("recent_form_raw") != "").alias("with_form"), *[F.count(n).alias(f"with_{n}") for n in kinds])


def picks_by_race(s: SparkSession, d: str) -> DataFrame:
    """Picks, distinct sources and runners of every race."""
    return racing.picks(s, d).groupBy("race_id").agg(F.count("*").alias("picks"), F.countDistinct("source_key").alias("sources"), F.countDistinct("horse_number").alias("horses"))


def queries() -> dict:
    return {
        "form_history": form_history, "insert_ignore": insert_ignored, "reconcile": reconciled, "without_composite": composite, "retention": retained, "local_instants": instants, "entity_names": entity_names,
        "pick_categories": pick_categories, "combined_fields": combined_fields, "ticket_inputs": ticket_inputs, "ticket_costs": ticket_costs, "result_rows": result_cells, "changed_pages": pages_changed,
        "stage_report": stage_statuses, "field_coverage": field_state, "totals": lambda s, d: reports.totals(racing.races(s, d), racing.runners(s, d)),
        "overview": lambda s, d: reports.overview(racing.races(s, d), racing.runners(s, d), health(s), racing.share_points(s, d)), "source_health": lambda s, d: gaps.source_health(health(s).join(racing.picks(s, d).select("source_key").distinct(), "source_key", "left_semi")),
        "ticket_ledger": ledger, "runner_dossiers": runner_dossiers, "history_outcomes": outcomes, "date_chain": chain, "adjustment_size": adjustments, "labelled_runners": progress, "race_coverage": race_coverage, "picks_by_race": picks_by_race,
        "market_features_at_capture": lambda s, d: market.features(market.pre_race(racing.share_points(s, d).join(racing.races(s, d).select("race_id", "race_date", "city", "race_number"), "race_id")), F.col("starts_at") - F.expr("interval 20 minutes")),
    }


DAY = "(starts_at + interval 3 hour)::date <> race_date"
MOVED = "case when race_id % {} = 0 then starts_at + interval 1 day else starts_at end"
FINISHES = ", ".join(f"{x}::double" for x in (100, 86, 74, 62, 52, 42, 34, 27, 20))


def bodies() -> dict[str, tuple[str, str]]:
    """name -> (common table expressions after those of the tables, query)."""
    from .oracles import ADJUSTED, FIELD

    mean = f"list_sum(list_transform(generate_series(1, n), lambda i: (case when p[i] between 1 and 9 then [{FINISHES}][p[i]] else 20.0::double end) * {AGES}[i])) / list_sum({AGES}[1:n])"
    step = "case trend when 'improving' then 6 when 'declining' then -6 else 0 end"
    named = "'kır İsi ' || horse_id"
    asof = lambda bound: f"max_by(agf_percent, captured_at) filter (captured_at <= {bound})"
    inside = "filter (captured_at >= starts_at - interval 90 minute and captured_at <= starts_at - interval 20 minute)"
    return {
        "form_history": ("h as (select horse_id, finish_position, row_number() over (partition by horse_id order by race_date desc, finish_position, distance_meters nulls first, city) as k from runners join races using (race_id) where finish_position > 0), "
            "g as (select horse_id, count(*) as races, list(finish_position order by k) filter (k <= 5) as p from h group by horse_id), "
            "t as (select *, len(p) as n, case when len(p) < 3 then 'unknown' when list_avg(p[1:2]) <= list_avg(p[3:]) - 1 then 'improving' when list_avg(p[1:2]) >= list_avg(p[3:]) + 1 then 'declining' else 'stable' end as trend from g)",
            f"select horse_id, races, array_to_string(p, ',') as places, {r(clamp(f'{mean} + {step}', 0, 100), 1)} as score, trend from t"),
        "insert_ignore": ("", f"select race_id, horse_number, captured_at, agf_percent from {SHARES} where (epoch_us(captured_at) // 60000000 + race_id) % 2 <> 0"),
        "reconcile": ("", "select race_id, horse_number from runners where race_id in (select race_id from results)"),
        "without_composite": ("", "select race_id, city from races where race_id % 7 <> 0"),
        "retention": ("", "select race_id, race_date from races where race_date >= date '1995-05-16' or race_id not in (select race_id from results)"),
        "local_instants": ("", "select race_id, case when race_id % 9 <> 0 then race_date + starts_at::time - interval 3 hour end as at, case when race_id % 9 <> 0 then race_date + 1 + (starts_at - interval 3 hour)::time end as moved from races"),
        "entity_names": ("", f"select race_id, horse_number, case when horse_id % 3 <> 0 then 'tjk-horse:' || horse_id else 'horse-name:KIR İSİ ' || horse_id || ' (7)' end as horse_key, "
            f"case when jockey_id % 2 = 0 then 'tjk-jockey:' || jockey_id when jockey_id is not null then 'jockey-name:JOKEY ' || jockey_id end as jockey_key, {named} as display, 'KIR İSİ ' || horse_id || ' (7)' as label, 'KIRİSİ' || horse_id as repair from runners"),
        "pick_categories": ("", "select source_key, case when is_banko then 'banko' when is_favorite then 'favorite' when is_strong then 'strong' when is_star then 'star' when is_rival then 'rival' when is_surprise then 'surprise' else 'none' end as category, count(*) as picks from picks group by all"),
        "combined_fields": (FIELD + ", b as (select race_id, horse_number, field_score as m, case when horse_id % 5 in (2, 3) then weight end as e from runners join fields using (race_id, horse_number))",
            f"select race_id, horse_number, case when m is not null and e is not null then {r('0.75::double * m + 0.25::double * e', 1)} else coalesce(m, e) end as field_score from b"),
        "ticket_inputs": (WINDOWS + ", i as (select card, sum(race_id)::bigint as k from legs group by card), filled as (select card, count(distinct leg) as f from legs where race_id % 11 <> 0 group by card), "
            "j as (select i.card, coalesce(f, 0) as f, case when k % 13 = 0 then 5 else 6 end as n, k % 7 as b, k % 5 as m from i left join filled on i.card = filled.card)",
            "select card, unnest(list_filter([case when n <> 6 then 'SIX_FOLD_REQUIRES_6_LEGS' end, case when b in (0, 2) then 'INVALID_COUPON_BUDGET' end, case when f < n then 'EMPTY_COUPON_LEG' end, case when m in (0, 1) then 'INVALID_MULTIPLIER' end, "
            "case when b = 1 and m <> 1 then 'BUDGET_BELOW_MINIMUM' end], lambda x: x is not null)) as code from j"),
        "ticket_costs": (WINDOWS + ", c as (select card, leg, ceil(count(*) / 2) as n from legs group by all), p as (select card, product(n)::double as n from c group by card), q as (select card, n * unit * 2 as cost from p join units using (card))",
            "select card, cost, case when cost <= 100 then 'micro' when cost <= 300 then 'small' when cost <= 1000 then 'medium' when cost <= 3000 then 'large' else 'extended' end as band from q"),
        "result_rows": ("", "select 'p' as page_id, race_id as race_no, horse_number, name, finish_position from results where race_id % 29 <> 0"),
        "changed_pages": ("", "select page_id, sha256(coalesce(url, '') || '|' || coalesce(html, '')) as fingerprint from pages where page_id % 5 = 0 or (page_id % 4 = 0 and coalesce(html, '') <> '')"),
        "stage_report": ("", "select stage, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as error, count(*) filter (status = 'skipped') as skipped from ("
            "select 'labels' as stage, case when race_id % 4 = 0 then 'error' else 'ok' end as status from races where race_id % 10 <> 0 union all select 'priors', case when race_id % 3 = 0 then 'skipped' else 'ok' end from races where race_id % 10 <> 0) group by stage"),
        "field_coverage": (FIELD, "select race_id, race_date, city, race_number, count(horse_number) as signal_rows, count(field_score) as scored_rows, case when race_id % 7 = 0 then 'no-data' when race_id % 5 <> 0 then 'healthy' end as status, "
            "timestamp '1995-06-15 12:00:00' as last_attempt_at, case when race_id % 7 <> 0 then timestamp '1995-06-15 12:00:00' end as last_success_at from races left join fields using (race_id) group by race_id, race_date, city, race_number"),
        "totals": ("", "select race_date, count(*) as runners, count(agf_bp) as with_share, count(*) filter (trim(recent_form_raw) <> '') as with_form from runners join races using (race_id) group by race_date"),
        "overview": ("", f"select (select count(*) from races) as races, (select count(*) from runners) as runners, 8 as sources, 1 as degraded, (select count(*) from {SHARES} where captured_at >= starts_at) as late_captures, 'degraded' as status"),
        "source_health": ("", "select enabled, case when source_key = 'src3' then 'error' else 'healthy' end as status, count(*) as sources, count(*) filter (enabled and source_key = 'src3') as degraded from sources where source_key in (select source_key from picks) group by all"),
        "ticket_ledger": (WINDOWS + ", l as (select card, sum(race_id)::bigint % 3 <> 0 as done, count(*) as n from legs group by card)",
            "select profile, count(*) as tickets, count(*) filter (not done) as pending, count(*) filter (done and n % 7 = 0) as six_of_six, count(*) filter (done and n % 3 = 0) as five_of_six, "
            "timestamp '1995-06-15 12:00:00' as latest_generation, max(case when done then timestamp '1995-06-15 12:00:00' end) as latest_evaluation from l, (values ('economic'), ('balanced'), ('maximum')) t(profile) group by profile"),
        "runner_dossiers": (FIELD + ", a as (select race_id, horse_number, array_to_string(list(source_key || '/' || source_rank order by source_key, source_rank, confidence), ',') as picks from picks group by all), "
            f"b as (select race_id, horse_number, array_to_string(list(epoch_us(captured_at) // 1000000 order by captured_at desc), ',') as points from {SHARES} group by all)",
            "select race_id, horse_number, coalesce(a.picks, '') as picks, coalesce(b.points, '') as points, field_score from fields left join a using (race_id, horse_number) left join b using (race_id, horse_number)"),
        "history_outcomes": ("", "select u.race_id, u.horse_number, o.finish_position as finish, u.race_id in (select race_id from results where finish_position is not null) as result_available from runners u left join results o using (race_id, horse_number)"),
        "date_chain": (f"a as (select race_date, city, count(*) as n, count(*) filter (race_id % 31 = 0) as wrong from races group by all), b as (select race_date, city, count(*) as n, count(*) filter (race_id % 37 = 0) as wrong, count(*) filter (race_id % 41 = 0) as late from races group by all), "
            "c as (select race_date, city, count(*) as n, count(*) filter (race_id % 43 = 0) as wrong from races where race_number <= 6 group by all), lateday as (select race_date, city, "
            f"count(*) filter ((({MOVED.format(31)}) + interval 3 hour)::date <> race_date) as w31, count(*) filter ((({MOVED.format(37)}) + interval 3 hour)::date <> race_date) as w37, count(*) filter (race_number <= 6 and (({MOVED.format(43)}) + interval 3 hour)::date <> race_date) as w43 from races group by all)",
            "select race_date, city, 1 as meetings, a.n as races, b.n as candidates, coalesce(c.n, 0) as learning, array_to_string(list_filter([case when w31 > 0 then 'RACE_DATE_STARTS_AT_MISMATCH' end, case when w37 > 0 then 'CANDIDATE_DATE_STARTS_AT_MISMATCH' end, "
            "case when late > 0 then 'CANDIDATE_CAPTURE_AFTER_START' end, case when w43 > 0 then 'LEARNING_DATE_STARTS_AT_MISMATCH' end], lambda x: x is not null), ',') as anomalies from a join b using (race_date, city) left join c using (race_date, city) join lateday using (race_date, city)"),
        "adjustment_size": (ADJUSTED, f"select count(*) as runners, {r('avg(abs(round(adjustment * 100)::bigint)::double) / 100', 6)} as mean_absolute_adjustment from adjusted"),
        "labelled_runners": ("n as (select race_id, count(*) as n from runners group by race_id), k as (select distinct race_id, true as done from results)",
            "select city, count(*) as races, count(done) as labelled, coalesce(sum(n), 0)::bigint as runners, coalesce(sum(case when done then n end), 0)::bigint as labelled_runners from races left join n using (race_id) left join k using (race_id) group by city"),
        "race_coverage": ("", f"select race_id, count(*) as runners, count(agf_bp) as with_share, count(*) filter (recent_form_raw <> '') as with_form, count(*) filter ((race_id, horse_number) in (select (race_id, horse_number) from picks)) as with_picks, "
            f"count(*) filter ((race_id, horse_number) in (select (race_id, horse_number) from {SHARES})) as with_market, count(*) filter ((race_id, horse_number) in (select (race_id, horse_number) from past where len(places) > 0)) as with_field from runners group by race_id"),
        "picks_by_race": ("", "select race_id, count(*) as picks, count(distinct source_key) as sources, count(distinct horse_number) as horses from picks group by race_id"),
        "market_features_at_capture": (f"pre as (select s.*, race_date, city, race_number from {SHARES} s join races using (race_id) where captured_at < s.starts_at)",
            f"select race_date, city, race_number, horse_number, {asof('starts_at - interval 90 minute')} as t90, {asof('starts_at - interval 30 minute')} as t30, null::double as t5, {asof('starts_at - interval 20 minute')} as final, "
            f"max(agf_percent) {inside} - min_by(agf_percent, captured_at) {inside} as max_rise, min(agf_percent) {inside} - min_by(agf_percent, captured_at) {inside} as max_fall from pre group by all"),
    }
