"""The registered queries in DuckDB's SQL, written on their own."""

from __future__ import annotations

from ..functions.signals import LEAST_SAMPLES, POSITIVE, STRENGTH
from ..sources.racing import SQL as TABLES

FLAGS = (*POSITIVE, "avoid")


def r(x: str, digits: int) -> str:
    return f"(floor(({x})::double * 1e{digits}::double + 0.5::double) / 1e{digits}::double)"


def clamp(x: str, low: float, high: float) -> str:
    return f"(case when ({x}) is not null then greatest({low}::double, least({high}::double, {x})) end)"


STRONGEST = "case " + " ".join(f"when is_{c} then {v}::double" for c, v in STRENGTH.items()) + " else 0.0::double end"
RATES = "count(*) as samples, count(*) filter (finish_position = 1) as wins, count(*) filter (finish_position between 1 and 3) as top3"
LEAST = "case category " + " ".join(f"when '{c}' then {n}" for c, n in LEAST_SAMPLES.items()) + " end"
RATIO = "{w}::double * case when base_win > 0 then win_rate / base_win else 1 end + {t}::double * case when base_top3 > 0 then top3_rate / base_top3 else 1 end - 1"
QUALITY = RATIO.format(w=0.65, t=0.35)
BASE = "base as (select samples, wins / samples as win_rate, top3 / samples as top3_rate from (select count(*) as samples, count(*) filter (finish_position = 1) as wins, count(*) filter (finish_position between 1 and 3) as top3 from runners))"
FIRST = f"""
firsts as (select * from picks qualify row_number() over (partition by race_id, horse_number, source_key order by source_rank, k) = 1), {BASE},
source_hits as (select source_key, {RATES} from firsts join (select race_id, horse_number, finish_position from runners) using (race_id, horse_number) where {' or '.join(f'is_{c}' for c in POSITIVE)} group by source_key),
source_rates as (select h.*, wins / h.samples as win_rate, top3 / h.samples as top3_rate, b.win_rate as base_win, b.top3_rate as base_top3 from source_hits h, base b),
source_priors as (select source_key, samples, wins, top3, case when samples < 30 then 1.0::double else {r('1 + ' + clamp(f'({QUALITY}) * 0.15::double * least((samples - 29) / 121, 1.0::double)', -0.15, 0.15), 4)} end as multiplier from source_rates),
each as (select *, unnest(list_filter([{', '.join(f"case when is_{c} then '{c}' end" for c in POSITIVE)}], lambda x: x is not null)) as category from firsts),
category_hits as (select source_key, category, {RATES} from each join (select race_id, horse_number, finish_position from runners where finish_position >= 1) using (race_id, horse_number) group by all),
category_rates as (select *, wins / samples as win_rate, top3 / samples as top3_rate, sum(wins) over c / sum(samples) over c as base_win, sum(top3) over c / sum(samples) over c as base_top3 from category_hits window c as (partition by category)),
category_priors as (select source_key, category, samples, wins, top3, case when samples < {LEAST} then 1.0::double else {r('1 + ' + clamp(f'({QUALITY}) * 0.12::double * ' + clamp(f'(samples - {LEAST} + 1) / 100.0::double', 0, 1), -0.12, 0.12), 4)} end as multiplier from category_rates),
named as (select *, coalesce({', '.join(f"case when is_{c} then '{c}' end" for c in POSITIVE)}) as category from firsts),
calibrated as (select n.*, base_weight * coalesce(p.multiplier, 1.0::double) * coalesce(q.multiplier, 1.0::double) as calibrated_weight from named n join sources using (source_key)
  left join source_priors p using (source_key) left join category_priors q on q.source_key = n.source_key and q.category = n.category where enabled),
weighted as (select *, least(1.5::double, greatest(0.1::double, calibrated_weight)) * (0.4::double + 0.6::double * confidence) / (1 + 0.06::double * (source_rank - 1)) as w from calibrated),
summed as (select race_id, horse_number, count(*) as source_count, {", ".join(f"count(*) filter (is_{c}) as {c}_count" for c in FLAGS)}, {", ".join(f"sum(case when is_{c} then w else 0.0 end) as weighted_{c}" for c in FLAGS)}, sum(w) as weight_sum,
  sum(case when is_avoid then 0.0 else w * {STRONGEST} end) as support, sum(case when is_avoid then 0.9::double * w else 0.0 end) as opposition
  from weighted group by race_id, horse_number),
consensus as (select race_id, horse_number, source_count, {", ".join(f"{c}_count" for c in FLAGS)}, {", ".join(f"{r(f'weighted_{c}', 3)} as weighted_{c}" for c in FLAGS)}, {r("support", 3)} as support, {r("opposition", 3)} as opposition,
  {r(clamp("50 + 50 * (support - opposition) / weight_sum", 0, 100), 0)} as expert_score, {r("1 - exp(-source_count / 2.5::double)", 2)} as expert_confidence,
  array_to_string(list_filter([{", ".join(f"case when {c}_count > 0 then '{c}' end" for c in FLAGS)}], lambda x: x is not null), ',') as labels from summed)
"""
PLACES = ", ".join(f"{x}::double" for x in (100, 86, 74, 62, 52, 43, 35, 28, 22, 16))
FORM = f"""
digits as (select *, list_transform(list_filter(string_split(reverse(right(regexp_replace(recent_form_raw, '[^0-9]', '', 'g'), 6)), ''), lambda x: x <> ''),
  lambda x: case when x = '0' then 10 else x::int end) as p from runners),
means as (select *, [1.0::double, 0.85, 0.7, 0.55, 0.4, 0.3][1:len(p)] as ws, len(p) as n, list_avg(p[1:2]) as recent, list_avg(p[3:]) as older from digits),
trends as (select *, case when n < 4 then 'unknown' when recent <= older - 1 then 'improving' when recent >= older + 1 then 'declining' else 'stable' end as trend from means),
formed as (select *, case when n > 0 then {r(clamp(f"list_sum(list_transform(generate_series(1, n), lambda i: [{PLACES}][p[i]] * ws[i])) / list_sum(ws) + case trend when 'improving' then 5 when 'declining' then -5 else 0 end", 0, 100), 1)} end as form_score from trends)
"""


def scaled(x: str) -> str:
    low, high = f"min({x}) over (partition by race_id)", f"max({x}) over (partition by race_id)"
    return f"case when {x} is null then null when {high} <= {low} then 50.0::double else ({x} - {low}) / ({high} - {low})::double * 100 end"


PARTS = {"agf_score": 25, "expert_part": 22, "form_score": 18, "hp_score": 15, "market_score": 10, "weight_score": 5, "field_score": 5}


def moved(keys: str, points: str, minutes: int) -> str:
    """CTEs b, m and moved: movement of the share by `keys`."""
    d, rel = "(z - a)", "((z - a) / greatest(a, 5.0::double))"
    return f"""b as (select {keys}, count(distinct (captured_at, agf_percent)) as sample_size, min_by(agf_percent, (captured_at, agf_percent)) as a, max_by(agf_percent, (captured_at, agf_percent)) as z, max(captured_at) - min(captured_at) as span
  from {points} where captured_at between starts_at - interval {minutes} minute and starts_at group by {keys}),
moved as (select {keys}, case when sample_size >= 2 and span >= interval 4 minute then {r(clamp('50 + 30 * ' + clamp(f'{d} / 10', -1, 1) + ' + 20 * ' + clamp(f'{rel} / 0.5::double', -1, 1), 0, 100), 1)} end as market_score from b)"""


AGES = "[1.0::double, 0.85, 0.7, 0.55, 0.4]"
FIELD_PLACES = ", ".join(f"{x}::double" for x in (100, 86, 74, 63, 53, 44, 36, 29, 23, 15))
FIELD = f"""fields as (select race_id, horse_number, case when len(places) > 0 then {r(f"50 + (list_sum(list_transform(generate_series(1, len(places)), lambda i: (case when places[i] between 1 and 10 then [{FIELD_PLACES}][places[i]] else 15.0::double end) * {AGES}[i])) / list_sum({AGES}[1:len(places)]) - 50) * least(len(places) / 3.0::double, 1.0::double)", 1)} end as field_score from past)"""
CARD = f"""{FIRST}, {FORM}, {moved("race_id, horse_number", "share_points", 90)}, {FIELD},
parts as (select f.*, agf_bp / 100.0::double as agf_score, 50 + (expert_score - 50) * expert_confidence as expert_part, market_score, field_score,
  {scaled("hp::double")} as hp_score, 100 - ({scaled("weight")}) as weight_score
  from formed f left join (select race_id, horse_number, expert_score, expert_confidence from consensus) using (race_id, horse_number) left join moved using (race_id, horse_number) left join fields using (race_id, horse_number)),
card as (select *, {r("(" + " + ".join(f"coalesce({c} * {w}, 0.0::double)" for c, w in PARTS.items()) + ") / (" + " + ".join(f"case when {c} is null then 0 else {w} end" for c, w in PARTS.items()) + ")", 2)} as score,
  {r("(" + " + ".join(f"case when {c} is null then 0 else {w} end" for c, w in PARTS.items()) + ") / 100.0::double", 3)} as model_confidence from parts)
"""
CONTEXT = """
ctx as (select u.*, city, coalesce(track, 'unknown') as track_key, case when distance_meters < 1300 then 'sprint' when distance_meters <= 1700 then 'middle' else 'route' end as band
  from runners u join races using (race_id)),
entities as (select *, unnest([{'t': 'horse', 'k': horse_id::varchar}, {'t': 'jockey', 'k': jockey_id::varchar}, {'t': 'pair', 'k': horse_id::varchar || '|' || jockey_id::varchar}]) as e from ctx),
priors as (select e.t as entity_type, e.k as entity_key, city, track_key, band, count(*) as samples, count(*) filter (finish_position = 1) as wins,
  count(*) filter (finish_position between 1 and 3) as top3, floor(avg(case when finish_position > 0 then finish_position end) * 1e4 + 0.5) / 1e4 as avg_finish
  from entities where e.k is not null group by all)
"""
def signal(kind: str, least: int, full: int) -> str:
    quality = f"(0.6::double * ({kind}.wins / {kind}.samples / win_rate) + 0.4::double * ({kind}.top3 / {kind}.samples / top3_rate) - 1) * 20"
    return f"case when {kind}.samples >= {least} then {clamp(quality, -12, 12)} * {clamp(f'({kind}.samples - {least} + 1) / {full - least + 1}.0::double', 0, 1)} end"


def prior_join(kind: str, key: str) -> str:
    return f"left join priors {kind} on {kind}.entity_type = '{kind}' and {kind}.entity_key = {key} and {kind}.city = c.city and {kind}.track_key = c.track_key and {kind}.band = c.band"


ADJUSTED = f"""{CARD}, {CONTEXT},
signals as (select c.race_id, c.horse_number, c.finish_position, {signal("horse", 6, 20)} as h, {signal("jockey", 20, 80)} as j, {signal("pair", 5, 15)} as p
  from ctx c {prior_join("horse", "c.horse_id::varchar")} {prior_join("jockey", "c.jockey_id::varchar")} {prior_join("pair", "c.horse_id::varchar || '|' || c.jockey_id::varchar")}, base),
shares as (select *, (case when h is null then 0.0 else 0.5 end + case when j is null then 0.0 else 0.3 end + case when p is null then 0.0 else 0.2 end)::double as share,
  coalesce(h * 0.5::double, 0) + coalesce(j * 0.3::double, 0) + coalesce(p * 0.2::double, 0) as total from signals),
adjusted as (select s.race_id, s.horse_number, s.finish_position, case when share > 0 then {r(clamp("total / share", -5, 5), 2)} else 0.0::double end as adjustment, case when share > 0 then total / share end as signal, score as base_score,
  {r("score + case when share > 0 then " + r(clamp("total / share", -5, 5), 2) + " else 0.0::double end", 2)} as shadow_score
  from shares s join card c on s.race_id = c.race_id and s.horse_number = c.horse_number)
"""
FROZEN = "frozen as (select race_id, horse_number, 'HORSE ' || horse_id as name from runners)"
AUDIT = f"""{FROZEN},
compared as (select race_id, count(f.name) as expected, count(o.name) as found, bool_and(coalesce(f.name = o.name, false)) as same from frozen f full join results o using (race_id, horse_number) group by race_id),
audit as (select race_id, expected, found, case when expected = 0 then 'NO_FROZEN_SNAPSHOT' when expected <> found then 'RUNNER_COUNT_MISMATCH' when not same then 'RUNNER_IDENTITY_MISMATCH' else 'LABELLED' end as reason
  from compared where found > 0)
"""
UNCERTAIN = f"""{CARD},
tops as (select race_id, count(*) as runners, max(score) as leader_score, list_sort(list(score), 'desc')[2] as second, sum(round(model_confidence * 1000)::bigint)::bigint / count(*) / 1000.0::double as conf from card group by race_id),
us as (select *, coalesce(leader_score - second, leader_score) as m, {clamp("0.7::double * " + clamp("1 - coalesce(leader_score - second, leader_score) / 25", 0, 1) + " + 0.3::double * (1 - " + clamp("conf", 0, 1) + ")", 0, 1)} as u from tops),
uncertain as (select race_id, runners, leader_score, {r("m", 2)} as margin, {r("conf", 3)} as confidence, {r("u * 100", 1)} as uncertainty, {r("u", 3)} as pressure,
  case when u < 0.25 then 'low' when u < 0.5 then 'medium' when u < 0.75 then 'high' else 'very-high' end as level from us)
"""
SELECTED = f"""{UNCERTAIN},
modes as (select *, case when level = 'low' and confidence >= 0.75 and margin >= 8 then 'single' when level in ('low', 'medium') and confidence >= 0.6 and margin >= 3 then 'compact' else 'spread' end as mode from uncertain),
sized as (select *, least(runners, case mode when 'single' then 1 when 'compact' then case when pressure < 0.4 then 2 else 3 end else greatest(3, ceil(runners * greatest(0.35::double, pressure))) end) as k from modes),
ranked as (select race_id, horse_number, row_number() over (partition by race_id order by score desc, horse_number) as place from card),
selected as (select race_id, mode, list_sort(list(horse_number)) as horses from ranked join sized using (race_id) where place <= k group by race_id, mode)
"""
WINDOWS = """
placed as (select *, row_number() over (partition by race_date, city order by race_number) as position, count(*) over (partition by race_date, city) as n from races),
windows as (select race_date, city, w.i as sixfold_number, position - case w.i when 1 then 0 else n - 6 end as place, race_number, race_id from placed, (values (1::bigint), (2)) w(i)
  where n >= 6 and (w.i = 1 and position <= 6 or w.i = 2 and n > 6 and position > n - 6)),
legs as (select race_date::varchar || '|' || city || '|' || sixfold_number as card, city, place as leg, race_id, horse_number, coalesce(agf_bp / 100.0::double, 0.0) as score, (1 + horse_id % 10) / 10.0::double as confidence from windows join runners using (race_id)),
units as (select distinct race_date::varchar || '|' || city || '|' || sixfold_number as card, case when contains(city, ' ') or city in ('diyarbakır', 'elazığ', 'şanlıurfa') then 1.0 else 1.25 end::double as unit from windows)
"""
# every combination of three legs on each side and every affordable pair of sizes: brute force over sizes, not over runners
TICKETS = f"""{WINDOWS},
ws as (select *, exp((score - max(score) over (partition by card, leg)) / 14) * (0.6::double + 0.4::double * greatest(0.2::double, least(1.0::double, confidence))) as w from legs),
ch as (select card, leg, row_number() over o as k, sum(w) over o / sum(w) over (partition by card, leg) as p from ws window o as (partition by card, leg order by score desc, horse_number rows unbounded preceding)),
full_cards as (select card from ch group by card having count(distinct leg) = 6),
halves as (select a.card, a.leg as half, a.k * b.k * c.k as q, max(a.p * b.p * c.p) as s from ch a join ch b on a.card = b.card and b.leg = a.leg + 1 join ch c on a.card = c.card and c.leg = a.leg + 2
  where a.leg in (1, 4) and a.card in (select card from full_cards) group by all),
pays as (select card, unit, budget::double as budget, profile, floor(least(budget, greatest(unit, budget * f)) / unit + 1e-9)::bigint as most
  from units, (values (300), (1000), (3000)) t(budget), (values ('economic', 0.45::double), ('balanced', 0.80::double), ('maximum', 1.0::double)) u(profile, f)),
pairs as (select l.card, budget, profile, unit, round(l.s * h.s, 12) as survival, l.q * h.q as combinations from halves l join halves h on l.card = h.card and l.half = 1 and h.half = 4 join pays on pays.card = l.card and l.q * h.q <= most)
select card, budget, profile, {r("max(survival)", 6)} as survival, max_by(combinations, (survival, combinations)) as combinations, max_by(combinations, (survival, combinations)) * any_value(unit) as cost from pairs group by card, budget, profile
"""


def metrics(score: str) -> str:
    x = f"rank_{score}"
    return ", ".join([*[f"{r(f'avg(({x} <= {k})::int::double)', 6)} as {score}_top{k}" for k in (1, 3, 5)], f"{r(f'avg({x}::double)', 6)} as {score}_mean_rank", f"{r(f'avg(1.0::double / {x})', 6)} as {score}_mrr"])


EVALUATION = f"""{ADJUSTED},
ranks as (select race_id, {", ".join(f"min(case when finish_position = 1 then rank_{s} end) as rank_{s}" for s in ("base_score", "shadow_score"))}
  from (select *, {", ".join(f"(select count(*) from adjusted o where o.race_id = a.race_id and o.finish_position >= 1 and o.{s} > a.{s}) + 1 as rank_{s}" for s in ("base_score", "shadow_score"))} from adjusted a where finish_position >= 1)
  group by race_id),
m as (select count(*) as races, {metrics("base_score")}, {metrics("shadow_score")} from ranks where rank_base_score is not null),
g as (select *, case when races < 100 then 'insufficient-data' when shadow_score_top1 - base_score_top1 <= -0.02 and base_score_mean_rank - shadow_score_mean_rank <= -0.15 then 'learning-degraded'
  when shadow_score_top3 - base_score_top3 <= -0.03 and base_score_mean_rank - shadow_score_mean_rank <= -0.10 then 'learning-reduced' else 'healthy' end as status from m)
select *, case status when 'insufficient-data' then 0.0 when 'learning-degraded' then 0.25 when 'learning-reduced' then 0.5 else 1.0 end::double as scale from g
"""
RK = "race_date, city, race_number"
HK = f"{RK}, horse_number"
BEFORE = "starts_at - interval {} minute"
ASOF = "max_by(agf_percent, captured_at) filter (captured_at <= {})"

LATEST = "latest as (select race_date, city, max(race_id) as k from races group by all)"
DOCUMENT = """, x as (select race_date, city, race_number, case when race_id % 23 = 0 then 'noon' else strftime(starts_at, '%H:%M') end as time, horse_number,
  case when horse_id % 17 <> 0 then 'HORSE ' || horse_id end as name, case when horse_id % 19 = 0 then 'about' else 'https://a.b/c' end as url from races join runners using (race_id))"""


def all_sql() -> dict[str, str]:
    bodies = {
        "scored_card": (CARD, f"select race_id, horse_number, {', '.join(f'{r(c, 4)} as {c}' for c in PARTS)}, score, model_confidence from card"),
        "races_projection": ("", "select * from races"),
        "runners_projection": ("", "select * exclude (line, l_suppkey) from runners"),
        "date_scan": ("", "select race_id, race_date, city, race_number from races where race_date between date '1995-01-01' and date '1996-06-30'"),
        "distance_bands": ("", "select case when distance_meters < 1300 then 'sprint' when distance_meters <= 1700 then 'middle' else 'route' end as band, track, count(*) as races from races group by all"),
        "form_scores": (FORM, "select race_id, horse_number, form_score, trend from formed"),
        "expert_consensus": (FIRST, "select * from consensus"),
        "global_rates": (BASE, f"select samples, {r('win_rate', 6)} as win_rate, {r('top3_rate', 6)} as top3_rate from base"),
        "source_priors": (FIRST, "select * from source_priors"),
        "category_priors": (FIRST, "select * from category_priors"),
        "context_priors": (CONTEXT, "select * from priors"),
        "prior_summary": (CONTEXT, "select entity_type, count(*) as priors, sum(samples)::bigint as samples, max(samples) as most from priors group by entity_type"),
        "learned_adjustment": (ADJUSTED, "select race_id, horse_number, adjustment, base_score, shadow_score from adjusted"),
        "ranking_evaluation": (EVALUATION, ""),
        "race_uncertainty": (UNCERTAIN, "select * from uncertain"),
        "recommended_selection": (SELECTED, "select race_id, mode, array_to_string(horses, ',') as horses from selected"),
        "selection_metrics": (f"{SELECTED}, won as (select race_id, list(horse_number) as winners from runners where finish_position = 1 group by race_id)",
            f"select mode, count(*) as races, count(*) filter (list_has_any(horses, winners)) as covered, {r('count(*) filter (list_has_any(horses, winners)) / count(*)', 6)} as hit_rate, {r('sum(len(horses)) / count(*)', 6)} as mean_size from selected join won using (race_id) group by mode"),
        "market_features": ("pre as (select * from points where agf_percent between 0 and 100 and captured_at < starts_at)",
            f"select {HK}, {ASOF.format(BEFORE.format(90))} as t90, {ASOF.format(BEFORE.format(30))} as t30, {ASOF.format(BEFORE.format(5))} as t5, {ASOF.format('starts_at')} as final, "
            + ", ".join(f"{f}(agf_percent) filter (captured_at >= {BEFORE.format(90)}) - min_by(agf_percent, captured_at) filter (captured_at >= {BEFORE.format(90)}) as {n}" for f, n in (("max", "max_rise"), ("min", "max_fall"))) + f" from pre group by {HK}"),
        "market_movement": (f"b as (select {HK}, count(distinct (captured_at, agf_percent)) as sample_size, min_by(agf_percent, (captured_at, agf_percent)) as a, max_by(agf_percent, (captured_at, agf_percent)) as z, max(captured_at) - min(captured_at) as span "
            f"from points where captured_at between {BEFORE.format(1440)} and starts_at group by {HK}), m as (select *, sample_size >= 2 and span >= interval 4 minute as moved, z - a as d, (z - a) / greatest(a, 5.0::double) as rel from b)",
            f"select {HK}, sample_size, case when moved then {r(clamp('50 + 30 * ' + clamp('d / 10', -1, 1) + ' + 20 * ' + clamp('rel / 0.5::double', -1, 1), 0, 100), 1)} end as market_score, case when moved then {r('d', 2)} end as delta, "
            "case when not moved then 'unknown' when d >= 5 then 'strong-up' when d >= 1.5 then 'up' when d <= -5 then 'strong-down' when d <= -1.5 then 'down' else 'flat' end as direction from m"),
        "market_series": ("", f"select {HK}, count(*) as points, min(captured_at) as first_at, max(captured_at) as last_at, md5(array_to_string(list(epoch_us(captured_at) || '=' || floor(agf_percent * 100 + 0.5)::bigint order by captured_at, agf_percent), ',')) as series_md5 from points group by {HK}"),
        "market_latest": ("", f"select {HK}, captured_at, agf_percent, row_number() over (partition by {HK} order by captured_at desc, agf_percent) as place from points qualify place <= 30"),
        "market_coverage": ("", f"select {RK}, count(*) as points, count(distinct horse_number) as horses, count(distinct captured_at) as captures, min(captured_at) as first_capture, max(captured_at) as last_capture from points group by {RK}"),
        "minutes_to_start": ("obs as (select distinct race_date, captured_at from points), st as (select distinct race_date, date_trunc('hour', captured_at) as begins from points)",
            "select o.race_date, captured_at, floor(min(epoch_us(s.begins) - epoch_us(captured_at)) / 60000000.0)::bigint as minutes from obs o left join st s on s.race_date = o.race_date and s.begins >= o.captured_at group by all"),
        "label_audit": (AUDIT, "select * from audit"),
        "strict_labels": (AUDIT, "select race_id, horse_number, finish_position from results where race_id in (select race_id from audit where reason = 'LABELLED')"),
        "label_progress": (AUDIT, "select city, coalesce(reason, 'PENDING') as reason, count(*) as races from races left join audit using (race_id) group by all"),
        "label_backlog": (f"{AUDIT}, behind as (select race_date, city, count(*) as pending from races where race_id not in (select race_id from audit) group by all)", "select *, (select count(*) from behind) as meetings from behind order by race_date, city limit 20"),
        "set_comparison": (f"{FROZEN}, x as (select race_id, case when f.name is null then 'MISSING' when o.name is null then 'EXTRA' when f.name <> o.name then 'NAME' else 'SAME' end as kind from (select * from frozen where race_id % 5 <> 0) f full join results o using (race_id, horse_number))", "select kind, count(*) as rows, count(distinct race_id) as races from x group by kind"),
        "sixfold_windows": (WINDOWS, "select * from windows"),
        "ticket_backtest": (TICKETS, ""),
        "ticket_settlement": (f"{WINDOWS}, chosen as (select card, leg, race_id, horse_number from legs qualify row_number() over (partition by card, leg order by score desc, horse_number) <= 2), "
            "hit as (select card, leg, race_id, max((o.finish_position is not null)::int) as hit from chosen c left join (select * from results where finish_position = 1) o using (race_id, horse_number) group by all), "
            "done as (select card, count(*) as n, sum(hit)::bigint as hits, count(*) filter (race_id in (select race_id from results where finish_position = 1)) as resolved from hit group by card)",
            "select card, hits, hits = 6 as six_of_six, hits >= 5 as five_of_six from done where n = 6 and resolved = 6"),
        "card_summary": ("", "select race_date, city, count(*) as races, min(race_number) as first_race, max(race_number) as last_race, min(starts_at) as first_start, max(starts_at) as last_start, sum((select count(*) from lineitem where l_orderkey = race_id))::bigint as runners from races group by all"),
        "missing_values": ("", "select city, count(*) as runners, count(*) filter (agf_bp is null) as no_share, count(*) filter (recent_form_raw = '') as no_form, count(*) filter (hp is null) as no_hp, count(*) filter (jockey_id is null) as no_jockey from runners join races using (race_id) group by city"),
        "coverage": ("pk as (select distinct race_id, horse_number, true as picked from picks)", "select race_id, count(horse_number) as runners, count(agf_bp) as with_share, count(*) filter (recent_form_raw <> '') as with_form, count(picked) as with_pick from races left join runners using (race_id) left join pk using (race_id, horse_number) group by race_id"),
        "pick_coverage": ("", "select source_key, city, count(*) as picks, count(distinct (race_id, horse_number)) as runners, count(distinct race_id) as races from picks join races using (race_id) group by rollup (source_key, city) having source_key is not null"),
        "card_violations": ("", "select race_id, unnest(list_filter([case when distance_meters is null then 'DISTANCE_MISSING' end, case when race_id not in (select l_orderkey from lineitem) then 'NO_RUNNERS' end], lambda x: x is not null)) as code from races"),
        "result_violations": ("by_race as (select race_id, count(*) as n, count(*) filter (finish_position = 1) as winners from results group by race_id)", "select race_id, unnest(list_filter([case when n < 2 then 'TOO_FEW_RUNNERS' end, case when winners = 0 then 'NO_WINNER' end], lambda x: x is not null)) as code from by_race"),
        "invariants": ("", "select 'late_captures' as \"check\", count(*) as violations from points where captured_at >= starts_at union all select 'orphan_runners', count(*) from runners where race_id % 7 = 0 "
            "union all select 'repeated_runners', count(*) from (select 1 from runners group by race_id, horse_number having count(*) > 1) union all select 'repeated_races', count(*) from (select 1 from races group by race_date, city, race_number having count(*) > 1)"),
        "date_layers": (f"{AUDIT}, a as (select race_date, city, count(*) as n from races group by all), b as (select race_date, city, count(*) as n from results join races using (race_id) group by all), "
            "c as (select race_date, city, count(*) as n from picks join races using (race_id) group by all), d as (select race_date, city, count(*) as n from results join races using (race_id) where race_id in (select race_id from audit where reason = 'LABELLED') group by all)",
            "select race_date, city, coalesce(a.n, 0) as races, coalesce(b.n, 0) as results, coalesce(c.n, 0) as picks, coalesce(d.n, 0) as labels, array_to_string(list_filter([case when a.n is null then 'races' end, case when b.n is null then 'results' end, case when c.n is null then 'picks' end, case when d.n is null then 'labels' end], lambda x: x is not null), ',') as missing "
            "from a full join b using (race_date, city) full join c using (race_date, city) full join d using (race_date, city)"),
        "upsert": ("", "select race_id, horse_number, coalesce(agf_bp, 0) + (race_id % 3 = 0 or race_id % 2 = 0)::int as value, case when race_id % 3 = 0 then 2 else 1 end::bigint as version from runners"),
        "field_signals": (f"own as (select race_id, horse_id from runners), hist as (select horse_id, race_id as past, finish_position, race_date from runners join races using (race_id)), "
            "one as (select distinct o.race_id, o.horse_id, race_date, finish_position from own o join hist h on o.horse_id = h.horse_id and past <> o.race_id), "
            "best as (select race_id, horse_id, finish_position, row_number() over (partition by race_id, horse_id order by race_date desc, finish_position) as k from one), "
            "past5 as (select race_id, horse_id, list(finish_position order by k) filter (k <= 5) as places from best group by all), "
            "paired as (select u.race_id, u.horse_number, coalesce(places, []) as places from runners u left join past5 using (race_id, horse_id)), " + FIELD.replace("from past)", "from paired)").replace("case when len(places) > 0 then", "len(places) as n, case when len(places) > 0 then"),
            "select race_id, horse_number, field_score as score, n as sample_size, case when max(field_score) over (partition by race_id) is not null then 'healthy' else 'no-data' end as state from fields"),
        "insert_only": ("", "select race_id, city from races where race_id % 2 <> 0"),
        "newest_candidate": ("", f"select {HK}, max(captured_at) as captured_at, max_by(agf_percent, captured_at) as agf_percent, max_by(starts_at, captured_at) as starts_at from points where captured_at < starts_at group by {HK}"),
        "archive_documents": ("", "select race_id, count(*) as n_runners, (14 + sum(len('{\"horse_number\":,\"horse_id\":,\"finish_position\":},' || horse_number || horse_id || finish_position)) - 1)::bigint as size from runners join races using (race_id) group by race_id"),
        "pending_meetings": (f"{LATEST}", "select distinct race_date, city from races where starts_at <= timestamp '1995-06-15 11:50:00' and race_id % 3 <> 0 and (race_date, city) in (select (race_date, city) from latest where k % 4 <> 0)"),
        "field_gaps": ("sc as (select distinct race_id from runners where race_id % 11 <> 0 and hp is not null)",
            "select race_id, case when race_id % 5 = 0 then 'MISSING' when race_id % 7 = 0 then 'NOT_HEALTHY' else 'NO_SCORE' end as gap from races where race_id % 5 = 0 or race_id % 7 = 0 or (race_id % 2 <> 0 and race_id not in (select race_id from sc))"),
        "form_gaps": ("", "select distinct horse_id from runners where horse_id % 3 = 0 or horse_id % 4 = 0"),
        "pick_validation": ("", "select source_key, case when race_id % 6 = 0 then 'EXPERT_RUNNER_KEY_NOT_FOUND' when (race_id + horse_id) % 13 = 0 then 'EXPERT_HORSE_NAME_MISMATCH' else 'VALID' end as reason, count(*) as picks from picks join runners using (race_id, horse_number) group by all"),
        "comment_sentiment": ("c as (select race_id, horse_number, case when is_banko then 1 when is_strong and track = 'Kum' then 1 when is_strong then null when is_rival then -1 when is_avoid then 0 end as v from picks join races using (race_id))",
            f"select race_id, horse_number, count(*) as relevant, {r(clamp('50 + 40 * sum(v) / count(*)::double', 0, 100), 1)} as score from c where v is not null group by all"),
        "programme_rows": ("", DOCUMENT + " select race_date, city, race_number, time, horse_number, name, url from x"),
        "document_violations": ("", DOCUMENT + " select race_date, city, race_number, horse_number, unnest(list_filter([case when time = 'noon' then 'INVALID_TIME' end, case when name is null then 'EMPTY_RUNNER_NAME' end, case when url = 'about' then 'INVALID_URL' end], lambda v: v is not null)) as code from x"),
        "date_repair": (f"{FROZEN}, m as (select f.race_id, f.horse_number, f.name as s, o.name as o from frozen f left join results o using (race_id, horse_number)), ok as (select race_id, bool_and(o is not null and s = o) as good from m group by race_id)",
            "select race_id as mapping, case when good and race_id % 3 = 0 then 'DELETE_DUPLICATE_SOURCE' when good then 'MOVE_SOURCE_TO_TARGET' else 'MANUAL_REVIEW' end as classification from ok"),
        "history_violations": ("", "select jockey_id, case when jockey_id % 3 = 0 or max(finish_position) <= 0 then 'FORM_NO_USABLE_ROWS' else 'FORM_IMPLAUSIBLE_ROW_COUNT' end as code from runners where jockey_id is not null group by jockey_id having jockey_id % 3 = 0 or max(finish_position) <= 0 or count(*) > 500"),
        "stage_log": ("", f"select user_id % 10 as scope, event_type as stage, count(*) as runs, count(*) filter (not value < 80) as failures, bool_or(value < 2) as fallback_used, {r('avg(floor(value))', 2)} as mean_ms from events group by all"),
        "candidate_counts": ("c as (select race_id, starts_at, case when race_id % 8 = 0 then starts_at else starts_at - interval 5 minute end as captured_at from races)",
            "select count(*) as candidates, count(*) filter (captured_at < starts_at and starts_at <= timestamp '1995-06-15 12:00:00') as eligible, count(*) filter (captured_at >= starts_at) as invalid_timing, min(captured_at) as earliest, max(captured_at) as latest, count(*) filter (starts_at < timestamp '1995-06-15 12:00:00' and race_id % 3 <> 0) as unlabelled from c"),
        "selection_arrays": ("", "select race_id, race_number + 2 as total from races where race_id % 10 <> 0"),
        "card_rows": ("s as (select *, case when distance_meters is not null then {'d': distance_meters, 't': track} end as own from races), "
            "c as (select *, first_value(own ignore nulls) over (partition by race_date, city order by race_number rows between current row and unbounded following) as surface from s)",
            "select race_date::varchar || '|' || city as page_id, race_number as race_no, strftime(starts_at, '%H:%M') as time, surface.d as distance_meters, case surface.t when 'Cim' then 'Çim' else surface.t end as track, horse_number, 'HORSE ' || horse_id as name, weight, "
            "'J ' || coalesce(jockey_id, 0) as jockey, hp, agf_bp / 100.0::double as agf_percent from c join runners using (race_id)"),
        "sixfold_starts": ("", "select race_date::varchar || '|' || city as page_id, race_number as race_no, case race_number when 1 then '1' else '2' end as sixfold_numbers from races where race_number in (1, 3)"),
        "meeting_links": ("", "select distinct race_date::varchar as page_id, city, 'https://a.b/Info/GunlukYarisProgrami?SehirAdi=' || case when city like '%4' then '&k=' else '' end || city as url from races where city not like '%3'"),
        "training_rows": (f"k as (select distinct race_date, city, race_number, max(captured_at) over (partition by race_date, city, race_number) as cut from points where race_number % 5 <> 0 and race_number % 3 <> 0), "
            f"m as (select distinct race_date, city, race_number, horse_number, cut from points join k using (race_date, city, race_number) where date_trunc('hour', captured_at) = date_trunc('hour', cut)), "
            f"l as (select race_date, city, race_number, horse_number, agf_percent, count(*) over (partition by {HK}) as n from points qualify row_number() over (partition by {HK} order by captured_at desc, agf_percent desc) = 1)",
            f"select {HK}, cut as captured_at, case when horse_number % 2 = 0 then 'src' || horse_number end as source_key, agf_percent, n as points from m join l using (race_date, city, race_number, horse_number)"),
        "pipeline_counters": (f"{LATEST}, u as (select race_date, city, k, max(starts_at) as t from races join latest using (race_date, city) group by all), "
            "a as (select count(*) as candidates, count(*) filter (race_id % 8 = 0) as invalid_timing, max(case when race_id % 8 = 0 then starts_at else starts_at - interval 5 minute end) as latest_capture from races), "
            "b as (select count(*) as tickets, count(*) filter (race_id % 3 = 0) as pending, max(starts_at) as latest_generation from races where race_number = 1), "
            "c as (select count(*) as runs, count(*) filter (k % 4 > 1) as ok, count(*) filter (k % 4 = 1) as warnings, count(*) filter (k % 4 = 0) as errors, max(t) as latest_attempt, max(t) filter (k % 4 <> 0) as latest_success from u)",
            "select * from a, b, c"),
        "stage_errors": (f"{LATEST}, u as (select race_date, city, k, max(starts_at) as t from races join latest using (race_date, city) group by all order by t desc, race_date, city limit 20)",
            "select race_date, city, stage, 'timeout' as error from u, (values ('labels', 4), ('priors', 8)) s(stage, n) where k % n = 0 and k % 12 <> 0"),
        "page_fingerprints": ("", "select page_id, sha256(coalesce(url, '') || '|' || coalesce(html, '')) as fingerprint from pages"),
    }
    from . import archive, more, reporting

    bodies |= more.bodies() | archive.bodies() | reporting.bodies()
    out = {name: f"with {TABLES.strip()}{', ' + extra.strip() if extra.strip() else ''}\n{body}" for name, (extra, body) in bodies.items()}
    gains = ", ".join(f"{r(f'{sign} * (shadow_score_{m} - base_score_{m})', 5)} as gain_{m}" for m, sign in (("top1", 1), ("top3", 1), ("mean_rank", -1)))
    labelled = f"(select count(distinct race_id) from ({out['strict_labels']}))"
    stages = ("strict_labels", "context_priors", "ranking_evaluation", "category_priors", "selection_metrics")
    out["rebuild"] = " union all ".join(f"select {i}::bigint as place, '{n}' as stage, 'ok' as status, count(*) as rows from ({out[n]})" for i, n in enumerate(stages))
    ahead = f"(with {TABLES.strip()}, {WINDOWS.strip()} select w.race_date::varchar || '|' || w.city || '|' || sixfold_number as card, sixfold_number, min(starts_at) as first_start from windows w join races using (race_id) group by all having min(starts_at) > timestamp '1995-06-15 12:00:00')"
    out["ticket_snapshots"] = f"select sha256(card || '|' || sixfold_number || '|' || budget || '|' || profile) as snapshot_key, card, budget, profile, first_start, combinations, cost from ({out['ticket_backtest']}) join {ahead} using (card) where profile <> 'economic'"
    allowed = f"(select scale from ({out['ranking_evaluation']}))"
    out["production_scores"] = f"with {TABLES.strip()}, {ADJUSTED.strip()} select race_id, horse_number, base_score, shadow_score, {r('base_score + coalesce(' + r(clamp(f'signal * {allowed}', -5, 5), 2) + ', 0.0)', 2)} as production_score from adjusted"
    out["applied_repair"] = (f"with {TABLES.strip()} select race_id as mapping, case classification when 'MOVE_SOURCE_TO_TARGET' then race_date + 1 else race_date end as race_date, city "
        f"from races left join ({out['date_repair']}) c on race_id = mapping where coalesce(classification, '') <> 'DELETE_DUPLICATE_SOURCE'")
    out |= reporting.after(out, TABLES.strip())
    return out | {"model_report": f"select races, status, scale, {gains}, {labelled} as labelled_races from ({out['ranking_evaluation']})"}
