"""Registered queries over pages, documents, snapshots and stored tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, snapshots
from ..sources import documents, pages, racing
from ..sources.stored import on, once, shared_folder
from ..sources.versioned import Versions, rewrite
from .oracles import FIELD, FORM, r

KEY = ["race_id", "horse_number"]


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def nested_pages(s: SparkSession, d: str) -> DataFrame:
    """The given pages, each with a table in a table and cells that span others put before it."""
    k = F.col("page_id")
    table = text(
        "<table class='a>b'><tr><th colspan=2>", k, "</th><th>u</th></tr><!-- <table><tr><td>no --><tr><td rowspan=\"2\">k</td><td>a<table><tr><td>in ", k % 7, "</td></tr></table>b</td><td>", k * 2,
        "<tr><td colspan='2'>d &amp; e<script>'<td>'</script></table>",
    )
    return racing.read(s, d, "pages").select("page_id", F.concat(table, F.coalesce("html", F.lit(""))).alias("html"))


def nested_cells(s: SparkSession, d: str) -> DataFrame:
    return pages.cells(nested_pages(s, d)).withColumns({c: F.col(c).cast("long") for c in ("table_no", "depth", "row_no", "col_no")})


def dated(s: SparkSession, d: str) -> DataFrame:
    """The given pages with a day each, and two links more: one that spells the day in one of six ways, one that spells another day."""
    k, day = F.col("page_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "ddMMyyyy", "yyyyMMdd", "d-M-yyyy", "d/M/yyyy"]
    spelled = F.element_at(F.array(*[F.date_format(day, f) for f in forms]), (k % 6 + 1).cast("int"))
    other = F.date_format(F.date_add(day, 40), "yyyy-MM-dd")
    more = text('<a href="/haber/ankara-yaris-', k, '">Ankara ', spelled, ' the card</a><a href="/haber/istanbul-', k, "-", other, '">Istanbul of old</a>')
    return racing.read(s, d, "pages").select("page_id", "url", F.concat(more, F.coalesce("html", F.lit(""))).alias("html"), day.alias("day"))


def page_candidates(s: SparkSession, d: str) -> DataFrame:
    rows = dated(s, d)
    found = pages.ranked_candidates(pages.links(rows), ["istanbul", "ankara"], ["the", "of", "and"], rows.select("page_id", "day"), least=1)
    return found.select("page_id", "url", "score", "place")


def purged(s: SparkSession, d: str) -> DataFrame:
    """Meetings of the composite programme (every eleventh meeting's first race is written so) go from five tables, children first, in one commit."""
    races = racing.races(s, d)
    composite = F.max(F.col("race_id") % 11 == 0).over(scoring.Window.partitionBy("race_date", "city"))
    races = races.withColumn("programme", F.when(composite, F.lit(" KARMA ")).otherwise(F.col("city")))
    meeting = races.select("race_id", "race_date", "city", "programme")
    tables = {
        "share_points": racing.share_points(s, d).select(*KEY, "captured_at", "agf_percent").join(meeting.select("race_id"), "race_id"),
        "picks": racing.picks(s, d).select(*KEY, "source_key", "source_rank"), "runners": racing.runners(s, d).select(*KEY, "horse_id"), "races": races,
        "meetings": meeting.select("race_date", "city", "programme").distinct(),
    }
    stored = Versions(s, f"{shared_folder(s)}/cards-{uuid.uuid4().hex}")
    stored.commit(0, tables)
    gone = stored.read("meetings").where(F.lower(F.trim("programme")) == "karma").select("race_date", "city")
    lost = stored.read("races").join(gone, ["race_date", "city"], "left_semi").select("race_id")
    by_race = lambda rows: rows.join(lost, "race_id", "left_anti")
    by_meeting = lambda rows: rows.join(gone, ["race_date", "city"], "left_anti")
    rewrite(stored, 1, {n: by_meeting if n == "meetings" else by_race for n in tables})
    counts = [stored.read(n, version=v).agg(F.lit(n).alias("table_name"), F.lit(v).cast("long").alias("version"), F.count("*").alias("rows")) for n in tables for v in (0, 1)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("table_name").agg(F.max(F.when(F.col("version") == 0, F.col("rows"))).alias("before"), F.max(F.when(F.col("version") == 1, F.col("rows"))).alias("after"))


def extracted(s: SparkSession, d: str) -> DataFrame:
    """Documents of three kinds written from the tables, with both date forms, decimal commas, numbers in texts, wrong identities and unreadable ones."""
    rows = racing.runners(s, d).join(racing.races(s, d), "race_id")
    day = F.when(F.col("race_id") % 2 == 0, F.date_format("race_date", "dd.MM.yyyy")).otherwise(F.col("race_date").cast("string"))
    order = lambda c: F.array_sort(F.collect_list(F.struct("race_id", "horse_number", c.alias("r"))))["r"]
    form = F.struct(
        F.when(F.col("race_id") % 7 == 0, "soon").otherwise(day).alias("raceDate"), "city", F.col("distance_meters").alias("distanceMeters"), F.lit("  ").alias("track"), F.concat(F.col("finish_position").cast("string"), F.lit(",9")).alias("finishPosition"),
        F.replace(F.col("weight").cast("string"), F.lit("."), F.lit(",")).alias("weight"), F.lit(" J ").alias("jockey"), F.when(F.col("race_id") % 3 == 0, "1e999").otherwise("2.05").alias("odds"), F.coalesce(F.col("hp").cast("string"), F.lit("-")).alias("hp"),
    )
    forms = rows.groupBy(F.col("horse_id").alias("doc_key")).agg(order(form).alias("rows"))
    field = F.struct(F.concat(F.lit(" HORSE "), F.col("horse_id").cast("string")).alias("horseName"), "horse_number", day.alias("raceDate"), "city", F.col("finish_position").alias("finishPosition")).withField("horseNumber", F.col("horse_number")).dropFields("horse_number")
    fields = rows.groupBy(F.col("race_id").alias("doc_key")).agg(order(field).alias("rows"))
    h = F.struct(F.col("horse_number").alias("horseNumber"), F.when(F.col("horse_id") % 17 == 0, " ").otherwise(F.concat(F.lit("HORSE "), F.col("horse_id").cast("string"))).alias("horseName"), F.col("finish_position").alias("finishPosition"))
    by_race = rows.groupBy("race_date", "city", "race_number", "race_id").agg(F.collect_list(h).alias("runners"))
    own = F.when(F.max("race_id") % 5 == 0, "Elsewhere").otherwise(F.col("city"))
    results = by_race.groupBy("race_date", "city").agg(F.max("race_id").alias("doc_key"), own.alias("own"), F.collect_list(F.struct(F.col("race_number").alias("raceNumber"), "runners")).alias("races"))
    broken = lambda document: F.when(F.col("doc_key") % 13 == 0, F.concat(F.lit("{"), document)).otherwise(document)
    none = F.lit(None).cast("string")
    listed = lambda df, kind: df.select("doc_key", F.lit(kind).alias("kind"), F.lit(None).cast("date").alias("race_date"), none.alias("city"), broken(F.to_json(F.struct("rows"))).alias("document"))
    met = results.select("doc_key", F.when(F.col("doc_key") % 101 == 0, "odd").otherwise("result").alias("kind"), "race_date", "city", broken(F.to_json(F.struct(F.col("own").alias("city"), F.date_format("race_date", "dd.MM.yyyy").alias("raceDate"), "races"))).alias("document"))
    return listed(forms, "form").unionByName(listed(fields, "field")).unionByName(met)


def result_documents(s: SparkSession, d: str) -> DataFrame:
    return documents.result_document_rows(extracted(s, d))


MINUTES = (50, 20, 3, -2)  # before the start, of the candidates of a race


def vectors(s: SparkSession, d: str) -> DataFrame:
    """Candidates at up to four moments a race, the last of them after the start; every sixth race is frozen already."""
    races = racing.races(s, d)
    every = races.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i")).where("i <= race_id % 4")
    minutes = F.element_at(F.array(*[F.lit(m) for m in MINUTES]), F.col("i") + 1)
    taken = every.withColumn("captured_at", F.timestamp_seconds(F.unix_seconds("starts_at") - 60 * minutes)).drop("i")
    chosen = snapshots.promoted(taken, races.where("race_id % 6 = 0"), F.lit("2100-01-01").cast("timestamp"))
    runners = scoring.with_recent_form(racing.runners(s, d)).join(racing.past_places(s, d), KEY).withColumn("field_score", scoring.field_score(F.col("places")))
    starts = races.select("race_id", "starts_at")
    picks = racing.picks(s, d).join(starts, "race_id").withColumn("captured_at", F.timestamp_seconds(F.unix_seconds("starts_at") - 60 * (10 + 15 * F.col("k"))))
    return snapshots.training_set(chosen, runners, racing.share_points(s, d), picks)


def dated_cards(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Races and runners stored by date and in buckets by race."""
    races, day = racing.races(s, d), racing.races(s, d).select("race_id", "race_date")
    known = once(s, d, "dated_races", ["nation", "customer", "orders"], lambda: races)
    return known, once(s, d, "dated_runners", ["nation", "customer", "orders", "lineitem"], lambda: racing.runners(s, d).join(day, "race_id"))


def stored_cards(s: SparkSession, d: str) -> DataFrame:
    """Cards of some days from the stored tables: a count and the shares of each race."""
    races, runners = (on(t, "1995-01-01", "1996-06-30") for t in dated_cards(s, d))
    both = races.select("race_id", "city", "race_number").join(runners.select("race_id", "horse_number", "agf_bp"), "race_id")
    return both.groupBy("race_id").agg(F.max("city").alias("city"), F.max("race_number").alias("race_number"), F.count("*").alias("runners"), F.sum("agf_bp").alias("share_bp"))


def queries() -> dict:
    return {
        "nested_cells": nested_cells,
        "page_links": lambda s, d: pages.links(racing.read(s, d, "pages")).select("page_id", "base", "url", "text", "position"),
        "page_candidates": page_candidates,
        "composite_purge": purged,
        "form_documents": lambda s, d: documents.form_rows(extracted(s, d)),
        "field_documents": lambda s, d: documents.field_rows(extracted(s, d)),
        "result_documents": result_documents,
        "corrupt_documents": lambda s, d: documents.corrupt(extracted(s, d)).select("doc_key", "kind", "reason"),
        "typed_violations": lambda s, d: documents.typed_violations(result_documents(s, d), ["race_date", "city", "race_number", "horse_number"]),
        "training_set": vectors,
        "stored_cards": stored_cards,
    }


def links_sql(rows: str) -> str:
    """Common table expressions up to `links(page_id, base, url, text, position)`; rows: a relation (page_id, url, html)."""
    anchor = r"""'(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
    host = lambda c: f"regexp_replace(lower(regexp_extract({c}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
    plain = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(label, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
    return f"""
a as (select page_id, url as base, unnest(regexp_extract_all(html, {anchor}, 1)) as h, unnest(regexp_extract_all(html, {anchor}, 2)) as label, unnest(generate_series(0, len(regexp_extract_all(html, {anchor}, 1)) - 1)) as position from {rows}),
b as (select *, trim(regexp_replace(h, '#.*$', '')) as href, regexp_extract(base, '^([a-zA-Z]+://[^/?#]+)', 1) as root, regexp_extract(base, '^([a-zA-Z]+://[^?#]*/)', 1) as folder from a),
c as (select page_id, base, case when regexp_matches(href, '^[a-zA-Z]+://') then href when starts_with(href, '//') then regexp_extract(base, '^([a-zA-Z]+:)', 1) || href when starts_with(href, '/') then root || href
        when href = '' then base else case when folder = '' then root || '/' else folder end || href end as url, {plain} as text, position::bigint as position from b),
links as (select * from c where {host('url')} = {host('base')} qualify row_number() over (partition by page_id, url order by position) = 1)"""


def bodies() -> dict[str, tuple[str, str]]:
    """name -> (common table expressions after those of the tables, query)."""
    fold = lambda x: f"trim(regexp_replace(translate(lower(translate({x}, 'Iİ', 'ıi')), 'ığüşöç', 'igusoc'), '[^a-z0-9]+', ' ', 'g'))"
    forms = ["%Y-%m-%d", "%d.%m.%Y", "%d%m%Y", "%Y%m%d", "%-d-%-m-%Y", "%-d/%-m/%Y"]
    has = lambda words: " + ".join(f"contains(words, '{w}')::int" for w in words)
    some = lambda words, first: f"case when {has(words)} > 0 then {first} + least({has(words)} - 1, 2) else 0 end"
    asof = lambda bound: f"max_by(agf_percent, captured_at) filter (captured_at <= {bound})"
    inside = "filter (captured_at >= s.starts_at - interval 90 minute and captured_at <= cut)"
    docs = "u as (select u.*, race_date, city, race_number, distance_meters from runners u join races using (race_id)), meet as (select race_date, city, max(race_id) as k from u group by all)"
    lost = "lost as (select race_date, city from races group by all having count(*) filter (race_id % 11 = 0) > 0), kept as (select * from races where (race_date, city) not in (select (race_date, city) from lost))"
    counted = " union all ".join(
        f"select '{n}' as table_name, (select count(*) from {t}) as before, (select count(*) from {t} where race_id in (select race_id from kept)) as after" for n, t in (("share_points", "share_points"), ("picks", "picks"), ("runners", "runners"), ("races", "races"))
    )
    relabelled = "k % 5 = 0"
    result = f"select race_date, city, {relabelled} as relabelled, race_number, horse_number, case when horse_id % 17 <> 0 then 'HORSE ' || horse_id end as name, finish_position from u join meet using (race_date, city) where k % 13 <> 0 and k % 101 <> 0"
    return {
        "nested_cells": ("", "select page_id, t as table_no, t as depth, r as row_no, c as col_no, case when v = 'id' then page_id::varchar when v = 'in' then 'in ' || page_id % 7 when v = 'twice' then (page_id * 2)::varchar else v end as cell, h as head, o as origin from pages, "
            "(values (0, 0, 0, 'id', true, true), (0, 0, 1, 'id', true, false), (0, 0, 2, 'u', true, true), (0, 1, 0, 'k', false, true), (0, 1, 1, 'a b', false, true), (0, 1, 2, 'twice', false, true), (0, 2, 0, 'k', false, false), "
            "(0, 2, 1, 'd & e', false, true), (0, 2, 2, 'd & e', false, false), (1, 0, 0, 'in', false, true)) g(t, r, c, v, h, o)"),
        "page_links": (links_sql("pages"), "select page_id, base, url, text, position from links"),
        "page_candidates": (
            "dated as (select page_id, url, date '2024-01-01' + (page_id % 400)::int as day, html from pages), "
            f"spelled as (select page_id, url, day, '<a href=\"/haber/ankara-yaris-' || page_id || '\">Ankara ' || case page_id % 6 {' '.join(f'when {i} then strftime(day, {chr(39)}{f}{chr(39)})' for i, f in enumerate(forms))} end || ' the card</a><a href=\"/haber/istanbul-' || page_id || '-' "
            "|| strftime(day + 40, '%Y-%m-%d') || '\">Istanbul of old</a>' || coalesce(html, '') as html from dated), " + links_sql("spelled") + ", "
            f"e as (select l.page_id, l.url, l.base, position, day, {fold('text')} || ' ' || {fold('l.url')} as words, regexp_extract(l.url, '^[a-zA-Z]+://[^/]+([^?#]*)', 1) as path from links l join spelled using (page_id)), "
            f"scored as (select page_id, url, position, ({some(('istanbul', 'ankara'), 4)} + {some(('the', 'of', 'and'), 3)} + case when {' or '.join(f'contains(words, {fold(f"strftime(day, {chr(39)}{f}{chr(39)})")})' for f in (*forms, '%d-%m-%Y'))} then 4 else 0 end "
            r"+ case when regexp_matches(path, '(?i)/(haber|yazi|article|news|post)') then 2 else 0 end + case when regexp_matches(path, '[a-z0-9]+-[a-z0-9]+-[a-z0-9]+') then 1 else 0 end - case when regexp_matches(path, '(?i)/(login|about|contact|privacy|tag)') then 4 else 0 end "
            r"- case when regexp_matches(path, '(?i)\.(jpg|png|gif|css|js|pdf)$') or url = base then 100 else 0 end)::bigint as score from e)",
            "select page_id, url, score, row_number() over (partition by page_id order by score desc, position) as place from scored where score >= 1 qualify place <= 12"),
        "composite_purge": (lost, f"{counted} union all select 'meetings', (select count(*) from (select distinct race_date, city from races)), (select count(*) from (select distinct race_date, city from kept))"),
        "form_documents": (docs, "select horse_id as doc_key, row_number() over (partition by horse_id order by race_id, horse_number) - 1 as place, case when race_id % 7 <> 0 then race_date end as race_date, city, distance_meters, null::varchar as track, finish_position, weight, 'J' as jockey, "
            "case when race_id % 3 <> 0 then 2.05::double end as odds, hp from u where horse_id % 13 <> 0"),
        "field_documents": (docs, "select race_id as doc_key, row_number() over (partition by race_id order by horse_number) - 1 as place, 'HORSE ' || horse_id as horse_name, horse_number, race_date, city, null::bigint as distance_meters, null::varchar as track, finish_position from u where race_id % 13 <> 0"),
        "result_documents": (docs, result),
        "corrupt_documents": (docs, "select distinct horse_id as doc_key, 'form' as kind, 'UNREADABLE' as reason from u where horse_id % 13 = 0 union all select distinct race_id, 'field', 'UNREADABLE' from u where race_id % 13 = 0 "
            "union all select k, case when k % 101 = 0 then 'odd' else 'result' end, case when k % 101 = 0 then 'UNKNOWN_KIND' else 'UNREADABLE' end from meet where k % 13 = 0 or k % 101 = 0"),
        "typed_violations": (docs, f"select race_date, city, race_number, horse_number, unnest(list_filter([case when name is null then 'EMPTY_RUNNER_NAME' end, case when relabelled then 'MEETING_RELABELLED' end], lambda x: x is not null)) as code from ({result})"),
        "stored_cards": ("", "select race_id, city, race_number, count(*) as runners, sum(agf_bp)::bigint as share_bp from races join runners using (race_id) where race_date between date '1995-01-01' and date '1996-06-30' group by all"),
        "training_set": (
            f"{FORM.strip()}, {FIELD.strip()}, cuts as (select race_id, starts_at, starts_at - to_minutes(case race_id % 4 when 0 then 50 when 1 then 20 else 3 end) as cut from races where race_id % 6 <> 0), "
            f"shares as (select race_id, horse_number, {asof('least(cut, s.starts_at - interval 90 minute)')} as t90, case when max(cut) >= max(s.starts_at) - interval 30 minute then {asof('s.starts_at - interval 30 minute')} end as t30, "
            f"case when max(cut) >= max(s.starts_at) - interval 5 minute then {asof('s.starts_at - interval 5 minute')} end as t5, {asof('cut')} as final, max(agf_percent) {inside} - min_by(agf_percent, captured_at) {inside} as max_rise, "
            f"min(agf_percent) {inside} - min_by(agf_percent, captured_at) {inside} as max_fall, count(*) filter (captured_at <= cut) as points from share_points s join cuts using (race_id) group by all), "
            f"said as (select race_id, horse_number, count(*) as picks, count(distinct source_key) as sources, count(*) filter (is_banko) as bankos, {r('avg(source_rank)', 4)} as mean_rank from picks join cuts using (race_id) where starts_at - to_minutes((10 + 15 * k)::int) <= cut group by all)",
            "select u.race_id, u.horse_number, cut, t90, t30, t5, final, max_rise, max_fall, coalesce(points, 0) as points, coalesce(picks, 0) as picks, coalesce(sources, 0) as sources, coalesce(bankos, 0) as bankos, mean_rank, form_score, field_score "
            "from formed u join cuts using (race_id) left join fields using (race_id, horse_number) left join shares using (race_id, horse_number) left join said using (race_id, horse_number)"),
    }
