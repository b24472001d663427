"""Nested tables, typed documents, dated links, the as-of training set and the stored layout on small hand-written input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.operators import snapshots
from paddock.plans import archive
from paddock.sources import cards, documents, pages, stored, tables

SF = "/root/testdata/sf0.001"


def grid(html):
    out = {}
    for number, _, row, column, body, head, origin in tables.table_cells(html):
        out[number, row, column] = (" ".join(body.split()), head, origin)
    return out


def text(html):
    return {k: v[0] for k, v in grid(html).items()}


def test_spans_push_cells_to_the_next_free_place():
    html = "<table><tr><td rowspan=3>a<td colspan=2>b<td>c<tr><td>d<td rowspan=2>e<td>f<tr><td>g<td>h</table>"
    assert text(html) == {
        (0, 0, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b", (0, 0, 3): "c", (0, 1, 0): "a", (0, 1, 1): "d", (0, 1, 2): "e", (0, 1, 3): "f", (0, 2, 0): "a", (0, 2, 1): "g", (0, 2, 2): "e", (0, 2, 3): "h",
    }
    assert [k for k, v in grid(html).items() if not v[2]] == [(0, 0, 2), (0, 1, 0), (0, 2, 0), (0, 2, 2)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>1<table><tr><td>2<table><tr><td>3</table>4</table>5</table>", {(0, 0, 0): "1 5", (1, 0, 0): "2 4", (2, 0, 0): "3"}),
        ("<table><tr><td>a</td>lost<td>b</tr>lost</table>lost<table><td>no row</table>", {(0, 0, 0): "a", (0, 0, 1): "b", (1, 0, 0): "no row"}),
        ("</table></td><table><tr><th>never closed", {(0, 0, 0): "never closed"}),
        ("<table><tr><!-- <td>no --><td title='x>y'>yes<script>'</table>'</script></table>", {(0, 0, 0): "yes"}),
        ("<table><tr><td colspan=0 rowspan='x'>a<td COLSPAN = \"2\">b</table>", {(0, 0, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b"}),
        ("<td>outside</td>", {}), ("", {}),
    ],
)
def test_broken_and_nested_tables(html, want):
    assert text(html) == want


def test_wide_spans_are_bounded():
    assert max(c for _, _, c in text("<table><tr><td colspan=99999999>x</table>")) == 999
    assert len(text("<table><tr><td rowspan=70000>x</table>")) == 1


def test_cells_of_repeated_and_missing_pages(spark):
    rows = spark.createDataFrame([("p", "<table><tr><td>&amp; x</table>"), ("p", "<table><tr><td>&amp; x</table>"), ("n", None), ("e", "")], "page_id string, html string")
    assert [(r.page_id, r.cell) for r in pages.cells(rows).collect()] == [("p", "& x")] * 2


def test_start_markers_in_tables_and_headings(spark):
    html = "<h3>1. Koşu 14.30</h3><table><tr><td>x<td>1. 6'LI GANYAN Bu koşudan başlar</td></tr></table><h3>2. Koşu 15.00</h3><p>none</p><h3>3. Koşu 15.30 <b>2. 6'LI GANYAN Bu koşudan başlar</b></h3>"
    got = {r.race_no: r.sixfold_numbers for r in cards.sixfold_starts(spark.createDataFrame([("p", html)], "page_id string, html string")).collect()}
    assert got == {1: [1], 3: [2]}


def test_nine_spellings_and_no_others(spark):
    day = dt.date(2024, 8, 2)
    spelled = ["2024-08-02", "02-08-2024", "02.08.2024", "02/08/2024", "02082024", "20240802", "2-8-2024", "2.8.2024", "2/8/2024", "x12.8.2024y", "on 02 08 2024."]
    other = ["2024-08-03", "8-2-2024", "2-8-24", "0208202", "3.8.2024", "", "2 August 2024"]
    rows = spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in enumerate(spelled + other)], "page_id long, url string, text string")
    days = rows.select("page_id", F.lit(day).alias("day"))
    assert pages.date_spellings(days).count() == 5
    got = {r.page_id for r in pages.dated_links(rows, days).where("dated").collect()}
    assert got == set(range(len(spelled)))
    slug = spark.createDataFrame([(1, "http://h/yaris-2-8-2024-ankara", "Card")], "page_id long, url string, text string")
    assert pages.dated_links(slug, slug.select("page_id", F.lit(day).alias("day"))).first().dated


@pytest.mark.parametrize(("raw", "want"), [("12,5", 12.5), (" 12.5 ", 12.5), ("-3", -3.0), ("", None), ("abc", None), ("1,2,3", None), ("1e3", 1000.0), ("1e999", None), ("NaN", None), (None, None), ("12d", None)])
def test_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(documents.number(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("2026-07-04", dt.date(2026, 7, 4)), ("04.07.2026", dt.date(2026, 7, 4)), ("31.02.2026", None), ("4.7.2026", None), ("2026-7-4", None), ("", None), (None, None)])
def test_days(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(documents.day(F.col("x"))).first()[0] == want


def test_corrupt_documents_are_routed(spark):
    rows = [(1, "form", '{"rows": [{"raceDate": "04.07.2026", "finishPosition": "2,7", "hp": 90}]}'), (2, "form", "{"), (3, "form", None), (4, "other", "{}"), (5, None, "{}"), (6, "form", '{"rows": 7}'), (7, "form", "{}"), (8, "form", '{"rows": []}')]
    docs = spark.createDataFrame(rows, "doc_key long, kind string, document string").withColumn("race_date", F.lit(None).cast("date")).withColumn("city", F.lit(None).cast("string"))
    (r,) = documents.form_rows(docs).collect()
    assert (r.doc_key, r.race_date, r.finish_position, r.hp, r.weight) == (1, dt.date(2026, 7, 4), 2, 90, None)
    assert {(r.doc_key, r.reason) for r in documents.corrupt(docs).collect()} == {(2, "UNREADABLE"), (3, "UNREADABLE"), (4, "UNKNOWN_KIND"), (5, "UNKNOWN_KIND"), (6, "UNREADABLE")}


def test_later_observations_change_nothing(spark):
    start, at = dt.datetime(2024, 5, 1, 12), lambda m: dt.datetime(2024, 5, 1, 12) - dt.timedelta(minutes=m)
    chosen = spark.createDataFrame([(1, start, at(20)), (2, start, at(3))], "race_id long, starts_at timestamp, captured_at timestamp")
    runners = spark.createDataFrame([(1, 1, 60.0, 50.0), (1, 2, None, None), (2, 1, 70.0, None), (3, 1, 1.0, 1.0)], "race_id long, horse_number long, form_score double, field_score double")
    shares = [(1, 1, at(80), 10.0), (1, 1, at(40), 14.0), (1, 1, at(20), 12.0), (2, 1, at(100), 5.0), (2, 1, at(4), 9.0)]
    said = [(1, 1, at(30), "a", 1, True), (1, 1, at(20), "b", 2, False), (2, 1, at(2), "a", 1, True)]
    points = lambda rows: spark.createDataFrame(rows, "race_id long, horse_number long, captured_at timestamp, agf_percent double")
    picks = lambda rows: spark.createDataFrame(rows, "race_id long, horse_number long, captured_at timestamp, source_key string, source_rank long, is_banko boolean")
    made = lambda p, q: {(r.race_id, r.horse_number): r.asDict() for r in snapshots.training_set(chosen, runners, points(p), picks(q)).collect()}
    got = made(shares, said)
    a, b, c = got[1, 1], got[1, 2], got[2, 1]
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and all(r["cut"] < start for r in got.values())
    assert (a["t90"], a["t30"], a["t5"], a["final"], a["max_rise"], a["max_fall"], a["points"]) == (None, 14.0, None, 12.0, 4.0, 0.0, 3)
    assert (a["picks"], a["sources"], a["bankos"], a["mean_rank"], a["form_score"], a["field_score"]) == (2, 2, 1, 1.5, 60.0, 50.0)
    assert (b["final"], b["points"], b["picks"], b["mean_rank"], b["form_score"]) == (None, 0, 0, None, None)
    assert (c["t90"], c["t30"], c["t5"], c["final"], c["picks"]) == (5.0, 5.0, 5.0, 9.0, 0)
    later = [(1, 1, at(19), 99.0), (1, 2, at(1), 99.0), (1, 9, at(50), 3.0), (2, 1, at(-5), 99.0)]
    assert made(shares + later, [*said, (1, 1, at(0), "z", 9, True), (1, 2, at(19), "z", 9, True)]) == got


def test_stored_layout_prunes_dates_and_joins_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        races, runners = (stored.on(t, "1995-01-01", "1995-03-31") for t in archive.dated_cards(spark, SF))
        joined = races.join(runners, "race_id").groupBy("race_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(race_date") == 2 and "SortMergeJoin" in plan
        assert "Exchange" not in plan, plan
        assert joined.agg(F.sum("count")).first()[0] == runners.count() > 0
        assert archive.dated_cards(spark, SF)[0].inputFiles() == archive.dated_cards(spark, SF)[0].inputFiles()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
