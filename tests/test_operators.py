"""Literal values for the scoring, market, ticket, page and write operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paddock.functions import names
from paddock.functions.numeric import rounded
from paddock.operators import expert, gaps, market, scoring, sinks, snapshots, tickets
from paddock.sources import cards, pages

NOON = datetime(2026, 1, 1, 12)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("x", "digits", "want"), [(1.005, 2, 1.0), (-2.5, 0, -2.0), (2.5, 0, 3.0)])
def test_rounding(spark, x, digits, want):
    assert one(spark, rounded(F.lit(x), digits))[0] == want


@pytest.mark.parametrize(
    ("raw", "score", "trend"), [("4519-71", 63.0, "stable"), ("001311", 84.7, "improving"), ("3223-66", 56.9, "declining"), ("558635", 56.8, "improving"), ("", None, "unknown")]
)
def test_recent_form(spark, raw, score, trend):
    assert tuple(one(spark, *scoring.recent_form(F.lit(raw)))) == (score, trend)


def test_recent_positions(spark):
    assert one(spark, scoring.recent_positions(F.lit("4519-71")))[0] == [1, 7, 9, 1, 5, 4]


@pytest.mark.parametrize(("places", "want"), [([1, 2, 6, 8], (76.1, "improving")), ([8, 6, 2, 1], (51.4, "declining"))])
def test_history_form(spark, places, want):
    assert tuple(one(spark, *scoring.history_form(F.array(*map(F.lit, places))))) == want


def points(spark, shares, step=60):
    rows = [("d", "c", 1, 1, NOON + timedelta(minutes=step * k), float(x), NOON + timedelta(minutes=200)) for k, x in enumerate(shares)]
    return spark.createDataFrame(rows, "race_date string, city string, race_number long, horse_number long, captured_at timestamp, agf_percent double, starts_at timestamp")


@pytest.mark.parametrize(
    ("shares", "step", "want"),
    [([8, 11, 17], 60, (97.0, "strong-up")), ([24, 18, 12], 60, (0.0, "strong-down")), ([12, 12], 60, (50.0, "flat")), ([12], 60, (None, "unknown")), ([10, 20], 1, (None, "unknown")), ([4, 8], 60, (82.0, "up"))],
)
def test_movement(spark, shares, step, want):
    r = market.movement(points(spark, shares, step), 300).first()
    assert (r.market_score, r.direction) == want


def test_late_bounds_are_null_before_them(spark):
    r = market.features(points(spark, [5, 6, 9]), F.lit(NOON + timedelta(minutes=100))).first()
    assert (r.t90, r.t30, r.t5, r.final) == (6.0, None, None, 6.0)


def pick(source, **flags):
    return (1, 1, source, 1, 0.5, 0, *[bool(flags.get(c)) for c in ("banko", "favorite", "strong", "star", "rival", "surprise", "avoid")])


PICK = "race_id long, horse_number long, source_key string, source_rank long, confidence double, k long, " + ", ".join(f"is_{c} boolean" for c in ("banko", "favorite", "strong", "star", "rival", "surprise", "avoid"))


@pytest.mark.parametrize(
    ("rows", "score"),
    [([pick("a", banko=1, favorite=1, strong=1, star=1)], 100.0), ([pick("a", favorite=1)], 93.0), ([pick("a", favorite=1), pick("b", avoid=1)], 49.0), ([pick("a", favorite=1), pick("a", avoid=1)], 93.0)],
)
def test_consensus(spark, rows, score):
    sources = spark.createDataFrame([("a", 1.0, True), ("b", 1.0, True)], "source_key string, base_weight double, enabled boolean")
    assert expert.consensus(spark.createDataFrame(rows[:1] if len({r[2] for r in rows}) == 1 else rows, PICK), sources).first().expert_score == score


def test_model_score(spark):
    rows = spark.createDataFrame(
        [(1, 1, 45.0, 95, 56.0, 85.0, 0.7), (1, 2, 15.0, 65, 60.0, 55.0, 0.7)], "race_id long, horse_number long, agf_percent double, hp long, weight double, expert_score double, expert_confidence double"
    ).withColumns({"recent_form_raw": F.lit(None).cast("string"), "market_score": F.lit(None).cast("double"), "field_score": F.lit(None).cast("double")})
    got = {r.horse_number: (r.score, round(r.model_confidence, 2)) for r in scoring.model_score(scoring.components(rows)).collect()}
    assert got == {1: (71.1, 0.67), 2: (23.16, 0.67)}


def legs(spark, sizes):
    rows = [("x", leg + 1, h + 1, 100.0 - 8 * h, 0.8) for leg, n in enumerate(sizes) for h in range(n)]
    return spark.createDataFrame(rows, "card string, leg long, horse_number long, score double, confidence double")


def test_tickets(spark):
    got = {r.profile: (round(r.survival, 6), r.cost) for r in tickets.optimise(legs(spark, [5] * 6), spark.createDataFrame([("x", 1.25)], "card string, unit double"), (3000.0,)).collect()}
    assert got == {"economic": (0.474647, 1215.0), "balanced": (0.569748, 2160.0), "maximum": (0.624221, 2880.0)}


def test_large_leg(spark):
    rows = tickets.optimise(legs(spark, [14, 3, 3, 3, 3, 3]), spark.createDataFrame([("x", 1.0)], "card string, unit double"), (20000.0,)).collect()
    assert max(max(r.sizes) for r in rows if r.profile == "maximum") > 5
    assert all(r.cost <= 20000 for r in rows)


def test_ticket_cost(spark):
    sizes = F.array(*map(F.lit, [1, 2, 3, 2, 4, 2]))
    assert tuple(one(spark, tickets.ticket_cost(sizes, F.lit(1.25)), tickets.ticket_cost(sizes, F.lit(1.25), 2))) == (120.0, 240.0)


@pytest.mark.parametrize(("n", "marks", "want"), [(9, [(1, 2), (2, 4)], {1: [2, 7], 2: [4, 9]}), (8, [], {1: [1, 6], 2: [3, 8]}), (6, [], {1: [1, 6]}), (5, [], {})])
def test_windows(spark, n, marks, want):
    races = spark.createDataFrame([("d", "c", k + 1, k) for k in range(n)], "race_date string, city string, race_number long, race_id long")
    markers = spark.createDataFrame([("d", "c", *m) for m in marks], "race_date string, city string, sixfold_number int, start_race long")
    got = {}
    for r in tickets.windows(races, markers).collect():
        got.setdefault(r.sixfold_number, []).append(r.race_number)
    assert {k: [min(v), max(v)] for k, v in got.items()} == want


def test_names(spark):
    r = one(spark, names.upper_tr(F.lit("istanbul ışık")), names.city_fold(F.lit("İstanbul ")), names.ascii_fold(F.lit("Şanlı-Urfa!")), names.horse_key(F.lit("x?QueryParameter_AtId=99665&y=1"), F.lit("A")), names.horse_key(F.lit(""), F.lit("ada  gül")))
    assert tuple(r) == ("İSTANBUL IŞIK", "ISTANBUL", "sanli urfa", "tjk-horse:99665", "horse-name:ADA GÜL")


def test_normal_form(spark):
    df = names.normalised(spark.createDataFrame([("ﬁ",), ("a",), (None,)], "x string"), "x")
    assert {r.x for r in df.collect()} == {"fi", "a", None}


HTML = """<a href="/Info/YarisIslem?SehirId=3&SehirAdi=x">İstanbul</a><a href="http://other.com/x">no</a><a href='/Info/YarisIslem?SehirId=3&SehirAdi=x#top'>again</a>
<table><tr><th>Tarih</th><th>Şehir</th><th>Msf</th><th>Pist</th><th>S</th><th>Sıklet</th><th>Jokey</th><th>Gny</th><th>HP</th></tr>
<tr><td>04.07.2026</td><td>İzmir</td><td>1400</td><td>Kum</td><td>1</td><td>61,5</td><td>S.KAYA</td><td>2,05</td><td>94</td></tr></table>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://www.site.org/a/", HTML)], "page_id long, url string, html string")
    assert [(r.url, r.text) for r in pages.links(df).collect()] == [("https://www.site.org/Info/YarisIslem?SehirId=3&SehirAdi=x", "İstanbul")]
    r = pages.history_rows(df).first()
    assert (str(r.race_date), r.city, r.distance_meters, r.finish_position, r.weight, r.jockey, r.odds, r.hp) == ("2026-07-04", "İzmir", 1400, 1, 61.5, "S.KAYA", 2.05, 94)


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "k int, v string, version int")
    state = sinks.upsert(old, new, ["k"], "version")
    assert {(r.k, r.v) for r in state.collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert {(r.k, r.v) for r in sinks.upsert(state, new, ["k"], "version").collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert [r.k for r in sinks.insert_only(old, new, ["k"], "version").collect()] == [3]
    with pytest.raises(ValueError, match="empty"):
        sinks.reconcile(old, new.limit(0), ["k"])


def test_comment_sentiment(spark):
    rows = [(1, "Pisti SEVER", "Kum"), (1, "mesafe uzun gelir", "Kum"), (1, "formda", "Kum"), (2, "kumda etkili", "kum"), (3, "kumda etkili", "Çim"), (4, None, None)]
    found = gaps.comment_sentiment(spark.createDataFrame(rows, "k int, comment string, track string"), ["k"])
    assert {r.k: (r.relevant, r.score) for r in found.collect()} == {1: (2, 50.0), 2: (1, 90.0)}


@pytest.mark.parametrize(("text", "want"), [("[1,2]", [1, 2]), ("[1,", None), ("x", None), ("[]", []), (None, None)])
def test_int_array(spark, text, want):
    assert one(spark, gaps.int_array(F.lit(text).cast("string")))[0] == want


def test_date_repair(spark):
    rows = lambda *ms: spark.createDataFrame([(m, 1, 1, name) for m, name in ms], "mapping int, race_number int, horse_number int, name string")
    found = gaps.date_repair(rows((1, "A"), (2, "A"), (3, "B"), (4, "A")), rows((2, "A"), (4, "C")), rows((1, "A"), (2, "A"), (3, "A"), (4, "A")))
    assert dict(found.collect()) == {1: "MOVE_SOURCE_TO_TARGET", 2: "DELETE_DUPLICATE_SOURCE", 3: "MANUAL_REVIEW", 4: "MANUAL_REVIEW"}


def test_programme_documents(spark):
    text = '{"city":"X","races":[{"race_number":"1,0","time":"9:00","runners":[{"number":"2","name":" ","url":"ftp://a"},{"number":"2","name":"A"}]}]}'
    rows = gaps.programme_rows(spark.createDataFrame([("d", text), ("d", "{"), ("d", None)], "race_date string, document string"))
    assert [(r.race_number, r.horse_number, r.name) for r in rows.where("name is not null").collect()] == [(1, 2, "A")]
    codes = {r.code for r in gaps.document_violations(rows.where("city is not null")).collect()}
    assert codes == {"INVALID_TIME", "DUPLICATE_RUNNER", "EMPTY_RUNNER_NAME", "INVALID_URL"}


CARD_PAGE = (
    "<h3>1. Koşu 9.05</h3><div><h3>Maiden 1200 Çim</h3><b>1. 6'LI GANYAN Bu koşudan başlar</b></div>"
    "<table><tr><th>N</th><th>At İsmi</th><th>Sıklet</th><th>Jokey</th><th>AGF</th></tr><tr><td>3</td><td>KARA &amp; AK</td><td>54,5</td><td>A. B.</td><td>%12,5 (2)</td></tr>"
    "<tr><td></td><td>NO NUMBER</td><td></td><td>C</td><td></td></tr></table><table><tr><th>x</th></tr><tr><td>1</td></tr></table><h3>2. Koşu: 17:30</h3><h3>Handikap</h3>"
)


def test_card_rows(spark):
    page = spark.createDataFrame([(1, CARD_PAGE), (2, None), (3, ""), (4, "<table><tr><th>N</th><th>At İsmi</th><th>Jokey</th></tr><tr><td>1</td><td>A</td><td>B</td></tr></table>")], "page_id int, html string")
    assert [tuple(r) for r in cards.card_rows(page).collect()] == [(1, 1, "09:05", 1200, "Çim", 3, "KARA & AK", 54.5, "A. B.", None, 12.5)]
    assert [tuple(r) for r in cards.sixfold_starts(page).collect()] == [(1, 1, [1])]
    assert cards.card_rows(page.limit(0)).count() == 0


def test_meeting_links(spark):
    html = '<a href="/x/GunlukYarisProgrami?SehirAdi=%C4%B0zmir">a</a><a href="/x/GunlukYarisProgrami?k=1">IZMIR (2)</a><a href="/x/GunlukYarisProgrami?k=2">Paris (YD)</a><a href="/x/GunlukYarisProgrami?SehirAdi=%Z">Adana (1)</a>'
    rows = cards.meeting_links(spark.createDataFrame([(1, "https://a.b/", html), (2, None, None)], "page_id int, url string, html string")).collect()
    assert sorted(r["city"] for r in rows) == ["Adana", "İzmir"]


def test_snapshots_take_nothing_from_later(spark):
    at = lambda m: NOON + timedelta(minutes=m)
    text = '{"runners":[{"horse_number":1,"picks":[{"source_key":"a","source_rank":1},{"source_key":"b","source_rank":2}]},{"horse_number":2}]}'
    made = [("A", 1, at(-30), NOON, text), ("A", 1, at(-60), NOON, "{}"), ("A", 1, at(5), NOON, text), ("A", 2, at(-5), NOON, "{"), ("A", 3, at(-5), at(99), text), ("A", 4, at(-5), NOON, text)]
    every = spark.createDataFrame([(NOON.date(), *r) for r in made], "race_date date, city string, race_number int, captured_at timestamp, starts_at timestamp, snapshot string")
    points = spark.createDataFrame([(NOON.date(), "A", 1, 1, at(m), float(m)) for m in (-40, -30, -20)], "race_date date, city string, race_number int, horse_number bigint, captured_at timestamp, agf_percent double")
    chosen = snapshots.promoted(every, every.where("race_number = 4"), F.lit(at(1)))
    rows = snapshots.training_rows(chosen, points).select("race_number", "horse_number", "source_key", "agf_percent", "points").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 1, "a", -30.0, 2), (1, 1, "b", -30.0, 2), (1, 2, None, None, 0)]


def test_rebuild_goes_on_after_a_failure(spark, tmp_path):
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    rows = snapshots.rebuild(spark, [("a", lambda: spark.range(2)), ("b", bad), ("c", lambda: spark.range(0))], f"file://{tmp_path}").collect()
    assert [(r["stage"], r["status"], r["rows"]) for r in rows] == [("a", "ok", 2), ("b", "error", None), ("c", "ok", 0)]
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 2


def test_counters_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    row = snapshots.pipeline_counters(empty("captured_at timestamp, starts_at timestamp"), empty("evaluated_at timestamp, generated_at timestamp"), empty("status string, last_attempt_at timestamp, last_success_at timestamp")).first()
    assert (row["candidates"], row["pending"], row["errors"], row["latest_attempt"]) == (0, 0, 0, None)


def test_repair_is_applied(spark):
    rows = spark.createDataFrame([(k, NOON.date()) for k in range(4)], "mapping int, race_date date")
    kinds = spark.createDataFrame([(0, "MOVE_SOURCE_TO_TARGET"), (1, "DELETE_DUPLICATE_SOURCE"), (2, "MANUAL_REVIEW")], "mapping int, classification string")
    out = {r["mapping"]: r["race_date"].day for r in snapshots.restated(rows, kinds, F.date_add("race_date", 1)).collect()}
    assert out == {0: 2, 2: 1, 3: 1}


def test_hand_written_pages(spark):
    """Wrapped, nested and missing markup."""
    html = (
        "<h3 class=x>\n 1 .  KOŞU\n<b>9:05</b></h3><h3>Şartlı 1<i>400</i>sentetik</h3><p>2. 6’lı\n Ganyan - bu  koşudan\nbaşlar</p><p>1. 6'LI GANYAN sonra</p>"
        "<table><tr><th>No</th><th><b>At İsmi</b></th><th>Jokey</th></tr><tr><td>4</td><td>AY<br>IŞIĞI</td><td>C. D.</td></tr><tr><td></td><td>X</td><td>Y</td></tr></table>"
        "<h3>2. Koşu</h3><table><tr><td>no head</td></tr></table><h3>Handikap</h3>"
    )
    page = spark.createDataFrame([(1, html), (2, "<table><tr>"), (3, None)], "page_id int, html string")
    rows = cards.card_rows(page).collect()
    assert [(r.race_no, r.time, r.distance_meters, r.track, r.horse_number, r.jockey) for r in rows] == [(1, "09:05", 400, "Sentetik", 4, "C. D.")]
    assert [tuple(r) for r in cards.sixfold_starts(page).collect()] == [(1, 1, [2])]
