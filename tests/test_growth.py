"""Queries whose work grew with the square of a group, or whose rows changed once a group outgrew small tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from paddock.operators import gaps, market
from paddock.plans import registry
from paddock.sources import pages

MONTH = dt.datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def long_meeting(spark, tmp_path_factory):
    """One meeting of 120 races, which reach into the third day, with a runner each."""
    d = str(tmp_path_factory.mktemp("long"))
    made = {
        "nation": ([(0, "X")], "n_nationkey int, n_name string"), "customer": ([(0, 0)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, 0, MONTH) for i in range(1, 121)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": ([(i, i, i, 1, 5.0, 100.0, "N") for i in range(1, 121)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"),
        "events": ([(MONTH, 1, "a", 1.0)], "ts timestamp_ntz, user_id long, event_type string, value double"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["local_instants", "card_rows", "sixfold_starts"])
def test_long_meeting_matches_sql(spark, long_meeting, name):
    d, con = long_meeting
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(repr(row) for row in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in registry.queries()[name](spark, d).collect()) == want


def test_next_start_looks_one_row_back(spark):
    at = lambda m: MONTH + dt.timedelta(minutes=m)
    seen = spark.createDataFrame([("d", at(m)) for m in (0, 5, 10, 11, 30)], "race_date string, captured_at timestamp")
    found = market.minutes_to_next_start(seen, spark.createDataFrame([("d", at(10)), ("d", at(20)), ("e", at(40))], "race_date string, starts_at timestamp"))
    assert [r.minutes for r in found.orderBy("captured_at").collect()] == [10, 5, 0, 9, None]
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString()


def test_field_signals_of_runs(spark):
    """As if every run were paired with every other race of its name; a race doesn't see what it alone has."""
    runs = spark.createDataFrame(
        [(r, n, dt.date(2024, 1, 1 + day), f) for n in ("A", "b (3)") for r, day, f in [(1, 1, 3), (1, 1, 4), (1, 1, 5), (2, 1, 3), (2, 2, 1), (3, 3, 0), (4, 4, 7), (5, 5, 2), (6, 6, 2), (6, 6, 1), (7, 7, 9), (8, 8, None)]],
        "race_id long, name string, race_date date, finish_position int",
    )
    runners = spark.createDataFrame([(r, i, n) for r in range(1, 10) for i, n in enumerate(["a", "B", "none"])], "race_id long, horse_number long, name string")
    own, past = runners.where("horse_number < 2").select("race_id").distinct(), runs.withColumnRenamed("race_id", "past")
    paired = own.join(past, F.col("race_id") != F.col("past")).select("race_id", "name", "race_date", "finish_position").distinct()
    found = gaps.field_signals_of_runs(runners, runs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gaps.field_signals(runners, paired).collect()))


def test_columns_are_told_without_an_exchange(spark):
    html = "<table><tr><th>N<th>HP</tr><tr><td>1<td>7</tr><tr><td rowspan=2>2<td>8</tr><tr><td>9</tr></table><table><tr><td>x</table>"
    rows = pages.named_columns(pages.tables(spark.createDataFrame([("p", html)], "page_id string, html string")), {"number": ["N"], "hp": ["Hp"], "odds": ["Gny"]})
    assert [(r.row_no, r.number, r.hp, r.odds) for r in rows.orderBy("row_no").collect()] == [(1, "1", "7", None), (2, "2", "8", None), (3, "2", "9", None)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_picks_are_not_dealt_out_by_their_few_sources(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.experts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [source_key" not in plan


def test_own_adjustment_is_that_of_its_own_priors(spark):
    from paddock.operators import expert, learning
    from paddock.sources import racing

    d = "/root/testdata/sf0.001"
    rows = learning.with_context(racing.runners(spark, d), racing.races(spark, d)).withColumn("horse_id", F.col("horse_id") % 20).withColumn("jockey_id", F.when(F.col("jockey_id") % 3 != 0, F.col("jockey_id") % 5))
    rows, columns = rows.withColumn("city", F.when(F.col("race_id") % 7 != 0, F.lit("X"))), ["race_id", "horse_number", "signal", "adjustment"]
    rates = expert.global_rates(rows)
    found = learning.own_adjustment(rows, rates).select(columns)
    want = sorted(map(tuple, learning.adjustment(rows, learning.context_priors(rows), rates).select(columns).collect()))
    assert sum(w[2] is not None for w in want) > 1000 and sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
