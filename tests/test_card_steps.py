"""Steps of the scored card take what they need where it lies, and stay compiled together."""

import datetime as dt

from pyspark.sql import functions as F

from paddock.functions.numeric import min_max
from paddock.operators import market
from paddock.plans import registry
from paddock.sources.stored import side_by_side

START = dt.datetime(2024, 1, 1, 12)


def test_movement_of_a_row_is_that_of_its_points(spark):
    """Points out of range, late, early, at one moment and missing; in any order."""
    at = lambda m: START - dt.timedelta(minutes=m)
    shares = {
        1: [(60, 5.0), (33, 9.0), (6, 12.0)], 2: [(6, 3.0), (60, 8.0), (33, 200.0)], 3: [(60, 5.0), (60, 4.0), (57, 7.0)], 4: [(0, 9.0), (-5, 9.0), (30, 8.0)], 5: [(91, 1.0), (90, 2.0), (10, 4.0)],
        6: [(60, None), (33, None), (6, None)], 7: [(60, 0.0), (6, 100.0), (None, 5.0)], 8: [(10, 5.0), (7, 6.0), (7, 6.0)], 9: [(10, -1.0), (5, 6.0), (1, 7.0)],
    }
    time = lambda m: None if m is None else at(m)
    wide = spark.createDataFrame([(k, START, *[x for m, a in p for x in (time(m), a)]) for k, p in shares.items()], "k int, starts_at timestamp, t0 timestamp, a0 double, t1 timestamp, a1 double, t2 timestamp, a2 double")
    long = spark.createDataFrame([(k, START, time(m), a) for k, p in shares.items() for m, a in p], "k int, starts_at timestamp, captured_at timestamp, agf_percent double")
    want = {r.k: r.market_score for r in market.movement(market.pre_race(long), 90, ["k"]).collect()}
    found = market.with_movement(wide, [(F.col(f"t{i}"), F.col(f"a{i}")) for i in range(3)])
    assert {r.k: r.market_score for r in found.collect()} == {k: want.get(k) for k in shares} and sum(v is not None for v in want.values()) > 3


def test_min_max_of_missing_ends(spark):
    rows = spark.createDataFrame([(5.0, 0.0, 10.0), (None, 0.0, 10.0), (5.0, None, 10.0), (5.0, 0.0, None), (3.0, 3.0, 3.0), (20.0, 0.0, 10.0)], "x double, a double, b double")
    assert [r[0] for r in rows.select(min_max(F.col("x"), F.col("a"), F.col("b"))).collect()] == [50.0, None, None, None, 50.0, 100.0]


def test_scored_rows_are_compiled_and_worked_out_once(spark):
    """No row and no sort a share point, stored rows not sorted anew, each extreme of a race once, methods under the 8,000 bytes of the JVM."""
    rows = registry.scored(spark, "/root/testdata/sf0.001").select("race_id", "horse_number", *registry.PARTS, "score", "model_confidence")
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # the plan of large tables
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        with side_by_side(spark):
            plan = rows._jdf.queryExecution().executedPlan()
            lines = plan.toString().splitlines()
            stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not [x for x in lines if "SortAggregate" in x]
    assert [x.count("windowspecdefinition(race_id") for x in lines if "min(" in x and "Window [" in x] == [4]
    assert len(sizes) > 10 and max(sizes) < 8000


def test_race_coverage_joins_runners_where_they_lie(spark):
    """Of the joins by runner none deals its sides out by race and number."""
    from paddock.plans import more

    rows = more.covered(spark, "/root/testdata/sf0.001")
    found = more.race_coverage(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    with side_by_side(spark):
        plan = more.covered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(race_id" in x and ", horse_number" in x.split("hashpartitioning(", 1)[1]]
