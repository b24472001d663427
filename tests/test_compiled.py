"""Steps of the race card stay compiled, and are worked out once a row."""

import pytest
from pyspark.sql import functions as F

from paddock.operators import gaps, scoring


def test_comment_text_is_lowered_once(spark):
    said = ["PİST ve  Mesafe uygun", "kumda etkili", "mesafe uzun gelir", "zemin uygun değil", "Formda", None]
    comments = spark.createDataFrame([(i % 3, c, t) for i, (c, t) in enumerate((c, t) for c in said for t in ("Kum", None))], "k int, comment string, track string")
    rows = gaps.comment_sentiment(comments, ["k"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(translate(coalesce(comment") == 1
    assert sorted((r.k, r.relevant, r.score) for r in rows.collect()) == [(0, 2, 70.0), (1, 3, 50.0), (2, 2, 50.0)]


@pytest.mark.parametrize("raw", ["123456", "4519-71", "0", "", "x1", "99", "102030405060", None])
def test_form_in_steps_is_the_form_of_its_columns(spark, raw):
    rows = spark.createDataFrame([(raw,)], "recent_form_raw string")
    found = scoring.with_recent_form(rows).select("form_score", "trend")
    assert found.collect() == rows.select(*[c.alias(n) for c, n in zip(scoring.recent_form(F.col("recent_form_raw")), ("form_score", "trend"), strict=True)]).collect()


def test_form_step_is_small_enough_to_be_compiled(spark):
    """The JVM leaves methods of over 8,000 bytes interpreted."""
    rows = scoring.with_recent_form(spark.range(8).select(F.col("id").cast("string").alias("recent_form_raw")))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(rows._jdf.queryExecution().executedPlan())
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_scored_rows_stay_with_their_race(spark):
    """While a table is written, joins by race and runner deal neither side out anew."""
    from paddock.plans import registry
    from paddock.sources.stored import side_by_side

    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    rows = registry.scored(spark, "/root/testdata/sf0.001")
    with side_by_side(spark):
        plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(race_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(race_id" in x and ", horse_number" in x.split("hashpartitioning(", 1)[1]]
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("name", ["ticket_snapshots", "ticket_inputs"])
def test_tickets_are_made_once_and_legs_lie_with_the_runners(spark, name):
    from paddock.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan and "hashpartitioning(race_id" not in plan
