"""What the plans of round 3's findings must not do: exchange what is worked out where it lies, or do one thing twice."""

import re

from paddock.operators import reports, runs
from paddock.plans import archive, registry
from paddock.sources import documents, racing
from paddock.sources.versioned import Versions

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_picks_take_the_finish_from_their_own_runner(spark, monkeypatch):
    monkeypatch.setattr(registry, "once", lambda *a, **how: a[4]())
    assert "Join" not in plan(registry.first_picks(spark, D))


def test_documents_are_written_and_read_once(spark):
    for rows in (documents.form_rows, documents.field_rows):
        assert not re.search(r"Filter .*StructsToJson", plan(rows(archive.extracted(spark, D))))


def test_documents_that_break_off_have_no_rows(spark):
    docs = spark.createDataFrame([(1, "field", '{"rows":[{"horseName":"A"}]}'), (2, "field", '{"rows":[{"horseName":"A"}'), (3, "field", None), (4, "field", '{"rows":null}'), (5, "field", "{}")], "doc_key long, kind string, document string")
    assert [(r.doc_key, r.horse_name) for r in documents.field_rows(docs).collect()] == [(1, "A")]
    assert documents.form_rows(docs.select("doc_key", documents.F.lit("form").alias("kind"), "document")).count() == 1


def test_meetings_are_grouped_as_numbers(spark):
    grouped = [x for x in plan(registry.programmes(spark, D)).split("\n") if "partial_collect_list" in x]
    assert grouped and not any("HORSE " in x or "https" in x for x in grouped)


def test_pick_coverage_exchanges_no_runners(spark):
    assert not re.search(r"Exchange hashpartitioning\(.*horse_number", plan(reports.pick_coverage(racing.picks(spark, D), racing.races(spark, D))))


def test_coverage_of_repeated_picks_and_unknown_cities(spark):
    picks = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (3, 1, "a"), (1, 1, "b"), (1, 1, None)], "race_id long, horse_number long, source_key string")
    races = spark.createDataFrame([(1, "X"), (2, "Y"), (3, None)], "race_id long, city string")
    got = sorted(map(str, (tuple(r) for r in reports.pick_coverage(picks, races).collect())))
    assert got == sorted(map(str, [("a", None, 5, 4, 3), ("a", "X", 3, 2, 1), ("a", "Y", 1, 1, 1), ("a", None, 1, 1, 1), ("b", None, 1, 1, 1), ("b", "X", 1, 1, 1)]))


def test_versions_are_written_small(spark, tmp_path):
    stored = Versions(spark, f"file://{tmp_path}")
    stored.commit(0, {"t": spark.range(9)})
    assert [p for p in tmp_path.rglob("*.parquet")] and all(".zstd." in p.name for p in tmp_path.rglob("*.parquet"))


def test_result_checks_hold_no_group_a_runner(spark):
    rows = spark.createDataFrame([("d", "1995-01-01", 1, 1, 1), ("d", "1995-01-01", 1, 1, 2), ("d", "1995-01-01", 2, None, 1), ("d", "1995-01-01", 2, 5, 2)], "document string, race_date string, race_number long, horse_number long, finish_position long")
    found = runs.result_checks(rows)
    assert not re.search(r"keys=\[[^\]]*horse_number", plan(found))
    assert sorted((r.race_number, r.code) for r in found.collect()) == [(1, "DUPLICATE_RACE_OR_RUNNER"), (2, "DUPLICATE_RACE_OR_RUNNER")]
