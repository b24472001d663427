"""Keyed state with timers, stream-static ingest and commits by batch id."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.sources.versioned import Versions, rewrite
from paddock.streaming import market as stream
from paddock.streaming import stateful

START = dt.datetime(2024, 5, 1, 12)
SCHEMA = "race_date date, city string, race_number long, horse_number long, captured_at timestamp, agf_percent double, starts_at timestamp"


def point(minutes, agf, horse=1, start=START, race=1):
    return (START.date(), "C", race, horse, START - dt.timedelta(minutes=minutes), agf, start)


FAR = START + dt.timedelta(days=2)
PUSH = (FAR.date(), "Z", 9, 9, FAR - dt.timedelta(hours=1), 1.0, FAR)  # moves the watermark past every other start
AGAIN = (FAR.date(), "Z", 9, 9, FAR - dt.timedelta(minutes=100), 1.0, FAR)


class Fed:
    """A streaming query that is given one batch after another."""

    def __init__(self, spark, folder, made, mode, name):
        for k, v in stateful.STORE.items():
            spark.conf.set(k, v)
        self.spark, self.folder, self.name, self.made, self.mode = spark, folder, name, made, mode
        (folder / "in").mkdir()

    def feed(self, *rows):
        if rows:
            self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        out, kept = [], []

        def keep(batch, batch_id):
            out.extend(batch.collect())

        query = self.made(source).writeStream.foreachBatch(keep).outputMode(self.mode).option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return out, kept[-1] if kept else None


def test_candidate_is_emitted_once_at_the_start(spark, tmp_path):
    fed = Fed(spark, tmp_path, stateful.candidate_at_start, "append", "candidates")
    out, rows = fed.feed(point(80, 10.0), point(20, 14.0), point(50, 12.0), point(-5, 99.0), point(30, 7.0, horse=2), point(10, 101.0, horse=2))
    assert out == [] and rows > 0
    out, _ = fed.feed(PUSH)
    got = {(r.horse_number, r.captured_at, r.agf_percent) for r in out}
    assert got == {(1, START - dt.timedelta(minutes=20), 14.0), (2, START - dt.timedelta(minutes=30), 7.0)}
    out, rows = fed.feed(point(1, 55.0), AGAIN)  # after the timer nothing changes
    assert out == []
    alone = rows
    out, rows = fed.feed(point(2, 56.0, horse=2), point(3, 57.0, horse=3))
    assert out == [] and rows == alone  # only the race that is still ahead has state
    end = (FAR.date(), "Z", 9, 8, FAR + dt.timedelta(hours=1), 1.0, FAR)  # of after the last start: it has no state itself
    out, _ = fed.feed(end)
    assert [r.city for r in out] in ([], ["Z"])
    more, rows = fed.feed(end)
    assert [r.captured_at for r in out + more] == [PUSH[4]] and rows == 0


def test_moved_start_moves_the_timer(spark, tmp_path):
    later = START + dt.timedelta(minutes=60)
    fed = Fed(spark, tmp_path, stateful.candidate_at_start, "append", "moved")
    fed.feed(point(40, 10.0))
    fed.feed(point(10, 11.0, start=later), (START.date(), "D", 1, 1, START + dt.timedelta(minutes=20), 5.0, FAR))  # the watermark passes the old start
    out, _ = fed.feed(point(-15, 12.0, start=later))
    assert out == []
    out, _ = fed.feed(PUSH)
    assert [(r.captured_at, r.agf_percent, r.starts_at) for r in out if r.city == "C"] == [(START + dt.timedelta(minutes=15), 12.0, later)]


def test_running_score_in_update_mode_with_bounded_state(spark, tmp_path):
    fed = Fed(spark, tmp_path, stateful.bounded_movement, "update", "scores")
    (r,), first = fed.feed(point(80, 10.0), point(80, 10.0), point(100, 1.0))
    assert (r.sample_size, r.market_score, r.direction) == (1, None, "unknown")
    (r,), second = fed.feed(point(20, 16.0), point(-1, 90.0), point(80, 10.0))
    assert (r.sample_size, r.delta, r.direction, r.market_score) == (2, 6.0, "strong-up", 50 + 30 * 0.6 + 20)
    assert second == first + 1  # one point more; the repeated one has no state of its own
    out, same = fed.feed(point(80, 10.0), point(20, 16.0))
    assert out == [] and same == second
    out, _ = fed.feed(PUSH)
    out, left = fed.feed(point(15, 30.0), AGAIN)  # after the start: no row, no state
    assert [r.city for r in out if r.city == "C"] == []
    assert left == 2  # the start and one point of the race that is still ahead


def test_ingest_sees_races_as_they_stand(spark, tmp_path):
    races, points = str(tmp_path / "races"), "race_date date, city string, race_number long, horse_number long, captured_at timestamp, agf_percent double"
    put = lambda start: spark.createDataFrame([(START.date(), "C", 1, start)], "race_date date, city string, race_number long, starts_at timestamp").write.mode("overwrite").parquet(races)
    write = stateful.ingest(lambda s: s.read.parquet(races), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(points).parquet(str(tmp_path / "in"))

    def feed(*rows):
        spark.createDataFrame([r[:6] for r in rows], points).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    put(START)
    feed(point(10, 5.0), point(10, 5.0), point(-10, 6.0), point(5, 7.0, race=2))
    put(START + dt.timedelta(minutes=30))
    feed(point(-20, 8.0), point(-40, 9.0))
    got = lambda: sorted(r.agf_percent for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got() == [5.0, 8.0]
    write(spark.createDataFrame([point(-20, 8.0)[:6]], points), 1)  # the second batch again
    assert got() == [5.0, 8.0]


def test_replayed_and_failed_batches_leave_the_table(spark, tmp_path):
    path, day = str(tmp_path / "t"), lambda n: dt.date(2024, 5, n)
    frame = lambda rows: spark.createDataFrame(rows, "race_date date, k long, version long, v string")
    write = stream.upsert_into(path, ["race_date", "k"], "version")
    got = lambda: {(r.race_date.day, r.k): r.v for r in stream.current(spark, path).collect()}
    assert stream.current(spark, path) is None
    write(frame([(day(1), 1, 1, "a"), (day(2), 1, 1, "b")]), 0)
    write(frame([(day(1), 1, 2, "new"), (day(1), 2, 1, "c")]), 1)
    want = {(1, 1): "new", (2, 1): "b", (1, 2): "c"}
    assert got() == want
    write(frame([(day(1), 1, 9, "replayed with other rows")]), 1)
    write(frame([(day(1), 1, 9, "older still")]), 0)
    assert got() == want
    broken = frame([(day(1), 1, 9, "x"), (day(2), 1, 9, "y")]).withColumn("v", F.when(F.col("race_date") == day(2), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        write(broken, 2)
    assert got() == want and Versions(spark, path).version() == 1
    write(frame([(day(1), 1, 9, "x")]), 2)
    assert got() == want | {(1, 1): "x"}
    assert Versions(spark, path).read("rows", version=0).count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    one = spark.range(3)
    assert table.commit(0, {"a": one}) and not table.commit(0, {"a": spark.range(9)})
    assert not table.publish(0, {}) and table.read("a").count() == 3


def test_rewrite_of_related_tables_is_whole_or_nothing(spark, tmp_path):
    names = ["points", "picks", "runners", "races", "meetings"]
    table = Versions(spark, str(tmp_path / "t"))
    table.commit(0, {n: spark.range(10 * (k + 1)) for k, n in enumerate(names)})
    count = lambda: [table.read(n).count() for n in names]
    cut = {n: (lambda df: df.where("id % 2 = 0")) for n in names}

    def fails(df):
        raise RuntimeError("between two tables")

    with pytest.raises(RuntimeError):
        rewrite(table, 1, cut | {"races": fails})
    with pytest.raises(Exception, match="boom"):
        rewrite(table, 1, cut | {"races": lambda df: df.where(F.raise_error(F.lit("boom")).isNull())})
    assert count() == [10, 20, 30, 40, 50] and table.version() == 0
    assert rewrite(table, 1, cut) and count() == [5, 10, 15, 20, 25]
