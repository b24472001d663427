"""A stream that reads all there is gives what the batch gives."""

from pyspark.sql import functions as F

from paddock.sources import racing
from paddock.streaming import market as stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    points = racing.market_points(spark, SF)
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    again = spark.read.parquet(str(tmp_path / "in")).limit(50)
    again.write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def ran(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    newest = ran(stream.newest_candidates(source()), "complete", "newest")
    batch = stream.newest_candidates(points)
    assert {tuple(r) for r in newest.collect()} == {tuple(r) for r in batch.collect()}
    query = source().writeStream.foreachBatch(stream.insert_new(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == points.dropDuplicates(stream.KEY).count()
    rate = ran(stream.capture_rate(source(), "1 hour", "40 days"), "append", "rate")
    hours = points.groupBy(F.window("captured_at", "1 hour").alias("w")).agg(F.count("*").alias("points"))
    due = points.agg(F.max("captured_at") - F.expr("interval 40 days")).first()[0]  # only windows behind the watermark are out
    assert {tuple(r) for r in rate.collect()} == {tuple(r) for r in hours.where(F.col("w.end") <= F.lit(due)).select("w.start", "w.end", "points").collect()}
    short = ran(stream.capture_rate(source(), "1 hour", "1 hour"), "append", "short_rate")
    found, want = {r.start: r.points for r in short.collect()}, {r.start: r.points for r in hours.select("w.start", "points").collect()}
    assert 0 < len(found) <= len(want) and all(0 < n <= want[at] for at, n in found.items())
    unique = ran(stream.deduplicated(source(), "40 days"), "append", "unique")
    assert unique.count() == points.dropDuplicates(stream.KEY).count()
    assert unique.groupBy(*stream.KEY).count().where(F.col("count") > 1).isEmpty()


def test_late_and_early_points(spark, tmp_path):
    """After the start and before the window nothing counts, in whatever order points come."""
    rows = [("first", 80, 10.0), ("first", 20, 12.0), ("second", 30, 99.0), ("second", 10, 16.0), ("second", 10, 16.0), ("third", 100, 1.0), ("third", -5, 50.0), ("third", 15, 120.0)]
    schema = "race_date date, city string, race_number long, horse_number long, captured_at timestamp, agf_percent double, starts_at timestamp"
    import datetime as dt

    start = dt.datetime(2024, 5, 1, 12)
    for k, name in enumerate(("first", "second", "third")):
        part = [(start.date(), "C", 1, 1, start - dt.timedelta(minutes=m), x, start) for n, m, x in rows if n == name]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.running_movement(source.dropDuplicates(stream.KEY)).writeStream.format("memory").queryName("moves").outputMode("complete").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    (r,) = spark.table("moves").collect()
    assert (r.sample_size, r.delta, r.direction) == (4, 6.0, "strong-up") and r.market_score == 50 + 30 * 0.6 + 20


def test_upsert_sink(spark, tmp_path):
    """The newest version of a key stays; days outside a batch aren't touched."""
    import datetime as dt

    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    day = lambda n: dt.date(2024, 5, n)
    write = stream.upsert_into(str(tmp_path / "t"), ["race_date", "k"], "version")
    for k, batch in enumerate(([(day(1), 1, 1, "a"), (day(2), 1, 1, "b")], [(day(1), 1, 2, "new"), (day(1), 2, 1, "c")], [(day(1), 1, 1, "old")])):
        write(spark.createDataFrame(batch, "race_date date, k long, version long, v string"), k)
    got = {(r.race_date.day, r.k): r.v for r in stream.current(spark, str(tmp_path / "t")).collect()}
    assert got == {(1, 1): "new", (2, 1): "b", (1, 2): "c"}
