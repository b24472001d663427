"""As-of market features and movement, one pass over the points of a runner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, rounded

RACE = ["race_date", "city", "race_number"]
RUNNER = [*RACE, "horse_number"]


def before(start: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.unix_micros(start) / 1e6 - 60 * minutes)


def pre_race(points: DataFrame) -> DataFrame:
    """Points with a share of 0 to 100 captured before the start."""
    return points.where("agf_percent between 0 and 100 and captured_at < starts_at")


def features(points: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Latest share at or before 90, 30 and 5 minutes to the start and at the cutoff, largest rise and fall in the last 90 minutes.

    The cutoff (default: the last moment before the start) must be a function of the race. Bounds after it give NULL.
    """
    rows = points.withColumn("cutoff", cutoff if cutoff is not None else F.col("starts_at"))
    return rows.groupBy(*RUNNER).agg(*feature_columns())


def feature_columns() -> list[Column]:
    """The aggregates of `features` over rows with starts_at, captured_at, agf_percent (NULL: no share point) and cutoff."""
    start, agf, stop = F.col("starts_at"), F.col("agf_percent"), F.col("cutoff")
    at = F.when(agf.isNotNull(), F.col("captured_at"))
    asof = lambda bound: F.max_by(F.when(at <= bound, agf), F.when(at <= bound, at))
    late = lambda minutes: F.when(F.max(stop >= before(start, minutes)), asof(before(start, minutes)))
    inside = (at >= before(start, 90)) & (at <= stop)
    first, inner = F.min_by(F.when(inside, agf), F.when(inside, at)), F.when(inside, agf)
    return [
        asof(F.least(stop, before(start, 90))).alias("t90"), late(30).alias("t30"), late(5).alias("t5"), asof(stop).alias("final"),
        (F.max(inner) - first).alias("max_rise"), (F.min(inner) - first).alias("max_fall"),
    ]


def movement(points: DataFrame, window_minutes: int = 90, keys: list[str] = RUNNER) -> DataFrame:
    """Score and direction of the share's movement within the window before the start."""
    at, agf = F.col("captured_at"), F.col("agf_percent")
    inside = points.where((at >= before(F.col("starts_at"), window_minutes)) & (at <= F.col("starts_at")))
    by = inside.groupBy(*keys).agg(
        F.countDistinct(F.struct(at, agf)).alias("sample_size"), F.min_by(agf, F.struct(at, agf)).alias("first_agf"), F.max_by(agf, F.struct(at, agf)).alias("latest_agf"),
        (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("span"),
    )
    return by.select(*keys, "sample_size", *movement_columns())


def with_movement(rows: DataFrame, points: list[tuple[Column, Column]], window_minutes: int = 90) -> DataFrame:
    """`market_score` of rows that have `starts_at` and hold a runner's whole series; points: its columns (captured_at, agf_percent), in any order.

    As `movement` of `pre_race` has it, without a row a point, a sort or an aggregate.
    """
    start = F.col("starts_at")
    rows = rows.withColumns({f"_{c}{i}": x for i, p in enumerate(points) for c, x in zip(("at", "agf"), p, strict=True)}).withColumn("_low", before(start, window_minutes))
    at, agf = ([F.col(f"_{c}{i}") for i in range(len(points))] for c in ("at", "agf"))
    seen = [F.when(a.between(0, 100) & (t < start) & (t >= F.col("_low")), F.struct(t.alias("at"), a.alias("agf"))) for t, a in zip(at, agf, strict=True)]
    rows = rows.withColumns({"_first": F.least(*seen), "_last": F.greatest(*seen)}).drop("_low", *[f"_{c}{i}" for c in ("at", "agf") for i in range(len(points))])
    span = F.unix_micros("_last.at") - F.unix_micros("_first.at")
    rows = rows.withColumns({"first_agf": F.col("_first.agf"), "latest_agf": F.col("_last.agf"), "span": span}).drop("_first", "_last")
    return rows.withColumn("market_score", movement_columns()[0]).drop("first_agf", "latest_agf", "span")


def movement_columns() -> list[Column]:
    """market_score, delta and direction from first_agf, latest_agf and span (microseconds); a span above nothing has two points at least."""
    moved = F.coalesce(F.col("span") >= 4 * 60 * 1_000_000, F.lit(False))
    delta = F.col("latest_agf") - F.col("first_agf")
    relative = delta / F.greatest(F.col("first_agf"), F.lit(5.0))
    score = 50 + 30 * clamp(delta / 10, -1.0, 1.0) + 20 * clamp(relative / 0.5, -1.0, 1.0)
    direction = F.when(~moved, "unknown").when(delta >= 5, "strong-up").when(delta >= 1.5, "up").when(delta <= -5, "strong-down").when(delta <= -1.5, "down").otherwise("flat")
    return [F.when(moved, rounded(clamp(score, 0.0, 100.0), 1)).alias("market_score"), F.when(moved, rounded(delta, 2)).alias("delta"), direction.alias("direction")]


def series(points: DataFrame, latest: int | None = None) -> DataFrame:
    """The ordered share series of every runner, or its latest points, newest first."""
    if latest is None:
        return points.groupBy(*RUNNER).agg(F.array_sort(F.collect_list(F.struct("captured_at", "agf_percent"))).alias("series"))
    order = Window.partitionBy(*RUNNER).orderBy(F.col("captured_at").desc(), "agf_percent")
    return points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= latest)


def minutes_to_next_start(observations: DataFrame, starts: DataFrame) -> DataFrame:
    """Forward as-of join by day: (race_date, captured_at) with the minutes to the first start at or after it.

    Walked from the last row back, so that a row looks at its predecessor only; a frame that reaches to the end is read anew by every row.
    """
    both = observations.select("race_date", "captured_at", F.lit(None).cast("timestamp").alias("starts_at"), F.lit(0).alias("side")).unionByName(
        starts.select("race_date", F.col("starts_at").alias("captured_at"), "starts_at", F.lit(1).alias("side"))
    )
    ahead = Window.partitionBy("race_date").orderBy(F.col("captured_at").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next", F.last("starts_at", ignorenulls=True).over(ahead)).where("side = 0")
    return found.select("race_date", "captured_at", F.floor((F.unix_micros("next") - F.unix_micros("captured_at")) / 60_000_000).alias("minutes"))
