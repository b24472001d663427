"""Form, field and model scores, race uncertainty and the recommended selection."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, min_max, rounded

# Fixed values of the model.
WEIGHTS = {"agf": 25, "expert": 22, "form": 18, "hp": 15, "market": 10, "weight_carried": 5, "field": 5}
RECENT = ((100, 86, 74, 62, 52, 43, 35, 28, 22, 16), (1.0, 0.85, 0.7, 0.55, 0.4, 0.3), 4)
HISTORY = ((100, 86, 74, 62, 52, 42, 34, 27, 20), (1.0, 0.85, 0.7, 0.55, 0.4), 3)
FIELD = ((100, 86, 74, 63, 53, 44, 36, 29, 23, 15), (1.0, 0.85, 0.7, 0.55, 0.4), 99)


def recent_digits(raw: Column) -> Column:
    """The last six digits of the text, newest first."""
    return F.reverse(F.right(F.regexp_replace(raw, "[^0-9]", ""), F.lit(6)))


def places_of(digits: Column) -> Column:
    """A place a digit, 0 standing for 10."""
    at = lambda i: (F.ascii(F.substring(digits, i, 1)) + 1) % 10 + 1  # noqa: E731 ("0" has code 48)
    return F.slice(F.array(*[at(i) for i in range(1, 7)]), F.lit(1), F.length(digits))


def recent_positions(raw: Column) -> Column:
    """Newest first; the last six digits of the text, 0 standing for 10."""
    return places_of(recent_digits(raw))


def weighted_form(positions: Column, table: tuple[int, ...], recency: tuple[float, ...]) -> Column:
    """Mean of the table's values with weights by recency; places beyond the table, and 0, take its last.

    Written out place by place: functions over lambdas are interpreted value by value, sums of a few columns are compiled.
    """
    return weighted_places([F.get(positions, F.lit(i)) for i in range(len(recency))], F.size(positions), table, recency)


def weighted_places(places: list[Column], n: Column, table: tuple[int, ...], recency: tuple[float, ...]) -> Column:
    """`weighted_form` of the first n of some columns."""
    points = F.array(*[F.lit(float(x)) for x in (table[-1], *table)])
    value = lambda p: F.coalesce(F.get(points, p.cast("int")), F.lit(float(table[-1])))
    total = sum((F.when(n > i, value(places[i]) * w).otherwise(0.0) for i, w in enumerate(recency)), F.lit(0.0))
    weight = F.get(F.array(*[F.lit(x) for x in accumulate(recency)]), F.least(n, F.lit(len(recency))) - 1)
    return total / weight


def halves(positions: Column, most: int = 6) -> tuple[Column, Column]:
    """Mean of the newest two places and of the others; positions has `most` at most."""
    place = lambda i: F.coalesce(F.get(positions, F.lit(i)), F.when(F.size(positions) <= i, 0)).cast("double")
    recent = F.try_divide(place(0) + place(1), F.least(F.size(positions), F.lit(2)).cast("double"))
    return recent, F.try_divide(sum((place(i) for i in range(3, most)), place(2)), (F.size(positions) - 2).cast("double"))


def trend_of(recent: Column, older: Column, few: Column) -> Column:
    return F.when(few, "unknown").when(recent <= older - 1, "improving").when(recent >= older + 1, "declining").otherwise("stable")


def trend(positions: Column, least: int, most: int = 6) -> Column:
    """How the newest two places compare with the others."""
    return trend_of(*halves(positions, most), F.size(positions) < least)


def recent_form(raw: Column) -> tuple[Column, Column]:
    """(score or NULL, trend) of a compact form text."""
    positions = recent_positions(raw)
    t = trend(positions, RECENT[2])
    step = F.when(t == "improving", 5.0).when(t == "declining", -5.0).otherwise(0.0)
    return F.when(F.size(positions) > 0, rounded(clamp(weighted_form(positions, RECENT[0], RECENT[1]) + step, 0.0, 100.0), 1)), t


def with_recent_form(rows: DataFrame) -> DataFrame:
    """`form_score` and `trend` as of `recent_form`, in steps, so that digits, places, means and trend are worked out once a row.

    The last six digits are one number, so that places are columns of numbers and no row has an array or a text of a digit.
    """
    digits, n, at = F.col("_digits"), F.col("_n"), [F.col(f"_p{i}") for i in range(6)]
    rows = rows.withColumn("_digits", F.substring(F.regexp_replace("recent_form_raw", "[^0-9]", ""), -6, 6))
    rows = rows.withColumns({"_n": F.length(digits), "_v": digits.try_cast("int")}).drop("_digits")
    place = lambda i: F.try_mod((F.col("_v") / 10**i).cast("int") + 9, F.lit(10)) + 1  # noqa: E731 (0 stands for 10)
    rows = rows.withColumns({f"_p{i}": F.when(n > i, place(i)).when(n <= i, 0) for i in range(6)}).drop("_v")
    older = F.try_divide(sum((p.cast("double") for p in at[3:]), at[2].cast("double")), (n - 2).cast("double"))
    rows = rows.withColumns({"_recent": F.try_divide(at[0].cast("double") + at[1].cast("double"), F.least(n, F.lit(2)).cast("double")), "_older": older})
    rows = rows.withColumns({"trend": trend_of(F.col("_recent"), F.col("_older"), n < RECENT[2]), "_mean": weighted_places(at, n, RECENT[0], RECENT[1])}).drop("_recent", "_older", *[f"_p{i}" for i in range(6)])
    step = F.when(F.col("trend") == "improving", 5.0).when(F.col("trend") == "declining", -5.0).otherwise(0.0)
    rows = rows.withColumn("_mean", F.col("_mean") + step)
    return rows.withColumn("form_score", F.when(n > 0, rounded(clamp(F.col("_mean"), 0.0, 100.0), 1))).drop("_n", "_mean")


def history_form(positions: Column) -> tuple[Column, Column]:
    """(score, trend) of finishes, newest first, five at most."""
    newest = F.slice(positions, 1, 5)
    t = trend(newest, HISTORY[2])
    step = F.when(t == "improving", 6.0).when(t == "declining", -6.0).otherwise(0.0)
    return F.when(F.size(newest) > 0, rounded(clamp(weighted_form(newest, HISTORY[0], HISTORY[1]) + step, 0.0, 100.0), 1)), t


def field_score(positions: Column) -> Column:
    """Same-condition finishes, newest first, shrunk to 50 below three."""
    return F.when(F.size(positions) > 0, rounded(50 + (weighted_form(positions, FIELD[0], FIELD[1]) - 50) * F.least(F.size(positions) / 3.0, F.lit(1.0)), 1))


def combined_field(measured: Column, expert: Column) -> Column:
    return F.when(measured.isNotNull() & expert.isNotNull(), rounded(0.75 * measured + 0.25 * expert, 1)).otherwise(F.coalesce(measured, expert))


def components(runners: DataFrame) -> DataFrame:
    """Component scores of every runner; needs agf_percent, expert_score, expert_confidence, market_score and field_score.

    Each extreme of a race is a column of its own first: named twice in a formula, it would be worked out twice. The form
    comes after the windows, which part the compiled methods: with what goes before them it would outgrow 8,000 bytes.
    """
    race = Window.partitionBy("race_id")
    hp, weight = F.col("hp").cast("double"), F.col("weight")
    ends = {"_hp_low": F.min(hp), "_hp_high": F.max(hp), "_weight_low": F.min(weight), "_weight_high": F.max(weight)}
    rows = with_recent_form(runners.withColumns({n: c.over(race) for n, c in ends.items()}))
    return rows.withColumns(
        {
            "agf_score": clamp(F.col("agf_percent"), 0.0, 100.0),
            "expert_part": 50 + (F.col("expert_score") - 50) * F.col("expert_confidence"),
            "hp_score": min_max(hp, F.col("_hp_low"), F.col("_hp_high")),
            "weight_score": 100 - min_max(weight, F.col("_weight_low"), F.col("_weight_high")),
        }
    ).drop(*ends)


def model_score(rows: DataFrame) -> DataFrame:
    """`score` and `model_confidence`: missing components are left out and the weights of the rest renormalised."""
    parts = dict(zip(WEIGHTS, (F.col(c) for c in ("agf_score", "expert_part", "form_score", "hp_score", "market_score", "weight_score", "field_score")), strict=True))
    have = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0) for k, c in parts.items()), F.lit(0))
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    rows = rows.withColumns({"_have": have, "_mean": F.try_divide(total, have)})  # a step of its own, so that neither is worked out twice
    return rows.withColumns({"score": F.when(F.col("_have") > 0, rounded(F.col("_mean"), 2)).otherwise(50.0), "model_confidence": rounded(F.col("_have") / 100.0, 3)}).drop("_have", "_mean")


def uncertainty(scored: DataFrame) -> DataFrame:
    """One row a race: leader, margin, uncertainty and its level."""
    by = scored.groupBy("race_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"), (F.sum(F.round(F.col("model_confidence") * 1000).cast("long")) / F.count("*") / 1000.0).alias("confidence"), F.count("*").alias("runners"))
    leader, second = F.element_at("s", 1), F.try_element_at("s", F.lit(2))
    by = by.withColumn("margin", F.coalesce(leader - second, leader))
    by = by.withColumn("u", clamp(0.7 * clamp(1 - F.col("margin") / 25, 0.0, 1.0) + 0.3 * (1 - clamp(F.col("confidence"), 0.0, 1.0)), 0.0, 1.0))
    level = F.when(F.col("u") < 0.25, "low").when(F.col("u") < 0.5, "medium").when(F.col("u") < 0.75, "high").otherwise("very-high")
    return by.select("race_id", "runners", leader.alias("leader_score"), rounded(F.col("margin"), 2).alias("margin"), rounded(F.col("confidence"), 3).alias("confidence"), rounded(F.col("u") * 100, 1).alias("uncertainty"), rounded(F.col("u"), 3).alias("pressure"), level.alias("level"))


def selections(scored: DataFrame) -> DataFrame:
    """Recommended runners of every race: (race_id, mode, horses)."""
    u = uncertainty(scored)
    single = (F.col("level") == "low") & (F.col("confidence") >= 0.75) & (F.col("margin") >= 8)
    compact = F.col("level").isin("low", "medium") & (F.col("confidence") >= 0.6) & (F.col("margin") >= 3)
    spread = F.greatest(F.lit(3), F.ceil(F.col("runners") * F.greatest(F.lit(0.35), F.col("pressure"))))
    mode = F.when(single, "single").when(compact, "compact").otherwise("spread")
    k = F.when(single, 1).when(compact, F.when(F.col("pressure") < 0.4, 2).otherwise(3)).otherwise(spread)
    order = Window.partitionBy("race_id").orderBy(F.col("score").desc(), "horse_number")
    ranked = scored.withColumn("place", F.row_number().over(order)).join(u.select("race_id", mode.alias("mode"), F.least(k, F.col("runners")).alias("k")), "race_id")
    return ranked.where("place <= k").groupBy("race_id", "mode").agg(F.array_sort(F.collect_list("horse_number")).alias("horses"))
