"""Expert consensus, source and category priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, rounded
from ..functions.signals import LEAST_SAMPLES, POSITIVE, flag, is_positive, source_weight, strength

RUNNER = ["race_id", "horse_number"]


def first_per_source(picks: DataFrame) -> DataFrame:
    """The first pick of a source for a runner, by rank and then order of arrival."""
    order = Window.partitionBy(*RUNNER, "source_key").orderBy("source_rank", "k")
    return picks.where("source_key is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def settled_picks(picks: DataFrame, labelled: DataFrame) -> DataFrame:
    """First picks with the finish of their runner, one row each; picks that have a `finish_position` column are such rows already."""
    return picks if "finish_position" in picks.columns else first_per_source(picks).join(labelled.select(*RUNNER, "finish_position"), RUNNER)


def weighted_picks(picks: DataFrame, sources: DataFrame, by_source: DataFrame | None = None, by_category: DataFrame | None = None) -> DataFrame:
    """Picks of enabled sources with their effective weight.

    The base weight is calibrated by the multipliers that a source has earned, in all and in the pick's
    category: by_source(source_key, multiplier), by_category(source_key, category, multiplier); 1 where there is none.
    All of it is one row a source, met in one join; picks stay where they are: few sources make a skewed exchange.
    """
    first = picks if "finish_position" in picks.columns else first_per_source(picks)
    known, base = sources.where("enabled"), F.col("base_weight")
    if by_source is not None:
        known = known.join(F.broadcast(by_source.select("source_key", F.col("multiplier").alias("_general"))), "source_key", "left")
        base = base * F.coalesce("_general", F.lit(1.0))
    if by_category is not None:
        special = by_category.groupBy("source_key").agg(*[F.max(F.when(F.col("category") == c, F.col("multiplier"))).alias(f"_{c}") for c in POSITIVE])
        known = known.join(F.broadcast(special), "source_key", "left")
        base = base * F.coalesce(*[F.when(flag(F.col(f"is_{c}")), F.coalesce(f"_{c}", F.lit(1.0))) for c in POSITIVE], F.lit(1.0))
    rows = first.join(F.broadcast(known), "source_key")
    return rows.withColumn("w", source_weight(base, F.col("confidence"), F.col("source_rank")))


def consensus(picks: DataFrame, sources: DataFrame, by_source: DataFrame | None = None, by_category: DataFrame | None = None) -> DataFrame:
    """Counts and weights of every flag, weighted support and opposition, score and support confidence of every runner with a pick."""
    w, avoid = F.col("w"), flag(F.col("is_avoid"))
    counts = [F.count_if(flag(F.col(f"is_{c}"))).alias(f"{c}_count") for c in (*POSITIVE, "avoid")]
    sums = weighted_picks(picks, sources, by_source, by_category).groupBy(*RUNNER).agg(
        F.count("*").alias("source_count"), *counts, *[F.sum(F.when(flag(F.col(f"is_{c}")), w).otherwise(0.0)).alias(f"weighted_{c}") for c in (*POSITIVE, "avoid")], F.sum("w").alias("weight_sum"),
        F.sum(F.when(avoid, 0.0).otherwise(w * strength())).alias("support"), F.sum(F.when(avoid, 0.9 * w).otherwise(0.0)).alias("opposition"),
    )
    score = clamp(50 + 50 * (F.col("support") - F.col("opposition")) / F.col("weight_sum"), 0.0, 100.0)
    labels = F.array_compact(F.array(*[F.when(F.col(f"{c}_count") > 0, c) for c in (*POSITIVE, "avoid")]))
    return sums.select(
        *RUNNER, "source_count", *[f"{c}_count" for c in (*POSITIVE, "avoid")], *[rounded(F.col(f"weighted_{c}"), 3).alias(f"weighted_{c}") for c in (*POSITIVE, "avoid")], rounded(F.col("support"), 3).alias("support"), rounded(F.col("opposition"), 3).alias("opposition"),
        rounded(score, 0).alias("expert_score"), rounded(1 - F.exp(-F.col("source_count") / 2.5), 2).alias("expert_confidence"), F.array_join(labels, ",").alias("labels"),
    )


def counted(rows) -> dict:
    """Samples, wins and top-three finishes of the rows for which a condition holds."""
    at = F.col("finish_position")
    return {"samples": F.count_if(rows), "wins": F.count_if(rows & (at == 1)), "top3": F.count_if(rows & at.between(1, 3))}


def rates(alias: str = "") -> list:
    """Samples, wins and top-three finishes; 0 (not placed) counts as a sample."""
    return [F.count("*").alias(f"{alias}samples"), F.count_if(F.col("finish_position") == 1).alias(f"{alias}wins"), F.count_if(F.col("finish_position").between(1, 3)).alias(f"{alias}top3")]


def global_rates(labelled: DataFrame) -> DataFrame:
    """One row: win and top-three rate of all labelled runners."""
    one = labelled.where("finish_position is not null").agg(*rates())
    return one.select("samples", F.coalesce(F.try_divide("wins", "samples"), F.lit(0.0)).alias("win_rate"), F.coalesce(F.try_divide("top3", "samples"), F.lit(0.0)).alias("top3_rate"))


def ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)


def source_priors(picks: DataFrame, labelled: DataFrame) -> DataFrame:
    """Hit rates of positive picks by source and the multiplier they earn after 30 samples."""
    hits = settled_picks(picks, labelled).where(is_positive()).where("finish_position is not null")
    base = global_rates(labelled).select(F.col("win_rate").alias("base_win"), F.col("top3_rate").alias("base_top3"))
    by = hits.groupBy("source_key").agg(*rates()).crossJoin(F.broadcast(base))  # one row
    by = by.withColumn("win_rate", F.col("wins") / F.col("samples")).withColumn("top3_rate", F.col("top3") / F.col("samples"))
    quality = 0.65 * ratio("win_rate", "base_win") + 0.35 * ratio("top3_rate", "base_top3") - 1
    earned = 1 + clamp(quality * 0.15 * F.least((F.col("samples") - 29) / 121, F.lit(1.0)), -0.15, 0.15)
    return by.select("source_key", "samples", "wins", "top3", F.when(F.col("samples") < 30, 1.0).otherwise(rounded(earned, 4)).alias("multiplier"))


def category_priors(picks: DataFrame, labelled: DataFrame) -> DataFrame:
    """Hit rates by source and category against the category over all sources; placed runners only."""
    placed = settled_picks(picks, labelled).where("finish_position >= 1")
    sums = placed.groupBy("source_key").agg(*[c.alias(f"{k}_{n}") for k in POSITIVE for n, c in counted(flag(F.col(f"is_{k}"))).items()])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), *[F.col(f"{k}_{n}").alias(n) for n in ("samples", "wins", "top3")]) for k in POSITIVE])).alias("c")
    by = sums.select("source_key", kinds).select("source_key", "c.*").where("samples > 0")
    whole = Window.partitionBy("category")
    total = {c: F.sum(c).over(whole) for c in ("samples", "wins", "top3")}
    by = by.withColumns({"win_rate": F.col("wins") / F.col("samples"), "top3_rate": F.col("top3") / F.col("samples"), "base_win": total["wins"] / total["samples"], "base_top3": total["top3"] / total["samples"]})
    least = F.element_at(F.create_map(*[F.lit(x) for c, n in LEAST_SAMPLES.items() for x in (c, n)]), F.col("category"))
    quality = 0.65 * ratio("win_rate", "base_win") + 0.35 * ratio("top3_rate", "base_top3") - 1
    earned = 1 + clamp(quality * 0.12 * clamp((F.col("samples") - least + 1) / 100, 0.0, 1.0), -0.12, 0.12)
    return by.select("source_key", "category", "samples", "wins", "top3", F.when(F.col("samples") < least, 1.0).otherwise(rounded(earned, 4)).alias("multiplier"))
