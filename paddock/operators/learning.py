"""Context priors, learned adjustment, ranking evaluation with its gate, strict labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import distance_band
from ..functions.numeric import clamp, rounded
from .expert import global_rates, rates

CONTEXT = ["city", "track_key", "band"]
# Samples needed and for full reliability, share of each kind of entity.
ENTITIES = {"horse": (6, 20, 0.5), "jockey": (20, 80, 0.3), "pair": (5, 15, 0.2)}


def with_context(runners: DataFrame, races: DataFrame) -> DataFrame:
    """Runners with the context of their race; an unknown track is a value of its own."""
    context = races.select("race_id", "city", F.coalesce("track", F.lit("unknown")).alias("track_key"), distance_band(F.col("distance_meters")).alias("band"))
    return runners.join(context, "race_id")


def entity_keys() -> dict[str, Column]:
    horse, jockey = F.col("horse_id").cast("string"), F.col("jockey_id").cast("string")
    return {"horse": horse, "jockey": jockey, "pair": F.when(jockey.isNotNull(), F.concat_ws("|", horse, jockey))}


def context_priors(labelled: DataFrame) -> DataFrame:
    """Samples, wins, top three and mean place by entity and context; the three kinds in one pass over the rows."""
    entities = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), key.alias("entity_key")) for k, key in entity_keys().items()])).alias("e")
    rows = labelled.where("finish_position is not null").select("finish_position", *CONTEXT, entities).select("*", "e.*").where("entity_key is not null")
    placed = F.when(F.col("finish_position") > 0, F.col("finish_position"))
    return rows.groupBy("entity_type", "entity_key", *CONTEXT).agg(*rates(), rounded(F.avg(placed), 4).alias("avg_finish"))


def learned_signal(samples: Column, wins: Column, top3: Column, least: int, full: int) -> Column:
    win, top = wins / samples, top3 / samples
    quality = 0.6 * F.when(F.col("win_rate") > 0, win / F.col("win_rate")).otherwise(1.0) + 0.4 * F.when(F.col("top3_rate") > 0, top / F.col("top3_rate")).otherwise(1.0)
    return F.when(samples >= least, clamp((quality - 1) * 20, -12.0, 12.0) * clamp((samples - least + 1) / float(full - least + 1), 0.0, 1.0))


def adjustment(rows: DataFrame, priors: DataFrame, rates_row: DataFrame, scale: float = 1.0) -> DataFrame:
    """`signal` and `adjustment` of every runner from its horse, jockey and pair priors, shares renormalised over those present.

    All three lookups are one join on (kind, key, context), where the priors lie as they were aggregated;
    missing jockeys have no row in it.
    """
    entities = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), key.alias("entity_key")) for k, key in entity_keys().items()])).alias("e")
    asked = rows.select("race_id", "horse_number", *CONTEXT, entities).select("*", "e.*").where("entity_key is not null").drop("e")
    found = asked.join(priors.select("entity_type", "entity_key", *CONTEXT, "samples", "wins", "top3"), ["entity_type", "entity_key", *CONTEXT])
    found = found.crossJoin(F.broadcast(rates_row.select("win_rate", "top3_rate")))  # one row
    signals = [F.max(F.when(F.col("entity_type") == k, learned_signal(F.col("samples"), F.col("wins"), F.col("top3"), a, b))).alias(f"_{k}") for k, (a, b, _) in ENTITIES.items()]
    out = rows.join(found.groupBy("race_id", "horse_number").agg(*signals), ["race_id", "horse_number"], "left")
    share = sum((F.when(F.col(f"_{k}").isNotNull(), x).otherwise(0.0) for k, (_, _, x) in ENTITIES.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"_{k}") * x, F.lit(0.0)) for k, (_, _, x) in ENTITIES.items()), F.lit(0.0))
    out = out.withColumn("signal", F.when(share > 0, total / share)).drop(*[f"_{k}" for k in ENTITIES])
    return out.withColumn("adjustment", scaled(F.col("signal"), F.lit(scale)))


def own_adjustment(rows: DataFrame, rates_row: DataFrame, scale: float = 1.0) -> DataFrame:
    """`adjustment` of rows by the priors of these same rows: (race_id, horse_number, finish_position, signal, adjustment).

    Priors are sums over the rows that share horse, pair or jockey and context, so they are windows over narrow rows: horse
    and pair lie together and take one exchange and one sort, jockeys another; a missing jockey meets only its own race.
    """
    seen = F.col("finish_position").isNotNull()
    counted = lambda by: (F.count_if(seen).over(by), F.count_if(F.col("finish_position") == 1).over(by), F.count_if(F.col("finish_position").between(1, 3)).over(by))
    whole = rows.select("race_id", "horse_number", "horse_id", "jockey_id", *CONTEXT, "finish_position").crossJoin(F.broadcast(rates_row.select("win_rate", "top3_rate")))  # one row
    earned = lambda kind, by: learned_signal(*counted(by), *ENTITIES[kind][:2])
    horse, pair = Window.partitionBy("horse_id", *CONTEXT), Window.partitionBy("horse_id", *CONTEXT, "jockey_id")
    jockey = Window.partitionBy("jockey_id", *CONTEXT, F.when(F.col("jockey_id").isNull(), F.col("race_id")))
    some = lambda x, *keys: F.when(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0, x)
    out = whole.repartition("horse_id", *CONTEXT).withColumn("_pair", some(earned("pair", pair), "horse_id", "jockey_id", *CONTEXT)).withColumn("_horse", some(earned("horse", horse), "horse_id", *CONTEXT))
    out = out.drop("horse_id").withColumn("_jockey", some(earned("jockey", jockey), "jockey_id", *CONTEXT))
    share = sum((F.when(F.col(f"_{k}").isNotNull(), x).otherwise(0.0) for k, (_, _, x) in ENTITIES.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"_{k}") * x, F.lit(0.0)) for k, (_, _, x) in ENTITIES.items()), F.lit(0.0))
    out = out.withColumn("signal", F.when(share > 0, total / share))
    return out.select("race_id", "horse_number", "finish_position", "signal", scaled(F.col("signal"), F.lit(scale)).alias("adjustment"))


def scaled(signal: Column, scale: Column) -> Column:
    """The adjustment that a signal gives at a scale; without a signal none."""
    return F.coalesce(rounded(clamp(signal * scale, -5.0, 5.0), 2), F.lit(0.0))


def winner_ranks(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Per race the best winner's competition rank for each score; races with a placed runner without a score are out."""
    placed = rows.where("finish_position >= 1")
    whole = placed
    for s in scores:
        by = Window.partitionBy("race_id").orderBy(F.col(s).desc())
        whole = whole.withColumn(f"rank_{s}", F.rank().over(by))
    lacks = F.max(sum((F.col(s).isNull().cast("int") for s in scores), F.lit(0)))
    win = F.col("finish_position") == 1
    by_race = whole.groupBy("race_id").agg(lacks.alias("lacks"), *[F.min(F.when(win, F.col(f"rank_{s}"))).alias(f"rank_{s}") for s in scores])
    return by_race.where(F.col("lacks") == 0).where(F.col(f"rank_{scores[0]}").isNotNull()).drop("lacks")


def ranking_metrics(ranks: DataFrame, scores: list[str]) -> DataFrame:
    """One row: races, top-1, top-3 and top-5 rate, mean rank and mean reciprocal rank of each score."""
    each = []
    for s in scores:
        r = F.col(f"rank_{s}")
        each += [rounded(F.avg((r <= k).cast("double")), 6).alias(f"{s}_top{k}") for k in (1, 3, 5)]
        each += [rounded(F.avg(r.cast("double")), 6).alias(f"{s}_mean_rank"), rounded(F.avg(1.0 / r), 6).alias(f"{s}_mrr")]
    return ranks.agg(F.count("*").alias("races"), *each)


def gate(metrics: DataFrame, base: str, shadow: str) -> DataFrame:
    """Scale of the learned adjustment and its status from a metrics row."""
    top1, top3 = F.col(f"{shadow}_top1") - F.col(f"{base}_top1"), F.col(f"{shadow}_top3") - F.col(f"{base}_top3")
    gain = F.col(f"{base}_mean_rank") - F.col(f"{shadow}_mean_rank")
    status = F.when(F.col("races") < 100, "insufficient-data").when((top1 <= -0.02) & (gain <= -0.15), "learning-degraded").when((top3 <= -0.03) & (gain <= -0.10), "learning-reduced").otherwise("healthy")
    scale = F.when(status == "insufficient-data", 0.0).when(status == "learning-degraded", 0.25).when(status == "learning-reduced", 0.5).otherwise(1.0)
    return metrics.select("*", status.alias("status"), scale.alias("scale"))


def label_audit(frozen: DataFrame, official: DataFrame) -> DataFrame:
    """Per officially run race why its frozen set can or can't be labelled: all or nothing.

    frozen and official have (race_id, horse_number, name).
    """
    a = frozen.select("race_id", "horse_number", F.col("name").alias("own"))
    b = official.select("race_id", "horse_number", F.col("name").alias("theirs"))
    by = a.join(b, ["race_id", "horse_number"], "full").groupBy("race_id").agg(
        F.count("own").alias("frozen"), F.count("theirs").alias("official"), F.bool_and(F.coalesce(F.col("own") == F.col("theirs"), F.lit(False))).alias("same")
    )
    reason = F.when(F.col("frozen") == 0, "NO_FROZEN_SNAPSHOT").when(F.col("frozen") != F.col("official"), "RUNNER_COUNT_MISMATCH").when(~F.col("same"), "RUNNER_IDENTITY_MISMATCH").otherwise("LABELLED")
    return by.where("official > 0").select("race_id", F.col("frozen").alias("expected"), F.col("official").alias("found"), reason.alias("reason"))


def labels(frozen: DataFrame, official: DataFrame) -> DataFrame:
    """(race_id, horse_number, finish_position) of races whose sets agree completely."""
    good = label_audit(frozen, official).where("reason = 'LABELLED'").select("race_id")
    return official.join(good, "race_id", "left_semi").select("race_id", "horse_number", "finish_position")
