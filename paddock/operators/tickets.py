"""Six-race windows, ticket optimisation as a backtest, settlement and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import lower_tr
from ..functions.numeric import finite

CARD = ["race_date", "city"]
PROFILES = {"economic": 0.45, "balanced": 0.80, "maximum": 1.0}


def windows(races: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(race_date, city, sixfold_number, place, race_number, race_id): the six races of each window of cards with six or more.

    markers(race_date, city, sixfold_number, start_race) are official starts; without one, number 1 takes the
    first six races and number 2 the last six of a card with more than six.
    """
    order = Window.partitionBy(*CARD).orderBy("race_number")
    placed = races.withColumn("position", F.row_number().over(order)).withColumn("races", F.count("*").over(Window.partitionBy(*CARD))).where("races >= 6")
    cards = placed.groupBy(*CARD).agg(F.first("races").alias("races")).withColumn("sixfold_number", F.explode(F.array(F.lit(1), F.lit(2))))
    fallback = F.when(F.col("sixfold_number") == 1, 1).when(F.col("races") > 6, F.col("races") - 5)
    if markers is not None:
        known = markers.join(placed.select(*CARD, F.col("race_number").alias("start_race"), F.col("position").alias("official"), F.col("races").alias("n")), [*CARD, "start_race"])
        known = known.where("official + 5 <= n").groupBy(*CARD, "sixfold_number").agg(F.max("official").alias("official"))
        cards = cards.join(known, [*CARD, "sixfold_number"], "left")
        fallback = F.coalesce(F.col("official"), fallback)
    starts = cards.withColumn("start", fallback).where("start is not null").select(*CARD, "sixfold_number", "start", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("place"))
    starts = starts.withColumn("position", F.col("start") + F.col("place") - 1)
    return starts.join(placed, [*CARD, "position"]).select(*CARD, F.col("sixfold_number").cast("long").alias("sixfold_number"), F.col("place").cast("long").alias("place"), "race_number", "race_id")


def leg_choices(legs: DataFrame) -> DataFrame:
    """(card, leg, k, p): the chance that the leg's winner is among its k best runners.

    legs(card, leg, horse_number, score, confidence).
    """
    leg = Window.partitionBy("card", "leg")
    weight = F.exp((F.col("score") - F.max("score").over(leg)) / 14) * (0.6 + 0.4 * F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("confidence"))))
    order = leg.orderBy(F.col("score").desc(), "horse_number")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = legs.withColumn("w", weight).withColumn("share", F.col("w") / F.sum("w").over(leg))
    return shared.select("card", "leg", F.row_number().over(order).alias("k"), F.sum("share").over(upto).alias("p"))


def budget_rows(cards: DataFrame, budgets: tuple[float, ...], multiplier: int = 1) -> DataFrame:
    """cards(card, unit): each with every budget and profile and the combinations it can pay."""
    plans = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("budget"), F.lit(n).alias("profile"), F.lit(x).alias("fraction")) for b in budgets for n, x in PROFILES.items()])).alias("f")
    price = F.col("unit") * multiplier
    rows = cards.select("card", price.alias("unit"), plans).select("card", "unit", "f.*")
    pay = F.least(F.col("budget"), F.greatest(F.col("unit"), F.col("budget") * F.col("fraction")))
    return rows.withColumn("most", F.floor(pay / F.col("unit") + 1e-9))


def optimise(legs: DataFrame, cards: DataFrame, budgets: tuple[float, ...]) -> DataFrame:
    """Best selection sizes by card, budget and profile: (card, budget, profile, survival, combinations, cost, sizes).

    legs as in `leg_choices`, cards(card, unit). Meet in the middle: three legs on each side, no more than
    n ** 3 rows a half; the affordable partner of a left half is looked up with a running maximum over the
    right halves in order of their combinations. Halves no larger than the budget allows stay, so no
    product of all six legs arises. The choices of a card are one row of six short arrays, so the legs are
    read once and halves grow by explosion, not by joins.
    """
    by_leg = leg_choices(legs).groupBy("card", "leg").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("c"))
    six = by_leg.groupBy("card").agg(*[F.max(F.when(F.col("leg") == i, F.col("c"))).alias(f"l{i}") for i in range(1, 7)])
    for i in range(1, 7):
        six = six.where(F.col(f"l{i}").isNotNull())
    plans = budget_rows(cards, budgets)
    known = six.join(plans.groupBy("card").agg(F.max("most").alias("top")), "card")

    def half(at: int) -> DataFrame:
        out = known.select("card", "top", *[f"l{at + i}" for i in range(3)], F.lit(1).alias("q"), F.lit(1.0).alias("s"))
        for i in range(3):
            out = out.withColumn("e", F.explode(f"l{at + i}")).withColumn(f"k{i}", F.col("e.k")).withColumn("q", F.col("q") * F.col("e.k")).withColumn("s", F.col("s") * F.col("e.p")).where("q <= top")
        # of equal sizes only the likeliest can be best
        return out.groupBy("card", "q").agg(F.max(F.struct("s", F.array("k0", "k1", "k2").alias("ks"))).alias("b")).select("card", F.col("q").cast("long").alias("q"), "b.*")

    plan = ["card", "budget", "profile"]
    left = half(1).join(plans, "card").where("q <= most").select(*plan, "unit", F.floor(F.col("most") / F.col("q")).alias("key"), F.lit(1).alias("side"), "q", "s", "ks")
    right = half(4).join(plans, "card").where("q <= most").select(*plan, "unit", F.col("q").alias("key"), F.lit(0).alias("side"), "q", "s", "ks")
    upto = Window.partitionBy(*plan).orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.when(F.col("side") == 0, F.struct("s", "q", "ks"))).over(upto)
    both = left.unionByName(right).withColumn("r", best).where("side = 1 and r is not null")
    pick = F.max(F.struct(F.round(F.col("s") * F.col("r.s"), 12).alias("survival"), (F.col("q") * F.col("r.q")).alias("combinations"), F.concat("ks", "r.ks").alias("sizes")))
    found = both.groupBy(*plan).agg(pick.alias("b"), F.first("unit").alias("unit"))
    return found.select(*plan, "b.survival", "b.combinations", (F.col("b.combinations") * F.col("unit")).alias("cost"), "b.sizes")


def unit_price(city: Column, foreign: Column) -> Column:
    """1 abroad and in three cities (fixed values), else 1.25."""
    return F.when(F.coalesce(foreign, F.lit(False)) | lower_tr(F.trim(city)).isin("diyarbakır", "elazığ", "şanlıurfa"), 1.0).otherwise(1.25)


def ticket_cost(sizes: Column, unit: Column, times: int = 1) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x) * unit * times


def budget_band(budget: Column) -> Column:
    return F.when(budget <= 100, "micro").when(budget <= 300, "small").when(budget <= 1000, "medium").when(budget <= 3000, "large").otherwise("extended")


def settle(chosen: DataFrame, winners: DataFrame) -> DataFrame:
    """chosen(card, leg, race_id, horses), winners(race_id, horse_number): hit legs of cards of which all six legs have a winner."""
    won = winners.groupBy("race_id").agg(F.collect_set("horse_number").alias("winners"))
    legs = chosen.join(won, "race_id", "left").withColumn("hit", F.coalesce(F.arrays_overlap("horses", "winners"), F.lit(False)))
    by = legs.groupBy("card").agg(F.count("*").alias("legs"), F.count("winners").alias("resolved"), F.count_if("hit").alias("hits"))
    return by.where("legs = 6 and resolved = 6").select("card", "hits", (F.col("hits") == 6).alias("six_of_six"), (F.col("hits") >= 5).alias("five_of_six"))


def mode_metrics(selected: DataFrame, winners: DataFrame) -> DataFrame:
    """Per selection mode: races, covered, hit rate and mean selection size; any winner of a dead heat covers."""
    won = winners.groupBy("race_id").agg(F.collect_set("horse_number").alias("winners"))
    rows = selected.join(won, "race_id").withColumn("covered", F.arrays_overlap("horses", "winners"))
    return rows.groupBy("mode").agg(F.count("*").alias("races"), F.count_if("covered").alias("covered"), F.sum(F.size("horses")).alias("sizes")).select(
        "mode", "races", "covered", (F.col("covered") / F.col("races")).alias("hit_rate"), (F.col("sizes") / F.col("races")).alias("mean_size")
    )


def invalid_inputs(inputs: DataFrame, legs: DataFrame) -> DataFrame:
    """(card, code) of ticket inputs that can't be optimised: inputs(card, legs, budget, multiplier, unit), legs(card, leg, horse_number) with the runners there are."""
    by = legs.where("horse_number is not null").groupBy("card").agg(F.countDistinct("leg").alias("filled"))
    rows = inputs.join(by, "card", "left")
    whole = (F.col("multiplier") >= 1) & (F.col("multiplier") == F.floor("multiplier"))
    budget = finite(F.col("budget"))
    codes = F.array_compact(F.array(
        F.when(F.col("legs") != 6, "SIX_FOLD_REQUIRES_6_LEGS"), F.when(~F.coalesce(budget > 0, F.lit(False)), "INVALID_COUPON_BUDGET"), F.when(F.coalesce("filled", F.lit(0)) < F.col("legs"), "EMPTY_COUPON_LEG"),
        F.when(~F.coalesce(whole, F.lit(False)), "INVALID_MULTIPLIER"), F.when((budget > 0) & (budget < F.col("unit") * F.col("multiplier")), "BUDGET_BELOW_MINIMUM"),
    ))
    return rows.select("card", F.explode(codes).alias("code"))
