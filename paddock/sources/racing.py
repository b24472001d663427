"""Racing-shaped tables derived from the driver tables, all in whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import distance_band
from .stored import dealt, once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes])


def races(spark: SparkSession, d: str) -> DataFrame:
    """One row a race, stored once a session in buckets by race_id."""
    return once(spark, d, "races", ["nation", "customer", "orders"], lambda: race_rows(spark, d), by=None)


def runners(spark: SparkSession, d: str) -> DataFrame:
    """One row a runner, stored once a session in buckets by race_id: the windows over a race are worked out by that one job."""
    return once(spark, d, "runners", ["lineitem"], lambda: runner_rows(spark, d), by=None, sort=["race_id", "horse_number"], deal=False)


def race_rows(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("city")))  # 25 rows in any table
    customer = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city")
    orders = read(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    card = Window.partitionBy("race_date", "city").orderBy("race_id")
    return (
        orders.select(k.alias("race_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("race_date"), "city")
        .withColumn("race_number", F.row_number().over(card).cast("long"))
        .withColumn("starts_at", F.timestamp_seconds(F.unix_date("race_date").cast("long") * 86400 + (720 + 30 * F.col("race_number")) * 60))
        .withColumn("distance_meters", F.when(F.col("race_id") % 50 != 0, 1000 + 100 * (F.col("race_id") % 15)))
        .withColumn("track", F.element_at(F.array(F.lit("Kum"), F.lit("Cim"), F.lit("Sentetik")), (F.col("race_id") % 3 + 1).cast("int")))
    )


def runner_rows(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out by race once; numbers, sums and places are windows within the race, compiled, with no array of its field in any row."""
    li = read(spark, d, "lineitem")
    order, effort_first = Window.partitionBy("race_id"), F.coalesce("effort", F.lit(-1000))  # no effort comes first
    rows = dealt(li.select(
        F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity", "l_extendedprice",
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("scratched"),
    )).withColumn("price", F.floor("l_extendedprice"))
    effort = (F.col("horse_id") * 31 + F.col("l_suppkey") * 17 + F.col("line") * 101) % 97
    form = F.lpad(((F.col("horse_id") * 7919 + F.col("l_suppkey") * 104729) % 1000000).cast("string"), 6, "0")
    rows = rows.withColumn("effort", effort).withColumn("place", F.rank().over(Window.partitionBy("race_id", "scratched").orderBy(effort_first))).withColumn("total", F.sum("price").over(order))
    rows = rows.withColumn("horse_number", F.row_number().over(order.orderBy("horse_id", "l_suppkey", "line", "l_extendedprice")).cast("long"))
    return rows.select(
        "race_id", "horse_number", "horse_id",
        F.when(F.col("l_suppkey") % 20 != 0, F.col("l_suppkey")).alias("jockey_id"), F.when(F.col("line") != 7, F.expr("price * 10000 div total")).alias("agf_bp"),
        F.when((F.col("race_id") + F.col("horse_id")) % 11 != 0, 50 + F.floor("l_quantity")).alias("hp"), (50 + (F.col("l_suppkey") % 21) / 2.0).alias("weight"),
        F.when(F.col("horse_id") % 13 == 0, "").otherwise(form).alias("recent_form_raw"), "scratched",
        F.when(F.col("scratched"), 0).otherwise(F.col("place")).cast("long").alias("finish_position"), "line", "l_suppkey",
    )


def picks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(race_id, horse_number, source_key, source_rank, confidence, is_*), and further columns of the runner."""
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("k")
    each = runners(spark, d).select("race_id", "horse_number", "horse_id", "l_suppkey", "line", *more, k)
    each = each.withColumn("m", (F.col("horse_id") * 13 + F.col("l_suppkey") * 7 + F.col("k") * 5) % 16).where("m <= 8")
    flags = {"banko": (0,), "favorite": (0, 1, 2), "strong": (2, 3), "star": (4,), "rival": (5, 6), "surprise": (7,), "avoid": (8,)}
    return each.select(
        "race_id", "horse_number", F.concat(F.lit("src"), ((F.col("l_suppkey") + F.col("k") * 7) % 9).cast("string")).alias("source_key"),
        (1 + (F.col("line") + F.col("k")) % 5).alias("source_rank"), (((F.col("horse_id") + F.col("k")) % 5) / 4.0).alias("confidence"), "k",
        *[F.col("m").isin(*ms).alias(f"is_{c}") for c, ms in flags.items()], *more,
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.range(9).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_key"), (0.5 + 0.1 * F.col("id")).alias("base_weight"), (F.col("id") != 8).alias("enabled"))


def market_points(spark: SparkSession, d: str) -> DataFrame:
    """(race_date, city, race_number, horse_number, captured_at, agf, starts_at), agf in hundredths of a percent."""
    kinds = Window.orderBy("event_type")
    events = read(spark, d, "events")
    numbers = events.select("event_type").distinct().withColumn("horse_number", F.row_number().over(kinds).cast("long"))  # one row a type
    return events.join(F.broadcast(numbers), "event_type").select(
        F.to_date("ts").alias("race_date"), F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("city"), (F.floor(F.col("user_id") / 5) + 1).cast("long").alias("race_number"),
        "horse_number", F.col("ts").alias("captured_at"), F.least("value", F.lit(100.0)).alias("agf_percent"), F.date_add(F.to_date("ts"), 1).cast("timestamp").alias("starts_at"),
    )


def share(k: Column) -> tuple[Column, Column]:
    """(captured_at, agf_percent) of a runner's share number k."""
    moved = F.col("agf_bp") + k * ((F.col("horse_id") * 7 + F.col("race_id") * 131) % 1201 - 600)
    at = F.timestamp_seconds(F.unix_seconds("starts_at") - 60 * (60 - 27 * k))
    return at.alias("captured_at"), (F.when(moved.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10000), moved))) / 100.0).alias("agf_percent")


def share_points(spark: SparkSession, d: str) -> DataFrame:
    """(race_id, horse_number, captured_at, starts_at, agf_percent): three shares of every runner in its last hour before the start."""
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("k")
    rows = runners(spark, d).where("agf_bp is not null").select("race_id", "horse_number", "horse_id", "agf_bp", k).join(races(spark, d).select("race_id", "starts_at"), "race_id")
    at, agf = share(F.col("k"))
    return rows.select("race_id", "horse_number", at, "starts_at", agf)


def share_columns() -> list[tuple[Column, Column]]:
    """The shares of `share_points` as columns of a runner's row with `starts_at`, NULL without a share."""
    return [share(F.lit(i).cast("long")) for i in range(3)]


def past_places(spark: SparkSession, d: str) -> DataFrame:
    """(race_id, horse_number, places): up to five finishes of the horse on the same track and band in earlier rows, newest first."""
    context = races(spark, d).select("race_id", "race_date", "track", distance_band(F.col("distance_meters")).alias("band"))
    before = Window.partitionBy("horse_id", "track", "band").orderBy("race_date", "race_id", "horse_number")
    rows = runners(spark, d).select("race_id", "horse_number", "horse_id", "finish_position").join(context, "race_id")
    earlier = [F.lag(F.col("finish_position").cast("int"), i).over(before).alias(f"p{i}") for i in range(1, 6)]
    rows = rows.select("race_id", "horse_number", (F.row_number().over(before) - 1).alias("n"), *earlier)
    return rows.select("race_id", "horse_number", F.slice(F.array("p1", "p2", "p3", "p4", "p5"), F.lit(1), F.least("n", F.lit(5))).alias("places"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """(race_id, horse_number, name, finish_position): official results, with races, runners and names that don't match."""
    r = runners(spark, d).where("race_id % 9 <> 0").where("(race_id + horse_id) % 19 <> 0")
    name = F.concat(F.lit("HORSE "), F.col("horse_id").cast("string"))
    return r.select("race_id", "horse_number", F.when((F.col("race_id") + F.col("horse_id")) % 17 == 0, F.concat(name, F.lit(" X"))).otherwise(name).alias("name"), "finish_position")


# The same tables in DuckDB.
SQL = """
races as (
  select race_id, race_date, city, race_number, race_date::timestamp + to_minutes((720 + 30 * race_number)::int) as starts_at,
    case when race_id % 50 <> 0 then 1000 + 100 * (race_id % 15) end as distance_meters, ['Kum', 'Cim', 'Sentetik'][(race_id % 3)::int + 1] as track
  from (select o_orderkey as race_id, date_trunc('month', o_orderdate)::date as race_date, n_name as city,
          row_number() over (partition by date_trunc('month', o_orderdate), n_name order by o_orderkey) as race_number
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)),
li as (select *, floor(l_extendedprice)::bigint as price, l_returnflag = 'R' and l_linenumber = 7 as scratched from lineitem),
runners as (
  select l_orderkey as race_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as horse_number, l_partkey as horse_id,
    case when l_suppkey % 20 <> 0 then l_suppkey end as jockey_id,
    case when l_linenumber <> 7 then price * 10000 // (sum(price) over (partition by l_orderkey))::bigint end as agf_bp,
    case when (l_orderkey + l_partkey) % 11 <> 0 then 50 + floor(l_quantity)::bigint end as hp, 50 + (l_suppkey % 21) / 2.0::double as weight,
    case when l_partkey % 13 = 0 then '' else lpad(((l_partkey * 7919 + l_suppkey * 104729) % 1000000)::varchar, 6, '0') end as recent_form_raw, scratched,
    case when scratched then 0 else rank() over (partition by l_orderkey, scratched order by (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 101) % 97) end::bigint as finish_position,
    l_linenumber::bigint as line, l_suppkey from li),
picks as (
  select race_id, horse_number, 'src' || ((l_suppkey + k * 7) % 9) as source_key, 1 + (line + k) % 5 as source_rank, ((horse_id + k) % 5) / 4.0::double as confidence, k,
    m = 0 as is_banko, m in (0, 1, 2) as is_favorite, m in (2, 3) as is_strong, m = 4 as is_star, m in (5, 6) as is_rival, m = 7 as is_surprise, m = 8 as is_avoid
  from (select *, (horse_id * 13 + l_suppkey * 7 + k * 5) % 16 as m from runners, (values (0), (1), (2)) t(k)) where m <= 8),
sources as (select 'src' || i as source_key, 0.5::double + 0.1::double * i as base_weight, i <> 8 as enabled from range(9) t(i)),
points as (
  select ts::date as race_date, 'C' || (user_id % 5) as city, user_id // 5 + 1 as race_number, horse_number, ts as captured_at,
    least(value, 100.0) as agf_percent, (ts::date + 1)::timestamp as starts_at
  from events join (select event_type, row_number() over (order by event_type) as horse_number from (select distinct event_type from events)) using (event_type)),
share_points as (
  select race_id, horse_number, starts_at - to_minutes((60 - 27 * k)::int) as captured_at, starts_at, greatest(0, least(10000, agf_bp + k * ((horse_id * 7 + race_id * 131) % 1201 - 600))) / 100.0::double as agf_percent
  from runners join races using (race_id), (values (0), (1), (2)) t(k) where agf_bp is not null),
past as (
  select race_id, horse_number, coalesce(list_reverse(list(finish_position) over (partition by horse_id, track, case when distance_meters < 1300 then 1 when distance_meters <= 1700 then 2 else 3 end
    order by race_date, race_id, horse_number rows between 5 preceding and 1 preceding)), []) as places
  from runners join races using (race_id)),
results as (
  select race_id, horse_number, 'HORSE ' || horse_id || case when (race_id + horse_id) % 17 = 0 then ' X' else '' end as name, finish_position
  from runners where race_id % 9 <> 0 and (race_id + horse_id) % 19 <> 0)
"""
