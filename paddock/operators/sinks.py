"""Write semantics over plain tables: what a target holds after a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last version of each key wins; at equal versions the batch."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def insert_only(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch with keys that the target lacks, the first of each key."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """New rows by full natural key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def newest_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest candidate captured before the start, one a key."""
    return candidates.where("captured_at < starts_at").groupBy(*keys).agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in keys]), "captured_at").alias("c")).select(*keys, "c.*")


def content_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def reconcile(children: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Children of active keys; an empty active set is refused."""
    if active.isEmpty():
        raise ValueError("the authoritative set is empty; nothing may be deleted")
    return children.join(active.select(*keys).distinct(), keys, "left_semi")


def without_composite(rows: DataFrame, name: str = "karma") -> DataFrame:
    return rows.where(F.coalesce(F.lower(F.trim("city")) != name, F.lit(True)))


def retain(rows: DataFrame, archived: DataFrame, keys: list[str], cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff, and older ones that aren't archived yet."""
    return rows.where(F.col("race_date") >= cutoff).unionByName(rows.where(F.col("race_date") < cutoff).join(archived.select(*keys).distinct(), keys, "left_anti"))


def archive_documents(races: DataFrame, runners: DataFrame, started_before: Column) -> DataFrame:
    """One document a started race with its runners in order."""
    docs = runners.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("horse_number", "horse_id", "finish_position"))).alias("runners"))
    return races.where(F.col("starts_at") < started_before).join(docs, "race_id").select("race_id", F.to_json(F.struct("runners")).alias("document"), F.size("runners").cast("long").alias("n_runners"))
