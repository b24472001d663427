"""Extracted JSON documents of several kinds to typed rows; what can't be read is kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def schema(fields: str) -> str:
    return f"rows array<struct<{', '.join(f'{f}:string' for f in fields.split())}>>, {CORRUPT} string"


# The fields of each kind of document.
KINDS = {
    "form": schema("raceDate city distanceMeters track finishPosition weight jockey odds hp"),
    "field": schema("horseName horseNumber raceDate city distanceMeters track finishPosition"),
    "result": f"city string, raceDate string, races array<struct<raceNumber:string, runners:array<struct<horseNumber:string, horseName:string, finishPosition:string>>>>, {CORRUPT} string",
}


def text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """A number with a comma or a point; NULL for anything else, infinities included."""
    value = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$") & (F.abs(value) < float("inf")), value)


def whole(c: Column) -> Column:
    """A number cut to a whole one."""
    return number(c).cast("long")


def day(c: Column) -> Column:
    """yyyy-MM-dd or dd.MM.yyyy; NULL for other texts and for days that don't exist."""
    c = F.trim(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")).when(c.rlike(r"^\d{2}[.]\d{2}[.]\d{4}$"), F.try_to_date(c, "dd.MM.yyyy"))


def parsed(documents: DataFrame, kind: str) -> DataFrame:
    """documents(..., kind, document) of one kind with the struct `_d` read by its schema."""
    return documents.where(F.col("kind") == kind).withColumn("_d", F.from_json("document", KINDS[kind], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))


def unreadable() -> Column:
    return F.col("document").isNull() | F.col(f"_d.{CORRUPT}").isNotNull()


def readable(rows: str) -> Column:
    """An array of `_d`, empty where the document can't be read.

    Not a filter: Spark moves one below the projection, so that each document would be read, and written where it is derived, twice.
    """
    return F.slice(rows, F.lit(1), F.when(F.col(f"_d.{CORRUPT}").isNull(), F.size(rows)).otherwise(0))


def corrupt(documents: DataFrame) -> DataFrame:
    """Documents that can't be read by the schema of their kind, and those of unknown kinds, with `reason`; their other columns stay."""
    bad = [parsed(documents, k).where(unreadable()).drop("_d").withColumn("reason", F.lit("UNREADABLE")) for k in KINDS]
    out = documents.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).withColumn("reason", F.lit("UNKNOWN_KIND"))
    for rows in bad:
        out = out.unionByName(rows)
    return out


def form_rows(documents: DataFrame) -> DataFrame:
    """documents(doc_key, kind, document) -> (doc_key, place, race_date, city, distance_meters, track, finish_position, weight, jockey, odds, hp); places from 0."""
    each = parsed(documents, "form").select("doc_key", F.posexplode(readable("_d.rows")).alias("place", "r"))
    return each.select(
        "doc_key", F.col("place").cast("long").alias("place"), day(F.col("r.raceDate")).alias("race_date"), text(F.col("r.city")).alias("city"), whole(F.col("r.distanceMeters")).alias("distance_meters"), text(F.col("r.track")).alias("track"),
        whole(F.col("r.finishPosition")).alias("finish_position"), number(F.col("r.weight")).alias("weight"), text(F.col("r.jockey")).alias("jockey"), number(F.col("r.odds")).alias("odds"), whole(F.col("r.hp")).alias("hp"),
    )


def field_rows(documents: DataFrame) -> DataFrame:
    """documents(doc_key, kind, document) -> (doc_key, place, horse_name, horse_number, race_date, city, distance_meters, track, finish_position)."""
    each = parsed(documents, "field").select("doc_key", F.posexplode(readable("_d.rows")).alias("place", "r"))
    return each.select(
        "doc_key", F.col("place").cast("long").alias("place"), text(F.col("r.horseName")).alias("horse_name"), whole(F.col("r.horseNumber")).alias("horse_number"), day(F.col("r.raceDate")).alias("race_date"), text(F.col("r.city")).alias("city"),
        whole(F.col("r.distanceMeters")).alias("distance_meters"), text(F.col("r.track")).alias("track"), whole(F.col("r.finishPosition")).alias("finish_position"),
    )


def result_document_rows(documents: DataFrame) -> DataFrame:
    """documents(race_date, city, kind, document) -> (race_date, city, relabelled, race_number, horse_number, name, finish_position).

    The meeting that was asked for wins over the document's own; `relabelled` says that the two differ.
    """
    read = parsed(documents, "result").where(~unreadable())
    said = (F.coalesce(text(F.col("_d.city")), F.col("city")) != F.col("city")) | (F.coalesce(day(F.col("_d.raceDate")), F.col("race_date")) != F.col("race_date"))
    races = read.select("race_date", "city", said.alias("relabelled"), F.explode("_d.races").alias("r"))
    runners = races.select("race_date", "city", "relabelled", whole(F.col("r.raceNumber")).alias("race_number"), F.explode("r.runners").alias("h"))
    return runners.select("race_date", "city", "relabelled", "race_number", whole(F.col("h.horseNumber")).alias("horse_number"), text(F.col("h.horseName")).alias("name"), whole(F.col("h.finishPosition")).alias("finish_position"))


def typed_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code) of typed rows: what a row of its kind must have and lacks; columns that a kind doesn't have aren't checked."""
    has = lambda c: c in rows.columns
    positive = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    checks = [
        (has("race_number"), lambda: positive("race_number"), "INVALID_RACE_NUMBER"), (has("horse_number"), lambda: positive("horse_number"), "INVALID_RUNNER_NUMBER"),
        (has("name"), lambda: F.col("name").isNull(), "EMPTY_RUNNER_NAME"), (has("horse_name"), lambda: F.col("horse_name").isNull(), "EMPTY_RUNNER_NAME"), (has("race_date"), lambda: F.col("race_date").isNull(), "INVALID_DATE"),
        (has("finish_position"), lambda: ~F.coalesce(F.col("finish_position") >= 0, F.lit(False)), "INVALID_POSITION"), (has("relabelled"), lambda: F.col("relabelled"), "MEETING_RELABELLED"),
    ]
    codes = F.array_compact(F.array(*[F.when(check(), code) for there, check, code in checks if there]))
    return rows.select(*keys, F.explode(codes).alias("code"))
