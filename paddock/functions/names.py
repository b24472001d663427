"""Turkish case mapping, name normalisers and keys of entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def upper_tr(x: Column) -> Column:
    return F.upper(F.translate(x, "iı", "İI"))


def lower_tr(x: Column) -> Column:
    return F.lower(F.translate(x, "Iİ", "ıi"))


def ascii_fold(x: Column) -> Column:
    """For ranking: lower case, Turkish letters to ASCII, other characters to single spaces."""
    return F.trim(F.regexp_replace(F.translate(lower_tr(x), "ığüşöç", "igusoc"), "[^a-z0-9]+", " "))


def city_fold(x: Column) -> Column:
    return F.regexp_replace(F.translate(upper_tr(x), "İIĞÜŞÖÇ", "IIGUSOC"), "[^A-Z0-9]", "")


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def without_number(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*\(\d+\)\s*$", "")


@F.pandas_udf(StringType())
def compatible(values: pd.Series) -> pd.Series:
    """Unicode's NFKC form; Spark has no function for it."""
    return values.str.normalize("NFKC")


def identity_name(x: Column) -> Column:
    """Compatibility forms are folded first; plain ASCII names don't leave the JVM's result."""
    return spaced(upper_tr(F.when(x.rlike(r"[^\x00-\x7F]"), compatible(x)).otherwise(x)))


def pick_name(x: Column) -> Column:
    return F.regexp_replace(upper_tr(without_number(x)), r"[\s\p{Punct}]+", "")


def field_name(x: Column) -> Column:
    return spaced(upper_tr(without_number(x)))


def label_name(x: Column) -> Column:
    return spaced(upper_tr(F.trim(x)))


def repair_name(x: Column) -> Column:
    return F.regexp_replace(upper_tr(without_number(x)), r"[\s\p{P}]+", "")


def display_name(x: Column) -> Column:
    return spaced(without_number(x))


def normalised(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """`column` in a Unicode normal form, computed once for each different value that has other than ASCII characters."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.str.normalize(form)

    other = df.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(column).distinct().withColumn("_normal", normal(column))
    return df.join(other, column, "left").withColumn(column, F.coalesce("_normal", column)).drop("_normal")


def entity_key(url: Column, name: Column, keys: str, prefix: str, fallback: str) -> Column:
    """`prefix:id` from a query parameter of the URL, else `fallback:name`; NULL without both."""
    found = F.regexp_extract(url, rf"(?i)[?&]({keys})=(\d+)(&|#|$)", 2)
    return F.when(found != "", F.concat(F.lit(f"{prefix}:"), found)).when(F.trim(name) != "", F.concat(F.lit(f"{fallback}:"), identity_name(name)))


def horse_key(url: Column, name: Column) -> Column:
    return entity_key(url, name, "QueryParameter_AtId|AtId", "tjk-horse", "horse-name")


def jockey_key(url: Column, name: Column) -> Column:
    return entity_key(url, name, "QueryParameter_JokeyId|JokeyId", "tjk-jockey", "jockey-name")


def distance_band(meters: Column) -> Column:
    return F.when(meters < 1300, "sprint").when(meters <= 1700, "middle").otherwise("route")


def local_instant(date: Column, clock: Column) -> Column:
    """UTC instant of a local day and HH:mm at the fixed offset of three hours; NULL for any other clock text."""
    return F.when(clock.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), clock, F.lit("+03:00")), F.lit("yyyy-MM-dd HH:mmXXX")))


def decimal_comma(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, r"-?\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")


def re_dated(instant: Column, day: Column) -> Column:
    """The time of `instant` on another day."""
    return F.to_timestamp(F.concat(day.cast("string"), F.lit(" "), F.date_format(instant, "HH:mm:ss.SSSSSS")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
