"""Flags, categories and weights of expert picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp

# Fixed values of the model.
POSITIVE = ("banko", "favorite", "strong", "star", "rival", "surprise")
STRENGTH = {"banko": 1.0, "favorite": 0.86, "strong": 0.74, "star": 0.68, "rival": 0.46, "surprise": 0.30}
LEAST_SAMPLES = {"banko": 15, "favorite": 25, "strong": 25, "star": 20, "rival": 30, "surprise": 30}


def flag(x: Column) -> Column:
    """true, 1 and "1" are set; everything else, NULL included, is not. A boolean is taken as it is, without a way over text."""
    return F.coalesce(F.when(F.typeof(x) == "boolean", x.try_cast("boolean")).otherwise(F.lower(x.cast("string")).isin("true", "1")), F.lit(False))


def is_positive() -> Column:
    out = F.lit(False)
    for c in POSITIVE:
        out = out | flag(F.col(f"is_{c}"))
    return out


def category() -> Column:
    return F.coalesce(*[F.when(flag(F.col(f"is_{c}")), c) for c in POSITIVE])


def strength() -> Column:
    return F.coalesce(*[F.when(flag(F.col(f"is_{c}")), s) for c, s in STRENGTH.items()], F.lit(0.0))


def source_weight(base: Column, confidence: Column, rank: Column) -> Column:
    """Clamped base weight, lifted by confidence, lowered by rank."""
    return clamp(base, 0.1, 1.5) * (0.4 + 0.6 * clamp(confidence, 0.0, 1.0)) / (1 + 0.06 * (F.greatest(rank, F.lit(1)) - 1))
