"""The index's arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.functions import dims


def half_up(x: Column, digits: int) -> Column:
    """Rounded by binary arithmetic alone, so every engine agrees on ties."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def severity_weight(level: Column) -> Column:
    """Weight of a level; null or 0 counts as 1, others are clamped to 1..5."""
    clamped = F.least(F.greatest(F.when(level != 0, level).otherwise(1), F.lit(1)), F.lit(5))
    return F.element_at(F.array(*[F.lit(dims.SEVERITY[k]) for k in range(1, 6)]), clamped.cast("int"))


def corroboration(count: Column) -> Column:
    return 1 + 0.15 * F.ln(F.greatest(count, F.lit(1)).cast("double"))


def kappa(median: Column, active_days: Column) -> Column:
    """Normaliser of a region's load: cold start, else a multiple of the trailing median with a floor."""
    return F.when((median <= 0) & (active_days < dims.COLD_DAYS), dims.KAPPA_COLD).otherwise(F.greatest(F.lit(dims.KAPPA_FLOOR), median * dims.NORM))


def saturation(load: Column, norm: Column) -> Column:
    return F.when(load > 0, F.least(1 - F.exp(-load / norm), F.lit(1.0))).otherwise(0.0)


def composite(events: Column, exercises: Column, base: Column) -> Column:
    return F.round(F.least((events * dims.WEIGHT_EVENTS + exercises * dims.WEIGHT_EXERCISES + base * dims.WEIGHT_BASE) * 100, F.lit(100.0)), 1)


def exercise_scale(scale: Column) -> Column:
    """Scale up to a full one; null or 0 is the default scale."""
    return F.least(F.coalesce(F.nullif(scale, F.lit(0)), F.lit(dims.DEFAULT_SCALE)), F.lit(dims.FULL_SCALE)).cast("long")
