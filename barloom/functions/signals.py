"""Per-bar signals and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_SIGNALS = [
    "open_return",
    "high_return",
    "low_return",
    "close_return",
    "volume_return",
    "range",
]
FEATURES = BASE_SIGNALS + [f"{name}_cs" for name in BASE_SIGNALS]
ZSCORE_EPS = 1e-8
IC_EPS = 1e-12


def is_finite(value: Column) -> Column:
    """False for null, NaN and the infinities (NaN sorts above infinity)."""
    return value.isNotNull() & (F.abs(value) < F.lit(float("inf")))


def is_positive(value: Column) -> Column:
    """Strictly positive and finite; a bare ``> 0`` would let NaN pass."""
    return (value > 0) & (value < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def log_ratio(value: Column, base: Column) -> Column:
    """``ln(value / base)``, null unless both are positive: Spark's ``ln`` is null at or below zero.

    A difference of logarithms needs no division guard, which keeps the generated code short.
    """
    return F.ln(value) - F.ln(base)


def price_returns(prev_close: str = "prev_close") -> dict[str, Column]:
    """Log return of each price against the previous close."""
    base = F.col(prev_close).cast("double")
    return {
        f"{price}_return": log_ratio(F.col(price).cast("double"), base)
        for price in ("open", "high", "low", "close")
    }


def volume_return(volume: str = "volume", prev_volume: str = "prev_volume") -> Column:
    """Log volume change; one share is added to both sides so a day without trades stays finite."""
    return log_ratio(F.col(volume).cast("double") + 1.0, F.col(prev_volume).cast("double") + 1.0)


def range_signal(high: str = "high", low: str = "low") -> Column:
    return log_ratio(F.col(high).cast("double"), F.col(low).cast("double"))


def feature_array(names: list[str] = FEATURES) -> Column:
    """Pack the signals into one float array, raw signals first, then their z-scores."""
    return F.array(*[F.col(name).cast("float") for name in names])


def zscore(value: Column, mean: Column, deviation: Column) -> Column:
    return F.try_divide(value - mean, deviation + ZSCORE_EPS)


def correlation(score: Column, target: Column) -> Column:
    """Population Pearson correlation as an aggregate; zero, not an error, for a flat side."""
    both = score.isNotNull() & target.isNotNull()
    score, target = F.when(both, score), F.when(both, target)
    return F.covar_pop(score, target) / (F.stddev_pop(score) * F.stddev_pop(target) + IC_EPS)


def huber(score: Column, target: Column, delta: float = 1.0) -> Column:
    """Huber loss of one row."""
    miss = F.abs(score - target)
    return F.when(miss <= delta, 0.5 * miss * miss).otherwise(delta * (miss - 0.5 * delta))
