"""Bars to features, and features to rank labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import signals
from barloom.operators import history
from barloom.operators.panel import forward_mfe, prev, sort_bars, zscore_by
from barloom.schemas import BAR_COLUMNS, PRICES

HORIZON = 25


def raw_signals(bars: DataFrame, entity: str = "code") -> DataFrame:
    """Projected bars with the six signals; a ticker's first row has no returns.

    Prices that are not finite become null, so that one bad bar cannot spoil a date's statistics.
    """
    sane = {c: signals.finite_or_null(F.col(c)) for c in (*PRICES, "volume")}
    return (
        bars.transform(history.project_bars, entity)
        .transform(history.positive_close)
        .withColumns(sane)
        .transform(prev, ["close", "volume"])
        .withColumns(
            {
                **signals.price_returns(),
                "volume_return": signals.volume_return(),
                "range": signals.range_signal(),
            }
        )
    )


def standardize(bars: DataFrame, entity: str = "code") -> DataFrame:
    """Signals and their z-scores within each date, packed in ``feature``, next to the prices.

    The bars are shuffled once, by ticker; the date statistics come from partial aggregates. The
    statistics include rows that are dropped afterwards for want of a previous row.
    """
    return (
        raw_signals(bars, entity)
        .transform(zscore_by, signals.BASE_SIGNALS)
        .transform(history.drop_null_rows, signals.FEATURES)
        .select("ticker", "date", signals.feature_array().alias("feature"), *PRICES)
    )


def label_rank(std: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows with a full forward window, labelled by the z-score of their best forward gain."""
    return label_gains(std.transform(forward_mfe, horizon))


def label_gains(gains: DataFrame) -> DataFrame:
    """Rows with a ``raw_mfe``, labelled by its z-score within their date."""
    return labelled_only(gains.transform(zscore_by, ["raw_mfe"], names=["label"]))


def labelled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull()).drop("raw_mfe")


def consolidate(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack bar frames, oldest first, keep the newest row per key, and sort."""
    return (
        history.union_frames(frames)
        .transform(history.keep_newest)
        .select(*BAR_COLUMNS)
        .transform(sort_bars, history.KEYS)
    )
