"""Quotes joined to positions and candidates, and the symbols to quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quote_bar(quotes: DataFrame) -> DataFrame:
    """Bars of usable quotes: open, high and low present, close falling back to the open.

    Prices pass through single precision, as stored bars do.
    """
    prices = {
        "open": F.col("open_price"),
        "high": F.col("high_price"),
        "low": F.col("low_price"),
        "close": F.coalesce("last_price", "open_price"),
    }
    usable = quotes.filter(
        F.col("open_price").isNotNull()
        & F.col("high_price").isNotNull()
        & F.col("low_price").isNotNull()
    )
    return usable.select("symbol", *[p.cast("float").alias(n) for n, p in prices.items()])


def entry_quote(quotes: DataFrame) -> DataFrame:
    """Entry price of each quote: the low, else the open; others are unusable."""
    return quotes.withColumn("entry", F.coalesce("low_price", "open_price")).filter(
        F.col("entry").isNotNull()
    )


def holdings_quotes(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Positions that have a quote, with it."""
    return positions.join(quotes, positions["stock_code_id"] == quotes["symbol"])


def candidates_quotes(ranked: DataFrame, quotes: DataFrame) -> DataFrame:
    """Ranked names that have a quote, with it."""
    return ranked.join(quotes, ranked["ticker"] == quotes["symbol"])


def symbols_to_quote(positions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct codes held or wanted."""
    held = positions.select(F.col("stock_code_id").alias("symbol"))
    return held.union(candidates.select(F.col("ticker").alias("symbol"))).distinct()
