"""Price ticks, fees and lot sizing as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.signals import is_finite
from barloom.schemas import LOW_HIGH, OPEN_FILL

# Fixed values of the market: lot size, fee rates and tick bands.
LOT = 1000.0
COMMISSION_RATE = 0.001425
MIN_COMMISSION = 20.0
SELL_TAX_RATE = 0.003
ROUND_TRIP = 2 * COMMISSION_RATE + SELL_TAX_RATE
TICK_BANDS = [(10.0, 0.01), (50.0, 0.05), (100.0, 0.1), (500.0, 0.5), (1000.0, 1.0)]
TOP_TICK = 5.0
TICK_SLACK = 1e-9


def tick_size(price: Column) -> Column:
    """Price step of the band that holds ``price``."""
    step = F.when(price < TICK_BANDS[0][0], TICK_BANDS[0][1])
    for upper, tick in TICK_BANDS[1:]:
        step = step.when(price < upper, tick)
    return step.otherwise(F.when(price.isNotNull(), TOP_TICK))


def tick_floor(price: Column) -> Column:
    """Highest legal price not above ``price``; null unless the price is finite."""
    tick = tick_size(price)
    return F.when(is_finite(price), F.floor(price / tick + TICK_SLACK) * tick)


def tick_ceil(price: Column) -> Column:
    """Lowest legal price not below ``price``; null unless the price is finite."""
    tick = tick_size(price)
    return F.when(is_finite(price), F.ceil(price / tick - TICK_SLACK) * tick)


def _fill_source(fill: str, extreme: str) -> Column:
    if fill not in (LOW_HIGH, OPEN_FILL):
        raise ValueError(f"unknown fill rule {fill!r}")
    return F.col("open" if fill == OPEN_FILL else extreme).cast("double")


def buy_price(fill: str = LOW_HIGH) -> Column:
    """Fill price of a buy on the bar in ``open``/``low``."""
    return tick_ceil(_fill_source(fill, "low"))


def sell_price(fill: str = LOW_HIGH) -> Column:
    """Fill price of a sell on the bar in ``open``/``high``."""
    return tick_floor(_fill_source(fill, "high"))


def commission(amount: Column) -> Column:
    return F.greatest(amount * COMMISSION_RATE, F.lit(MIN_COMMISSION))


def gross_cost(amount: Column) -> Column:
    """Cash paid for a buy of ``amount``."""
    return amount + commission(amount)


def net_proceeds(amount: Column) -> Column:
    """Cash received for a sell of ``amount``."""
    return amount - commission(amount) - amount * SELL_TAX_RATE


def affordable_shares(budget: Column, price: Column, cash: Column) -> Column:
    """Most whole-lot shares within ``budget`` whose cost and commission ``cash`` covers.

    The commission is the larger of two linear functions of the lot count, so the largest
    affordable count is the smaller of two quotients.
    """
    lot_value = price * LOT
    by_rate = F.floor(cash / (lot_value * (1 + COMMISSION_RATE)))
    by_minimum = F.floor((cash - MIN_COMMISSION) / lot_value)
    lots = F.least(F.floor(budget / lot_value), by_rate, by_minimum)
    return F.when(price > 0, F.greatest(lots, F.lit(0)) * LOT).otherwise(F.lit(0.0))


def whole_lots(budget: float, price: np.ndarray, cash: float) -> np.ndarray:
    """:func:`affordable_shares` in lots for numbers, with the same arithmetic."""
    lot_value = np.where(price > 0, price, np.inf) * LOT
    by_rate = np.floor(cash / (lot_value * (1 + COMMISSION_RATE)))
    by_minimum = np.floor((cash - MIN_COMMISSION) / lot_value)
    return np.maximum(np.minimum(np.minimum(np.floor(budget / lot_value), by_rate), by_minimum), 0.0)


def lots(shares: Column) -> Column:
    return F.round(shares / LOT).cast("long")
