"""A day's sell and buy orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import pricing
from barloom.operators.orders import candidates_quotes, entry_quote, holdings_quotes, quote_bar


def plan_sells(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Sell every position with a usable quote whole, at the highest legal price of the day.

    Positions are counted in lots.
    """
    priced = holdings_quotes(positions, quote_bar(quotes)).withColumn("price", pricing.sell_price())
    amount = F.col("price") * F.col("shares") * pricing.LOT
    keys = [c for c in positions.columns if c not in ("stock_code_id", "shares")]
    return priced.select(
        *keys,
        F.col("stock_code_id").alias("code"),
        F.col("shares").cast("long").alias("lots"),
        "price",
        pricing.net_proceeds(amount).alias("proceeds"),
    )


def plan_buys(
    candidates: DataFrame,
    quotes: DataFrame,
    budget: Column,
    slots: int,
    account: str = "account",
) -> DataFrame:
    """Buy orders of each account, strongest name first, until its cash runs out.

    ``candidates`` has the account, ticker and rank; names without a legal price are left out. Every name
    aims at an equal share of the budget; what a name costs is gone for the names after it, hence the fold
    in rank order. An account's names are sorted by Spark and stream through its task, which keeps nothing
    but the cash that is left, so a list may have any length.
    """
    entry = pricing.tick_ceil(F.col("entry")).alias("price")
    offered = candidates_quotes(candidates.withColumn("budget", budget), entry_quote(quotes))
    priced = offered.select(account, "rank", F.col("ticker").alias("code"), entry, F.col("budget").cast("double").alias("budget"))
    priced = priced.filter(F.col("price").isNotNull())
    cash = priced.groupBy(account).agg(F.max("budget").alias("budget"))
    queues = (
        priced.drop("budget").join(cash, account)
        .repartition(account)
        .sortWithinPartitions(account, "rank", "code", "price")
        .select(account, "code", "price", "budget")
    )
    schema = T.StructType([queues.schema[account], queues.schema["code"], T.StructField("shares", T.DoubleType()),
                           T.StructField("price", T.DoubleType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, left = None, 0.0
        for batch in batches:
            names, prices, budgets = batch.column(0), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(names)]
            taken: list[int] = []
            shares: list[float] = []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start < stop and (owner is None or names[start] != owner):
                    owner, left = names[start], float(budgets[start])
                target = float(budgets[start]) / max(slots, 1) if start < stop else 0.0
                at = start
                while at < stop:
                    # The names in between cost more than is left, and cash only falls.
                    can = np.flatnonzero(pricing.whole_lots(min(target, left), prices[at:stop], left) > 0)
                    if not len(can):
                        break
                    at += int(can[0])
                    bought = float(pricing.whole_lots(min(target, left), prices[at], left)) * pricing.LOT
                    amount = float(prices[at]) * bought
                    left -= amount + max(amount * pricing.COMMISSION_RATE, pricing.MIN_COMMISSION)
                    taken.append(at)
                    shares.append(bought)
                    at += 1
            if taken:
                own = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(shares), own.column(2)], names=[account, "code", "shares", "price"]
                )

    return queues.mapInArrow(fill, schema).select(
        account,
        "code",
        pricing.lots(F.col("shares")).alias("lots"),
        "price",
        pricing.gross_cost(F.col("price") * F.col("shares")).alias("cost"),
    )
