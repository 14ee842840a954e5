"""Bars, schedules, quotes, positions and actions derived from the given tables.

Each derived table exists twice: as a DataFrame and as the SQL of the cross-check.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import pricing
from barloom.functions.signals import is_finite
from barloom.operators.history import since, until
from barloom.operators.panel import along
from barloom.operators.ranking import top_k
from barloom.operators.spread import per_day
from barloom.plans import scoring
from barloom.plans.features import label_rank, standardize
from barloom.session import cut_lineage

# Parameters shared by queries and SQL.
STEPS = 20
HORIZON = 25
THRESHOLD = 0.005
SLOTS = 10
CASH = 1_000_000_000.0
RANK_DAYS = 240  # calendar days that hold more than STEPS bars of most tickers in this sparse history
BOOK_LOT = 25  # volume per lot of a position
CUTOFF = "2000-01-01"
REFETCH_FROM = "2001-01-01"
STORED_UNTIL = "2001-07-01"

TASK_LINES = 1 << 19  # lines that a task sorts, if no supplier has more
FEW_LINES = 1 << 12  # lines that are worth a task

# Order, line and price in one number: a primitive key keeps the day aggregate hashed. Order keys up
# to 2**40 fit; beyond that the sum overflows with an error.
SEQUENCE = (
    "(l_orderkey * 8 + l_linenumber) * 1048576 + cast(l_extendedprice * 100 as bigint) % 1048576"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as trades of a supplier: unit price, quantity and place in the day's sequence."""
    return table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.expr(SEQUENCE).alias("seq"),
    )


def day_aggregates() -> list[Column]:
    return [
        F.min_by("price", "seq").cast("float").alias("open"),
        F.max("price").cast("float").alias("high"),
        F.min("price").cast("float").alias("low"),
        F.max_by("price", "seq").cast("float").alias("close"),
        F.sum("quantity").cast("float").alias("volume"),
    ]


# Codes are made after the grouping, which hashes the number.
CODE = "concat('S', l_suppkey) as code"


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier: unit prices of the day's lines in order."""
    days = lines(spark, sf).groupBy("l_suppkey", "date").agg(*day_aggregates())
    return days.select(F.expr(CODE), "date", "open", "high", "low", "close", "volume")


def tasks(spark: SparkSession, sf: str) -> int:
    """Tasks that share the lines by supplier: their number grows with the lines, so that a task's share does not."""
    total = table(spark, sf, "lineitem").count()  # from the files' footers
    few = min(spark.sparkContext.defaultParallelism, total // FEW_LINES)
    return max(few, math.ceil(total / TASK_LINES), 1)


def bars_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`bars` for frames that are made once: each supplier's lines move once, to the task that frames its bars.

    First and last line are taken as rows, which Spark aggregates along the sorted lines; by numbers it would keep a hash
    table of all days of a task. Statistics of a date that are joined back would repeat the sort: they are for ``bars``.
    """
    placed = F.when(F.col("seq").isNotNull(), F.struct("seq", "price"))
    ends = {"open": F.min(placed)["price"].cast("float"), "close": F.max(placed)["price"].cast("float")}
    own = [F.max("price").cast("float").alias("high"), F.min("price").cast("float").alias("low"),
           F.sum("quantity").cast("float").alias("volume")]
    placed_lines = lines(spark, sf).withColumn("code", F.concat(F.lit("S"), "l_suppkey")).repartition(tasks(spark, sf), "code")
    days = placed_lines.groupBy("code", "date").agg(*[value.alias(name) for name, value in ends.items()], *own)
    return days.select("code", "date", "open", "high", "low", "close", "volume")


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("code"),
        F.when(F.col("s_nationkey") % 2 == 1, "otc").otherwise("tse").alias("market"),
        F.concat(F.lit("N"), "s_nationkey").alias("account"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with their market, in stored layout."""
    joined = bars(spark, sf).join(markets(spark, sf), "code")
    return joined.select("market", "code", "date", "open", "high", "low", "close", "volume")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Unadjusted bars: the adjusted close takes off the day's largest discount.

    Days of little volume have no close.
    """
    aggregates = [*day_aggregates(), F.max("discount").alias("discount")]
    day = lines(spark, sf).groupBy("l_suppkey", "date").agg(*aggregates)
    quoted = F.col("volume") >= 5
    adjclose = (F.col("close").cast("double") * (1 - F.col("discount"))).cast("float")
    return day.select(
        F.expr(CODE),
        "date",
        "open",
        "high",
        "low",
        F.when(quoted, F.col("close")).alias("close"),
        "volume",
        F.when(quoted, adjclose).alias("adjclose"),
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the history that an earlier refresh left behind."""
    return until(history(spark, sf), STORED_UNTIL)


def refetched(spark: SparkSession, sf: str) -> DataFrame:
    """A later fetch that overlaps the stored part, one percent higher."""
    fresh = since(history(spark, sf), REFETCH_FROM)
    return fresh.withColumn("close", (F.col("close").cast("double") * 1.01).cast("float"))


def std(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(bars(spark, sf))


class Rounded:
    """Scores rounded far below their scale, so that ranks do not hang on summation order."""

    def __init__(self, inner, digits: int = 9):
        self.inner, self.unit = inner, float(10**digits)

    def score(self, frame: DataFrame, steps: int) -> DataFrame:
        # What is not finite stays so; floor would turn it into a number.
        score = F.col("score")
        units = F.floor(score * self.unit + 0.5) / self.unit
        return self.inner.score(frame, steps).withColumn("score", F.when(is_finite(score), units).otherwise(score))


SCORER = Rounded(scoring.momentum_scorer(STEPS))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(std(spark, sf), SCORER, STEPS)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return label_rank(std(spark, sf), HORIZON)


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Score and label of each labelled window."""
    return scoring.score(labelled(spark, sf), SCORER, STEPS).select(
        "ticker", "date", "score", F.col("label").alias("target")
    )


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.day_bars(std(spark, sf), SCORER, STEPS)


def written_day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Day bars for queries that read them more than once: scoring runs once, then storage serves."""
    return cut_lineage(day_bars(spark, sf))


def holdings(bars_today: DataFrame) -> DataFrame:
    """A book that holds the strongest names overnight.

    Names picked on the previous day, with their score of the day if they have a bar.
    """
    picks = top_k(bars_today, -1.0, SLOTS, by="date").select("date", "ticker")
    days = bars_today.select("date").distinct()
    following = days.withColumn("next", F.lead("date").over(Window.orderBy("date")))
    carried = (
        picks.join(per_day(following), "date")
        .filter(F.col("next").isNotNull())
        .select(F.col("next").alias("date"), "ticker")
    )
    return carried.join(bars_today.select("date", "ticker", "score"), ["date", "ticker"], "left")


def actions(spark: SparkSession, sf: str, days: Callable[[SparkSession, str], DataFrame] = bars) -> DataFrame:
    """Buys where the close turns up and sells where it turns down, one position per ticker.

    The position grows with the volume of the entry bar. ``days`` makes the bars.
    """
    order = along("code")
    turns = (
        days(spark, sf)
        .withColumn("_up", F.col("close") > F.lag("close").over(order))
        .withColumn("_was", F.lag("_up").over(order))
        .filter(F.col("_up").isNotNull() & (F.coalesce("_was", ~F.col("_up")) != F.col("_up")))
    )
    lots = F.when(F.col("_up"), F.col("volume")).otherwise(F.lag("volume").over(order))
    return (
        turns.withColumn("shares", F.ceil(lots.cast("double") / BOOK_LOT) * pricing.LOT)
        .filter(F.col("shares").isNotNull())
        .select(
            "date",
            F.col("code").alias("ticker"),
            F.when(F.col("_up"), "Buy").otherwise("Sell").alias("side"),
            F.when(F.col("_up"), F.lit("")).otherwise("signal").alias("reason"),
            F.when(F.col("_up"), pricing.buy_price()).otherwise(pricing.sell_price()).alias("price"),
            "shares",
        )
    )


def ticker_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).withColumnRenamed("code", "ticker")


def book(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, float]:
    """Orders, bars and cash of the book."""
    return actions(spark, sf, bars_in_order), bars_in_order(spark, sf).withColumnRenamed("code", "ticker"), CASH


def last_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's newest bar with its account."""
    fields = ["date", "open", "high", "low", "close", "volume"]
    newest = bars(spark, sf).groupBy("code").agg(
        *[F.max_by(c, "date").alias(c) for c in fields[1:]], F.max("date").alias("date")
    )
    return newest.join(markets(spark, sf), "code")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Live quotes: thin volume leaves prices out, as before a session's first trade."""
    price = {n: F.col(n).cast("double") for n in ("open", "high", "low", "close")}
    volume = F.col("volume")
    return last_bars(spark, sf).select(
        F.col("code").alias("symbol"),
        F.when(volume >= 10, price["open"]).alias("open_price"),
        F.when(volume >= 10, price["high"]).alias("high_price"),
        F.when(volume >= 15, price["low"]).alias("low_price"),
        F.when(volume >= 20, price["close"]).alias("last_price"),
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """One position per supplier: as many lots as the newest bar's volume."""
    return last_bars(spark, sf).select(
        "account", F.col("code").alias("stock_code_id"), F.col("volume").cast("long").alias("shares")
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each account's strongest names by their latest score."""
    latest = scoring.latest_scores(bars(spark, sf), SCORER, STEPS, lookback_days=RANK_DAYS)
    mine = latest.join(
        markets(spark, sf).select(F.col("code").alias("ticker"), "account"), "ticker"
    )
    return top_k(mine, -1.0, SLOTS, by="account").select("account", "ticker", "score", "rank")


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Schedule entries: days whose largest order is urgent, closed if it is fulfilled."""
    top = F.max(F.struct("o_totalprice", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    days = (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(top.alias("top"))
        .filter(F.col("top.o_orderpriority") == "1-URGENT")
    )
    status = F.col("top.o_orderstatus")
    return days.select(
        "date",
        F.concat(F.lit("day of order "), F.col("top.o_orderkey")).alias("name"),
        F.when(status == "F", "依規定放假1日。")
        .when(status == "O", "國曆新年開始交易。")
        .otherwise("農曆春節前最後交易。")
        .alias("description"),
    )


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions.parsing import is_closed

    return schedule(spark, sf).select(
        "date", F.col("name").alias("desc"), is_closed(F.col("description")).alias("closed")
    )


CTES: dict[str, tuple[str, str]] = {
    "lines": (
        "",
        """SELECT 'S' || l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
            l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_discount AS discount,
            (l_orderkey * 8 + l_linenumber) * 1048576
            + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1048576 AS seq FROM lineitem""",
    ),
    "bars": (
        "lines",
        """SELECT code, date, CAST(arg_min(price, seq) AS FLOAT) AS open,
            CAST(max(price) AS FLOAT) AS high, CAST(min(price) AS FLOAT) AS low,
            CAST(arg_max(price, seq) AS FLOAT) AS close, CAST(sum(quantity) AS FLOAT) AS volume
            FROM lines GROUP BY code, date""",
    ),
    "markets": (
        "",
        """SELECT 'S' || s_suppkey AS code,
            CASE WHEN s_nationkey % 2 = 1 THEN 'otc' ELSE 'tse' END AS market,
            'N' || s_nationkey AS account FROM supplier""",
    ),
    "history": (
        "bars markets",
        """SELECT market, code, date, open, high, low, close, volume
            FROM bars JOIN markets USING (code)""",
    ),
    "raw_bars": (
        "lines",
        """SELECT code, date, open, high, low, CASE WHEN volume >= 5 THEN close END AS close, volume,
            CASE WHEN volume >= 5 THEN CAST(CAST(close AS DOUBLE) * (1 - discount) AS FLOAT) END
            AS adjclose FROM (
            SELECT code, date, CAST(arg_min(price, seq) AS FLOAT) AS open,
            CAST(max(price) AS FLOAT) AS high, CAST(min(price) AS FLOAT) AS low,
            CAST(arg_max(price, seq) AS FLOAT) AS close, CAST(sum(quantity) AS FLOAT) AS volume,
            max(discount) AS discount FROM lines GROUP BY code, date)""",
    ),
    "frames": (
        "history",
        f"""SELECT *, 0 AS source_seq FROM history WHERE date < DATE '{STORED_UNTIL}'
            UNION ALL
            SELECT market, code, date, open, high, low,
            CAST(CAST(close AS DOUBLE) * 1.01 AS FLOAT), volume, 1
            FROM history WHERE date >= DATE '{REFETCH_FROM}'""",
    ),
    "newest": (
        "frames",
        """SELECT * FROM frames QUALIFY
            row_number() OVER (PARTITION BY market, code, date ORDER BY source_seq DESC) = 1""",
    ),
    "sig": (
        "bars",
        """SELECT code AS ticker, date, open, high, low, close, volume,
            ln(CAST(open AS DOUBLE) / pc) AS open_return, ln(CAST(high AS DOUBLE) / pc) AS high_return,
            ln(CAST(low AS DOUBLE) / pc) AS low_return, ln(CAST(close AS DOUBLE) / pc) AS close_return,
            ln((CAST(volume AS DOUBLE) + 1) / (pv + 1)) AS volume_return,
            ln(CAST(high AS DOUBLE) / CAST(low AS DOUBLE)) AS range, pc, pv
            FROM (SELECT *, CAST(lag(close) OVER w AS DOUBLE) AS pc,
                CAST(lag(volume) OVER w AS DOUBLE) AS pv FROM bars WHERE close > 0
                WINDOW w AS (PARTITION BY code ORDER BY date))""",
    ),
    "z": (
        "sig",
        "SELECT *, "
        + ", ".join(
            f"({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + 1e-8) AS {c}_cs"
            for c in ("open_return", "high_return", "low_return", "close_return",
                      "volume_return", "range")
        )
        + " FROM sig WINDOW d AS (PARTITION BY date)",
    ),
    "std": (
        "z",
        "SELECT ticker, date, open, high, low, close, "
        + ", ".join(
            f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}"
            for base in ("", "_cs")
            for c in (f"open_return{base}", f"high_return{base}", f"low_return{base}",
                      f"close_return{base}", f"volume_return{base}", f"range{base}")
        )
        + " FROM z WHERE open_return IS NOT NULL AND open_return_cs IS NOT NULL"
        " AND range_cs IS NOT NULL",
    ),
    "mfe": (
        "std",
        f"""SELECT *, peak / nl - 1 AS raw_mfe FROM (
            SELECT *, CAST(lead(low) OVER w AS DOUBLE) AS nl,
            CASE WHEN count(high) OVER f = {HORIZON} THEN CAST(max(high) OVER f AS DOUBLE) END AS peak
            FROM std WINDOW w AS (PARTITION BY ticker ORDER BY date),
            f AS (PARTITION BY ticker ORDER BY date
                  ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING))""",
    ),
    "lab": (
        "mfe",
        """SELECT * FROM (SELECT *, (raw_mfe - avg(raw_mfe) OVER d)
            / (stddev_samp(raw_mfe) OVER d + 1e-8) AS label FROM mfe
            WINDOW d AS (PARTITION BY date)) WHERE label IS NOT NULL""",
    ),
    "keyed": (
        "std",
        f"""SELECT *, CASE WHEN row_number() OVER w >= {STEPS}
            THEN floor((avg(close_return) OVER f - 0.1 * range_cs) * 1e9 + 0.5) / 1e9 END AS score FROM std
            WINDOW w AS (PARTITION BY ticker ORDER BY date),
            f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {STEPS - 1} PRECEDING AND CURRENT ROW)
            """,
    ),
    "scored": ("keyed", "SELECT * FROM keyed WHERE score IS NOT NULL"),
    "scored_labels": (
        "lab",
        f"""SELECT ticker, date, label AS target, score FROM (
            SELECT *, CASE WHEN row_number() OVER w >= {STEPS}
            THEN floor((avg(close_return) OVER f - 0.1 * range_cs) * 1e9 + 0.5) / 1e9 END AS score FROM lab
            WINDOW w AS (PARTITION BY ticker ORDER BY date),
            f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {STEPS - 1} PRECEDING AND CURRENT ROW)
            ) WHERE score IS NOT NULL""",
    ),
    "day_bars": (
        "keyed",
        """SELECT date, ticker, prior AS score, open, low, high, close FROM (
            SELECT *, lag(score) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM keyed)
            WHERE prior IS NOT NULL""",
    ),
    "day_picks": (
        "day_bars",
        f"""SELECT date, ticker, score FROM day_bars WHERE score > -1 QUALIFY
            row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= {SLOTS}""",
    ),
    "holdings": (
        "day_picks day_bars",
        """SELECT n.next AS date, p.ticker, b.score FROM day_picks p
            JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next
                  FROM (SELECT DISTINCT date FROM day_bars)) n ON p.date = n.date
            LEFT JOIN day_bars b ON b.date = n.next AND b.ticker = p.ticker
            WHERE n.next IS NOT NULL""",
    ),
    "day_index": (
        "day_bars",
        """SELECT date, row_number() OVER (ORDER BY date) - 1 AS day
            FROM (SELECT DISTINCT date FROM day_bars)""",
    ),
    "actions": (
        "bars",
        f"""SELECT date, code AS ticker, CASE WHEN up THEN 'Buy' ELSE 'Sell' END AS side,
            CASE WHEN up THEN '' ELSE 'signal' END AS reason,
            CASE WHEN up THEN ceil(CAST(low AS DOUBLE) / tl - 1e-9) * tl
                 ELSE floor(CAST(high AS DOUBLE) / th + 1e-9) * th END AS price,
            ceil(CAST(lots AS DOUBLE) / {BOOK_LOT}) * 1000 AS shares
            FROM (SELECT *, CASE WHEN up THEN volume
                    ELSE lag(volume) OVER (PARTITION BY code ORDER BY date) END AS lots,
                CASE WHEN low < 10 THEN .01 WHEN low < 50 THEN .05 WHEN low < 100 THEN .1
                     WHEN low < 500 THEN .5 WHEN low < 1000 THEN 1.0 ELSE 5.0 END::DOUBLE AS tl,
                CASE WHEN high < 10 THEN .01 WHEN high < 50 THEN .05 WHEN high < 100 THEN .1
                     WHEN high < 500 THEN .5 WHEN high < 1000 THEN 1.0 ELSE 5.0 END::DOUBLE AS th
              FROM (SELECT *, lag(up) OVER (PARTITION BY code ORDER BY date) AS was
                FROM (SELECT *, close > lag(close) OVER (PARTITION BY code ORDER BY date) AS up
                      FROM bars))
              WHERE up IS NOT NULL AND coalesce(was, NOT up) <> up)
            WHERE lots IS NOT NULL""",
    ),
    "costed": (
        "actions",
        """SELECT *, price * shares AS amount,
            CASE WHEN side = 'Buy'
            THEN -(price * shares + greatest(price * shares * 0.001425, 20))
            ELSE price * shares - greatest(price * shares * 0.001425, 20) - price * shares * 0.003
            END AS flow FROM actions""",
    ),
    "trades": (
        "actions",
        """SELECT *, proceeds - cost AS pnl, (proceeds - cost) / cost AS return_pct FROM (
            SELECT ticker, date AS entry_date, exit_date, price AS entry_price, exit_price, shares,
            exit_reason, price * shares + greatest(price * shares * 0.001425, 20) AS cost,
            exit_price * shares - greatest(exit_price * shares * 0.001425, 20)
            - exit_price * shares * 0.003 AS proceeds FROM (
            SELECT *, lead(side) OVER w AS next_side, lead(date) OVER w AS exit_date,
            lead(price) OVER w AS exit_price, lead(reason) OVER w AS exit_reason FROM actions
            WINDOW w AS (PARTITION BY ticker ORDER BY date))
            WHERE side = 'Buy' AND next_side = 'Sell')""",
    ),
    "spine": (
        "bars actions",
        """SELECT d.date, t.ticker, b.close, a.side, a.shares FROM
            (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT code AS ticker FROM bars) t
            LEFT JOIN bars b ON b.code = t.ticker AND b.date = d.date
            LEFT JOIN actions a ON a.ticker = t.ticker AND a.date = d.date""",
    ),
    "marked": (
        "spine",
        """SELECT date, ticker,
            last_value(CAST(close AS DOUBLE) IGNORE NULLS) OVER w AS mark,
            coalesce(sum(CASE side WHEN 'Buy' THEN shares WHEN 'Sell' THEN -shares END) OVER w, 0)
                AS held,
            CASE WHEN side = 'Buy' THEN shares ELSE 0 END AS bought FROM spine
            WINDOW w AS (PARTITION BY ticker ORDER BY date
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "book": (
        "marked costed",
        f"""SELECT date, value, kept, paid, received,
            {CASH} + coalesce(sum(paid + received) OVER
                (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cash_before
            FROM (SELECT date, coalesce(sum(held * mark), 0) AS value,
                  coalesce(sum((held - bought) * mark), 0) AS kept FROM marked GROUP BY date)
            LEFT JOIN (SELECT date, sum(CASE WHEN side = 'Buy' THEN flow ELSE 0 END) AS paid0,
                  sum(CASE WHEN side = 'Buy' THEN 0 ELSE flow END) AS received0
                  FROM costed GROUP BY date) USING (date),
            LATERAL (SELECT coalesce(paid0, 0) AS paid, coalesce(received0, 0) AS received)""",
    ),
    "equity": (
        "book",
        "SELECT date, cash_before + paid + received + value AS equity FROM book",
    ),
    "last_bars": (
        "bars markets",
        """SELECT * FROM bars JOIN markets USING (code)
            QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""",
    ),
    "quotes": (
        "last_bars",
        """SELECT code AS symbol, CASE WHEN volume >= 10 THEN CAST(open AS DOUBLE) END AS open_price,
            CASE WHEN volume >= 10 THEN CAST(high AS DOUBLE) END AS high_price,
            CASE WHEN volume >= 15 THEN CAST(low AS DOUBLE) END AS low_price,
            CASE WHEN volume >= 20 THEN CAST(close AS DOUBLE) END AS last_price FROM last_bars""",
    ),
    "positions": (
        "last_bars",
        """SELECT account, code AS stock_code_id, CAST(volume AS BIGINT) AS shares
            FROM last_bars""",
    ),
    "tail": (
        "bars",
        f"""SELECT * FROM bars
            WHERE date >= (SELECT max(date) FROM bars) - {RANK_DAYS}""",
    ),
    "latest": (
        "tail",
        f"""SELECT ticker, date, floor((mean_return - 0.1 * CAST(CAST(range_cs AS FLOAT) AS DOUBLE)) * 1e9 + 0.5) / 1e9
            AS score FROM (
            SELECT *, avg(CAST(CAST(close_return AS FLOAT) AS DOUBLE)) OVER (PARTITION BY ticker
                ORDER BY date ROWS BETWEEN {STEPS - 1} PRECEDING AND CURRENT ROW) AS mean_return,
            row_number() OVER (PARTITION BY ticker ORDER BY date) AS n,
            row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM (
            SELECT *, (range - avg(range) OVER d) / (stddev_samp(range) OVER d + 1e-8) AS range_cs,
            count(close_return) OVER d AS returns FROM (
            SELECT code AS ticker, date, ln(CAST(close AS DOUBLE)
                / CAST(lag(close) OVER (PARTITION BY code ORDER BY date) AS DOUBLE)) AS close_return,
            ln(CAST(high AS DOUBLE) / CAST(low AS DOUBLE)) AS range FROM tail)
            WINDOW d AS (PARTITION BY date))
            WHERE close_return IS NOT NULL AND returns > 1 AND range_cs IS NOT NULL)
            WHERE n >= {STEPS} AND age = 1""",
    ),
    "candidates": (
        "latest markets",
        f"""SELECT account, ticker, score, CAST(rank AS INTEGER) AS rank FROM (
            SELECT account, ticker, score, row_number() OVER
            (PARTITION BY account ORDER BY score DESC, ticker) AS rank
            FROM latest JOIN markets ON markets.code = latest.ticker WHERE score > -1)
            WHERE rank <= {SLOTS}""",
    ),
    "schedule": (
        "",
        """SELECT date, 'day of order ' || o_orderkey AS name,
            CASE o_orderstatus WHEN 'F' THEN '依規定放假1日。' WHEN 'O' THEN '國曆新年開始交易。'
            ELSE '農曆春節前最後交易。' END AS description, o_orderstatus = 'F' AS closed
            FROM (SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders QUALIFY row_number() OVER
            (PARTITION BY date ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
            WHERE o_orderpriority = '1-URGENT'""",
    ),
    "cal": (
        "schedule lines",
        """SELECT date, kind, name AS "desc", next_session, prev_session FROM (
            SELECT *, min(CASE WHEN kind = 'trading' THEN date END) OVER (ORDER BY date
                ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS next_session,
            max(CASE WHEN kind = 'trading' THEN date END) OVER (ORDER BY date
                ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prev_session FROM (
            SELECT d.date, name, CASE WHEN closed THEN 'holiday' WHEN name IS NOT NULL THEN 'trading'
                WHEN isodow(d.date) >= 6 THEN 'weekend' ELSE 'trading' END AS kind
            FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM lines) - 31,
                (SELECT max(date) FROM lines) + 31, INTERVAL 1 DAY)) AS DATE) AS date) d
            LEFT JOIN schedule USING (date)))""",
    ),
}
