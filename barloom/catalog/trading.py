"""Pricing, exit and book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, tidy
from barloom.functions import pricing
from barloom.operators import ranking, trades

TAKE_PROFIT, STOP_LOSS, HOLD = 3.0, 0.8, 6


def tick_sql(price: str) -> str:
    return (
        f"(CASE WHEN {price} < 10 THEN 0.01 WHEN {price} < 50 THEN 0.05 WHEN {price} < 100 THEN 0.1"
        f" WHEN {price} < 500 THEN 0.5 WHEN {price} < 1000 THEN 1.0 ELSE 5.0 END)::DOUBLE"
    )


def floor_sql(price: str) -> str:
    return f"floor({price} / {tick_sql(price)} + 1e-9) * {tick_sql(price)}"


def ceil_sql(price: str) -> str:
    return f"ceil({price} / {tick_sql(price)} - 1e-9) * {tick_sql(price)}"


t.CTES["px"] = (
    "bars",
    """SELECT code, date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
        CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close,
        CAST(volume AS DOUBLE) AS volume FROM bars""",
)
t.CTES["path"] = (
    "day_bars day_index",
    f"""SELECT ticker, b.date, score, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
        CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, day,
        {ceil_sql('CAST(low AS DOUBLE)')} AS buy, {floor_sql('CAST(high AS DOUBLE)')} AS sell,
        row_number() OVER (PARTITION BY ticker ORDER BY b.date) AS n,
        max(day) OVER () AS last_day, max(b.date) OVER () AS last_date
        FROM day_bars b JOIN day_index USING (date)""",
)
t.CTES["judged"] = (
    "path",
    f"""SELECT e.ticker, e.date AS entry_date, e.day AS entry_day, e.buy, b.day, b.date, b.close, b.sell,
        e.close AS entry_close, e.last_day, e.last_date,
        CASE WHEN b.high >= e.buy * {1 + TAKE_PROFIT} THEN 'take_profit'
             WHEN b.low <= e.buy * (1 - {STOP_LOSS}) THEN 'stop_loss'
             WHEN b.day - e.day >= {HOLD} THEN 'time'
             WHEN b.score < 0 THEN 'signal'
             WHEN b.day = e.last_day THEN 'final' END AS reason
        FROM path e LEFT JOIN path b
        ON b.ticker = e.ticker AND b.n > e.n AND b.n <= e.n + {HOLD}
        WHERE e.score > {t.THRESHOLD} AND e.day < e.last_day""",
)
t.CTES["outcomes"] = (
    "judged",
    f"""SELECT ticker, entry_date, coalesce(x.date, last_date) AS exit_date, buy AS entry_price,
        CASE x.reason WHEN 'take_profit' THEN {floor_sql(f'(buy * {1 + TAKE_PROFIT})')}
            WHEN 'stop_loss' THEN {floor_sql(f'(buy * (1 - {STOP_LOSS}))')}
            WHEN 'time' THEN {floor_sql('x.close')}
            WHEN 'signal' THEN x.sell WHEN 'final' THEN x.sell
            ELSE coalesce(mark, entry_close) END AS exit_price,
        CAST(coalesce(x.day, last_day) - entry_day AS INTEGER) AS days_held,
        coalesce(x.reason, 'final') AS exit_reason FROM (
        SELECT ticker, entry_date, any_value(entry_day) AS entry_day, any_value(buy) AS buy,
        any_value(entry_close) AS entry_close, any_value(last_day) AS last_day,
        any_value(last_date) AS last_date, arg_max(close, day) AS mark,
        arg_min({{'reason': reason, 'date': date, 'day': day, 'close': close, 'sell': sell}}, day)
            FILTER (WHERE reason IS NOT NULL) AS x
        FROM judged GROUP BY ticker, entry_date)""",
)
OUTCOME_SQL = f"""SELECT ticker, entry_date, exit_date, {r('entry_price')} AS entry_price,
    {r('exit_price')} AS exit_price, days_held, exit_reason FROM outcomes"""


def bars64(spark, sf):
    """Bars in double precision."""
    prices = ["open", "high", "low", "close", "volume"]
    return t.bars(spark, sf).withColumns({c: F.col(c).cast("double") for c in prices})


def outcomes(spark, sf):
    return trades.exit_outcomes(
        t.written_day_bars(spark, sf), TAKE_PROFIT, STOP_LOSS, HOLD, threshold=t.THRESHOLD
    )


@query("tick_size", "px", f"SELECT code, date, {r(tick_sql('close'))} AS tick FROM px")
def tick_size(spark, sf):
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", pricing.tick_size(F.col("close")).alias("tick")))


@query("tick_floor", "px", f"SELECT code, date, {r(floor_sql('close'))} AS price FROM px")
def tick_floor(spark, sf):
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", pricing.tick_floor(F.col("close")).alias("price")))


@query("tick_ceil", "px", f"SELECT code, date, {r(ceil_sql('close'))} AS price FROM px")
def tick_ceil(spark, sf):
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", pricing.tick_ceil(F.col("close")).alias("price")))


@query(
    "fill_prices",
    "px",
    f"""SELECT code, date, {r(ceil_sql('low'))} AS buy_low, {r(ceil_sql('open'))} AS buy_open,
        {r(floor_sql('high'))} AS sell_high, {r(floor_sql('open'))} AS sell_open FROM px""",
)
def fill_prices(spark, sf):
    return tidy(
        t.bars(spark, sf).select(
            "code",
            "date",
            pricing.buy_price("low_high").alias("buy_low"),
            pricing.buy_price("open").alias("buy_open"),
            pricing.sell_price("low_high").alias("sell_high"),
            pricing.sell_price("open").alias("sell_open"),
        )
    )


@query(
    "commission",
    "px",
    f"SELECT code, date, {r('greatest(close * volume * 0.001425, 20)', 6)} AS fee FROM px",
)
def commission(spark, sf):
    amount = F.col("close") * F.col("volume")
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", pricing.commission(amount).alias("fee")), 6)


@query(
    "net_proceeds",
    "px",
    f"""SELECT code, date, {r('close * volume - greatest(close * volume * 0.001425, 20) - close * volume * 0.003', 5)}
        AS proceeds FROM px""",
)
def net_proceeds(spark, sf):
    amount = F.col("close") * F.col("volume")
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", pricing.net_proceeds(amount).alias("proceeds")), 5)


@query(
    "round_trip_cost",
    "px",
    f"SELECT code, date, {r('close * 0.00585', 6)} AS hurdle FROM px",
)
def round_trip_cost(spark, sf):
    df = bars64(spark, sf)
    return tidy(df.select("code", "date", (F.col("close") * pricing.ROUND_TRIP).alias("hurdle")), 6)


@query(
    "affordable_shares",
    "px",
    f"""SELECT code, date, {r('1000 * list_max(list_filter(range(0, CAST(floor(budget / lot) AS BIGINT) + 1), lambda k: k = 0 OR k * lot + greatest(k * lot * 0.001425, 20) <= cash))')}
        AS shares FROM (SELECT code, date, {ceil_sql('low')} * 1000 AS lot,
        1000000 + volume * 200000 AS budget, (1000000 + volume * 200000) * 1.0005 AS cash FROM px)""",
)
def affordable_shares(spark, sf):
    budget = 1_000_000 + F.col("volume") * 200_000
    shares = pricing.affordable_shares(budget, pricing.buy_price(), budget * 1.0005)
    return tidy(bars64(spark, sf).select("code", "date", shares.alias("shares")))


@query(
    "lots",
    "actions",
    "SELECT ticker, date, CAST(round(shares / 1000) AS BIGINT) AS lots FROM actions",
)
def lots(spark, sf):
    return t.actions(spark, sf).select(
        "ticker", "date", pricing.lots(F.col("shares")).alias("lots")
    )


WEIGHT = """CASE WHEN sum(greatest(score, 0)) OVER d > 0
    THEN greatest(score, 0) / sum(greatest(score, 0)) OVER d ELSE 1.0 / count(*) OVER d END"""


@query(
    "score_weights",
    "day_bars",
    f"SELECT date, ticker, {r(WEIGHT, 6)} AS weight FROM day_bars WINDOW d AS (PARTITION BY date)",
)
def score_weights(spark, sf):
    df = ranking.score_weights(t.written_day_bars(spark, sf).select("date", "ticker", "score"))
    return tidy(df.select("date", "ticker", "weight"), 6)


@query(
    "score_targets",
    "day_bars",
    f"""SELECT date, ticker, {r(f'1000000 * ({WEIGHT})', 2)} AS target FROM (
        SELECT * FROM day_bars WHERE score > {t.THRESHOLD} QUALIFY row_number() OVER
        (PARTITION BY date ORDER BY score DESC, ticker) <= {t.SLOTS} - day(date) % {t.SLOTS + 1})
        WINDOW d AS (PARTITION BY date)""",
)
def score_targets(spark, sf):
    """The book holds from none to all of its slots, by the day of the month."""
    wanted = ranking.above(t.day_bars(spark, sf), t.THRESHOLD).withColumns(
        {"cash": F.lit(1e6), "held": F.dayofmonth("date") % (t.SLOTS + 1)}
    )
    df = ranking.score_targets(wanted, t.SLOTS, held="held")
    return tidy(df.select("date", "ticker", "target"), 2)


@query("exit_outcomes", "outcomes", OUTCOME_SQL)
def exit_outcomes(spark, sf):
    return tidy(outcomes(spark, sf))


@query("final_liquidation", "outcomes", OUTCOME_SQL + " WHERE exit_reason = 'final'")
def final_liquidation(spark, sf):
    return tidy(outcomes(spark, sf).filter(F.col("exit_reason") == "final"))


@query(
    "round_trips",
    "trades",
    f"""SELECT ticker, entry_date, exit_date, exit_reason, {r('entry_price')} AS entry_price,
        {r('exit_price')} AS exit_price, {r('shares')} AS shares, {r('cost')} AS cost,
        {r('proceeds')} AS proceeds, {r('pnl')} AS pnl, {r('return_pct', 6)} AS return_pct FROM trades""",
)
def round_trips(spark, sf):
    df = trades.round_trips(t.actions(spark, sf))
    return tidy(df, 4, return_pct=6)


@query("mark_equity", "equity", f"SELECT date, {r('equity', -1)} AS equity FROM equity")
def mark_equity(spark, sf):
    df = trades.mark_equity(*t.book(spark, sf), tasks=t.tasks(spark, sf))
    return tidy(df, -1)


@query(
    "equal_target",
    "book",
    f"SELECT date, {r(f'(cash_before + kept) / {t.SLOTS}', -1)} AS target FROM book",
)
def equal_target(spark, sf):
    df = trades.equal_target(*t.book(spark, sf), t.SLOTS, t.tasks(spark, sf))
    return tidy(df, -1)


t.CTES["settled"] = (
    "costed bars",
    f"""SELECT date, ticker, side, reason, price, shares, {t.CASH} + total AS cash_after FROM (
        SELECT *, sum(flow) OVER (ORDER BY date, phase, ticker ROWS UNBOUNDED PRECEDING) AS total
        FROM (
        SELECT date, ticker, side, reason, price, shares,
            CASE side WHEN 'Buy' THEN 2 ELSE 1 END AS phase,
            CASE side WHEN 'Buy' THEN flow ELSE 0 END AS flow FROM costed
        UNION ALL
        SELECT next, ticker, side, reason, price, shares, 0, flow FROM costed JOIN (
            SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM bars))
            USING (date) WHERE side = 'Sell' AND next IS NOT NULL)) WHERE phase > 0""",
)


def settled(spark, sf):
    return trades.settle_cash(t.actions(spark, sf), t.bars(spark, sf), t.CASH)


@query(
    "settle_cash",
    "settled",
    f"""SELECT date, ticker, side, reason, {r('price')} AS price, {r('shares')} AS shares,
        {r('cash_after', -1)} AS cash_after FROM settled""",
)
def settle_cash(spark, sf):
    return tidy(settled(spark, sf), 4, cash_after=-1)


@query(
    "mark_to_last_close",
    "actions px",
    f"""SELECT a.ticker, a.date, {r('shares')} AS shares, {r('close')} AS mark,
        {r('close * shares', 2)} AS value FROM (SELECT ticker, date + 3 AS date, shares FROM actions) a
        ASOF JOIN px ON px.code = a.ticker AND a.date >= px.date""",
)
def mark_to_last_close(spark, sf):
    dated = t.actions(spark, sf).select("ticker", F.date_add("date", 3).alias("date"), "shares")
    df = trades.mark_to_last_close(dated, t.ticker_bars(spark, sf))
    return tidy(df, 4, value=2)


@query(
    "not_held",
    "day_bars holdings",
    f"""SELECT date, ticker, {r('score', 6)} AS score FROM day_bars b WHERE NOT EXISTS (
        SELECT 1 FROM holdings h WHERE h.date = b.date AND h.ticker = b.ticker)""",
)
def not_held(spark, sf):
    today = t.written_day_bars(spark, sf).select("date", "ticker", "score")
    return tidy(trades.not_held(today, t.holdings(today)), 6)


@query(
    "rotation_pairs",
    "day_bars holdings",
    f"""SELECT date, CAST(k AS INTEGER) AS k, held, {r('held_score', 6)} AS held_score, challenger,
        {r('new_score', 6)} AS new_score FROM (
        SELECT *, bool_and(new_score - held_score > 0.00585) OVER (PARTITION BY date ORDER BY k) AS ok
        FROM (SELECT date, ticker AS held, score AS held_score,
                row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k FROM holdings
              WHERE score IS NOT NULL AND date IN
                (SELECT date FROM holdings GROUP BY date HAVING count(*) >= {t.SLOTS}))
        JOIN (SELECT date, ticker AS challenger, score AS new_score,
                row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k
              FROM day_bars b WHERE score > {t.THRESHOLD} AND NOT EXISTS (
              SELECT 1 FROM holdings h WHERE h.date = b.date AND h.ticker = b.ticker))
        USING (date, k)) WHERE ok""",
)
def rotation_pairs(spark, sf):
    today = t.written_day_bars(spark, sf).select("date", "ticker", "score")
    held = t.holdings(today)
    free = ranking.above(trades.not_held(today, held), t.THRESHOLD)
    return tidy(trades.rotation_pairs(held, free, t.SLOTS), 6)
