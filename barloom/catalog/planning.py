"""Calendar queries and the daily plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, tidy
from barloom.catalog.trading import ceil_sql, floor_sql
from barloom.operators import history, metrics, orders, sessions
from barloom.plans import orders as plans

BUDGET = 100_000_000.0
FIRST, LAST = "1995-01-02", "2001-11-04"

t.CTES["dates"] = ("lines", "SELECT DISTINCT date FROM lines")


def dates(spark, sf):
    return t.lines(spark, sf).select("date").distinct()


def calendar(spark, sf):
    """The calendar of the days the bars span."""
    first, last = dates(spark, sf).agg(F.min("date"), F.max("date")).first()
    return sessions.calendar(t.holidays(spark, sf), first, last)


@query(
    "classify_days",
    "dates cal",
    'SELECT date, kind, "desc" FROM dates JOIN cal USING (date)',
)
def classify_days(spark, sf):
    return sessions.classify_days(dates(spark, sf), t.holidays(spark, sf))


@query(
    "missing_ranges",
    "history markets cal",
    """SELECT market, code, min(date) AS first, max(date) AS last, CAST(count(*) AS INTEGER) AS sessions FROM (
        SELECT market, code, date, k - row_number() OVER (PARTITION BY market, code ORDER BY date) AS island
        FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM cal
            WHERE kind = 'trading' AND date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31') d CROSS JOIN markets m
        ANTI JOIN history h ON h.market = m.market AND h.code = m.code AND h.date = d.date)
        GROUP BY market, code, island""",
)
def missing_ranges(spark, sf):
    """Sessions of each listed code that the stored history lacks, as ranges to fetch."""
    sessions_ = calendar(spark, sf).filter(F.col("kind") == "trading")
    codes = t.markets(spark, sf).select("market", "code")
    return history.missing_ranges(
        t.history(spark, sf), codes, sessions_, "1996-01-01", "2001-12-31", keys=("market", "code")
    )


@query("next_session", "dates cal", "SELECT date, next_session FROM dates JOIN cal USING (date)")
def next_session(spark, sf):
    return sessions.next_session(dates(spark, sf), calendar(spark, sf))


@query("prev_session", "dates cal", "SELECT date, prev_session FROM dates JOIN cal USING (date)")
def prev_session(spark, sf):
    return sessions.prev_session(dates(spark, sf), calendar(spark, sf))


def event_holidays(spark, sf):
    """Days of the event stream named after their largest event; a failure closes the day."""
    largest = F.max(F.struct("value", "event_id", "event_type")).alias("top")
    days = t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(largest)
    return days.filter(F.col("top.event_type").isin("error", "purchase")).select(
        "date",
        F.col("top.event_type").alias("desc"),
        (F.col("top.event_type") == "error").alias("closed"),
    )


t.CTES["event_cal"] = (
    "",
    """SELECT *, min(CASE WHEN trading THEN date END) OVER (ORDER BY date
            ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS next_session,
        max(CASE WHEN trading THEN date END) OVER (ORDER BY date
            ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prev_session FROM (
        SELECT d.date, CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true
            ELSE isodow(d.date) < 6 END AS trading
        FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events) - 31,
            (SELECT CAST(max(ts) AS DATE) FROM events) + 40, INTERVAL 1 DAY)) AS DATE) AS date) d
        LEFT JOIN (SELECT CAST(ts AS DATE) AS date, arg_max(event_type, (value, event_id)) AS event_type
            FROM events GROUP BY 1) e ON e.date = d.date)""",
)


@query(
    "session_for",
    "event_cal",
    """SELECT event_id, session, p.prev_session AS prior FROM (
        SELECT event_id, CASE WHEN trading AND CAST(local AS TIME) < TIME '13:00:00' THEN c.date
            ELSE c.next_session END AS session
        FROM (SELECT event_id, ts + INTERVAL 8 HOUR AS local FROM events)
        JOIN event_cal c ON c.date = CAST(local AS DATE))
        JOIN event_cal p ON p.date = session""",
)
def session_for(spark, sf):
    """Every event as an order placed at its time."""
    events = t.table(spark, sf, "events").select("event_id", "ts")
    first, last = events.agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 9)).first()
    days = sessions.calendar(event_holidays(spark, sf), first, last)
    return sessions.session_for(events, days).select("event_id", "session", "prior")


@query(
    "freshness_gate",
    "dates cal history",
    f"""SELECT last_date, needed, last_date >= needed AS ok FROM
        (SELECT max(date) AS last_date FROM history WHERE date < DATE '{t.STORED_UNTIL}'),
        (SELECT prev_session AS needed FROM cal WHERE date = (SELECT max(date) FROM dates))""",
)
def freshness_gate(spark, sf):
    days = calendar(spark, sf)
    newest = dates(spark, sf).agg(F.max("date").alias("date"))
    needed = days.join(newest, "date").select(F.col("prev_session").alias("prior"))
    return history.freshness(history.last_date(t.stored(spark, sf)), needed)


QUOTES_SQL = ", ".join(
    f"{r(c)} AS {c}" for c in ("open_price", "high_price", "low_price", "last_price")
)


@query(
    "holdings_quotes",
    "positions quotes",
    f"SELECT account, stock_code_id, shares, symbol, {QUOTES_SQL} FROM positions"
    " JOIN quotes ON symbol = stock_code_id",
)
def holdings_quotes(spark, sf):
    return tidy(orders.holdings_quotes(t.positions(spark, sf), t.quotes(spark, sf)))


@query(
    "candidates_quotes",
    "candidates quotes",
    f"SELECT account, ticker, {r('score')} AS score, rank, symbol, {QUOTES_SQL} FROM candidates"
    " JOIN quotes ON symbol = ticker",
)
def candidates_quotes(spark, sf):
    return tidy(orders.candidates_quotes(t.candidates(spark, sf), t.quotes(spark, sf)))


@query(
    "quote_bar",
    "quotes",
    f"""SELECT symbol, {r('open_price')} AS open, {r('high_price')} AS high, {r('low_price')} AS low,
        {r('coalesce(last_price, open_price)')} AS close FROM quotes WHERE open_price IS NOT NULL
        AND high_price IS NOT NULL AND low_price IS NOT NULL""",
)
def quote_bar(spark, sf):
    return tidy(orders.quote_bar(t.quotes(spark, sf)))


@query(
    "entry_quote",
    "quotes",
    f"""SELECT symbol, {r('coalesce(low_price, open_price)')} AS entry FROM quotes
        WHERE coalesce(low_price, open_price) IS NOT NULL""",
)
def entry_quote(spark, sf):
    return tidy(orders.entry_quote(t.quotes(spark, sf)).select("symbol", "entry"))


@query(
    "symbols_to_quote",
    "positions candidates",
    "SELECT stock_code_id AS symbol FROM positions UNION SELECT ticker FROM candidates",
)
def symbols_to_quote(spark, sf):
    return orders.symbols_to_quote(t.positions(spark, sf), t.candidates(spark, sf))


@query(
    "quote_coverage", "quotes", "SELECT count(*) AS fetched, count(open_price) AS priced FROM quotes"
)
def quote_coverage(spark, sf):
    return metrics.quote_coverage(t.quotes(spark, sf))


t.CTES["sells"] = (
    "positions quotes",
    f"""SELECT account, stock_code_id AS code, shares AS lots, price,
        amount - greatest(amount * 0.001425, 20) - amount * 0.003 AS proceeds FROM (
        SELECT *, price * shares * 1000 AS amount FROM (
        SELECT *, {floor_sql('high_price')} AS price FROM positions
        JOIN quotes ON symbol = stock_code_id WHERE open_price IS NOT NULL
        AND high_price IS NOT NULL AND low_price IS NOT NULL))""",
)
t.CTES["queue"] = (
    "candidates quotes",
    f"""SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank) AS k FROM (
        SELECT account, ticker, rank, {ceil_sql('coalesce(low_price, open_price)')} AS price
        FROM candidates JOIN quotes ON symbol = ticker
        WHERE coalesce(low_price, open_price) IS NOT NULL)""",
)
SHARES = f"""1000 * list_max(list_filter(range(0, CAST(floor(least({BUDGET} / {t.SLOTS}, w.remaining)
    / (q.price * 1000)) AS BIGINT) + 1), lambda x: x = 0 OR
    x * 1000 * q.price + greatest(x * 1000 * q.price * 0.001425, 20) <= w.remaining))"""
t.CTES["walk"] = (
    "queue",
    f"""SELECT account, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS code,
            CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS price,
            CAST({BUDGET} AS DOUBLE) AS remaining FROM (SELECT DISTINCT account FROM queue)
        UNION ALL
        SELECT account, k, code, shares, price, remaining - CASE WHEN shares > 0
            THEN shares * price + greatest(shares * price * 0.001425, 20) ELSE 0 END FROM (
        SELECT w.account, q.k, q.ticker AS code, q.price, w.remaining,
            CAST({SHARES} AS DOUBLE) AS shares
        FROM walk w JOIN queue q ON q.account = w.account AND q.k = w.k + 1)""",
)
t.CTES["buys"] = (
    "walk",
    """SELECT account, code, CAST(shares / 1000 AS BIGINT) AS lots, price,
        shares * price + greatest(shares * price * 0.001425, 20) AS cost FROM walk WHERE shares > 0""",
)


def sells(spark, sf):
    return plans.plan_sells(t.positions(spark, sf), t.quotes(spark, sf))


def buys(spark, sf):
    return plans.plan_buys(t.candidates(spark, sf), t.quotes(spark, sf), F.lit(BUDGET), t.SLOTS)


@query(
    "plan_sells",
    "sells",
    f"SELECT account, code, lots, {r('price')} AS price, {r('proceeds')} AS proceeds FROM sells",
)
def plan_sells(spark, sf):
    return tidy(sells(spark, sf))


@query(
    "plan_buys",
    "buys",
    f"SELECT account, code, lots, {r('price')} AS price, {r('cost')} AS cost FROM buys",
    recursive=True,
)
def plan_buys(spark, sf):
    return tidy(buys(spark, sf))


@query(
    "plan_totals",
    "sells buys",
    f"""SELECT * FROM (SELECT count(*) AS sells, {r('sum(proceeds)', 3)} AS proceeds FROM sells),
        (SELECT count(*) AS buys, {r('sum(cost)', 3)} AS cost FROM buys)""",
    recursive=True,
)
def plan_totals(spark, sf):
    return tidy(metrics.plan_totals(sells(spark, sf), buys(spark, sf)), 3)
