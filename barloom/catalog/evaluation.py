"""Trade and equity evaluation queries, and the CSV round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, tidy
from barloom.catalog.trading import outcomes, settled
from barloom.operators import metrics, trades
from barloom.schemas import ACTIONS_CSV, EQUITY_CSV, EXIT_REASONS, TRADES_CSV
from barloom.session import scratch_path
from barloom.sources.history import read_csv, read_curves, write_csv

START, END = "1998-01-05", "2000-12-29"

t.CTES["baseline"] = (
    "bars",
    f"""SELECT date, avg(norm) * {t.CASH} AS equity FROM (
        SELECT date, CAST(close AS DOUBLE) / CAST(first_value(close) OVER
            (PARTITION BY code ORDER BY date) AS DOUBLE) AS norm FROM bars
        WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
        AND code IN (SELECT code FROM bars WHERE date = DATE '{START}')) GROUP BY date""",
)
t.CTES["whole_baseline"] = (
    "bars",
    f"""SELECT date, avg(norm) * {t.CASH} AS equity FROM (
        SELECT date, CAST(close AS DOUBLE) / CAST(first_value(close) OVER
            (PARTITION BY code ORDER BY date) AS DOUBLE) AS norm FROM bars
        WHERE code IN (SELECT code FROM bars WHERE date = (SELECT min(date) FROM bars)))
        GROUP BY date""",
)
t.CTES["returns"] = (
    "equity",
    "SELECT date, equity, equity / lag(equity) OVER (ORDER BY date) - 1 AS daily_return FROM equity",
)
STATS_SQL = f"""count(*) AS trade_count,
    {r("count(*) FILTER (WHERE pnl > 0) / greatest(count(*), 1)", 6)} AS win_rate,
    {r("sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0)", 6)} AS profit_factor,
    {r("avg(return_pct) FILTER (WHERE pnl > 0)", 6)} AS avg_win_return,
    {r("avg(return_pct) FILTER (WHERE pnl < 0)", 6)} AS avg_loss_return"""
TALLY_SQL = ", ".join(f"count(*) FILTER (WHERE exit_reason = '{x}') AS {x}" for x in EXIT_REASONS)
FINAL = "arg_max(equity, date)"
RETURN_SQL = f"""{r(FINAL, -1)} AS final_equity, count(*) AS trading_days,
    {r(f"{FINAL} / {t.CASH} - 1", 6)} AS cumulative_return,
    {r(f"({FINAL} / {t.CASH} - 1) / count(*) * 252", 6)} AS annualized_return"""
SHARPE = "avg(daily_return) / stddev_pop(daily_return) * sqrt(252)"


def equity(spark, sf):
    return trades.mark_equity(*t.book(spark, sf), tasks=t.tasks(spark, sf))


def round_trips(spark, sf):
    return trades.round_trips(t.actions(spark, sf, t.bars_in_order))


@query(
    "priced_at_start",
    "bars",
    f"""SELECT code, date, {r('close')} AS close FROM bars
        WHERE code IN (SELECT code FROM bars WHERE date = DATE '{START}')""",
)
def priced_at_start(spark, sf):
    df = metrics.priced_at_start(t.bars(spark, sf), START)
    return tidy(df.select("code", "date", "close"))


@query("baseline_curve", "baseline", f"SELECT date, {r('equity', -1)} AS equity FROM baseline")
def baseline_curve(spark, sf):
    return tidy(metrics.baseline_curve(t.bars(spark, sf), START, END, t.CASH), -1)


@query("exit_tally", "outcomes", f"SELECT {TALLY_SQL} FROM outcomes")
def exit_tally(spark, sf):
    return metrics.exit_tally(outcomes(spark, sf))


@query("trade_stats", "trades", f"SELECT {STATS_SQL} FROM trades")
def trade_stats(spark, sf):
    return tidy(metrics.trade_stats(round_trips(spark, sf)), 6)


@query("return_stats", "equity", f"SELECT {RETURN_SQL} FROM equity")
def return_stats(spark, sf):
    return tidy(metrics.return_stats(equity(spark, sf), t.CASH), 6, final_equity=-1)


@query("sharpe", "returns", f"SELECT {r(SHARPE)} AS sharpe FROM returns")
def sharpe(spark, sf):
    return tidy(metrics.sharpe(equity(spark, sf)))


@query(
    "daily_return",
    "returns",
    f"SELECT date, {r('equity', -1)} AS equity, {r('daily_return', 6)} AS daily_return FROM returns",
)
def daily_return(spark, sf):
    return tidy(metrics.daily_return(equity(spark, sf)), 6, equity=-1)


@query(
    "performance_report",
    "trades returns",
    f"""SELECT * FROM (SELECT {STATS_SQL} FROM trades), (SELECT {TALLY_SQL} FROM trades),
        (SELECT {RETURN_SQL} FROM returns), (SELECT {r(SHARPE, 6)} AS sharpe FROM returns)""",
)
def performance_report(spark, sf):
    df = metrics.performance_report(round_trips(spark, sf), equity(spark, sf), t.CASH)
    return tidy(df, 6, final_equity=-1)


@query("write_curve_csv", "equity", f"SELECT date, {r('equity', -1)} AS equity FROM equity")
def write_curve_csv(spark, sf):
    path = scratch_path(spark, "curve")
    write_csv(equity(spark, sf), path)
    return tidy(read_csv(spark, path, EQUITY_CSV), -1)


@query(
    "write_trades_csv",
    "trades",
    f"""SELECT entry_date, exit_date, ticker, {r('shares', 3)} AS shares,
        {r('entry_price', 3)} AS entry_price, {r('exit_price', 3)} AS exit_price,
        {r('cost', 3)} AS cost, {r('proceeds', 3)} AS proceeds, {r('pnl', 3)} AS pnl,
        {r('return_pct', 3)} AS return_pct, exit_reason FROM trades""",
)
def write_trades_csv(spark, sf):
    path = scratch_path(spark, "trades")
    columns = [field.split()[0] for field in TRADES_CSV.split(", ")]
    write_csv(round_trips(spark, sf).select(*columns), path)
    return tidy(read_csv(spark, path, TRADES_CSV), 3)


@query(
    "write_actions_csv",
    "settled",
    f"""SELECT date, ticker, side, nullif(reason, '') AS reason, {r('price', 2)} AS price,
        {r('shares', 2)} AS shares, {r('price * shares', 2)} AS amount,
        {r('cash_after', -1)} AS cash_after FROM settled""",
)
def write_actions_csv(spark, sf):
    path = scratch_path(spark, "actions")
    columns = [field.split()[0] for field in ACTIONS_CSV.split(", ")]
    booked = settled(spark, sf).withColumn("amount", F.col("price") * F.col("shares"))
    write_csv(booked.select(*columns), path)
    back = read_csv(spark, path, ACTIONS_CSV)
    return tidy(back.withColumn("reason", F.expr("nullif(reason, '')")), 2, cash_after=-1)


def curve_files(spark, sf):
    """The book's curve and the buy-and-hold curve as CSV, by label."""
    files = {"book": equity(spark, sf),
             "hold": metrics.baseline_curve(t.bars_in_order(spark, sf), START, END, t.CASH)}
    paths = {label: scratch_path(spark, f"curve-{label}") for label in files}
    for label, curve in files.items():
        write_csv(curve, paths[label])
    return paths


CURVES_SQL = """SELECT date, equity, 'book' AS series FROM equity
    UNION ALL SELECT date, equity, 'hold' AS series FROM baseline"""


@query(
    "read_labelled_csv",
    "equity baseline",
    f"SELECT date, {r('equity', -1)} AS equity, series FROM ({CURVES_SQL})",
)
def read_labelled_csv(spark, sf):
    return tidy(read_curves(spark, curve_files(spark, sf)), -1)


@query(
    "final_return_by_series",
    "equity baseline",
    f"""SELECT series, {r(f'arg_max(equity, date) / {t.CASH} - 1', 6)} AS total_return
        FROM ({CURVES_SQL}) GROUP BY series""",
)
def final_return_by_series(spark, sf):
    return tidy(metrics.final_returns(read_curves(spark, curve_files(spark, sf)), t.CASH), 6)


@query(
    "compare_curves",
    "equity baseline whole_baseline",
    f"""SELECT date, {r('equity', -1)} AS equity, series,
        {r(f'arg_max(equity, date) OVER (PARTITION BY series) / {t.CASH} - 1', 6)} AS total_return FROM ({CURVES_SQL}
        UNION ALL SELECT date, equity, 'baseline' AS series FROM whole_baseline)""",
)
def compare_curves(spark, sf):
    curves = read_curves(spark, curve_files(spark, sf))
    return tidy(metrics.compare_curves(curves, t.bars(spark, sf), t.CASH), -1, total_return=6)
