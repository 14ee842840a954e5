"""Fixed table layouts."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("market", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.FloatType()),
        T.StructField("high", T.FloatType()),
        T.StructField("low", T.FloatType()),
        T.StructField("close", T.FloatType()),
        T.StructField("volume", T.FloatType()),
    ]
)
BAR_COLUMNS = BARS.fieldNames()
PRICES = ["open", "high", "low", "close"]

EQUITY_CSV = "date date, equity double"
TRADES_CSV = (
    "entry_date date, exit_date date, ticker string, shares double, entry_price double, "
    "exit_price double, cost double, proceeds double, pnl double, return_pct double, "
    "exit_reason string"
)
ACTIONS_CSV = (
    "date date, ticker string, side string, reason string, price double, shares double, "
    "amount double, cash_after double"
)
HOLIDAYS = "date date, desc string, closed boolean"

# Payload layouts, named as the services send them.
CHART_JSON = (
    "chart struct<result: array<struct<"
    "meta: struct<gmtoffset: bigint>, timestamp: array<bigint>, "
    "indicators: struct<"
    "quote: array<struct<open: array<float>, high: array<float>, low: array<float>, "
    "close: array<float>, volume: array<float>>>, "
    "adjclose: array<struct<adjclose: array<float>>>>>>>"
)
QUOTE_JSON = (
    "symbol string, name string, openPrice double, highPrice double, lowPrice double, "
    "lastPrice double"
)
HOLIDAY_JSON = "array<struct<Name: string, Date: string, Description: string>>"
UNIVERSE_JSON = "map<string, struct<type: string>>"
POSITIONS_JSON = (
    "result string, status string, data array<struct<usid: bigint, stock_name: string, "
    "stock_code_id: string, shares: bigint, beginning_price: string, createtime: bigint, "
    "user_uid_id: bigint>>"
)

# Fixed vocabularies.
EXIT_REASONS = ["take_profit", "stop_loss", "time", "signal", "rotate", "final"]
BUY, SELL = "Buy", "Sell"
LOW_HIGH, OPEN_FILL = "low_high", "open"
