"""Queries of the payload decoders. Payloads are built from the tables, then decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.history import listing
from barloom.catalog.registry import query, r, tidy
from barloom.functions import parsing
from barloom.session import scratch_path
from barloom.sources import payloads
from barloom.sources.history import read_holidays

GMT_OFFSET = 28800
MEMBERS = 1000  # codes per listing payload


def epoch(date):
    """Nine o'clock at the exchange."""
    return F.unix_date(date).cast("long") * 86400 + 9 * 3600 - GMT_OFFSET


def chart_payloads(spark, sf):
    """One chart response per code; a code has one entry per day."""
    series = ["open", "high", "low", "close", "volume", "adjclose"]
    day = F.struct("date", *series)
    grouped = t.raw_bars(spark, sf).groupBy("code").agg(
        F.array_sort(F.collect_list(day)).alias("days")
    )

    def column(name):
        return F.transform("days", lambda d: d[name])

    quote = F.struct(*[column(name).alias(name) for name in series[:-1]])
    result = F.struct(
        F.struct(F.lit(GMT_OFFSET).alias("gmtoffset"), F.lit("TWD").alias("currency")).alias("meta"),
        F.transform("days", lambda d: epoch(d["date"])).alias("timestamp"),
        F.struct(
            F.array(quote).alias("quote"),
            F.array(F.struct(column("adjclose").alias("adjclose"))).alias("adjclose"),
        ).alias("indicators"),
    )
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return grouped.select("code", F.to_json(chart).alias("json"))


@query(
    "decode_chart_json",
    "raw_bars",
    "SELECT code, date, "
    + ", ".join(
        f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "adjclose")
    )
    + " FROM raw_bars",
)
def decode_chart(spark, sf):
    return tidy(payloads.decode_chart(chart_payloads(spark, sf)))


@query(
    "reject_chart",
    "raw_bars",
    """SELECT code, CASE CAST(substr(code, 2) AS BIGINT) % 3 WHEN 0 THEN 'no chart data'
        ELSE 'no adjclose series' END AS error
        FROM (SELECT DISTINCT code FROM raw_bars) WHERE CAST(substr(code, 2) AS BIGINT) % 3 < 2""",
)
def reject_chart(spark, sf):
    """Payloads of which a third have no result and a third no adjusted series."""
    kind = F.substring("code", 2, 20).cast("long") % 3
    broken = F.when(kind == 0, F.lit('{"chart": {"result": []}}')).when(
        kind == 1, F.replace("json", F.lit('"adjclose":[{'), F.lit('"other":[{'))
    )
    landed = chart_payloads(spark, sf).withColumn("json", F.coalesce(broken, "json"))
    return payloads.reject_chart(landed).select("code", "error")


QUOTE_COLUMNS = ("open_price", "high_price", "low_price", "last_price")


@query(
    "decode_quote_json",
    "quotes",
    "SELECT symbol, 'name of ' || symbol AS name, "
    + ", ".join(f"{r(c)} AS {c}" for c in QUOTE_COLUMNS)
    + " FROM quotes",
)
def decode_quotes(spark, sf):
    sent = t.quotes(spark, sf).select(
        F.to_json(
            F.struct(
                "symbol",
                F.concat(F.lit("name of "), "symbol").alias("name"),
                F.col("open_price").alias("openPrice"),
                F.col("high_price").alias("highPrice"),
                F.col("low_price").alias("lowPrice"),
                F.col("last_price").alias("lastPrice"),
                F.array(F.struct(F.lit(1).alias("size"))).alias("bids"),
            )
        ).alias("json")
    )
    return tidy(payloads.decode_quotes(sent))


def roc_text(date):
    return F.concat((F.year(date) - parsing.ROC_OFFSET).cast("string"), F.date_format(date, "MMdd"))


@query(
    "decode_holiday_json",
    "schedule",
    'SELECT date, name AS "desc", closed FROM schedule',
)
def decode_holidays(spark, sf):
    """One schedule per year, with an entry whose date does not exist."""
    entry = F.struct(
        F.col("name").alias("Name"),
        roc_text(F.col("date")).alias("Date"),
        F.col("description").alias("Description"),
    )
    broken = F.array(
        F.struct(F.lit("x").alias("Name"), F.lit("1151340").alias("Date"),
                 F.lit("").alias("Description"))
    )
    years = t.schedule(spark, sf).groupBy(F.year("date").alias("year")).agg(
        F.to_json(F.concat(F.collect_list(entry), broken)).alias("json")
    )
    return payloads.decode_holidays(years.select("json"))


@query(
    "decode_universe_json",
    "",
    """SELECT 'S' || s_suppkey AS code,
        ['TWSE', 'ETF', 'OTC', 'ESB', 'TWSE'][n_regionkey + 1] AS type
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def decode_universe(spark, sf):
    shard = F.floor(F.substring("code", 2, 20).cast("long") / MEMBERS)
    listed = listing(spark, sf).groupBy(shard.alias("shard")).agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct("code", F.struct("name", "type"))))
        ).alias("json")
    )
    return payloads.decode_universe(listed.select("json"))


@query(
    "decode_positions_json",
    "bars markets",
    f"""SELECT CAST(epoch(date) + 3600 AS BIGINT) AS usid, 'stock ' || code AS stock_name,
        code AS stock_code_id, CAST(volume AS BIGINT) AS shares,
        {r('close')} AS beginning_price, CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR AS createtime,
        CAST(substr(code, 2) AS BIGINT) AS user_uid_id FROM bars JOIN markets USING (code)
        WHERE market = 'tse'""",
)
def decode_positions(spark, sf):
    """One envelope per code and month; those of one market fail."""
    opened = (F.unix_date("date").cast("long") * 86400 + 3600).alias("createtime")
    position = F.struct(
        opened.alias("usid"),
        F.concat(F.lit("stock "), "code").alias("stock_name"),
        F.col("code").alias("stock_code_id"),
        F.col("volume").cast("long").alias("shares"),
        F.col("close").cast("double").cast("string").alias("beginning_price"),
        opened.alias("createtime"),
        F.substring("code", 2, 20).cast("long").alias("user_uid_id"),
    )
    months = t.history(spark, sf).groupBy("code", "market", F.trunc("date", "MM")).agg(
        F.collect_list(position).alias("data")
    )
    ok = F.to_json(F.struct(F.lit("success").alias("result"), F.lit("ok").alias("status"), "data"))
    failed = F.to_json(F.struct(F.lit("failed").alias("result"), F.lit("no").alias("status")))
    sent = months.select(F.when(F.col("market") == "tse", ok).otherwise(failed).alias("json"))
    # Plain wall-clock time for the comparison.
    decoded = payloads.decode_positions(sent)
    return tidy(decoded.withColumn("createtime", F.col("createtime").cast("timestamp_ntz")))


LABELS = {"usable_cash": "可用餘額", "cumulative_return": "累積報酬率", "trade_count": "交易成功次數"}


@query(
    "extract_labelled_values",
    "",
    f"""SELECT page_id, {r('length(url) * 1234567 + page_id')} AS usable_cash,
        {r('-(length(url) / 1000.0)')} AS cumulative_return,
        CASE WHEN length(html) % 2 = 0 THEN {r('length(html)')} END AS trade_count FROM pages""",
)
def extract_labelled(spark, sf):
    """Whole pages that end in an account dashboard; some lack a field."""
    cash = F.format_number(F.length("url") * 1234567 + F.col("page_id"), 0)
    gain = F.format_string("%.3f", -(F.length("url") / 1000.0))
    count = F.concat(
        F.lit("<div>交易成功次數</div><div>"), F.length("html").cast("string"), F.lit("</div>")
    )
    page = F.concat(
        "html",
        F.lit("<div><div class='k'> 可用餘額 </div>\n<div class='v'>$ "),
        cash,
        F.lit("</div></div><div><div><b>累積報酬率</b></div> <!-- x --> <span>"),
        gain,
        F.lit("%</span></div>"),
        F.when(F.length("html") % 2 == 0, count).otherwise(F.lit("")),
    )
    sent = t.table(spark, sf, "pages").select("page_id", page.alias("html"))
    return tidy(payloads.extract_labelled(sent, "html", LABELS).select("page_id", *LABELS))


@query("read_holiday_years", "schedule", 'SELECT date, name AS "desc", closed FROM schedule')
def read_holiday_years(spark, sf):
    path = scratch_path(spark, "holidays")
    named = t.holidays(spark, sf)
    named.repartition(F.year("date")).write.json(path)
    return read_holidays(spark, path)


@query("roc_date", "bars", "SELECT code, date AS date FROM bars")
def roc_date(spark, sf):
    text = t.bars(spark, sf).select("code", roc_text(F.col("date")).alias("text"))
    return text.select("code", parsing.roc_date(F.col("text")).alias("date"))


@query("is_closed", "schedule", "SELECT date, closed FROM schedule")
def is_closed(spark, sf):
    return t.schedule(spark, sf).select(
        "date", parsing.is_closed(F.col("description")).alias("closed")
    )


@query(
    "local_bar_date",
    "",
    "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date FROM events",
)
def local_bar_date(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    date = parsing.local_bar_date(seconds, F.lit(GMT_OFFSET))
    return t.table(spark, sf, "events").select("event_id", date.alias("date"))


@query(
    "clean_number",
    "",
    f"SELECT o_orderkey, {r('o_totalprice')} AS number FROM orders",
)
def clean_number(spark, sf):
    text = F.concat(F.lit(" $ "), F.format_number("o_totalprice", 2), F.lit(" %\n"))
    return tidy(
        t.table(spark, sf, "orders").select(
            "o_orderkey", parsing.clean_number(text).alias("number")
        )
    )
