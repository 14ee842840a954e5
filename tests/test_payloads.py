import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import parsing
from barloom.operators.history import adjust, route_market
from barloom.sources import payloads


def frame(spark, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "id int, json string")


def chart(times, adjclose=True, quote=True, **series):
    indicators = {"quote": [series] if quote else [], "adjclose": []}
    if adjclose:
        indicators["adjclose"] = [{"adjclose": series["close"]}]
    result = {"meta": {"gmtoffset": 28800, "x": 1}, "timestamp": times, "indicators": indicators}
    return {"chart": {"result": [result, {}], "error": None}}


SERIES = {n: [1.5, None] for n in ("open", "high", "low", "close", "volume")}
TIMES = [1704067200, 1704153600]


def test_chart(spark):
    rows = payloads.decode_chart(frame(spark, chart(TIMES, **SERIES))).orderBy("date").collect()
    assert [r.date for r in rows] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert (rows[0].open, rows[0].adjclose, rows[1].close) == (1.5, 1.5, None)
    assert adjust(payloads.decode_chart(frame(spark, chart(TIMES, **SERIES)))).count() == 1


def test_chart_rejects(spark):
    bad = frame(
        spark,
        {"chart": {"result": []}},
        {"chart": {"result": None, "error": "x"}},
        chart(TIMES, quote=False, adjclose=False),
        chart(TIMES, adjclose=False, **SERIES),
        chart(TIMES[:1], **SERIES),
        "not json",
        chart(TIMES, **SERIES),
    )
    errors = {r.id: r.error for r in payloads.reject_chart(bad).collect()}
    assert errors == {
        0: "no chart data", 1: "no chart data", 2: "no quote series", 3: "no adjclose series",
        4: "uneven series", 5: "no chart data",
    }
    assert payloads.decode_chart(bad).select("id").distinct().collect() == [(6,)]


def test_quotes(spark):
    df = frame(spark, {"symbol": "2330", "openPrice": 10.5, "bids": [{"price": 1}]})
    row = payloads.decode_quotes(df).first()
    assert (row.symbol, row.name, row.open_price, row.last_price) == ("2330", None, 10.5, None)


def test_holidays(spark):
    doc = [
        {"Name": "a", "Date": "1150101", "Description": "依規定放假1日。"},
        {"Name": "b", "Date": "1150102", "Description": "國曆新年開始交易。"},
        {"Name": "c", "Date": "1151340", "Description": ""},
        {"Name": "d", "Date": "1150211", "Description": "農曆春節前最後交易。"},
    ]
    rows = payloads.decode_holidays(frame(spark, doc)).orderBy("date").collect()
    assert [(r.date, r.desc, r.closed) for r in rows] == [
        (dt.date(2026, 1, 1), "a", True),
        (dt.date(2026, 1, 2), "b", False),
        (dt.date(2026, 2, 11), "d", False),
    ]


def test_universe(spark):
    df = frame(spark, {"2330": {"name": "x", "type": "TWSE"}, "1": {"name": "y", "type": "ESB"}})
    listed = payloads.decode_universe(df)
    assert listed.count() == 2
    row = route_market(listed).first()
    assert (row.code, row.market, row.symbol) == ("2330", "tse", "2330.TW")


def test_positions(spark):
    held = {"usid": 1, "stock_name": "x", "stock_code_id": "2330", "shares": 3,
            "beginning_price": "34.40000", "createtime": 1704067200, "user_uid_id": 9}
    df = frame(spark, {"result": "success", "status": "ok", "data": [held, held]},
               {"result": "failed", "status": "no"})
    rows = payloads.decode_positions(df).collect()
    assert len(rows) == 2 and rows[0].beginning_price == 34.4 and rows[0].id == 0
    assert rows[0].createtime == dt.datetime(2024, 1, 1)


def test_labelled_values(spark):
    labels = {"cash": "可用餘額", "assets": "資產總額", "gain": "累積報酬率", "count": "交易成功次數"}
    html = (
        "<div><div>可用餘額</div><div>$22,606,117</div></div>\n"
        "<div><div class='k'> 資產總額 </div> <div><b>$ 101,906,017</b></div></div>\n"
        "<div><div>累積報酬率</div><!-- n --><span>1.906%</span></div>"
        "<div>前 交易成功次數</div><div>7</div>"
    )
    row = payloads.extract_labelled(
        spark.createDataFrame([(html,)], "html string"), "html", labels
    ).first()
    assert (row.cash, row.assets, row.gain, row["count"]) == (22606117.0, 101906017.0, 1.906, None)


def test_labelled_values_on_large_pages(spark):
    text = "words <b>and</b> more " * 50_000
    pages = [
        f"{text}<div>cash</div>{'x ' * 250_000}<p>12</p>{text}",
        f"<div>cash</div>{'<!-- note -->' * 20_000}<p>13</p>",
        f"<div>cash</div><p>{text}",  # never closed
        f"<div>{'<i> </i>' * 50_000}cash</div> <p>14</p>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    rows = payloads.extract_labelled(df, "html", {"cash": "cash"}).orderBy("i").collect()
    assert [r.cash for r in rows] == [12.0, 13.0, None, 14.0]


@pytest.mark.parametrize(
    "text, value",
    [("$22,606,117", 22606117.0), ("$ 101,906,017", 101906017.0), ("1.906%", 1.906),
     ("61", 61.0), ("--", None), ("none", None)],
)
def test_clean_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parsing.clean_number(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(
    "text, date",
    [("1150101", dt.date(2026, 1, 1)), (" 840102 ", dt.date(1995, 1, 2)), ("1150230", None),
     ("0101", None), ("11501x1", None), ("", None)],
)
def test_roc_date(spark, text, date):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parsing.roc_date(F.col("t"))).first()[0] == date


def test_local_date(spark):
    df = spark.createDataFrame([(1704067200, 28800), (-1, 0)], "ts bigint, off bigint")
    got = [r[0] for r in df.select(parsing.local_bar_date(F.col("ts"), F.col("off"))).collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(1969, 12, 31)]
