"""Decoders of landed service payloads: one text column in, typed rows out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.parsing import clean_number, is_closed, local_bar_date, roc_date

SERIES = ["open", "high", "low", "close", "volume", "adjclose"]


def parse_chart(df: DataFrame, payload: str = "json") -> DataFrame:
    """Parsed chart payloads with the first result's series, and ``error`` where it has none."""
    first = F.get(F.from_json(F.col(payload), schemas.CHART_JSON)["chart"]["result"], F.lit(0))
    parsed = df.withColumn("_result", first)
    quote = F.get(F.col("_result.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("_result.indicators.adjclose"), F.lit(0))
    taken = parsed.withColumns({"_quote": quote, "_adj": adjusted["adjclose"]})
    times = F.col("_result.timestamp")
    series = [F.col("_adj") if name == "adjclose" else F.col("_quote")[name] for name in SERIES]
    uneven = reduce(
        lambda a, b: a | b, [F.coalesce(F.size(s) != F.size(times), F.lit(True)) for s in series]
    )
    error = (
        F.when(F.col("_result").isNull(), "no chart data")
        .when(F.col("_quote").isNull(), "no quote series")
        .when(F.col("_adj").isNull(), "no adjclose series")
        .when(times.isNull() | F.col("_result.meta.gmtoffset").isNull(), "no timestamps")
        .when(uneven, "uneven series")
    )
    return taken.withColumn("error", error)


def decode_chart(df: DataFrame, payload: str = "json") -> DataFrame:
    """Unadjusted bars, one row per timestamp, next to the other columns of ``df``.

    Prices may be null. Payloads with an error are left out; :func:`reject_chart` has them.
    """
    keep = [c for c in df.columns if c != payload]
    good = parse_chart(df, payload).filter(F.col("error").isNull())
    zipped = F.arrays_zip(
        F.col("_result.timestamp").alias("ts"),
        *[F.col("_quote")[name].alias(name) for name in SERIES[:-1]],
        F.col("_adj").alias("adjclose"),
    )
    return (
        good.select(*keep, F.col("_result.meta.gmtoffset").alias("_offset"), F.inline(zipped))
        .withColumn("date", local_bar_date(F.col("ts"), F.col("_offset")))
        .select(*keep, "date", *SERIES)
    )


def reject_chart(df: DataFrame, payload: str = "json") -> DataFrame:
    """Payloads that hold no bars, with the reason in ``error``."""
    return parse_chart(df, payload).filter(F.col("error").isNotNull()).select(*df.columns, "error")


def decode_quotes(df: DataFrame, payload: str = "json") -> DataFrame:
    """Live quotes; unknown fields are ignored and prices may be null."""
    keep = [c for c in df.columns if c != payload]
    quote = F.from_json(F.col(payload), schemas.QUOTE_JSON)
    return (
        df.withColumn("_q", quote)
        .filter(F.col("_q.symbol").isNotNull())
        .select(
            *keep,
            F.col("_q.symbol").alias("symbol"),
            F.col("_q.name").alias("name"),
            F.col("_q.openPrice").alias("open_price"),
            F.col("_q.highPrice").alias("high_price"),
            F.col("_q.lowPrice").alias("low_price"),
            F.col("_q.lastPrice").alias("last_price"),
        )
    )


def decode_holidays(df: DataFrame, payload: str = "json") -> DataFrame:
    """Named days of the schedule; rows whose date does not parse are dropped."""
    keep = [c for c in df.columns if c != payload]
    rows = df.select(*keep, F.inline(F.from_json(F.col(payload), schemas.HOLIDAY_JSON)))
    return rows.select(
        *keep,
        roc_date(F.col("Date")).alias("date"),
        F.col("Name").alias("desc"),
        is_closed(F.coalesce("Description", F.lit(""))).alias("closed"),
    ).filter(F.col("date").isNotNull())


def decode_universe(df: DataFrame, payload: str = "json") -> DataFrame:
    """Listed codes with their type, from an object keyed by code."""
    keep = [c for c in df.columns if c != payload]
    entries = F.explode(F.from_json(F.col(payload), schemas.UNIVERSE_JSON)).alias("code", "_entry")
    return df.select(*keep, entries).select(*keep, "code", F.col("_entry.type").alias("type"))


def decode_positions(df: DataFrame, payload: str = "json") -> DataFrame:
    """Positions of the successful envelopes; the price arrives as quoted text."""
    keep = [c for c in df.columns if c != payload]
    envelope = F.from_json(F.col(payload), schemas.POSITIONS_JSON)
    rows = (
        df.withColumn("_e", envelope)
        .filter(F.col("_e.result") == "success")
        .select(*keep, F.inline("_e.data"))
    )
    return rows.withColumns(
        {
            "beginning_price": F.col("beginning_price").try_cast("double"),
            "createtime": F.timestamp_seconds("createtime"),
        }
    )


def _following_text(html: Column, label: str) -> Column:
    """Text of the element after the ``div`` whose text is ``label``."""
    # Inline tags and blanks may surround the label; text may follow its div. The value runs to the
    # closing tag of its own element. Comments go first, and every repeat is possessive, so that the
    # match neither steps back nor nests however much text a page has.
    pad = r"(?:\s++|<(?!/?div\b)[^>]*+>)*+"
    pattern = (
        rf"(?is)<div\b[^>]*+>{pad}\Q{label}\E{pad}</div>[^<]*+"
        r"<([a-z][a-z0-9]*+)\b[^>]*+>(.*?)</\1\s*+>"
    )
    found = F.regexp_extract(F.regexp_replace(html, "(?s)<!--.*?-->", ""), pattern, 2)
    return F.regexp_replace(found, "<[^>]*>", "")


def extract_labelled(df: DataFrame, html: str, labels: Mapping[str, str]) -> DataFrame:
    """Number that follows each label of a page, one column per entry of ``labels``.

    ``labels`` maps column names to label texts. A missing label, or a value that is not a
    number, gives null.
    """
    values = {
        name: F.when(F.col(html).contains(label), clean_number(_following_text(F.col(html), label)))
        for name, label in labels.items()
    }
    return df.withColumns(values)
