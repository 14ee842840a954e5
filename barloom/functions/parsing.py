"""Parsing of payload fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a named day as an open session, and the era offset.
OPEN_MARKERS = ["開始交易", "最後交易"]
ROC_OFFSET = 1911


def clean_number(text: Column) -> Column:
    """Number in ``text`` once currency signs, separators and blanks are gone."""
    return F.regexp_replace(text, "[^0-9.\\-]", "").try_cast("double")


def roc_date(text: Column) -> Column:
    """Date from ``YYYMMDD`` counted in the Republic era; null when it is not a date."""
    digits = F.trim(text)
    year = F.substring(digits, F.lit(1), F.length(digits) - 4).try_cast("int") + ROC_OFFSET
    tail = F.substring(digits, -4, 4)
    parts = [F.lpad(year.cast("string"), 4, "0"), F.substring(tail, 1, 2), F.substring(tail, 3, 2)]
    parsed = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
    return F.when(digits.rlike("^[0-9]{5,8}$"), parsed)


def is_closed(description: Column) -> Column:
    """A named day is closed unless its description marks the first or last session."""
    opens = F.lit(False)
    for marker in OPEN_MARKERS:
        opens = opens | description.contains(marker)
    return ~opens


def local_bar_date(epoch: Column, offset: Column) -> Column:
    """Calendar date at the exchange for an epoch in seconds."""
    return F.date_from_unix_date(F.floor((epoch + offset) / 86400).cast("int"))
