"""Registration of queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.catalog.tables import CTES
from barloom.functions.signals import is_finite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Rounding by floor gives the same bits in both engines and stays in generated code. Values halfway
# between two roundings would still fall either way; a relative nudge far above the noise of
# summation order, and far below the digits compared, settles them on both sides.
NUDGE = 1.00000000001


def scale(digits: int) -> float:
    return float(10**digits)


def r(expr: str, digits: int = 4) -> str:
    """SQL rounding to compare floats by."""
    unit = scale(digits)
    shifted = f"CAST({expr} AS DOUBLE) * CAST({unit * NUDGE!r} AS DOUBLE) + 0.5"
    return f"floor({shifted}) / CAST({unit!r} AS DOUBLE)"


def rounded(value: Column, digits: int) -> Column:
    """The same rounding on the Spark side."""
    unit, wide = scale(digits), value.cast("double")
    units = F.try_divide(F.floor(wide * (unit * NUDGE) + 0.5), F.lit(unit))
    # NaN and the infinities stay what they are, as they do in SQL.
    return F.when(is_finite(wide), units).otherwise(wide)


def tidy(df: DataFrame, digits: int = 4, **own: int | None) -> DataFrame:
    """Round every float column; ``own`` gives columns digits of their own, or None for as is."""

    def column(field: T.StructField) -> Column:
        if not isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.col(field.name)
        places = own.get(field.name, digits)
        value = F.col(field.name)
        return (value.cast("double") if places is None else rounded(value, places)).alias(field.name)

    return df.select(*[column(field) for field in df.schema])


def with_tables(uses: str | Sequence[str], sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named derived tables and those they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = CTES[name]
        for need in needs.split():
            visit(need)
        if name not in order:
            order.append(name)

    for name in uses.split() if isinstance(uses, str) else uses:
        visit(name)
    if not order:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + sql


def query(name: str, uses: str = "", sql: str | None = None, recursive: bool = False):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(uses, sql, recursive)
        return fn

    return register
