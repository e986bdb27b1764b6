"""Sums of floating-point numbers that a threshold or rounding follows: their last digits count, and these depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, total, n, rows): values added one after the other in order of a key, as by a reader of the table; n without nulls.

    A running sum over a sorted window, which spills: no group is held as a list.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = rows.select(*by, F.sum(value).over(upto).alias("total"), F.count(value).over(upto).alias("n"), F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("rows"))
    return t.groupBy(*by).agg(F.max_by("total", "rows").alias("total"), F.max("n").alias("n"), F.max("rows").cast("long").alias("rows"))


def totals(rows: DataFrame, by: list[str], value: str, order: str, close: Column) -> DataFrame:
    """(by, total, n, rows) by partial sums; groups for which close holds, a condition on total and n, are added again in order.

    Without that the last digit would be by how rows were dealt to tasks. close has to be wider than a sum's error.
    """
    rough = rows.groupBy(*by).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.count("*").alias("rows"))
    near = F.coalesce(close, F.lit(False))
    asked = rough.where(near).select(*(F.col(c).alias(f"near_{c}") for c in by))
    same = [F.col(c).eqNullSafe(F.col(f"near_{c}")) for c in by]
    return rough.where(~near).unionByName(in_order(rows.join(asked, same, "left_semi"), by, value, order))
