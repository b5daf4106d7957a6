"""Aggregate expressions with the conventions used everywhere here: a mean of nothing is 0, deviations divide by n, percentiles
interpolate between neighbours, weeks are weeks of the month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean0(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile(c: Column | str, p: float) -> Column:
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    return F.percentile(c, p / 100)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def share(cond: Column) -> Column:
    """Percent of the rows, 0 without rows."""
    return F.coalesce(F.try_divide(100.0 * F.count_if(cond), F.count(F.lit(1))), F.lit(0.0))


def week_of_month(ts: Column) -> Column:
    return F.ceil(F.dayofmonth(ts) / 7).cast("int")


def period_key(ts: Column, period: str) -> Column:
    """'2024-01-05', '2024-01-W1' or '2024-01'."""
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "week":
        return F.concat(F.date_format(ts, "yyyy-MM"), F.lit("-W"), week_of_month(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def period_start(ts: Column, period: str) -> Column:
    """First day of the day, of the week that starts on Sunday, or of the month."""
    day = F.to_date(ts)
    return {"day": day, "week": F.date_sub(day, F.dayofweek(day) - 1), "month": F.trunc(day, "month")}[period]
