"""Column functions on dates and periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def month_period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_period(ts: Column) -> Column:
    """Monday/Sunday range of the week, ``2024-03-04/2024-03-10``."""
    monday = F.to_date(F.date_trunc("week", ts))
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def month_axis_label(period: Column) -> Column:
    """``2024-03`` -> ``Mar '24``."""
    return F.date_format(F.to_date(F.concat(period, F.lit("-01"))), "MMM ''yy")


def ordinal_day(day: Column) -> Column:
    """Proleptic ordinal: day 1 is 0001-01-01."""
    return F.unix_date(day) + F.lit(719163)
