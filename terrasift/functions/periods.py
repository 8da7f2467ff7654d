"""Half-month periods as integers and strings.

A period's ordinal is ``year * 24 + (month - 1) * 2 + (day > 15)``; all time
arithmetic is integer arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PER_YEAR = 24
ZONE = "America/Los_Angeles"


def ordinal_of_date(day: Column) -> Column:
    """Ordinal of a date or timestamp by its own calendar fields."""
    return (F.year(day) * 24 + (F.month(day) - 1) * 2 + F.when(F.dayofmonth(day) > 15, 1).otherwise(0)).cast("int")


def ordinal_of_instant(utc: Column, zone: str = ZONE) -> Column:
    """Ordinal of a UTC timestamp without zone, by wall clock in ``zone``."""
    return ordinal_of_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")))


def period_name(ordinal: Column) -> Column:
    """``YYYY-MM-H1`` or ``-H2``."""
    year, rest = F.floor(ordinal / 24), F.pmod(ordinal, F.lit(24))
    return F.format_string("%04d-%02d-H%d", year.cast("int"), (F.floor(rest / 2) + 1).cast("int"), (rest % 2 + 1).cast("int"))


def ordinal_of_name(name: Column) -> Column:
    """Inverse of ``period_name``; null for what is no period."""
    y, m, h = (F.regexp_extract(name, r"^(\d{4})-(\d{2})-H([12])$", k) for k in (1, 2, 3))
    value = y.try_cast("int") * 24 + (m.try_cast("int") - 1) * 2 + h.try_cast("int") - 1
    return F.when(name.rlike(r"^\d{4}-(0[1-9]|1[0-2])-H[12]$"), value).cast("int")


def period_start(ordinal: Column) -> Column:
    rest = F.pmod(ordinal, F.lit(24))
    return F.make_date(F.floor(ordinal / 24).cast("int"), (F.floor(rest / 2) + 1).cast("int"), F.when(rest % 2 == 0, 1).otherwise(16))


def period_end(ordinal: Column) -> Column:
    """The first day after the period."""
    return period_start(ordinal + 1)


def period_days(ordinal: Column) -> Column:
    return F.datediff(period_end(ordinal), period_start(ordinal))


def lenient_date(text: Column) -> Column:
    """The first ten characters as an ISO date, else null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def calendar(spark: SparkSession, low: int, high: int) -> DataFrame:
    """All periods from ``low`` to ``high``, both included."""
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias("ord")).withColumn("period", period_name(F.col("ord")))
