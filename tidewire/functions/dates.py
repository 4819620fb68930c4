"""Periods and dates, cut in UTC; ``as_of`` stands for the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-q"), F.quarter(ts).cast("string"))


def year_key(ts: Column) -> Column:
    return F.year(ts).cast("string")


KEYS = {"month": month_key, "quarter": quarter_key, "year": year_key}


def period_start(key: Column) -> Column:
    """First day of a month, quarter or year key."""
    year = F.substring(key, 1, 4)
    month = F.when(key.rlike("-q[1-4]$"), (F.substring(key, -1, 1).cast("int") - 1) * 3 + 1).when(key.rlike(r"-\d\d$"), F.substring(key, 6, 2).cast("int")).otherwise(1)
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def period_end(key: Column) -> Column:
    """First day after a period."""
    months = F.when(key.rlike("-q[1-4]$"), 3).when(key.rlike(r"-\d\d$"), 1).otherwise(12)
    return F.add_months(period_start(key), months)


def quarter_months(key: Column) -> Column:
    """The three month keys of a quarter."""
    first = period_start(key)
    return F.transform(F.sequence(first, F.add_months(first, 2), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def period_label(key: Column, short: bool = False) -> Column:
    """``July 2026`` (``Jul 2026``), ``Q3 2026`` or ``2026``."""
    month = F.date_format(period_start(key), "MMM yyyy" if short else "MMMM yyyy")
    return F.when(key.rlike("-q[1-4]$"), F.concat(F.lit("Q"), F.substring(key, -1, 1), F.lit(" "), F.substring(key, 1, 4))).when(key.rlike(r"-\d\d$"), month).otherwise(key)


def is_open(key: Column, as_of: Column) -> Column:
    """The period has not ended."""
    return (F.to_date(as_of) >= period_start(key)) & (F.to_date(as_of) < period_end(key))


def is_truncated(key: Column, first: Column) -> Column:
    """The period begins before the archive does."""
    return period_start(key) < F.to_date(first)


def full_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


#: Formats feeds use, each with a shape that all it reads have: a format that does not fit is not tried, as a failed try costs far more
#: than the shape.
_FEED_FORMATS = [
    (r"^\S+ \S+ \S+ [^\s:]+:[^\s:]+:[^\s:]+ \S+$", "d MMM yyyy HH:mm:ss Z"),
    (r"^\S+ \S+ \S+ [^\s:]+:[^\s:]+ \S+$", "d MMM yyyy HH:mm Z"),
    (r"^[^\s.]+[Tt][^\s.]+\d$", "yyyy-MM-dd'T'HH:mm:ssZ"),
    (r"^[^\s.]+[Tt][^\s.]+\.\S+\d$", "yyyy-MM-dd'T'HH:mm:ss.SSSZ"),
    (r"^[^\s.]+[Tt][^\s.]+[Zz]$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (r"^[^\s:Tt]+$", "yyyy-MM-dd"),
]


def parse_feed_time(*fields: Column) -> Column:
    """The first field that is a date, in the formats feeds use; null where none is."""

    def read(bare: Column) -> Column:
        return F.coalesce(*[F.when(bare.rlike(shape), F.try_to_timestamp(bare, F.lit(p))) for shape, p in _FEED_FORMATS])

    def once(f: Column, then) -> Column:
        return F.element_at(F.transform(F.array(f), then), 1)  # the text is made once, not once a format

    def told(f: Column) -> Column:
        bare = F.regexp_replace(F.trim(f), r"^[A-Za-z]{3,9},\s*", "")
        bare = F.regexp_replace(F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000"), r"([+-]\d\d):(\d\d)$", "$1$2")
        return F.when(f != "", once(bare, read))

    return F.coalesce(*[once(f, told) for f in fields])


def time_ago(ts: Column, as_of: Column) -> Column:
    """``just now`` under 90 seconds, then minutes, hours, days under a week, then the date."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 90, "just now").when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).when(s < 7 * 86400, part(86400, "d ago")).otherwise(short_date(ts))


def local_date(ts: Column, zone: str = "America/Chicago") -> Column:
    """Calendar day in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def mailable(day: Column) -> Column:
    """A real date, Monday to Friday."""
    d = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.weekday(d) < 5, F.lit(False))


def recency(ts: Column, as_of: Column, hours: float = 24.0) -> Column:
    """1 now, 1/e after ``hours``."""
    return F.exp(-(F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / (3600.0 * hours))


def days_apart(a: Column, b: Column) -> Column:
    """Days between two times; an undated side counts as no distance."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86400e6, F.lit(0.0))


def year_gap(filed: Column, announced: Column, tolerance: int = 1) -> Column:
    """Filed more than ``tolerance`` years after it was announced."""
    return F.coalesce(F.year(filed) - announced.cast("int") > tolerance, F.lit(False))


def month_windows(spark, as_of: str, count: int):
    """``(after, before)`` of the last ``count`` calendar months, newest first."""
    first = F.trunc(F.lit(as_of).cast("date"), "month")
    months = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    return months.select(F.add_months(first, -F.col("i")).alias("after"), F.add_months(first, 1 - F.col("i")).alias("before")).orderBy(F.col("after").desc())
