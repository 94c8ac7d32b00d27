"""Partial dates (``YYYY`` or ``YYYY-MM-DD`` as text), decades and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^[0-9]{4}(-[0-9]{2}-[0-9]{2})?\z"


def bound(value: Column, upper: bool = False) -> Column:
    """First or last day that a partial date can mean; null if it is no real date."""
    whole = F.when(F.length(value) == 4, F.concat(value, F.lit("-12-31" if upper else "-01-01"))).otherwise(value)
    real = value.rlike(SHAPE) & (F.substring(value, 1, 4) != "0000")
    return F.when(real, F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).cast("date"))


def calendar_ok(value: Column) -> Column:
    """True for null and real dates, false for impossible ones, null for a wrong shape."""
    return F.when(value.isNull(), True).when(value.rlike(SHAPE), bound(value).isNotNull())


def out_of_order(first: Column, last: Column) -> Column:
    """Whether the earliest day of ``first`` is after the latest of ``last``; null dates never are."""
    return F.coalesce(bound(first) > bound(last, upper=True), F.lit(False))


def year(value: Column) -> Column:
    """Four-digit year or null; other text is null too (see ``bad_year``)."""
    return F.when(value.rlike(r"^[0-9]{4}\z"), value.cast("int"))


def bad_year(value: Column) -> Column:
    return F.coalesce((value != "") & ~value.rlike(r"^[0-9]{4}\z"), F.lit(False))


def year_prefix(value: Column) -> Column:
    return F.substring(value, 1, 4)


def decade(of_year: Column) -> Column:
    return (F.floor(of_year / 10) * 10).cast("int")


def decades(first_year: Column, last_year: Column) -> Column:
    """All decades that a span of years meets."""
    last = F.greatest(first_year, F.coalesce(last_year, first_year))
    return F.sequence(decade(first_year), decade(last), F.lit(10))


def valid_decade(value: Column, through: int | None = None) -> Column:
    ok = (value % 10 == 0) & (value >= 1950)
    return ok & (value <= through) if through else ok


def instant(value: Column) -> Column:
    """UTC instant ``YYYY-MM-DDTHH:MM:SSZ`` or null."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z")
    return F.when(shaped, F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def now_text() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def photography_ok(value: Column) -> Column:
    """A year from 1800 to 2100, or a real date."""
    return F.when(F.length(value) == 4, F.coalesce(year(value).between(1800, 2100), F.lit(False))).otherwise(bound(value).isNotNull())


def candidate_date_problem(start: Column, end: Column) -> Column:
    """What is wrong with a start and end, else null."""
    return (
        F.when(start.isNotNull() & bound(start).isNull(), F.concat(F.lit("not a real date: "), start))
        .when(end.isNotNull() & bound(end).isNull(), F.concat(F.lit("not a real date: "), end))
        .when(end.isNotNull() & start.isNull(), F.lit("an end needs a start"))
        .when(out_of_order(start, end), F.lit("ends before it starts"))
    )


def straddle_problem(start: Column, end: Column, year_limit: int = 1950) -> Column:
    first, last = year(year_prefix(start)), year(year_prefix(F.coalesce(end, start)))
    return F.when((first < year_limit) & (last >= year_limit), F.lit(f"straddles {year_limit}")).when(first < year_limit, F.lit(f"before {year_limit}"))
