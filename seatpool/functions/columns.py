"""Column expressions shared by the operators (functions F1 to F13)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from seatpool import schemas as S


def parse_day(text, pattern: str = S.ISO_DAY) -> Column:
    """a day from text; null where the text is no such day."""
    return F.try_to_date(F.col(text) if isinstance(text, str) else text, pattern)


def format_day(day, pattern: str = S.ISO_DAY) -> Column:
    """a day as text."""
    return F.date_format(day, pattern)


def format_hour(moment) -> Column:
    """a moment as its full hour."""
    return F.date_format(moment, S.HOUR)


def composite_key(*parts) -> Column:
    """parts joined by underscores; days in ISO form."""
    return F.concat_ws("_", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def ticket_price(total: Column, tickets: Column) -> Column:
    """a quarter above the mean bid, rounded up, exact for whole numbers and decimals."""
    numerator = total * 5
    denominator = tickets * 4
    whole = F.call_function("div", numerator, denominator)
    return (whole + F.when(numerator % denominator > 0, 1).otherwise(0)).cast("bigint")


def today(now, zone: str = S.USER_ZONE) -> Column:
    """the day it is in ``zone`` at the moment ``now`` (UTC)."""
    return F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone))


def hours_after(day: Column, hours: Column) -> Column:
    """a moment some hours after the start of a day."""
    return day.cast("timestamp") + F.make_dt_interval(hours=hours)


def sized(*factors) -> int:
    """a row count from multipliers, halves to even."""
    product = 1.0
    for factor in factors:
        product *= factor
    return round(product)


def percent(part: Column, whole: Column) -> Column:
    """F12."""
    return part / whole * 100


def first_reason(checks: Iterable[tuple[Column, str]]) -> Column:
    """The text of the first check that fails, or null. A null check counts as failed."""
    return F.coalesce(
        *[F.when(~F.coalesce(passed, F.lit(False)), reason) for passed, reason in checks]
    )
