"""The calendar arithmetic of period.py as Spark columns: integer expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Frequency, as_frequency, reject_unit

#: Day number of 1970-01-01.
EPOCH = 719_163


def floor_div(x: Column, n: int | Column) -> Column:
    """Quotient rounded down; SQL's own division of integers rounds towards zero."""
    return F.floor(x / n).cast("long")


def day_of(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") + EPOCH


def date_of(day: Column) -> Column:
    return F.date_from_unix_date((day - EPOCH).cast("int"))


def month_of(day: Column) -> Column:
    date = date_of(day)
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def month_start(month: Column) -> Column:
    return day_of(F.make_date(floor_div(month, 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1)))


def bday_of(day: Column, bias: str = "strict") -> Column:
    week, rest = floor_div(day, 7), F.pmod(day, F.lit(7))
    weekend = rest.isin(0, 6)
    if bias == "strict":
        moved = F.raise_error(F.lit("the date is on a weekend")).cast("long")
    else:
        sunday = 1 if bias in ("next", "nearest") else 0
        saturday = 6 if bias == "next" else 5
        moved = 5 * week + F.when(rest == 0, sunday).otherwise(saturday)
    return F.when(weekend, moved).otherwise(5 * week + rest).cast("long")


def bday_to_day(value: Column) -> Column:
    return value + 2 * floor_div(value - 1, 5)


def week_of(day: Column, end_day: int) -> Column:
    return floor_div(day + (13 - end_day), 7)


def containing(freq: Frequency, day: Column, bias: str = "nearest") -> Column:
    """Value of the period of freq that has the day in it."""
    if freq.is_monthly_based:
        return floor_div(month_of(day) + freq.shift, freq.months)
    if freq.kind == "Weekly":
        return week_of(day, freq.end)
    if freq.kind == "Daily":
        return day
    if freq.kind == "BDaily":
        return bday_of(day, bias)
    raise TypeError("Unit has no calendar")


def period_day(freq: Frequency, value: Column, ref: str = "end") -> Column:
    """First (ref begin) or last day of a period."""
    if freq.is_monthly_based:
        if ref == "begin":
            return month_start(value * freq.months - freq.shift)
        return month_start((value + 1) * freq.months - freq.shift) - 1
    if freq.kind == "Weekly":
        return 7 * value - (7 - freq.end) - (6 if ref == "begin" else 0)
    if freq.kind == "Daily":
        return value
    if freq.kind == "BDaily":
        return bday_to_day(value)
    raise TypeError("Unit has no calendar")


def from_date(freq: object, date: Column, bias: str = "nearest") -> Column:
    """Value of the period that has the date (or timestamp, in the session's zone) in it."""
    return containing(as_frequency(freq), day_of(date), bias)


def to_date(freq: object, value: Column, ref: str = "end") -> Column:
    return date_of(period_day(as_frequency(freq), value, ref))


def convert(target: object, source: object, value: Column, ref: str = "end", round_to: str = "current") -> Column:
    """As convert_period, for a column of values."""
    target, source = as_frequency(target), as_frequency(source)
    if target == source:
        return value
    reject_unit(target, source)
    if target.is_monthly_based and source.is_monthly_based:
        back = source.months - source.end_period
        if ref == "begin":
            return floor_div(value * source.months - back, target.months)
        return floor_div((value + 1) * source.months - back + target.months - 1, target.months) - 1
    bias = ("strict" if round_to == "current" else round_to) if target.kind == "BDaily" else "nearest"
    return containing(target, period_day(source, value, ref), bias)


def source_edge(source: Frequency, target: Frequency, value: Column, ref: str) -> Column:
    """The source period that anchors a target period's first or last day."""
    return containing(source, period_day(target, value, ref), "previous" if ref == "end" else "next")


def year(freq: object, value: Column) -> Column:
    freq = as_frequency(freq)
    if freq.is_monthly_based:
        return floor_div(value, 12 // freq.months)
    return floor_div(month_of(period_day(freq, value)), 12)


def period(freq: object, value: Column) -> Column:
    """Number within the year, from 1: of the period, the day, or the business day."""
    freq = as_frequency(freq)
    if freq.is_monthly_based:
        return F.pmod(value, F.lit(12 // freq.months)) + 1
    if freq.kind not in ("Daily", "BDaily"):
        raise TypeError(f"{freq} periods have no number in the year")
    first = month_start(year(freq, value) * 12)
    return value - containing(freq, first, "next") + 1


def as_float(freq: object, value: Column) -> Column:
    """Year and fraction of it."""
    freq = as_frequency(freq)
    n = 12 // freq.months
    return floor_div(value, n) + F.pmod(value, F.lit(n)) / n


def label(freq: object, value: Column) -> Column:
    """Text form, as str(period)."""
    freq = as_frequency(freq)
    mark = str(freq)[len(freq.kind) :]
    if freq.kind == "Unit":
        return F.concat(value.cast("string"), F.lit("U"))
    if not freq.is_monthly_based:
        return F.concat(F.date_format(to_date(freq, value), "yyyy-MM-dd"), F.lit(mark))
    sign = {"Yearly": "Y", "HalfYearly": "H", "Quarterly": "Q", "Monthly": "M"}[freq.kind]
    number = F.lit("") if freq.kind == "Yearly" else period(freq, value).cast("string")
    return F.concat(year(freq, value).cast("string"), F.lit(sign), number, F.lit(mark))
