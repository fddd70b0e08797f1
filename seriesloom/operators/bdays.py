"""Business days: holiday maps, filters and the filling-in of missing values after a shift.

A holiday map says of every business day in a range whether business is done. It is made on the driver and bounded, so that
joining it broadcasts a table of proven size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.frequency import BDaily
from seriesloom.functions.ieee import to_nan
from seriesloom.functions.period import Period, PeriodRange, bday_of, bday_to_day, day_number
from seriesloom.operators import windows
from seriesloom.plans import options
from seriesloom.plans.frame import SeriesFrame

#: Longest map, about 400 years.
MOST_DAYS = 104_000


@dataclass(frozen=True)
class HolidayMap:
    """is_open[i]: whether business is done on the i-th business day from ``first`` on."""

    first: Period
    is_open: tuple[bool, ...] = field(repr=False)

    def __post_init__(self) -> None:
        if self.first.freq != BDaily():
            raise TypeError(f"a holiday map is business-daily, got {self.first.freq}")
        object.__setattr__(self, "is_open", tuple(map(bool, self.is_open)))
        if len(self.is_open) > MOST_DAYS:
            raise ValueError(f"a holiday map has at most {MOST_DAYS} days")

    @property
    def range(self) -> PeriodRange:
        return PeriodRange(self.first, self.first + (len(self.is_open) - 1))

    @classmethod
    def from_holidays(cls, holidays: Iterable[dt.date | str], first: dt.date | str = "1970-01-01", last: dt.date | str = "2049-12-31") -> HolidayMap:
        """Open on all weekdays of a range but the dates given; dates on weekends change nothing."""
        a, b = bday_of(day_number(first), "next"), bday_of(day_number(last), "previous")
        closed = set()
        for date in holidays:
            day = day_number(date)
            if day % 7 not in (0, 6):
                closed.add(bday_of(day))
        return cls(Period(BDaily(), a), tuple(v not in closed for v in range(a, b + 1)))

    @classmethod
    def from_country(cls, country: str, subdivision: str | None = None, first: str = "1970-01-01", last: str = "2049-12-31") -> HolidayMap:
        """By the package ``holidays``, where it is installed."""
        try:
            import holidays
        except ImportError as e:
            raise ImportError("HolidayMap.from_country needs the package holidays; use from_holidays with a list of dates") from e
        years = range(dt.date.fromisoformat(first).year, dt.date.fromisoformat(last).year + 1)
        return cls.from_holidays(holidays.country_holidays(country, subdiv=subdivision, years=years).keys(), first, last)

    def covers(self, rng: PeriodRange, pad: int = 0) -> None:
        own = self.range
        if rng and (rng.first.value - pad < own.first.value or rng.last.value + pad > own.last.value):
            raise IndexError(f"the holiday map covers {own}, needed is {rng} with {pad} more at each end")

    def frame(self, spark: SparkSession) -> DataFrame:
        """mit, is_business_day, and how many holidays lie right before and right after the day."""
        rows, run = [], 0
        for i, is_open in enumerate(self.is_open):
            rows.append([self.first.value + i, is_open, run, 0])
            run = 0 if is_open else run + 1
        run = 0
        for row in reversed(rows):
            row[3] = run
            run = 0 if row[1] else run + 1
        return spark.createDataFrame(rows, "mit long, is_business_day boolean, holidays_before int, holidays_after int")

    def holidays(self) -> list[dt.date]:
        return [dt.date.fromordinal(bday_to_day(self.first.value + i)) for i, x in enumerate(self.is_open) if not x]


def holiday_options(country: str | None = None) -> list[str]:
    """Countries that the package ``holidays`` knows, or a country's subdivisions."""
    try:
        import holidays
    except ImportError as e:
        raise ImportError("holiday_options needs the package holidays") from e
    known = holidays.list_supported_countries()
    return sorted(known) if country is None else list(known[country])


def resolve(holidays_map: HolidayMap | None, skip_holidays: bool) -> HolidayMap | None:
    """The map given, or with skip_holidays the one that is set as an option."""
    if holidays_map is not None:
        if not isinstance(holidays_map, HolidayMap):
            raise TypeError(f"holidays_map must be a HolidayMap, got {type(holidays_map).__name__}")
        return holidays_map
    if not skip_holidays:
        return None
    found = options.get("bdaily_holidays_map")
    if found is None:
        raise ValueError("skip_holidays needs the option bdaily_holidays_map; set it with options.set_holidays_map")
    return found


def _require(s: SeriesFrame) -> None:
    if s.freq.kind != "BDaily":
        raise TypeError(f"this is for business-daily series, got {s.freq}")


def _every(s: SeriesFrame, test: Callable[[str], Column], all_of: bool) -> Column:
    out = test(s.cols[0])
    for c in s.cols[1:]:
        out = (out & test(c)) if all_of else (out | test(c))
    return out


def _open_rows(s: SeriesFrame, m: HolidayMap) -> DataFrame:
    joined = s.df.join(F.broadcast(m.frame(s.spark).select("mit", "is_business_day")), "mit", "left")
    outside = F.raise_error(F.lit("the holiday map does not cover the range")).cast("boolean")
    return joined.withColumn("is_business_day", F.coalesce("is_business_day", outside))


def cleaned(s: SeriesFrame, *, skip_all_nans: bool = False, skip_holidays: bool = False, holidays_map: HolidayMap | None = None) -> SeriesFrame:
    """Rows that count: a given map decides alone; else missing rows go; else those closed by the option's map.

    A row of a matrix stays only if all its variables have values. The rows that stay need not be dense.
    """
    _require(s)
    if holidays_map is None and skip_all_nans:
        return s.with_df(s.df.where(_every(s, lambda c: ~F.isnan(c), all_of=True)))
    m = resolve(holidays_map, skip_holidays)
    return s if m is None else s.with_df(_open_rows(s, m).where("is_business_day"))


def keep_mask(s: SeriesFrame, *, skip_all_nans: bool = False, skip_holidays: bool = False, holidays_map: HolidayMap | None = None) -> SeriesFrame | None:
    """keep: whether a row counts for results by row. Here the maps come before missing values, and a row with any value stays."""
    if not (skip_all_nans or skip_holidays or holidays_map is not None):
        return None
    _require(s)
    m = resolve(holidays_map, skip_holidays)
    if m is not None:
        marked = _open_rows(s, m).withColumn("keep", F.col("is_business_day"))
    else:
        marked = s.df.withColumn("keep", _every(s, lambda c: ~F.isnan(c), all_of=False))
    return s.with_df(marked, cols=("keep",))


def fill_in(s: SeriesFrame, k: int, *, skip_all_nans: bool = False, skip_holidays: bool = False, holidays_map: HolidayMap | None = None) -> SeriesFrame:
    """Missing values of a series that was shifted by k, from the next value (k > 0) or the one before.

    With skip_all_nans all are filled; with a map only those whose own day, before the shift, is a holiday. A value that is
    missing on a business day stays missing, and so do the holidays that would take it. The nearest value may lie any
    way off, so carried values pass from block to block in a second, small window.
    """
    _require(s)
    if not (skip_all_nans or skip_holidays or holidays_map is not None):
        return s
    m = resolve(holidays_map, skip_holidays)
    rows = s.df
    if m is not None:
        m.covers(s.range(), abs(k))
        days = m.frame(s.spark).select((F.col("mit") - k).alias("mit"), (~F.col("is_business_day")).alias("_holiday"))
        rows = rows.join(F.broadcast(days), "mit", "left")
    else:
        rows = rows.withColumn("_holiday", F.lit(False))
    forward = k > 0
    home = F.floor(F.col("mit") / 4096)
    rows = rows.withColumn("_block", home)
    inner = Window.partitionBy(*s.keys, "_block").orderBy("mit")
    frame = inner.rowsBetween(0, Window.unboundedFollowing) if forward else inner.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if forward else F.last

    def source(c: str) -> Column:
        """What a row passes on: its value, NaN as a barrier, or nothing (null)."""
        empty = F.isnan(c)
        passes = F.when(~empty & (F.lit(skip_all_nans) | ~F.col("_holiday")), F.col(c))
        return passes if skip_all_nans else passes.when(empty & ~F.col("_holiday"), F.col(c))

    carried = rows.withColumns({f"_c_{c}": pick(source(c), ignorenulls=True).over(frame) for c in s.cols})
    per_block = rows.groupBy(*s.keys, "_block").agg(*((F.min_by if forward else F.max_by)(source(c), F.when(source(c).isNotNull(), F.col("mit"))).alias(f"_e_{c}") for c in s.cols))
    outer = Window.partitionBy(*s.keys).orderBy("_block")
    beyond = outer.rowsBetween(1, Window.unboundedFollowing) if forward else outer.rowsBetween(Window.unboundedPreceding, -1)
    edges = per_block.select(*s.keys, "_block", *(pick(f"_e_{c}", ignorenulls=True).over(beyond).alias(f"_o_{c}") for c in s.cols))
    joined = carried.join(edges, [*s.keys, "_block"])
    may = F.lit(True) if skip_all_nans else F.col("_holiday")
    return s.with_df(joined.select(*s.index, *(F.when(F.isnan(c) & may, to_nan(F.coalesce(f"_c_{c}", f"_o_{c}"))).otherwise(F.col(c)).alias(c) for c in s.cols)))


def shift(s: SeriesFrame, k: int, **skip) -> SeriesFrame:
    """windows.shift, then fill_in."""
    return fill_in(windows.shift(s, k), k, **skip)


def lag(s: SeriesFrame, k: int = 1, **skip) -> SeriesFrame:
    return shift(s, -k, **skip)


def lead(s: SeriesFrame, k: int = 1, **skip) -> SeriesFrame:
    return shift(s, k, **skip)


def diff(s: SeriesFrame, k: int = -1, **skip) -> SeriesFrame:
    from seriesloom.operators.align import arithmetic

    return arithmetic(s, "-", shift(s, k, **skip))


def pct(s: SeriesFrame, k: int = -1, **skip) -> SeriesFrame:
    from seriesloom.functions.ieee import divide
    from seriesloom.operators.align import combine

    return combine(s, shift(s, k, **skip), lambda a, b: 100 * divide(a - b, b))


