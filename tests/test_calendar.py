import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.functions import period as P
from seriesloom.functions.frequency import BDaily, Daily, Frequency, HalfYearly, Monthly, Quarterly, Unit, Weekly, Yearly, as_frequency, from_pandas_alias, is_quarterly, periods_per_year, to_pandas_alias
from seriesloom.functions.period import Period, PeriodRange, Span, bdaily, convert_period, convert_range, daily, mm, parse_period, qq, weekly, weekly_from_iso, yy

ALL = [Monthly(), BDaily(), Daily(), *(Quarterly(i) for i in (1, 2, 3)), *(HalfYearly(i) for i in range(1, 7)), *(Yearly(i) for i in range(1, 13)), *(Weekly(i) for i in range(1, 8))]
DAYS = [*range(dt.date(1899, 12, 20).toordinal(), dt.date(1900, 3, 10).toordinal()), *range(dt.date(1999, 6, 1).toordinal(), dt.date(2001, 4, 1).toordinal()), dt.date(2100, 2, 28).toordinal(), dt.date(2100, 3, 1).toordinal(), 1, 2, 8]


@pytest.mark.parametrize("freq", ALL, ids=str)
def test_containment(freq):
    for day in DAYS:
        v = P.containing(freq, day, "previous")
        first, last = (P.period_day(freq, v, r) for r in ("begin", "end"))
        if freq.kind != "BDaily":
            assert first <= day <= last
            assert P.period_day(freq, v + 1, "begin") == last + 1
        else:
            assert first == last == day - max(0, dt.date.fromordinal(day).isoweekday() - 5)
        date = dt.date.fromordinal(last) if last > 0 else None
        if date and freq.is_monthly_based:
            assert (date + dt.timedelta(days=1)).day == 1 and date.month % freq.months == freq.end_period % freq.months
        if date and freq.kind == "Weekly":
            assert date.isoweekday() == freq.end


def test_columns_equal_driver_values(spark):
    days = spark.createDataFrame([(d,) for d in DAYS if d > 400], "day long")
    columns = {}
    for f in ALL:
        v = calendar.containing(f, F.col("day"), "next")
        columns[f"{f}"] = F.struct(v.alias("v"), calendar.period_day(f, v, "begin").alias("a"), calendar.period_day(f, v).alias("b"), calendar.label(f, v).alias("label"))
    for row in days.select("day", *(c.alias(n) for n, c in columns.items())).collect():
        for f in ALL:
            v = P.containing(f, row["day"], "next")
            assert tuple(row[str(f)]) == (v, P.period_day(f, v, "begin"), P.period_day(f, v), str(Period(f, v))), (f, row["day"])


def test_conversion_columns_equal_driver_values(spark):
    df = spark.range(24_000, 24_060).withColumnRenamed("id", "v")
    pairs = [(a, b) for a in (Yearly(7), HalfYearly(4), Quarterly(2), Monthly()) for b in (Yearly(3), HalfYearly(), Quarterly(1), Monthly(), Weekly(3), Daily())]
    out = df.select("v", *(calendar.convert(b, a, F.col("v"), r).alias(f"{a}|{b}|{r}") for a, b in pairs for r in ("begin", "end") if a.kind == "Monthly" or b.is_monthly_based))
    for row in out.collect():
        for a, b in pairs:
            for r in ("begin", "end"):
                if a.kind == "Monthly" or b.is_monthly_based:
                    assert row[f"{a}|{b}|{r}"] == convert_period(b, Period(a, row["v"]), r).value


def test_business_days():
    assert bdaily("2024-01-06", "previous").to_date() == dt.date(2024, 1, 5)
    assert bdaily("2024-01-06", "next").to_date() == dt.date(2024, 1, 8)
    assert bdaily("2024-01-07", "nearest").to_date() == dt.date(2024, 1, 8)
    with pytest.raises(ValueError, match="weekend"):
        bdaily("2024-01-06")
    with pytest.raises(ValueError, match="bias"):
        bdaily("2024-01-06", "other")


def test_weeks():
    assert weekly("2024-01-03", 4).to_date() == dt.date(2024, 1, 4)
    assert weekly_from_iso(2020, 53).to_date() == dt.date(2021, 1, 3)
    with pytest.raises(ValueError, match="weeks"):
        weekly_from_iso(2020, 54)


def test_text_forms():
    cases = [(qq(2020, 1), "2020Q1"), (mm(2020, 3), "2020M3"), (yy(1999), "1999Y"), (Period(Unit(), 5), "5U"), (Period.of(Yearly(8), 2020), "2020Y{8}"), (Period.of(HalfYearly(), 2020, 2), "2020H2"), (daily("2020-02-29"), "2020-02-29")]
    for p, text in cases:
        assert str(p) == text
        if p.freq.kind not in ("Daily", "BDaily", "Weekly"):
            assert parse_period(text) == p


def test_periods_and_spans():
    a = qq(2020, 4)
    assert a + 1 == qq(2021, 1) and a - qq(2020, 1) == Span(Quarterly(), 3) and a - qq(2020, 1) == 3
    assert (a - 2).year == 2020 and (a - 2).period == 2 and float(a) == 2020.75
    assert a != 8083 and a > qq(2019, 1) and a + Span(Quarterly(), -4) == qq(2019, 4)
    assert daily("2020-03-01").period == 61 and bdaily("2020-01-02").period == 2
    for bad in (lambda: a + a, lambda: 1 - a, lambda: a < mm(2020, 1), lambda: a - mm(2020, 1), lambda: a + Span(Monthly(), 1)):
        with pytest.raises(TypeError):
            bad()
    assert Span(Monthly(), 7) // Span(Monthly(), 2) == 3 and -Span(Monthly(), 7) % 4 == Span(Monthly(), 1) and abs(Span(Monthly(), -2)) == 2


def test_ranges():
    r = PeriodRange(qq(2020, 1), qq(2021, 4), 3)
    assert [str(p) for p in r] == ["2020Q1", "2020Q4", "2021Q3"] and qq(2020, 4) in r and qq(2020, 3) not in r and mm(2020, 4) not in r
    back = PeriodRange(qq(2021, 1), qq(2020, 1), -1)
    assert len(back) == 5 and back.first == qq(2021, 1) and back[-1] == qq(2020, 1) and back[1:3] == PeriodRange(qq(2020, 4), qq(2020, 3), -1)
    empty = PeriodRange(qq(2020, 2), qq(2020, 1))
    assert not empty and empty == PeriodRange(qq(2020, 4), qq(2020, 1)) and len(empty) == 0
    with pytest.raises(ValueError, match="empty"):
        _ = empty.first
    with pytest.raises(ValueError, match="step"):
        PeriodRange(qq(2020, 1), qq(2020, 2), 0)
    assert P.span_of(qq(2020, 1), back, empty) == PeriodRange(qq(2020, 1), qq(2021, 1))
    assert P.intersection_of(back, PeriodRange(qq(2020, 3), qq(2022, 1))) == PeriodRange(qq(2020, 3), qq(2021, 1))
    assert PeriodRange(qq(2020, 1), qq(2020, 4)).drop(1).drop(-2) == PeriodRange(qq(2020, 2), qq(2020, 2))


def test_range_conversion():
    r = PeriodRange(mm(2022, 2), mm(2022, 7))
    assert [str(convert_range(Quarterly(), r, t)) for t in ("begin", "end", "both")] == ["2022Q2:2022Q3", "2022Q1:2022Q2", "2022Q2:2022Q2"]
    assert convert_range(Monthly(), PeriodRange(yy(2020), yy(2020))) == PeriodRange(mm(2020, 1), mm(2020, 12))
    assert convert_range(Daily(), PeriodRange(mm(2020, 2), mm(2020, 2))) == PeriodRange(daily("2020-02-01"), daily("2020-02-29"))
    assert convert_range(BDaily(), PeriodRange(mm(2020, 2), mm(2020, 2))) == PeriodRange(bdaily("2020-02-03"), bdaily("2020-02-28"))
    assert convert_range(Monthly(), PeriodRange(daily("2020-01-02"), daily("2020-03-31"))) == PeriodRange(mm(2020, 2), mm(2020, 3))
    with pytest.raises(TypeError, match="Unit"):
        convert_range(Monthly(), PeriodRange(Period(Unit(), 1), Period(Unit(), 2)))


def test_period_conversion():
    assert convert_period(Quarterly(), yy(22)) == qq(22, 4) and convert_period(Quarterly(), yy(22), "begin") == qq(22, 1)
    assert convert_period(Yearly(), qq(2020, 2)) == yy(2020) and convert_period(Daily(), qq(2020, 1)) == daily("2020-03-31")
    with pytest.raises(ValueError, match="weekend"):
        convert_period(BDaily(), daily("2024-01-06"))
    assert convert_period(BDaily(), daily("2024-01-06"), round_to="next") == bdaily("2024-01-08")


def test_frequencies():
    assert as_frequency("Quarterly{2}") == Quarterly(2) and as_frequency(Quarterly) == Quarterly() and str(Yearly(9)) == "Yearly{9}"
    assert [periods_per_year(f) for f in (Daily, BDaily, Weekly, Monthly, Quarterly, HalfYearly, Yearly)] == [365, 260, 52, 12, 4, 2, 1]
    assert is_quarterly(Quarterly(1)) and is_quarterly(qq(2020, 1)) and not is_quarterly(Monthly)
    for bad, error in ((lambda: Quarterly(4), ValueError), (lambda: Yearly(True), TypeError), (lambda: Frequency("Monthly", 1), ValueError), (lambda: periods_per_year(Unit()), ValueError), (lambda: Frequency("Hourly"), ValueError)):
        with pytest.raises(error):
            bad()
    for f in (Yearly(3), Quarterly(2), Weekly(3), Monthly(), BDaily(), Daily()):
        assert from_pandas_alias(to_pandas_alias(f)) == f
    assert from_pandas_alias("QE-NOV") == Quarterly(2) and from_pandas_alias("YS") == Yearly() and from_pandas_alias("A-JUN") == Yearly(6) and from_pandas_alias("ME") == Monthly()
