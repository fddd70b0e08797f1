import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.frequency import BDaily, Daily, HalfYearly, Monthly, Quarterly, Unit, Weekly, Yearly
from seriesloom.functions.period import Period, PeriodRange, bdaily, daily, mm, qq, unit, yy
from seriesloom.operators import align, bdays, compare, convert, recursion, stats, windows
from seriesloom.plans import display, options
from seriesloom.plans.frame import SeriesFrame
from seriesloom.plans.workspace import Workspace, overlay_workspaces
from seriesloom.sources import frames, json_codec

NAN = math.nan


def ser(spark, first, values):
    return frames.series(spark, first, list(values))


def got(s):
    """First period and values of one series."""
    rows = s.df.select("mit", s.only()).orderBy("mit").collect()
    if rows:
        assert [r[0] for r in rows] == list(range(rows[0][0], rows[0][0] + len(rows)))
    return (Period(s.freq, rows[0][0]) if rows else None), [r[1] for r in rows]


def check(s, first, values):
    a, v = got(s)
    assert a == first
    assert v == pytest.approx(list(values), nan_ok=True, abs=1e-9)


# --- frequency conversion: inputs and expected outputs as data ---

PAIRS = [float(i) for i in range(1, 9) for _ in range(2)]
UP36 = [float(i) for i in range(1, 37)]
UP100 = [float(i) for i in range(1, 101)]
LOWER = [
    (Period.of(Quarterly(), 1, 2), PAIRS, Yearly(), "mean", "end", yy(2), [3, 5, 7]),
    (Period(Quarterly(2), 9), PAIRS, Yearly(), "mean", "end", yy(3), [3, 5, 7]),
    (Period.of(Quarterly(), 1, 2), PAIRS[:-1], Yearly(), "mean", "end", yy(2), [3, 5, 7]),
    (mm(20, 1), UP36, Yearly(), "mean", "end", yy(20), [6.5, 18.5, 30.5]),
    (mm(20, 1), UP36, Yearly(9), "mean", "end", Period.of(Yearly(9), 21), [15.5, 27.5]),
    (mm(20, 1), UP36, Quarterly(), "mean", "end", qq(20, 1), list(range(2, 36, 3))),
    (mm(20, 1), UP36, Quarterly(2), "mean", "end", Period(Quarterly(2), 81), list(range(4, 35, 3))),
    (qq(2022, 1), UP36[:10], Yearly(), "point", "begin", yy(2022), [1, 5, 9]),
    (qq(2022, 1), UP36[:10], Yearly(), "point", "end", yy(2022), [4, 8]),
    (qq(2022, 1), UP36[:10], Yearly(), "begin", "end", yy(2022), [1, 5, 9]),
    (qq(2022, 1), UP36[:10], Yearly(8), "point", "begin", Period.of(Yearly(8), 2023), [3, 7]),
    (qq(2022, 1), UP36[:10], Yearly(8), "point", "end", Period.of(Yearly(8), 2022), [2, 6, 10]),
    (qq(2022, 2), UP36[1:11], Yearly(11), "mean", "end", Period.of(Yearly(11), 2023), [5.5, 9.5]),
    (qq(2022, 2), UP36[1:11], Yearly(11), "mean", "begin", Period.of(Yearly(11), 2023), [6.5]),
    (Period.of(Quarterly(2), 2022, 2), [2, 3, 4], Quarterly(), "point", "end", qq(2022, 2), [2, 3, 4]),
    (Period.of(Quarterly(2), 2022, 2), [2, 3, 4], Quarterly(), "point", "begin", qq(2022, 2), [2, 3, 4]),
    (daily("0001-01-01"), UP100, Weekly(), "mean", "end", Period(Weekly(), 1), list(range(4, 96, 7))),
    (daily("0001-01-01"), UP100, Weekly(), "sum", "end", Period(Weekly(), 1), list(range(28, 666, 49))),
    (daily("0001-01-01"), UP100, Weekly(), "point", "end", Period(Weekly(), 1), list(range(7, 99, 7))),
    (daily("0001-01-01"), UP100, Weekly(), "point", "begin", Period(Weekly(), 1), list(range(1, 100, 7))),
    (daily("0001-01-01"), UP100, Monthly(), "mean", "end", mm(1, 1), [16, 45.5, 75]),
    (daily("0001-01-01"), UP100, Monthly(), "point", "end", mm(1, 1), [31, 59, 90]),
    (daily("0001-01-01"), UP100, Monthly(), "point", "begin", mm(1, 1), [1, 32, 60, 91]),
    (Period(Weekly(), 1), UP100[:20], Monthly(), "mean", "end", mm(1, 1), [2.5, 6.5, 10.5, 15]),
    (Period(Weekly(), 1), UP100[:20], Monthly(), "point", "end", mm(1, 1), [4, 8, 12, 17]),
    (Period(Weekly(), 1), UP100[:20], Monthly(), "point", "begin", mm(1, 1), [1, 5, 9, 13, 18]),
    (Period(Weekly(), 1), UP100[:20], Monthly(), "sum", "end", mm(1, 1), [10, 26, 42, 75]),
    (Period(Weekly(4), 2), UP100[:20], Monthly(), "mean", "end", mm(1, 2), [5.5, 10, 14.5]),
]


@pytest.mark.parametrize("case", range(len(LOWER)))
def test_lower(spark, case):
    first, values, target, method, ref, start, want = LOWER[case]
    check(convert.convert(ser(spark, first, values), target, method, ref), start, want)


def test_second_month_average(spark):
    s = convert.convert(convert.convert(ser(spark, Period(Quarterly(2), 9), PAIRS), Monthly(), "const"), Yearly(), "mean")
    check(s, yy(3), [3 + 1 / 6, 5 + 1 / 6, 7 + 1 / 6][: len(got(s)[1])])


BUSINESS = [float(i) for i in range(1, 14)]
HIGHER = [
    (yy(22), [1, 2], Monthly(), "const", "end", mm(22, 1), [1] * 12 + [2] * 12),
    (Period.of(Yearly(7), 22), [1, 2], Monthly(), "const", "end", mm(21, 8), [1] * 12 + [2] * 12),
    (yy(2022), [1, 2, 3, 4], Monthly(), "linear", "begin", mm(2022, 1), [1 + k / 12 for k in range(48)]),
    (yy(2022), [1, 2, 3], Quarterly(), "linear", "end", qq(2022, 1), [0.25 * k for k in range(1, 13)]),
    (yy(2022), [4, 8], Quarterly(), "even", "end", qq(2022, 1), [1] * 4 + [2] * 4),
    (bdaily("2022-07-06"), BUSINESS, Daily(), "const", "end", daily("2022-07-06"), [1, 2, 3, 4, 4, 4, 5, 6, 7, 8, 9, 9, 9, 10, 11, 12, 13]),
    (bdaily("2022-07-06"), BUSINESS, Daily(), "const", "begin", daily("2022-07-06"), [1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 8, 8, 9, 10, 11, 12, 13]),
    (bdaily("2022-07-06"), BUSINESS, Daily(), "linear", "end", daily("2022-07-06"), [1, 2, 3, 10 / 3, 11 / 3, 4, 5, 6, 7, 8, 25 / 3, 26 / 3, 9, 10, 11, 12, 13]),
    (bdaily("2022-07-06"), BUSINESS, Daily(), "even", "end", daily("2022-07-06"), [1, 2, 3, NAN, NAN, 4, 5, 6, 7, 8, NAN, NAN, 9, 10, 11, 12, 13]),
    (Period(Weekly(), 1), [7, 14], Daily(), "even", "end", daily("0001-01-01"), [1] * 7 + [2] * 7),
]


@pytest.mark.parametrize("case", range(len(HIGHER)))
def test_higher(spark, case):
    first, values, target, method, ref, start, want = HIGHER[case]
    check(convert.convert(ser(spark, first, values), target, method, ref), start, want)


def spread_by_hand(first, values, end_day, method, ref):
    """Months to weeks, as the rule is worded: counts between week numbers of boundary dates, then what lies in the range."""
    from seriesloom.functions.period import period_day, week_of

    months = [Period(first.freq, first.value + i) for i in range(len(values))]
    begin = [period_day(m.freq, m.value, "begin") for m in months]
    end = [period_day(m.freq, m.value, "end") for m in months]
    week = lambda day: week_of(day, end_day)
    lo, hi = week(begin[0]), week(end[-1])
    if ref == "end":
        edges = [begin[0], *(e + 1 for e in end[:-1]), end[-1] + (1 if end[-1] % 7 == end_day % 7 else 0)]
        counts = [week(b) - week(a) for a, b in zip(edges, edges[1:], strict=False)]
        cut_lo, cut_hi = 0, int(period_day(Weekly(end_day), hi) > end[-1])
    else:
        edges = [begin[0] - 7, *end]
        counts = [week(b) - week(a) for a, b in zip(edges, edges[1:], strict=False)]
        cut_lo, cut_hi = int(period_day(Weekly(end_day), lo, "begin") < begin[0]), 0
    out = []
    for i, (v, n) in enumerate(zip(values, counts, strict=True)):
        if method == "const":
            out += [v] * n
        elif method == "even":
            out += [v / n] * n
        elif ref == "end":
            step = (values[1] - values[0]) / counts[1] if i == 0 else (v - values[i - 1]) / n
            out += [v - (n - j) * step for j in range(1, n + 1)]
        else:
            step = (v - values[i - 1]) / counts[i - 1] if i == len(values) - 1 else (values[i + 1] - v) / n
            out += [v + j * step for j in range(n)]
    total = hi - cut_hi - (lo + cut_lo) + 1
    return lo + cut_lo, out[cut_lo : cut_lo + total]


@pytest.mark.parametrize("end_day", [7, 3])
@pytest.mark.parametrize("method", ["const", "even", "linear"])
@pytest.mark.parametrize("ref", ["end", "begin"])
def test_months_to_weeks(spark, end_day, method, ref):
    values = [3.0, 8.0, 1.0, 5.0, 9.0, 2.0]
    for first in (mm(2020, 1), mm(2021, 2), mm(2023, 5)):
        lo, want = spread_by_hand(first, values, end_day, method, ref)
        check(convert.convert(ser(spark, first, values), Weekly(end_day), method, ref), Period(Weekly(end_day), lo), want)


def test_days_to_business_days(spark):
    check(convert.convert(ser(spark, daily("0001-01-01"), UP100[:14]), BDaily()), Period(BDaily(), 1), [1, 2, 3, 4, 5, 8, 9, 10, 11, 12])


def test_custom_functions(spark):
    m = ser(spark, mm(20, 1), UP36)
    check(convert.convert(m, Quarterly(), lambda v: float(v[-1] - v[0])), qq(20, 1), [2] * 12)
    check(convert.convert(ser(spark, yy(22), [1, 2]), Quarterly(), lambda v, counts, ref: np.repeat(v, counts) * 10), qq(22, 1), [10] * 4 + [20] * 4)


def test_conversion_errors(spark):
    s = ser(spark, qq(2020, 1), [1, 2, 3, 4])
    for bad, error in (
        (lambda: convert.convert(s, Unit()), TypeError),
        (lambda: convert.convert(s, Yearly(), "average"), ValueError),
        (lambda: convert.convert(s, Monthly(), "mean"), ValueError),
        (lambda: convert.convert(s, Yearly(), "mean", "middle"), ValueError),
        (lambda: convert.convert(s, Yearly(), "mean", skip_all_nans=True), TypeError),
    ):
        with pytest.raises(error):
            bad()
    assert convert.convert(s, Quarterly()) is s
    with pytest.raises(Exception, match="two observations"):
        convert.convert(ser(spark, yy(2020), [1.0]), Quarterly(), "linear").df.collect()


@pytest.mark.parametrize("source", [Yearly(7), HalfYearly(4), Quarterly(2), Monthly()], ids=str)
@pytest.mark.parametrize("target", [Yearly(), Yearly(5), HalfYearly(), HalfYearly(2), Quarterly(), Quarterly(1), Monthly()], ids=str)
def test_round_trips(spark, source, target):
    """A constant spread and averaged back is the series; equal shares add up to it."""
    if not target.is_higher(source) or (source.end_period % target.months) != (target.end_period % target.months):
        return
    s = ser(spark, Period(source, 4040), [3.0, 1.0, 4.0, 1.0, 5.0])
    assert got(convert.convert(convert.convert(s, target, "const"), source, "mean")) == got(s)
    check(convert.convert(convert.convert(s, target, "even"), source, "sum"), *got(s))


def test_panel_equals_single_series(spark):
    rng = np.random.default_rng(1)
    parts = {k: (mm(2000 + k, 1 + k), rng.normal(size=20 + 5 * k)) for k in range(4)}
    rows = [(k, first.value + i, float(v)) for k, (first, values) in parts.items() for i, v in enumerate(values)]
    panel = SeriesFrame(spark.createDataFrame(rows, "k int, mit long, value double"), Monthly(), ("k",))
    operators = [
        lambda s: convert.convert(s, Quarterly(), "mean"), lambda s: convert.convert(s, Yearly(9), "end"), lambda s: convert.convert(s, Weekly(), "linear"), windows.diff, lambda s: windows.moving_average(s, 3), lambda s: windows.undiff(s, 2.0),
        lambda s: convert.convert(s, Daily(), "linear", "begin"), lambda s: recursion.rec_linear(s, [0.5], [1], PeriodRange(s.first_date() + 1, s.last_date())) if not s.keys else s,
    ]
    for op in operators[:-1]:
        whole = op(panel).df.collect()
        for k, (first, values) in parts.items():
            alone = op(ser(spark, first, values)).df.collect()
            assert {r["mit"]: r["value"] for r in whole if r["k"] == k} == pytest.approx({r["mit"]: r["value"] for r in alone})


def test_extend_trim_strip(spark):
    s = ser(spark, mm(2022, 2), UP36[:7])
    check(convert.extend_series(s, Quarterly()), mm(2022, 1), [1.5, *UP36[:7], 6.5])
    check(convert.extend_series(s, Quarterly(), method="end"), mm(2022, 1), [1, *UP36[:7], 7])
    check(convert.extend_series(s, Yearly()), mm(2022, 1), [4, *UP36[:7], 4, 4, 4, 4])
    check(convert.extend_series(s, Quarterly(), "begin"), mm(2022, 1), [1.5, *UP36[:7]])
    check(convert.trim_series(s, Quarterly()), mm(2022, 4), [3, 4, 5])
    check(ser(spark, mm(2020, 1), [NAN, NAN, 1, NAN, 2, NAN]).strip(), mm(2020, 3), [1, NAN, 2])
    assert ser(spark, mm(2020, 1), [NAN, NAN]).strip().is_empty()


# --- windows ---


def test_growth(spark):
    check(windows.shift(ser(spark, qq(2020, 1), [1, 2, 3, 4]), 1), qq(2019, 4), [1, 2, 3, 4])
    check(windows.lag(ser(spark, qq(2020, 1), [1, 2])), qq(2020, 2), [1, 2])
    y = ser(spark, yy(2000), [1, 2, 4, 8])
    check(windows.pct(y), yy(2001), [100] * 3)
    check(windows.pct(y, -2), yy(2002), [300] * 2)
    doubling = [2.0**i for i in range(1, 21)]
    check(windows.apct(ser(spark, qq(2000, 1), doubling)), qq(2000, 2), [1500] * 19)
    check(windows.ytypct(ser(spark, qq(2000, 1), doubling)), qq(2001, 1), [1500] * 16)
    check(windows.apct(ser(spark, mm(2000, 1), doubling)), mm(2000, 2), [409500] * 19)
    check(windows.pct(ser(spark, yy(2000), [0, 0, 1, 2])), yy(2001), [NAN, math.inf, 100])
    for bad in (windows.apct, windows.ytypct):
        with pytest.raises(TypeError):
            bad(ser(spark, daily("2020-01-01"), [1, 2]))


def test_moving(spark):
    s = ser(spark, unit(1), range(1, 11))
    check(windows.moving_average(s, 4), unit(4), [t - 1.5 for t in range(4, 11)])
    check(windows.moving_average(s, -4), unit(1), [t + 1.5 for t in range(1, 8)])
    check(windows.moving_sum(s, 1), unit(1), range(1, 11))
    check(windows.moving_sum(ser(spark, unit(1), [1, NAN, 3, 4, 5]), 2), unit(2), [NAN, NAN, 7, 9])
    with pytest.raises(ValueError, match="window"):
        windows.moving_sum(s, 0)
    assert windows.moving_sum(s, 11).is_empty()


def test_undiff(spark):
    d = windows.diff(ser(spark, unit(1), range(1, 11)))
    check(windows.undiff(d), unit(1), range(10))
    check(windows.undiff(d, (unit(1), 1.0)), unit(1), range(1, 11))
    check(windows.undiff(d, (unit(5), 5.0)), unit(2), range(2, 11))
    check(windows.undiff(d, (unit(12), 3.0)), unit(2), [-5, -4, -3, -2, -1, 0, 1, 2, 3, 3, 3])
    base = ser(spark, unit(1), [10] * 10)
    check(windows.undiff_into(base, d), unit(1), range(10, 20))
    check(windows.undiff_into(base, d, unit(5)), unit(1), [10] * 5 + [11, 12, 13, 14, 15])


def test_blocks_do_not_show(spark, monkeypatch):
    """Small blocks give what one window gives."""
    rng = np.random.default_rng(0)
    values = rng.normal(size=200)
    s = ser(spark, unit(-37), values)
    whole = [got(op(s)) for op in (windows.diff, lambda x: windows.diff(x, 7), lambda x: windows.moving_sum(x, 9), lambda x: windows.moving_sum(x, -9), windows.cumulative)]
    monkeypatch.setattr("seriesloom.plans.frame.BLOCK", 16)
    monkeypatch.setattr("seriesloom.operators.windows.BLOCK", 16)
    for (first, want), op in zip(whole, (windows.diff, lambda x: windows.diff(x, 7), lambda x: windows.moving_sum(x, 9), lambda x: windows.moving_sum(x, -9), windows.cumulative), strict=True):
        check(op(s), first, want)
    check(windows.cumulative(s), unit(-37), np.cumsum(values))


# --- alignment ---


def test_arithmetic(spark):
    a, b = ser(spark, qq(2020, 1), [1, 2, 3, 4]), ser(spark, qq(2020, 3), [10, 0, 30])
    check(align.arithmetic(a, "+", b), qq(2020, 3), [13, 4])
    check(align.arithmetic(a, "/", b), qq(2020, 3), [0.3, math.inf])
    check(align.arithmetic(1.0, "-", a), qq(2020, 1), [0, -1, -2, -3])
    check(align.arithmetic(a, "%", -3.0), qq(2020, 1), [-2, -1, 0, -2])
    check(align.arithmetic(a, "//", 2.0), qq(2020, 1), [0, 1, 1, 2])
    check(align.arithmetic(a, "**", 2.0), qq(2020, 1), [1, 4, 9, 16])
    check(align.update(a, "+", b), qq(2020, 1), [1, 2, 13, 4])
    check(align.maximum(a, b), qq(2020, 3), [10, 4])
    check(align.function("log", ser(spark, unit(1), [1, 0, -1])), unit(1), [0, -math.inf, NAN])
    with pytest.raises(TypeError, match="mixing"):
        align.arithmetic(a, "+", ser(spark, mm(2020, 1), [1]))
    assert align.arithmetic(a, "+", ser(spark, qq(2030, 1), [1])).is_empty()
    same = align.compare_elements(ser(spark, unit(1), [1, NAN, 3]), "==", ser(spark, unit(1), [1, NAN, 4]))
    assert [r[0] for r in same.df.orderBy("mit").select("value").collect()] == [True, False, False]


def test_numpy_functions_and_products(spark):
    s = ser(spark, unit(1), [1, NAN, 4])
    check(align.apply(s, np.sqrt), unit(1), [1, NAN, 2])
    check(align.apply(s, lambda v: np.hypot(v, 3)), unit(1), [math.hypot(1, 3), NAN, 5])
    flags = align.logical(s, "xor", ser(spark, unit(1), [0, 0, 2]))
    assert [r[0] for r in flags.df.orderBy("mit").select("value").collect()] == [True, True, False]
    weights = spark.createDataFrame([("x", 0, 2.0), ("x", 2, 0.5), ("y", 2, -1.0)], "row string, position long, weight double")
    assert {r["row"]: r["value"] for r in align.left_matmul(weights, s).collect()} == {"x": 4.0, "y": -4.0}
    assert s.at_position(0) == 1 and s.at_position(-1) == 4
    with pytest.raises(IndexError):
        s.at_position(3)
    check(s.similar(2), unit(1), [2, 2, 2])
    positions = align.compare_positions(ser(spark, unit(1), [1, 2]), ser(spark, unit(9), [1, 3]))
    assert [r[0] for r in positions.df.orderBy("mit").select("value").collect()] == [True, False]


def test_overlay_and_concatenation(spark):
    x1, x2 = ser(spark, qq(2020, 1), [1, 2, NAN, 4]), ser(spark, qq(2019, 3), [10, 20, 30, 40])
    check(align.overlay(x1, x2), qq(2019, 3), [10, 20, 1, 2, NAN, 4])
    check(align.overlay(x1, x2, rng=PeriodRange(qq(2019, 4), qq(2021, 1))), qq(2019, 4), [20, 1, 2, NAN, 4, NAN])
    a = frames.matrix(spark, PeriodRange(yy(2000), yy(2002)), a1=1.0, a2=1.0)
    b = frames.matrix(spark, PeriodRange(yy(1998), yy(2001)), b=2.0)
    rows = align.hcat(a, b).df.orderBy("mit").collect()
    assert [r["mit"] for r in rows] == list(range(1998, 2003)) and math.isnan(rows[0]["a1"]) and rows[2]["a2"] == 1 and rows[0]["b"] == 2 and math.isnan(rows[4]["b"])
    with pytest.raises(ValueError, match="duplicate"):
        align.hcat(a, a)
    check(align.vcat(x1, ser(spark, qq(1990, 1), [7, 8])), qq(2020, 1), [1, 2, NAN, 4, 7, 8])


def test_matrix_alignment(spark):
    m = frames.matrix(spark, PeriodRange(qq(2020, 1), qq(2020, 4)), a=1.0, b=2.0)
    n = frames.matrix(spark, PeriodRange(qq(2020, 2), qq(2021, 1)), b=10.0, c=20.0)
    both = align.arithmetic(m, "+", n)
    assert both.cols == ("b",) and got(both) == (qq(2020, 2), [12, 12, 12])
    t = align.arithmetic(m, "*", ser(spark, qq(2020, 3), [3, 4]))
    assert t.cols == ("a", "b") and [tuple(r) for r in t.df.select("a", "b").orderBy("mit").collect()] == [(3, 6), (4, 8)]


# --- point access ---


def test_access(spark):
    s = ser(spark, qq(2020, 1), [1, 2, 3, 4, 5])
    assert s.at(qq(2020, 2)) == 2 and s.length() == 5 and s.first_date() == qq(2020, 1) and s.last_date() == qq(2021, 1)
    with pytest.raises(IndexError):
        s.at(qq(2030, 1))
    check(s[PeriodRange(qq(2020, 2), qq(2020, 3))], qq(2020, 2), [2, 3])
    with pytest.raises(TypeError):
        s[mm(2020, 1)]
    wanted = spark.createDataFrame([(0, qq(2020, 3).value), (1, qq(2020, 1).value)], "pos int, mit long")
    assert [r["value"] for r in s.lookup(wanted).orderBy("pos").collect()] == [3, 1]
    with pytest.raises(Exception, match="outside"):
        s.lookup(spark.createDataFrame([(0, 1)], "pos int, mit long")).collect()
    check(s.assign(PeriodRange(qq(2021, 3), qq(2021, 4)), 9.0), qq(2020, 1), [1, 2, 3, 4, 5, NAN, 9, 9])
    check(s.assign(PeriodRange(qq(2020, 1), qq(2020, 3)), ser(spark, qq(2020, 2), [7, 8, 9])), qq(2020, 1), [1, 7, 8, 4, 5])
    check(s.resize(PeriodRange(qq(2019, 4), qq(2020, 2))), qq(2019, 4), [NAN, 1, 2])
    check(s.reindex(qq(2020, 1), unit(1)), unit(1), [1, 2, 3, 4, 5])
    check(s.where(align.compare_elements(s, ">=", 4)), qq(2020, 4), [4, 5])
    m = frames.matrix(spark, s.range(), a=s, b=2.0)
    assert m["a"].cols == ("a",) and m[["b", "a"]].cols == ("b", "a") and got(m[PeriodRange(qq(2020, 2), qq(2020, 2)), "a"]) == (qq(2020, 2), [2])
    assert m.rename(prefix="x_").cols == ("x_a", "x_b") and m.rename({"a": "z"}).cols == ("z", "b") and m.rename(str.upper).cols == ("A", "B")
    for bad, error in ((lambda: m.rename(["a", "a"]), ValueError), (lambda: m["q"], KeyError), (lambda: SeriesFrame(m.df, Quarterly(), (), ("a", "a")), ValueError), (lambda: SeriesFrame(m.df, Quarterly(), (), ("q",)), ValueError)):
        with pytest.raises(error):
            bad()
    with pytest.raises(ValueError, match="gaps"):
        SeriesFrame(s.df.where("mit != 8081"), Quarterly()).check()
    s.check()


# --- statistics ---


def test_statistics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 4))
    m = frames.matrix(spark, qq(2020, 1), **{f"c{i}": x[:, i].tolist() for i in range(4)})
    for name, f in (("mean", np.mean), ("std", lambda v, axis=None: np.std(v, axis=axis, ddof=1)), ("var", lambda v, axis=None: np.var(v, axis=axis, ddof=1)), ("median", np.median), ("sum", np.sum), ("min", np.min), ("max", np.max)):
        assert stats.reduce_by(m, name).first()[0] == pytest.approx(f(x))
        assert list(stats.reduce_by(m, name, 0).first()) == pytest.approx(f(x, axis=0).tolist())
        check(stats.reduce_by(m, name, 1), qq(2020, 1), f(x, axis=1))
    assert stats.quantile(m["c0"], 0.3).first()[0] == pytest.approx(np.quantile(x[:, 0], 0.3))
    assert stats.quantile(m, [0.1, 0.9]).first()[0] == pytest.approx(np.quantile(x, [0.1, 0.9]).tolist())
    check(stats.quantile(m, 0.4, 1), qq(2020, 1), np.quantile(x, 0.4, axis=1))
    assert stats.stdm(m["c0"], 0.5).first()[0] == pytest.approx(math.sqrt(((x[:, 0] - 0.5) ** 2).sum() / 9))
    found = {(r["row"], r["col"]): r["value"] for r in stats.cor(m).collect()}
    assert all(found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x.T)[i, j]) for i in range(4) for j in range(4))
    assert {(r["row"], r["col"]): r["value"] for r in stats.cov(m).collect()}["c1", "c3"] == pytest.approx(np.cov(x.T)[1, 3])
    assert stats.cor(m["c0"], m["c1"]).first()[0] == pytest.approx(np.corrcoef(x.T)[0, 1])


def test_statistics_of_special_values(spark):
    s = ser(spark, unit(1), [1, NAN, 3])
    for name in ("mean", "std", "median", "min", "max", "sum"):
        assert math.isnan(stats.reduce_by(s, name).first()[0])
    one = ser(spark, unit(1), [2])
    assert math.isnan(stats.std(one).first()[0]) and math.isnan(stats.varm(one, 0).first()[0]) and stats.mean(one).first()[0] == 2
    assert math.isnan(stats.cor(ser(spark, unit(1), [1, 1, 1]), ser(spark, unit(1), [1, 2, 3])).first()[0])
    with pytest.raises(Exception, match="same range"):
        stats.cor(ser(spark, unit(1), [1, 2, 3]), ser(spark, unit(2), [1, 2, 3])).collect()
    with pytest.raises(ValueError, match="axis"):
        stats.mean(s, 2)


# --- business days ---


def test_holidays(spark):
    first = bdaily("2022-07-04")
    s = ser(spark, first, [1, 2, NAN, 4])
    day = lambda t: bdaily(t)
    assert [r[0] for r in bdays.cleaned(s, skip_all_nans=True).df.orderBy("mit").select("value").collect()] == [1, 2, 4]
    m = bdays.HolidayMap(first, (True, False, True, True))
    four = ser(spark, first, [1, 2, 3, 4])
    assert [r[0] for r in bdays.cleaned(four, holidays_map=m).df.orderBy("mit").select("value").collect()] == [1, 3, 4]
    check(bdays.shift(s, 1, skip_all_nans=True), day("2022-07-01"), [1, 2, 4, 4])
    check(bdays.shift(s, -1, skip_all_nans=True), day("2022-07-05"), [1, 2, 2, 4])
    closed = bdays.HolidayMap.from_holidays(["2022-07-06"], "2022-06-01", "2022-08-01")
    check(bdays.shift(s, 1, holidays_map=closed), day("2022-07-01"), [1, 2, 4, 4])
    check(bdays.shift(s, -1, holidays_map=closed), day("2022-07-05"), [1, 2, 2, 4])
    missing = bdays.HolidayMap.from_holidays(["2022-07-05"], "2022-06-01", "2022-08-01")
    check(bdays.shift(s, 1, holidays_map=missing), day("2022-07-01"), [1, 2, NAN, 4])
    with pytest.raises(Exception, match="cover"):
        bdays.cleaned(four, holidays_map=bdays.HolidayMap(first + 1, (True, True))).df.collect()
    with pytest.raises(IndexError, match="cover"):
        bdays.shift(four, 1, holidays_map=m)
    with pytest.raises(TypeError, match="business"):
        bdays.cleaned(ser(spark, qq(2020, 1), [1]), skip_all_nans=True)
    with pytest.raises(ValueError, match="bdaily_holidays_map"):
        bdays.cleaned(four, skip_holidays=True)
    with options.scope(bdaily_holidays_map=m):
        assert bdays.cleaned(four, skip_holidays=True).df.count() == 3
        assert [r[0] for r in bdays.keep_mask(four, skip_holidays=True).df.orderBy("mit").select("keep").collect()] == [True, False, True, True]
    assert options.get_holidays_map() is None


def fill_by_hand(values, closed, k, every):
    values, last = list(values), NAN
    order = range(len(values) - 1, -1, -1) if k > 0 else range(len(values))
    for i in order:
        if math.isnan(values[i]):
            if every or closed[i]:
                values[i] = last
            else:
                last = NAN
        elif every or not closed[i]:
            last = values[i]
    return values


@pytest.mark.parametrize("k", [2, -2])
@pytest.mark.parametrize("every", [True, False])
def test_filling_in_random(spark, k, every, monkeypatch):
    rng = np.random.default_rng(7)
    first = Period(BDaily(), 500_000)
    closed = rng.random(400) < 0.2
    values = np.where((rng.random(300) < 0.3) | (closed[50:350] & (rng.random(300) < 0.8)), NAN, rng.normal(size=300))
    m = bdays.HolidayMap(first - 50, tuple(~closed))
    s = bdays.shift(ser(spark, first, values), k, skip_all_nans=every, holidays_map=None if every else m)
    check(s, first - k, fill_by_hand(values, closed[50:350], k, every))


def test_holiday_conversion(spark):
    first = bdaily("2022-01-03")
    s = ser(spark, first, range(1, 64))
    new_year = bdays.HolidayMap.from_holidays(["2021-12-31", "2022-01-17", "2022-03-31"], "2021-01-01", "2023-01-01")
    a, values = got(convert.convert(s, Monthly(), "mean", holidays_map=new_year))
    assert a == mm(2022, 1) and values == pytest.approx([np.mean([v for v in range(1, 22) if v != 11]), np.mean(range(22, 42)), np.mean(range(42, 64))][: len(values)])
    assert got(convert.convert(s, Monthly(), "mean"))[0] == mm(2022, 1)


# --- recursion ---


def test_recursion(spark):
    s = ser(spark, unit(1), [1, 1])
    check(recursion.rec(s, PeriodRange(unit(3), unit(10)), "value", lambda x, t: x["value"][t - 1] + x["value"][t - 2]), unit(1), [1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    z = ser(spark, unit(1), [0] * 9 + [7])
    check(recursion.rec_linear(z, [1.0], [-1], PeriodRange(unit(9), unit(1), -1)), unit(1), [7] * 10)
    income = np.arange(1.0, 21.0)
    both = frames.matrix(spark, qq(2020, 1), income=income.tolist(), c=income.tolist())
    made = recursion.rec(both, PeriodRange(qq(2020, 2), qq(2024, 4)), "c", lambda x, t: 0.6 * x["c"][t - 1] + 0.4 * x["income"][t])
    want = [1.0]
    for v in income[1:]:
        want.append(0.6 * want[-1] + 0.4 * v)
    check(made["c"], qq(2020, 1), want)
    for bad, error in (
        (lambda: recursion.rec_linear(z, [1.0], [1, 2], PeriodRange(unit(3), unit(4))), ValueError),
        (lambda: recursion.rec_linear(z, [1.0], [-1], PeriodRange(unit(3), unit(4))), ValueError),
        (lambda: recursion.rec_linear(z, [1.0], [1], PeriodRange(unit(3), unit(9), 2)), ValueError),
        (lambda: recursion.rec_linear(z, [1.0], [1], PeriodRange(qq(1, 1), qq(1, 2))), TypeError),
    ):
        with pytest.raises(error):
            bad()
    with pytest.raises(Exception, match="initial condition"):
        recursion.rec_linear(z, [1.0], [5], PeriodRange(unit(3), unit(4))).df.collect()


# --- containers, comparison, formats ---


def test_workspace(spark):
    a, b = ser(spark, qq(2020, 1), [1, NAN, 3]), ser(spark, qq(2020, 2), [1, 2, 3])
    w = Workspace(a=a, b=b, n=5)
    assert list(w) == ["a", "b", "n"] and w.n == 5 and w["a"] is a and list(w[["a", "n"]]) == ["a", "n"]
    assert w.frequency() == Quarterly() and w.range() == PeriodRange(qq(2020, 2), qq(2020, 3)) and w.span() == PeriodRange(qq(2020, 1), qq(2020, 4))
    assert list(w.filter(lambda k, v: k != "n")) == ["a", "b"] and list(w.merge({"n": 6, "m": 1}).items())[2] == ("n", 6)
    w.z = Workspace(n=1)
    del w["n"]
    assert "z" in w and "Workspace" in repr(w) and w.as_namespace().z.n == 1
    o = overlay_workspaces(Workspace(a=a, x=None), Workspace(a=b, x=3, y=4))
    assert o.x == 3 and o.y == 4 and got(o.a) == (qq(2020, 1), [1, 1, 3, 3])
    assert w.frame().cols == ("a", "b") and Workspace.from_dict({"p": {"q": 1}}, recursive=True).p.q == 1
    assert got(Workspace(a=a).reindex(qq(2020, 1), qq(2021, 1)).a)[0] == qq(2021, 1)
    target = frames.matrix(spark, PeriodRange(qq(2020, 1), qq(2020, 4)), b=0.0, c=0.0)
    check(w.copy_to(target, PeriodRange(qq(2020, 3), qq(2020, 4)))["b"], qq(2020, 1), [0, 0, 2, 3])


def test_compare(spark):
    a, b = ser(spark, qq(2020, 1), [1, NAN, 3]), ser(spark, qq(2020, 1), [1, NAN, 3 + 1e-9])
    assert not compare.compare(a, b) and compare.compare(a, b, nans=True) and compare.allclose(a, b) and not compare.equals(a, a)
    c = compare.compare({"x": a, "y": 1, "q": {"r": 2.0}}, {"x": ser(spark, qq(2020, 1), [1, 2]), "z": 1, "q": {"r": 3.0}}, nans=True)
    assert {d.path for d in c.differences} == {("y",), ("z",), ("x",), ("q", "r")} and "x:" in str(c)
    assert compare.compare({"x": a}, {"x": a, "y": 1}, nans=True, ignoremissing=True)
    assert compare.compare(a, ser(spark, qq(2020, 1), [1, 5, 3]), trange=PeriodRange(qq(2020, 3), qq(2020, 3)))
    assert not compare.compare(a, ser(spark, mm(2020, 1), [1])) and compare.compare([1, "a"], [1, "a"]) and not compare.compare([1], [1, 2])


def test_json(spark):
    w = Workspace(p=qq(2020, 1), s=ser(spark, mm(2020, 1), [1, 2.5]), m=frames.matrix(spark, yy(2000), a=[1.0, 2.0], b=[3.0, 4.0]), r=PeriodRange(yy(2000), yy(2010), 2), f=Weekly(3), d=qq(2020, 2) - qq(2020, 1), k={"x": [1, None, "t", True]})
    back = json_codec.loads(json_codec.dumps(w), spark)
    assert back.p == w.p and back.r == w.r and back.f == w.f and back.d == w.d and back.k == w.k and got(back.s) == got(w.s) and back.m.cols == ("a", "b")
    assert json_codec.encode(qq(2020, 1)) == {"_type": "MIT", "freq": {"name": "Quarterly", "end_month": 3}, "value": 8080}
    with pytest.raises(ValueError, match="tag"):
        json_codec.loads('{"_type": "Nothing"}')
    with pytest.raises(TypeError):
        json_codec.dumps(object())


def test_pandas(spark):
    s = ser(spark, qq(2020, 1), [1, 2, 3])
    p = frames.to_pandas(s)
    assert p.index.freqstr == "Q-DEC" and got(frames.from_pandas(spark, p)) == got(s)
    d = frames.to_pandas(ser(spark, daily("2020-02-28"), [1, 2]))
    assert got(frames.from_pandas(spark, d, freq=Daily())) == (daily("2020-02-28"), [1, 2])
    h = frames.to_pandas(ser(spark, Period.of(HalfYearly(), 2020, 1), [1, 2]))
    assert got(frames.from_pandas(spark, h)) == (Period.of(HalfYearly(), 2020, 1), [1, 2])
    long = pd.DataFrame({"t": pd.to_datetime(["2020-01-31", "2020-02-29"] * 2), "n": ["b", "b", "a", "a"], "v": [1.0, 2.0, 3.0, 4.0]})
    wide = frames.from_pandas(spark, long, freq=Monthly(), time_col="t", name_col="n", value_col="v")
    assert wide.cols == ("b", "a") and got(wide["a"]) == (mm(2020, 1), [3, 4])
    assert list(frames.from_pandas(spark, long, freq=Monthly(), time_col="t", name_col="n", value_col="v", to_workspace=True)) == ["b", "a"]
    with pytest.raises(ValueError, match="twice"):
        frames.from_pandas(spark, pd.concat([long, long]), freq=Monthly(), time_col="t", name_col="n", value_col="v")
    with pytest.raises(ValueError, match="gaps"):
        frames.from_pandas(spark, pd.Series([1.0, 2.0], index=[1, 3]))
    assert got(frames.from_pandas(spark, pd.Series([1.0, 2.0], index=[4, 5]))) == (unit(4), [1, 2])


def test_polars_missing(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "polars", None)
    for gated in (lambda: frames.to_polars(ser(spark, qq(2020, 1), [1])), lambda: frames.from_polars(spark, None)):
        with pytest.raises(ImportError, match="polars"):
            gated()


def test_polars_both_ways(spark):
    pytest.importorskip("polars")
    s = ser(spark, qq(2020, 1), [1, 2, 3])
    made = frames.to_polars(s)
    assert made.columns[0] == "time" and made.height == 3
    assert got(frames.from_polars(spark, made, freq=Quarterly())) == got(s)


def test_constructors(spark, tmp_path):
    rng = PeriodRange(qq(2020, 1), qq(2020, 4))
    check(frames.series(spark, rng), qq(2020, 1), [NAN] * 4)
    check(frames.series(spark, rng, 2), qq(2020, 1), [2] * 4)
    check(frames.series(spark, rng, lambda n: range(n)), qq(2020, 1), [0, 1, 2, 3])
    for bad, error in ((lambda: frames.series(spark, qq(2020, 1), 1.0), TypeError), (lambda: frames.series(spark, rng, [1.0]), ValueError), (lambda: frames.missing_value("O"), TypeError)):
        with pytest.raises(error):
            bad()
    assert math.isnan(frames.missing_value(float)) and frames.missing_value("int32") == 2**31 - 1 and frames.missing_value(bool) is False
    m = frames.matrix(spark, None, a=frames.series(spark, rng, 1), b=ser(spark, qq(2020, 4), [5, 6]))
    assert got(m["b"])[1] == pytest.approx([NAN, NAN, NAN, 5, 6], nan_ok=True)
    frames.save(m, str(tmp_path / "m"))
    again = frames.read(spark, str(tmp_path / "m"))
    assert again.freq == Quarterly() and again.cols == ("a", "b") and compare.compare(again, m, nans=True)
    gaps = spark.createDataFrame([("x", 1, 1.0), ("x", 4, None), ("y", 2, 2.0)], "k string, mit long, value double")
    dense = frames.densify(gaps, Unit(), ("k",))
    assert sorted((r["k"], r["mit"]) for r in dense.check().df.collect()) == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 2)]


def test_display(spark):
    s = ser(spark, qq(2020, 1), range(50))
    text = display.text(s)
    assert "2020Q1" in text and "..." in text and "2032Q2" in text and len(text.split("\n")) == 23
    assert "<td>2020Q1</td>" in display.html_table(s, 4)
    assert [str(p) for p in display.ticks(PeriodRange(qq(2020, 2), qq(2024, 4)), 5)] == ["2021Q1", "2022Q1", "2023Q1", "2024Q1"]
    assert display.panel_grid(5) == (3, 2)
    if not display.available_backends():
        with pytest.raises(ImportError):
            display.plot(s)
    with pytest.raises(ValueError, match="backend"):
        display.plot(s, backend="other")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_both_ansi_modes(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        check(windows.pct(ser(spark, yy(2000), [0, 1, 0])), yy(2001), [math.inf, -100])
        check(align.arithmetic(ser(spark, unit(1), [0, 1]), "/", 0.0), unit(1), [NAN, math.inf])
        assert math.isnan(stats.cor(ser(spark, unit(1), [1, 1]), ser(spark, unit(1), [1, 2])).first()[0])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_streams(spark, tmp_path):
    from seriesloom.streaming import periods

    rows = [(f"2024-01-{d:02d} 10:00:00", "a" if d % 2 else "b", float(d)) for d in range(1, 29)]
    data = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))

    def result(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    weekly = {r["mit"]: r["total"] for r in result(periods.period_aggregates(stream, "ts", Weekly(), {"total": F.sum("v")}), "complete", "weekly")}
    first = daily("2024-01-01").value
    assert weekly == {(first + 7 * w + 6) // 7: sum(range(7 * w + 1, 7 * w + 8)) for w in range(4)}
    assert len(result(periods.period_aggregates(stream, "ts", Monthly(), {"n": F.count("*")}, ["k"]), "complete", "monthly")) == 2
    windows_ = result(periods.sliding_windows(stream, "ts", "4 days", "2 days", {"n": F.count("*")}), "complete", "sliding")
    assert sum(r["n"] for r in windows_) == 56
    assert len(result(periods.sessions(stream.where("k = 'a'"), "ts", "1 day", {"n": F.count("*")}), "complete", "sessions")) == 14
    filtered = {(r["k"], r["ts"].day): r["filtered"] for r in result(periods.linear_filter(stream, "k", "ts", "v", [0.5]), "append", "filtered")}
    y = 0.0
    for d in range(1, 29, 2):
        y = 0.5 * y + d
        assert filtered["a", d] == pytest.approx(y)


def test_streams_let_go_of_old_periods(spark, tmp_path):
    from seriesloom.streaming import periods

    def add(name, *days):
        spark.createDataFrame([(d, 1.0) for d in days], "ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add("a", "2024-01-05", "2024-01-20")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    made = periods.period_aggregates(stream, "ts", Monthly(), {"total": F.sum("v")}, late="2 days")
    query = made.writeStream.format("memory").queryName("months").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        for days in (("2024-02-03",), ("2024-01-31", "2024-02-10"), ("2024-04-10",), ("2024-05-02", "2024-01-07"), ("2024-05-03",)):
            add("b", *days)
            query.processAllAvailable()
        # a row of January counts in February, but not in May, when its state is gone
        assert {r["mit"]: r["total"] for r in spark.table("months").collect()} == {mm(2024, 1).value: 3, mm(2024, 2).value: 2}
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    finally:
        query.stop()


def test_operators_of_handles(spark):
    a, b = ser(spark, qq(2020, 1), [1, 2, 3, 4]), ser(spark, qq(2020, 3), [10, 20, 30])
    for made, values in ((a + b, [13, 24]), (b - a, [7, 16]), (2 * a, [2, 4, 6, 8]), (1 / a, [1, 0.5, 1 / 3, 0.25]), (a // 2, [0, 1, 1, 2]), (7 % a, [0, 1, 1, 3]), (2**a, [2, 4, 8, 16]), (-a, [-1, -2, -3, -4]), (+a, [1, 2, 3, 4]), (abs(-a), [1, 2, 3, 4]), (a + np.float32(1), [2, 3, 4, 5]), (np.float64(1) + a, [2, 3, 4, 5])):
        assert got(made)[1] == pytest.approx(values)
    assert got(a + b)[0] == qq(2020, 3)
    for made, values in ((a > 2, [False, False, True, True]), (a == 3, [False, False, True, False]), (2 != a, [True, False, True, True]), (3 >= a, [True, True, True, False]), ((a > 1) & (a < 4), [False, True, True, False]), ((a < 2) | (a > 3), [True, False, False, True]), (~(a > 2), [True, True, False, False])):
        assert got(made)[1] == values
    c = a
    c += b
    assert got(c)[1] == [1, 2, 13, 24] and got(a)[1] == [1, 2, 3, 4]
    assert len({a, b, a}) == 2
    with pytest.raises(TypeError):
        a + "x"
    with pytest.raises(TypeError):
        a + yy_series(spark)


def yy_series(spark):
    return ser(spark, yy(2020), [1, 2])


def test_numpy_protocols(spark):
    a, b = ser(spark, qq(2020, 1), [1, 4, 9]), ser(spark, qq(2020, 1), [2, 2, 2])
    assert np.asarray(a).tolist() == [1, 4, 9] and np.asarray(a, dtype=int).dtype == int
    assert got(np.sqrt(a))[1] == [1, 2, 3] and got(np.multiply(a, b))[1] == [2, 8, 18] and got(np.add(1, a))[1] == [2, 5, 10]
    assert got(np.maximum(a, 3))[1] == [3, 4, 9] and got(np.greater(a, b))[1] == [False, True, True]
    assert np.add.reduce(a) == 14 and np.mean(a) == pytest.approx(14 / 3)
    assert np.array_equal(a, np.array([1, 4, 9])) and np.allclose(a, [1, 4, 9 + 1e-12]) and not np.array_equal(a, b)
    assert got(np.concatenate([a, b])) == (qq(2020, 1), [1, 4, 9, 2, 2, 2])
    assert np.concatenate([a, [5.0]]).tolist() == [1, 4, 9, 5]
    assert np.matmul(a, b) == a @ b == 28 and np.array([1, 0, 1]) @ a == 10
    m = align.hcat(a.rename(["x"]), b.rename(["y"]))
    assert np.asarray(m).tolist() == [[1, 2], [4, 2], [9, 2]] and np.concatenate([m, m.rename(["p", "q"])], axis=1).cols == ("x", "y", "p", "q")
    w = np.array([[1.0, 0.5], [2.0, 0.0]])
    assert np.asarray(m @ w).tolist() == (np.asarray(m) @ w).tolist() and np.asarray(m @ w[:, 0]).tolist() == [5, 8, 13]
    with pytest.raises(ValueError, match="rows"):
        m @ np.ones(3)
    with pytest.raises(Exception, match="lengths differ"):
        a @ ser(spark, qq(2020, 1), [1, 2])


def test_overlay_of_numbers():
    assert align.overlay(NAN, None, 3.0, 4.0) == 3.0 and align.overlay(None) is None and math.isnan(align.overlay(NAN, NAN))


def test_correlation_with_holiday_options(spark):
    a = ser(spark, bdaily("2020-01-06"), [1, 2, NAN, 4, 8])
    b = ser(spark, bdaily("2020-01-06"), [1, 3, NAN, 2, 9])
    want = np.corrcoef([1, 2, 4, 8], [1, 3, 2, 9])[0, 1]
    assert stats.cor(a, b, skip_all_nans=True).first()[0] == pytest.approx(want)
    assert stats.cov(a, b, skip_all_nans=True).first()[0] == pytest.approx(np.cov([1, 2, 4, 8], [1, 3, 2, 9])[0, 1])
    m = align.hcat(a.rename(["x"]), b.rename(["y"]))
    cells = {(r["row"], r["col"]): r["value"] for r in stats.cor(m, skip_all_nans=True).collect()}
    assert cells["x", "y"] == pytest.approx(want) and cells["x", "x"] == 1
    with pytest.raises(Exception, match="different rows"):
        stats.cor(a, ser(spark, bdaily("2020-01-06"), [1, 3, 5, 2, 9]), skip_all_nans=True).collect()
    with pytest.raises(TypeError):
        stats.cor(ser(spark, qq(2020, 1), [1, 2]), ser(spark, qq(2020, 1), [1, 2]), skip_all_nans=True)
