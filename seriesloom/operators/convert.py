"""Frequency conversion of series.

To a lower frequency each source period names its target by integer arithmetic, one aggregation gathers the values, and
the target periods at a key's ends that lack input are then dropped by arithmetic on the key's first and last period, which
the same aggregation brings along. To a higher frequency a row is exploded into its target periods.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import calendar, ieee
from seriesloom.functions.calendar import floor_div
from seriesloom.functions.frequency import Frequency, as_frequency, reject_unit
from seriesloom.functions.ieee import NAN
from seriesloom.functions.period import PeriodRange, convert_period, convert_range
from seriesloom.operators import bdays
from seriesloom.operators.align import join_keys
from seriesloom.plans.frame import SeriesFrame

HIGHER = ("const", "even", "linear")
LOWER = ("mean", "sum", "min", "max", "point", "begin", "end")

#: Aggregates of a value column v over periods t.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda v, t: F.avg(v),
    "sum": lambda v, t: F.sum(v),
    "min": lambda v, t: ieee.minimum(v),
    "max": lambda v, t: F.max(v),
    "begin": lambda v, t: F.min_by(v, t),
    "end": lambda v, t: F.max_by(v, t),
}


def convert(s: SeriesFrame, target: object, method: str | Callable | None = None, ref: str | None = None, *, skip_all_nans: bool = False, skip_holidays: bool = False, holidays_map: bdays.HolidayMap | None = None) -> SeriesFrame:
    """s at another frequency; every variable, every key.

    Higher: const (default), even, linear, or f(values, counts, ref=...) per key. Lower: mean (default), sum, min, max, point,
    begin, end, or f(values) -> number. ref is begin or end (default); methods begin and end have their own.
    """
    target, freq = as_frequency(target), s.freq
    if target == freq:
        return s
    reject_unit(target, freq)
    ref = ref or "end"
    if ref not in ("begin", "end"):
        raise ValueError(f"ref must be begin or end, got {ref!r}")
    options = {"skip_all_nans": skip_all_nans, "skip_holidays": skip_holidays, "holidays_map": holidays_map}
    if target.kind == "BDaily" and freq.kind == "Daily":
        return _to_business_days(s)
    if target.is_higher(freq):
        return _higher(s, target, method or "const", ref)
    if any(options.values()) and freq.kind != "BDaily":
        raise TypeError("holiday options need a business-daily series")
    if target.is_monthly_based and freq.is_monthly_based:
        return _lower_months(s, target, method or "mean", ref)
    if not target.is_monthly_based and target.kind != "Weekly":
        raise NotImplementedError(f"conversion from {freq} to {target}")
    return _lower_days(s, target, method or "mean", ref, **options)


# --- lower ------------------------------------------------------------------------------------------------------------


def _aggregated(s: SeriesFrame, to: Column, method: str | Callable, use: Column | None = None) -> DataFrame:
    """keys, _to, the variables, and the first and last source period and number of used rows of every target."""
    rows = s.df.withColumn("_to", to)
    if use is not None:
        rows = rows.withColumns({"_use": use})
    if callable(method):
        return _custom(rows, s, method, use is not None)
    make = AGGREGATES[method]

    def value(c: str) -> Column:
        own, at = F.col(c), F.col("mit")
        return make(own, at) if use is None else make(F.when(F.col("_use"), own), F.when(F.col("_use"), at))

    count = F.count("*") if use is None else F.count_if(F.col("_use"))
    return rows.groupBy(*s.keys, "_to").agg(F.min("mit").alias("_lo"), F.max("mit").alias("_hi"), count.alias("_n"), *(value(c).alias(c) for c in s.cols))


def _custom(rows: DataFrame, s: SeriesFrame, f: Callable[[np.ndarray], float], has_use: bool) -> DataFrame:
    """An aggregate that only Python knows: a target's values, in order of period, in one call."""
    cols, keys = list(s.cols), list(s.keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mit")
        used = pdf[pdf["_use"]] if has_use else pdf
        out = {k: [pdf[k].iloc[0]] for k in [*keys, "_to"]} | {"_lo": [pdf["mit"].min()], "_hi": [pdf["mit"].max()], "_n": [len(used)]}
        return pd.DataFrame(out | {c: [float(f(used[c].to_numpy())) if len(used) else NAN] for c in cols})

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_to long, _lo long, _hi long, _n long", *(f"`{c}` double" for c in cols)])
    made = rows.groupBy(*keys, "_to").applyInPandas(run, schema)
    return made.withColumns({c: ieee.to_nan(F.col(c)) for c in cols})


def _of_key(s: SeriesFrame, made: DataFrame) -> DataFrame:
    """made with _first and _last, the key's own range: a small aggregate of made, joined back."""
    return join_keys(made, made.groupBy(*s.keys).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last")), s.keys)


def _months(freq: Frequency, value: Column) -> tuple[Column, Column]:
    """The months of a period as a half-open interval."""
    start = value * freq.months - freq.shift
    return start, start + freq.months


def _holder(freq: Frequency, month: Column) -> Column:
    """Value of the period that has the month in it."""
    return floor_div(month + freq.shift, freq.months)


def _lower_months(s: SeriesFrame, target: Frequency, method: str | Callable, ref: str) -> SeriesFrame:
    """A source period belongs to the target period in which it ends (ref end) or starts (ref begin).

    Keys are dense, so a target period is whole if its first and last member are there. Under ref begin an aggregate needs
    the series to go on after the period as well. A single value is the last member that ends in the target period (end) or the
    one that holds its first month (begin): a filter, without a shuffle.
    """
    source, mit = s.freq, F.col("mit")
    if method in ("begin", "end"):
        method, ref = "point", method
    if not callable(method) and method not in LOWER:
        raise ValueError(f"method must be one of {LOWER}, got {method!r}")
    start, end = _months(source, mit)
    if method == "point":
        to = _holder(target, end - 1)
        opens, closes = _months(target, to)
        fits = closes < end + source.months if ref == "end" else opens >= start
        return s.with_df(s.df.withColumn("_to", to).where(fits).drop("mit").withColumnRenamed("_to", "mit"), freq=target)
    made = _aggregated(s, _holder(target, end - 1 if ref == "end" else start), method)
    opens, closes = _months(target, F.col("_to"))
    starts, ends = _months(source, F.col("_lo"))[0], _months(source, F.col("_hi"))[1]
    if ref == "end":
        whole = (starts <= opens) & (ends + source.months > closes)
    else:
        made = _of_key(s, made)
        whole = (starts - source.months < opens) & (_months(source, F.col("_last"))[1] > closes)
    return s.with_df(made.where(whole).withColumnRenamed("_to", "mit"), freq=target)


def _lower_days(s: SeriesFrame, target: Frequency, method: str | Callable, ref: str, skip_all_nans: bool, skip_holidays: bool, holidays_map: bdays.HolidayMap | None) -> SeriesFrame:
    source = s.freq
    single = method in ("point", "begin", "end")
    if method in ("begin", "end"):
        ref = method
    if method == "point":
        method = ref
    if not callable(method) and method not in AGGREGATES:
        raise ValueError(f"method must be one of {LOWER}, got {method!r}")
    day = calendar.period_day(source, F.col("mit"), "end" if single else ref)
    pads = F.lit(0), F.lit(0)
    calendar_map = bdays.resolve(holidays_map, skip_holidays)
    if calendar_map is not None or skip_all_nans:
        marked = s.df
        use = F.lit(True)
        if calendar_map is not None:
            marked = marked.join(F.broadcast(calendar_map.frame(s.spark)), "mit", "left")
            use = F.coalesce("is_business_day", F.raise_error(F.lit("the holiday map does not cover the range")).cast("boolean"))
        if skip_all_nans and holidays_map is None:
            use = use & ~F.isnan(s.only())
        made = _aggregated(SeriesFrame(marked, source, s.keys, s.cols), calendar.containing(target, day), method, use).where("_n > 0")
        edges = s.ranges().select(*s.keys, F.col("first").alias("_first"), F.col("last").alias("_last"))
        if calendar_map is not None:
            runs = calendar_map.frame(s.spark)
            edges = edges.join(F.broadcast(runs.select(F.col("mit").alias("_first"), "holidays_before")), "_first", "left").join(F.broadcast(runs.select(F.col("mit").alias("_last"), "holidays_after")), "_last", "left")
            pads = F.coalesce("holidays_before", F.lit(0)), F.coalesce("holidays_after", F.lit(0))
        made = join_keys(made, edges, s.keys)
    else:
        made = _of_key(s, _aggregated(s, calendar.containing(target, day), method))
    first, last = F.col("_first"), F.col("_last")
    lo, hi = calendar.containing(target, calendar.period_day(source, first)), calendar.containing(target, calendar.period_day(source, last))
    cut_lo = F.when(calendar.source_edge(source, target, lo, "begin") < first - pads[0], 1).otherwise(0) if not single or ref == "begin" else F.lit(0)
    cut_hi = F.when(calendar.source_edge(source, target, hi, "end") > last + pads[1], 1).otherwise(0) if not single or ref == "end" else F.lit(0)
    if source.kind == "Weekly":  # the weeks' own anchors set the range
        anchor = "end" if single else ref
        lo, hi = (calendar.containing(target, calendar.period_day(source, x, anchor)) for x in (first, last))
    out = made.where((F.col("_to") >= lo + cut_lo) & (F.col("_to") <= hi - cut_hi))
    return s.with_df(out.withColumnRenamed("_to", "mit"), freq=target)


def _to_business_days(s: SeriesFrame) -> SeriesFrame:
    kept = s.df.where(~F.pmod(F.col("mit"), F.lit(7)).isin(0, 6))
    return s.with_df(kept.withColumn("mit", calendar.bday_of(F.col("mit"), "previous")), freq=Frequency("BDaily"))


# --- higher -----------------------------------------------------------------------------------------------------------


def _targets(s: SeriesFrame, target: Frequency, ref: str) -> tuple[Column, Column]:
    """First and last target period of a source row."""
    source, mit = s.freq, F.col("mit")
    if target.is_monthly_based and source.is_monthly_based:
        start, end = _months(source, mit)
        # from the target period that holds the first month, or from the first that starts in the source period
        first = _holder(target, start if ref == "end" else start + target.months - 1)
        return first, first + source.months // target.months - 1
    begin, end = (calendar.period_day(source, mit, r) for r in ("begin", "end"))
    if target.kind == "Weekly":
        week = lambda day: calendar.week_of(day, target.end)
        if ref == "end":  # the week in which the next period begins belongs to that
            return week(begin), week(end + 1) - 1
        return week(begin - 1) + 1, week(end)
    if target.kind == "BDaily":
        return calendar.bday_of(begin, "next"), calendar.bday_of(end, "previous")
    return begin, end


def _higher(s: SeriesFrame, target: Frequency, method: str | Callable, ref: str) -> SeriesFrame:
    if callable(method):
        return _custom_spread(s, target, method, ref)
    if method not in HIGHER:
        raise ValueError(f"method must be one of {HIGHER}, got {method!r}")
    if s.freq.kind == "BDaily":
        return _weekends(s, method, ref)
    first, last = _targets(s, target, ref)
    if method == "const":
        spread = s.df.withColumn("_to", F.explode(F.sequence(first, last)))
        return s.with_df(spread.drop("mit").withColumnRenamed("_to", "mit"), freq=target)
    early = first
    if target.kind == "Weekly" and ref == "begin":  # the week that a key's first period shares with an earlier one counts, but is not given
        early = calendar.week_of(calendar.period_day(s.freq, F.col("mit"), "begin"), target.end)
    return _spread(s, target, early, last, method, ref)


def _spread(s: SeriesFrame, target: Frequency, early: Column, last: Column, method: str, ref: str) -> SeriesFrame:
    """even: equal shares. linear: between neighbouring values; at the open end the nearest slope goes on.

    early is the first target period as a key's first row counts it.
    """
    first, _ = _targets(s, target, ref)

    def build(w: Window) -> dict[str, Column]:
        here = F.when(F.lag("mit", 1).over(w).isNull(), early).otherwise(first)
        before = F.when(F.lag("mit", 2).over(w).isNull(), F.lag(early, 1).over(w)).otherwise(F.lag(first, 1).over(w))
        out = {"_given": first, "_a": here, "_b": last, "_na": F.lag(last, 1).over(w) - before + 1, "_nb": F.lead(last - first + 1, 1).over(w)}
        for c in s.cols:
            out |= {c: F.col(c), f"_p_{c}": F.lag(c, 1).over(w), f"_x_{c}": F.lead(c, 1).over(w)}
        return out

    near = s.windowed(build, 2, 1).df.withColumn("_to", F.explode(F.sequence("_a", "_b"))).where("_to >= _given")
    n, j = F.col("_b") - F.col("_a") + 1, F.col("_to") - F.col("_a")

    def value(c: str) -> Column:
        v, p, x = F.col(c), F.col(f"_p_{c}"), F.col(f"_x_{c}")
        if method == "even":
            return ieee.divide(v, n)
        alone = F.raise_error(F.lit("linear conversion needs two observations")).cast("double")
        if ref == "end":
            back = F.when(F.col("_nb").isNull(), alone).otherwise(v - (n - j - 1) * (x - v) / F.col("_nb"))
            return F.when(F.col("_na").isNull(), back).otherwise(p + (v - p) * (j + 1) / n)
        on = F.when(F.col("_na").isNull(), alone).otherwise(v + j * (v - p) / F.col("_na"))
        return F.when(F.col("_nb").isNull(), on).otherwise(v + (x - v) * j / n)

    out = near.select(*s.keys, F.col("_to").alias("mit"), *(value(c).alias(c) for c in s.cols))
    return s.with_df(out, freq=target)


def _weekends(s: SeriesFrame, method: str, ref: str) -> SeriesFrame:
    """Business days as days: weekends between two rows are missing (even), take Monday's (const, end) or Friday's (const, begin)
    value, or lie on the line between them."""
    def build(w: Window) -> dict[str, Column]:
        out = {"_has_next": F.lead("mit", 1).over(w).isNotNull()}
        for c in s.cols:
            out |= {c: F.col(c), f"_x_{c}": F.lead(c, 1).over(w)}
        return out

    day = calendar.bday_to_day(F.col("mit"))
    gap = F.col("_has_next") & (F.pmod(F.col("mit"), F.lit(5)) == 0)
    rows = s.windowed(build, 0, 1).df.withColumn("_j", F.explode(F.when(gap, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))

    def value(c: str) -> Column:
        v, x, j = F.col(c), F.col(f"_x_{c}"), F.col("_j")
        weekend = {"even": F.lit(NAN), "const": x if ref == "end" else v, "linear": v + (x - v) * j / 3}[method]
        return F.when(j == 0, v).otherwise(weekend)

    return s.with_df(rows.select(*s.keys, (day + F.col("_j")).alias("mit"), *(value(c).alias(c) for c in s.cols)), freq=Frequency("Daily"))


def _custom_spread(s: SeriesFrame, target: Frequency, f: Callable, ref: str) -> SeriesFrame:
    """f(values, counts, ref=ref) -> all target values of a key, in one call per key and variable."""
    if s.freq.kind == "BDaily":
        raise NotImplementedError("business days spread by const, even or linear only")
    first, last = _targets(s, target, ref)
    keys, cols = list(s.keys), list(s.cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mit")
        counts = (pdf["_b"] - pdf["_a"] + 1).to_numpy()
        n = int(counts.sum())
        out = {k: [pdf[k].iloc[0]] * n for k in keys} | {"mit": np.arange(n, dtype=np.int64) + int(pdf["_a"].iloc[0])}
        return pd.DataFrame(out | {c: np.asarray(f(pdf[c].to_numpy(), counts, ref=ref), dtype=float)[:n] for c in cols})

    rows = s.df.withColumns({"_a": first, "_b": last, "_one": F.lit(0)})
    types = dict(s.df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mit long", *(f"`{c}` double" for c in cols)])
    return s.with_values(rows.groupBy(*(keys or ["_one"])).applyInPandas(run, schema), freq=target)


# --- ranges -----------------------------------------------------------------------------------------------------------


def trim_series(s: SeriesFrame, target: object, direction: str = "both") -> SeriesFrame:
    """Restricted to target periods that the range fills; for handles whose keys share one range."""
    rng = convert_range(target, s.range(), direction)
    return s.slice(convert_range(s.freq, rng)) if rng else s.slice(PeriodRange(s.first_date(), s.first_date() - 1))


def extend_series(s: SeriesFrame, target: object, direction: str = "both", method: str = "mean") -> SeriesFrame:
    """Padded to whole target periods: with the mean of the period's own values, or the nearest value (end).

    Business-daily values leave missing ones out of both.
    """
    target = as_frequency(target)
    reject_unit(target, s.freq)
    if direction not in ("both", "begin", "end") or method not in ("mean", "end"):
        raise ValueError("direction must be both, begin or end, method mean or end")
    whole = s.range()
    out = s
    for at, edge in (("begin", whole.first), ("end", whole.last)):
        if direction not in ("both", at):
            continue
        to = convert_period(target, edge)
        want = convert_period(s.freq, to, at, **({"round_to": "next" if at == "begin" else "previous"} if s.freq.kind == "BDaily" else {}))
        if (at == "begin" and want >= edge) or (at == "end" and want <= edge):
            continue
        inside = convert_range(s.freq, PeriodRange(to, to))
        own = s.df.where(F.col("mit").between(inside.first.value, inside.last.value)) if method == "mean" else s.df
        clean = (lambda c: ieee.to_null(F.col(c))) if s.freq.kind == "BDaily" else F.col
        if method == "mean":
            fill = own.groupBy(*s.keys).agg(*(F.avg(clean(c)).alias(c) for c in s.cols))
        else:
            pick = F.min_by if at == "begin" else F.max_by
            fill = own.groupBy(*s.keys).agg(*(pick(F.col(c), F.when(clean(c).isNotNull(), F.col("mit"))).alias(c) for c in s.cols))
        lo, hi = (want.value, edge.value - 1) if at == "begin" else (edge.value + 1, want.value)
        pad = fill.withColumn("mit", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
        out = out.with_df(out.df.select(*s.index, *s.cols).unionByName(pad.select(*s.index, *(ieee.to_nan(F.col(c)).alias(c) for c in s.cols))))
    return out
