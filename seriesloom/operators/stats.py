"""Statistics over whole series, per variable or per period. Missing values spread, as in IEEE arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import ieee
from seriesloom.functions.ieee import NAN
from seriesloom.operators.align import joined
from seriesloom.plans.frame import SeriesFrame


def _or_nan(v: Column) -> Column:
    return F.coalesce(v, F.lit(NAN))


def _deviation(c: Column, m: Column | float, power: float) -> Column:
    m = m if isinstance(m, Column) else F.lit(float(m))
    ratio = F.sum((c - m) * (c - m)) / F.nullif(F.count(c) - 1, F.lit(0))
    return F.when(F.count(c) <= 1, NAN).otherwise(F.pow(ratio, F.lit(power)) if power != 1 else ratio)


#: Aggregates of a column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": lambda c: _or_nan(F.avg(c)),
    "std": lambda c: _or_nan(F.stddev_samp(c)),
    "var": lambda c: _or_nan(F.var_samp(c)),
    "median": lambda c: _or_nan(ieee.guarded(c, F.percentile(c, F.lit(0.5)))),
    "sum": lambda c: _or_nan(F.sum(c)),
    "min": lambda c: _or_nan(ieee.minimum(c)),
    "max": lambda c: _or_nan(F.max(c)),
    "any": lambda c: F.bool_or((c != 0) & ~F.isnan(c)),
    "all": lambda c: F.bool_and((c != 0) | F.isnan(c)),
}


def _by_row(s: SeriesFrame, name: str) -> Column:
    """An aggregate over the variables of one row."""
    values = F.array(*(F.col(c) for c in s.cols))
    n = float(len(s.cols))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    some_nan = F.exists(values, F.isnan)
    ordered = F.array_sort(values)
    low, high = F.element_at(ordered, F.lit((len(s.cols) + 1) // 2)), F.element_at(ordered, F.lit(len(s.cols) // 2 + 1))
    made = {
        "sum": total,
        "mean": mean,
        "var": squares / (n - 1) if n > 1 else F.lit(NAN),
        "std": F.sqrt(squares / (n - 1)) if n > 1 else F.lit(NAN),
        "median": F.when(some_nan, NAN).otherwise((low + high) / 2),
        "min": F.when(some_nan, NAN).otherwise(F.array_min(values)),
        "max": F.when(some_nan, NAN).otherwise(F.array_max(values)),
    }
    return made[name]


def _only_business(s: SeriesFrame, made: SeriesFrame | None, skip: dict) -> SeriesFrame:
    """s without the rows that the holiday options leave out; made, a result by row, missing at those rows."""
    from seriesloom.operators import bdays

    if made is None:
        return bdays.cleaned(s, **skip)
    keep = bdays.keep_mask(s, **skip)
    if keep is None:
        return made
    marked = made.df.join(keep.df, made.index)
    return made.with_df(marked.withColumn("value", F.when(F.col("keep"), F.col("value")).otherwise(NAN)))


def reduce_by(s: SeriesFrame, name: str, axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    """axis None: one value per key over all cells; 0: one row per key, a column per variable; 1: a series over the variables.

    Business-daily series take skip_all_nans, skip_holidays and holidays_map.
    """
    make = AGGREGATES[name]
    if axis == 1:
        made = s.with_df(s.df.select(*s.index, _by_row(s, name).alias("value")), cols=("value",))
        return _only_business(s, made, skip) if skip else made
    if skip:
        s = _only_business(s, None, skip)
    if axis == 0:
        return s.df.groupBy(*s.keys).agg(*(make(F.col(c)).alias(c) for c in s.cols))
    if axis is not None:
        raise ValueError(f"axis must be None, 0 or 1, got {axis!r}")
    if len(s.cols) == 1:
        return s.df.groupBy(*s.keys).agg(make(F.col(s.cols[0])).alias("value"))
    return s.df.select(*s.keys, F.explode(F.array(*s.cols)).alias("_v")).groupBy(*s.keys).agg(make(F.col("_v")).alias("value"))


def mean(s: SeriesFrame, axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    return reduce_by(s, "mean", axis, **skip)


def std(s: SeriesFrame, axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    return reduce_by(s, "std", axis, **skip)


def var(s: SeriesFrame, axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    return reduce_by(s, "var", axis, **skip)


def median(s: SeriesFrame, axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    return reduce_by(s, "median", axis, **skip)


def quantile(s: SeriesFrame, p: float | Sequence[float], axis: int | None = None, **skip) -> DataFrame | SeriesFrame:
    """Exact quantiles with linear interpolation; several at once only over all cells (an array)."""
    if skip and axis != 1:
        s = _only_business(s, None, skip)
    if isinstance(p, (int, float)):
        make = lambda c: _or_nan(ieee.guarded(c, F.percentile(c, F.lit(float(p)))))
    elif axis is None:
        spread = F.array(*(F.lit(NAN) for _ in p))
        make = lambda c: F.when(F.max(F.isnan(c)), spread).otherwise(F.percentile(c, F.array(*(F.lit(float(x)) for x in p))))
    else:
        raise ValueError("several quantiles need axis None")
    if axis == 0:
        return s.df.groupBy(*s.keys).agg(*(make(F.col(c)).alias(c) for c in s.cols))
    if axis == 1:
        values, n = F.array_sort(F.array(*s.cols)), len(s.cols)
        place = float(p) * (n - 1)
        k, rest = int(place), place - int(place)
        a, b = F.element_at(values, F.lit(k + 1)), F.element_at(values, F.lit(min(k + 2, n)))
        value = F.when(F.exists(F.array(*s.cols), F.isnan), NAN).otherwise(a + (b - a) * rest)
        made = s.with_df(s.df.select(*s.index, value.alias("value")), cols=("value",))
        return _only_business(s, made, skip) if skip else made
    cells = s.df.select(*s.keys, F.explode(F.array(*s.cols)).alias("_v"))
    return cells.groupBy(*s.keys).agg(make(F.col("_v")).alias("value"))


def stdm(s: SeriesFrame, m: float, **skip) -> DataFrame:
    """Standard deviation around a given mean; NaN for one observation or none."""
    s = _only_business(s, None, skip) if skip else s
    return s.df.groupBy(*s.keys).agg(*(_deviation(F.col(c), m, 0.5).alias(c) for c in s.cols))


def varm(s: SeriesFrame, m: float, **skip) -> DataFrame:
    s = _only_business(s, None, skip) if skip else s
    return s.df.groupBy(*s.keys).agg(*(_deviation(F.col(c), m, 1).alias(c) for c in s.cols))


def _correlation(a: Column, b: Column) -> Column:
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    spoiled = F.max(F.isnan(a) | F.isnan(b))
    usable = ~(constant | spoiled)
    return F.when(usable, F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))).otherwise(NAN)


def _covariance(a: Column, b: Column) -> Column:
    return _or_nan(F.covar_samp(a, b))


def _pair(a: SeriesFrame, b: SeriesFrame, make: Callable[[Column, Column], Column]) -> DataFrame:
    x, y = a.only(), b.only()
    if a.df is b.df:
        return a.df.groupBy(*a.keys).agg(make(F.col(x), F.col(y)).alias("value"))
    both = joined(a, b, "full")
    unmatched = F.max(F.col(x).isNull() | F.col(f"_b_{y}").isNull())
    value = F.when(unmatched, F.raise_error(F.lit("the series need the same range")).cast("double")).otherwise(make(F.col(x), F.col(f"_b_{y}")))
    return both.groupBy(*a.keys).agg(value.alias("value"))


def _matrix(s: SeriesFrame, make: Callable[[Column, Column], Column], diagonal: Callable[[Column], Column]) -> DataFrame:
    """row, col, value for every pair of variables, from one aggregation of the upper triangle."""
    cells = {}
    for i, a in enumerate(s.cols):
        for j, b in enumerate(s.cols[i:], i):
            cells[i, j] = (diagonal(F.col(a)) if i == j else make(F.col(a), F.col(b))).alias(f"_{i}_{j}")
    made = s.df.groupBy(*s.keys).agg(*cells.values())
    out = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"_{min(i, j)}_{max(i, j)}").alias("value")) for i, a in enumerate(s.cols) for j, b in enumerate(s.cols)]
    return made.select(*s.keys, F.inline(F.array(*out)))


def _both(a: SeriesFrame, b: SeriesFrame, skip: dict, make: Callable[[Column, Column], Column]) -> DataFrame:
    """make over two series; with holiday options over the rows that both keep: no holidays, or none where either is missing."""
    if not skip:
        return _pair(a, b, make)
    x, y = a.only(), b.only()
    both = joined(a, b, "full")
    unmatched = F.col(x).isNull() | F.col(f"_b_{y}").isNull()
    checked = F.when(unmatched, F.raise_error(F.lit("the series need the same range")).cast("double"))
    if skip.get("skip_all_nans") and skip.get("holidays_map") is None:
        checked = checked.when(F.isnan(x) != F.isnan(f"_b_{y}"), F.raise_error(F.lit("the series miss different rows")).cast("double"))
    rows = both.select(*a.index, checked.otherwise(F.col(x)).alias("_x"), checked.otherwise(F.col(f"_b_{y}")).alias("_y"))
    kept = _only_business(a.with_df(rows, cols=("_x", "_y")), None, skip)
    return kept.df.groupBy(*a.keys).agg(make(F.col("_x"), F.col("_y")).alias("value"))


def cor(a: SeriesFrame, b: SeriesFrame | None = None, **skip) -> DataFrame:
    """Pearson correlation of two series of one range, or the matrix of a handle's variables; NaN for constants.

    Business-daily series take skip_all_nans, skip_holidays and holidays_map.
    """
    if b is not None:
        return _both(a, b, skip, _correlation)
    a = _only_business(a, None, skip) if skip else a
    return _matrix(a, _correlation, lambda c: F.lit(1.0) + 0 * F.coalesce(F.count(c), F.lit(0)))


def cov(a: SeriesFrame, b: SeriesFrame | None = None, **skip) -> DataFrame:
    """Covariance, as cor."""
    if b is not None:
        return _both(a, b, skip, _covariance)
    a = _only_business(a, None, skip) if skip else a
    return _matrix(a, _covariance, lambda c: _or_nan(F.var_samp(c)))
