"""Series from tables, values and pandas; series to tables and pandas."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.functions.frequency import Frequency, as_frequency, from_pandas_alias, same_frequency, to_pandas_alias
from seriesloom.functions.ieee import NAN, to_nan
from seriesloom.functions.period import Period, PeriodRange, containing, day_number, period_day
from seriesloom.operators.align import overlay, spread_over
from seriesloom.plans.frame import SeriesFrame
from seriesloom.plans.workspace import Workspace


def missing_value(dtype: object) -> object:
    """What stands for a missing value: NaN, the largest integer, or False."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return NAN
    if kind.kind in "iu":
        return int(np.iinfo(kind).max)
    if kind.kind == "b":
        return False
    raise TypeError(f"no missing value for {kind}")


def range_frame(spark: SparkSession, rng: PeriodRange) -> DataFrame:
    """mit for each period of a range, made on the executors."""
    values = rng.values
    return spark.range(values.start, values.stop, values.step).select(F.col("id").alias("mit"))


def series(spark: SparkSession, start: Period | PeriodRange, values: float | Iterable[float] | Callable[[int], Iterable[float]] | None = None, name: str = "value") -> SeriesFrame:
    """One series: a first period and values, or a range and a number, values, a function of the length, or nothing."""
    if isinstance(start, Period):
        if values is None or isinstance(values, (int, float)):
            raise TypeError("a first period needs values")
        values = [float(v) for v in values]
        rng = PeriodRange(start, start + (len(values) - 1))
    else:
        rng = start
        if values is None or isinstance(values, (int, float)):
            df = range_frame(spark, rng).withColumn(name, F.lit(NAN if values is None else float(values)))
            return SeriesFrame(df, rng.freq, (), (name,))
        values = [float(v) for v in (values(len(rng)) if callable(values) else values)]
        if len(values) != len(rng):
            raise ValueError(f"the range has {len(rng)} periods, there are {len(values)} values")
    rows = list(zip(rng.values, values, strict=True))
    return SeriesFrame(spark.createDataFrame(rows, f"mit long, `{name}` double"), rng.freq, (), (name,))


def matrix(spark: SparkSession, start: Period | PeriodRange | None = None, **columns: SeriesFrame | float | Sequence[float]) -> SeriesFrame:
    """Variables side by side: series aligned by period, numbers, or values from the first period on."""
    own = [c for c in columns.values() if isinstance(c, SeriesFrame)]
    if start is None:
        if not own:
            raise ValueError("a range is needed where no series gives one")
        base = overlay(*(c.rename([n]) for n, c in columns.items() if isinstance(c, SeriesFrame)))
        rng = base.range()
    else:
        lengths = {len(c) for c in columns.values() if isinstance(c, (list, tuple, np.ndarray))}
        if isinstance(start, Period) and len(lengths) != 1:
            raise ValueError("a first period needs values of one length")
        rng = PeriodRange(start, start + (lengths.pop() - 1)) if isinstance(start, Period) else start
    same_frequency(rng.freq, *(c.freq for c in own))
    out = range_frame(spark, rng)
    for name, c in columns.items():
        if isinstance(c, SeriesFrame):
            out = out.join(c.df.select("mit", F.col(c.only()).alias(name)), "mit", "left").withColumn(name, to_nan(F.col(name)))
        elif isinstance(c, (int, float)):
            out = out.withColumn(name, F.lit(float(c)))
        else:
            out = out.join(series(spark, rng, list(c), name).df, "mit")
    return SeriesFrame(out, rng.freq, (), tuple(columns))


def densify(df: DataFrame, freq: object, keys: Sequence[str] = (), cols: Sequence[str] = ("value",), rng: PeriodRange | None = None) -> SeriesFrame:
    """A handle from rows with gaps: each key gets all periods between its first and last (or of rng), new ones missing.

    Null values become NaN. Rows need unique keys and mit.
    """
    return SeriesFrame(spread_over(df, keys, cols, rng), as_frequency(freq), tuple(keys), tuple(cols))


def from_facts(facts: DataFrame, date: str | Column, freq: object, values: Mapping[str, Column], keys: Sequence[str] = (), bias: str = "nearest", fill: bool = True) -> SeriesFrame:
    """A series, or a panel by keys, aggregated from dated rows: values maps names to aggregate columns."""
    freq = as_frequency(freq)
    mit = calendar.from_date(freq, F.col(date) if isinstance(date, str) else date, bias)
    made = facts.groupBy(*keys, mit.alias("mit")).agg(*(v.cast("double").alias(n) for n, v in values.items())).where("mit is not null")
    if fill:
        return densify(made, freq, keys, tuple(values))
    return SeriesFrame(made.select(*keys, "mit", *(to_nan(F.col(n)).alias(n) for n in values)), freq, tuple(keys), tuple(values))


def pivoted(s: SeriesFrame, name_col: str, names: Sequence[str]) -> SeriesFrame:
    """A panel whose key name_col becomes one variable per name."""
    rest = [k for k in s.keys if k != name_col]
    wide = s.df.groupBy(*rest, "mit").pivot(name_col, list(names)).agg(F.first(s.only()))
    return SeriesFrame(spread_over(wide, rest, names), s.freq, tuple(rest), tuple(names))


def long(s: SeriesFrame, name_col: str = "name", value_col: str = "value") -> DataFrame:
    return s.df.unpivot(s.index, list(s.cols), name_col, value_col)


def save(s: SeriesFrame, path: str, mode: str = "error") -> None:
    """Parquet with the frequency in the column's metadata."""
    meta = {"freq": str(s.freq), "keys": list(s.keys), "cols": list(s.cols)}
    s.df.withMetadata("mit", {"seriesloom": meta}).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> SeriesFrame:
    df = spark.read.parquet(path)
    meta = df.schema["mit"].metadata["seriesloom"]
    return SeriesFrame(df, as_frequency(meta["freq"]), tuple(meta["keys"]), tuple(meta["cols"]))


# --- pandas -----------------------------------------------------------------------------------------------------------


def _axis(index: pd.Index, freq: Frequency | None) -> tuple[Frequency, list[int]]:
    """Frequency and period values of a pandas axis: periods, dates (with freq), integers (Unit), dates or Period objects."""
    if isinstance(index, pd.PeriodIndex):
        found = from_pandas_alias(index.freqstr)
        return found, [containing(found, p.end_time.date().toordinal()) for p in index]
    if len(index) and all(isinstance(x, Period) for x in index):
        return same_frequency(*(x.freq for x in index)), [x.value for x in index]
    if pd.api.types.is_integer_dtype(index):
        found = freq or Frequency("Unit")
        return found, [int(x) for x in index]
    if freq is None:
        raise ValueError("dates need a frequency")
    return freq, [containing(freq, day_number(pd.Timestamp(x).date()), "nearest") for x in index]


def from_pandas(spark: SparkSession, obj: pd.Series | pd.DataFrame, *, freq: object = None, time_col: str | None = None, name_col: str | None = None, value_col: str | None = None, to_workspace: bool = False) -> SeriesFrame | Workspace:
    """A handle from a Series, a wide DataFrame (a column per variable) or a long one (name_col and value_col).

    Periods must ascend without gaps; a name that has a period twice is an error.
    """
    freq = None if freq is None else as_frequency(freq)
    if isinstance(obj, pd.Series):
        obj = obj.to_frame(obj.name or "value")
    if name_col is not None:
        if value_col is None or time_col is None:
            raise ValueError("a long table needs time_col, name_col and value_col")
        if obj.duplicated([time_col, name_col]).any():
            raise ValueError("a name has a period twice")
        order = list(dict.fromkeys(obj[name_col]))
        obj = obj.pivot(index=time_col, columns=name_col, values=value_col)[order]
    elif time_col is not None:
        obj = obj.set_index(time_col)
    found, values = _axis(obj.index, freq)
    if values and values != list(range(values[0], values[0] + len(values))):
        raise ValueError("periods must ascend without gaps")
    names = [str(c) for c in obj.columns]
    rows = [(v, *map(float, row)) for v, row in zip(values, obj.to_numpy(dtype=float), strict=True)]
    out = SeriesFrame(spark.createDataFrame(rows, ", ".join(["mit long", *(f"`{n}` double" for n in names)])), found, (), tuple(names))
    return Workspace({n: out[n] for n in names}) if to_workspace else out


def _dates(freq: Frequency, values: Iterable[int], ref: str) -> list[dt.date]:
    return [dt.date.fromordinal(period_day(freq, v, ref)) for v in values]


def to_pandas(s: SeriesFrame, *, index: str = "auto", date_ref: str = "end") -> pd.Series | pd.DataFrame:
    """On the driver, in order of period: a Series for one variable, else a DataFrame; keys stay columns.

    index: auto (periods or dates where pandas has them, else text), mit (Period objects) or date.
    """
    if index not in ("auto", "mit", "date"):
        raise ValueError(f"index must be auto, mit or date, got {index!r}")
    pdf = s.df.select(*s.index, *s.cols).orderBy(*s.index).toPandas()
    values = pdf.pop("mit").tolist()
    if index == "mit" or (index == "auto" and s.freq.kind == "HalfYearly"):
        axis = pd.Index([Period(s.freq, v) for v in values], dtype=object)
    elif s.freq.kind == "Unit":
        if index == "date":
            raise TypeError("Unit has no dates")
        axis = pd.Index(values)
    elif index == "auto" and s.freq.kind not in ("Daily", "BDaily"):
        axis = pd.PeriodIndex(_dates(s.freq, values, "end"), freq=to_pandas_alias(s.freq))
    else:
        axis = pd.DatetimeIndex(_dates(s.freq, values, date_ref))
    pdf.index = axis
    return pdf[s.cols[0]] if len(s.cols) == 1 and not s.keys else pdf


def from_polars(spark: SparkSession, obj: object, *, freq: object = None, time_col: str = "time", **how) -> SeriesFrame | Workspace:
    """As from_pandas, for a polars DataFrame with a time column; needs polars."""
    try:
        import polars  # noqa: F401
    except ImportError as e:
        raise ImportError("from_polars needs the package polars") from e
    return from_pandas(spark, obj.to_pandas(), freq=freq, time_col=time_col, **how)


def to_polars(s: SeriesFrame, *, time_col: str = "time", date_ref: str = "end") -> object:
    """A polars DataFrame with a time column: dates, or integers for Unit."""
    try:
        import polars
    except ImportError as e:
        raise ImportError("to_polars needs the package polars") from e
    if time_col in s.cols:
        raise ValueError(f"{time_col!r} is a variable already")
    time = F.col("mit") if s.freq.kind == "Unit" else calendar.to_date(s.freq, F.col("mit"), date_ref)
    return polars.from_arrow(s.df.orderBy(*s.index).select(*s.keys, time.alias(time_col), *s.cols).toArrow())
