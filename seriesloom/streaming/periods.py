"""Series from streams of dated rows, with Structured Streaming.

Period aggregates group by the period's integer; windows and sessions are those of event time with watermarks; recursions keep the last
values of every key as state.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.functions import calendar
from seriesloom.functions.frequency import as_frequency


def period_aggregates(rows: DataFrame, time: str, freq: object, values: Mapping[str, Column], keys: Sequence[str] = (), late: str = "1 day") -> DataFrame:
    """keys, mit and the aggregates of every period; use the update or complete mode for the output.

    A row's event time is its day, or for longer periods the last day of its period, with the period's length added to ``late``: a
    period stays open at least ``late`` beyond its end. Periods are grouped with a window of that time, so that a period's state
    goes once the watermark has passed it, and rows that come later still are dropped.
    """
    freq = as_frequency(freq)
    mit = calendar.from_date(freq, F.col(time))
    if freq.kind == "Daily":
        marked, event = rows.withWatermark(time, late).withColumn("mit", mit), time
    else:
        length = 31 * freq.months if freq.is_monthly_based else 7
        last = calendar.to_date(freq, mit, "end").cast("timestamp")
        marked, event = rows.withColumns({"mit": mit, "_end": last}).withWatermark("_end", f"{late} {length} days"), "_end"
    grouped = marked.groupBy(*keys, "mit", F.window(event, "1 day").alias("_day"))
    return grouped.agg(*(v.alias(n) for n, v in values.items())).drop("_day")


def sliding_windows(rows: DataFrame, time: str, length: str, slide: str | None, values: Mapping[str, Column], keys: Sequence[str] = (), late: str = "1 day") -> DataFrame:
    """Tumbling (no slide) or sliding windows of event time."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.withWatermark(time, late).groupBy(*keys, window.alias("window")).agg(*(v.alias(n) for n, v in values.items()))


def sessions(rows: DataFrame, time: str, gap: str, values: Mapping[str, Column], keys: Sequence[str] = (), late: str = "1 day") -> DataFrame:
    """Sessions that end after a gap, per key or over all rows."""
    marked = rows.withWatermark(time, late).withColumn("_one", F.lit(0))
    made = marked.groupBy(*(keys or ["_one"]), F.session_window(time, gap).alias("session")).agg(*(v.alias(n) for n, v in values.items()))
    return made.select(*keys, "session", *values)


def linear_filter(rows: DataFrame, key: str, order: str, value: str, coefficients: Sequence[float], gain: float = 1.0) -> DataFrame:
    """y[t] = sum of coefficients times y[t - lag], lags from 1, plus gain times the row's value: a recursion per key, kept as state.

    Within a micro-batch rows are taken in the order of ``order``; rows that come late are taken when they come.
    """
    weights = [float(c) for c in coefficients]
    types = dict(rows.dtypes)

    def step(keys: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else [0.0] * len(weights)
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        out = []
        for x in pdf[value].tolist():
            y = sum(c * p for c, p in zip(weights, past, strict=True)) + gain * x
            past = [y, *past[:-1]]
            out.append(y)
        state.update((past,))
        yield pd.DataFrame({key: [keys[0]] * len(pdf), order: pdf[order], "filtered": out})

    output = f"`{key}` {types[key]}, `{order}` {types[order]}, filtered double"
    return rows.groupBy(key).applyInPandasWithState(step, output, "past array<double>", "append", GroupStateTimeout.NoTimeout)
