"""Recursive equations: a key's periods in sequence, in one call per key.

A recurrence can't be split along its axis, so a key is the unit of parallel work; its state is one array of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.frequency import same_frequency
from seriesloom.functions.period import PeriodRange
from seriesloom.plans.frame import SeriesFrame


class Track:
    """One variable of a key during a recursion: read and written by period value."""

    def __init__(self, first: int, values: np.ndarray):
        self.first, self.values = first, values

    def __getitem__(self, t: int) -> float:
        at = t - self.first
        if not 0 <= at < len(self.values):
            raise IndexError(f"period {t} is outside the range")
        return float(self.values[at])

    def __setitem__(self, t: int, value: float) -> None:
        at = t - self.first
        if at < 0:
            self.values = np.concatenate([np.full(-at, np.nan), self.values])
            self.first, at = t, 0
        elif at >= len(self.values):
            self.values = np.concatenate([self.values, np.full(at - len(self.values) + 1, np.nan)])
        self.values[at] = value


def _per_key(s: SeriesFrame, run: Callable[[dict[str, Track]], None]) -> SeriesFrame:
    keys, cols = list(s.keys), list(s.cols)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mit")
        tracks = {c: Track(int(pdf["mit"].iloc[0]), pdf[c].to_numpy(dtype=float).copy()) for c in cols}
        run(tracks)
        lo, hi = min(t.first for t in tracks.values()), max(t.first + len(t.values) for t in tracks.values())
        out = {k: [pdf[k].iloc[0]] * (hi - lo) for k in keys} | {"mit": np.arange(lo, hi, dtype=np.int64)}
        for c, t in tracks.items():
            padded = np.full(hi - lo, np.nan)
            padded[t.first - lo : t.first - lo + len(t.values)] = t.values
            out[c] = padded
        return pd.DataFrame(out)

    types = dict(s.df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mit long", *(f"`{c}` double" for c in cols)])
    grouped = s.df.withColumn("_one", F.lit(0)).groupBy(*(keys or ["_one"]))
    return s.with_values(grouped.applyInPandas(apply, schema))


def rec(s: SeriesFrame, rng: PeriodRange, target: str, fn: Callable[[dict[str, Track], int], float]) -> SeriesFrame:
    """target[t] = fn(series, t) for each period value t of rng in its order.

    fn reads any variable of the handle as series[name][t - 1]; other series have to be variables of it. The range grows
    as far as rng asks.
    """
    same_frequency(s.freq, rng.freq)
    steps = list(rng.values)

    def run(tracks: dict[str, Track]) -> None:
        own = tracks[target]
        for t in steps:
            own[t] = fn(tracks, t)

    return _per_key(s, run)


def rec_linear(s: SeriesFrame, coefficients: Sequence[float], lags: Sequence[int], rng: PeriodRange, target: str | None = None) -> SeriesFrame:
    """target[t] = sum of coefficients times target[t - lag]; forward ranges take positive lags, backward ones negative.

    The initial conditions must exist.
    """
    same_frequency(s.freq, rng.freq)
    if len(coefficients) != len(lags):
        raise ValueError("as many lags as coefficients are needed")
    if not coefficients:
        raise ValueError("a coefficient is needed")
    if rng.step not in (1, -1):
        raise ValueError(f"the range must have step 1 or -1, got {rng.step}")
    if any(isinstance(k, bool) or not isinstance(k, int) or k * rng.step <= 0 for k in lags):
        raise ValueError("lags are integers, positive on a forward range and negative on a backward one")
    if not rng:
        return s
    name = target or s.only()
    steps, pairs = list(rng.values), [(float(c), int(k)) for c, k in zip(coefficients, lags, strict=True)]

    def run(tracks: dict[str, Track]) -> None:
        own = tracks[name]
        for k in (k for _, k in pairs):
            at = steps[0] - k
            if not own.first <= at < own.first + len(own.values):
                raise IndexError(f"no initial condition at lag {k}")
        for t in steps:
            total = 0.0
            for c, k in pairs:
                total += c * own[t - k]
            own[t] = total

    return _per_key(s, run)
