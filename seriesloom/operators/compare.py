"""Comparing series, handles and nested containers within a tolerance."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.period import PeriodRange, intersection_of
from seriesloom.operators.align import joined
from seriesloom.plans.frame import SeriesFrame

ROOT_EPSILON = math.sqrt(2.220446049250313e-16)


@dataclass(frozen=True)
class Difference:
    path: tuple[str, ...]
    message: str

    def __str__(self) -> str:
        return f"{'.'.join(self.path) or '(top)'}: {self.message}"


@dataclass(frozen=True)
class Comparison:
    differences: list[Difference] = field(default_factory=list)

    def __bool__(self) -> bool:
        return not self.differences

    def __str__(self) -> str:
        return "equal" if self else "\n".join(map(str, self.differences))


def tolerance(atol: float, rtol: float | None) -> float:
    """The relative tolerance where none is given: the root of machine epsilon, or 0 next to an absolute one."""
    return rtol if rtol is not None else 0.0 if atol > 0 else ROOT_EPSILON


def close(x: Column, y: Column, atol: float = 0.0, rtol: float | None = None, nans: bool = False) -> Column:
    r = tolerance(atol, rtol)
    both_nan = F.isnan(x) & F.isnan(y)
    near = (x == y) | (F.abs(x - y) <= atol + r * F.abs(y))
    return F.when(both_nan, F.lit(nans)).when(F.isnan(x) | F.isnan(y), F.lit(False)).otherwise(near)


def difference_counts(a: SeriesFrame, b: SeriesFrame, *, atol: float = 0.0, rtol: float | None = None, nans: bool = False) -> DataFrame:
    """Per key: rows only in a, rows only in b, and for each variable how many values differ."""
    both = joined(a.with_df(a.df.withColumn("_has_a", F.lit(True)), cols=(*a.cols, "_has_a")), b, "full")
    paired = F.col("_has_a") & F.col("_has_b")
    return both.groupBy(*a.keys).agg(
        F.count_if(F.col("_has_b").isNull()).alias("only_left"),
        F.count_if(F.col("_has_a").isNull()).alias("only_right"),
        *(F.count_if(paired & ~close(F.col(c), F.col(f"_b_{c}"), atol, rtol, nans)).alias(c) for c in a.cols if c in b.cols),
    )


def equals(a: SeriesFrame, b: SeriesFrame) -> bool:
    """Same frequency, variables, rows and values; missing values never equal."""
    return bool(compare(a, b, atol=0.0, rtol=0.0))


def allclose(a: SeriesFrame, b: SeriesFrame, atol: float = 1e-8, rtol: float = 1e-5) -> bool:
    """As equals, within a tolerance and with missing values equal."""
    return bool(compare(a, b, atol=atol, rtol=rtol, nans=True))


def compare(a: Any, b: Any, *, atol: float = 0.0, rtol: float | None = None, nans: bool = False, ignoremissing: bool = False, trange: PeriodRange | None = None) -> Comparison:
    """All differences of two values, handles or containers (mappings), with their paths.

    ignoremissing looks only at common names and common periods; trange only at its periods.
    """
    found: list[Difference] = []

    def missing_names(path: tuple[str, ...], left: list[str], right: list[str]) -> None:
        for n in left:
            if n not in right:
                found.append(Difference((*path, n), "missing in the right"))
        for n in right:
            if n not in left:
                found.append(Difference((*path, n), "missing in the left"))

    def series(path: tuple[str, ...], x: SeriesFrame, y: SeriesFrame) -> None:
        if x.freq != y.freq:
            found.append(Difference(path, f"frequencies differ: {x.freq} and {y.freq}"))
            return
        if not ignoremissing and x.cols != y.cols:
            missing_names(path, list(x.cols), list(y.cols))
            if set(x.cols) == set(y.cols):
                found.append(Difference(path, "variables come in another order"))
            return
        if trange is not None:
            x, y = x.slice(trange), y.slice(trange)
        if ignoremissing and not x.keys:
            common = intersection_of(x.range(), y.range())
            x, y = x.slice(common), y.slice(common)
        total = difference_counts(x, y, atol=atol, rtol=rtol, nans=nans)
        sums = total.agg(*(F.sum(c).alias(c) for c in total.columns if c not in x.keys)).first()
        if sums is None:
            return
        if not ignoremissing and (sums["only_left"] or sums["only_right"]):
            found.append(Difference(path, f"ranges differ: {sums['only_left'] or 0} rows only in the left, {sums['only_right'] or 0} only in the right"))
        for c in x.cols:
            if c in y.cols and sums[c]:
                found.append(Difference((*path, c) if len(x.cols) > 1 else path, f"{sums[c]} values differ"))

    def walk(path: tuple[str, ...], x: Any, y: Any) -> None:
        if isinstance(x, SeriesFrame) and isinstance(y, SeriesFrame):
            series(path, x, y)
        elif isinstance(x, Mapping) and isinstance(y, Mapping):
            if not ignoremissing:
                missing_names(path, list(x), list(y))
            for n in x:
                if n in y:
                    walk((*path, str(n)), x[n], y[n])
        elif isinstance(x, (list, tuple)) and isinstance(y, (list, tuple)):
            if len(x) != len(y):
                found.append(Difference(path, f"lengths differ: {len(x)} and {len(y)}"))
            for i, (p, q) in enumerate(zip(x, y, strict=False)):
                walk((*path, str(i)), p, q)
        elif _is_number(x) and _is_number(y):
            same = nans if math.isnan(x) and math.isnan(y) else x == y or abs(x - y) <= atol + tolerance(atol, rtol) * abs(y)
            if not same:
                found.append(Difference(path, f"values differ: {x!r} and {y!r}"))
        elif type(x) is not type(y) or x != y:
            found.append(Difference(path, f"values differ: {x!r} and {y!r}"))

    walk((), a, b)
    return Comparison(found)


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)
