"""Alignment by period: element-wise algebra, comparison, overlay, concatenation, copying."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import ieee
from seriesloom.functions.frequency import same_frequency
from seriesloom.functions.ieee import NAN
from seriesloom.functions.period import PeriodRange, bounds
from seriesloom.plans.frame import SeriesFrame

Operand = SeriesFrame | float | int
Binary = Callable[[Column, Column], Column]

#: Binary operators by sign.
ARITHMETIC: dict[str, Binary] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": ieee.divide,
    "//": ieee.floor_divide,
    "%": ieee.modulo,
    "**": lambda a, b: F.pow(a, b),
}
COMPARISON: dict[str, Binary] = {
    "==": ieee.equal,
    "!=": lambda a, b: ~ieee.equal(a, b),
    "<": ieee.less,
    "<=": lambda a, b: ieee.less(a, b) | ieee.equal(a, b),
    ">": lambda a, b: ieee.less(b, a),
    ">=": lambda a, b: ieee.less(b, a) | ieee.equal(a, b),
}
#: Element-wise functions of one argument by the names that NumPy has for them.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "negative": lambda v: -v,
    "positive": lambda v: v,
    "absolute": F.abs,
    "exp": F.exp,
    "log": lambda v: F.when(v > 0, F.log(v)).when(v == 0, -ieee.INF).otherwise(NAN),
    "log2": lambda v: F.when(v > 0, F.log2(v)).when(v == 0, -ieee.INF).otherwise(NAN),
    "log10": lambda v: F.when(v > 0, F.log10(v)).when(v == 0, -ieee.INF).otherwise(NAN),
    "log1p": lambda v: F.when(v > -1, F.log1p(v)).when(v == -1, -ieee.INF).otherwise(NAN),
    "expm1": F.expm1,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "square": lambda v: v * v,
    "reciprocal": lambda v: ieee.divide(F.lit(1.0), v),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "floor": lambda v: F.when(F.isnan(v) | (F.abs(v) == ieee.INF), v).otherwise(F.floor(v).cast("double")),
    "ceil": lambda v: F.when(F.isnan(v) | (F.abs(v) == ieee.INF), v).otherwise(F.ceil(v).cast("double")),
    "rint": F.rint,
    "sign": lambda v: F.when(F.isnan(v), NAN).otherwise(F.signum(v)),
    "isnan": lambda v: F.isnan(v).cast("double"),
    "isfinite": lambda v: (~F.isnan(v) & (F.abs(v) < ieee.INF)).cast("double"),
}


def pairs(a: SeriesFrame, b: SeriesFrame) -> list[tuple[str, str, str]]:
    """(column of a, column of b, name of the result): common names, or one variable against all of the other's."""
    if len(b.cols) == 1 and len(a.cols) >= 1 and a.cols != b.cols:
        return [(c, b.cols[0], c) for c in a.cols]
    if len(a.cols) == 1 and a.cols != b.cols:
        return [(a.cols[0], c, c) for c in b.cols]
    return [(c, c, c) for c in a.cols if c in b.cols]


def joined(a: SeriesFrame, b: SeriesFrame, how: str = "inner") -> DataFrame:
    """Rows of both by keys and period; b's variables as _b_<name>, and _has_b."""
    same_frequency(a.freq, b.freq)
    if set(b.keys) - set(a.keys):
        raise ValueError(f"the right operand has keys {b.keys}, the left one {a.keys}")
    right = b.df.select(*b.index, F.lit(True).alias("_has_b"), *(F.col(c).alias(f"_b_{c}") for c in b.cols))
    return a.df.select(*a.index, *a.cols).join(right, b.index, how)


def combine(a: Operand, b: Operand, op: Binary) -> SeriesFrame:
    """op over the periods (and keys) that both have; numbers apply to every row. The same data joins nothing."""
    if not isinstance(a, SeriesFrame):
        return b.each(lambda v: op(F.lit(float(a)), v))
    if not isinstance(b, SeriesFrame):
        return a.each(lambda v: op(v, F.lit(float(b))))
    chosen = pairs(a, b)
    names = tuple(n for _, _, n in chosen)
    same_frequency(a.freq, b.freq)
    if a.df is b.df and a.keys == b.keys:
        return a.with_df(a.df.select(*a.index, *(op(F.col(x), F.col(y)).alias(n) for x, y, n in chosen)), cols=names)
    both = joined(a, b)
    return a.with_df(both.select(*a.index, *(op(F.col(x), F.col(f"_b_{y}")).alias(n) for x, y, n in chosen)), cols=names)


def arithmetic(a: Operand, sign: str, b: Operand) -> SeriesFrame:
    return combine(a, b, ARITHMETIC[sign])


def compare_elements(a: Operand, sign: str, b: Operand) -> SeriesFrame:
    """Booleans over the common periods; comparisons with a missing value are false, != is true."""
    return combine(a, b, COMPARISON[sign])


def compare_positions(a: SeriesFrame, b: SeriesFrame) -> SeriesFrame:
    """Booleans by position from each key's first row on, whatever the periods; variables pair in order. Lengths must agree."""
    if len(a.cols) != len(b.cols):
        raise ValueError("as many variables are needed on both sides")
    first = b.ranges().select(*b.keys, F.col("first").alias("_theirs"), F.col("length").alias("_n"))
    own = a.ranges().select(*a.keys, F.col("first").alias("_ours"), F.col("length").alias("_m"))
    pairing = join_keys(own, first, a.keys)
    same_length = F.when(F.col("_n") != F.col("_m"), F.raise_error(F.lit("the lengths differ")).cast("boolean")).otherwise(True)
    left = join_keys(a.df, pairing, a.keys).where(same_length).withColumn("_at", F.col("mit") - F.col("_ours") + F.col("_theirs"))
    right = b.df.select(*b.keys, F.col("mit").alias("_at"), *(F.col(c).alias(f"_b_{c}") for c in b.cols))
    both = left.join(right, [*a.keys, "_at"])
    return a.with_df(both.select(*a.index, *(ieee.equal(F.col(x), F.col(f"_b_{y}")).alias(x) for x, y in zip(a.cols, b.cols, strict=True))))


def function(name: str, s: SeriesFrame) -> SeriesFrame:
    return s.each(FUNCTIONS[name])


def apply(s: SeriesFrame, f: Callable[[np.ndarray], np.ndarray]) -> SeriesFrame:
    """Any element-wise NumPy function, on batches of values; those in FUNCTIONS stay in the JVM."""
    name = getattr(f, "__name__", "")
    if isinstance(f, np.ufunc) and name in FUNCTIONS:
        return function(name, s)

    @F.pandas_udf("double")
    def batch(v: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(v.to_numpy(dtype=float)), dtype=float))

    return s.each(lambda v: ieee.to_nan(batch(v)))


def logical(a: Operand, what: str, b: Operand) -> SeriesFrame:
    """and, or, xor of values taken as true where they are not 0 (NaN counts as true)."""
    def true(v: Column) -> Column:
        return (v.cast("double") != 0) | F.isnan(v.cast("double"))

    made: dict[str, Binary] = {"and": lambda x, y: true(x) & true(y), "or": lambda x, y: true(x) | true(y), "xor": lambda x, y: true(x) != true(y)}
    return combine(a, b, made[what])


def maximum(a: Operand, b: Operand) -> SeriesFrame:
    return combine(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), NAN).otherwise(F.greatest(x, y)))


def minimum(a: Operand, b: Operand) -> SeriesFrame:
    return combine(a, b, lambda x, y: F.when(F.isnan(x) | F.isnan(y), NAN).otherwise(F.least(x, y)))


def update(a: SeriesFrame, sign: str, b: Operand) -> SeriesFrame:
    """a with op applied where b has a row too; all other rows of a stay (the in-place operators)."""
    op = ARITHMETIC[sign]
    if not isinstance(b, SeriesFrame):
        return combine(a, b, op)
    both = joined(a, b, "left")
    changed = {n: F.when(F.col("_has_b"), op(F.col(x), F.col(f"_b_{y}"))).otherwise(F.col(x)) for x, y, n in pairs(a, b)}
    return a.with_df(both.withColumns(changed))


def spread_over(df: DataFrame, keys: Sequence[str], cols: Sequence[str], rng: PeriodRange | None = None) -> DataFrame:
    """df with a row for each period of a key between its first and last (or of rng); new rows are NaN."""
    if rng is None:
        edges = df.groupBy(*keys).agg(F.min("mit").alias("_lo"), F.max("mit").alias("_hi")).where("_lo is not null")
    else:
        lo, hi = bounds(rng)
        edges = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        edges = edges.withColumns({"_lo": F.lit(lo).cast("long"), "_hi": F.lit(hi).cast("long")})
        df = df.where(F.col("mit").between(lo, hi))
    steps = edges.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("mit"))
    return steps.join(df, [*keys, "mit"], "left").select(*keys, "mit", *(ieee.to_nan(F.col(c)).alias(c) for c in cols))


def overlay(*parts: SeriesFrame | float | None, rng: PeriodRange | None = None) -> SeriesFrame | float | None:
    """The first value that is not missing, from left to right, over the span of all (or rng).

    Variables are the ordered union of all names. One aggregation, whatever the number of parts. With numbers among the parts, the
    first part that is not a missing number.
    """
    if not all(isinstance(p, SeriesFrame) for p in parts):
        return next((p for p in parts if isinstance(p, SeriesFrame) or not (p is None or p != p)), parts[-1])
    first = parts[0]
    freq = same_frequency(*(p.freq for p in parts))
    names = list(dict.fromkeys(c for p in parts for c in p.cols))
    tagged = []
    for priority, p in enumerate(parts):
        if p.keys != first.keys:
            raise ValueError("all parts need the same keys")
        tagged.append(p.df.select(*p.index, F.lit(priority).alias("_p"), *(ieee.to_null(F.col(c)).alias(c) if c in p.cols else F.lit(None).cast("double").alias(c) for c in names)))
    every = reduce(DataFrame.unionByName, tagged)
    best = every.groupBy(*first.index).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in names))
    return SeriesFrame(spread_over(best, first.keys, names, rng), freq, first.keys, tuple(names))


def hcat(*parts: SeriesFrame) -> SeriesFrame:
    """All variables side by side over the span of all, missing where a part has no row; names must differ."""
    names = [c for p in parts for c in p.cols]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names: {names}")
    return overlay(*parts)


def vcat(top: SeriesFrame, *blocks: SeriesFrame) -> SeriesFrame:
    """Blocks of rows below each other: periods follow on from the first one's, whatever the others' are."""
    rows, at = top.df.select(*top.index, *top.cols), top.ranges().select(*top.keys, "last")
    for b in blocks:
        if len(b.cols) != len(top.cols):
            raise ValueError("blocks need the same number of variables")
        edges = b.ranges().select(*b.keys, F.col("first").alias("_first"), F.col("length").alias("_n"))
        offset = join_keys(edges, at, top.keys)
        moved = join_keys(b.df, offset, top.keys)
        rows = rows.unionByName(moved.select(*top.keys, (F.col("mit") - F.col("_first") + F.col("last") + 1).alias("mit"), *(F.col(c).alias(n) for c, n in zip(b.cols, top.cols, strict=True))))
        at = offset.select(*top.keys, (F.col("last") + F.col("_n")).alias("last"))
    return top.with_df(rows)


def join_keys(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the one row that per_key has for their key; without keys per_key is a single row."""
    return rows.join(per_key, list(keys), how) if keys else rows.crossJoin(F.broadcast(per_key))


def copy_to(target: SeriesFrame, members: dict[str, SeriesFrame], rng: PeriodRange | None = None) -> SeriesFrame:
    """target with each member written into the variable of its name, where both have rows within rng."""
    for name, member in members.items():
        if name not in target.cols:
            continue
        source = member if rng is None else member.slice(rng)
        both = joined(target, source.rename([name]), "left")
        target = target.with_df(both.withColumn(name, F.when(F.col("_has_b"), F.col(f"_b_{name}")).otherwise(F.col(name))))
    return target


def dot(a: SeriesFrame, b: SeriesFrame) -> DataFrame:
    """Inner product over the common periods, a row per key."""
    both = joined(a, b)
    return both.groupBy(*a.keys).agg(F.sum(F.col(a.only()) * F.col(f"_b_{b.only()}")).alias("value"))


def inner(a: SeriesFrame, b: SeriesFrame) -> DataFrame:
    """Inner product by position, a row per key, whatever the periods; the lengths must agree."""
    ours = a.ranges().select(*a.keys, F.col("first").alias("_ours"), F.col("length").alias("_m"))
    theirs = b.ranges().select(*b.keys, F.col("first").alias("_theirs"), F.col("length").alias("_n"))
    pairing = join_keys(ours, theirs, a.keys)
    rows = join_keys(a.df, pairing, a.keys).withColumn("_at", F.col("mit") - F.col("_ours") + F.col("_theirs"))
    same = F.when(F.col("_m") != F.col("_n"), F.raise_error(F.lit("the lengths differ")).cast("boolean")).otherwise(True)
    both = rows.where(same).join(b.df.select(*b.keys, F.col("mit").alias("_at"), F.col(b.only()).alias("_b")), [*a.keys, "_at"])
    return both.groupBy(*a.keys).agg(F.sum(F.col(a.only()) * F.col("_b")).alias("value"))


def left_matmul(weights: DataFrame, s: SeriesFrame) -> DataFrame:
    """A matrix times a series: weights has row, position (from 0, in order of period) and weight; gives row and value per key."""
    edges = s.ranges().select(*s.keys, F.col("first").alias("_first"))
    placed = join_keys(s.df, edges, s.keys).withColumn("position", F.col("mit") - F.col("_first"))
    return placed.join(weights, "position").groupBy(*s.keys, "row").agg(F.sum(F.col(s.only()) * F.col("weight")).alias("value"))


def matmul(a: SeriesFrame, weights: dict[str, dict[str, float]]) -> SeriesFrame:
    """Rows of a times a matrix given as {result: {variable: weight}}: one projection."""
    def combination(w: dict[str, float]) -> Column:
        return reduce(lambda x, y: x + y, (F.col(c) * float(v) for c, v in w.items()))

    return a.with_df(a.df.select(*a.index, *(combination(w).alias(n) for n, w in weights.items())), cols=tuple(weights))
