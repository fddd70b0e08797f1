"""Lags, differences, growth rates, moving windows and anchored sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from seriesloom.functions import calendar, ieee
from seriesloom.functions.period import Period
from seriesloom.operators.align import join_keys
from seriesloom.plans.frame import BLOCK, SeriesFrame


def shift(s: SeriesFrame, k: int) -> SeriesFrame:
    """Values k periods earlier on the axis: a positive k leads. Only the periods change."""
    return s.shifted_axis(-k)


def lag(s: SeriesFrame, k: int = 1) -> SeriesFrame:
    return shift(s, -k)


def lead(s: SeriesFrame, k: int = 1) -> SeriesFrame:
    return shift(s, k)


def with_shifted(s: SeriesFrame, k: int, make: Callable[[Column, Column], Column]) -> SeriesFrame:
    """make(value, value shifted by k) where both exist, in one window over dense rows."""
    def moved(c: str, w: Window) -> Column:
        return F.lag(c, -k).over(w) if k <= 0 else F.lead(c, k).over(w)

    def build(w: Window) -> dict[str, Column]:
        return {c: make(F.col(c), moved(c, w)) for c in s.cols}

    return s.windowed(build, max(-k, 0), max(k, 0), keep=lambda w: (F.lag("mit", -k) if k <= 0 else F.lead("mit", k)).over(w).isNotNull())


def diff(s: SeriesFrame, k: int = -1) -> SeriesFrame:
    """s - shift(s, k)."""
    return with_shifted(s, k, lambda a, b: a - b)


def pct(s: SeriesFrame, k: int = -1, islog: bool = False) -> SeriesFrame:
    """Percentage change against the value shifted by k; islog takes exponentials first."""
    own = s.each(F.exp) if islog else s
    return with_shifted(own, k, lambda a, b: 100 * ieee.divide(a - b, b))


def _made_of_months(s: SeriesFrame, what: str) -> int:
    if not s.freq.is_monthly_based:
        raise TypeError(f"{what} needs a yearly, half-yearly, quarterly or monthly series, got {s.freq}")
    return s.freq.per_year


def apct(s: SeriesFrame, islog: bool = False) -> SeriesFrame:
    """Annualised percentage change."""
    n = _made_of_months(s, "apct")
    own = s.each(F.exp) if islog else s
    return with_shifted(own, -1, lambda a, b: (F.pow(ieee.divide(a, b), F.lit(float(n))) - 1) * 100)


def ytypct(s: SeriesFrame) -> SeriesFrame:
    """Year-on-year percentage change."""
    return with_shifted(s, -_made_of_months(s, "ytypct"), lambda a, b: 100 * (ieee.divide(a, b) - 1))


def _moving(s: SeriesFrame, n: int, aggregate: Callable[[str], Column]) -> SeriesFrame:
    if n == 0:
        raise ValueError("the window must have a period at least")
    size = abs(n)
    back, on = (size - 1, 0) if n > 0 else (0, size - 1)

    def framed(w: Window) -> Window:
        return w.rowsBetween(-back, on)

    return s.windowed(lambda w: {c: aggregate(c).over(framed(w)) for c in s.cols}, back, on, keep=lambda w: F.count(F.lit(1)).over(framed(w)) == size)


def moving_sum(s: SeriesFrame, n: int) -> SeriesFrame:
    """Sum over n periods up to (n > 0) or from (n < 0) each period; full windows only."""
    return _moving(s, n, F.sum)


def moving_average(s: SeriesFrame, n: int) -> SeriesFrame:
    return _moving(s, n, F.avg)


moving = moving_average


def cumulative(s: SeriesFrame) -> SeriesFrame:
    """Running sums of every key: sums within blocks, then the sums of the blocks before."""
    block = calendar.floor_div(F.col("mit"), BLOCK)
    rows = s.df.withColumn("_block", block)
    keys = [*s.keys, "_block"]
    totals = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"_t_{c}") for c in s.cols))
    earlier = Window.partitionBy(*s.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0.0)).alias(f"_o_{c}") for c in s.cols))
    within = Window.partitionBy(*keys).orderBy("mit").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({f"_s_{c}": F.sum(c).over(within) for c in s.cols}).join(offsets, keys)
    return s.with_df(joined.select(*s.index, *((F.col(f"_s_{c}") + F.col(f"_o_{c}")).alias(c) for c in s.cols)))


def undiff(s: SeriesFrame, anchor: tuple[Period, float | SeriesFrame] | float | SeriesFrame = 0.0) -> SeriesFrame:
    """The series whose differences are s and whose value at the anchor's period is the anchor's value.

    Without a period the anchor lies one before the first difference (for a series: its value there). An anchor outside
    the range extends it with zero differences.
    """
    if isinstance(anchor, tuple):
        period, value = anchor
    else:
        period, value = None, anchor
    if period is None and not isinstance(value, SeriesFrame):
        # the sums start from the anchor, so one pass over them is enough
        start = s.ranges().select(*s.keys, (F.col("first") - 1).alias("mit"), *(F.lit(float(value)).alias(c) for c in s.cols))
        return s.with_df(cumulative(s).each(lambda v: v + float(value)).df.unionByName(start.where("mit is not null")))
    edges = s.ranges().select(*s.keys, "first", "last")
    at = edges.withColumn("_at", F.lit(period.value).cast("long") if period else F.col("first") - 1)
    before = at.where(F.col("_at") < F.col("first")).select(*s.keys, F.explode(F.sequence(F.col("_at"), F.col("first") - 1)).alias("mit"))
    after = at.where(F.col("_at") > F.col("last")).select(*s.keys, F.explode(F.sequence(F.col("last") + 1, F.col("_at"))).alias("mit"))
    zeros = before.unionByName(after).select(*s.index, *(F.lit(0.0).alias(c) for c in s.cols))
    sums = cumulative(s.with_df(s.df.select(*s.index, *s.cols).unionByName(zeros)))
    base = join_keys(sums.df, at.select(*s.keys, "_at"), s.keys).where(F.col("mit") == F.col("_at"))
    if isinstance(value, SeriesFrame):
        source = value.df.select(*value.index, *(F.col(v).alias(f"_a_{c}") for c, v in zip(s.cols, value.cols * (len(s.cols) // len(value.cols)), strict=True)))
        base = base.join(source, value.index)
    else:
        base = base.withColumns({f"_a_{c}": F.lit(float(value)) for c in s.cols})
    base = base.select(*s.keys, *((F.col(f"_a_{c}") - F.col(c)).alias(f"_d_{c}") for c in s.cols))
    moved = join_keys(sums.df, base, s.keys)
    return s.with_df(moved.select(*s.index, *((F.col(c) + F.col(f"_d_{c}")).alias(c) for c in s.cols)))


def undiff_into(var: SeriesFrame, dvar: SeriesFrame, fromdate: Period | None = None) -> SeriesFrame:
    """var with what follows fromdate (one before dvar's first) replaced by its value there plus the running sum of dvar."""
    c = var.only()
    edges = dvar.ranges()
    start = edges.select(*dvar.keys, (F.lit(fromdate.value).cast("long") if fromdate else F.col("first") - 1).alias("_from"))
    changes = join_keys(dvar.df, start, dvar.keys).where(F.col("mit") > F.col("_from"))
    sums = cumulative(dvar.with_df(changes)).rename([c])
    base = join_keys(var.df, start, var.keys).where(F.col("mit") == F.col("_from")).select(*var.keys, F.col(c).alias("_base"))
    new = join_keys(sums.df, base, var.keys).select(*var.index, (F.col(c) + F.col("_base")).alias("_new"))
    both = var.df.join(new, var.index, "full")
    return var.with_df(both.select(*var.index, F.coalesce("_new", c).alias(c)))
