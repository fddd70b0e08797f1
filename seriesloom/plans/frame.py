"""SeriesFrame: one series, a matrix of series or a panel of them, as a DataFrame with a frequency.

The DataFrame has the key columns, ``mit`` (the period's integer) and one double column per variable. Keys and mit are
unique together, every key has a row for each period between its first and last (sources.densify makes it so), and
missing values are NaN. A handle is immutable; what would change a series in place returns a new handle.

Windows never take a whole key into one task: rows are dealt out by key and block of periods, with the rows that
a frame reaches into copied over from the neighbouring blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.functions.frequency import Frequency, as_frequency, same_frequency
from seriesloom.functions.ieee import NAN, to_nan
from seriesloom.functions.period import Period, PeriodRange
from seriesloom.plans.algebra import Algebra

#: Periods of a block.
BLOCK = 4096


@dataclass(frozen=True, eq=False)
class SeriesFrame(Algebra):
    df: DataFrame
    freq: Frequency
    keys: tuple[str, ...] = ()
    cols: tuple[str, ...] = ("value",)

    def __post_init__(self) -> None:
        object.__setattr__(self, "freq", as_frequency(self.freq))
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "cols", tuple(self.cols))
        if len(set(self.cols)) != len(self.cols):
            raise ValueError(f"duplicate column names: {self.cols}")
        lost = {"mit", *self.keys, *self.cols} - set(self.df.columns)
        if lost:
            raise ValueError(f"the data has no column {sorted(lost)}")

    # --- make-up ---

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def index(self) -> list[str]:
        return [*self.keys, "mit"]

    def with_df(self, df: DataFrame, **changes) -> SeriesFrame:
        new = replace(self, df=df, **changes)
        return replace(new, df=df.select(*new.index, *new.cols))

    def with_values(self, df: DataFrame, **changes) -> SeriesFrame:
        """As with_df, for rows that come from pandas, where missing values have turned into nulls."""
        new = self.with_df(df, **changes)
        return new.with_df(new.df.select(*new.index, *(to_nan(F.col(c)).alias(c) for c in new.cols)))

    def each(self, f: Callable[[Column], Column]) -> SeriesFrame:
        """f applied to every variable, row by row."""
        return self.with_df(self.df.select(*self.index, *(f(F.col(c)).alias(c) for c in self.cols)))

    def only(self) -> str:
        if len(self.cols) != 1:
            raise ValueError(f"one variable is needed, found {self.cols}")
        return self.cols[0]

    # --- accessors ---

    def ranges(self) -> DataFrame:
        """first, last and length of every key."""
        return self.df.groupBy(*self.keys).agg(F.min("mit").alias("first"), F.max("mit").alias("last"), F.count("*").alias("length"))

    def range(self) -> PeriodRange:
        """Range over all keys."""
        lo, hi = self.df.agg(F.min("mit"), F.max("mit")).first()
        return PeriodRange(Period(self.freq, 1), Period(self.freq, 0)) if lo is None else PeriodRange(Period(self.freq, lo), Period(self.freq, hi))

    def first_date(self) -> Period:
        return self.range().first

    def last_date(self) -> Period:
        return self.range().last

    def length(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def check(self) -> SeriesFrame:
        """Raises an error unless keys and mit are unique, rows dense and mit given."""
        bad = self.df.groupBy(*self.keys).agg(F.count("*").alias("n"), F.count_distinct("mit").alias("d"), F.max("mit").alias("hi"), F.min("mit").alias("lo"))
        if not bad.where("n != d or hi - lo + 1 != d or lo is null").isEmpty():
            raise ValueError("periods must be unique and follow each other without gaps")
        return self

    # --- projections and point access ---

    def __getitem__(self, what: object) -> SeriesFrame:
        """Variables by name or list of names; rows by period or range; (rows, names) for both."""
        if isinstance(what, tuple) and len(what) == 2 and not all(isinstance(w, str) for w in what):
            return self[what[0]][what[1]]
        if isinstance(what, str):
            what = [what]
        if isinstance(what, (list, tuple)) and all(isinstance(w, str) for w in what):
            lost = set(what) - set(self.cols)
            if lost:
                raise KeyError(f"no variable {sorted(lost)}")
            return self.with_df(self.df, cols=tuple(what))
        if isinstance(what, Period):
            same_frequency(self.freq, what.freq)
            return self.with_df(self.df.where(F.col("mit") == what.value))
        if isinstance(what, PeriodRange):
            return self.slice(what)
        raise TypeError(f"can't index with {type(what).__name__}")

    def slice(self, rng: PeriodRange) -> SeriesFrame:
        same_frequency(self.freq, rng.freq)
        values = rng.values
        if not values:
            return self.with_df(self.df.where(F.lit(False)))
        step = abs(rng.step)
        within = F.col("mit").between(min(values[0], values[-1]), max(values[0], values[-1]))
        return self.with_df(self.df.where(within & (F.pmod(F.col("mit") - values[0], F.lit(step)) == 0) if step > 1 else within))

    def at(self, period: Period) -> dict[str, float] | float:
        """Values of a single series at a period."""
        rows = self[period].df.select(*self.cols).take(1)
        if not rows:
            raise IndexError(f"{period} is outside the range")
        return rows[0][0] if len(self.cols) == 1 else rows[0].asDict()

    def at_position(self, i: int) -> dict[str, float] | float:
        """Values of a single series at a position, from 0 on or from -1 backwards."""
        rng = self.range()
        if not -len(rng) <= i < len(rng):
            raise IndexError(f"position {i} is outside a range of {len(rng)}")
        return self.at(rng[i])

    def similar(self, value: float = NAN) -> SeriesFrame:
        """The same rows with one value everywhere."""
        return self.each(lambda _: F.lit(float(value)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Values at the periods of ``wanted``, a table (keys..., pos, mit); a period outside the range raises an error."""
        found = wanted.join(self.df.withColumn("_found", F.lit(True)), self.index, "left")
        return found.where(F.when(F.col("_found").isNull(), F.raise_error(F.lit("a key is outside the range")).cast("boolean")).otherwise(True)).drop("_found")

    def where(self, mask: SeriesFrame) -> SeriesFrame:
        """Rows at which the one variable of mask, a boolean, is true."""
        same_frequency(self.freq, mask.freq)
        chosen = mask.df.where(F.col(mask.only()).cast("boolean")).select(*mask.index)
        return self.with_df(self.df.join(chosen, mask.index, "left_semi"))

    def assign(self, rng: Period | PeriodRange, value: float | SeriesFrame, names: Iterable[str] | None = None) -> SeriesFrame:
        """A new handle with the variables named (all) set over a range: to a number, or to a series aligned by period.

        Periods of rng outside a key's own range extend it with missing values between.
        """
        names = tuple(names or self.cols)
        rng = PeriodRange(rng, rng) if isinstance(rng, Period) else rng
        grown = self.extend_to(rng)
        inside = F.col("mit").between(min(rng.values), max(rng.values))
        if not isinstance(value, SeriesFrame):
            return grown.with_df(grown.df.withColumns({c: F.when(inside, F.lit(float(value))).otherwise(F.col(c)) for c in names}))
        same_frequency(self.freq, value.freq)
        other = value.cols if len(value.cols) > 1 else value.cols * len(names)
        right = value.df.select(*value.index, F.lit(True).alias("_has"), *(F.col(o).alias(f"_new_{c}") for o, c in zip(other, names, strict=True)))
        joined = grown.df.join(right, value.index, "left")
        return grown.with_df(joined.withColumns({c: F.when(inside & F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in names}))

    def extend_to(self, rng: PeriodRange) -> SeriesFrame:
        """Every key's range widened to cover rng; new rows are missing."""
        lo, hi = min(rng.values), max(rng.values)
        edges = self.ranges()
        before = edges.where(F.col("first") > lo).select(*self.keys, F.explode(F.sequence(F.lit(lo).cast("long"), F.col("first") - 1)).alias("mit"))
        after = edges.where(F.col("last") < hi).select(*self.keys, F.explode(F.sequence(F.col("last") + 1, F.lit(hi).cast("long"))).alias("mit"))
        new = before.unionByName(after).select(*self.index, *(F.lit(NAN).alias(c) for c in self.cols))
        return self.with_df(self.df.select(*self.index, *self.cols).unionByName(new))

    def resize(self, rng: PeriodRange) -> SeriesFrame:
        """Every key over exactly rng: overlap kept, missing elsewhere."""
        return self.extend_to(rng).slice(rng)

    def rename(self, names: Iterable[str] | Mapping[str, str] | Callable[[str], str] | None = None, *, replace_text: tuple[str, str] | None = None, prefix: str = "", suffix: str = "") -> SeriesFrame:
        """Variables renamed by list, mapping, function, or by replaced text, prefix and suffix."""
        if names is None:
            def rule(c: str) -> str:
                return prefix + (c.replace(*replace_text) if replace_text else c) + suffix

            new = [rule(c) for c in self.cols]
        elif callable(names):
            new = [names(c) for c in self.cols]
        elif isinstance(names, Mapping):
            new = [names.get(c, c) for c in self.cols]
        else:
            new = list(names)
        if len(new) != len(self.cols) or len(set(new)) != len(new):
            raise ValueError(f"need {len(self.cols)} different names, got {new}")
        df = self.df.select(*self.index, *(F.col(c).alias(n) for c, n in zip(self.cols, new, strict=True)))
        return SeriesFrame(df, self.freq, self.keys, tuple(new))

    def shifted_axis(self, by: int) -> SeriesFrame:
        return self.with_df(self.df.withColumn("mit", F.col("mit") + by))

    def reindex(self, old: Period, new: Period) -> SeriesFrame:
        """Relabelled so that ``old`` becomes ``new``, which may be of another frequency."""
        same_frequency(self.freq, old.freq)
        return self.with_df(self.df.withColumn("mit", F.col("mit") + (new.value - old.value)), freq=new.freq)

    def strip(self) -> SeriesFrame:
        """Without leading and trailing rows in which no variable has a value."""
        some = F.lit(False)
        for c in self.cols:
            some = some | ~F.isnan(c)
        edges = self.df.groupBy(*self.keys).agg(F.min(F.when(some, F.col("mit"))).alias("_lo"), F.max(F.when(some, F.col("mit"))).alias("_hi"))
        joined = self.df.join(edges, list(self.keys)) if self.keys else self.df.crossJoin(F.broadcast(edges))  # one row
        return self.with_df(joined.where(F.col("mit").between(F.col("_lo"), F.col("_hi"))))

    # --- display columns ---

    def labelled(self) -> DataFrame:
        """Rows with the period's text form, in order."""
        return self.df.withColumn("period", calendar.label(self.freq, F.col("mit"))).orderBy(*self.index)

    def dated(self, ref: str = "end") -> DataFrame:
        return self.df.withColumn("date", calendar.to_date(self.freq, F.col("mit"), ref))

    # --- windows by block ---

    def windowed(self, make: Callable[[Window], Mapping[str, Column]], before: int = 0, after: int = 0, keep: Callable[[Window], Column] | None = None) -> SeriesFrame:
        """The variables replaced by ``make(window)``, whose frames reach ``before`` rows back and ``after`` rows on.

        A block holds its own rows and, at its ends, those of its neighbours that frames can reach.
        """
        size = max(BLOCK, before + after)
        home, place = calendar.floor_div(F.col("mit"), size), F.pmod(F.col("mit"), F.lit(size))
        blocks = [home]
        if before:
            blocks.append(F.when(place >= size - before, home + 1))
        if after:
            blocks.append(F.when(place < after, home - 1))
        spread = self.df.withColumn("_block", F.explode(F.array_compact(F.array(*blocks))) if len(blocks) > 1 else home)
        window = Window.partitionBy(*self.keys, "_block").orderBy("mit")
        made = make(window)
        out = spread.select(*self.index, "_block", *(made[c].alias(c) for c in made), *([keep(window).alias("_keep")] if keep else []))
        out = out.where(home == F.col("_block"))
        if keep:
            out = out.where("_keep")
        return self.with_df(out, cols=tuple(made))
