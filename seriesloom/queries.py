"""The registered queries of the series operators, each with the SQL that gives the same rows.

Amounts are summed in whole units, so that sums are exact in any order; missing values come out as null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.functions.frequency import BDaily, Daily, Frequency, HalfYearly, Monthly, Quarterly, Unit, Weekly, Yearly
from seriesloom.functions.ieee import to_null
from seriesloom.functions.period import Period, PeriodRange, mm, qq, yy
from seriesloom.operators import align, bdays, compare, convert, recursion, stats, windows
from seriesloom.plans.frame import SeriesFrame
from seriesloom.plans.workspace import Workspace
from seriesloom.sources import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# --- series that the queries start from -------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str, freq: Frequency, keys: tuple[str, ...] = (), bias: str = "nearest", fill: bool = True) -> SeriesFrame:
    return frames.from_facts(table(spark, d, "orders"), "o_orderdate", freq, {"value": F.sum(F.floor("o_totalprice"))}, keys, bias, fill)


def shipped(spark: SparkSession, d: str, freq: Frequency, keys: tuple[str, ...]) -> SeriesFrame:
    return frames.from_facts(table(spark, d, "lineitem"), "l_shipdate", freq, {"value": F.sum(F.floor("l_extendedprice"))}, keys)


def flags(spark: SparkSession, d: str) -> SeriesFrame:
    """One variable per return flag, monthly."""
    return frames.pivoted(shipped(spark, d, Monthly(), ("l_returnflag",)), "l_returnflag", ["A", "N", "R"])


def out(s: SeriesFrame, digits: int | None = None) -> DataFrame:
    def own(c: str) -> Column:
        v = to_null(F.col(c).cast("double"))
        return (v if digits is None else F.round(v, digits)).alias(c)

    return s.df.select(*s.keys, "mit", *(own(c) for c in s.cols))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(to_null(F.col(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- the same in SQL --------------------------------------------------------------------------------------------------


def day(x: str) -> str:
    return f"({x}::DATE - DATE '0001-01-01' + 1)::BIGINT"


def fdiv(a: str, n: int) -> str:
    return f"floor(({a}) / {n}::DOUBLE)::BIGINT"


def pmod(a: str, n: int) -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def month(x: str) -> str:
    return f"(12 * year({x}) + month({x}) - 1)::BIGINT"


def date_of(x: str) -> str:
    return f"(DATE '0001-01-01' + (({x}) - 1)::INTEGER)"


def mit_sql(freq: Frequency, x: str, bias: str = "nearest") -> str:
    if freq.is_monthly_based:
        return fdiv(f"{month(x)} + {freq.shift}", freq.months)
    if freq.kind == "Daily":
        return day(x)
    if freq.kind == "Weekly":
        return f"(ceil({day(x)} / 7.0) + greatest(0, least(1, isodow({x}) - {freq.end})))::BIGINT"
    o, r = day(x), f"isodow({x})"
    sunday, saturday = (1 if bias in ("next", "nearest") else 0), (0 if bias == "next" else 1)
    return f"({o} - 2 * {fdiv(o, 7)} - CASE WHEN {r} = 7 THEN {-sunday} WHEN {r} = 6 THEN {saturday} ELSE 0 END)::BIGINT"


def month_start_sql(m: str) -> str:
    return f"make_date({fdiv(m, 12)}, ({pmod(m, 12)} + 1)::BIGINT, 1::BIGINT)"


def period_date_sql(freq: Frequency, v: str, ref: str = "end") -> str:
    if freq.is_monthly_based:
        first = f"(({v} + {0 if ref == 'begin' else 1}) * {freq.months} - {freq.shift})"
        return month_start_sql(first) if ref == "begin" else f"({month_start_sql(first)} - 1)::DATE"
    if freq.kind == "Weekly":
        return date_of(f"7 * {v} - {7 - freq.end}" + (" - 6" if ref == "begin" else ""))
    if freq.kind == "BDaily":
        return date_of(f"{v} + 2 * {fdiv(f'{v} - 1', 5)}")
    return date_of(v)


def dense(name: str, keys: str = "", cols: str = "value") -> str:
    """CTE body: name's rows with all periods between the first and last of each key."""
    k, on = (f"{keys}, ", f"{keys}, mit") if keys else ("", "mit")
    group = f"GROUP BY {keys}" if keys else ""
    return f"SELECT * FROM (SELECT {k}unnest(generate_series(lo, hi)) AS mit FROM (SELECT {k}min(mit) AS lo, max(mit) AS hi FROM {name} {group})) LEFT JOIN {name} USING ({on})"


def orders_sql(freq: Frequency, keys: str = "", bias: str = "nearest") -> str:
    """WITH clause whose table s is the series."""
    k = f"{keys}, " if keys else ""
    return f"""WITH s0 AS (SELECT {k}{mit_sql(freq, 'o_orderdate', bias)} AS mit, sum(floor(o_totalprice))::DOUBLE AS value FROM orders GROUP BY ALL),
s AS ({dense('s0', keys)})"""


def shipped_sql(freq: Frequency, keys: str) -> str:
    return f"""WITH s0 AS (SELECT {keys}, {mit_sql(freq, 'l_shipdate')} AS mit, sum(floor(l_extendedprice))::DOUBLE AS value FROM lineitem GROUP BY ALL),
s AS ({dense('s0', keys)})"""


FLAGS_SQL = f"""WITH f0 AS (SELECT {month('l_shipdate')} AS mit, (sum(floor(l_extendedprice)) FILTER (l_returnflag = 'A'))::DOUBLE AS "A",
(sum(floor(l_extendedprice)) FILTER (l_returnflag = 'N'))::DOUBLE AS "N", (sum(floor(l_extendedprice)) FILTER (l_returnflag = 'R'))::DOUBLE AS "R" FROM lineitem GROUP BY 1),
s AS ({dense('f0')})"""
M, Q, Y = Monthly(), Quarterly(), Yearly()


# --- the flagship query -----------------------------------------------------------------------------------------------

register(
    "entry_quarterly_growth",
    lambda spark, d: out(windows.ytypct(convert.convert(orders(spark, d, M), Q, "mean")), 6),
    f"""{orders_sql(M)}, q AS (SELECT {fdiv('mit', 3)} AS mit, avg(value) AS value FROM s GROUP BY 1 HAVING count(*) = 3),
    g AS (SELECT mit, 100 * (value / lag(value, 4) OVER (ORDER BY mit) - 1) AS value, lag(mit, 4) OVER (ORDER BY mit) AS had FROM q)
    SELECT mit, round(value, 6) AS value FROM g WHERE had IS NOT NULL""",
)

# --- calendar ---------------------------------------------------------------------------------------------------------


def _calendar(freq: Frequency, bias: str = "nearest") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        dates = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
        mit = calendar.from_date(freq, F.col("d"), bias)
        begin, end = (F.date_format(calendar.to_date(freq, mit, r), "yyyy-MM-dd") for r in ("begin", "end"))
        return dates.select(F.date_format("d", "yyyy-MM-dd").alias("d"), mit.alias("mit"), begin.alias("begin_date"), end.alias("end_date"), calendar.label(freq, mit).alias("label"))

    return run


def _label_sql(freq: Frequency) -> str:
    mark = str(freq)[len(freq.kind) :]
    if not freq.is_monthly_based:
        return f"strftime({period_date_sql(freq, 'mit')}, '%Y-%m-%d') || '{mark}'"
    n = 12 // freq.months
    sign = {"Yearly": "Y", "HalfYearly": "H", "Quarterly": "Q", "Monthly": "M"}[freq.kind]
    number = "''" if n == 1 else f"({pmod('mit', n)} + 1)::VARCHAR"
    return f"{fdiv('mit', n)}::VARCHAR || '{sign}' || {number} || '{mark}'"


def _calendar_sql(freq: Frequency, bias: str = "nearest") -> str:
    return f"""WITH dates AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), m AS (SELECT d, {mit_sql(freq, 'd', bias)} AS mit FROM dates)
    SELECT strftime(d, '%Y-%m-%d') AS d, mit, strftime({period_date_sql(freq, 'mit', 'begin')}, '%Y-%m-%d') AS begin_date,
    strftime({period_date_sql(freq, 'mit')}, '%Y-%m-%d') AS end_date, {_label_sql(freq)} AS label FROM m"""


for _name, _freq, _bias in (
    ("mit_daily", Daily(), "nearest"),
    ("mit_bdaily_previous", BDaily(), "previous"),
    ("mit_bdaily_next", BDaily(), "next"),
    ("mit_bdaily_nearest", BDaily(), "nearest"),
    ("mit_weekly_7", Weekly(), "nearest"),
    ("mit_weekly_4", Weekly(4), "nearest"),
    ("mit_monthly", M, "nearest"),
    ("mit_quarterly", Q, "nearest"),
    ("mit_quarterly_e2", Quarterly(2), "nearest"),
    ("mit_halfyearly", HalfYearly(), "nearest"),
    ("mit_halfyearly_e4", HalfYearly(4), "nearest"),
    ("mit_yearly", Y, "nearest"),
    ("mit_yearly_e9", Yearly(9), "nearest"),
):
    register(_name, _calendar(_freq, _bias), _calendar_sql(_freq, _bias))

register(
    "mit_year_period",
    lambda spark, d: orders(spark, d, Daily()).df.select("mit", calendar.year(Daily(), F.col("mit")).alias("year"), calendar.period(Daily(), F.col("mit")).alias("period")),
    f"{orders_sql(Daily())} SELECT mit, year({date_of('mit')})::BIGINT AS year, dayofyear({date_of('mit')})::BIGINT AS period FROM s",
)
register(
    "mit_convert",
    lambda spark, d: orders(spark, d, M).df.select("mit", *(calendar.convert(f, M, F.col("mit"), r).alias(n) for n, f, r in (("q_end", Q, "end"), ("y_begin", Y, "begin"), ("w_end", Weekly(), "end"), ("d_begin", Daily(), "begin")))),
    f"""{orders_sql(M)} SELECT mit, {fdiv('mit', 3)} AS q_end, {fdiv('mit', 12)} AS y_begin, {mit_sql(Weekly(), '(' + period_date_sql(M, 'mit') + ')')} AS w_end,
    {day(period_date_sql(M, 'mit', 'begin'))} AS d_begin FROM s""",
)

# --- sources ----------------------------------------------------------------------------------------------------------

register("densify_daily", lambda spark, d: out(orders(spark, d, Daily())), f"{orders_sql(Daily())} SELECT mit, value FROM s")
register("densify_panel", lambda spark, d: out(shipped(spark, d, M, ("l_suppkey",))), f"{shipped_sql(M, 'l_suppkey')} SELECT l_suppkey, mit, value FROM s")
register("range_scan", lambda spark, d: frames.range_frame(spark, PeriodRange(mm(1990, 1), mm(2010, 12), 3)), "SELECT unnest(generate_series(12 * 1990, 12 * 2010 + 11, 3))::BIGINT AS mit")
register(
    "series_range",
    lambda spark, d: shipped(spark, d, M, ("l_suppkey",)).ranges(),
    f"{shipped_sql(M, 'l_suppkey')} SELECT l_suppkey, min(mit) AS first, max(mit) AS last, count(*) AS length FROM s GROUP BY 1",
)
register("pivot_matrix", lambda spark, d: out(flags(spark, d)), f'{FLAGS_SQL} SELECT mit, "A", "N", "R" FROM s')
register(
    "unpivot_long",
    lambda spark, d: frames.long(flags(spark, d)).withColumn("value", to_null(F.col("value"))),
    f"{FLAGS_SQL} SELECT mit, 'A' AS name, \"A\" AS value FROM s UNION ALL SELECT mit, 'N', \"N\" FROM s UNION ALL SELECT mit, 'R', \"R\" FROM s",
)
register("constant_fill", lambda spark, d: out(frames.series(spark, PeriodRange(qq(2000, 1), qq(2004, 4)), 2.5)), "SELECT unnest(generate_series(8000, 8019))::BIGINT AS mit, 2.5::DOUBLE AS value")

# --- projections, filters, point access -------------------------------------------------------------------------------

register("slice_range", lambda spark, d: out(orders(spark, d, M)[PeriodRange(mm(1996, 3), mm(1998, 2))]), f"{orders_sql(M)} SELECT mit, value FROM s WHERE mit BETWEEN {12 * 1996 + 2} AND {12 * 1998 + 1}")
register(
    "slice_step",
    lambda spark, d: out(orders(spark, d, M)[PeriodRange(mm(1996, 3), mm(1998, 2), 4)]),
    f"{orders_sql(M)} SELECT mit, value FROM s WHERE mit BETWEEN {12 * 1996 + 2} AND {12 * 1998 + 1} AND (mit - {12 * 1996 + 2}) % 4 = 0",
)


def _mask(spark: SparkSession, d: str) -> DataFrame:
    s = orders(spark, d, M)
    return out(s.where(align.compare_elements(s, ">", 1_500_000.0)))


register("mask_filter", _mask, f"{orders_sql(M)} SELECT mit, value FROM s WHERE value > 1500000")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    s = orders(spark, d, M)
    wanted = spark.range(12).select((F.lit(12 * 1996) + F.col("id") * 3).alias("mit"), F.col("id").alias("pos"))
    return s.lookup(wanted).select("pos", "mit", "value")


register("lookup_keys", _lookup, f"{orders_sql(M)}, k AS (SELECT unnest(generate_series(0, 11))::BIGINT AS pos) SELECT pos, mit, value FROM k JOIN s ON mit = {12 * 1996} + pos * 3")
register(
    "resize_series",
    lambda spark, d: out(orders(spark, d, M).resize(PeriodRange(mm(1994, 7), mm(1996, 6)))),
    f"{orders_sql(M)}, g AS (SELECT unnest(generate_series({12 * 1994 + 6}, {12 * 1996 + 5}))::BIGINT AS mit) SELECT mit, value FROM g LEFT JOIN s USING (mit)",
)
register(
    "strip_series",
    lambda spark, d: out(orders(spark, d, M).resize(PeriodRange(mm(1990, 1), mm(2010, 12))).strip()),
    f"{orders_sql(M)} SELECT mit, value FROM s",
)
register(
    "trim_series",
    lambda spark, d: out(convert.trim_series(orders(spark, d, M)[PeriodRange(mm(1996, 2), mm(1999, 5))], Q)),
    f"{orders_sql(M)} SELECT mit, value FROM s WHERE mit BETWEEN {12 * 1996 + 3} AND {12 * 1999 + 2}",
)
register("rename_columns", lambda spark, d: out(flags(spark, d).rename(prefix="flag_")), f'{FLAGS_SQL} SELECT mit, "A" AS "flag_A", "N" AS "flag_N", "R" AS "flag_R" FROM s')
register("reindex_unit", lambda spark, d: out(orders(spark, d, M).reindex(mm(1995, 1), Period(Unit(), 1))), f"{orders_sql(M)} SELECT mit - {12 * 1995} + 1 AS mit, value FROM s")
register(
    "assign_range",
    lambda spark, d: out(orders(spark, d, Y).assign(PeriodRange(yy(1993), yy(1996)), 5.0)),
    f"{orders_sql(Y)} SELECT mit, 5.0::DOUBLE AS value FROM (SELECT unnest(generate_series(1993, 1996))::BIGINT AS mit) UNION ALL SELECT mit, value FROM s WHERE mit > 1996",
)

# --- alignment --------------------------------------------------------------------------------------------------------


def _two(spark: SparkSession, d: str) -> tuple[SeriesFrame, SeriesFrame]:
    s = orders(spark, d, M)
    return s[PeriodRange(mm(1995, 1), mm(1998, 12))], s[PeriodRange(mm(1997, 1), mm(2000, 6))].shifted_axis(-3)


TWO_SQL = f"""{orders_sql(M)}, a AS (SELECT * FROM s WHERE mit BETWEEN {12 * 1995} AND {12 * 1998 + 11}),
b AS (SELECT mit - 3 AS mit, value FROM s WHERE mit BETWEEN {12 * 1997} AND {12 * 2000 + 5})"""

for _name, _sign, _sql in (("add_misaligned", "+", "a.value + b.value"), ("sub_misaligned", "-", "a.value - b.value"), ("mul_misaligned", "*", "a.value * b.value / 1e6"), ("div_misaligned", "/", "round(a.value / b.value, 9)")):
    register(
        _name,
        lambda spark, d, sign=_sign: out(align.function("positive", align.arithmetic(*(lambda p: (p[0], sign, p[1]))(_two(spark, d)))).each(lambda v, sign=sign: v / 1e6 if sign == "*" else F.round(v, 9) if sign == "/" else v)),
        f"{TWO_SQL} SELECT mit, {_sql} AS value FROM a JOIN b USING (mit)",
    )
register("mul_scalar", lambda spark, d: out(align.arithmetic(orders(spark, d, M), "*", 2.5)), f"{orders_sql(M)} SELECT mit, value * 2.5 AS value FROM s")
register(
    "floor_mod_power",
    lambda spark, d: out(align.arithmetic(align.arithmetic(orders(spark, d, M), "//", -7.0), "%", 5.0)),
    f"{orders_sql(M)} SELECT mit, q - 5.0 * floor(q / 5.0) AS value FROM (SELECT mit, floor(value / -7.0) AS q FROM s)",
)
register(
    "elementwise_functions",
    lambda spark, d: out(align.function("sqrt", align.function("log1p", orders(spark, d, M))), 9),
    f"{orders_sql(M)} SELECT mit, round(sqrt(ln(1 + value)), 9) AS value FROM s",
)
register(
    "panel_ratio",
    lambda spark, d: out(align.arithmetic(shipped(spark, d, M, ("l_returnflag",)), "/", frames.from_facts(table(spark, d, "lineitem"), "l_shipdate", M, {"value": F.sum(F.floor("l_extendedprice"))})), 9),
    f"{shipped_sql(M, 'l_returnflag')}, t AS (SELECT {month('l_shipdate')} AS mit, sum(floor(l_extendedprice))::DOUBLE AS total FROM lineitem GROUP BY 1) SELECT l_returnflag, mit, round(value / total, 9) AS value FROM s JOIN t USING (mit)",
)


def _common(spark: SparkSession, d: str) -> DataFrame:
    m = flags(spark, d)
    return out(align.arithmetic(m[["A", "N"]], "+", m[["N", "R"]].shifted_axis(2)))


register("mvts_common_columns", _common, f'{FLAGS_SQL} SELECT a.mit, a."N" + b."N" AS "N" FROM s a JOIN s b ON a.mit = b.mit + 2')
register("inplace_left", lambda spark, d: out(align.update(_two(spark, d)[0], "+", _two(spark, d)[1])), f"{TWO_SQL} SELECT a.mit, CASE WHEN b.mit IS NULL THEN a.value ELSE a.value + b.value END AS value FROM a LEFT JOIN b USING (mit)")


def _comparisons(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    both = align.joined(a, b)
    return both.select("mit", *(f(F.col("value"), F.col("_b_value")).alias(n) for n, f in (("lt", align.COMPARISON["<"]), ("ge", align.COMPARISON[">="]), ("eq", align.COMPARISON["=="]), ("ne", align.COMPARISON["!="]))))


register("compare_ops", _comparisons, f"{TWO_SQL} SELECT mit, a.value < b.value AS lt, a.value >= b.value AS ge, a.value = b.value AS eq, a.value <> b.value AS ne FROM a JOIN b USING (mit)")
register("overlay_two", lambda spark, d: out(align.overlay(*_two(spark, d))), f"{TWO_SQL} SELECT mit, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (mit)")
register(
    "overlay_three_rng",
    lambda spark, d: out(align.overlay(*_two(spark, d), orders(spark, d, M), rng=PeriodRange(mm(1994, 1), mm(2001, 12)))),
    f"{TWO_SQL}, g AS (SELECT unnest(generate_series({12 * 1994}, {12 * 2001 + 11}))::BIGINT AS mit) SELECT mit, coalesce(a.value, b.value, s.value) AS value FROM g LEFT JOIN a USING (mit) LEFT JOIN b USING (mit) LEFT JOIN s USING (mit)",
)
register(
    "hcat_span",
    lambda spark, d: out(align.hcat(_two(spark, d)[0].rename(["a"]), _two(spark, d)[1].rename(["b"]))),
    f"{TWO_SQL} SELECT mit, a.value AS a, b.value AS b FROM a FULL JOIN b USING (mit)",
)
register(
    "vcat_blocks",
    lambda spark, d: out(align.vcat(*_two(spark, d))),
    f"{TWO_SQL} SELECT mit, value FROM a UNION ALL SELECT mit - (SELECT min(mit) FROM b) + (SELECT max(mit) FROM a) + 1, value FROM b",
)


def _copyto(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return out(Workspace(value=b).copy_to(a, PeriodRange(mm(1997, 3), mm(1997, 9))))


register("copyto_overlap", _copyto, f"{TWO_SQL} SELECT mit, CASE WHEN b.mit BETWEEN {12 * 1997 + 2} AND {12 * 1997 + 8} THEN b.value ELSE a.value END AS value FROM a LEFT JOIN b USING (mit)")

# --- statistics -------------------------------------------------------------------------------------------------------

_AVERAGE = {"mean": "avg(value)", "std": "stddev_samp(value)", "var": "var_samp(value)", "median": "median(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}
for _name, _sql in _AVERAGE.items():
    _digits = -4 if _name == "var" else 3
    register(
        f"stat_{_name}",
        lambda spark, d, name=_name, digits=_digits: rounded(stats.reduce_by(orders(spark, d, M), name), digits),
        f"{orders_sql(M)} SELECT round({_sql}, {_digits}) AS value FROM s",
    )
    register(
        f"stat_{_name}_panel",
        lambda spark, d, name=_name, digits=_digits: rounded(stats.reduce_by(shipped(spark, d, Q, ("l_returnflag",)), name), digits),
        f"{shipped_sql(Q, 'l_returnflag')} SELECT l_returnflag, round({_sql}, {_digits}) AS value FROM s GROUP BY 1",
    )
register(
    "quantiles",
    lambda spark, d: stats.quantile(orders(spark, d, M), [0.1, 0.25, 0.9]).select(*(F.round(F.col("value")[i], 4).alias(n) for i, n in enumerate(("p10", "p25", "p90")))),
    f"{orders_sql(M)} SELECT round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.9), 4) AS p90 FROM s",
)
register("stdm", lambda spark, d: rounded(stats.stdm(orders(spark, d, M), 1e6), 3), f"{orders_sql(M)} SELECT round(sqrt(sum((value - 1e6) * (value - 1e6)) / (count(*) - 1)), 3) AS value FROM s")
register("varm", lambda spark, d: rounded(stats.varm(orders(spark, d, M), 1e6), -4), f"{orders_sql(M)} SELECT round(sum((value - 1e6) * (value - 1e6)) / (count(*) - 1), -4) AS value FROM s")


def _flag(spark: SparkSession, d: str) -> SeriesFrame:
    """The months in which every flag has shipments."""
    return (lambda m: m.with_df(m.df.dropna().where(~(F.isnan("A") | F.isnan("N") | F.isnan("R")))))(flags(spark, d))


FULL_SQL = f'{FLAGS_SQL}, t AS (SELECT * FROM s WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL)'
register("cor_pair", lambda spark, d: rounded(stats.cor(*(lambda m: (m["A"], m["N"].with_df(m.df, cols=("N",))))(_flag(spark, d))), 9), f'{FULL_SQL} SELECT round(corr("A", "N"), 9) AS value FROM t')
register("cov_pair", lambda spark, d: rounded(stats.cov(*(lambda m: (m["A"], m["N"]))(_flag(spark, d))), -4), f'{FULL_SQL} SELECT round(covar_samp("A", "N"), -4) AS value FROM t')


def _matrix_sql(function: str, digits: int) -> str:
    cells = [f"SELECT '{a}' AS row, '{b}' AS col, round({function}(\"{a}\", \"{b}\"), {digits}) AS value FROM t" for a in "ANR" for b in "ANR"]
    return f"{FULL_SQL} {' UNION ALL '.join(cells)}"


register("cor_matrix", lambda spark, d: rounded(stats.cor(_flag(spark, d)), 9), _matrix_sql("corr", 9))
register("cov_matrix", lambda spark, d: rounded(stats.cov(_flag(spark, d)), -4), _matrix_sql("covar_samp", -4))
register("mean_axis0", lambda spark, d: rounded(stats.mean(_flag(spark, d), 0), 4), f'{FULL_SQL} SELECT round(avg("A"), 4) AS "A", round(avg("N"), 4) AS "N", round(avg("R"), 4) AS "R" FROM t')
register("mean_axis1", lambda spark, d: out(stats.mean(_flag(spark, d), 1), 4), f'{FULL_SQL} SELECT mit, round(("A" + "N" + "R") / 3.0, 4) AS value FROM t')
register("mean_all_cells", lambda spark, d: rounded(stats.mean(_flag(spark, d)), 4), f'{FULL_SQL} SELECT round(sum("A" + "N" + "R") / (3 * count(*)), 4) AS value FROM t')
register("std_axis1", lambda spark, d: out(stats.std(_flag(spark, d), 1), 3), f'{FULL_SQL} SELECT mit, round(list_aggregate(["A", "N", "R"], \'stddev_samp\'), 3) AS value FROM t')
register("median_axis1", lambda spark, d: out(stats.median(_flag(spark, d), 1), 3), f'{FULL_SQL} SELECT mit, round(list_aggregate(["A", "N", "R"], \'median\'), 3) AS value FROM t')

# --- windows ----------------------------------------------------------------------------------------------------------

register("shift_lead", lambda spark, d: out(windows.shift(orders(spark, d, M), 2)), f"{orders_sql(M)} SELECT mit - 2 AS mit, value FROM s")
register("lag_1", lambda spark, d: out(windows.lag(orders(spark, d, M))), f"{orders_sql(M)} SELECT mit + 1 AS mit, value FROM s")
register("lead_1", lambda spark, d: out(windows.lead(orders(spark, d, M))), f"{orders_sql(M)} SELECT mit - 1 AS mit, value FROM s")


def _lagged(expression: str, n: int, freq: Frequency = M, digits: int = 6) -> str:
    return f"""{orders_sql(freq)}, l AS (SELECT mit, value, lag(value, {n}) OVER (ORDER BY mit) AS b, lag(mit, {n}) OVER (ORDER BY mit) AS had FROM s)
    SELECT mit, round({expression}, {digits}) AS value FROM l WHERE had IS NOT NULL"""


register("diff_1", lambda spark, d: out(windows.diff(orders(spark, d, M)), 6), _lagged("value - b", 1))
register("diff_4", lambda spark, d: out(windows.diff(orders(spark, d, M), -4), 6), _lagged("value - b", 4))
register("diff_lead", lambda spark, d: out(windows.diff(orders(spark, d, M), 2), 6), f"{orders_sql(M)}, l AS (SELECT mit, value - lead(value, 2) OVER (ORDER BY mit) AS value, lead(mit, 2) OVER (ORDER BY mit) AS had FROM s) SELECT mit, value FROM l WHERE had IS NOT NULL")
register("pct", lambda spark, d: out(windows.pct(orders(spark, d, M)), 6), _lagged("100 * ((value - b) / b)", 1))
register("pct_log", lambda spark, d: out(windows.pct(orders(spark, d, M).each(lambda v: F.log(v)), islog=True), 6), _lagged("100 * ((exp(ln(value)) - exp(ln(b))) / exp(ln(b)))", 1))
register("apct", lambda spark, d: out(windows.apct(orders(spark, d, Q)), 4), _lagged("(pow(value / b, 4) - 1) * 100", 1, Q, 4))
register("ytypct", lambda spark, d: out(windows.ytypct(orders(spark, d, M)), 6), _lagged("100 * (value / b - 1)", 12))


def _moving_sql(frame: str, aggregate: str, n: int) -> str:
    return f"{orders_sql(M)}, w AS (SELECT mit, {aggregate}(value) OVER f AS value, count(*) OVER f AS n FROM s WINDOW f AS (ORDER BY mit ROWS BETWEEN {frame})) SELECT mit, round(value, 4) AS value FROM w WHERE n = {n}"


register("moving_avg_back", lambda spark, d: out(windows.moving_average(orders(spark, d, M), 4), 4), _moving_sql("3 PRECEDING AND CURRENT ROW", "avg", 4))
register("moving_avg_fwd", lambda spark, d: out(windows.moving_average(orders(spark, d, M), -4), 4), _moving_sql("CURRENT ROW AND 3 FOLLOWING", "avg", 4))
register("moving_sum", lambda spark, d: out(windows.moving_sum(orders(spark, d, M), 6), 4), _moving_sql("5 PRECEDING AND CURRENT ROW", "sum", 6))
register(
    "moving_panel",
    lambda spark, d: out(windows.moving_sum(shipped(spark, d, M, ("l_suppkey",)), 3)),
    f"{shipped_sql(M, 'l_suppkey')}, w AS (SELECT l_suppkey, mit, sum(value) OVER f AS value, count(*) OVER f AS n, count(value) OVER f AS v FROM s WINDOW f AS (PARTITION BY l_suppkey ORDER BY mit ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT l_suppkey, mit, CASE WHEN v = 3 THEN value END AS value FROM w WHERE n = 3",
)
register(
    "undiff_default",
    lambda spark, d: out(windows.undiff(windows.diff(orders(spark, d, M)))),
    f"{orders_sql(M)} SELECT mit, value - (SELECT arg_min(value, mit) FROM s) AS value FROM s",
)
register(
    "undiff_mid_anchor",
    lambda spark, d: out(windows.undiff(windows.diff(orders(spark, d, M)), (mm(1997, 6), 1000.0))),
    f"{orders_sql(M)} SELECT mit, value - (SELECT value FROM s WHERE mit = {12 * 1997 + 5}) + 1000 AS value FROM s WHERE mit > (SELECT min(mit) FROM s)",
)
register(
    "undiff_series_anchor",
    lambda spark, d: out(windows.undiff(windows.diff(orders(spark, d, M)), orders(spark, d, M))),
    f"{orders_sql(M)} SELECT mit, value FROM s",
)
register(
    "cumulative_sum",
    lambda spark, d: out(windows.cumulative(orders(spark, d, M))),
    f"{orders_sql(M)} SELECT mit, sum(value) OVER (ORDER BY mit) AS value FROM s",
)

# --- conversion to lower frequencies ----------------------------------------------------------------------------------


def _lower_sql(source: Frequency, target: Frequency, aggregate: str, count: int | None, digits: int = 4, keys: str = "") -> str:
    """Aggregates of whole periods: by number of source periods, or by dates where it varies."""
    base = shipped_sql(source, keys) if keys else orders_sql(source)
    k = f"{keys}, " if keys else ""
    to = fdiv(f"mit * {source.months} + {target.shift}", target.months) if source.is_monthly_based else mit_sql(target, "(" + period_date_sql(source, "mit") + ")")
    value = f"CASE WHEN count(value) = count(*) THEN {aggregate} END"
    whole = f"HAVING count(*) = {count}" if count else ""
    body = f"{base}, g AS (SELECT {k}{to} AS mit, {value} AS value, min(mit) AS lo, max(mit) AS hi FROM s GROUP BY ALL {whole})"
    if count:
        return f"{body} SELECT {k}mit, round(value, {digits}) AS value FROM g"
    first, last = period_date_sql(target, "mit", "begin"), period_date_sql(target, "mit")
    return f"{body}, e AS (SELECT min(lo) AS first, max(hi) AS last FROM g) SELECT mit, round(value, {digits}) AS value FROM g, e WHERE {mit_sql(source, '(' + first + ')', 'next')} >= first AND {mit_sql(source, '(' + last + ')', 'previous')} <= last"


_REDUCE = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "begin": "arg_min(value, mit)", "end": "arg_max(value, mit)"}
for _name, _from, _to, _method, _count in (
    ("fc_mq_mean", M, Q, "mean", 3),
    ("fc_mq_sum", M, Q, "sum", 3),
    ("fc_mq_min", M, Q, "min", 3),
    ("fc_mq_max", M, Q, "max", 3),
    ("fc_qy_mean", Q, Y, "mean", 4),
    ("fc_my_e9_mean", M, Yearly(9), "mean", 12),
    ("fc_mh_sum", M, HalfYearly(), "sum", 6),
    ("fc_mq_e2_mean", M, Quarterly(2), "mean", 3),
    ("fc_dm_mean", Daily(), M, "mean", None),
    ("fc_dw_sum", Daily(), Weekly(), "sum", None),
    ("fc_dw4_sum", Daily(), Weekly(4), "sum", None),
    ("fc_dy_mean", Daily(), Y, "mean", None),
    ("fc_wm_mean", Weekly(), M, "mean", None),
    ("fc_bm_mean", BDaily(), M, "mean", None),
    ("fc_bw_sum", BDaily(), Weekly(), "sum", None),
):
    register(_name, lambda spark, d, f=_from, t=_to, m=_method: out(convert.convert(orders(spark, d, f), t, m), 4), _lower_sql(_from, _to, _REDUCE[_method], _count))
register("fc_panel_mq_sum", lambda spark, d: out(convert.convert(shipped(spark, d, M, ("l_suppkey",)), Q, "sum"), 4), _lower_sql(M, Q, "sum(value)", 3, keys="l_suppkey"))
register("fc_mq_begin", lambda spark, d: out(convert.convert(orders(spark, d, M), Q, "begin")), f"{orders_sql(M)} SELECT {fdiv('mit', 3)} AS mit, value FROM s WHERE mit % 3 = 0")
register("fc_mq_end", lambda spark, d: out(convert.convert(orders(spark, d, M), Q, "end")), f"{orders_sql(M)} SELECT {fdiv('mit', 3)} AS mit, value FROM s WHERE mit % 3 = 2")
register("fc_dm_end", lambda spark, d: out(convert.convert(orders(spark, d, Daily()), M, "end")), f"{orders_sql(Daily())} SELECT {month(date_of('mit'))} AS mit, value FROM s WHERE day({date_of('mit + 1')}) = 1")
register("fc_db_sample", lambda spark, d: out(convert.convert(orders(spark, d, Daily()), BDaily())), f"{orders_sql(Daily())} SELECT {mit_sql(BDaily(), '(' + date_of('mit') + ')')} AS mit, value FROM s WHERE isodow({date_of('mit')}) < 6")
register(
    "fc_custom_range",
    lambda spark, d: out(convert.convert(orders(spark, d, M), Q, lambda v: float(np.max(v) - np.min(v)))),
    f"{orders_sql(M)} SELECT {fdiv('mit', 3)} AS mit, max(value) - min(value) AS value FROM s GROUP BY 1 HAVING count(*) = 3",
)

# --- conversion to higher frequencies ---------------------------------------------------------------------------------


def _higher_sql(source: Frequency, target: Frequency, kind: str, ref: str = "end", digits: int = 6) -> str:
    if target.is_monthly_based:
        n = source.months // target.months
        first, last = f"mit * {n}", f"mit * {n} + {n - 1}"
    elif target.kind == "Daily":
        first, last = (day(period_date_sql(source, "mit", r)) for r in ("begin", "end"))
    elif target.kind == "BDaily":
        first, last = (mit_sql(target, "(" + period_date_sql(source, "mit", r) + ")", b) for r, b in (("begin", "next"), ("end", "previous")))
    else:
        first = mit_sql(target, "(" + period_date_sql(source, "mit", "begin") + ")")
        last = mit_sql(target, "(" + period_date_sql(source, "(mit + 1)", "begin") + ")") + " - 1"
    spread = f"""{orders_sql(source)}, r AS (SELECT mit, value, {first} AS a, {last} AS b FROM s),
    x AS (SELECT *, b - a + 1 AS n, lag(value) OVER o AS p, lead(value) OVER o AS x, lag(b - a + 1) OVER o AS np, lead(b - a + 1) OVER o AS nx FROM r WINDOW o AS (ORDER BY mit)),
    e AS (SELECT *, unnest(generate_series(a, b)) AS t FROM x)"""
    end = "CASE WHEN p IS NULL THEN value - (n - (t - a) - 1) * (x - value) / nx ELSE p + (value - p) * (t - a + 1) / n END"
    begin = "CASE WHEN x IS NULL THEN value + (t - a) * (value - p) / np ELSE value + (x - value) * (t - a) / n END"
    value = {"const": "value", "even": "value / n", "linear": end if ref == "end" else begin}[kind]
    return f"{spread} SELECT t::BIGINT AS mit, round({value}, {digits}) AS value FROM e"


for _name, _from, _to, _method, _ref in (
    ("fc_yq_const", Y, Q, "const", "end"),
    ("fc_yq_even", Y, Q, "even", "end"),
    ("fc_yq_linear_end", Y, Q, "linear", "end"),
    ("fc_yq_linear_begin", Y, Q, "linear", "begin"),
    ("fc_qm_linear", Q, M, "linear", "end"),
    ("fc_md_const", M, Daily(), "const", "end"),
    ("fc_md_linear", M, Daily(), "linear", "begin"),
    ("fc_mb_even", M, BDaily(), "even", "end"),
    ("fc_mw_const", M, Weekly(), "const", "end"),
    ("fc_mw_even", M, Weekly(), "even", "end"),
    ("fc_wd_even", Weekly(), Daily(), "even", "end"),
):
    _digits = 4 if _method == "linear" else 6
    register(
        _name,
        lambda spark, d, f=_from, t=_to, m=_method, r=_ref, n=_digits: out(convert.convert(orders(spark, d, f), t, m, r), n),
        _higher_sql(_from, _to, _method, _ref, _digits),
    )


def _bd_daily_sql(value: str) -> str:
    return f"""{orders_sql(BDaily())}, x AS (SELECT mit, value, lead(value) OVER o AS x, lead(mit) OVER o AS had FROM s WINDOW o AS (ORDER BY mit)),
    e AS (SELECT *, unnest(CASE WHEN had IS NOT NULL AND mit % 5 = 0 THEN [0, 1, 2] ELSE [0] END) AS j FROM x)
    SELECT (mit + 2 * {fdiv('mit - 1', 5)} + j)::BIGINT AS mit, round(CASE WHEN j = 0 THEN value ELSE {value} END, 4) AS value FROM e"""


register("fc_bd_daily_const", lambda spark, d: out(convert.convert(orders(spark, d, BDaily()), Daily(), "const"), 4), _bd_daily_sql("x"))
register("fc_bd_daily_begin", lambda spark, d: out(convert.convert(orders(spark, d, BDaily()), Daily(), "const", "begin"), 4), _bd_daily_sql("value"))
register("fc_bd_daily_linear", lambda spark, d: out(convert.convert(orders(spark, d, BDaily()), Daily(), "linear"), 4), _bd_daily_sql("value + (x - value) * j / 3"))


def _extend(spark: SparkSession, d: str, method: str) -> DataFrame:
    return out(convert.extend_series(orders(spark, d, M)[PeriodRange(mm(1996, 2), mm(1998, 7))], Q, "both", method), 6)


EXTEND_SQL = f"{orders_sql(M)}, t AS (SELECT * FROM s WHERE mit BETWEEN {12 * 1996 + 1} AND {12 * 1998 + 6})"
register(
    "extend_mean",
    lambda spark, d: _extend(spark, d, "mean"),
    f"""{EXTEND_SQL} SELECT mit, round(value, 6) AS value FROM t UNION ALL SELECT {12 * 1996}, round(avg(value), 6) FROM t WHERE mit < {12 * 1996 + 3}
    UNION ALL SELECT unnest([{12 * 1998 + 7}, {12 * 1998 + 8}]), v FROM (SELECT round(avg(value), 6) AS v FROM t WHERE mit >= {12 * 1998 + 6})""",
)
register(
    "extend_end",
    lambda spark, d: _extend(spark, d, "end"),
    f"""{EXTEND_SQL} SELECT mit, value FROM t UNION ALL SELECT {12 * 1996}, value FROM t WHERE mit = {12 * 1996 + 1}
    UNION ALL SELECT unnest([{12 * 1998 + 7}, {12 * 1998 + 8}]), value FROM t WHERE mit = {12 * 1998 + 6}""",
)

# --- business days ----------------------------------------------------------------------------------------------------

#: A synthetic calendar: every 25th business day is a holiday.
FIRST_DAY, LAST_DAY = 520_000, 522_600


def holiday_map() -> bdays.HolidayMap:
    return bdays.HolidayMap(Period(BDaily(), FIRST_DAY), tuple(v % 25 != 0 for v in range(FIRST_DAY, LAST_DAY)))


def business(spark: SparkSession, d: str) -> SeriesFrame:
    """Orders by business day without those on weekends; days without orders, and every 7th, are missing."""
    s = frames.from_facts(table(spark, d, "orders").where(F.weekday("o_orderdate") < 5), "o_orderdate", BDaily(), {"value": F.sum(F.floor("o_totalprice"))})
    return s.with_df(s.df.withColumn("value", F.when(F.pmod(F.col("mit"), F.lit(7)) == 0, float("nan")).otherwise(F.col("value"))))


BUSINESS_SQL = f"""WITH s0 AS (SELECT {mit_sql(BDaily(), 'o_orderdate')} AS mit, sum(floor(o_totalprice))::DOUBLE AS value FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1),
s AS (SELECT mit, CASE WHEN mit % 7 <> 0 THEN value END AS value FROM ({dense('s0')}))"""
register("bd_clean_map", lambda spark, d: out(bdays.cleaned(business(spark, d), holidays_map=holiday_map())), f"{BUSINESS_SQL} SELECT mit, value FROM s WHERE mit % 25 <> 0")
register("bd_clean_nan", lambda spark, d: out(bdays.cleaned(business(spark, d), skip_all_nans=True)), f"{BUSINESS_SQL} SELECT mit, value FROM s WHERE value IS NOT NULL")
register(
    "bd_infill_fwd",
    lambda spark, d: out(bdays.shift(business(spark, d), 1, skip_all_nans=True)),
    f"{BUSINESS_SQL} SELECT mit - 1 AS mit, coalesce(value, first_value(value IGNORE NULLS) OVER (ORDER BY mit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM s",
)
register(
    "bd_infill_back",
    lambda spark, d: out(bdays.shift(business(spark, d), -1, skip_all_nans=True)),
    f"{BUSINESS_SQL} SELECT mit + 1 AS mit, coalesce(value, last_value(value IGNORE NULLS) OVER (ORDER BY mit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM s",
)
register(
    "bd_infill_holidays",
    lambda spark, d: out(bdays.shift(business(spark, d), 1, holidays_map=holiday_map())),
    f"""{BUSINESS_SQL}, o AS (SELECT mit, value, mit % 25 = 0 AS holiday FROM s),
    n AS (SELECT mit, value, holiday, min(CASE WHEN NOT holiday THEN mit END) OVER (ORDER BY mit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS source FROM o)
    SELECT n.mit - 1 AS mit, CASE WHEN n.value IS NULL AND n.holiday THEN t.value ELSE n.value END AS value FROM n LEFT JOIN s t ON t.mit = n.source""",
)
register(
    "bd_fc_holidays",
    lambda spark, d: out(convert.convert(business(spark, d), M, "mean", holidays_map=holiday_map()), 4),
    f"""{BUSINESS_SQL}, g AS (SELECT {month(period_date_sql(BDaily(), 'mit'))} AS mit, CASE WHEN count(value) = count(*) THEN avg(value) END AS value FROM s WHERE mit % 25 <> 0 GROUP BY 1),
    e AS (SELECT min(mit) AS a, max(mit) AS b FROM s)
    SELECT g.mit, round(value, 4) AS value FROM g, e WHERE {mit_sql(BDaily(), '(' + month_start_sql('g.mit') + ')', 'next')} >= a - CASE WHEN (a - 1) % 25 = 0 THEN 1 ELSE 0 END
    AND {mit_sql(BDaily(), '(' + month_start_sql('(g.mit + 1)') + ' - 1)::DATE', 'previous')} <= b + CASE WHEN (b + 1) % 25 = 0 THEN 1 ELSE 0 END""",
)
register(
    "bd_fc_skip_nans",
    lambda spark, d: out(convert.convert(business(spark, d), Q, "sum", skip_all_nans=True), 4),
    f"""{BUSINESS_SQL}, g AS (SELECT {fdiv(month(period_date_sql(BDaily(), 'mit')), 3)} AS mit, sum(value) AS value, min(mit) AS lo, max(mit) AS hi FROM s WHERE value IS NOT NULL GROUP BY 1), e AS (SELECT min(mit) AS a, max(mit) AS b FROM s)
    SELECT g.mit, round(value, 4) AS value FROM g, e WHERE {mit_sql(BDaily(), '(' + month_start_sql('g.mit * 3') + ')', 'next')} >= a AND {mit_sql(BDaily(), '(' + month_start_sql('(g.mit + 1) * 3') + ' - 1)::DATE', 'previous')} <= b""",
)

register("bd_mean_skip_nans", lambda spark, d: rounded(stats.mean(business(spark, d), skip_all_nans=True), 4), f"{BUSINESS_SQL} SELECT round(avg(value), 4) AS value FROM s")
register("bd_median_holidays", lambda spark, d: rounded(stats.median(bdays.cleaned(business(spark, d), skip_all_nans=True), holidays_map=holiday_map()), 4), f"{BUSINESS_SQL} SELECT round(median(value), 4) AS value FROM s WHERE mit % 25 <> 0 AND value IS NOT NULL")
register(
    "bd_row_mean_holidays",
    lambda spark, d: out(stats.mean(business(spark, d), 1, holidays_map=holiday_map())),
    f"{BUSINESS_SQL} SELECT mit, CASE WHEN mit % 25 <> 0 THEN value END AS value FROM s",
)
register(
    "compare_positions",
    lambda spark, d: (lambda s: align.compare_positions(s, s.shifted_axis(5)).df)(orders(spark, d, M)),
    f"{orders_sql(M)} SELECT mit, true AS value FROM s",
)

# --- recursion --------------------------------------------------------------------------------------------------------


def _fibonacci(spark: SparkSession, d: str) -> DataFrame:
    s = frames.series(spark, PeriodRange(Period(Unit(), 1), Period(Unit(), 40)), 1.0)
    return out(recursion.rec(s, PeriodRange(Period(Unit(), 3), Period(Unit(), 40)), "value", lambda x, t: x["value"][t - 1] + x["value"][t - 2]))


register("rec_fibonacci", _fibonacci, "WITH RECURSIVE f(mit, value, nxt) AS (SELECT 1::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT mit + 1, nxt, value + nxt FROM f WHERE mit < 40) SELECT mit, value FROM f")


def _ar2(spark: SparkSession, d: str) -> DataFrame:
    s = orders(spark, d, M)[PeriodRange(mm(1995, 1), mm(1998, 12))]
    return out(recursion.rec_linear(s, [0.5, 0.25], [1, 2], PeriodRange(mm(1995, 3), mm(1998, 12))), 4)


register(
    "rec_ar2",
    _ar2,
    f"""{orders_sql(M).replace('WITH ', 'WITH RECURSIVE ', 1)}, r(mit, value, prev) AS (SELECT mit, value, (SELECT value FROM s WHERE mit = {12 * 1995}) FROM s WHERE mit = {12 * 1995 + 1}
    UNION ALL SELECT mit + 1, 0.5 * value + 0.25 * prev, value FROM r WHERE mit < {12 * 1998 + 11})
    SELECT mit, round(value, 4) AS value FROM r UNION ALL SELECT mit, round(value, 4) FROM s WHERE mit = {12 * 1995}""",
)


def _backcast(spark: SparkSession, d: str) -> DataFrame:
    s = orders(spark, d, Y)
    return out(recursion.rec_linear(s, [0.5], [-1], PeriodRange(yy(1999), yy(1990), -1)), 4)


register(
    "rec_backcast",
    _backcast,
    f"{orders_sql(Y).replace('WITH ', 'WITH RECURSIVE ', 1)}, r(mit, value) AS (SELECT mit, value FROM s WHERE mit = 2000 UNION ALL SELECT mit - 1, 0.5 * value FROM r WHERE mit > 1990) SELECT mit, round(value, 4) AS value FROM r UNION ALL SELECT mit, round(value, 4) FROM s WHERE mit > 2000",
)


def _exogenous(spark: SparkSession, d: str) -> DataFrame:
    """Consumption out of income, per return flag."""
    s = shipped(spark, d, Q, ("l_returnflag",))
    both = SeriesFrame(s.df.withColumns({"income": F.coalesce(to_null(F.col("value")), F.lit(0.0)), "c": F.coalesce(to_null(F.col("value")), F.lit(0.0))}), Q, s.keys, ("income", "c"))
    made = recursion.rec(both, PeriodRange(qq(1996, 1), qq(1998, 4)), "c", lambda x, t: 0.6 * x["c"][t - 1] + 0.4 * x["income"][t])
    return out(made[PeriodRange(qq(1995, 4), qq(1998, 4))], 4)


register(
    "rec_exog_panel",
    _exogenous,
    f"""{shipped_sql(Q, 'l_returnflag').replace('WITH ', 'WITH RECURSIVE ', 1)}, i AS (SELECT l_returnflag, mit, coalesce(value, 0) AS income FROM s),
    r(l_returnflag, mit, income, c) AS (SELECT l_returnflag, mit, income, income FROM i WHERE mit = {4 * 1995 + 3}
    UNION ALL SELECT i.l_returnflag, i.mit, i.income, 0.6 * r.c + 0.4 * i.income FROM r JOIN i ON i.l_returnflag = r.l_returnflag AND i.mit = r.mit + 1 WHERE i.mit <= {4 * 1998 + 3})
    SELECT l_returnflag, mit, round(income, 4) AS income, round(c, 4) AS c FROM r""",
)

# --- workspace, comparison, matrices ----------------------------------------------------------------------------------


def _tolerance(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return compare.difference_counts(a, b, atol=50_000.0)


register(
    "compare_tolerance",
    _tolerance,
    f"{TWO_SQL} SELECT count(*) FILTER (b.mit IS NULL) AS only_left, count(*) FILTER (a.mit IS NULL) AS only_right, count(*) FILTER (a.mit IS NOT NULL AND b.mit IS NOT NULL AND NOT abs(a.value - b.value) <= 50000) AS value FROM a FULL JOIN b ON a.mit = b.mit",
)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    w = Workspace(y=convert.convert(orders(spark, d, Y), Q, "const"), q=orders(spark, d, Q), m=convert.convert(orders(spark, d, M), Q, "mean"))
    return out(align.arithmetic(align.arithmetic(w.q, "-", w.m), "/", w.y), 9)


register(
    "mixed_freq_pipeline",
    _mixed,
    f"""WITH m AS (SELECT {month('o_orderdate')} AS mit, sum(floor(o_totalprice))::DOUBLE AS value FROM orders GROUP BY 1), q AS (SELECT {fdiv('mit', 3)} AS mit, sum(value) AS value FROM m GROUP BY 1),
    a AS (SELECT {fdiv('mit', 3)} AS mit, avg(value) AS value FROM m GROUP BY 1 HAVING count(*) = 3), y AS (SELECT {fdiv('mit', 12)} AS year, sum(value) AS value FROM m GROUP BY 1)
    SELECT q.mit, round((q.value - a.value) / y.value, 9) AS value FROM q JOIN a USING (mit) JOIN y ON y.year = {fdiv('q.mit', 4)}""",
)
register("matmul_dot", lambda spark, d: align.dot(*_two(spark, d)).select(F.round(F.col("value") / 1e6, 2).alias("value")), f"{TWO_SQL} SELECT round(sum(a.value * b.value) / 1e6, 2) AS value FROM a JOIN b USING (mit)")
register(
    "matmul_rows",
    lambda spark, d: out(align.matmul(_flag(spark, d), {"x": {"A": 0.5, "N": 2.0}, "y": {"N": -1.0, "R": 4.0}})),
    f'{FULL_SQL} SELECT mit, "A" * 0.5 + "N" * 2.0 AS x, "N" * -1.0 + "R" * 4.0 AS y FROM t',
)
def _left(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.range(24).select((F.col("id") % 2).alias("row"), F.col("id").alias("position"), (F.col("id") + 1).cast("double").alias("weight"))
    return align.left_matmul(weights, orders(spark, d, M))


register(
    "matmul_left",
    _left,
    f"{orders_sql(M)} SELECT (mit - {12 * 1995}) % 2 AS row, sum(value * (mit - {12 * 1995} + 1)) AS value FROM s WHERE mit < {12 * 1995} + 24 GROUP BY 1",
)
register("similar_fill", lambda spark, d: out(orders(spark, d, M).similar(1.5)), f"{orders_sql(M)} SELECT mit, 1.5::DOUBLE AS value FROM s")
register("numpy_function", lambda spark, d: out(align.apply(orders(spark, d, M), lambda v: np.hypot(v, 3.0)), 4), f"{orders_sql(M)} SELECT mit, round(sqrt(value * value + 9.0), 4) AS value FROM s")
register("logical_and", lambda spark, d: align.logical(*(lambda p: (p[0], "and", p[1]))(_two(spark, d))).df, f"{TWO_SQL} SELECT mit, a.value <> 0 AND b.value <> 0 AS value FROM a JOIN b USING (mit)")
register("workspace_frame", lambda spark, d: out(Workspace(a=_two(spark, d)[0], b=_two(spark, d)[1]).frame()), f"{TWO_SQL} SELECT mit, a.value AS a, b.value AS b FROM a FULL JOIN b USING (mit)")


# --- Python and NumPy operators of handles, options of correlations ---------------------------------------------------

register(
    "handle_arithmetic",
    lambda spark, d: out((lambda a, b: (2 * a - b / 4 + abs(-b)) // 10 % 1000 + a**1)(*_two(spark, d))),
    f"{TWO_SQL} SELECT mit, floor((2 * a.value - b.value / 4 + abs(-b.value)) / 10) - 1000 * floor(floor((2 * a.value - b.value / 4 + abs(-b.value)) / 10) / 1000) + a.value AS value FROM a JOIN b USING (mit)",
)
register(
    "handle_comparison",
    lambda spark, d: (lambda a, b: ((a > b) & (a >= 1.0) | (a == b)).df)(*_two(spark, d)),
    f"{TWO_SQL} SELECT mit, (a.value > b.value AND a.value >= 1) OR a.value = b.value AS value FROM a JOIN b USING (mit)",
)
register(
    "handle_numpy",
    lambda spark, d: out((lambda a, b: np.maximum(np.sqrt(np.square(a)), np.add(b, 1.0)) - np.float64(3))(*_two(spark, d)), 6),
    f"{TWO_SQL} SELECT mit, round(greatest(sqrt(a.value * a.value), b.value + 1) - 3, 6) AS value FROM a JOIN b USING (mit)",
)
register(
    "handle_concatenate",
    lambda spark, d: out(np.concatenate(_two(spark, d))),
    f"{TWO_SQL} SELECT mit, value FROM a UNION ALL SELECT row_number() OVER (ORDER BY mit) + (SELECT max(mit) FROM a) AS mit, value FROM b",
)
register(
    "handle_inner_product",
    lambda spark, d: rounded(align.inner(*(lambda s: (s, s.shifted_axis(7)))(_two(spark, d)[0])), -6),
    f"{TWO_SQL} SELECT round(sum(value * value), -6) AS value FROM a",
)
register(
    "bd_cor_holidays",
    lambda spark, d: rounded(stats.cor(*(lambda s: (s, s.each(lambda v: v * v)))(bdays.cleaned(business(spark, d), skip_all_nans=True)), holidays_map=holiday_map()), 9),
    f"{BUSINESS_SQL} SELECT round(corr(value, value * value), 9) AS value FROM s WHERE mit % 25 <> 0 AND value IS NOT NULL",
)
register(
    "bd_cov_nans",
    lambda spark, d: rounded(stats.cov(*(lambda s: (s, s.each(lambda v: v / 1000)))(business(spark, d)), skip_all_nans=True), -3),
    f"{BUSINESS_SQL} SELECT round(covar_samp(value, value / 1000), -3) AS value FROM s WHERE value IS NOT NULL",
)
