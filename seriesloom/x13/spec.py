"""Specification objects: regressors, models, and blocks of fields that are checked as they are made."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from seriesloom.functions.frequency import Frequency
from seriesloom.functions.period import Period, PeriodRange

#: Month names of the format.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: The fields of every block, in the order in which they are written.
FIELDS: dict[str, tuple[str, ...]] = {name: tuple(text.split()) for name, text in {
    "series": "appendbcst appendfcst comptype compwt data decimals file format modelspan name period precision print save span start title type divpower missingcode missingval saveprecision trimzero",
    "arima": "model title ar ma fixar fixma",
    "automdl": "diff acceptdefault checkmu ljungboxlimit maxorder maxdiff mixed print savelog armalimit balanced exactdiff fcstlim hrinitial reducecv rejectfcst urfinal",
    "transform": "adjust aicdiff data file format func mode name power precision print save savelog start title type constant trimzero",
    "regression": "aicdiff aictest chi2test chi2testcv data file format print save savelog pvaictest start testalleaster tlimit user usertype variables b fixb centeruser eastermeans noapply tcrate",
    "forecast": "exclude lognormal maxback maxlead print save probability",
    "seats": "appendfcst finite hpcycle noadmiss out print save savelog printphtrf qmax statseas tabtables bias epsiv epsphi hplan imean maxit rmod xl",
    "x11": "appendbcst appendfcst final mode print save savelog seasonalma sigmalim title trendma type calendarsigma centerseasonal keepholiday print1stpass sfshort sigmavec trendic true7term",
    "check": "maxlag qtype print save savelog acflimit qlimit",
    "estimate": "exact maxiter outofsample print save savelog tol file fix",
    "force": "lambda_ mode print save rho round start target type usefcst indforce",
    "history": "endtable estimates fixmdl fixreg fstep print save savelog sadjlags start target trendlags fixx11reg outlier outlierwin refresh transformfcst x11outlier",
    "identify": "diff sdiff maxlag print save",
    "metadata": "entries",
    "outlier": "critical lsrun method print save savelog span types almost tcrate",
    "pickmdl": "bcstlim fcstlim models identify method mode outofsample overdiff print savelog qlim file",
    "slidingspans": "cutchng cutseas cuttd fixmdl fixreg length numspans outlier print save savelog start additivesa fixx11reg x11outlier",
    "spectrum": "logqs print save savelog qcheck start tukey120 decibel difference maxar peakwidth series siglevel type",
    "x11regression": "aicdiff aictest critical data file format outliermethod outlierspan print save savelog prior sigma span start tdprior user usertype variables almost b fixb centeruser eastermeans forcecal noapply reweight umdata umfile umformat umname umprecision umstart umtrimzero",
}.items()}
#: The order of blocks in a specification, after series.
ORDER = ("arima", "estimate", "transform", "regression", "automdl", "x11", "x11regression", "check", "forecast", "force", "pickmdl", "history", "metadata", "identify", "outlier", "seats", "slidingspans", "spectrum")

#: The tables that save="all" stands for; print="all" is a word of the program's own. x11 has more tables than are worth
#: keeping here, so they have to be named.
SAVE_ALL: dict[str, tuple[str, ...]] = {name: tuple(text.split()) for name, text in {
    "series": "span specfile adjoriginal calendaradjorig outlieradjorig seriesmvadj",
    "transform": "seriesconstant prior permprior tempprior prioradjusted permprioradjusted prioradjustedptd permprioradjustedptd transformed",
    "regression": "regressionmatrix outlier aoutlier levelshift seasonaloutlier transitory temporarychange tradingday holiday regseasonal userdef",
    "check": "acf pacf acfsquared",
    "estimate": "model estimates lkstats iterations regcmatrix armacmatrix roots regressioneffects regressionresiduals residuals",
    "force": "seasadjtot saround revsachanges rndsachanges revsachangespct rndsachangespct",
    "history": "outlierhistory sarevisions chngrevisions indsarevisions trendrevisions trendchngrevisions sfrevisions lkhdhistory fcsterrors armahistory tdhistory sfilterhistory saestimates chngestimates indsaestimates trendestimates trendchngestimates sfestimates fcsthistory",
    "identify": "acf pacf",
    "outlier": "iterations finaltests",
    "slidingspans": "sfspans chngspans saspans ychngspans tdspans indsfspans indchngspans indsaspans indychngspans",
    "spectrum": "specorig specsa specirr specseatssa specseatsirr specextresiduals specresidual speccomposite specindirr specindsa",
    "x11regression": "priortd extremeval tradingday combtradingday holiday calendar combcalendar extremevalb tradingdayb combtradingdayb holidayb calendarb combcalendarb outlieriter xregressionmatrix xregressioncmatrix",
}.items()}


def token(period: Period) -> str:
    """2020.jul for months, 2020.3 for quarters and half-years."""
    year, p = period.year_period()
    return f"{year}.{MONTHS[p - 1] if period.freq.kind == 'Monthly' else p}"


# --- regressors -------------------------------------------------------------------------------------------------------

#: Regressors by what they take, and for those with a number its bounds (none: unchecked).
POINT = ("ao", "ls", "tc", "so")
RANGE = ("aos", "lss", "rp", "qd", "qi", "tl")
NUMBER = {"tdstock": (1, 31), "tdstock1coef": None, "easter": (0, 25), "labor": (1, 25), "thank": (-8, 17), "sceaster": (1, 24), "easterstock": (1, 25)}
REGIME = ("td", "tdnolpyear", "td1coef", "td1nolpyear", "lpyear", "lom", "loq", "seasonal")
REGIMES = {"both": ("/", "/"), "zerobefore": ("//", "/"), "zeroafter": ("/", "//")}


@dataclass(frozen=True)
class Regressor:
    """One entry of a list of regression variables; its text form is that of the format."""

    name: str
    periods: tuple[Period, ...] = ()
    numbers: tuple[int, ...] = ()
    regime: str = "neither"

    def __str__(self) -> str:
        if self.name in POINT:
            return self.name + token(self.periods[0])
        if self.name in RANGE:
            return f"{self.name}{token(self.periods[0])}-{token(self.periods[1])}"
        if self.name in NUMBER:
            return f"{self.name}[{self.numbers[0]}]"
        if self.name == "sincos":
            return f"sincos[{' '.join(map(str, self.numbers))}]"
        if self.regime == "neither":
            return self.name
        before, after = REGIMES[self.regime]
        return f"{self.name}{before}{token(self.periods[0])}{after}"


def _period(name: str, value: object) -> Period:
    if not isinstance(value, Period):
        raise TypeError(f"{name} needs a period, got {type(value).__name__}")
    return value


def _point(name: str) -> Callable[[Period], Regressor]:
    def make(period: Period) -> Regressor:
        return Regressor(name, (_period(name, period),))

    return make


def _range(name: str) -> Callable[[Period, Period], Regressor]:
    def make(first: Period, last: Period) -> Regressor:
        return Regressor(name, (_period(name, first), _period(name, last)))

    return make


def _number(name: str) -> Callable[[int], Regressor]:
    def make(n: int) -> Regressor:
        return Regressor(name, (), (n,))

    return make


def _regime(name: str) -> Callable[..., Regressor]:
    def make(period: Period | None = None, regimechange: str | None = None) -> Regressor:
        regime = regimechange or ("neither" if period is None else "both")
        if regime not in (*REGIMES, "neither"):
            raise ValueError(f"regimechange must be one of {(*REGIMES, 'neither')}, got {regime!r}")
        if regime != "neither" and period is None:
            raise ValueError(f"regimechange {regime!r} needs a period")
        return Regressor(name, () if period is None else (_period(name, period),), (), regime)

    return make


ao, ls, tc, so = map(_point, POINT)
aos, lss, rp, qd, qi, tl = map(_range, RANGE)
tdstock, tdstock1coef, easter, labor, thank, sceaster, easterstock = map(_number, NUMBER)
td, tdnolpyear, td1coef, td1nolpyear, lpyear, lom, loq, seasonal = map(_regime, REGIME)


def sincos(n: Sequence[int]) -> Regressor:
    if not isinstance(n, tuple):
        raise TypeError("sincos takes a tuple of integers")
    return Regressor("sincos", (), n)


def name_of(variable: Regressor | str) -> str:
    """The kind of a regressor that is given as an object or as its text."""
    if isinstance(variable, Regressor):
        return variable.name
    names = (*POINT, *RANGE, *NUMBER, *REGIME, "sincos", "const", "td1stock")
    found = [n for n in names if variable == n or (variable.startswith(n) and not variable[len(n)].isalpha())]
    return max(found, key=len, default=variable)


# --- models and spans -------------------------------------------------------------------------------------------------

Order = int | tuple[int, ...]


def _order(value: Order | list[int]) -> Order:
    if isinstance(value, bool):
        raise TypeError("an order is an integer or a list of lags")
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)) and all(isinstance(v, int) and not isinstance(v, bool) for v in value):
        return tuple(value)
    raise TypeError("an order is an integer or a list of lags")


@dataclass(frozen=True)
class Arima:
    """(p d q), with the lags that are in it where an order is a tuple; period 0 follows from the place in a model."""

    p: Order = 0
    d: Order = 0
    q: Order = 0
    period: int = 0

    def __post_init__(self) -> None:
        for name in ("p", "d", "q"):
            object.__setattr__(self, name, _order(getattr(self, name)))
        if isinstance(self.period, bool) or not isinstance(self.period, int):
            raise TypeError("the period is an integer")

    def __str__(self) -> str:
        orders = (f"[{' '.join(map(str, x))}]" if isinstance(x, tuple) else str(x) for x in (self.p, self.d, self.q))
        return f"({' '.join(orders)}){self.period or ''}"

    @classmethod
    def two_seasonal(cls, p: Order, d: Order, q: Order, sp: Order, sd: Order, sq: Order) -> tuple[Arima, Arima]:
        return cls(p, d, q), cls(sp, sd, sq)


@dataclass(frozen=True)
class ArimaModel:
    """The product of operators; default marks one model of a list to pick from."""

    specs: tuple[Arima, ...]
    default: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "specs", tuple(self.specs))
        if not self.specs:
            raise ValueError("a model needs an operator")

    def __str__(self) -> str:
        return "".join(map(str, self.specs))

    @classmethod
    def of(cls, *orders: Order, period: int = 0, default: bool = False) -> ArimaModel:
        """(p, d, q), or (p, d, q, P, D, Q)."""
        if len(orders) == 3:
            return cls((Arima(*orders, period),), default)
        if len(orders) == 6:
            return cls(Arima.two_seasonal(*orders), default)
        raise ValueError(f"3 or 6 orders are needed, got {len(orders)}")


@dataclass(frozen=True)
class OpenSpan:
    """From b to e; None leaves an end to the series."""

    b: Period | None = None
    e: Period | None = None


@dataclass(frozen=True)
class Data:
    """Values on the driver: one row per period, a column per name."""

    first: Period
    columns: dict[str, tuple[float, ...]]

    @classmethod
    def of(cls, first: Period, values: Iterable[float], name: str = "value") -> Data:
        return cls(first, {name: tuple(map(float, values))})

    @property
    def freq(self) -> Frequency:
        return self.first.freq

    @property
    def values(self) -> tuple[float, ...]:
        return next(iter(self.columns.values()))

    @property
    def range(self) -> PeriodRange:
        return PeriodRange(self.first, self.first + (len(self.values) - 1))

    def since(self, start: Period) -> Data:
        skip = start.value - self.first.value
        return Data(start, {n: v[skip:] for n, v in self.columns.items()})


def as_data(what: Any) -> Data:
    """Data from itself or from a handle without keys, whose rows come to the driver."""
    if isinstance(what, Data):
        return what
    if hasattr(what, "df"):
        rows = what.df.select("mit", *what.cols).orderBy("mit").collect()
        return Data(Period(what.freq, rows[0][0]), {c: tuple(r[c] for r in rows) for c in what.cols})
    raise TypeError(f"a series is needed, got {type(what).__name__}")


# --- blocks -----------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """A named block and the fields that were given."""

    kind: str
    given: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        """A field's value, or None where it was not given."""
        if name.startswith("_") or name in ("kind", "given"):
            raise AttributeError(name)
        if name not in FIELDS[self.kind]:
            raise AttributeError(f"{self.kind} has no field {name!r}")
        return self.given.get(name)

    def has(self, name: str) -> bool:
        return name in self.given

    def items(self) -> list[tuple[str, Any]]:
        return [(f, self.given[f]) for f in FIELDS[self.kind] if f in self.given]


class Problem(ValueError):
    """A rule of the specification is broken."""


def need(condition: object, message: str) -> None:
    if not condition:
        raise Problem(message)


def warn(message: str) -> None:
    warnings.warn(message, UserWarning, stacklevel=4)


def as_list(value: Any) -> list[Any]:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _between(kind: str, name: str, values: Any, low: float, high: float) -> None:
    for v in as_list(values):
        need(v is None or low <= v <= high, f"{kind}: {name} must lie between {low} and {high}, got {v}")


def _one_of(kind: str, name: str, values: Any, allowed: Iterable[Any]) -> None:
    allowed = list(allowed)
    bad = [v for v in as_list(values) if v not in allowed]
    need(not bad, f"{kind}: {name} must be one of {allowed}, got {bad}")


#: Tests that aictest may name, and kinds of user regressors.
AICTESTS = ("td", "tdnolpyear", "tdstock", "td1coef", "td1nolpyear", "tdstock1coef", "lom", "loq", "lpyear", "easter", "easterstock", "user")
AICTESTS_X11 = ("td", "tdstock", "td1coef", "tdstock1coef", "easter", "user")
USERTYPES = ("constant", "seasonal", "td", "tdstock", "lom", "loq", "lpyear", "easter", "holiday", "holiday2", "holiday3", "holiday4", "holiday5", "user", "ao", "ls", "so", "transitory")


def _check_regressors(kind: str, variables: Any) -> None:
    own = [v for v in as_list(variables) if isinstance(v, Regressor)]
    for v in own:
        bounds = NUMBER.get(v.name)
        if bounds:
            need(bounds[0] <= v.numbers[0] <= bounds[1], f"{kind}: {v.name} must have a value between {bounds[0]} and {bounds[1]}, got {v.numbers[0]}")
    for name in ("aos", "lss"):
        spans = sorted((v.periods[0].value, v.periods[1].value) for v in own if v.name == name)
        for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
            if start <= end:
                warn(f"{kind}: overlapping {name} regressors")


def _check_arima(b: Block) -> None:
    model = b.given["model"]
    if isinstance(model, Arima):
        model = ArimaModel((model,))
    elif isinstance(model, tuple):
        model = ArimaModel(model)
    if not isinstance(model, ArimaModel):
        raise TypeError("arima: the model must be an ArimaModel, an Arima or a tuple of them")
    b.given["model"] = model
    for name in ("ar", "ma"):
        if b.has(name) and b.has(f"fix{name}"):
            need(len(b.given[name]) == len(b.given[f"fix{name}"]), f"arima: fix{name} must have the same length as {name}")


def _check_automdl(b: Block) -> None:
    for name, first, second in (("diff", (0, 1, 2), (0, 1)), ("maxdiff", (None, 1, 2), (None, 1)), ("maxorder", (None, 1, 2, 3, 4), (None, 1, 2))):
        value = b.given.get(name)
        if value is not None:
            need(len(value) == 2, f"automdl: {name} must contain exactly two values")
            need(value[0] in first, f"automdl: the regular order of {name} must be one of {first}, got {value[0]}")
            need(value[1] in second, f"automdl: the seasonal order of {name} must be one of {second}, got {value[1]}")
    if b.has("diff") and b.has("maxdiff"):
        warn("automdl: diff is ignored because maxdiff is given")


def _check_transform(b: Block) -> None:
    need(not (b.has("func") and b.has("power")), "transform: either power or func can be given, not both")
    if b.adjust == "lpyear":
        need(b.power in (None, 0, 0.0) and b.func in (None, "log"), "transform: adjust lpyear needs a log transform")
    mode = b.mode if isinstance(b.mode, list) else []
    need(len(mode) <= 2, "transform: at most two modes")
    need("diff" not in mode or not {"ratio", "percent"} & set(mode), "transform: mode diff excludes ratio and percent")
    if b.has("data"):
        data = as_data(b.given["data"])
        b.given |= {"data": data, "start": data.first, "name": list(data.columns) if len(data.columns) > 1 else next(iter(data.columns))}
    if b.has("type"):
        need(b.has("data"), "transform: type needs data")
        need(not isinstance(b.type, list) or len(b.type) in (1, len(b.data.columns)), "transform: as many types as data columns")
        need(not isinstance(b.type, str) or len(b.data.columns) == 1, "transform: as many types as data columns")


def _check_regression(b: Block) -> None:
    need(not (b.has("aicdiff") and b.has("pvaictest")), f"{b.kind}: aicdiff excludes pvaictest") if b.kind == "regression" else None
    if b.has("data"):
        data = as_data(b.given["data"])
        b.given |= {"data": data, "start": data.first, "user": list(data.columns) if len(data.columns) > 1 else next(iter(data.columns))}
    allowed = USERTYPES if b.kind == "regression" else ("td", "holiday", "user")
    _one_of(b.kind, "usertype", b.usertype, allowed)
    if isinstance(b.usertype, list) and len(b.usertype) > 1:
        need(len(b.usertype) == len(as_list(b.user)), f"{b.kind}: usertype must have the same length as the user series")
    _one_of(b.kind, "aictest", b.aictest, AICTESTS if b.kind == "regression" else AICTESTS_X11)
    _check_regressors(b.kind, b.variables)


def _check_x11regression(b: Block) -> None:
    _check_regression(b)
    need(b.sigma is None or b.sigma > 0, "x11regression: sigma must be positive")
    if b.has("tdprior"):
        need(len(b.tdprior) == 7 and min(b.tdprior) >= 0, "x11regression: tdprior needs seven weights, none negative")
    if b.has("umdata"):
        data = as_data(b.given["umdata"])
        b.given |= {"umdata": data, "umstart": data.first, "umname": list(data.columns)}
    tests, variables = {name_of(v) for v in as_list(b.aictest)}, {name_of(v) for v in as_list(b.variables)}
    for t in tests & {"td", "tdstock", "td1coef", "tdstock1coef"}:
        need(not variables & ({"td", "tdstock", "td1coef", "tdstock1coef"} - {t}), f"x11regression: aictest {t} needs the same trading-day variable")


def _check_seats(b: Block) -> None:
    b.given.setdefault("out", 0)
    need(b.epsiv is None or b.epsiv > 0, "seats: epsiv must be a small positive number")
    need(b.print != "all" and b.print != ["all"], "seats: print all is not possible")
    if b.has("hplan") and b.has("hpcycle"):
        warn("seats: hplan overrides hpcycle")


def _check_x11(b: Block) -> None:
    if isinstance(b.trendma, int):
        need(b.trendma % 2 == 1 and 3 <= b.trendma <= 101, f"x11: trendma must be odd and between 3 and 101, got {b.trendma}")
    need(not b.has("sigmavec") or b.calendarsigma == "select", "x11: sigmavec needs calendarsigma select")


def _check_force(b: Block) -> None:
    _between("force", "rho", b.rho, 0, 1)


def _check_history(b: Block) -> None:
    for name, most in (("fstep", 4), ("sadjlags", 5), ("trendlags", 5)):
        own = as_list(b.given.get(name))
        need(len(own) <= most, f"history: at most {most} values of {name}")
        need(all(v >= 1 for v in own), f"history: {name} must be positive")


def _check_metadata(b: Block) -> None:
    own = b.given["entries"] = [tuple(e) for e in b.given["entries"]]
    need(0 < len(own) <= 20, f"metadata: 1 to 20 entries, got {len(own)}")
    for i, what in enumerate(("keys", "values")):
        need(all(len(e[i]) <= 132 for e in own), f"metadata: {what} have at most 132 characters")
        need(sum(len(e[i]) for e in own) <= 2000, f"metadata: all {what} together have at most 2000 characters")


def _check_outlier(b: Block) -> None:
    need(len(as_list(b.critical)) <= 3, "outlier: at most three critical values")
    _between("outlier", "lsrun", b.lsrun, 0, 5)
    need(b.almost is None or b.almost > 0, "outlier: almost must be positive")
    need(b.tcrate is None or 0 < b.tcrate < 1, "outlier: tcrate must lie between 0 and 1")
    _one_of("outlier", "types", b.types, ("ao", "ls", "tc", "so", "all", "none"))


def _check_pickmdl(b: Block) -> None:
    for name in ("bcstlim", "fcstlim", "qlim"):
        _between("pickmdl", name, b.given.get(name), 0, 100)
    _between("pickmdl", "overdiff", b.overdiff, 0.9, 1)
    if not b.has("file"):
        models = as_list(b.models)
        need(len(models) >= 2, "pickmdl: two models at least")
        need(sum(m.default for m in models) <= 1, "pickmdl: one default at most")


def _check_slidingspans(b: Block) -> None:
    if b.has("fixreg") and b.fixmdl in (True, "yes"):
        warn("slidingspans: fixreg is ignored with fixmdl")


CHECKS: dict[str, Callable[[Block], None]] = {
    "arima": _check_arima,
    "automdl": _check_automdl,
    "transform": _check_transform,
    "regression": _check_regression,
    "seats": _check_seats,
    "x11": _check_x11,
    "force": _check_force,
    "history": _check_history,
    "metadata": _check_metadata,
    "outlier": _check_outlier,
    "pickmdl": _check_pickmdl,
    "slidingspans": _check_slidingspans,
    "x11regression": _check_x11regression,
}


def make(kind: str, given: dict[str, Any]) -> Block:
    """A block; fields that are None count as not given, long titles are cut with a warning."""
    unknown = set(given) - set(FIELDS[kind])
    if unknown:
        raise TypeError(f"{kind} has no field {sorted(unknown)}")
    block = Block(kind, {k: v for k, v in given.items() if v is not None})
    for name, most in (("title", 79), ("name", 64)):
        value = block.given.get(name)
        if isinstance(value, str) and len(value) > most and not (kind == "transform" and name == "name"):
            warn(f"{kind}: {name} cut to {most} characters: {value}")
            block.given[name] = value[:most]
    if block.given.get("save") in ("all", ["all"]):
        need(kind in SAVE_ALL, f"{kind}: name the tables to save")
        block.given["save"] = list(SAVE_ALL[kind])
    if kind in CHECKS:
        CHECKS[kind](block)
    return block


def series(data: Any, **given: Any) -> Block:
    """The series block: the data, cut to start, with missing values written as missingcode."""
    own = as_data(data)
    if given.get("start") is not None:
        start = given["start"]
        need(start in own.range, f"series: start {start} must lie within {own.range}")
        own = own.since(start)
    for name in ("span", "modelspan"):
        check_span(own, given.get(name), f"series: {name}")
    _between("series", "divpower", given.get("divpower"), -9, 9)
    if any(math.isnan(v) for v in own.values):
        code = given.get("missingcode")
        need(code is not None, "series: missing values need a missingcode")
        own = Data(own.first, {n: tuple(float(code) if math.isnan(x) else x for x in v) for n, v in own.columns.items()})
    if given.get("period") is None and own.freq.kind not in ("Monthly", "Yearly"):
        given["period"] = own.freq.per_year
    return make("series", {**given, "data": own, "start": own.first})


def check_span(data: Data, span: PeriodRange | OpenSpan | None, what: str) -> None:
    if span is None:
        return
    b, e = (span.first, span.last) if isinstance(span, PeriodRange) else (span.b, span.e)
    need(b is None or b >= data.range.first, f"{what} must start within {data.range}")
    need(e is None or e <= data.range.last, f"{what} must end within {data.range}")


def _builder(kind: str) -> Callable[..., Block]:
    def build(**given: Any) -> Block:
        return make(kind, given)

    build.__name__, build.__doc__ = kind, f"The {kind} block; fields: {', '.join(FIELDS[kind])}."
    return build


automdl, transform, regression, forecast, seats, x11 = map(_builder, ("automdl", "transform", "regression", "forecast", "seats", "x11"))
check, estimate, force, history, identify, outlier = map(_builder, ("check", "estimate", "force", "history", "identify", "outlier"))
slidingspans, spectrum, x11regression = map(_builder, ("slidingspans", "spectrum", "x11regression"))


def arima(model: ArimaModel | Arima | tuple[Arima, ...], **given: Any) -> Block:
    return make("arima", {"model": model, **given})


def metadata(entries: Sequence[tuple[str, str]]) -> Block:
    return make("metadata", {"entries": entries})


def pickmdl(models: Sequence[ArimaModel] | None = None, **given: Any) -> Block:
    return make("pickmdl", {"models": models, **given})


@dataclass
class Spec:
    """The series and the blocks that were set."""

    series: Block
    blocks: dict[str, Block] = field(default_factory=dict)

    def put(self, *blocks: Block) -> Spec:
        for b in blocks:
            if b.kind == "series":
                raise ValueError("a specification has one series")
            self.blocks[b.kind] = b
        return self

    def get(self, kind: str) -> Block | None:
        return self.blocks.get(kind)


def new_spec(data: Any, *blocks: Block) -> Spec:
    return Spec(data if isinstance(data, Block) else series(data)).put(*blocks)
