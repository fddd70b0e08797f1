"""Rules that reach over several blocks of a specification."""

from __future__ import annotations

from seriesloom.functions.period import Period, PeriodRange
from seriesloom.x13.spec import RANGE, Block, Data, OpenSpan, Regressor, Spec, as_list, name_of, need, warn

#: Which regressors suit only flows or only stocks, need months (or months and quarters), and exclude which others.
FLOW_ONLY = {"td", "tdnolpyear", "td1coef", "td1nolpyear", "lpyear", "easter", "labor", "thank", "sceaster"}
STOCK_ONLY = {"tdstock", "td1stock", "tdstock1coef", "easterstock"}
MONTHLY_ONLY = {"tdstock", "tdstock1coef", "labor", "sceaster"}
MONTHLY_OR_QUARTERLY = {"td", "tdnolpyear", "td1coef", "td1nolpyear", "lpyear", "easter", "easterstock"}
EXCLUDES = {
    "td": {"tdnolpyear", "td1coef", "td1nolpyear", "lpyear", "lom", "loq", "tdstock", "tdstock1coef"},
    "tdnolpyear": {"td", "td1coef", "td1nolpyear", "tdstock", "tdstock1coef"},
    "td1coef": {"td", "tdnolpyear", "td1nolpyear", "lpyear", "lom", "loq", "tdstock", "tdstock1coef"},
    "td1nolpyear": {"td", "tdnolpyear", "td1coef", "tdstock", "tdstock1coef"},
    "lpyear": {"td", "td1coef", "lom", "loq", "tdstock", "tdstock1coef"},
    "lom": {"td", "td1coef", "lpyear", "loq", "tdstock", "tdstock1coef"},
    "loq": {"td", "td1coef", "lpyear", "lom", "tdstock", "tdstock1coef"},
    "tdstock": {"td", "tdnolpyear", "td1coef", "td1nolpyear", "lom", "loq", "lpyear", "tdstock1coef"},
    "tdstock1coef": {"td", "tdnolpyear", "td1coef", "td1nolpyear", "lom", "loq", "lpyear", "tdstock"},
}


def effective_span(series: Block) -> PeriodRange:
    own, span = series.data.range, series.span
    if isinstance(span, PeriodRange):
        return span
    if isinstance(span, OpenSpan):
        return PeriodRange(span.b or own.first, span.e or own.last)
    return own


def _models(spec: Spec) -> None:
    chosen = [k for k in ("arima", "automdl", "pickmdl") if spec.get(k)]
    need(len(chosen) <= 1, f"{' and '.join(chosen)} exclude each other")
    estimate = spec.get("estimate")
    if estimate and estimate.has("file"):
        arima, regression = spec.get("arima"), spec.get("regression")
        need(not arima and not spec.get("automdl"), "estimate: file excludes a model, ar and ma of arima, and automdl")
        need(not regression or not (regression.has("variables") or regression.has("user") or regression.has("b")), "estimate: file excludes variables, user and b of regression")


def _compatible(spec: Spec, block: Block, tokens: set[str], field: str) -> None:
    series, transform = spec.series, spec.get("transform")
    kind, adjust = series.data.freq.kind, transform.adjust if transform else None
    for t in sorted(tokens):
        where = f"{block.kind}: {t} in {field}"
        if series.type is not None and series.type != "flow":
            need(t not in FLOW_ONLY, f"{where} needs flow data, the series is {series.type}")
        if series.type is not None and series.type != "stock":
            need(t not in STOCK_ONLY, f"{where} needs stock data, the series is {series.type}")
        need(t not in MONTHLY_ONLY or kind == "Monthly", f"{where} needs monthly data")
        need(t not in MONTHLY_OR_QUARTERLY or kind in ("Monthly", "Quarterly"), f"{where} needs monthly or quarterly data")
        if field == "aictest":
            need(t != "lom" or kind == "Monthly", f"{where} needs monthly data")
            need(t != "loq" or kind == "Quarterly", f"{where} needs quarterly data")
        clash = sorted(EXCLUDES.get(t, set()) & tokens)
        need(not clash, f"{where} can't be used with {', '.join(clash)}")
        if adjust is not None:
            need(t not in ("td", "td1coef"), f"{where} can't be used with adjust of transform")
            need(not (adjust == "lom" and t == "lom"), f"{where} conflicts with adjust lom of transform")


def _outlier_dates(spec: Spec, regression: Block) -> None:
    within, span = spec.series.data.range, effective_span(spec.series)
    for v in as_list(regression.variables):
        if not isinstance(v, Regressor):
            continue
        if v.name in ("ao", "ls", "tc", "so", *RANGE):
            need(all(p in within for p in v.periods), f"{v.name} regressors must have dates within {within}, got {v}")
        if v.name in ("ls", "so"):
            need(v.periods[0] != span.first, f"{v.name} regressors can't be at the start of {span}, got {v}")


def _coverage(spec: Spec) -> None:
    """User data has to cover the series with its forecasts and backcasts."""
    forecast = spec.get("forecast")
    lead = forecast.maxlead if forecast and forecast.maxlead is not None else 0
    back = forecast.maxback if forecast and forecast.maxback is not None else 0
    span = effective_span(spec.series)
    first, last = span.first - back, span.last + lead
    for kind, field in (("regression", "data"), ("x11regression", "data"), ("x11regression", "umdata")):
        block = spec.get(kind)
        data: Data | None = block.given.get(field) if block else None
        if data is not None:
            need(data.freq == span.freq, f"{kind}: {field} must have the frequency of the series")
            need(data.range.first <= first and data.range.last >= last, f"{kind}: {field} must cover {PeriodRange(first, last)}, it covers {data.range}")


def _history_and_spans(spec: Spec) -> None:
    history, forecast, slides, spectrum = (spec.get(k) for k in ("history", "forecast", "slidingspans", "spectrum"))
    if history:
        lead = forecast.maxlead if forecast and forecast.maxlead is not None else 12
        need(all(f <= lead for f in as_list(history.fstep)), f"history: fstep must not exceed maxlead of forecast ({lead})")
        if history.has("outlier") and not spec.get("outlier"):
            warn("history: outlier has no effect without an outlier block")
    if slides:
        year = spec.series.data.freq.per_year
        if slides.length is not None:
            need(3 * year <= slides.length <= 19 * year, f"slidingspans: length must be 3 to 19 years, got {slides.length} periods")
        if slides.has("outlier") and not spec.get("outlier"):
            warn("slidingspans: outlier has no effect without an outlier block")
    if spectrum and spectrum.qcheck and spec.series.data.freq.kind != "Monthly":
        warn("spectrum: qcheck has an effect on monthly series only")


def _adjustment(spec: Spec) -> None:
    x11, transform, seats = spec.get("x11"), spec.get("transform"), spec.get("seats")
    if seats and seats.hpcycle:
        least = {"Monthly": 120, "Quarterly": 48}.get(spec.series.data.freq.kind, 0)
        if len(spec.series.data.values) < least:
            warn(f"seats: the Hodrick-Prescott filter needs {least} observations")
    if x11:
        mode, adjust = x11.mode, transform.adjust if transform else None
        need(adjust is None or mode not in ("add", "pseudoadd"), f"x11: mode {mode} can't be used with adjust of transform")
        plain = transform and not (transform.has("func") or transform.has("power"))
        need(not (plain and mode is None), "x11: the default multiplicative mode conflicts with no transformation")
    xreg = spec.get("x11regression")
    if xreg and xreg.forcecal:
        tokens = {name_of(v) for v in as_list(xreg.variables)}
        if not (any(t.startswith("td") for t in tokens) and tokens & {"easter", "labor", "thank", "sceaster"}):
            warn("x11regression: forcecal needs trading-day and holiday regressors")
    modelspan = spec.series.modelspan
    start: Period | None = modelspan.first if isinstance(modelspan, PeriodRange) else modelspan.b if isinstance(modelspan, OpenSpan) else None
    forecast = spec.get("forecast")
    if start is not None and start != effective_span(spec.series).first and forecast and forecast.maxback:
        warn("series: modelspan starts after span, so there are no backcasts")


def validate(spec: Spec) -> None:
    """Raises Problem at the first broken rule; lesser matters are warnings."""
    need(spec.series.kind == "series", "a specification needs a series")
    _models(spec)
    for kind in ("regression", "x11regression"):
        block = spec.get(kind)
        if block:
            variables = {name_of(v) for v in as_list(block.variables)}
            _compatible(spec, block, variables, "variables")
            if block.has("aictest"):
                _compatible(spec, block, {name_of(v) for v in as_list(block.aictest)}, "aictest")
    if spec.get("regression"):
        _outlier_dates(spec, spec.get("regression"))
    _coverage(spec)
    _history_and_spans(spec)
    _adjustment(spec)
