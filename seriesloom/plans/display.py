"""Series as text and HTML tables, and plots. Only the rows that are shown come to the driver."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence

from seriesloom.functions.frequency import same_frequency
from seriesloom.functions.period import Period, PeriodRange, intersection_of
from seriesloom.plans.frame import SeriesFrame

ROWS, COLUMNS, PANELS = 20, 8, 10


def cell(v: float | None) -> str:
    return "" if v is None else "NaN" if math.isnan(v) else f"{v:g}"


def shown(s: SeriesFrame, rows: int = ROWS) -> tuple[list[str], list[list[str]]]:
    """Header and rows: the first and last of a long series with a gap of dots between them."""
    cols = list(s.cols[:COLUMNS])
    ordered = s.df.select(*s.index, *cols)
    head = ordered.orderBy(*s.index).limit(rows + 1).collect()
    if len(head) > rows:
        half = rows // 2
        tail = ordered.orderBy(*(ordered[c].desc() for c in s.index)).limit(half).collect()[::-1]
        picked = [*head[: rows - half], None, *tail]
    else:
        picked = head
    header = [*s.keys, "period", *cols, *(["..."] if len(s.cols) > COLUMNS else [])]
    return header, [["..."] * len(header) if r is None else [*(str(r[k]) for k in s.keys), str(Period(s.freq, r["mit"])), *(cell(r[c]) for c in cols), *(["..."] if len(s.cols) > COLUMNS else [])] for r in picked]


def text(s: SeriesFrame, rows: int = ROWS) -> str:
    header, body = shown(s, rows)
    widths = [max(len(r[i]) for r in [header, *body]) for i in range(len(header))]
    lines = ["  ".join(c.rjust(w) for c, w in zip(r, widths, strict=True)) for r in [header, *body]]
    return "\n".join([f"{s.freq} series, keys {list(s.keys)}, variables {list(s.cols)}", *lines])


def html_table(s: SeriesFrame, rows: int = ROWS) -> str:
    header, body = shown(s, rows)
    head = "".join(f"<th>{html.escape(h)}</th>" for h in header)
    rest = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in body)
    return f"<table><caption>{html.escape(str(s.freq))}</caption><thead><tr>{head}</tr></thead><tbody>{rest}</tbody></table>"


# --- plots ------------------------------------------------------------------------------------------------------------


def axis_position(p: Period) -> float:
    """Years for periods made of months, days for dates, the number itself for Unit."""
    if p.freq.is_monthly_based:
        return float(p)
    return float(p.value) if p.freq.kind == "Unit" else float(p.to_date().toordinal())


def stride(n: int, per_year: int, most: int = 10) -> int:
    """Periods between ticks: few of them, and whole years where there are many periods."""
    for step in (1, 2, per_year // 4 or 1, per_year // 2 or 1, per_year, 2 * per_year, 5 * per_year, 10 * per_year, 25 * per_year):
        if n <= step * most:
            return step
    return -(-n // most)


def ticks(rng: PeriodRange, most: int = 10) -> list[Period]:
    """Periods to mark; years start at their first period."""
    if not rng:
        return []
    per_year = 1 if rng.freq.kind == "Unit" else rng.freq.per_year
    step = stride(len(rng), per_year, most)
    return [p for p in rng if p.value % step == 0] if rng.freq.is_monthly_based else list(rng[::step])


def panel_grid(n: int) -> tuple[int, int]:
    columns = 1 if n == 1 else 2 if n <= 6 else 3
    return -(-n // columns), columns


def available_backends() -> list[str]:
    import importlib.util

    return [b for b in ("matplotlib", "plotly") if importlib.util.find_spec(b)]


def plot(*series: SeriesFrame, names: Sequence[str] | None = None, rng: PeriodRange | None = None, backend: str = "matplotlib") -> object:
    """Lines of single series on one pair of axes, or of matrices in a panel per variable (10 at most)."""
    if backend not in ("matplotlib", "plotly"):
        raise ValueError(f"backend must be matplotlib or plotly, got {backend!r}")
    if backend not in available_backends():
        raise ImportError(f"plotting needs the package {backend}")
    same_frequency(*(s.freq for s in series))
    variables = list(dict.fromkeys(c for s in series for c in s.cols)) if any(len(s.cols) > 1 for s in series) else [None]
    if len(variables) > PANELS:
        raise ValueError(f"at most {PANELS} variables, got {len(variables)}")
    clip = rng if rng is not None else intersection_of(*(s.range() for s in series)) if len(series) > 1 else None
    lines = []
    for i, s in enumerate(series):
        own = s if clip is None else s.slice(clip)
        rows = own.df.select("mit", *own.cols).orderBy("mit").collect()
        x = [axis_position(Period(s.freq, r["mit"])) for r in rows]
        lines.append((names[i] if names else f"series {i + 1}", x, {c: [r[c] for r in rows] for c in own.cols}))
    if backend == "plotly":
        from plotly.subplots import make_subplots

        down, across = panel_grid(len(variables))
        figure = make_subplots(down, across, subplot_titles=[v or "" for v in variables])
        for k, v in enumerate(variables):
            for name, x, ys in lines:
                figure.add_scatter(x=x, y=ys.get(v) if v else next(iter(ys.values())), name=name, row=k // across + 1, col=k % across + 1)
        return figure
    from matplotlib import pyplot

    down, across = panel_grid(len(variables))
    figure, axes = pyplot.subplots(down, across, squeeze=False)
    for k, v in enumerate(variables):
        axis = axes[k // across][k % across]
        for name, x, ys in lines:
            y = ys.get(v) if v else next(iter(ys.values()))
            if y is not None:
                axis.plot(x, y, label=name)
        axis.set_title(v or "")
        axis.legend()
    return figure
