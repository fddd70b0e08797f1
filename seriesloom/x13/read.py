"""The program's output files: series, tables, key-value lists, estimates, models and messages."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from seriesloom.functions.frequency import Frequency
from seriesloom.functions.period import Period
from seriesloom.x13.spec import MONTHS, Data

#: Kinds of files by extension; every other file is a series.
TABLES = frozenset("acf acm ac2 iac ipc itr pcf pc2 rcm rog rtf sp0 sp1 sp2 spr st0 st1 st2 str is0 is1 is2 s1s s2s".split())
KEY_VALUES = frozenset("lks xoi".split())
TEXTS = frozenset("out log spc gmt htm html".split())


def column_name(text: str) -> str:
    return re.sub(r"[\s\-.]+", "_", text.strip())


def as_number(text: str) -> int | float | None:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return None


def as_float(text: str) -> float:
    found = as_number(text.strip())
    return math.nan if found is None else float(found)


def period_of(text: str, freq: Frequency) -> Period:
    """YYYYPP, or the name of a month."""
    text = text.strip()
    if text[:3].lower() in MONTHS:
        return Period.of(freq, 1, MONTHS.index(text[:3].lower()) + 1)
    if len(text) < 3 or not text.lstrip("-").isdigit():
        raise ValueError(f"not a period: {text!r}")
    return Period.of(freq, int(text[:-2]), int(text[-2:]))


def _columns(names: list[str], rows: list[list[str]]) -> dict[str, tuple[float, ...]]:
    return {n: tuple(as_float(r[i]) if i < len(r) else math.nan for r in rows) for i, n in enumerate(names)}


def series(text: str, freq: Frequency) -> Data:
    """A header, dashes, and a row for each period, with tabs between."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 3:
        raise ValueError("a series needs a header and rows")
    names = [column_name(x) for x in lines[0].split("\t")[1:] if x.strip()]
    rows = [x.split("\t") for x in lines[2:]]
    return Data(period_of(rows[0][0], freq), _columns(names, [r[1:] for r in rows]))


def seats_series(text: str, freq: Frequency) -> Data:
    """A title or two, a header, and rows that start with period-year, with wide gaps between."""
    lines = [x.rstrip() for x in text.split("\n")]
    gap = re.compile(r"\s\s+")
    at = next((i for i, x in enumerate(lines[1:], 1) if gap.search(x)), None)
    if at is None:
        raise ValueError("no header row")
    rows = [gap.split(x.strip()) for x in lines[at + 1 :] if re.match(r"\s*\d+\s*-\s*\d+", x)]
    if not rows:
        raise ValueError("no data rows")
    names = [column_name(x) for x in gap.split(lines[at].strip())[1:]]
    p, year = (int(x) for x in rows[0][0].split("-"))
    return Data(Period.of(freq, year, p), _columns(names, [r[1:] for r in rows]))


def _typed(values: list[str]) -> list[Any]:
    numbers = [as_number(v) for v in values]
    if values and all(isinstance(n, int) for n in numbers):
        return numbers
    if values and all(n is not None for n in numbers):
        return [float(n) for n in numbers]
    return values


def table(text: str, ext: str = "") -> dict[str, list[Any]]:
    """Columns by name: whole numbers where all are, else floats where all are, else texts."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return {}
    if ext == "rog":
        lines = [lines[0], *(re.sub(r"\s\s+", "\t", re.sub(r"\s+:", ":", x)).strip() for x in lines[1:])]
        names, rows = ["measure", *map(column_name, lines[1].split("\t"))], lines[2:]
    else:
        names, rows = list(map(column_name, lines[0].strip().split("\t"))), lines[2:]
        if ext == "acm":
            names.insert(1, "lag")
    cells = [r.split("\t") for r in rows]
    return {n: _typed([r[i].strip() if i < len(r) else "" for r in cells]) for i, n in enumerate(names)}


def nested(flat: dict[str, Any]) -> dict[str, Any]:
    """Dotted keys as dictionaries in each other; a name that is a value too gets an underscore."""
    out: dict[str, Any] = {k: v for k, v in flat.items() if "." not in k}
    groups: dict[str, dict[str, Any]] = {}
    for k, v in flat.items():
        if "." in k:
            head, _, rest = k.partition(".")
            groups.setdefault(head, {})[rest] = v
    for head, own in groups.items():
        out[head + "_" if head in out else head] = nested(own)
    return out


def value_of(key: str, text: str) -> Any:
    if key == "date":
        found = re.fullmatch(r"(\w{3})\w*\s+(\d+),?\s+(\d+)", text)
        if found and found[1].lower() in MONTHS:
            return f"{int(found[3]):04d}-{MONTHS.index(found[1].lower()) + 1:02d}-{int(found[2]):02d}"
    number = as_number(text)
    if number is not None:
        return number
    parts = [as_number(x) for x in text.replace("*******", "nan").split()]
    if len(parts) > 1 and None not in parts:
        return [float(x) for x in parts]
    return {"yes": True, "no": False}.get(text, text)


def key_values(text: str, separator: str = r"[\t:]") -> dict[str, Any]:
    flat = {}
    for line in text.split("\n"):
        found = re.search(separator, line) or re.search(":", line)
        if found and line.strip():
            flat[line[: found.start()]] = value_of(line[: found.start()], line[found.end() :].strip())
    return nested(flat)


def udg(text: str) -> dict[str, Any]:
    return key_values(text, ": ")


def _sections(text: str, start: str) -> dict[str, str]:
    """What follows each line that matches start, by that line's name."""
    out: dict[str, list[str]] = {}
    name = None
    for line in text.split("\n"):
        found = re.match(start, line)
        if found:
            name = found[1]
            out[name] = []
        elif name is not None:
            out[name].append(line)
    return {k: "\n".join(v) for k, v in out.items()}


def estimates(text: str) -> dict[str, Any]:
    """Tables by section ($arima$estimates: and such); the variance section is a key-value list."""
    out = {}
    for name, body in _sections(text, r"\$([\w$]+):\s*$").items():
        if body.strip():
            out[name.replace("$", "_")] = key_values(body) if name == "variance" else table(body)
    return out


def identify(text: str) -> dict[str, dict[str, list[Any]]]:
    """A table for each pair of differencing orders."""
    out, name = {}, None
    pages: dict[str, list[str]] = {}
    for line in text.split("\n"):
        found = re.match(r"\$(s?diff)\s*=?\s*(\d+)", line)
        if found:
            name = f"diff{found[2]}" if found[1] == "diff" else f"{name}_sdiff{found[2]}"
        elif name is not None and line.strip():
            pages.setdefault(name, []).append(line)
    for name, lines in pages.items():
        out[name] = table("\n".join(lines))
    return out


def model(text: str) -> dict[str, dict[str, Any]]:
    """arima{...} and regression{...} blocks: lists of numbers (f marks fixed ones) or texts by field."""
    out: dict[str, dict[str, Any]] = {}
    for kind, body in re.findall(r"(\w+)\s*\{(.*?)\}", text, re.S):
        own: dict[str, Any] = {}
        for name, value in re.findall(r"(\w+)\s*=\s*(\(.*?\)(?:\s*\(.*?\)\d*)*|\S+)", body, re.S):
            inner = value.strip("()").split()
            numbers = [as_number(v.rstrip("f,")) for v in inner]
            if name != "model" and value.startswith("(") and numbers and None not in numbers:
                own[name] = [float(n) for n in numbers]
                own[f"fix{name}"] = [v.rstrip(",").endswith("f") for v in inner]
            elif name != "model" and value.startswith("("):
                own[name] = inner
            else:
                own[name] = " ".join(value.split())
        out[kind] = own
    return out


@dataclass
class Messages:
    warnings: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def messages(text: str) -> Messages:
    """Messages of an .err file; a line that starts none goes on with the last one."""
    out, kinds = Messages(), {"WARNING": "warnings", "ERROR": "errors", "NOTE": "notes"}
    last: list[str] | None = None
    for line in text.split("\n"):
        found = re.match(r" (WARNING|ERROR|NOTE):\s?(.*)", line)
        if found:
            last = getattr(out, kinds[found[1]])
            last.append(found[2])
        elif last is not None and line.strip():
            last[-1] += "\n" + line
    return out


def read(path: Path, freq: Frequency) -> Any:
    """A file's content by its extension."""
    text, ext = path.read_text(encoding="utf-8", errors="replace"), path.suffix[1:]
    if ext in TEXTS:
        return text
    if ext == "err":
        return messages(text)
    if ext == "udg":
        return udg(text)
    if ext in KEY_VALUES:
        return key_values(text)
    if ext == "est":
        return estimates(text)
    if ext in ("iac", "ipc") and text.startswith("$"):
        return identify(text)
    if ext == "mdl":
        return model(text)
    if ext in TABLES:
        return table(text, ext)
    if re.search(r"^\s*\d+\s*-\s*\d{3,4}\s", text, re.M):
        return seats_series(text, freq)
    return series(text, freq)
