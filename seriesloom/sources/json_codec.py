"""Periods, series and workspaces as tagged JSON. Bulk data belongs in Parquet; this is for small objects."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import SparkSession

from seriesloom.functions.frequency import ENDS, Frequency
from seriesloom.functions.period import Period, PeriodRange, Span
from seriesloom.plans.frame import SeriesFrame
from seriesloom.plans.workspace import Workspace

#: The tags and field names of the format.
TAGS = ("MIT", "Duration", "MITRange", "TSeries", "MVTSeries", "Workspace", "Frequency")


def _end_field(kind: str) -> str | None:
    return None if kind not in ENDS else "end_day" if kind == "Weekly" else "end_month"


def _frequency(freq: Frequency) -> dict[str, Any]:
    field = _end_field(freq.kind)
    return {"name": freq.kind} | ({field: freq.end} if field else {})


def _frequency_from(tree: dict[str, Any]) -> Frequency:
    field = _end_field(tree.get("name"))
    return Frequency(tree["name"], tree.get(field) if field else None)


def _encode_series(s: SeriesFrame) -> dict[str, Any]:
    if s.keys:
        raise TypeError("a panel has no JSON form; save it as Parquet")
    rows = s.df.select("mit", *s.cols).orderBy("mit").collect()
    first = encode(Period(s.freq, rows[0][0] if rows else 1))
    if len(s.cols) == 1:
        return {"_type": "TSeries", "firstdate": first, "dtype": "float64", "values": [r[1] for r in rows]}
    return {"_type": "MVTSeries", "firstdate": first, "dtype": "float64", "names": list(s.cols), "values": [list(r[1:]) for r in rows]}


def encode(obj: Any) -> Any:
    """A tree of plain JSON values."""
    if isinstance(obj, (Period, Span)):
        return {"_type": "MIT" if isinstance(obj, Period) else "Duration", "freq": _frequency(obj.freq), "value": obj.value}
    if isinstance(obj, PeriodRange):
        return {"_type": "MITRange", "start": encode(obj.start), "stop": encode(obj.stop), "step": obj.step}
    if isinstance(obj, Frequency):
        return {"_type": "Frequency", "freq": _frequency(obj)}
    if isinstance(obj, SeriesFrame):
        return _encode_series(obj)
    if isinstance(obj, Workspace):
        return {"_type": "Workspace", "items": [[k, encode(v)] for k, v in obj.items()]}
    if isinstance(obj, dict):
        return {str(k): encode(v) for k, v in obj.items()}
    if isinstance(obj, (list, tuple)):
        return [encode(v) for v in obj]
    if obj is None or isinstance(obj, (bool, int, float, str)):
        return obj
    raise TypeError(f"{type(obj).__name__} has no JSON form")


def _decode_series(tree: dict[str, Any], spark: SparkSession | None) -> SeriesFrame:
    if spark is None:
        raise ValueError("series need a Spark session")
    first = decode(tree["firstdate"])
    if not isinstance(first, Period):
        raise ValueError("a series has no first period")
    names = tree.get("names", ["value"])
    rows = [(first.value + i, *map(float, v if isinstance(v, list) else [v])) for i, v in enumerate(tree["values"])]
    df = spark.createDataFrame(rows, ", ".join(["mit long", *(f"`{n}` double" for n in names)]))
    return SeriesFrame(df, first.freq, (), tuple(names))


def decode(tree: Any, spark: SparkSession | None = None) -> Any:
    """The inverse of encode."""
    if isinstance(tree, list):
        return [decode(v, spark) for v in tree]
    if not isinstance(tree, dict):
        return tree
    if "_type" not in tree:
        return {k: decode(v, spark) for k, v in tree.items()}
    makers: dict[str, Callable[[], Any]] = {
        "MIT": lambda: Period(_frequency_from(tree["freq"]), int(tree["value"])),
        "Duration": lambda: Span(_frequency_from(tree["freq"]), int(tree["value"])),
        "MITRange": lambda: PeriodRange(decode(tree["start"]), decode(tree["stop"]), int(tree.get("step", 1))),
        "Frequency": lambda: _frequency_from(tree["freq"]),
        "TSeries": lambda: _decode_series(tree, spark),
        "MVTSeries": lambda: _decode_series(tree, spark),
        "Workspace": lambda: Workspace([(k, decode(v, spark)) for k, v in tree["items"]]),
    }
    if tree["_type"] not in makers:
        raise ValueError(f"unknown tag {tree['_type']!r}")
    return makers[tree["_type"]]()


def dumps(obj: Any, **how: Any) -> str:
    return json.dumps(encode(obj), **how)


def loads(text: str, spark: SparkSession | None = None) -> Any:
    return decode(json.loads(text), spark)


def dump(obj: Any, file: IO[str], **how: Any) -> None:
    json.dump(encode(obj), file, **how)


def load(file: IO[str], spark: SparkSession | None = None) -> Any:
    return decode(json.load(file), spark)
