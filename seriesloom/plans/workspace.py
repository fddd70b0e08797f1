"""An ordered, nestable container of series and anything else, held on the driver; the series in it stay lazy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, MutableMapping
from types import SimpleNamespace
from typing import Any

from seriesloom.functions.frequency import Frequency, same_frequency
from seriesloom.functions.period import Period, PeriodRange, intersection_of, span_of
from seriesloom.operators import align
from seriesloom.plans.frame import SeriesFrame


class Workspace(MutableMapping):
    """Names, also as attributes, to values. A list of names gives a workspace of those."""

    def __init__(self, items: Mapping[str, Any] | Iterable[tuple[str, Any]] = (), **more: Any):
        object.__setattr__(self, "_items", dict(items, **more))

    @classmethod
    def from_dict(cls, items: Mapping[str, Any], recursive: bool = False) -> Workspace:
        return cls({k: cls.from_dict(v, True) if recursive and isinstance(v, Mapping) else v for k, v in items.items()})

    def __getitem__(self, name: str | list[str]) -> Any:
        if isinstance(name, (list, tuple)):
            return Workspace({n: self._items[n] for n in name})
        return self._items[name]

    def __setitem__(self, name: str, value: Any) -> None:
        if not isinstance(name, str):
            raise TypeError("names are strings")
        self._items[name] = value

    def __delitem__(self, name: str) -> None:
        del self._items[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def __getattr__(self, name: str) -> Any:
        try:
            return self._items[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        self._items[name] = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Workspace) and list(self.items()) == list(other.items())

    __hash__ = None

    def __repr__(self) -> str:
        lines = [f"Workspace with {len(self)} variables"]
        for k, v in self._items.items():
            what = f"{v.freq} series {list(v.keys)} {list(v.cols)}" if isinstance(v, SeriesFrame) else repr(v).split("\n")[0]
            lines.append(f"  {k} = {what}")
        return "\n".join(lines)

    def copy(self) -> Workspace:
        return Workspace(self._items)

    def as_namespace(self) -> SimpleNamespace:
        return SimpleNamespace(**self._items)

    def merge(self, other: Mapping[str, Any]) -> Workspace:
        """All names of both; the other's values win."""
        return Workspace({**self._items, **other})

    def filter(self, keep: Callable[[str, Any], bool] | Iterable[str]) -> Workspace:
        """Members that keep(name, value) accepts, or those named."""
        if not callable(keep):
            wanted = set(keep)
            return Workspace({k: v for k, v in self.items() if k in wanted})
        return Workspace({k: v for k, v in self.items() if keep(k, v)})

    def map(self, f: Callable[[Any], Any]) -> Workspace:
        return Workspace({k: f(v) for k, v in self.items()})

    def strip(self, recursive: bool = True) -> Workspace:
        """Every single series without missing values at its ends."""
        def own(v: Any) -> Any:
            if isinstance(v, SeriesFrame) and len(v.cols) == 1:
                return v.strip()
            return v.strip() if recursive and isinstance(v, Workspace) else v

        return self.map(own)

    def _dated(self) -> list[SeriesFrame | Period | PeriodRange]:
        """Members with a range; matrices don't count."""
        return [v for v in self.values() if isinstance(v, (Period, PeriodRange)) or (isinstance(v, SeriesFrame) and len(v.cols) == 1)]

    def frequency(self) -> Frequency:
        """The one frequency that all dated members have."""
        found = self._dated()
        if not found:
            raise ValueError("no member has a frequency")
        return same_frequency(*(v.freq for v in found))

    def _ranges(self) -> list[PeriodRange]:
        own = [v.range() if isinstance(v, SeriesFrame) else v for v in self._dated()]
        return [v.to(v) if isinstance(v, Period) else v for v in own]

    def range(self, method: str = "intersect") -> PeriodRange:
        if method not in ("intersect", "union"):
            raise ValueError(f"method must be intersect or union, got {method!r}")
        return (intersection_of if method == "intersect" else span_of)(*self._ranges())

    def span(self) -> PeriodRange:
        return span_of(*self._ranges())

    def reindex(self, old: Period, new: Period) -> Workspace:
        """Members of old's frequency relabelled; the others as they are."""
        def own(v: Any) -> Any:
            if isinstance(v, SeriesFrame) and v.freq == old.freq:
                return v.reindex(old, new)
            if isinstance(v, Workspace):
                return v.reindex(old, new)
            return v

        return self.map(own)

    def frame(self) -> SeriesFrame:
        """All series side by side over their span; variables of matrices are named member.variable."""
        parts = [v.rename([k]) if len(v.cols) == 1 else v.rename([f"{k}.{c}" for c in v.cols]) for k, v in self.items() if isinstance(v, SeriesFrame)]
        return align.hcat(*parts)

    def copy_to(self, target: SeriesFrame, rng: PeriodRange | None = None) -> SeriesFrame:
        return align.copy_to(target, {k: v for k, v in self.items() if isinstance(v, SeriesFrame)}, rng)


def overlay_workspaces(*parts: Workspace) -> Workspace:
    """Names of all in order; series overlay each other, nested workspaces too, other values come from the first that has them."""
    out: dict[str, Any] = {}
    for name in dict.fromkeys(n for p in parts for n in p):
        values = [p[name] for p in parts if name in p]
        if all(isinstance(v, SeriesFrame) for v in values):
            out[name] = align.overlay(*values)
        elif all(isinstance(v, Workspace) for v in values):
            out[name] = overlay_workspaces(*values)
        else:
            out[name] = next((v for v in values if v is not None and v == v), values[0])
    return Workspace(out)
