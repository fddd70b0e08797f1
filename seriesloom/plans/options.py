"""Options of the engine, held in a context variable: scopes and threads don't disturb each other."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

DEFAULTS: dict[str, Any] = {"bdaily_holidays_map": None, "bdaily_creation_bias": "strict", "x13path": ""}


class _Values:
    """The context variable; a copy on an executor starts with the defaults."""

    def __init__(self) -> None:
        self.var: ContextVar[dict[str, Any] | None] = ContextVar("seriesloom_options", default=None)

    def __reduce__(self) -> tuple:
        return _Values, ()


_current = _Values()


def _checked(name: str, value: Any) -> Any:
    if name not in DEFAULTS:
        raise KeyError(f"no option {name!r}; there are {sorted(DEFAULTS)}")
    if name == "bdaily_creation_bias" and value not in ("strict", "previous", "next", "nearest"):
        raise ValueError(f"bdaily_creation_bias must be strict, previous, next or nearest, got {value!r}")
    if name == "bdaily_holidays_map" and value is not None:
        from seriesloom.operators.bdays import HolidayMap

        if not isinstance(value, HolidayMap):
            raise TypeError("bdaily_holidays_map must be a HolidayMap or None")
    if name == "x13path" and not isinstance(value, str):
        raise TypeError("x13path must be a string")
    return value


def get(name: str) -> Any:
    if name not in DEFAULTS:
        raise KeyError(f"no option {name!r}; there are {sorted(DEFAULTS)}")
    return (_current.var.get() or DEFAULTS)[name]


def put(name: str, value: Any) -> None:
    _current.var.set((_current.var.get() or DEFAULTS) | {name: _checked(name, value)})


@contextmanager
def scope(**values: Any) -> Iterator[None]:
    """Options for the length of a with statement."""
    token = _current.var.set((_current.var.get() or DEFAULTS) | {k: _checked(k, v) for k, v in values.items()})
    try:
        yield
    finally:
        _current.var.reset(token)


def set_holidays_map(value: Any, subdivision: str | None = None) -> None:
    """A HolidayMap, or a country code for the package holidays."""
    if isinstance(value, str):
        from seriesloom.operators.bdays import HolidayMap

        value = HolidayMap.from_country(value, subdivision)
    put("bdaily_holidays_map", value)


def get_holidays_map() -> Any:
    return get("bdaily_holidays_map")


def clear_holidays_map() -> None:
    put("bdaily_holidays_map", None)
