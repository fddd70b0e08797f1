"""Frequencies: what one step of an integer time axis means."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: For each kind of frequency the nominal periods per year (which also orders kinds from low to high), the months of
#: a period (0: not made of months) and the range and default of its end parameter.
PER_YEAR = {"Yearly": 1, "HalfYearly": 2, "Quarterly": 4, "Monthly": 12, "Weekly": 52, "BDaily": 260, "Daily": 365}
MONTHS = {"Yearly": 12, "HalfYearly": 6, "Quarterly": 3, "Monthly": 1}
ENDS = {"Yearly": 12, "HalfYearly": 6, "Quarterly": 3, "Weekly": 7}
#: Names that pandas gives to months and days.
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAY_NAMES = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


@dataclass(frozen=True)
class Frequency:
    """A kind and, for kinds that have one, the month or ISO day on which a period ends."""

    kind: str
    end: int | None = None

    def __post_init__(self) -> None:
        if self.kind != "Unit" and self.kind not in PER_YEAR:
            raise ValueError(f"unknown frequency {self.kind!r}")
        most = ENDS.get(self.kind)
        if most is None:
            if self.end is not None:
                raise ValueError(f"{self.kind} takes no parameter")
            return
        if self.end is None:
            object.__setattr__(self, "end", most)
        if isinstance(self.end, bool) or not isinstance(self.end, int):
            raise TypeError(f"{self.kind}: the end must be an integer")
        if not 1 <= self.end <= most:
            raise ValueError(f"{self.kind}: the end must lie in 1..{most}, got {self.end}")

    def __str__(self) -> str:
        return self.kind if self.end in (None, ENDS.get(self.kind)) else f"{self.kind}{{{self.end}}}"

    __repr__ = __str__

    @property
    def months(self) -> int:
        """Months of a period; only for frequencies made of months."""
        if self.kind not in MONTHS:
            raise TypeError(f"{self} is not made of months")
        return MONTHS[self.kind]

    @property
    def is_monthly_based(self) -> bool:
        return self.kind in MONTHS

    @property
    def shift(self) -> int:
        """Months by which periods end before the calendar's own."""
        return self.months - (self.end or 1)

    @property
    def per_year(self) -> int:
        if self.kind == "Unit":
            raise ValueError("Unit has no periods per year")
        return PER_YEAR[self.kind]

    @property
    def end_period(self) -> int:
        """The end parameter; 1 where there is none."""
        return self.end or 1

    def is_higher(self, other: Frequency) -> bool:
        return self.per_year > other.per_year


def Unit() -> Frequency:  # noqa: N802
    return Frequency("Unit")


def Yearly(end_month: int = 12) -> Frequency:  # noqa: N802
    return Frequency("Yearly", end_month)


def HalfYearly(end_month: int = 6) -> Frequency:  # noqa: N802
    return Frequency("HalfYearly", end_month)


def Quarterly(end_month: int = 3) -> Frequency:  # noqa: N802
    return Frequency("Quarterly", end_month)


def Monthly() -> Frequency:  # noqa: N802
    return Frequency("Monthly")


def Weekly(end_day: int = 7) -> Frequency:  # noqa: N802
    return Frequency("Weekly", end_day)


def BDaily() -> Frequency:  # noqa: N802
    return Frequency("BDaily")


def Daily() -> Frequency:  # noqa: N802
    return Frequency("Daily")


def as_frequency(what: object) -> Frequency:
    """A frequency from itself, from one of the makers above, or from its text form."""
    if isinstance(what, Frequency):
        return what
    if callable(what):
        return what()
    found = re.fullmatch(r"(\w+?)(?:\{(\d+)\})?", str(what))
    if not found:
        raise ValueError(f"not a frequency: {what!r}")
    return Frequency(found[1], int(found[2]) if found[2] else None)


def periods_per_year(what: object) -> int:
    return as_frequency(what).per_year


def is_kind(what: object, kind: str) -> bool:
    """Whether something is, or has, a frequency of that kind."""
    own = what if isinstance(what, Frequency) or callable(what) else getattr(what, "freq", what)
    return as_frequency(own).kind == kind


def is_yearly(x: object) -> bool:
    return is_kind(x, "Yearly")


def is_halfyearly(x: object) -> bool:
    return is_kind(x, "HalfYearly")


def is_quarterly(x: object) -> bool:
    return is_kind(x, "Quarterly")


def is_monthly(x: object) -> bool:
    return is_kind(x, "Monthly")


def is_weekly(x: object) -> bool:
    return is_kind(x, "Weekly")


def is_daily(x: object) -> bool:
    return is_kind(x, "Daily")


def is_bdaily(x: object) -> bool:
    return is_kind(x, "BDaily")


def same_frequency(*frequencies: Frequency) -> Frequency:
    if len(set(frequencies)) != 1:
        raise TypeError(f"mixing frequencies not allowed: {', '.join(map(str, frequencies))}")
    return frequencies[0]


def reject_unit(*frequencies: Frequency) -> None:
    if any(f.kind == "Unit" for f in frequencies):
        raise TypeError("Unit can't be converted")


def to_pandas_alias(freq: Frequency) -> str:
    """The alias of pandas' periods, such as Q-DEC; HalfYearly and Unit have none."""
    if freq.kind == "Yearly":
        return f"Y-{MONTH_NAMES[freq.end - 1]}"
    if freq.kind == "Quarterly":
        return f"Q-{MONTH_NAMES[(freq.end + 8) % 12]}"
    if freq.kind == "Weekly":
        return f"W-{DAY_NAMES[freq.end - 1]}"
    plain = {"Monthly": "M", "BDaily": "B", "Daily": "D"}
    if freq.kind not in plain:
        raise ValueError(f"pandas has no alias for {freq}")
    return plain[freq.kind]


def from_pandas_alias(alias: str) -> Frequency:
    """The frequency of an alias; start and end forms such as QS, QE and A- mean the same."""
    head, _, anchor = alias.upper().partition("-")
    head = {"A": "Y", "BY": "Y", "BQ": "Q", "BM": "M"}.get(re.sub(r"(?<=[AYQM])[SE]$", "", head), re.sub(r"(?<=[AYQM])[SE]$", "", head))
    if head == "Y":
        return Yearly(MONTH_NAMES.index(anchor) + 1 if anchor else 12)
    if head == "Q":
        return Quarterly(MONTH_NAMES.index(anchor) % 3 + 1 if anchor else 3)
    if head == "W":
        return Weekly(DAY_NAMES.index(anchor) + 1 if anchor else 7)
    plain = {"M": Monthly, "B": BDaily, "D": Daily}
    if head not in plain:
        raise ValueError(f"no frequency for pandas alias {alias!r}")
    return plain[head]()
