"""Query parameters: coerced, checked, and frozen before a plan is built."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from roadlens.plans.dims import PREFIXES

YEARS = range(2015, 2031)
CITY_COLUMNS = {"occurrence": "codmunocor", "residence": "codmunres"}


class InvalidParameter(ValueError):
    """A parameter is out of its domain (a service would answer 422)."""


class NotFound(LookupError):
    """The row that was asked for does not exist (a service would answer 404 with this message)."""

    def __init__(self) -> None:
        super().__init__("Not Found")


def _whole(name: str, value: object) -> int | None:
    if value is None:
        return None
    try:
        number = float(str(value))
    except ValueError:
        raise InvalidParameter(f"{name}: {value!r} is no number") from None
    if number != int(number):
        raise InvalidParameter(f"{name}: {value!r} is no whole number")
    return int(number)


def _year(name: str, value: object) -> int | None:
    number = _whole(name, value)
    if number is not None and number not in YEARS:
        raise InvalidParameter(f"{name}: {number} is not within {YEARS[0]} and {YEARS[-1]}")
    return number


def _one_of(name: str, value: object, domain: object) -> None:
    if value not in domain:
        raise InvalidParameter(f"{name}: {value!r} is none of {sorted(domain)}")


def _day(name: str, value: object) -> dt.date | None:
    if value is None or isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value))
    except ValueError:
        raise InvalidParameter(f"{name}: {value!r} is no ISO date") from None


@dataclass(frozen=True)
class DeathFilter:
    """What the mortality reports take. A city code of 0 filters nothing, as in an unset one, but is echoed."""

    year: int | None = None
    start_year: int | None = None
    end_year: int | None = None
    city_code: int | None = None
    location_type: str = "occurrence"
    transport_mode: str | None = None

    def __post_init__(self) -> None:
        for name in ("year", "start_year", "end_year"):
            object.__setattr__(self, name, _year(name, getattr(self, name)))
        object.__setattr__(self, "city_code", _whole("city_code", self.city_code))
        _one_of("location_type", self.location_type, CITY_COLUMNS)
        if self.transport_mode is not None:
            _one_of("transport_mode", self.transport_mode, PREFIXES)

    @property
    def city_column(self) -> str:
        return CITY_COLUMNS[self.location_type]


@dataclass(frozen=True)
class EventFilter:
    """What the list of counting events takes; an empty city filters nothing."""

    location_id: int | None = None
    city: str | None = None
    start_date: dt.date | None = None
    end_date: dt.date | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "location_id", _whole("location_id", self.location_id))
        if self.location_id is not None and self.location_id <= 0:
            raise InvalidParameter("location_id must be positive")
        for name in ("start_date", "end_date"):
            object.__setattr__(self, name, _day(name, getattr(self, name)))


def row_id(value: object) -> int:
    """An id given in a path."""
    number = _whole("id", value)
    if number is None:
        raise InvalidParameter("id is missing")
    return number


def described(kind: type) -> list[tuple[str, str]]:
    """Names and types of the parameters, for a listing of the operators."""
    return [(f.name, str(f.type)) for f in fields(kind)]
