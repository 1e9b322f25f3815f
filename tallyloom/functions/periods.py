"""Date ranges of dashboard requests."""

from __future__ import annotations

from datetime import date, timedelta


def checked(start: str, end: str, most: int = 120) -> tuple[date, date]:
    """The range as dates; ValueError if a date is malformed, the order wrong or the range longer than most days."""
    try:
        s, e = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError as err:
        raise ValueError("dates are written YYYY-MM-DD") from err
    if s > e:
        raise ValueError(f"start {start} lies after end {end}")
    if (e - s).days + 1 > most:
        raise ValueError(f"the range has more than {most} days")
    return s, e


def span(start: str, end: str, most: int = 120) -> tuple[date, date, date, date]:
    """The range and the equally long one right before it."""
    s, e = checked(start, end, most)
    n = (e - s).days + 1
    return s, e, s - timedelta(days=n), s - timedelta(days=1)
