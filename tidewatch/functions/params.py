"""Request parameters: coerced and clamped when a plan is built, so that no row pays for it."""

from __future__ import annotations

from collections.abc import Sequence


def whole(value: object, default: int, low: int, high: int) -> int:
    """A whole number within bounds; the default where it isn't one."""
    try:
        return max(low, min(high, int(str(value).strip())))
    except (TypeError, ValueError):
        return default


def one_of(value: object, allowed: Sequence[str], default: str) -> str:
    text = str(value).strip().lower() if value is not None else ""
    return text if text in allowed else default


def box(value: str | None) -> tuple[float, float, float, float] | None:
    """west,south,east,north in degrees; None unless all four are valid and in order."""
    try:
        west, south, east, north = (float(x) for x in (value or "").split(","))
    except ValueError:
        return None
    fits = -180 <= west < east <= 180 and -90 <= south < north <= 90
    return (west, south, east, north) if fits else None
