"""Words for people: amounts in reports, and what they type as a start time."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

NOTHING = "—"
_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def usd(value: float | None) -> str:
    """Small amounts keep four places."""
    return NOTHING if value is None else f"${value:,.4f}" if value < 1 else f"${value:,.2f}"


def number(value: float | None) -> str:
    return NOTHING if value is None else f"{int(value):,}"


def percent(value: float | None) -> str:
    return NOTHING if value is None else f"{value:.1f}%"


def milliseconds(value: float | None) -> str:
    return NOTHING if value is None else f"{value / 1000:.1f}s"


def since_ms(said: str | None, now: datetime | None = None) -> int | None:
    """``7d``, ``12h``, ``30m`` or ``2w`` back from now, or an ISO date or time (UTC where it names no zone), as epoch milliseconds."""
    if said is None:
        return None
    if found := re.fullmatch(r"(\d+)([mhdw])", said.strip().lower()):
        at = (now or datetime.now(UTC)) - timedelta(**{_UNITS[found[2]]: int(found[1])})
    else:
        try:
            at = datetime.fromisoformat(said.strip())
        except ValueError:
            raise ValueError(f"not a time: {said!r} (try 7d, 12h, 30m, 2w or 2026-07-01)") from None
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return int(at.timestamp() * 1000)
