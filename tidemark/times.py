"""Durations and instants, in milliseconds."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from .errors import BadData

#: Milliseconds of each unit (fixed values).
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_compound = re.compile(r"(?:\d+(?:ms|[smhdwy]))+")
_part = re.compile(r"(\d+)(ms|[smhdwy])")


def duration_ms(text: str | float) -> int:
    """Milliseconds of ``1h30m`` or of seconds as a number."""
    s = str(text).strip()
    sign = -1 if s.startswith("-") else 1
    body = s.lstrip("+-")
    if _compound.fullmatch(body):
        return sign * sum(int(n) * UNITS[u] for n, u in _part.findall(body))
    try:
        seconds = float(body)
    except ValueError:
        raise BadData(f"not a duration: {text!r}") from None
    if not math.isfinite(seconds):
        raise BadData(f"not a duration: {text!r}")
    return sign * round(seconds * 1000)


def instant_ms(value: str | float | datetime) -> int:
    """Milliseconds since the epoch of seconds, RFC 3339 text or a datetime (UTC where it has no zone)."""
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return round(at.timestamp() * 1000)
    try:
        return round(float(value) * 1000)
    except ValueError:
        pass
    try:
        return instant_ms(datetime.fromisoformat(str(value).replace("Z", "+00:00")))
    except ValueError:
        raise BadData(f"not a time: {value!r}") from None
