"""Column expressions; all are built-in functions that Catalyst compiles."""

from .keys import UNKNOWN_KEY, date_key, period_key, period_label, surrogate_key
from .typing import Cast, checked_cast, clock_seconds, has_drift, json_leaf
from .measures import decided, points, rate, share_of, verdict

__all__ = [
    "Cast", "UNKNOWN_KEY", "checked_cast", "clock_seconds", "date_key", "decided", "has_drift", "json_leaf", "period_key", "period_label",
    "points", "rate", "share_of", "surrogate_key", "verdict",
]
