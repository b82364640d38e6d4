"""Durations as text and trailing event-time windows, half open: (t - w, t]."""

from __future__ import annotations

import re

from pyspark.sql import Window, WindowSpec

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def micros(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smhdw])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]] * 1_000_000


def trailing(scope: str, window: str | None = None, lag: str | None = None) -> WindowSpec:
    """Rows of the scope in (t - window, t - lag]; no window: all history. Peers at one instant count.

    The spec has an attribute `grown`: the frames (all to t - lag) and (all to t - window), which only grow as t goes on. A count or an exact
    sum over the window is the difference of those, which costs a step for each row however many rows the window holds."""
    ordered = Window.partitionBy(scope).orderBy("t")
    end = -micros(lag) if lag else 0
    start = Window.unboundedPreceding if window is None else -(micros(window) - 1)
    spec = ordered.rangeBetween(start, end)
    grow = lambda last: ordered.rangeBetween(Window.unboundedPreceding, last)
    spec.grown = (grow(end), None if window is None else grow(start - 1))
    return spec
