"""Aggregates by name, for collapse, egen and running forms."""

from __future__ import annotations

#: Names whose Spark name differs.
NAMES = {"mean": "avg", "sd": "stddev_samp", "stddev": "stddev_samp", "median": "median", "count": "count", "sum": "sum", "min": "min", "max": "max"}
ORDERED = {"first": False, "firstnm": False, "last": True, "lastnm": True}
RUNNING = frozenset(["sum", "mean", "count", "min", "max"])


def plain(name: str, arg: str, is_bool: bool = False) -> str:
    """SQL of an aggregate that does not depend on the row order.

    Sums and means of a condition count it as 0 and 1.  Unknown names go to Spark.
    """
    if is_bool and name.lower() not in ("count", "min", "max"):
        arg = f"CAST({arg} AS INT)"
    return f"{NAMES.get(name.lower(), name)}({arg})"
