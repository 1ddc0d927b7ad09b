"""A script of row-wise commands as a transformation of a streaming DataFrame.

Commands that need neither other rows nor a row order run unchanged on a stream: keep, drop, rename, order, generate, replace,
mvencode, recode, and merges of the stream with a fixed dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.operators import combining, rows
from statloom.plans.expressions import to_sql
from statloom.plans.frame import Frame
from statloom.plans.script import logical_lines, parse

ROW_WISE = {"keep": rows.keep, "drop": rows.drop, "rename": rows.rename, "order": rows.order, "generate": rows.generate, "replace": rows.replace, "mvencode": rows.mvencode, "recode": lambda f, c, p=None: combining.recode(f, c)}


def transform(stream: DataFrame, script: str) -> DataFrame:
    """The stream after a script; a command that looks at other rows is refused."""
    frame = Frame(stream)
    for line in logical_lines(script):
        c = parse(line)
        if c.verb not in ROW_WISE or c.by:
            raise CommandError(f"{c.verb} does not work on a stream")
        for text in (c.cond, rows.assignment(c.head)[1] if c.verb in ("generate", "replace") else None):
            scope = frame.scope()
            scope.order = ("1",)
            if text and (to_sql(text, scope), scope.windows)[1]:
                raise CommandError(f"a command on a stream cannot look at other rows: {line}")
        frame = ROW_WISE[c.verb](frame, c, None)
    return frame.visible()


def collapse_windows(stream: DataFrame, time: str, length: str, results: dict[str, str], by: list[str], late: str) -> DataFrame:
    """Aggregates (name to SQL) by time window and group; rows later than ``late`` are dropped by the watermark."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, length), *by)
    return grouped.agg(*(F.expr(sql).alias(n) for n, sql in results.items())).select(F.col("window.start").alias("window_start"), *by, *results)
