"""Problem 1: runs of identical or near-identical consecutive events.

Each event that matches its predecessor points to it; pointer doubling (self joins that replace a pointer
by its target's pointer) brings every event to the start of its run in logarithmically many rounds.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import Stage

#: Width of a block of ``command_index``; the first lag runs inside (file, block), so no task holds a whole file.
BLOCK = 4096

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\S")
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`[^`]*`?|#.*|[^\"'`#]+", re.S)


def strip_layout(command: str) -> str:
    """The command without trailing comment and semicolons; quotes unified.  White space is left to the tokens."""
    parts = []
    for piece in _QUOTED.findall(command):
        if piece[0] == "#":
            break
        parts.append(piece)
    text = "".join(parts).strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    return text.replace("'", '"').replace("`", '"')


@lru_cache(maxsize=8192)
def _tokens(command: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(strip_layout(command)))


def edits_within(a: str, b: str, limit: int = 2) -> bool:
    """Whether the Levenshtein distance of two words is at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return False
    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[first:], b[first:]
    last = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[:len(a) - last], b[:len(b) - last]
    if max(len(a), len(b)) <= limit:
        return True
    # only the band of the table in which the distance can be within the limit
    far = limit + 1
    row = {j: j for j in range(min(limit, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            new[j] = i if not j else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values(), default=far) > limit:
            return False
        row = new
    return row.get(len(b), far) <= limit


def same_event(a: str | None, b: str | None) -> bool:
    """Equal but for layout, or but for the value of one number, or but for two characters of one word of 5+ letters."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    s, t = _tokens(a), _tokens(b)
    if s == t:
        return True
    if len(s) != len(t):
        return False
    at = -1
    for i, (x, y) in enumerate(zip(s, t)):
        if x != y:
            if at >= 0:
                return False
            at = i
    x, y = s[at], t[at]
    if x[0].isdigit() and y[0].isdigit():
        return True
    if x[0].isalpha() and y[0].isalpha():
        return max(len(x), len(y)) >= 5 and edits_within(x, y)
    return False


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_event(x, y) for x, y in zip(a, b)], dtype=bool)


def neighbour_pairs(events: DataFrame, group: str, index: str, text: str, at: str, order: str, block: int = BLOCK) -> DataFrame:
    """Every event with the one before it in its group: (g, i, p, t, pt), t and pt the texts.

    Lag inside (group, block of the index), then over the first and last events of the blocks, in blocks of blocks of the index until these
    span it: no window has more than two events of each of ``block`` blocks, however the indexes of a group lie.
    """
    least, most = events.agg(F.min(index), F.max(index)).first()
    span = most - least if most is not None else 0
    rows = events.select(
        F.col(group).alias("g"), F.col(index).alias("i"), F.col(text).alias("t"), F.col(at).alias("at"), F.col(order).alias("o"),
        F.floor(F.col(index) / F.lit(block)).cast("long").alias("k"),
    ).filter("g is not null and i is not null")
    once = Window.partitionBy("g", "k", "i").orderBy(F.col("o").asc_nulls_last(), F.col("t").asc_nulls_last())
    inside = Window.partitionBy("g", "k").orderBy("i")
    # one shuffle by (g, k) serves both windows
    rows = rows.repartition("g", "k").withColumn("rn", F.row_number().over(once)).filter("rn = 1").drop("rn", "o")
    rows = rows.withColumns({"p": F.lag("i").over(inside), "pt": F.lag("t").over(inside), "n": F.lead("i").over(inside)})
    pairs = rows.filter("p is not null").select("g", "i", "p", "t", "pt")
    edge = rows.filter("p is null or n is null").select("g", "i", "t", F.col("p").isNull().alias("open"))
    width = block
    while True:
        width *= block
        last = width > span
        across = Window.partitionBy("g", *([] if last else [F.floor(F.col("i") / F.lit(width))])).orderBy("i")
        edge = edge.withColumns({"p": F.lag("i").over(across), "pt": F.lag("t").over(across), "n": F.lead("i").over(across)})
        pairs = pairs.unionByName(edge.filter("open and p is not null").select("g", "i", "p", "t", "pt"))
        if last:
            return pairs
        edge = edge.filter("p is null or n is null").select("g", "i", "t", (F.col("open") & F.col("p").isNull()).alias("open"))


def run_pointers(pairs: DataFrame, stage: Stage) -> DataFrame:
    """(g, i, start) of every event that follows a matching one, by pointer doubling."""
    # texts that are equal as bytes need no Python; null texts match nothing
    known = pairs.filter("t is not null and pt is not null")
    near = known.filter("t <> pt").filter(_same("t", "pt"))
    edges = known.filter("t = pt").select("g", "i", "p").unionByName(near.select("g", "i", "p"))
    cur, left = stage.cut_counting(edges.select("g", "i", F.col("p").alias("ptr"), F.lit(False).alias("done")), "pointers", F.lit(True))
    while left:
        to = cur.select("g", F.col("i").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"))
        moved = cur.filter("not done").join(to, ["g", "ptr"], "left").select(
            "g", "i", F.coalesce("ptr2", "ptr").alias("ptr"), F.coalesce("done2", F.lit(True)).alias("done")
        )
        cur, left = stage.cut_counting(cur.filter("done").unionByName(moved), "pointers", ~F.col("done"))
    return cur.select("g", "i", F.col("ptr").alias("start"))


def collapse_runs(events: DataFrame, group: str = "file_id", index: str = "command_index", text: str = "command",
                  at: str = "entered_at", order: str = "loaded_at", block: int = BLOCK) -> DataFrame:
    """One row per run of two or more matching neighbours.

    Result: (group, first_index, last_index, n_events, first_at, last_at, span_seconds).  A repeated (group, index)
    counts once (the earliest ``order``, then the smallest text).  Rows with a null group or index are in no run; a null text is in
    no run and ends one; null times are left out of the span (null if all are).  Empty texts equal each other.
    An empty table gives an empty result; other columns are ignored.
    """
    stage = Stage(events.sparkSession, "runs")
    pairs = neighbour_pairs(events, group, index, text, at, order, block)
    member = run_pointers(pairs, stage)
    heads = member.select("g", F.col("start").alias("i"), "start").distinct()
    member = member.unionByName(heads)
    times = events.filter(F.col(group).isNotNull() & F.col(index).isNotNull()).groupBy(F.col(group).alias("g"), F.col(index).alias("i")).agg(F.min(at).alias("at"))
    runs = member.join(times, ["g", "i"], "left").groupBy("g", "start").agg(
        F.max("i").alias("last_index"), F.count(F.lit(1)).alias("n_events"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return runs.select(
        F.col("g").alias(group), F.col("start").alias("first_index"), "last_index", "n_events", "first_at", "last_at",
        F.timestamp_diff("MICROSECOND", "first_at", "last_at").cast("double").__truediv__(1e6).alias("span_seconds"),
    )


def run_bounds(events: DataFrame, group: str = "file_id", index: str = "command_index", text: str = "command",
               at: str = "entered_at", order: str = "loaded_at", block: int = BLOCK) -> DataFrame:
    """Only (group, first_index, last_index) of every run."""
    stage = Stage(events.sparkSession, "runs")
    member = run_pointers(neighbour_pairs(events, group, index, text, at, order, block), stage)
    return member.groupBy("g", "start").agg(F.max("i").alias("last_index")).select(
        F.col("g").alias(group), F.col("start").alias("first_index"), "last_index"
    )
