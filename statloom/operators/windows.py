"""Terms that look at other rows of the whole dataset, without gathering it in one task."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import aggregate
from statloom.plans.expressions import quote
from statloom.plans.frame import Frame, Key
from statloom.sources.files import cut

#: Rows of a block for running values over the whole dataset.
BLOCK = 65_536
#: Estimated bytes of a dataset that one task may sort or hold, and rows of a group.
ONE_TASK_BYTES, ONE_TASK_ROWS = 4 << 30, 20_000_000


def with_position(frame: Frame, name: str = "__pos") -> Frame:
    """With the position (from 1) of each row in the whole order.

    The rows are range-partitioned by the order and sorted per partition; a row's position is its place in the partition plus
    the rows of the partitions before, of which only the counts (one number per partition) reach the driver.
    """
    frame = frame.numbered()
    keys = [k.sort() for k in frame.order]
    df = frame.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a table of its own, so that the numbers are settled and later steps do not carry this plan along
    df = cut(df.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    counts = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, {}
    for p, n in counts:
        offsets[p] = before
        before += n
    if not offsets:
        return replace(frame, df=df.withColumn(name, F.lit(0).cast("long")).drop("__mid"))
    # one row per partition: small whatever the data
    table = F.broadcast(df.sparkSession.createDataFrame(list(offsets.items()), "__part long, __before long"))
    df = df.withColumn("__part", part).join(table, "__part").withColumn(name, F.col("__mid").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1)
    return replace(frame, df=df.drop("__mid", "__part", "__before"))


def large(df: DataFrame) -> bool:
    """Whether a dataset may be too large for one task, by the planner's estimate of its size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > ONE_TASK_BYTES


def hot_groups(df: DataFrame, by: list[str]) -> bool:
    """Whether some group may be too large for one task.  Only where the whole dataset may be are groups counted."""
    if not large(df):
        return False
    most = df.groupBy(*(F.col(quote(g)) for g in by)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > ONE_TASK_ROWS


def order_statistics(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Percentiles between neighbouring values, of values that no task gathers: by their positions in the order."""
    placed = with_position(Frame(df.filter(F.col(quote(x)).isNotNull()).select(quote(x)), (Key(x),), has_rid=True)).df
    n = placed.count()
    if not n:
        return [None] * len(shares)
    wanted = [(n - 1) * s for s in shares]
    places = sorted({int(w) + k for w in wanted for k in (1, 2)})
    at = {r["__pos"]: float(r[x]) for r in placed.filter(F.col("__pos").isin(places)).collect()}
    return [at[int(w) + 1] + (w - int(w)) * (at.get(int(w) + 2, 0.0) - at[int(w) + 1]) if w > int(w) else at[int(w) + 1] for w in wanted]


def medians(df: DataFrame, by: list[str], sql: str, name: str) -> DataFrame:
    """(groups, median), by positions inside the groups: no task gathers one."""
    rows = df.select(*(F.col(quote(g)).alias(g) for g in by), F.expr(sql).cast("double").alias("__x")).filter("__x is not null")
    placed = add_whole_terms(Frame(rows, (), has_rid=True), [("__at", "n", "", 0), ("__of", "N", "", 0)], by, ["__x"]).df
    middle = placed.filter("2 * __at between __of and __of + 2")
    return middle.groupBy(*(F.col(quote(g)).alias(g) for g in by)).agg(F.avg("__x").alias(name))


def total(df: DataFrame, column) -> object:
    """A value over all rows as a scalar subquery: partial aggregates, no join."""
    return df.agg(column.alias("x")).scalar()


def _running(df: DataFrame, name: str, kind: str, arg: str) -> DataFrame:
    """A running value over a group's order: inside blocks of positions by windows, before a block from the group's earlier blocks."""
    df = df.withColumn("__arg", F.expr(arg)).withColumn("__blk", F.floor((F.col("__pos") - 1) / BLOCK))
    inside = Window.partitionBy("__start", "__blk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("__start").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    wanted = {"sum": ["sum"], "count": ["count"], "mean": ["sum", "count"], "min": ["min"], "max": ["max"]}[kind]
    parts = {}
    blocks = df.groupBy("__start", "__blk").agg(*(F.expr(aggregate.plain(w, "__arg")).alias(f"__t_{w}") for w in wanted))
    for w in wanted:
        up = "sum" if w in ("sum", "count") else w
        blocks = blocks.withColumn(f"__b_{w}", F.expr(f"{up}(__t_{w})").over(over))
        parts[w] = F.expr(aggregate.plain(w, "__arg")).over(inside)
    df = df.withColumns({f"__i_{w}": c for w, c in parts.items()}).join(blocks.select("__start", "__blk", *(f"__b_{w}" for w in wanted)), ["__start", "__blk"])
    both = {}
    for w in wanted:
        a, b = F.col(f"__i_{w}"), F.col(f"__b_{w}")
        both[w] = F.least(a, b) if w == "min" else F.greatest(a, b) if w == "max" else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    value = F.try_divide(both["sum"], both["count"]) if kind == "mean" else both[kind]
    return df.withColumn(name, value).drop("__arg", "__blk", *(f"__{x}_{w}" for x in "ib" for w in wanted))


def add_terms(frame: Frame, terms: list[tuple[str, str, str, int]], by: list[str], by_sort: list[str], panel: tuple[str | None, str] | None) -> Frame:
    """``add_whole_terms``; terms in the order of time have the panel's unit as group."""
    timed = [(n, "shift", arg, k) for n, kind, arg, k in terms if kind == "time"]
    if timed and panel:
        frame = add_whole_terms(frame, timed, [panel[0]] if panel[0] else [], [panel[1]])
    rest = [t for t in terms if t[1] != "time"]
    return add_whole_terms(frame, rest, by, by_sort) if rest else frame


def add_whole_terms(frame: Frame, terms: list[tuple[str, str, str, int]], by: list[str] | None = None, by_sort: list[str] | None = None) -> Frame:
    """The frame with a hidden column for each term over the whole dataset or, with ``by``, over its group.

    Positions run through all rows in the order of group, sort and row; a group begins at its least position.  No step gathers a group:
    sorting is by ranges, group sizes are partial aggregates, rows some places away are joined by position.
    """
    by, by_sort = by or [], by_sort or []
    order = frame.order
    if by or any(kind != "N" for _, kind, _, _ in terms):
        front = [*by, *by_sort]
        frame = with_position(replace(frame, order=(*map(Key, front), *(k for k in order if k.column not in front))))
    df = frame.df
    if by:
        groups = df.groupBy(*(F.col(quote(g)).alias(f"__g{i}") for i, g in enumerate(by))).agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__size"))
        on = F.col(quote(by[0])).eqNullSafe(F.col("__g0"))
        for i, g in enumerate(by[1:], 1):
            on = on & F.col(quote(g)).eqNullSafe(F.col(f"__g{i}"))
        df = df.join(groups, on).drop(*(f"__g{i}" for i in range(len(by))))
    else:
        df = df.withColumn("__start", F.lit(1).cast("long"))
    base = df
    for name, kind, arg, k in terms:
        if kind == "n":
            df = df.withColumn(name, F.col("__pos") - F.col("__start") + 1)
        elif kind == "N":
            df = df.withColumn(name, F.col("__size") if by else total(base, F.count(F.lit(1))))
        elif kind == "shift":
            # the row k places away is joined by its position, if it is of the same group
            other = base.select((F.col("__pos") - k).alias("__pos"), F.col("__start").alias("__start2"), F.expr(arg).alias("__other"))
            df = df.join(other, "__pos", "left").withColumn(name, F.when(F.col("__start") == F.col("__start2"), F.col("__other"))).drop("__start2", "__other")
        elif kind == "at":
            place = base.filter(F.col("__pos") - F.col("__start") + 1 == k)
            df = df.join(place.select("__start", F.expr(arg).alias(name)), "__start", "left") if by else df.withColumn(name, total(place, F.first(F.expr(arg))))
        else:
            df = _running(df, name, kind, arg)
    return replace(frame, df=df.drop("__pos", "__start", "__size"), order=order)
