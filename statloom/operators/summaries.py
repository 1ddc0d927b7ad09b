"""Aggregates: collapse, egen, summarize, tabulate, count."""

from __future__ import annotations

import re
from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.functions import aggregate
from statloom.operators.rows import Panel, assignment, filtered
from statloom.operators.windows import large, medians, order_statistics, total
from statloom.plans.expressions import quote
from statloom.plans.frame import Frame, Key, compiled
from statloom.plans.script import Command, names, top_level

_CALL = re.compile(r"([A-Za-z_]\w*)\s*\((.*)\)\s*$", re.S)


def _pieces(text: str) -> list[str]:
    """Text cut at blanks outside brackets; an assignment and a call stay together."""
    text = re.sub(r"\s*=\s*", "=", text)
    out, at = [], 0
    for i, c in top_level(text):
        if c.isspace():
            out.append(text[at:i])
            at = i + 1
    return [p for p in [*out, text[at:]] if p]


def targets(head: str) -> list[tuple[str, str, str]]:
    """(function, new name, argument) of each result that collapse asks for."""
    out, function = [], "mean"
    for piece in _pieces(head):
        if piece[0] == "(" and piece[-1] == ")":
            function = piece[1:-1].strip()
            continue
        new, sign, arg = piece.partition("=")
        if not sign:
            out.append((function, new, new))
        elif m := _CALL.match(arg):
            out.append((m.group(1), new, m.group(2).strip()))
        else:
            out.append((function, new, arg))
    if not out:
        raise CommandError("collapse needs results such as (mean) y=x")
    return [(f, n.strip("`"), a) for f, n, a in out]


def _ordered(frame: Frame, sql: str, last: bool) -> Column:
    """The value of the first or last row by the order, null or not."""
    keys = []
    for k in frame.order:
        col = F.col(quote(k.column))
        keys.append((k, col))
    if any(k.descending for k, _ in keys):
        raise CommandError("first and last after a descending sort need an ascending key; sort the other way and swap them")
    packed = F.struct(*(x for _, col in keys for x in (col.isNull(), col)))
    value = F.struct(F.expr(sql).alias("v"))
    return (F.max_by(value, packed) if last else F.min_by(value, packed))["v"]


def _value(frame: Frame, function: str, arg: str, panel: Panel, strict_nm: bool) -> tuple[Frame, Column]:
    ordered = aggregate.ORDERED.get(function.lower())
    if ordered is not None:
        frame = frame.numbered()
    frame, sql, scope = compiled(frame, arg, panel=panel, running=False)
    if scope.windows:
        raise CommandError(f"{function}({arg}): generate the variable first")
    if ordered is not None:
        if strict_nm and function.lower().endswith("nm"):
            keys = F.struct(*(x for k in frame.order for x in (F.col(quote(k.column)).isNull(), F.col(quote(k.column)))))
            given = F.when(F.expr(sql).isNotNull(), keys)
            return frame, (F.max_by if ordered else F.min_by)(F.expr(sql), given)
        return frame, _ordered(frame, sql, ordered)
    boolean = frame.types().get(arg.strip("`"), "") == "boolean"
    return frame, F.expr(aggregate.plain(function, sql, boolean))


def collapse(frame: Frame, c: Command, panel: Panel = None, strict_nm: bool = False) -> Frame:
    by = [frame.resolve(n) for n in (c.option_names("by") or list(c.by))]
    frame = filtered(frame, c.cond, panel)
    wanted = targets(c.head)
    if any(f.lower() in aggregate.ORDERED for f, _, _ in wanted) and any(k.descending for k in frame.order):
        frame = _ascending(frame)
    aggregates, seen, apart = [], set(by), []
    for function, new, arg in wanted:
        if new in seen:
            raise CommandError(f"collapse gives {new} twice")
        seen.add(new)
        if function.lower() == "median" and large(frame.df):
            apart.append((new, _argument(frame, function, arg, panel)))
            continue
        frame, value = _value(frame, function, arg, panel, strict_nm)
        aggregates.append(value.alias(new))
    aggregates = aggregates or [F.count(F.lit(1)).alias("__rows")]
    df = frame.df.groupBy(*(F.col(quote(g)).alias(g) for g in by)).agg(*aggregates) if by else frame.df.agg(*aggregates)
    for new, sql in apart:
        df = _beside(df, medians(frame.df, by, sql, new), by, new)
    if apart:
        df = df.select(*(F.col(quote(n)) for n in [*by, *(new for _, new, _ in wanted)]))
    return Frame(df, tuple(Key(g) for g in by), has_rid=bool(by))


def _argument(frame: Frame, function: str, arg: str, panel: Panel) -> str:
    _, sql, scope = compiled(frame, arg, panel=panel, running=False)
    if scope.windows:
        raise CommandError(f"{function}({arg}): generate the variable first")
    return sql


def _beside(df: DataFrame, more: DataFrame, by: list[str], name: str) -> DataFrame:
    """The groups of ``df`` with a column of another table of the same groups; null groups match."""
    if not by:
        return df.withColumn(name, more.select(quote(name)).scalar())
    more = more.select(*(F.col(quote(g)).alias(f"__m{i}") for i, g in enumerate(by)), F.col(quote(name)))
    on = F.lit(True)
    for i, g in enumerate(by):
        on = on & F.col(quote(g)).eqNullSafe(F.col(f"__m{i}"))
    return df.join(more, on, "left").drop(*(f"__m{i}" for i in range(len(by))))


def _ascending(frame: Frame) -> Frame:
    """The order as one ascending position, for aggregates that need a greatest or least key."""
    from statloom.operators.windows import with_position

    frame = with_position(frame, "__place")
    return changed(frame, order=(Key("__place"),))


def egen(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    name, call = assignment(c.head)
    m = _CALL.match(call)
    if not m:
        raise CommandError("egen needs a function: name = f(variable)")
    frame.undefined(name)
    by = [frame.resolve(n) for n in (c.option_names("by") or list(c.by))]
    if m.group(1).lower() in aggregate.ORDERED and any(k.descending for k in frame.order):
        frame = _ascending(frame)
    frame = frame.numbered() if frame.order or m.group(1).lower() in aggregate.ORDERED else frame
    apart = m.group(1).lower() == "median" and large(frame.df)
    if apart:
        sql = _argument(frame, m.group(1), m.group(2).strip(), panel)
        frame = frame.numbered()
        df = _beside(frame.df, medians(frame.df, by, sql, "__value"), by, "__value")
    else:
        frame, value = _value(frame, m.group(1), m.group(2).strip(), panel, False)
    if apart:
        pass
    elif by:
        # grouped and joined back, not a window: groups are reduced before they move, and a large group is spread over tasks
        frame = frame.numbered()
        groups = frame.df.groupBy(*(F.col(quote(g)).alias(f"__g{i}") for i, g in enumerate(by))).agg(value.alias("__value"))
        same = [F.col(quote(g)).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(by)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        df = frame.df.join(groups, on, "left").drop(*(f"__g{i}" for i in range(len(by))))
    else:
        df = frame.df.withColumn("__value", total(frame.df, value))
    out = F.col("__value")
    frame = changed(frame, df=df)
    if c.cond is not None:
        # the condition hides results; the aggregate sees all rows
        inner = changed(frame, df=df)
        inner, sql, scope = compiled(inner, c.cond, panel=panel)
        frame, out = inner, F.when(F.expr(sql), F.col("__value"))
        df = inner.df
    hidden = [x for x in frame.hidden if x not in ("__value",) and not x.startswith("__w")]
    df = df.select(*(F.col(quote(x)) for x in frame.columns), out.alias(name), *hidden)
    return changed(frame, df=df)


def summarize(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    wanted = [frame.resolve(n) for n in c.names()]
    if not wanted:
        raise CommandError("summarize needs a variable")
    frame = filtered(frame, c.cond, panel)
    types = frame.types()
    each, beyond = [], large(frame.df)
    for v in wanted:
        x = F.col(quote(v)).cast("int") if types[v] == "boolean" else F.col(quote(v))
        shares = [0.25, 0.5, 0.75]
        # an exact percentile keeps all different values in one task; beyond that, the places of the values are looked up
        p = F.array(*(F.lit(q).cast("double") for q in order_statistics(frame.df.select(x.alias(v)), v, shares))) if beyond else F.percentile(x, F.array(*map(F.lit, shares)))
        each.append(F.struct(
            F.lit(v).alias("variable"), F.count(x).alias("N"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).cast("double").alias("min") if len(wanted) > 1 else F.min(x).alias("min"),
            p[0].alias("p25"), p[1].alias("p50"), p[2].alias("p75"), F.max(x).cast("double").alias("max") if len(wanted) > 1 else F.max(x).alias("max"),
        ))
    # one pass over the data for all variables
    row = frame.df.agg(F.array(*each).alias("r")).select(F.inline("r"))
    return row if len(wanted) > 1 else row.drop("variable")


def tabulate(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    wanted = [frame.resolve(n) for n in c.names()]
    if not wanted:
        raise CommandError("tabulate needs a variable")
    frame = filtered(frame, c.cond, panel)
    counted = frame.df.groupBy(*(F.col(quote(n)).alias(n) for n in wanted)).agg(F.count(F.lit(1)).alias("freq"))
    return counted.orderBy(*(F.col(quote(n)).asc_nulls_last() for n in wanted))


def count(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    return filtered(frame, c.cond, panel).df.agg(F.count(F.lit(1)).alias("n"))


def listing(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    frame = filtered(frame, c.cond, panel)
    wanted = [frame.resolve(n) for n in c.names()] or frame.columns
    return frame.sorted().select(*(F.col(quote(n)) for n in wanted))


def _many(c: Command) -> int:
    text = c.head or "5"
    if not text.isdigit():
        raise CommandError(f"{c.verb} needs a number of rows, not {text}")
    return int(text)


def head(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    # sort and limit become one top-k
    return frame.sorted().limit(_many(c))


def tail(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    """The last rows, in order: the first ones of the reversed order, put right again."""
    frame = frame.numbered()
    last = frame.df.orderBy(*(k.sort(backwards=True) for k in frame.order)).limit(_many(c))
    return changed(frame, df=last).sorted()


def regress(frame: Frame, c: Command, panel: Panel = None) -> DataFrame:
    """Least squares of the first variable on the others: one pass for the cross products, a small system on the driver."""
    import numpy as np

    wanted = [frame.resolve(n) for n in names(c.head)]
    if len(wanted) < 2:
        raise CommandError("regress needs a result and at least one regressor")
    frame = filtered(frame, c.cond, panel)
    cols = [F.col(quote(n)).cast("double") for n in wanted]
    full = frame.df.select(*(x.alias(f"x{i}") for i, x in enumerate(cols))).dropna()
    terms = ["1.0D", *(f"x{i}" for i in range(1, len(wanted)))]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = full.agg(
        *(F.expr(f"sum({terms[i]} * {terms[j]})").alias(f"a{i}_{j}") for i, j in pairs), *(F.expr(f"sum({t} * x0)").alias(f"b{i}") for i, t in enumerate(terms)),
        F.expr("sum(x0 * x0)").alias("yy"), F.count(F.lit(1)).alias("n"),
    ).first()
    k, n = len(terms), row["n"]
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    b = np.array([row[f"b{i}"] or 0.0 for i in range(k)])
    if n <= k:
        raise CommandError("too few complete rows")
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    left = max(0.0, row["yy"] - beta @ b) / (n - k)
    se = np.sqrt(np.maximum(0.0, np.diag(inverse) * left))
    rows = [(v, float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] else None, int(n)) for i, v in [(i, wanted[i]) for i in range(1, k)] + [(0, "_cons")]]
    return frame.df.sparkSession.createDataFrame(rows, "variable string, coef double, se double, t double, n long")
