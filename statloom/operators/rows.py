"""Rows and columns: keep, drop, rename, order, generate, replace, mvencode, sort, expand, duplicates."""

from __future__ import annotations

from dataclasses import replace as changed

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.operators.windows import hot_groups, with_position
from statloom.plans.expressions import quote
from statloom.plans.frame import Frame, Key, compiled
from statloom.plans.script import Command

Panel = tuple[str | None, str] | None


def filtered(frame: Frame, cond: str | None, panel: Panel = None, by: tuple[str, ...] = (), by_sort: tuple[str, ...] = (), negate: bool = False) -> Frame:
    """The rows for which a condition holds (or, negated, is false; a null condition drops the row both ways)."""
    if cond is None:
        return frame
    names = set(frame.df.columns)
    frame, sql, scope = compiled(frame, cond, by, by_sort, panel)
    test = f"NOT ({sql})" if negate else sql
    if not scope.windows:
        return changed(frame, df=frame.df.filter(F.expr(test)))
    df = frame.df.withColumn("__if", F.expr(test)).filter("__if")
    drop = [c for c in df.columns if c not in names and c in ("__if", *(w[0] for w in scope.whole))]
    return changed(frame, df=df.drop(*drop))


def select(frame: Frame, names: list[str]) -> Frame:
    frame = frame.protect(*(c for c in frame.columns if c not in names))
    return changed(frame, df=frame.df.select(*(F.col(quote(c)) for c in [*names, *frame.hidden])))


def keep(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    names = [frame.resolve(n) for n in c.names()]
    if not names and c.cond is None:
        raise CommandError("keep needs variables or an if condition")
    frame = filtered(frame, c.cond, panel, c.by, c.by_sort)
    return select(frame, names) if names else frame


def drop(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    names = [frame.resolve(n) for n in c.names()]
    if names and c.cond is not None or not names and c.cond is None:
        raise CommandError("drop needs variables or an if condition")
    if names:
        return select(frame, [n for n in frame.columns if n not in names])
    return filtered(frame, c.cond, panel, c.by, c.by_sort, negate=True)


def rename(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    names = c.names()
    if len(names) != 2:
        raise CommandError("rename needs an old and a new name")
    old, new = frame.resolve(names[0]), names[1]
    if new.lower() != old.lower():
        frame.undefined(new)
    frame = frame.protect(old)
    rest = [F.col(quote(x)) for x in frame.columns if x != old]
    # the renamed variable moves to the end
    return changed(frame, df=frame.df.select(*rest, F.col(quote(old)).alias(new), *frame.hidden))


def order(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    first = list(dict.fromkeys(frame.resolve(n) for n in c.names()))
    if not first:
        raise CommandError("order needs variables")
    return changed(frame, df=frame.df.select(*(F.col(quote(x)) for x in [*first, *(x for x in frame.columns if x not in first), *frame.hidden])))


def assignment(head: str) -> tuple[str, str]:
    name, sign, expression = head.partition("=")
    name, expression = name.strip().strip("`"), expression.strip()
    if not sign or not name or not expression or expression.startswith("="):
        raise CommandError(f"an assignment name = expression is needed, not: {head}")
    return name, expression


def _assigned(frame: Frame, c: Command, panel: Panel, name: str, expression: str, other: str) -> Frame:
    both = f"CASE WHEN {c.cond} THEN {expression} ELSE {other} END" if c.cond else expression
    before = set(frame.df.columns)
    frame, sql, scope = compiled(frame, both, c.by, c.by_sort, panel)
    frame = frame.protect(name)
    df = frame.df.withColumn(name, F.expr(sql))
    drop = [w[0] for w in scope.whole if w[0] not in before]
    df = df.drop(*drop) if drop else df
    hidden = [x for x in df.columns if x.startswith("__")]
    if hidden and name not in before:
        df = df.select(*(F.col(quote(x)) for x in [y for y in df.columns if y not in hidden] + hidden))
    return changed(frame, df=df)


def generate(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    name, expression = assignment(c.head)
    frame.undefined(name)
    return _assigned(frame, c, panel, name, expression, "NULL")


def replace(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    name, expression = assignment(c.head)
    name = frame.resolve(name)
    return _assigned(frame, c, panel, name, expression, f"`{name}`")


def mvencode(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    names = c.names()
    value = c.options.get("mv") or "0"
    if not names:
        raise CommandError("mvencode needs variables")
    if names == ["_all"]:
        text = "'" in value or '"' in value
        types = frame.types()
        names = [n for n in frame.columns if (types[n] == "string") == text and types[n] not in ("boolean", "date", "timestamp", "timestamp_ntz", "binary")]
    names = [frame.resolve(n) for n in names]
    _, sql, _ = compiled(frame, value)
    frame = frame.protect(*names)
    return changed(frame, df=frame.df.withColumns({n: F.expr(f"coalesce({quote(n)}, {sql})") for n in names}))


def sort(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    names = [frame.resolve(n) for n in c.names()]
    if not names:
        raise CommandError("sort needs variables")
    keys = tuple(Key(n, c.has("desc")) for n in dict.fromkeys(names))
    # a stable sort: ties keep their order, which is looked up only if something depends on it
    return changed(frame, order=(*keys, *(k for k in frame.order if k.column not in names)))


def duplicates(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    words = c.names()
    if not words or words[0].lower() != "drop":
        raise CommandError("duplicates only knows drop")
    names = [frame.resolve(n) for n in words[1:]]
    if not names:
        if not frame.order and not frame.has_rid:
            return Frame(frame.df.distinct())
        names = frame.columns
    frame = frame.numbered()
    order = frame.order
    if any(k.descending for k in order) and hot_groups(frame.df, names):
        # one ascending place in the order, so that the aggregate below can be used
        frame = with_position(frame, "__place")
        frame = changed(frame, order=(Key("__place"),))
    # the first row of each group by the row order: an aggregate, so a large group is reduced before it moves
    rest = [x for x in frame.df.columns if x not in names]
    if all(not k.descending for k in frame.order):
        # nulls sort last: a flag in front of each key
        keys = F.struct(*(x for k in frame.order for x in (F.col(quote(k.column)).isNull(), F.col(quote(k.column)))))
        packed = F.struct(*(F.col(quote(x)) for x in rest)) if rest else F.struct(F.lit(0).alias("__none"))
        groups = [F.col(quote(n)).alias(n) for n in names]
        df = frame.df.groupBy(*groups).agg(F.min_by(packed, keys).alias("__first"))
        df = df.select(*(F.col(quote(x)) if x in names else F.col("__first")[x].alias(x) for x in frame.df.columns))
        return changed(frame, df=df.drop("__place"), order=order)
    w = Window.partitionBy(*(F.col(quote(n)) for n in names)).orderBy(*(k.sort() for k in frame.order))
    return changed(frame, df=frame.df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn"))


def expand(frame: Frame, c: Command, panel: Panel = None) -> Frame:
    if not c.head:
        raise CommandError("expand needs a number or an expression")
    flag = (c.option_names("generate", "gen") or [None])[0]
    if flag:
        frame.undefined(flag)
    frame, sql, _ = compiled(frame.numbered(), c.head, c.by, c.by_sort, panel)
    visible = frame.columns
    # no copies for null, zero and negative counts
    copies = F.expr(f"posexplode(array_repeat(0, CAST(coalesce({sql}, 0) AS INT)))").alias("__copy", "__zero")
    df = frame.df.select("*", copies).drop("__zero")
    new = [F.when(F.col("__copy") > 0, 1).otherwise(0).alias(flag)] if flag else []
    df = df.select(*(F.col(quote(x)) for x in visible), *new, *frame.hidden, F.col("__copy").alias(f"__copy{len(frame.order)}"))
    return changed(frame, df=df, order=(*frame.order, Key(f"__copy{len(frame.order)}")))
