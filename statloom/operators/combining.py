"""Two datasets and shape: merge, joinby, append, reshape."""

from __future__ import annotations

from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.plans.expressions import quote
from statloom.plans.frame import RID, Frame, Key
from statloom.plans.script import Command

_CODES = {"master": 1, "1": 1, "using": 2, "2": 2, "match": 3, "matched": 3, "3": 3}
#: Different values of the new-column variable of reshape wide, at most.
WIDE = 10_000


def using_parts(c: Command) -> tuple[list[str], str]:
    """(words before ``using``, the source after it)."""
    words = c.names()
    low = [w.lower() for w in words]
    if "using" not in low or low.index("using") + 1 >= len(words):
        raise CommandError(f"{c.verb} needs using and a source")
    at = low.index("using")
    return words[:at], words[at + 1]


def _unique(df: DataFrame, keys: list[str], side: str) -> None:
    if not df.groupBy(*(F.col(quote(k)) for k in keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise CommandError(f"the keys do not identify the rows of the {side} data")


def merge(frame: Frame, using: Frame, c: Command, validate: bool = False) -> Frame:
    """Equi-join with a code for where a row was found: 1 here, 2 in the other data, 3 in both.

    Null keys match nothing.  The join type follows from the rows that are kept, so that no wider join is run than needed; broadcast,
    hash or sort-merge is left to the planner, which knows the sizes.
    """
    words, _ = using_parts(c)
    if not words or words[0] not in ("1:1", "m:1", "1:m", "m:m"):
        raise CommandError("merge needs 1:1, m:1, 1:m or m:m")
    keys = [frame.resolve(k) for k in words[1:]]
    if not keys:
        raise CommandError("merge needs key variables")
    chosen = c.option_names("keepusing")
    extra = [using.resolve(n) for n in chosen] if chosen else [n for n in using.columns if n not in keys]
    # where both sides have a variable, the one here stays
    extra = [n for n in extra if n not in keys and n not in frame.columns]
    kept = set()
    for w in c.option_names("keep"):
        if w.lower() not in _CODES:
            raise CommandError(f"keep() takes master, using and match, not {w}")
        kept.add(_CODES[w.lower()])
    kept = kept or {1, 2, 3}
    if validate:
        if words[0][0] == "1":
            _unique(frame.df, keys, "present")
        if words[0][2] == "1":
            _unique(using.df, keys, "other")
    coded = not c.has("nogenerate", "nogen", "nogenerated")
    frame = frame.numbered().protect(*frame.columns)
    left = frame.df
    right = using.numbered().df.select(*(F.col(quote(using.resolve(k))).alias(k) for k in keys), *(F.col(quote(n)) for n in extra), F.col(RID).alias("__urid"))
    if kept == {1}:
        # only rows without a partner: an anti join, and nulls for the other side
        types = dict(using.df.dtypes)
        df = left.join(right.select(*keys), keys, "left_anti").select(*left.columns, *(F.lit(None).cast(types[n]).alias(n) for n in extra))
        df = df.withColumn("__urid", F.lit(None).cast("long")).withColumn("_merge", F.lit(1))
    elif kept == {2}:
        types = {f.name: f.dataType for f in left.schema.fields}
        df = right.join(left.select(*(F.col(quote(k)) for k in keys)), keys, "left_anti")
        df = df.select(*(F.col(quote(n)) if n in keys else F.lit(None).cast(types[n]).alias(n) for n in left.columns), *(F.col(quote(n)) for n in extra), "__urid").withColumn("_merge", F.lit(2))
    else:
        how = "inner" if kept == {3} else "left" if 2 not in kept else "right" if 1 not in kept else "full"
        here, there = left.withColumn("__m", F.lit(True)), right.withColumn("__u", F.lit(True))
        df = here.join(there, keys, how)
        code = F.when(F.col("__m").isNotNull() & F.col("__u").isNotNull(), 3).when(F.col("__m").isNotNull(), 1).otherwise(2)
        df = df.withColumn("_merge", code)
        if kept == {1, 2}:
            df = df.filter("_merge <> 3")
    shown = [F.col(quote(n)) for n in [*frame.columns, *extra]]
    if coded:
        if "_merge" in frame.columns:
            raise CommandError("variable _merge is already defined; drop it or use nogenerate")
        shown.append(F.col("_merge"))
    # rows from here in their order, then the others in theirs
    df = df.select(*shown, *(F.col(quote(h)) for h in frame.hidden), "__urid")
    return _settled(df, (*frame.order, Key("__urid")))


def _settled(df: DataFrame, keys: tuple[Key, ...]) -> Frame:
    """A frame whose keys are hidden columns of names that later steps do not reuse."""
    names, out = {}, []
    for i, k in enumerate(keys):
        names[k.column] = f"__o{i}"
        out.append(Key(names[k.column], k.descending))
    shown = [x for x in df.columns if not x.startswith("__")]
    df = df.select(*(F.col(quote(x)) for x in shown), *(F.col(quote(a)).alias(b) for a, b in names.items()))
    return Frame(df, tuple(out), has_rid=True)


def joinby(frame: Frame, using: Frame, c: Command) -> Frame:
    """All pairs of rows that agree on the keys."""
    words, _ = using_parts(c)
    keys = [frame.resolve(k) for k in words]
    if not keys:
        raise CommandError("joinby needs key variables")
    extra = [n for n in using.columns if n not in keys and n not in frame.columns]
    frame = frame.numbered().protect(*frame.columns)
    right = using.numbered().df.select(*(F.col(quote(n)) for n in [*keys, *extra]), F.col(RID).alias("__urid"))
    df = frame.df.join(right, keys, "inner").select(*(F.col(quote(n)) for n in [*frame.columns, *extra]), *frame.hidden, "__urid")
    return _settled(df, (*frame.order, Key("__urid")))


def append(frame: Frame, using: Frame) -> Frame:
    """Rows of both, columns by name; missing ones are null, and a variable that is text in one is text in the result."""
    a, b = frame.numbered(), using.numbered()
    a = a.protect(*a.columns)
    left, right = a.visible().schema, b.visible().schema
    types = {f.name: f.dataType.simpleString() for f in left.fields}
    text = [f.name for f in right.fields if f.name in types and (types[f.name] == "string") != (f.dataType.simpleString() == "string")]

    def ready(f: Frame, side: int) -> DataFrame:
        cols = [F.col(quote(n)).cast("string").alias(n) if n in text else F.col(quote(n)) for n in f.columns]
        keys = [F.lit(side).alias("__side"), *(F.col(quote(k.column)).alias(f"__a{i}") for i, k in enumerate(f.order))] if side == 0 else [F.lit(side).alias("__side"), F.col(RID).alias("__brid")]
        return f.df.select(*cols, *keys)

    df = ready(a, 0).unionByName(ready(b, 1), allowMissingColumns=True)
    keys = (Key("__side"), *(Key(f"__a{i}", k.descending) for i, k in enumerate(a.order)), Key("__brid"))
    shown = [*frame.columns, *(n for n in using.columns if n not in frame.columns)]
    df = df.select(*(F.col(quote(n)) for n in shown), *(k.column for k in keys))
    return _settled(df, keys)


def reshape(frame: Frame, c: Command) -> Frame:
    words = c.names()
    kind = words[0].lower() if words else ""
    if kind not in ("long", "wide"):
        raise CommandError("reshape needs long or wide")
    j = (c.option_names("j") or [""])[0]
    if not j:
        raise CommandError("reshape needs j()")
    return _long(frame, words[1:], j) if kind == "long" else _wide(frame, words[1:], c.option_names("i"), j)


def _long(frame: Frame, stubs: list[str], j: str) -> Frame:
    """One row per id and suffix of ``stub_suffix``; rows in which all values are null vanish."""
    if not stubs:
        raise CommandError("reshape long needs stubs")
    parts: dict[str, dict[str, str]] = {}
    for name in frame.columns:
        for s in stubs:
            if name.startswith(s + "_") and len(name) > len(s) + 1:
                parts.setdefault(name[len(s) + 1:], {})[s] = name
    if not parts:
        raise CommandError(f"no variables named {stubs[0]}_...")
    wide = {n for p in parts.values() for n in p.values()}
    frame = frame.numbered().protect(*wide)
    ids = [n for n in frame.columns if n not in wide]
    clash = [n for n in [j, *stubs] if n in ids]
    if clash:
        raise CommandError(f"variable {clash[0]} is already defined")
    types = frame.types()
    kinds = {}
    for s in stubs:
        found = {types[p[s]] for p in parts.values() if s in p}
        kinds[s] = found.pop() if len(found) == 1 else "string" if "string" in found else "double"
    # a narrow step: one array of structs per row, exploded
    rows = [
        F.struct(F.lit(k).alias(j), *((F.col(quote(p[s])) if s in p else F.lit(None)).cast(kinds[s]).alias(s) for s in stubs))
        for k, p in parts.items()
    ]
    df = frame.df.select(*(F.col(quote(n)) for n in ids), *frame.hidden, F.posexplode(F.array(*rows)).alias("__at", "__row"))
    values = [F.col("__row")[s].alias(s) for s in stubs]
    test = F.col("__row")[stubs[0]].isNotNull()
    for s in stubs[1:]:
        test = test | F.col("__row")[s].isNotNull()
    df = df.filter(test).select(*(F.col(quote(n)) for n in ids), F.col("__row")[j].alias(j), *values, *frame.hidden, "__at")
    return _settled(df, (*frame.order, Key("__at")))


def _wide(frame: Frame, stubs: list[str], ids: list[str], j: str) -> Frame:
    """One row per ids, one column per value of j; the first value by the row order where several fall together."""
    if len(stubs) < 1 or not ids:
        raise CommandError("reshape wide needs a variable and i()")
    values = [frame.resolve(s) for s in stubs]
    keys, j = [frame.resolve(i) for i in ids], frame.resolve(j)
    found = frame.df.select(F.col(quote(j)).alias("j")).filter("j is not null").distinct().orderBy("j").limit(WIDE + 1).collect()
    if len(found) > WIDE:
        raise CommandError(f"{j} has over {WIDE} different values")
    cells = [r["j"] for r in found]
    frame = frame.numbered()
    place = F.struct(*(x for k in frame.order for x in (F.col(quote(k.column)).isNull(), F.col(quote(k.column)))))

    def first(v: str) -> Column:
        return F.min_by(F.struct(F.col(quote(v)).alias("v")), place)["v"]

    groups = [F.col(quote(k)).alias(k) for k in keys]
    wide = frame.df.groupBy(*groups).pivot(quote(j), cells).agg(*(first(v).alias(v) for v in values))
    if len(values) > 1:
        wide = wide.select(*(F.col(quote(k)) for k in keys), *(F.col(quote(f"{x}_{v}")).alias(f"{v}_{x}") for v in values for x in cells))
    return Frame(wide, tuple(Key(k) for k in keys), has_rid=True)


def recode(frame: Frame, c: Command) -> Frame:
    """``recode v (1=10) (2=20) [, generate(w)]``: values by exact match, others stay."""
    import re

    rules = re.findall(r"\(([^()=]+)=([^()]+)\)", c.head)
    name = frame.resolve(c.names()[0])
    if not rules:
        raise CommandError("recode needs rules such as (1=10)")
    new = (c.option_names("generate", "gen") or [name])[0]
    kind = frame.types()[name]
    x = F.col(quote(name))
    out: Column | None = None
    for old, to in rules:
        test = x == F.lit(old.strip().strip('"')).cast(kind)
        value = F.lit(to.strip().strip('"')).cast(kind)
        out = F.when(test, value) if out is None else out.when(test, value)
    frame = frame.protect(new)
    return changed(frame, df=frame.df.withColumn(new, out.otherwise(x)))  # type: ignore[union-attr]
