"""A dataset with an explicit row order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.plans.expressions import Scope, quote, to_sql

#: Names of helper columns begin so; no command shows or changes them.
HIDDEN = "__"
RID = "__rid"


@dataclass(frozen=True)
class Key:
    """A sort key: a column of the data, possibly a hidden one."""

    column: str
    descending: bool = False

    def sql(self) -> str:
        return f"{quote(self.column)} {'DESC' if self.descending else 'ASC'} NULLS LAST"

    def sort(self, backwards: bool = False) -> Column:
        c = F.col(quote(self.column))
        if self.descending != backwards:
            return c.desc_nulls_first() if backwards else c.desc_nulls_last()
        return c.asc_nulls_first() if backwards else c.asc_nulls_last()


@dataclass(frozen=True)
class Frame:
    """An immutable dataset.

    ``order`` says how the rows follow each other; rows are sorted only where they are shown or written.  ``has_rid`` tells whether the
    scan order is among the columns: it is added late, as it keeps filters from reaching the scan.  ``spread``: terms over groups are worked out without
    windows over groups; None: where a group may be too large for a task.
    """

    df: DataFrame
    order: tuple[Key, ...] = ()
    has_rid: bool = False
    spread: bool | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def visible(self) -> DataFrame:
        return self.df.select(*(F.col(quote(c)) for c in self.columns)) if self.hidden else self.df

    def sorted(self) -> DataFrame:
        """The visible data in order; the scan order needs no sort."""
        if not self.order:
            return self.visible()
        return self.df.orderBy(*(k.sort() for k in self.order)).select(*(F.col(quote(c)) for c in self.columns))

    def numbered(self) -> Frame:
        """With the scan order as a column and as the last key, so that the order is total.

        Before any shuffle the number follows the scan, whose splits do not change from run to run.
        """
        if self.has_rid:
            return self
        df = self.df.withColumn(RID, F.monotonically_increasing_id())
        return replace(self, df=df, order=(*self.order, Key(RID)), has_rid=True)

    def types(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.df.schema.fields if not f.name.startswith(HIDDEN)}

    def resolve(self, name: str) -> str:
        if name in self.columns:
            return name
        low = [c for c in self.columns if c.lower() == name.lower()]
        if len(low) == 1:
            return low[0]
        raise CommandError(f"no variable named {name}")

    def undefined(self, name: str) -> None:
        """A new name must differ from all others, letter case aside."""
        if name.startswith(HIDDEN):
            raise CommandError(f"names cannot begin with {HIDDEN}")
        if name.lower() in {c.lower() for c in self.columns}:
            raise CommandError(f"variable {name} is already defined")

    def protect(self, *changed: str) -> Frame:
        """Keep the values of sort keys that are about to change, as hidden columns."""
        keys = [k.column for k in self.order if k.column in changed]
        if not keys:
            return self
        df, order = self.df, self.order
        for c in dict.fromkeys(keys):
            new = f"__key{sum(x.startswith('__key') for x in df.columns)}"
            df = df.withColumn(new, F.col(quote(c)))
            order = tuple(replace(k, column=new) if k.column == c else k for k in order)
        return replace(self, df=df, order=order)

    def scope(self, by: tuple[str, ...] = (), by_sort: tuple[str, ...] = (), panel: tuple[str | None, str] | None = None) -> Scope:
        keys = [Key(self.resolve(c)) for c in by_sort]
        keys += [k for k in self.order if k.column not in {x.column for x in keys}]
        return Scope(self.types(), tuple(self.resolve(c) for c in by), tuple(k.sql() for k in keys), panel, spread=bool(self.spread))

    def with_order(self, keys: tuple[Key, ...]) -> Frame:
        """Without hidden columns that no key uses any more."""
        used = {k.column for k in keys}
        drop = [c for c in self.hidden if c not in used]
        return replace(self, df=self.df.drop(*drop) if drop else self.df, order=keys, has_rid=self.has_rid and RID in used)


def compiled(frame: Frame, text: str, by: tuple[str, ...] = (), by_sort: tuple[str, ...] = (), panel: tuple[str | None, str] | None = None, running: bool = True) -> tuple[Frame, str, Scope]:
    """The frame with all columns an expression needs, the SQL of the expression, and its scope.

    An expression that looks at other rows needs the total row order, so the scan order is added first.
    """
    from statloom.operators import windows

    scope = frame.scope(by, by_sort, panel)
    scope.running = running
    if not scope.order:
        scope.order = (Key(RID).sql(),)
    sql = to_sql(text, scope)
    if scope.windows:
        groups = list(by) or ([panel[0]] if panel and panel[0] else [])
        chosen = frame.spread
        if groups and chosen is None:
            frame = replace(frame, spread=windows.hot_groups(frame.df, [frame.resolve(g) for g in groups]))
        frame = frame.numbered()
        again = frame.scope(by, by_sort, panel)
        again.running = running
        sql, scope = to_sql(text, again), again
        scope.windows = True
        if scope.whole:
            frame = windows.add_terms(frame, scope.whole, [frame.resolve(c) for c in by], [frame.resolve(c) for c in by_sort], panel)
        frame = replace(frame, spread=chosen)
    return frame, sql, scope
