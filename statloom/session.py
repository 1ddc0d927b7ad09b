"""A session: the current dataset, its history and everything that is declared about it."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.errors import CommandError
from statloom.operators import combining, rows, summaries
from statloom.plans import render
from statloom.plans.expressions import quote
from statloom.plans.frame import Frame
from statloom.plans.script import TERMINAL, Command, logical_lines, names, parse, unrolled
from statloom.runtime import share_package
from statloom.sources import dta, files

LIVE = "_live"
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


@dataclass(frozen=True)
class Step:
    text: str
    frame: Frame
    sql: str


@dataclass(frozen=True)
class Result:
    """What a command gives: rows to show, a message, or only its status."""

    data: DataFrame | None = None
    status: str = "OK"


_ROWS = {
    "keep": rows.keep, "drop": rows.drop, "rename": rows.rename, "order": rows.order, "generate": rows.generate, "replace": rows.replace,
    "mvencode": rows.mvencode, "sort": rows.sort, "duplicates": rows.duplicates, "expand": rows.expand, "egen": summaries.egen,
}
_SHOWN = {
    "list": summaries.listing, "head": summaries.head, "tail": summaries.tail, "count": summaries.count, "summarize": summaries.summarize,
    "tabulate": summaries.tabulate, "regress": summaries.regress,
}


class Session:
    """One user's state.  Frames are immutable, so undo, redo and restore only move between them.

    live_view: keep a view ``_live`` on the current dataset; sql_comments and format_sql: how ``show sql`` prints;
    strict_nm: firstnm and lastnm skip nulls; validate: merge checks that 1 sides have unique keys; spread_groups: bysort terms are worked
    out by positions and joins instead of a window per group; by default where a group may be too large for a task, by the planner's estimate and, beyond it,
    a count.  keep_text: text sources are kept in the executors once read (memory, then disk), as several commands read them.
    """

    def __init__(self, spark: SparkSession, live_view: bool = False, sql_comments: bool = True, format_sql: bool = True, strict_nm: bool = False, validate: bool = False, spread_groups: bool | None = None, keep_text: bool = True):
        share_package(spark)
        self.spark = spark
        self.live_view, self.sql_comments, self.format_sql, self.strict_nm, self.validate = live_view, sql_comments, format_sql, strict_nm, validate
        self.spread_groups, self.keep_text = spread_groups, keep_text
        self.temporary: set[str] = set()
        self._views: set[str] = set()
        self._kept: list[DataFrame] = []
        self._forget()

    def _forget(self) -> None:
        self.steps: list[Step] = []
        self.undone: list[Step] = []
        self.labels: dict[str, str] = {}
        self.value_labels: dict[str, dict[int, str]] = {}
        self.attached: dict[str, str] = {}
        self.panel: tuple[str | None, str] | None = None
        self.preserved: tuple[list[Step], list[Step]] | None = None

    # --- the dataset
    @property
    def frame(self) -> Frame:
        if not self.steps:
            raise CommandError("no dataset in memory; load one with use or import")
        return self.steps[-1].frame

    def current(self) -> DataFrame:
        """The current dataset, in no particular order."""
        return self.frame.visible()

    def _add(self, text: str, frame: Frame, sql: str) -> Result:
        self.steps.append(Step(text, replace(frame, spread=self.spread_groups), sql))
        self.undone = []
        self._live()
        return Result()

    def _live(self) -> None:
        if self.live_view and self.steps:
            self.frame.visible().createOrReplaceTempView(LIVE)
            self._views.add(LIVE)

    def _view_of(self, name: str) -> str:
        short = name.removeprefix("_tempfiles.")
        return f"_tempfiles_{short}" if short in self.temporary else name

    def _load(self, name: str, kind: str | None = None) -> DataFrame:
        return files.read(self.spark, name if files.kind_of(name) or kind else self._view_of(name), kind)

    # --- running
    def run(self, text: str) -> Result:
        """One command."""
        c = parse(text)
        if c.verb in _ROWS:
            before = self.frame
            after = _ROWS[c.verb](before, c, self.panel)
            return self._add(c.text, after, render.step_sql(c, before, after, self.panel))
        if c.verb in _SHOWN:
            return Result(_SHOWN[c.verb](self.frame, c, self.panel))
        return getattr(self, f"_{c.verb}")(c)

    def script(self, text: str) -> Result:
        """All commands of a script; the result is that of the last one that shows something."""
        shown = Result()
        for line in unrolled(logical_lines(text)):
            try:
                parse(line)
            except CommandError as e:
                if str(e).startswith("not a command"):
                    continue
                raise
            r = self.run(line)
            shown = r if r.data is not None else shown
        return shown

    # --- sources and sinks
    def _use(self, c: Command) -> Result:
        found = names(c.head)
        if len(found) != 1:
            raise CommandError('use needs a file in quotes or a table')
        return self._start(c, found[0], None)

    def _import(self, c: Command) -> Result:
        words = [w for w in names(c.head) if w.lower() != "using"]
        if len(words) != 2 or words[0].lower() != "delimited":
            raise CommandError("only import delimited is known")
        return self._start(c, words[1], "csv")

    def _start(self, c: Command, name: str, kind: str | None) -> Result:
        df = self._load(name, kind)
        kind = kind or files.kind_of(name)
        if kind in ("csv", "json", "dta") and self.keep_text and not c.has("lazy"):
            # text is parsed once; Parquet is left where it is, so that filters and columns reach the scan
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
        kept = self.preserved
        self._forget()
        self.preserved = kept
        for f in df.schema.fields:
            if f.metadata.get("label"):
                self.labels[f.name] = f.metadata["label"]
        if kind == "dta":
            self.value_labels, self.attached = dta.labels_of(self.spark, name)
        return self._add(c.text, Frame(df), f"SELECT * FROM {files.source_sql(name, kind)}")

    def _save(self, c: Command) -> Result:
        found = names(c.head)
        if len(found) != 1:
            raise CommandError("save needs a target")
        name = found[0]
        if c.has("table", "memory") or name.removeprefix("_tempfiles.") in self.temporary:
            df = self.frame.sorted().persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
            view = self._view_of(name)
            df.createOrReplaceTempView(view)
            self._views.add(view)
        else:
            files.write(self._labelled(), name, labels=self.labels, value_labels=self.value_labels, attached=self.attached)
        return Result()

    def _labelled(self) -> DataFrame:
        df = self.frame.sorted()
        for n, text in self.labels.items():
            if n in df.columns:
                df = df.withMetadata(n, {"label": text})
        return df

    def _export(self, c: Command) -> Result:
        words = [w for w in names(c.head) if w.lower() != "using"]
        if len(words) != 2 or words[0].lower() != "delimited":
            raise CommandError("only export delimited is known")
        files.write(self.frame.sorted(), words[1], "csv")
        return Result()

    def _tempfile(self, c: Command) -> Result:
        found = c.names()
        if not found:
            raise CommandError("tempfile needs names")
        self.temporary |= set(found)
        return Result()

    # --- two datasets and shape
    def _append(self, c: Command) -> Result:
        found = [w for w in c.names() if w.lower() != "using"]
        if len(found) != 1:
            raise CommandError("append needs using and a source")
        before = self.frame
        after = combining.append(before, Frame(self._load(found[0])))
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel, files.source_sql(self._view_of(found[0]))))

    def _merge(self, c: Command) -> Result:
        before, name = self.frame, combining.using_parts(c)[1]
        after = combining.merge(before, Frame(self._load(name)), c, self.validate)
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel, files.source_sql(self._view_of(name))))

    def _joinby(self, c: Command) -> Result:
        before, name = self.frame, combining.using_parts(c)[1]
        after = combining.joinby(before, Frame(self._load(name)), c)
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel, files.source_sql(self._view_of(name))))

    def _reshape(self, c: Command) -> Result:
        before = self.frame
        after = combining.reshape(before, c)
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel))

    def _recode(self, c: Command) -> Result:
        before = self.frame
        after = combining.recode(before, c)
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel))

    def _collapse(self, c: Command) -> Result:
        before = self.frame
        after = summaries.collapse(before, c, self.panel, self.strict_nm)
        return self._add(c.text, after, render.step_sql(c, before, after, self.panel))

    # --- state
    def _clear(self, c: Command) -> Result:
        for view in self._views:
            self.spark.catalog.dropTempView(view)
        for df in self._kept:
            df.unpersist()
        self._views, self._kept, self.temporary = set(), [], set()
        self._forget()
        return Result()

    @staticmethod
    def _times(c: Command) -> int:
        if c.head and not c.head.isdigit():
            raise CommandError(f"{c.verb} needs a number of steps")
        return int(c.head or 1)

    def _undo(self, c: Command) -> Result:
        n = min(self._times(c), max(0, len(self.steps) - 1))
        if not n:
            raise CommandError("Nothing to undo.")
        for _ in range(n):
            self.undone.append(self.steps.pop())
        self._live()
        return Result(status=f"undid {n}")

    def _redo(self, c: Command) -> Result:
        n = min(self._times(c), len(self.undone))
        if not n:
            raise CommandError("Nothing to redo.")
        for _ in range(n):
            self.steps.append(self.undone.pop())
        self._live()
        return Result(status=f"redid {n}")

    def _preserve(self, c: Command) -> Result:
        if self.preserved is not None:
            raise CommandError("already preserved; restore first")
        _ = self.frame
        self.preserved = (list(self.steps), list(self.undone))
        return Result()

    def _restore(self, c: Command) -> Result:
        if self.preserved is None:
            raise CommandError("nothing to restore; preserve first")
        self.steps, self.undone = self.preserved
        self.preserved = None
        self._live()
        return Result()

    def _xtset(self, c: Command) -> Result:
        found = c.names()
        if not 1 <= len(found) <= 2:
            raise CommandError(f"{c.verb} needs a time variable, or a unit and a time variable")
        found = [self.frame.resolve(n) for n in found]
        self.panel = (found[0], found[1]) if len(found) == 2 else (None, found[0])
        return Result()

    _tsset = _xtset

    def _history(self, c: Command) -> Result:
        entries = [(i, s.text, False) for i, s in enumerate(self.steps)]
        entries += [(len(self.steps) + i, s.text, True) for i, s in enumerate(reversed(self.undone))]
        return Result(self.spark.createDataFrame(entries, "step_id long, command string, undone boolean"))

    def sql(self) -> str:
        _ = self.frame
        return render.chain_sql([(s.text, s.sql) for s in self.steps], self.sql_comments, self.format_sql)

    def _show(self, c: Command) -> Result:
        if c.head.lower() not in ("sql", "query"):
            raise CommandError("show knows sql and query")
        return Result(self.spark.createDataFrame([(self.sql(),)], "sql string"))

    def _describe(self, c: Command) -> Result:
        types = self.frame.types()
        labelled = bool(self.labels or self.attached)
        found = []
        for n, t in types.items():
            shown = _TYPES.get(t, t.upper())
            found.append((n, shown, self.labels.get(n, ""), self.attached.get(n, "")) if labelled else (n, shown))
        schema = "column_name string, column_type string" + (", variable_label string, value_label string" if labelled else "")
        return Result(self.spark.createDataFrame(found, schema))

    _codebook = _describe

    def _label(self, c: Command) -> Result:
        kind, _, rest = c.head.partition(" ")
        kind, rest = kind.lower(), rest.strip()
        if kind == "variable":
            m = re.fullmatch(r"(\S+)\s+\"([^\"]*)\"", rest)
            if not m:
                raise CommandError('label variable needs a name and "text"')
            self.labels[self.frame.resolve(m.group(1))] = m.group(2)
        elif kind == "define":
            m = re.fullmatch(r"(\w+)((?:\s+-?\d+\s+\"[^\"]*\")+)", rest)
            if not m:
                raise CommandError('label define needs a name and pairs of a whole number and "text"')
            self.value_labels[m.group(1)] = {int(a): b for a, b in re.findall(r"(-?\d+)\s+\"([^\"]*)\"", m.group(2))}
        elif kind == "values":
            found = names(rest)
            if len(found) != 2:
                raise CommandError("label values needs a variable and a label")
            if found[1] not in self.value_labels:
                raise CommandError(f"value label {found[1]} is not defined")
            self.attached[self.frame.resolve(found[0])] = found[1]
        elif kind == "list":
            found_rows = [(n, "variable", t) for n, t in self.labels.items()] + [(n, "value_label", v) for n, v in self.attached.items()]
            found_rows += [(n, str(k), t) for n, mapping in self.value_labels.items() for k, t in mapping.items()]
            if not found_rows:
                return Result(status="no labels")
            return Result(self.spark.createDataFrame(sorted(found_rows), "name string, type string, value string"))
        else:
            raise CommandError("label knows variable, define, values and list")
        return Result()

    def decoded(self, column: str) -> DataFrame:
        """The dataset with a labelled variable's texts in place of its numbers."""
        mapping = self.value_labels[self.attached[column]]
        text = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))))
        return self.current().withColumn(column, F.coalesce(F.try_element_at(text, F.col(quote(column)).cast("int")), F.col(quote(column)).cast("string")))

    def _do(self, c: Command) -> Result:
        found = names(c.head)
        if len(found) != 1:
            raise CommandError("do needs a script file")
        if not os.path.exists(found[0]):
            raise CommandError(f"cannot open {found[0]}")
        with open(found[0], encoding="utf-8") as f:
            lines = logical_lines(f.read())
        for line in unrolled(lines):
            try:
                inner = parse(line)
            except CommandError as e:
                if str(e).startswith("not a command"):
                    continue
                raise
            if inner.verb in TERMINAL:
                continue
            if inner.verb in ("use", "import") and not inner.has("lazy"):
                inner = replace(inner, options={**inner.options, "lazy": None})
                (self._use if inner.verb == "use" else self._import)(inner)
                continue
            self.run(line)
        return Result()
