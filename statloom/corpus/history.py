"""Parsing of R history files.

Each file is read line by line on an executor (its state runs through the lines); everything around that is plain DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from statloom.runtime import share_package

# Words of the language that look like calls, its pipes and the operators that ask for another line.  Fixed values.
CONTROL = ["if", "for", "while", "repeat", "function", "switch", "return", "next", "break", "else", "in"]
PIPES = ["%>%", "|>", "%<>%", "%T>%", "%$%"]
_UNFINISHED = re.compile(r"(?:%[^%\s]*%|\|>|<<?-|->>?|[-+*/^=<>&|~,(\[{!:])\s*$")
_LEADING = re.compile(r"^\s*(?:%[^%\s]*%|\|>)")
_NAME = r"(?:[A-Za-z.][\w.]*:::?)?[A-Za-z.][\w.]*"
_CALLED = re.compile(rf"(?<![\w.:])({_NAME})\s*\(")
_ASSIGNED = re.compile(r"^\s*([A-Za-z.][\w.$@\[\]\"']*|`[^`]+`)\s*(?:<<-|<-|=(?!=))")
_ASSIGNED_RIGHT = re.compile(r"->>?\s*([A-Za-z.][\w.$]*)\s*$")


def _outside(text: str) -> Iterator[tuple[int, str]]:
    """(position, character) outside quotes; a backslash hides the next character of a quoted piece."""
    quote, i = "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        else:
            yield i, c
        i += 1


def strip_comment(line: str) -> str:
    """The line before its first unquoted ``#``."""
    for i, c in _outside(line):
        if c == "#":
            return line[:i].rstrip()
    return line.rstrip()


def _depth(text: str) -> int:
    return sum(1 if c in "([{" else -1 if c in ")]}" else 0 for _, c in _outside(text))


def _open_quote(text: str) -> bool:
    quote, i = "", 0
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            if c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        i += 1
    return bool(quote)


def join_lines(lines: list[str]) -> list[str]:
    """Lines that belong together: open brackets or quotes, an operator at the end, a pipe at the start of the next."""
    out: list[str] = []
    held = ""
    for line in lines:
        # inside an open string a hash is text
        line = line if held and _open_quote(held) else strip_comment(line)
        if not line.strip():
            continue
        if not held and out and _LEADING.match(line):
            held = out.pop()
        held = f"{held} {line.strip()}" if held else line.strip()
        if _depth(held) > 0 or _open_quote(held) or _UNFINISHED.search(held):
            continue
        out.append(held)
        held = ""
    return out + [held] if held else out


def split_statements(line: str) -> list[str]:
    """A line cut at the semicolons outside quotes and brackets."""
    parts, at, depth = [], 0, 0
    for i, c in _outside(line):
        depth += 1 if c in "([{" else -1 if c in ")]}" else 0
        if c == ";" and depth <= 0:
            parts.append(line[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, line[at:]] if p.strip()]


def blanked(text: str) -> str:
    """The text with quoted pieces blanked out."""
    out = [" "] * len(text)
    for i, c in _outside(text):
        out[i] = c
    return "".join(out)


def calls(command: str) -> list[str]:
    """Names called, in order, with their package; words of control flow are no calls, with a package neither."""
    return [n for n in _CALLED.findall(blanked(command)) if n.rpartition(":")[2] not in CONTROL]


def pipe_of(command: str) -> str:
    """The first pipe of a command, or an empty text."""
    text = blanked(command)
    found = [(text.find(p), p) for p in PIPES if p in text]
    return min(found)[1] if found else ""


def target_of(command: str) -> str:
    """The name that a command assigns to, or an empty text."""
    m = _ASSIGNED.match(command) or _ASSIGNED_RIGHT.search(blanked(command))
    return m.group(1).strip("`") if m else ""


def parse_text(text: str | None) -> list[str]:
    """The commands of a file."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return [s for line in join_lines(lines) for s in split_statements(line)]


def non_empty(files: DataFrame, text: str = "text") -> DataFrame:
    """Files with at least one line that is neither blank nor a comment."""
    line = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return files.filter(F.exists(line, lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#")))


def deduplicated(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.dropDuplicates(keys)


def indexed(files: DataFrame, text: str = "text", name: str = "source_file") -> DataFrame:
    """Size and line counts of every file, and a name it can be stored under."""
    lines = F.split(F.regexp_replace(text, "\n\\z", ""), "\n")
    return files.select(
        *(c for c in files.columns if c != text), F.octet_length(text).alias("size_bytes"), F.size(lines).alias("line_count"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("nonblank_line_count"), F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_").alias("raw_file"),
    )


def described(command: str) -> dict:
    """What the table of commands says about a command, and its calls."""
    found, pipe, target = calls(command), pipe_of(command), target_of(command)
    return {
        "command": command, "primary_function": found[0] if found else "", "has_pipe": bool(pipe), "pipe_type": pipe, "has_assignment": bool(target), "assignment_target": target, "calls": found,
    }


_COMMAND = "struct<command:string,primary_function:string,has_pipe:boolean,pipe_type:string,has_assignment:boolean,assignment_target:string,calls:array<string>>"


_KNOWN = ["command", "primary_function", "has_pipe", "pipe_type", "has_assignment", "assignment_target", "calls"]


def parse_commands(commands: DataFrame, command: str = "command") -> DataFrame:
    """The columns of a table of single commands with what is known of each: primary function, pipe, target and calls, in place of older columns of these names; a null command has none."""
    share_package(commands.sparkSession)
    schema = T.StructType([*commands.schema.fields, *T.StructType.fromDDL(f"__c {_COMMAND}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(schema["__c"].dataType)
        for batch in batches:
            found = [None if x is None else described(x) for x in batch.column(command).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "__c"])

    return commands.mapInArrow(run, schema).select(*(F.col(f"`{x}`") for x in commands.columns if x not in _KNOWN[1:]), *(F.col("__c")[x].alias(x) for x in _KNOWN if x != "command"))


def parse_history(files: DataFrame, name: str = "source_file", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, commands, function_calls) of a table of history files.

    Each row is a file of its own, also where names recur.  Files without commands are left out; ``file_id`` counts from 0 by name, equal names
    in the order of the rows; an older ``file_id`` is left out.  Files are parsed once, into a table; the numbering moves only names and row numbers, by way of range partitions.
    """
    from statloom.operators.windows import with_position
    from statloom.plans.frame import Frame, Key
    from statloom.sources.files import cut

    share_package(files.sparkSession)
    others = [c for c in files.columns if c not in (text, name, "file_id")]
    rows = files.select(name, *others, text)
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(f"__cmds array<{_COMMAND}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(schema["__cmds"].dataType)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                found = [described(c) for c in parse_text(one.column(batch.num_columns - 1)[0].as_py())]
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([found], kind)], schema.names)

    parsed = cut(rows.mapInArrow(run, schema).filter(F.size("__cmds") > 0).withColumn("__uid", F.monotonically_increasing_id()))
    order = with_position(Frame(parsed.select(name, "__uid"), (Key(name), Key("__uid")), has_rid=True)).df
    numbered = parsed.join(order.select("__uid", (F.col("__pos") - 1).alias("file_id")), "__uid")
    full = numbered.select("file_id", F.posexplode("__cmds").alias("command_index", "c"))
    commands = full.select("file_id", "command_index", *(F.col("c")[x].alias(x) for x in _KNOWN[:-1]))
    function_calls = full.select("file_id", "command_index", F.posexplode(F.col("c")["calls"]).alias("call_order", "function_name"))
    return numbered.select("file_id", name, *others), commands, function_calls
