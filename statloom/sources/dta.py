"""Statistical data files, format versions 117 to 121.

The layout is the published one: tagged sections, fixed-width rows, long strings in a section of their own.  Rows have one width,
so a file is read in ranges of rows, one per task, from any file system that Arrow knows.  Tasks pack the rows of a file to be written;
the driver only copies their bytes, as the format is one file.
"""

from __future__ import annotations

import datetime as dt
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statloom.errors import CommandError
from statloom.plans.expressions import quote
from statloom.runtime import share_package

#: Rows of a task's range.
RANGE = 250_000
#: Longest text that is written in the row itself.
FIXED = 2045
_DAYS = (dt.date(1970, 1, 1) - dt.date(1960, 1, 1)).days

# Type codes of the format and the largest values that are not missing.  Fixed values.
_STRL, _DOUBLE, _FLOAT, _LONG, _INT, _BYTE, _ALIAS = 32768, 65526, 65527, 65528, 65529, 65530, 65525
_WIDTH = {_STRL: 8, _DOUBLE: 8, _FLOAT: 4, _LONG: 4, _INT: 2, _BYTE: 1, _ALIAS: 0}
_NUMPY = {_DOUBLE: "f8", _FLOAT: "f4", _LONG: "i4", _INT: "i2", _BYTE: "i1"}
_LARGEST = {_DOUBLE: 8.9884656743e307, _FLOAT: 1.70141173319e38, _LONG: 2147483620, _INT: 32740, _BYTE: 100}


def located(spark: SparkSession, path: str) -> str:
    """The path as an address: without a scheme it lies on the default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _place(path: str) -> tuple[FileSystem, str]:
    if "://" not in path:
        return LocalFileSystem(), os.path.abspath(urlparse(path).path if path.startswith("file:") else path)
    return FileSystem.from_uri(path)


def opened(path: str):
    """A file to read, on any machine."""
    system, place = _place(path)
    return open(place, "rb") if isinstance(system, LocalFileSystem) else system.open_input_file(place)


@dataclass
class Header:
    release: int
    order: str
    n: int
    names: list[str]
    kinds: list[int]
    formats: list[str]
    labels: list[str]
    value_label_of: list[str]
    data: int
    strls: int
    value_labels: int

    @property
    def width(self) -> int:
        return sum(_WIDTH.get(k, k) for k in self.kinds)


def _text(raw: bytes, release: int) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1" if release < 118 else "utf-8", "replace")


def header(path: str) -> Header:
    """Everything before the rows."""
    with opened(path) as f:
        start = f.read(200)
        if not start.startswith(b"<stata_dta>"):
            raise CommandError(f"{path} is not a data file of version 117 or later")

        def tagged(name: bytes, within: bytes, size: int) -> bytes:
            at = within.index(b"<" + name + b">") + len(name) + 2
            return within[at:at + size]

        release = int(tagged(b"release", start, 3))
        if not 117 <= release <= 121:
            raise CommandError(f"data file version {release} is not supported")
        order = "<" if tagged(b"byteorder", start, 3) == b"LSF" else ">"
        wide = release in (119, 121)
        k = struct.unpack(order + ("I" if wide else "H"), tagged(b"K", start, 4 if wide else 2))[0]
        n = struct.unpack(order + ("I" if release == 117 else "Q"), tagged(b"N", start, 4 if release == 117 else 8))[0]
        f.seek(0)
        head = f.read(2000)
        at = head.index(b"<map>") + 5
        places = struct.unpack(order + "14Q", head[at:at + 112])
        name, form, label_name, label = (33, 49, 33, 81) if release == 117 else (129, 57, 129, 321)

        def section(number: int, tag: bytes, size: int) -> bytes:
            f.seek(places[number] + len(tag) + 2)
            return f.read(size)

        kinds = list(struct.unpack(f"{order}{k}H", section(2, b"variable_types", 2 * k)))
        cut = lambda raw, w: [_text(raw[i * w:(i + 1) * w], release) for i in range(k)]
        names = cut(section(3, b"varnames", name * k), name)
        formats = cut(section(5, b"formats", form * k), form)
        attached = cut(section(6, b"value_label_names", label_name * k), label_name)
        labels = cut(section(7, b"variable_labels", label * k), label)
        return Header(release, order, n, names, kinds, formats, labels, attached, places[9] + 6, places[10] + 7, places[11] + 14)


def _kind(code: int, form: str) -> str:
    if form.startswith(("%td", "%d")):
        return "date"
    if form.startswith(("%tc", "%tC")):
        return "timestamp"
    return {_DOUBLE: "double", _FLOAT: "float", _LONG: "int", _INT: "smallint", _BYTE: "tinyint"}.get(code, "string")


_SPARK = {"date": T.DateType(), "timestamp": T.TimestampNTZType(), "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "string": T.StringType()}
_ARROW = {"date": pa.date32(), "timestamp": pa.timestamp("us"), "double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def _strings(f, h: Header, at: int, wanted: set[tuple[int, int]] | None = None) -> Iterator[tuple[int, tuple[int, int], str | None]]:
    """(place, (variable, row), text if wanted) of the long strings from a place in the file on."""
    f.seek(at)
    while f.read(3) == b"GSO":
        key = struct.unpack(h.order + ("II" if h.release == 117 else "IQ"), f.read(8 if h.release == 117 else 12))
        kind, size = struct.unpack(h.order + "BI", f.read(5))
        text = None
        if wanted is not None and key in wanted:
            raw = f.read(size)
            text = (raw[:-1] if kind == 130 else raw).decode("latin-1" if h.release < 118 else "utf-8", "replace")
        yield at, key, text
        at += 3 + (8 if h.release == 117 else 12) + 5 + size
        f.seek(at)


def long_strings(f, h: Header, wanted: set[tuple[int, int]], at: int) -> tuple[dict[tuple[int, int], str], int]:
    """The long strings that rows refer to, and the place after the last one; they are looked for from a place on, what is missing from the start."""
    found: dict[tuple[int, int], str] = {}
    after = at
    for begin in dict.fromkeys((at, h.strls)):
        for place, key, text in _strings(f, h, begin, wanted) if len(found) < len(wanted) else ():
            if text is not None:
                found[key] = text
                after = max(after, place)
                if len(found) == len(wanted):
                    break
    return found, after


def string_places(f, h: Header, starts: list[int]) -> list[int]:
    """For ranges of rows, the place of the first long string of a row in or after each: one pass over their heads."""
    out: list[int] = []
    if _STRL in h.kinds:
        for place, (_, row), _ in _strings(f, h, h.strls):
            while len(out) < len(starts) and row > starts[len(out)]:
                out.append(place)
    return out + [h.strls] * (len(starts) - len(out))


def _reference(raw: bytes, h: Header) -> tuple[int, int]:
    if h.release == 117:
        return struct.unpack(h.order + "II", raw)
    split = 3 if h.release in (119, 121) else 2
    name = "little" if h.order == "<" else "big"
    return int.from_bytes(raw[:split], name), int.from_bytes(raw[split:], name)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        h = header(self.path)
        starts = list(range(0, max(h.n, 1), RANGE))
        with opened(self.path) as f:
            return [InputPartition((a, min(a + RANGE, h.n), place)) for a, place in zip(starts, string_places(f, h, starts))]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        h = header(self.path)
        a, b, place = partition.value
        cols = [(n, c, _kind(c, fm)) for n, c, fm in zip(h.names, h.kinds, h.formats) if c != _ALIAS]
        shape = np.dtype([(f"f{i}", h.order + _NUMPY[c] if c in _NUMPY else f"V{_WIDTH[c]}" if c == _STRL else f"S{c}") for i, (_, c, _) in enumerate(cols)])
        with opened(self.path) as f:
            while a < b:
                n = min(20_000, b - a)
                f.seek(h.data + a * h.width)
                cells = np.frombuffer(f.read(n * h.width), shape) if cols else np.empty(n, [])
                wanted = {_reference(bytes(r), h) for i, (_, c, _) in enumerate(cols) if c == _STRL for r in cells[f"f{i}"]}
                texts, place = long_strings(f, h, wanted - {(0, 0)}, place)
                arrays = []
                for i, (_, c, kind) in enumerate(cols):
                    x = cells[f"f{i}"]
                    if c == _STRL:
                        arrays.append(pa.array([texts.get(_reference(bytes(r), h), "") for r in x], pa.string()))
                    elif c <= FIXED:
                        arrays.append(pa.array([_text(r, h.release) for r in x.tolist()], pa.string()))
                    else:
                        # missing codes lie above the largest value
                        lost = (x > _LARGEST[c]) | (x != x)
                        x = np.where(lost, 0, x)
                        if kind == "date":
                            x = np.trunc(x).astype(np.int32) - np.int32(_DAYS)
                        elif kind == "timestamp":
                            x = np.rint(x * 1000.0).astype(np.int64) - np.int64(_DAYS * 86_400_000_000)
                        arrays.append(pa.array(x.astype(x.dtype.newbyteorder("=")), mask=lost).cast(_ARROW[kind]))
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _, _ in cols])
                a += n


class DtaSource(DataSource):
    """``spark.read.format("dta").load(path)``; option value_labels=true turns labelled numbers into their texts."""

    @classmethod
    def name(cls) -> str:
        return "dta"

    def schema(self):
        h = header(self.options["path"])
        return T.StructType([
            T.StructField(n, _SPARK[_kind(c, fm)], True, {"label": lab} if lab else {})
            for n, c, fm, lab in zip(h.names, h.kinds, h.formats, h.labels) if c != _ALIAS
        ])

    def reader(self, schema):
        return _Reader(self.options["path"])


def value_labels(path: str) -> dict[str, dict[int, str]]:
    """The value labels of a file: label name to number to text."""
    h = header(path)
    wide = 33 if h.release == 117 else 129
    out: dict[str, dict[int, str]] = {}
    with opened(path) as f:
        f.seek(h.value_labels)
        while f.read(5) == b"<lbl>":
            size = struct.unpack(h.order + "I", f.read(4))[0]
            name = _text(f.read(wide), h.release)
            f.read(3)
            body = f.read(size)
            n, length = struct.unpack(h.order + "II", body[:8])
            offsets = struct.unpack(f"{h.order}{n}I", body[8:8 + 4 * n])
            numbers = struct.unpack(f"{h.order}{n}i", body[8 + 4 * n:8 + 8 * n])
            texts = body[8 + 8 * n:8 + 8 * n + length]
            out[name] = {k: _text(texts[o:], h.release) for k, o in zip(numbers, offsets)}
            f.read(6)
    return out


def labels_of(spark: SparkSession, path: str) -> tuple[dict[str, dict[int, str]], dict[str, str]]:
    """(value labels by name, label name by variable) of a file."""
    path = located(spark, path)
    h, known = header(path), value_labels(path)
    return known, {n: label for n, label in zip(h.names, h.value_label_of) if label in known}


def read(spark: SparkSession, path: str, with_value_labels: bool = False) -> DataFrame:
    """A data file; with ``with_value_labels`` labelled numbers become their texts."""
    spark.dataSource.register(DtaSource)
    path = located(spark, path)
    system, place = _place(path)
    if system.get_file_info(place).type != FileType.File:
        raise CommandError(f"cannot open {path}")
    df = spark.read.format("dta").load(path)
    # the labels are metadata that the scan may not carry through
    h = header(path)
    for n, text in zip(h.names, h.labels):
        if text and n in df.columns:
            df = df.withMetadata(n, {"label": text})
    if with_value_labels:
        known = value_labels(path)
        for n, label in zip(h.names, h.value_label_of):
            if label in known and n in df.columns:
                texts = F.create_map(*(x for k, v in known[label].items() for x in (F.lit(k), F.lit(v))))
                df = df.withColumn(n, F.coalesce(F.try_element_at(texts, F.col(n).cast("int")), F.col(n).cast("string")))
    return df


def _out_kind(t: T.DataType) -> tuple[int, str]:
    """(type code, display format); whole numbers of 64 bits, dates and times become doubles."""
    simple = t.simpleString()
    if simple in ("tinyint", "boolean"):
        return _BYTE, "%8.0g"
    if simple == "smallint":
        return _INT, "%8.0g"
    if simple == "int":
        return _LONG, "%12.0g"
    if simple == "float":
        return _FLOAT, "%9.0g"
    if simple == "date":
        return _DOUBLE, "%td"
    if simple.startswith("timestamp"):
        return _DOUBLE, "%tc"
    if simple in ("bigint", "double") or simple.startswith("decimal"):
        return _DOUBLE, "%10.0g"
    return _STRL, "%9s"


_MISSING = {_DOUBLE: 2.0**1023, _FLOAT: 2.0**127, _LONG: 2147483621, _INT: 32741, _BYTE: 101}


def _lettered(path_labels: dict[str, dict[int, str]]) -> bytes:
    """The section of value labels."""
    out = []
    for name, mapping in path_labels.items():
        numbers = sorted(mapping)
        texts = [mapping[k].encode("utf-8") + b"\0" for k in numbers]
        offsets = np.cumsum([0, *map(len, texts)])[:-1] if texts else []
        body = struct.pack("<II", len(numbers), sum(map(len, texts))) + struct.pack(f"<{len(numbers)}I", *map(int, offsets)) + struct.pack(f"<{len(numbers)}i", *numbers) + b"".join(texts)
        out.append(b"<lbl>" + struct.pack("<I", len(body)) + _padded(name, 129) + b"\0\0\0" + body + b"</lbl>")
    return b"".join(out)


def _padded(text: str, width: int) -> bytes:
    raw = text.encode("utf-8")[:width - 1].decode("utf-8", "ignore").encode("utf-8")
    return raw.ljust(width, b"\0")


def _packer(kinds: list[tuple[int, str]], offsets: dict[int, int]):
    """Packs batches of rows with ``__mid`` as last column into (start, n, rows, strings): consecutive rows and their long strings as bytes."""
    shape = np.dtype([(f"f{i}", f"S{c}" if c <= FIXED else "u8" if c == _STRL else "<" + _NUMPY[c]) for i, (c, _) in enumerate(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mid = batch.column(batch.num_columns - 1).to_numpy()
            # rows are counted from 1
            number = np.array([offsets[int(p)] for p in mid >> 33], np.int64) + (mid & ((1 << 33) - 1)) + 1
            cells = np.zeros(len(mid), shape)
            strings: list[tuple[int, bytes]] = []
            for i, (c, fm) in enumerate(kinds):
                col = batch.column(i)
                if c == _STRL:
                    at = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(col), 0), False).to_numpy(zero_copy_only=False))
                    cells[f"f{i}"][at] = (i + 1) | number[at].astype(np.uint64) << np.uint64(16)
                    for k in at.tolist():
                        raw = col[k].as_py().encode("utf-8") + b"\0"
                        strings.append((k, b"GSO" + struct.pack("<IQBI", i + 1, int(number[k]), 130, len(raw)) + raw))
                elif c <= FIXED:
                    cells[f"f{i}"] = [b"" if x is None else x.encode("utf-8") for x in col.to_pylist()]
                else:
                    if fm == "%td":
                        col = pc.add(col.cast(pa.int32()), _DAYS)
                    elif fm == "%tc":
                        col = pc.divide(pc.add(col.cast(pa.timestamp("us")).cast(pa.int64()).cast(pa.float64()), _DAYS * 86_400e6), 1000.0)
                    elif pa.types.is_boolean(col.type):
                        col = col.cast(pa.int8())
                    elif pa.types.is_decimal(col.type):
                        col = col.cast(pa.float64())
                    x = col.cast(pa.float64()).to_numpy(zero_copy_only=False)
                    with np.errstate(invalid="ignore"):
                        lost = ~np.isfinite(x) | (x > _LARGEST[c])
                        if c in (_LONG, _INT, _BYTE):
                            lost |= x < -_LARGEST[c] - 40
                        cells[f"f{i}"] = np.where(lost, _MISSING[c], x)
            # pieces of consecutive rows: a batch may hold ends of several
            cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    own = b"".join(raw for k, raw in sorted((x for x in strings if lo <= x[0] < hi), key=lambda x: x[0]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(number[lo])]), pa.array([hi - lo]), pa.array([cells[lo:hi].tobytes()]), pa.array([own])], ["start", "n", "rows", "strings"])

    return run


def write(df: DataFrame, path: str, labels: dict[str, str], value_labels: dict[str, dict[int, str]] | None = None, attached: dict[str, str] | None = None) -> None:
    """A file of version 118 with the rows in the order of ``df``; an older file is replaced only when the new one is complete.

    The rows become a table that settles their order; tasks pack them, and the driver copies the packed bytes to the one file, piece by piece.
    """
    from statloom.sources.files import cut

    spark = df.sparkSession
    share_package(spark)
    value_labels, attached = value_labels or {}, attached or {}
    fields = df.schema.fields
    kinds = [_out_kind(f.dataType) for f in fields]
    texts = [f.name for f, (k, _) in zip(fields, kinds) if k == _STRL]
    if texts:
        df = df.withColumns({n: F.col(quote(n)).cast("string") for n in texts})
    placed = cut(df.withColumn("__mid", F.monotonically_increasing_id()))
    if texts:
        longest = placed.agg(*(F.max(F.octet_length(quote(n))).alias(n) for n in texts)).first()
        kinds = [(min(max(1, longest[f.name] or 1), FIXED + 1), f"%{max(1, min(longest[f.name] or 1, FIXED))}s") if k == _STRL else (k, fm) for f, (k, fm) in zip(fields, kinds)]
        kinds = [(_STRL if k == FIXED + 1 else k, fm) for k, fm in kinds]
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("__mid", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, n = {}, 0
    for p, size in counts:
        offsets[p] = n
        n += size
    packed = cut(placed.mapInArrow(_packer(kinds, offsets), "start long, n long, rows binary, strings binary"))
    gso = packed.agg(F.sum(F.octet_length("strings"))).first()[0] or 0
    width = sum(_WIDTH.get(c, c) for c, _ in kinds)
    k = len(fields)
    stamp = b"01 Jan 1960 00:00"
    head = b"<stata_dta><header><release>118</release><byteorder>LSF</byteorder><K>" + struct.pack("<H", k) + b"</K><N>" + struct.pack("<Q", n)
    head += b"</N><label>" + struct.pack("<H", 0) + b"</label><timestamp>" + bytes([len(stamp)]) + stamp + b"</timestamp></header>"
    known = {name: value_labels[name] for f in fields if (name := attached.get(f.name)) in value_labels}
    sections = [
        (b"variable_types", struct.pack(f"<{k}H", *(c for c, _ in kinds))), (b"varnames", b"".join(_padded(f.name, 129) for f in fields)), (b"sortlist", b"\0\0" * (k + 1)),
        (b"formats", b"".join(_padded(fm, 57) for _, fm in kinds)), (b"value_label_names", b"".join(_padded(attached[f.name] if attached.get(f.name) in known else "", 129) for f in fields)),
        (b"variable_labels", b"".join(_padded(labels.get(f.name, "")[:80], 321) for f in fields)), (b"characteristics", b""),
    ]
    places, at = [0, len(head)], len(head) + 11 + 112
    body = b""
    for tag, content in sections:
        places.append(at)
        body += b"<" + tag + b">" + content + b"</" + tag + b">"
        at += 2 * len(tag) + 5 + len(content)
    last = b"<value_labels>" + _lettered(known) + b"</value_labels>"
    # what follows has known sizes: rows, long strings, value labels
    places += [at, at + 13 + n * width, at + 13 + n * width + 15 + gso]
    end = places[-1] + len(last)
    places += [end, end + 12]
    system, target = _place(located(spark, path))
    if isinstance(system, LocalFileSystem):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = target + ".part"
    with system.open_output_stream(part) as f:
        f.write(head + b"<map>" + struct.pack("<14Q", *places) + b"</map>" + body + b"<data>")
        for column, between in (("rows", b"</data><strls>"), ("strings", b"</strls>")):
            for r in packed.select("start", column).orderBy("start").toLocalIterator():
                f.write(bytes(r[column]))
            f.write(between)
        f.write(last + b"</stata_dta>")
    system.move(part, target)
