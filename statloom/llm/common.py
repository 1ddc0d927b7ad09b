"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statloom.runtime import share_package


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="statloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone
        pass


class Stage:
    """Tables written to the shared folder: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        share_package(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._last: dict[str, str] = {}
        atexit.register(_delete, spark, self.root)

    def cut(self, df: DataFrame, label: str, replace: bool = False) -> DataFrame:
        """Write ``df`` and read it back; with ``replace`` the previous table of this label is deleted afterwards."""
        self._n += 1
        path = f"{self.root}/{label}-{self._n}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        if replace and label in self._last:
            _delete(self.spark, self._last[label])
        self._last[label] = path
        return self.spark.read.schema(schema).parquet(path)

    def cut_counting(self, df: DataFrame, label: str, cond: Column) -> tuple[DataFrame, int]:
        """``cut`` in place of the previous table of this label, and for how many rows a condition holds, counted while they are written (0 only if for none)."""
        seen = Observation()
        table = self.cut(df.observe(seen, F.count_if(cond).alias("n")), label, replace=True)
        return table, seen.get["n"]

    def drop(self, label: str) -> None:
        if label in self._last:
            _delete(self.spark, self._last.pop(label))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, text) of a table, ready for functions of this package in Python workers."""
    share_package(docs.sparkSession)
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))


#: Characters that are taken together when words are hashed; a longer text is cut between two words.
GROUP = 1_000_000
_PLANES = 0x20000
_TERMS = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(_PLANES)), bool, _PLANES)


def _pieces(text: str) -> Iterator[str]:
    """The text, cut between words where it is very long."""
    at = 0
    while len(text) - at > GROUP:
        end = at + GROUP
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _hashed(text: str, ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of each word of a text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if ascii_only:
        cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
        inside = (cp >= 97) & (cp <= 122) | (cp >= 48) & (cp <= 57)
    else:
        inside = _alphanumeric()[np.minimum(cp, _PLANES - 1)]
        far = np.flatnonzero(cp >= _PLANES)
        inside[far] = [chr(c).isalnum() for c in cp[far].tolist()]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    terms = _TERMS[offset & 63]
    if int(offset.max()) > 63:
        terms = terms * (2 * (offset >> 6) + 1).astype(np.uint64)
    h = np.add.reduceat(cp[at] * terms, first)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return at[first], h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str | None], ascii_only: bool = False) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, case ignored, in order.

    Words are the longest runs of letters or digits of any script in the lower-cased text, or of ASCII letters or digits in the text as it is.
    """
    held: list[str] = []
    size = 0

    def out() -> Iterator[np.ndarray]:
        place, h = _hashed("\n".join(held), ascii_only)
        ends = np.searchsorted(place, np.cumsum([len(t) + 1 for t in held]))
        return iter(np.split(h, ends[:-1]))

    for t in texts:
        t = t or ""
        t = t if ascii_only else t.lower()
        if len(t) > GROUP:
            if held:
                yield from out()
                held, size = [], 0
            yield np.concatenate([_hashed(x, ascii_only)[1] for x in _pieces(t)])
            continue
        held.append(t)
        size += len(t)
        if size >= GROUP or len(held) >= 20_000:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()
