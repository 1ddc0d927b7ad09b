"""Problem 8: evaluation texts inside training texts, by a positional inverted index.

The index is cut by documents: a shard holds, for every term of its documents, the sorted positions in the shard's
stream of words.  A phrase is found inside a shard by intersecting offset-adjusted lists from the rarest terms on, so no
posting is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Stage, texts_of, word_hashes

PHRASE = 13
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 2_000_000
#: Characters that all evaluation items together may have; they are held by the driver and every task.
MAX_ITEM_CHARACTERS = 10_000_000
#: Proximity: so many of the rarest terms of an item within so many words.
RAREST, NEEDED, TILE = 8, 6, 64

_WORD = re.compile(r"[A-Za-z0-9]+")


def word_ids(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs of ASCII letters or digits, case ignored) of a text."""
    return next(word_hashes([text], ascii_only=True))


_INDEX = "terms array<long>, starts array<int>, positions array<int>, docs array<long>, doc_starts array<int>"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[int] = []
    words: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words])
        # one free position after each document, so no phrase runs over its end
        doc_starts = np.cumsum(lengths + 1) - lengths - 1
        stream = np.concatenate(words)
        at = np.arange(len(stream)) + np.repeat(np.arange(len(words)), lengths)
        order = np.argsort(stream, kind="stable")
        ranked = stream[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        one = lambda x, t: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [one(ranked[starts].view(np.int64), pa.int64()), one(starts, pa.int32()), one(at[order], pa.int32()), one(docs, pa.int64()), one(doc_starts, pa.int32())],
            ["terms", "starts", "positions", "docs", "doc_starts"],
        )

    for batch in batches:
        for i, w in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist(), ascii_only=True)):
            if not len(w):
                continue
            if words and size + len(w) > SHARD_WORDS:
                yield out()
                docs, words, size = [], [], 0
            docs.append(i)
            words.append(w)
            size += len(w)
    if words:
        yield out()


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional index of every word of every text, one row per shard.

    Null ids, null texts and texts without words have no postings; a repeated id has the postings of all its texts.
    """
    rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(_shards, _INDEX)


class _Shard:
    def __init__(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, docs: np.ndarray, doc_starts: np.ndarray):
        self.terms, self.positions, self.docs, self.doc_starts = terms.view(np.uint64), positions, docs, doc_starts
        self.starts = np.append(starts, len(positions))

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[k] == terms
        return np.where(known, self.starts[k], 0), np.where(known, self.starts[k + 1], 0)

    def document(self, at: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.doc_starts, at, side="right") - 1]


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(x):
        return np.zeros(len(x), bool)
    k = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[k] == x


def phrases(shard: _Shard, item: np.ndarray, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(documents, longest run) of the documents with at least ``phrase`` consecutive words of the item."""
    n = len(item)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if n < phrase:
        return none
    lo, hi = shard.ranges(item)
    count = hi - lo
    lists = lambda o: shard.positions[lo[o]:hi[o]]
    found: list[np.ndarray] = []
    start = 0
    while start + phrase <= n:
        # the rarest word of the window; windows that hold it are settled by its list
        anchor = start + int(np.argmin(count[start:start + phrase]))
        at = lists(anchor)
        if len(at):
            good = np.zeros(len(at), bool)
            half = phrase // 2
            # a phrase with this word holds all of the half before or all of the half after it
            for a, b in ((max(0, anchor - half), anchor), (anchor + 1, min(n, anchor + half + 1))):
                if b - a < half:
                    continue
                left = np.arange(len(at))
                for o in a + np.argsort(count[a:b], kind="stable"):
                    left = left[_within(at[left] + (o - anchor), lists(o))]
                    if not len(left):
                        break
                good[left] = True
            if good.any():
                found.append(at[good].astype(np.int64) - anchor)
        start = anchor + 1
    if not found:
        return none
    shift = np.unique(np.concatenate(found))
    run, best = np.zeros(len(shift), np.int64), np.zeros(len(shift), np.int64)
    end = np.zeros(len(shift), np.int64)
    for o in range(n):
        hit = _within(shift + o, lists(o))
        run = np.where(hit, run + 1, 0)
        end = np.where(run > best, o, end)
        best = np.maximum(best, run)
    keep = best >= phrase
    doc = shard.document((shift + end)[keep])
    best = best[keep]
    order = np.lexsort((-best, doc))
    doc, best = doc[order], best[order]
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    return doc[first], best[first]


def near(shard: _Shard, terms: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, most terms at once) of the documents in which ``need`` of the terms stand within TILE words."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(terms) < need or not len(terms):
        return none
    lo, hi = shard.ranges(terms)
    at = np.concatenate([shard.positions[x:y] for x, y in zip(lo, hi)]).astype(np.int64)
    if not len(at):
        return none
    label = np.repeat(np.arange(len(terms)), hi - lo)
    order = np.argsort(at)
    at, label = at[order], label[order]
    part = np.searchsorted(shard.doc_starts, at, side="right") - 1
    # of the window that ends at each position: the terms whose last place before is inside
    begin = np.maximum(at - TILE + 1, shard.doc_starts[part])
    n = np.zeros(len(at), np.int64)
    for k in range(len(terms)):
        n += np.maximum.accumulate(np.where(label == k, at, -1)) >= begin
    doc, n = shard.docs[part[n >= need]], n[n >= need]
    order = np.lexsort((-n, doc))
    doc, n = doc[order], n[order]
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    return doc[first], n[first]


def _frequencies(terms: np.ndarray):
    """Per shard, in how many of its documents each of the terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = _shard(batch, k)
                part = np.searchsorted(shard.doc_starts, shard.positions, side="right") - 1
                new = np.concatenate(([True], part[1:] != part[:-1]))
                new[shard.starts[:-1]] = True
                upto = np.concatenate(([0], np.cumsum(new)))
                lo, hi = shard.ranges(terms)
                n = upto[hi] - upto[lo]
                yield pa.RecordBatch.from_arrays([pa.array(terms[n > 0].view(np.int64)), pa.array(n[n > 0].astype(np.int64))], ["term", "n"])

    return run


def rarest(index: DataFrame, items: list[tuple[int, str]]) -> list[tuple[int, bytes, int]]:
    """(item, its RAREST terms, how many of them are needed), by the documents of the whole index that hold a term, ties by the term itself.

    Terms that no document holds are left out.
    """
    each = [(i, word_ids(" ".join(sorted({w.lower() for w in _WORD.findall(t)})))) for i, t in items]
    terms = np.unique(np.concatenate([t for _, t in each])) if each else np.empty(0, np.uint64)
    if not len(terms):
        return []
    known = index.mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(terms), np.int64)
    count[np.searchsorted(terms, known.column(0).to_numpy().view(np.uint64))] = known.column(1).to_numpy()
    out = []
    for i, t in each:
        n = count[np.searchsorted(terms, t)]
        order = np.argsort(n, kind="stable")
        out.append((i, t[order[n[order] > 0][:RAREST]].tobytes(), min(NEEDED, len(t))))
    return out


def _shard(batch: pa.RecordBatch, k: int) -> _Shard:
    return _Shard(*(np.array(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in range(5)))


def _search(items: list[tuple], how: str, phrase: int):
    """items: the id and the words, for ``near`` the terms and how many are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(i, np.frombuffer(b, np.uint64), *need) for i, b, *need in items]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = _shard(batch, k)
                docs, ids, size = [], [], []
                for i, item, *need in ready:
                    d, n = phrases(shard, item, phrase) if how == "phrase" else near(shard, item, *need)
                    docs.append(d)
                    ids.append(np.full(len(d), i, np.int64))
                    size.append(n)
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (docs, ids, size)], ["doc_id", "item_id", "words"])

    return run


def read_items(items: DataFrame, item: str = "item_id", text: str = "text") -> list[tuple[int, str]]:
    """The evaluation items, for the tasks; more than MAX_ITEM_CHARACTERS are refused, as driver and tasks hold them."""
    rows = items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MAX_ITEM_CHARACTERS:
        raise ValueError(f"the items have {size} characters; search them in parts of at most {MAX_ITEM_CHARACTERS}")
    return [(r["i"], r["t"]) for r in rows.collect()]


def leaks(docs: DataFrame, items: DataFrame, how: str = "phrase", phrase: int = PHRASE) -> DataFrame:
    """(doc_id, item_id, words) of the documents that hold an evaluation item.

    ``how="phrase"``: at least ``phrase`` consecutive words of the item in the same order; ``words`` is the longest such run.
    ``how="near"``: at least NEEDED (all different terms, if the item has fewer) of the item's RAREST terms within TILE words; ``words`` is their
    number.  Rarest are those in the fewest documents of the whole index, at least one; ties go by the term.
    Each (document, item) comes once.  Items with fewer words than ``phrase`` leak in no document.
    """
    stage = Stage(docs.sparkSession, "index")
    known = read_items(items)
    index = stage.cut(build_index(docs), "postings")
    wanted: list[tuple] = rarest(index, known) if how == "near" else [(i, word_ids(t).tobytes()) for i, t in known]
    # the hits are few: once they are a table, the index can go
    hits = stage.cut(index.mapInArrow(_search(wanted, how, phrase), "doc_id long, item_id long, words long"), "hits")
    stage.drop("postings")
    return hits.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
