"""Problem 5: frequent subsequences with gaps across many sequences, as closed patterns.

Patterns grow from their first item; a sequence is never copied, each step looks it up from the leftmost instance of the prefix
(pseudo-projection).  A pattern is closed if no item can be added after it or, by the maximum periods, before or inside it
without losing a sequence; the semi-maximum periods prune prefixes that lead to no closed pattern.  Supports of all
frequent patterns follow from the closed ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import Stage

#: Width of a block of the index: a long sequence is shortened block by block, then so many blocks at a time, until one is left.
BLOCK, BLOCKS = 16_384, 64
#: Prefixes that one pass over the sequences extends, about; more are taken in parts.
PREFIXES = 4_000
#: Counters a task holds, numbers it works on at once, and places of sequences that it takes together.
COUNTERS, CELLS, PLACES = 16_000_000, 4_000_000, 40_000
#: Coded items that are broadcast; a longer list is joined by a shuffle.
ITEMS = 8_192


def shorten(codes: np.ndarray, k: int, n_items: int) -> np.ndarray:
    """A shorter sequence with the same subsequences of up to ``k`` items (Simon's congruence).

    The coordinate of a position from the left is the length of the shortest word that is first completed there; a
    position whose coordinates from both sides exceed k + 1 together can go.
    """
    n = len(codes)
    if n <= 2 * k:
        return codes
    listed = codes.tolist()
    left = np.empty(n, np.int64)
    state = np.ones(n_items, np.int64)
    for p, a in enumerate(listed):
        x = state[a]
        left[p] = x
        if x <= k:
            np.minimum(state, x + 1, out=state)
        state[a] = x + 1
    state[:] = 1
    keep = []
    for p in range(n - 1, -1, -1):
        a = listed[p]
        y = state[a]
        if left[p] + y > k + 1:
            continue
        keep.append(p)
        if y <= k:
            np.minimum(state, y + 1, out=state)
        state[a] = y + 1
    return codes[keep[::-1]]


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each owner and each of its entries: (owner, number of the entry)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Lookup:
    """Where items stand in several sequences, for many look-ups at once."""

    def __init__(self, seqs: list[np.ndarray], n_items: int):
        self.length = np.array([len(s) for s in seqs], np.int64)
        flat = np.concatenate(seqs).astype(np.int64)
        seq, at = _spans(self.length)
        self.wide, self.n_items = int(self.length.max()) + 1, n_items
        # (sequence, item, position) in one sorted number
        self.keys = np.sort((seq * n_items + flat) * self.wide + at)
        pair = self.keys // self.wide
        ends = np.flatnonzero(np.append(pair[1:] != pair[:-1], True))
        #: the different items of each sequence and their last positions, sequence by sequence
        self.item, self.last = pair[ends] % n_items, self.keys[ends] % self.wide
        self.own = np.bincount(pair[ends] // n_items, minlength=len(seqs))
        self.first = np.cumsum(self.own) - self.own
        self.seqs = seqs

    def after(self, seq: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first position of an item at or after a place, -1 if none."""
        base = (seq * self.n_items + item) * self.wide
        k = np.minimum(np.searchsorted(self.keys, base + at), len(self.keys) - 1)
        found = self.keys[k] - base
        return np.where((found >= at) & (found < self.wide), found, -1)

    def before(self, seq: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last position of an item before a place; there must be one."""
        base = (seq * self.n_items + item) * self.wide
        return self.keys[np.searchsorted(self.keys, base + at) - 1] - base

    def tables(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first column, columns, start, cells) by runs of columns: cells hold the next place of a sequence's items from each of its places on."""
        width = max(1, int(CELLS // int(self.length.max())))
        for j in range(0, int(self.own.max()), width):
            columns = np.clip(self.own - j, 0, width)
            start = np.cumsum((self.length + 1) * columns) - (self.length + 1) * columns
            cells = np.empty(int(((self.length + 1) * columns).sum()), np.int32)
            for n, s in enumerate(self.seqs):
                if not columns[n]:
                    continue
                own = self.item[self.first[n] + j:self.first[n] + j + columns[n]]
                table = np.full((len(s) + 1, len(own)), self.wide, np.int32)
                c = np.minimum(np.searchsorted(own, s), len(own) - 1)
                hit = np.flatnonzero(own[c] == s)
                table[hit, c[hit]] = hit
                np.minimum.accumulate(table[::-1], axis=0, out=table[::-1])
                cells[start[n]:start[n] + table.size] = table.ravel()
            yield j, columns, start, cells


def _grow(prefixes: list[tuple[int, ...]], n_items: int):
    """Counts of the extensions of each prefix and of the items in its periods, merged within a task.

    Out: (prefix, kind, slot, m).  Kind 0: item ``slot`` can follow in m sequences.  Kinds 1 and 2: in all m sequences of the task that hold
    the prefix, item ``slot`` modulo the number of items stands in the maximum (2: semi-maximum) period number ``slot`` over it.
    """
    depth, n_prefixes = len(prefixes[0]), len(prefixes)
    pattern = np.array(prefixes, np.int64)
    # a trie by levels: the children of a node are consecutive
    nodes, level = [], np.zeros(n_prefixes, np.int64)
    for d in range(depth):
        first = np.flatnonzero(np.concatenate(([True], (pattern[1:, :d + 1] != pattern[:-1, :d + 1]).any(axis=1))))
        parent, items = level[first], pattern[first, d]
        n = np.bincount(parent, minlength=int(level.max()) + 1)
        nodes.append((n, np.cumsum(n) - n, items))
        level = np.searchsorted(first, np.arange(n_prefixes), side="right") - 1

    def matched(look: _Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, prefix, positions) of the leftmost instance of each prefix in each sequence."""
        seq = np.arange(len(look.seqs))
        node, at = np.zeros(len(seq), np.int64), np.full((len(seq), 1), -1, np.int64)
        for n, begin, items in nodes:
            owner, k = _spans(n[node])
            child = begin[node[owner]] + k
            pos = look.after(seq[owner], items[child], at[owner, -1] + 1)
            good = pos >= 0
            owner = owner[good]
            seq, node, at = seq[owner], child[good], np.column_stack([at[owner], pos[good]])
        return seq, node, at[:, 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_prefixes, np.int64)
        counts = np.zeros((1 + 2 * depth, n_prefixes * n_items), np.int64)

        def add(seqs: list[np.ndarray]) -> None:
            look = _Lookup(seqs, n_items)
            every = matched(look)
            seen[:] += np.bincount(every[1], minlength=n_prefixes)
            # so many pairs at a time that the work on their items fits in memory
            size = np.cumsum(look.own[every[0]])
            cuts = np.searchsorted(size, np.arange(CELLS, int(size[-1]) + CELLS, CELLS), side="right") if len(size) else []
            blocks, begin = [], 0
            for end in cuts:
                end = max(int(end), begin + 1)
                if begin < len(size):
                    blocks.append(tuple(x[begin:end] for x in every))
                begin = end
            periods = []
            for seq, prefix, at in blocks:
                owner, k = _spans(look.own[seq])
                entry = look.first[seq[owner]] + k
                more = look.last[entry] > at[owner, -1]
                counts[0] += np.bincount(prefix[owner[more]] * n_items + look.item[entry[more]], minlength=counts.shape[1])
                bounds = []
                for how, end in ((0, look.length[seq]), (1, at[:, -1] + 1)):
                    for d in range(depth - 1, -1, -1):
                        end = look.before(seq, pattern[prefix, d], end)
                        bounds.append((1 + how * depth + d, at[:, d - 1] + 1 if d else np.zeros(len(at), np.int64), end))
                periods.append((seq, prefix, bounds))
            for j, columns, start, cells in look.tables():
                for seq, prefix, bounds in periods:
                    owner, k = _spans(columns[seq])
                    slot = prefix[owner] * n_items + look.item[look.first[seq[owner]] + j + k]
                    for row, lo, hi in bounds:
                        inside = cells[(start[seq] + lo * columns[seq])[owner] + k] < hi[owner]
                        counts[row] += np.bincount(slot[inside], minlength=counts.shape[1])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for s in batch.column(0):
                held.append(s.values.to_numpy(zero_copy_only=False).astype(np.int64))
                size += len(held[-1])
                if size >= PLACES:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        out = []
        for row in range(1 + 2 * depth):
            own = counts[row].reshape(n_prefixes, n_items)
            keep = own > 0 if not row else (own == seen[:, None]) & (seen > 0)[:, None]
            n, item = np.nonzero(keep)
            kind = 0 if not row else 1 + (row - 1) // depth
            out.append((n, np.full(len(n), kind), ((row - 1) % depth * n_items if row else 0) + item, own[n, item]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in range(4)], ["prefix", "kind", "slot", "m"])

    return run


class Patterns:
    """Closed patterns: (pattern array<string>, support long), and how many sequences there are."""

    def __init__(self, closed: DataFrame, n_sequences: int):
        self.closed, self.n_sequences = closed, n_sequences

    def of_length(self, length: int, different: bool = False) -> DataFrame:
        """All frequent patterns of one length with their supports, from the closed ones: the greatest support of a closed pattern that holds them."""

        def parts(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                rows = {(c, int(s)) for p, s in zip(pdf["pattern"], pdf["support"]) if len(p) >= length for c in combinations(list(p), length)}
                yield pd.DataFrame({"pattern": [list(c) for c, _ in rows], "support": [s for _, s in rows]})

        found = self.closed.filter(F.size("pattern") >= length).mapInPandas(parts, "pattern array<string>, support long")
        found = found.groupBy("pattern").agg(F.max("support").alias("support"))
        return found.filter(F.size(F.array_distinct("pattern")) == length) if different else found


def _shortened(k: int, n_items: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([shorten(np.asarray(x, np.int64), k, n_items).astype(np.int32) for x in s])

    return run


def frequent_sequences(events: DataFrame, group: str, index: str, item: Column, min_count: int = 5, min_share: float = 0.08, bound: int = 8) -> Patterns:
    """Closed patterns of items that occur in this order, gaps allowed, in at least ``min_count`` and ``min_share`` of the sequences.

    A sequence is a group's items by index, each (group, index) once (of differing repeats, the least item); null groups, indexes and
    items and empty items are left out.  Groups without items do not count.  Other columns are ignored; an empty table has no patterns.

    Exact: long sequences are shortened by a rule that keeps their subsequences of up to ``bound`` items; if
    frequent patterns reach the bound, it is doubled and the work starts again.
    """
    spark = events.sparkSession
    stage = Stage(spark, "sequences")
    rows = events.select(F.col(group).alias("g"), F.col(index).cast("long").alias("i"), item.alias("item")).filter("g is not null and i is not null and item is not null and item <> ''")
    rows = stage.cut(rows.groupBy("g", "i").agg(F.min("item").alias("item")), "events")
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("support", T.LongType())])
    pairs = rows.select("g", "item").distinct()
    total, least, most = rows.agg(F.countDistinct("g"), F.min("i"), F.max("i")).first()
    need = max(min_count, int(np.ceil(min_share * total - 1e-9)), 1)
    # at most m / min_share items, if a sequence has m different items on average
    top = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).orderBy("item").collect()
    if not top:
        return Patterns(spark.createDataFrame([], schema), total)
    names = [r["item"] for r in top]
    codes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "item string, c int")
    coded = rows.join(F.broadcast(codes) if len(names) <= ITEMS else codes, "item").select("g", "i", "c")
    while True:
        cut = _shortened(bound, len(names))
        blocks = coded.groupBy("g", F.floor(F.col("i") / F.lit(BLOCK)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("s"))
        # most sequences are one short block: they need no Python
        long = F.size("s") > 2 * bound
        blocks = blocks.select("g", "b", F.col("s.c").alias("s"), long.alias("long"))
        blocks = blocks.filter("not long").select("g", "b", "s").unionByName(blocks.filter("long").select("g", "b", cut("s").alias("s")))
        span = (most - least) // BLOCK + 2
        while True:
            last = span <= BLOCKS
            keys = ["g"] if last else ["g", F.floor(F.col("b") / F.lit(BLOCKS)).alias("b")]
            met = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", "s"))).alias("s"), F.count(F.lit(1)).alias("n"))
            kept = ["g"] if last else ["g", "b"]
            met = met.select(*kept, "n", F.flatten("s.s").alias("s"))
            blocks = met.filter("n = 1").select(*kept, "s").unionByName(met.filter("n > 1").select(*kept, cut("s").alias("s")))
            if last:
                break
            span = span // BLOCKS + 2
        whole = blocks.select("s")
        # spread once, before the table: the levels read it without a shuffle
        spread = max(2 * spark.sparkContext.defaultParallelism, total // 20_000)
        sequences = stage.cut(whole.repartition(spread), "sequences", replace=True)
        found = _mine(sequences, stage, [((i,), r["n"]) for i, r in enumerate(top)], len(names), need, bound)
        if found is not None:
            break
        bound *= 2
    stage.drop("events")
    stage.drop("sequences")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[names[x] for x in p] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string())), batch.column(1)], ["pattern", "support"])

    return Patterns(found.mapInArrow(named, schema), total)


def _mine(sequences: DataFrame, stage: Stage, first: list[tuple[tuple[int, ...], int]], n_items: int, need: int, bound: int) -> DataFrame | None:
    """(pattern of codes, n) of the closed patterns, level by level; None if they reach the bound.

    Levels and closed patterns are tables; the driver and the tasks hold the prefixes of one part of a level.
    """
    spark = sequences.sparkSession
    schema = "pattern array<int>, n long"
    known: list | None = sorted(first)
    level, size, depth, closed = None, len(first), 1, []
    while size:
        if depth >= bound:
            return None
        most = max(1, min(PREFIXES, COUNTERS // (n_items * (1 + 2 * depth))))
        parts = -(-size // most)
        if level is None:
            level = spark.createDataFrame([(list(p), n) for p, n in first], schema)
        steps = []
        for k in range(parts):
            if parts > 1 or known is None:
                known = sorted((tuple(r["pattern"]), r["n"]) for r in level.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).collect())
            if known:
                steps.append(stage.cut(_step(sequences, known, n_items, need), "steps"))
            known = None
        after = None
        for s in steps:
            closed.append(s.filter("not open and not pruned").select("pattern", "n"))
            more = s.filter("not pruned").select("pattern", F.explode("next").alias("x")).select(F.concat("pattern", F.array(F.col("x.slot").cast("int"))).alias("pattern"), F.col("x.m").alias("n"))
            after = more if after is None else after.unionByName(more)
        depth += 1
        # a level of one part is looked at once: its rows tell its size
        rows = after.limit(most + 1).collect()
        if len(rows) <= min(most, max(1, min(PREFIXES, COUNTERS // (n_items * (1 + 2 * depth))))):
            known, size = sorted((tuple(r["pattern"]), r["n"]) for r in rows), len(rows)
            level = after
        else:
            level = stage.cut(after, "level")
            size = level.count()
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found


def _step(sequences: DataFrame, part: list[tuple[tuple[int, ...], int]], n_items: int, need: int) -> DataFrame:
    """One row per prefix of a part: (pattern, n, open, pruned, next); open: an item can be added without losing a sequence."""
    numbered = sequences.sparkSession.createDataFrame([(k, list(p), n) for k, (p, n) in enumerate(part)], "prefix long, pattern array<int>, n long").coalesce(1)
    grown = sequences.mapInArrow(_grow([p for p, _ in part], n_items), "prefix long, kind long, slot long, m long")
    # each prefix has a row at least; tasks have merged their counts, so one shuffle serves both aggregates
    grown = grown.unionByName(numbered.select("prefix", F.lit(-1).cast("long").alias("kind"), F.lit(0).cast("long").alias("slot"), F.col("n").alias("m"))).repartition("prefix")
    grown = grown.groupBy("prefix", "kind", "slot").agg(F.sum("m").alias("m")).join(F.broadcast(numbered), "prefix")
    full, kind = F.col("m") == F.col("n"), F.col("kind")
    return grown.groupBy("prefix").agg(
        F.first("pattern").alias("pattern"), F.first("n").alias("n"), F.max(full & kind.isin(0, 1)).alias("open"), F.max(full & (kind == 2)).alias("pruned"),
        F.collect_list(F.when((kind == 0) & (F.col("m") >= need), F.struct("slot", "m"))).alias("next"),
    ).drop("prefix")
