"""Problem 6: near-duplicate texts, by a self join of binary tries over min-hash bits.

Each text gives its set of sequences of five words, a signature of min-hash bits, and min-hash band keys.  Texts that share a
band key form a block; within a block the signatures stand in a binary trie, pairs of nodes are walked
together with the count of differing bits, and a pair of nodes is left as soon as the count exceeds the budget.
The pairs that stay are decided by their exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Stage, texts_of, word_hashes

WORDS = 5
BITS = 128
#: Bands of ROWS min-hash values: a pair of similarity 0.6 shares none of them with probability 0.0004, one of 0.8 with 1e-10.
BANDS, ROWS = 32, 3
#: Differing bits allowed: a pair of similarity 0.6 differs in 25.6 of 128 (s.d. 4.5), so it exceeds 45 with probability 1e-5.
BUDGET = 45
#: Rows of a block that one task joins; larger blocks are cut into pieces that are joined pairwise.
BLOCK_ROWS = 16_384
#: Documents of a class of equal texts that meet those of another, or of the same, in one task.
PIECE = 4_000
#: Node pairs that are expanded at once.
FRONTIER = 1_000_000

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 2**32, BITS, dtype=np.uint32) | np.uint32(1))
_B = _rng.integers(0, 2**32, BITS, dtype=np.uint32)
_M = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, WORDS + 4, dtype=np.uint64)]
_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def shingles(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its sequences of ``n`` consecutive words."""
    for h in word_hashes(texts):
        m = len(h) - n + 1
        if m < 1:
            yield np.empty(0, np.uint64)
            continue
        mixed = h[:m] * _M[0]
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _M[k] + h[k:k + m]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _M[WORDS]
        mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        yield mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash values, one row of BITS per non-empty set."""
    out = np.empty((len(sets), BITS), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 16_384):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to]).astype(np.uint32)
        offsets = np.cumsum([0] + [len(s) for s in sets[at:to - 1]])
        step = max(1, 262_144 // max(1, size))
        for k in range(0, BITS, step):
            out[at:to, k:k + step] = np.minimum.reduceat(x[None, :] * _A[k:k + step, None] + _B[k:k + step, None], offsets, axis=1).T
        at = to
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "k1", "k2", "sig", "bands"]
    for batch in batches:
        ids, sets = [], []
        for i, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1).to_pylist())):
            if len(s):
                ids.append(i)
                sets.append(s)
        if not ids:
            continue
        values = signatures(sets)
        bits = np.packbits(((values * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint8), axis=1)
        cols = values[:, :BANDS * ROWS].astype(np.uint64).reshape(len(ids), BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _M[WORDS + 1]
        keys = np.repeat(keys, len(ids), axis=0)
        for r in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(31))) * _M[WORDS + 2] + cols[:, :, r]
        keys = (keys ^ (keys >> np.uint64(32))) * _M[WORDS + 3]
        k1 = np.array([int(s.sum()) & (2**64 - 1) for s in sets], np.uint64)
        k2 = np.array([int((s * _M[0] ^ (s >> np.uint64(17))).sum()) & (2**64 - 1) for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                pa.array([b.tobytes() for b in bits], pa.binary()), pa.ListArray.from_arrays(np.arange(0, len(ids) * BANDS + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel()),
            ],
            names,
        )


def _cross(n_u: np.ndarray, n_v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sizes all (pair, i, j)."""
    n = n_u * n_v
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pair, k // n_v[pair], k % n_v[pair]


def trie_join(block: np.ndarray, sig: np.ndarray, budget: int = BUDGET, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of the same block whose signatures differ in at most ``budget`` bits.

    ``sig`` holds one row of bytes per text.  The trie is binary; eight levels are taken per step, and a node is a range of
    the sorted rows.  With ``side``, only pairs of rows of different sides count.
    """
    if len(block) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = sig.shape[1]
    order = np.lexsort([sig[:, c] for c in range(width - 1, -1, -1)] + [block])
    b, s = block[order], sig[order]
    change = np.concatenate(([True], b[1:] != b[:-1]))
    first = [np.flatnonzero(change)]  # rows at which the nodes of a depth begin
    for d in range(width):
        change = change | np.concatenate(([True], s[1:, d] != s[:-1, d]))
        first.append(np.flatnonzero(change))
    first.append(np.arange(len(b)))
    found_i, found_j = [], []
    top = np.arange(len(first[0]))
    size = np.diff(np.append(first[0], len(b)))
    top = top[size > 1]
    todo = [(0, top, top, np.zeros(len(top), np.int16))]
    while todo:
        d, u, v, err = todo.pop()
        # children of a node: the nodes of the next depth that begin inside it
        starts = np.searchsorted(first[d + 1], first[d])
        n_children = np.diff(np.append(starts, len(first[d + 1])))
        n = n_children[u] * n_children[v]
        if n.sum() > FRONTIER and len(u) > 1:
            half = len(u) // 2
            todo += [(d, u[:half], v[:half], err[:half]), (d, u[half:], v[half:], err[half:])]
            continue
        pair, i, j = _cross(n_children[u], n_children[v])
        cu, cv, e = starts[u][pair] + i, starts[v][pair] + j, err[pair]
        keep = cu <= cv
        if d == width:
            keep = cu < cv
            found_i.append(cu[keep])
            found_j.append(cv[keep])
            continue
        cu, cv, e = cu[keep], cv[keep], e[keep]
        rows = first[d + 1]
        e = e + _POP[s[rows[cu], d] ^ s[rows[cv], d]]
        keep = e <= budget
        if keep.any():
            todo.append((d + 1, cu[keep], cv[keep], e[keep]))
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = order[np.concatenate(found_i)], order[np.concatenate(found_j)]
    if side is not None:
        keep = side[i] != side[j]
        i, j = i[keep], j[keep]
    return i, j


def _block_join(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted (key, side, id, sig) in; (a, b, key, rows) out: a pair, or the key of a block that is too large and its rows.

    ``whole``: blocks of any size are joined.
    """
    held: list[tuple] = []
    hot_key, hot_rows = None, 0

    def join(parts: list[tuple]) -> pa.RecordBatch:
        key, side, ids, sig = (np.concatenate([p[c] for p in parts]) for c in range(4))
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[number] > 1
        number, side, ids, sig = number[keep], side[keep], ids[keep], sig[keep]
        i, j = trie_join(number, sig, side=None if (side < 0).all() else side)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.empty((0, 2), np.int64)
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["a", "b", "key", "rows"])

    def hot() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([hot_key], pa.int64()), pa.array([hot_rows], pa.int64())], ["a", "b", "key", "rows"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        side = batch.column(1).to_numpy(zero_copy_only=False)
        ids = batch.column(2).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
        if hot_key is not None:
            n = int(np.searchsorted(key != hot_key, True)) if (key != hot_key).any() else len(key)
            hot_rows += n
            if n == len(key):
                continue
            yield hot()
            hot_key = None
            key, side, ids, sig = key[n:], side[n:], ids[n:], sig[n:]
        # whole blocks are joined, the last one may go on in the next batch
        last = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
        if last or held and held[-1][0][-1] != key[0]:
            held.append((key[:last], side[:last], ids[:last], sig[:last]))
            full = [p for p in held if len(p[0])]
            if full:
                # a block that ran over several batches may have grown too large only together
                yield join(full)
            held = []
        held.append((key[last:], side[last:], ids[last:], sig[last:]))
        if not whole and sum(len(p[0]) for p in held) > BLOCK_ROWS:
            hot_key, hot_rows = int(held[-1][0][0]), sum(len(p[0]) for p in held)
            held = []
    if hot_key is not None:
        yield hot()
    full = [p for p in held if len(p[0])]
    if full:
        yield join(full)


_OUT = "a long, b long, key long, rows long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) in; the rows whose key another row has out."""
    key, ids, paired = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        # the last row waits for its successor
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
        same = key[1:] == key[:-1]
        keep = same | np.concatenate(([paired], same[:-1])) if len(same) else same
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(ids[:-1][keep])], ["key", "id"])
        key, ids, paired = key[-1:], ids[-1:], bool(same[-1]) if len(same) else paired
    if paired:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], ["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingles(batch.column(1).to_pylist())]
        offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "set"])


class NearCopies:
    """Near copies of a table of texts.

    A text counts once per id (of a repeated id, the smallest text); null ids, null texts and texts under five words are in no pair.
    Texts with the same set of sequences form a class with its least id as representative; only representatives
    are joined.  Very long texts are used whole; other columns are ignored; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, threshold: float = 0.8, doc: str = "doc_id", text: str = "text", unique_ids: bool = False):
        spark = docs.sparkSession
        self.stage, self.threshold = Stage(spark, "copies"), threshold
        rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null")
        self.rows = rows if unique_ids else rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        feats = self.stage.cut(self.rows.mapInArrow(_features, "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>"), "features")
        classes = feats.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        member = feats.select("doc_id", "k1", "k2", "n").join(classes, ["k1", "k2", "n"]).select("doc_id", "rep", "n", "copies")
        #: (doc_id, rep, n, copies)
        self.member = self.stage.cut(member, "member")
        reps = feats.join(self.member.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sig", "bands")
        self.links = self._verified(self._candidates(reps))
        # what follows needs only the members and the links
        for label in ("features", "keys", "joined", "pieces", "candidates", "sets"):
            self.stage.drop(label)

    def _candidates(self, reps: DataFrame) -> DataFrame:
        # most keys occur once: keys travel with ids only, and those that two texts share get their signatures
        keys = reps.select(F.explode("bands").alias("key"), "id").repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long")
        rows = self.stage.cut(keys, "keys").join(reps.select("id", "sig"), "id").select("key", F.lit(-1).cast("long").alias("side"), "id", "sig")
        out = self.stage.cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_block_join, _OUT), "joined")
        pairs = out.filter("a is not null").select("a", "b")
        hot = out.filter("key is not null").select("key", F.ceil(F.col("rows") / (BLOCK_ROWS // 2)).alias("pieces"))
        if not hot.isEmpty():
            # blocks too large for a task: every two pieces of a block are joined on their own
            cut = rows.drop("side").join(hot, "key").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces"))
            cut = cut.select("key", "piece", "id", "sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
            cut = cut.select(
                F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"),
                F.when(F.col("piece") == F.col("other"), F.lit(-1).cast("long") - F.col("id")).otherwise(F.col("piece")).alias("side"), "id", "sig",
            )
            more = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_pieces_join, "a long, b long")
            pairs = pairs.unionByName(self.stage.cut(more, "pieces"))
        return self.stage.cut(pairs.distinct(), "candidates")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = self.stage.cut(self.rows.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set array<long>"), "sets")
        x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
        both = F.size(F.array_intersect("x", "y")).cast("double")
        scored = pairs.join(x, "a").join(y, "b").withColumn("both", both)
        scored = scored.select("a", "b", (F.col("both") / (F.size("x") + F.size("y") - F.col("both"))).alias("similarity"))
        return self.stage.cut(scored.filter(F.col("similarity") >= self.threshold - 1e-12), "links")

    def pairs(self) -> DataFrame:
        """All pairs of documents (doc_id_a < doc_id_b), copies of one class included: as many rows as there are such pairs."""
        # large classes are cut into pieces, and every two pieces that belong together meet on their own
        pieces = F.ceil(F.col("copies") / PIECE)
        m = self.member.select("doc_id", "rep", "copies", pieces.alias("pieces"), F.pmod(F.xxhash64("doc_id"), pieces).alias("piece"))
        cuts = self.member.filter("doc_id = rep").select("rep", F.sequence(F.lit(0).cast("long"), pieces - 1).alias("cuts"))
        links = self.links.select("a", "b").join(cuts.withColumnsRenamed({"rep": "a", "cuts": "ca"}), "a").join(cuts.withColumnsRenamed({"rep": "b", "cuts": "cb"}), "b")
        links = links.select("a", "b", F.explode("ca").alias("pa"), "cb").select("a", "b", "pa", F.explode("cb").alias("pb"))
        left = m.select(F.col("rep").alias("a"), F.col("piece").alias("pa"), F.col("doc_id").alias("x"))
        right = m.select(F.col("rep").alias("b"), F.col("piece").alias("pb"), F.col("doc_id").alias("y"))
        between = links.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("x", "y")
        many = m.filter("copies > 1")
        left = many.select("rep", F.col("piece").alias("p"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("q"), F.col("doc_id").alias("x"))
        right = many.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), "piece")).alias("p"), F.col("piece").alias("q"), F.col("doc_id").alias("y"))
        inside = left.join(right, ["rep", "p", "q"]).filter("p < q or x < y").select("x", "y")
        both = between.unionByName(inside)
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def groups(self) -> DataFrame:
        """(doc_id, class_id, group_id, n_links) of every document with words: its class, its group, and the links of its class to others.

        Groups are the connected parts of the links between classes: least label with pointer jumping, a table per round.
        """
        edges = self.stage.cut(self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        label = self.stage.cut(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
        while True:
            near = edges.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
            step = label.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l"))
            jump = step.join(label.select(F.col("a").alias("l"), F.col("l").alias("ll")), "l", "left")
            new = self.stage.cut(jump.select("a", "old", F.least("l", F.coalesce("ll", "l")).alias("l")), "labels", replace=True)
            label = new.select("a", "l")
            if new.filter("old <> l").isEmpty():
                break
        degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).join(label, "a").withColumnRenamed("a", "rep")
        return self.member.select("doc_id", "rep").join(degree, "rep", "left").select(
            "doc_id", F.col("rep").alias("class_id"), F.coalesce("l", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )


def _pieces_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two pieces of a block have about BLOCK_ROWS rows together; by the spread of the hash some have more, and are joined as well."""
    for batch in _block_join(batches, whole=True):
        if batch.column(0).null_count:
            raise AssertionError("a piece of a block has not been joined")
        yield batch.select(["a", "b"])
