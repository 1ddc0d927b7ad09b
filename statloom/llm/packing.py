"""Problem 7: filling containers of fixed capacity with texts, certified by lower bounds.

Texts are packed by best-fit decreasing in partitions of bounded size.  Dual feasible functions give a lower bound of the
containers each partition needs; partitions that meet it are done, the others pool the texts of their unfilled containers, exchange them and
pack again.
"""

from __future__ import annotations

import base64
import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Stage, texts_of

#: Items of a partition, about.
PARTITION = 20_000
#: Rounds of exchange, at most; what they leave open shows in the certificate.
ROUNDS = 3
#: The split pattern of the byte-level vocabularies, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file (base64 token, rank); one per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: str | None, path: str) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_counts(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have none.  The rank file goes with the job to other machines."""
    context = docs.sparkSession.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        context.addFile(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count_tokens(t, own) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    return texts_of(docs, doc, text).mapInArrow(counted, "doc_id long, tokens long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, containers): each item, largest first, goes where it leaves least room."""
    place = np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    rooms: list[int] = []
    n = 0
    order = np.argsort(-sizes, kind="stable").tolist()
    listed = sizes.tolist()
    for k in order:
        s = listed[k]
        i = bisect_left(rooms, s)
        if i < len(rooms):
            room = rooms[i]
            stack = free[room]
            b = stack.pop()
            if not stack:
                del rooms[i], free[room]
        else:
            b, room = n, capacity
            n += 1
        place[k] = b
        room -= s
        if room in free:
            free[room].append(b)
        else:
            free[room] = [b]
            insort(rooms, room)
    return place, n


def lower_bound(sizes: np.ndarray, capacity: int, n: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of the volume and two families of dual feasible functions.

    With ``n``, so many items have each size.
    """
    if not len(sizes):
        return 0
    keep = sizes > 0
    s, first = np.unique(sizes[keep], return_inverse=True)
    n = np.bincount(first, weights=None if n is None else n[keep]).astype(np.int64)
    if not len(s):
        return 1
    best = -(-int((s * n).sum()) // capacity)
    # over capacity - a counts whole, under a counts nothing
    cuts = s[s <= capacity // 2]
    total, number = np.concatenate(([0], np.cumsum(s * n))), np.concatenate(([0], np.cumsum(n)))
    if len(cuts):
        low = np.searchsorted(s, cuts, side="left")
        high = np.searchsorted(s, capacity - cuts, side="right")
        volume = total[high] - total[low] + (number[-1] - number[high]) * capacity
        best = max(best, int((-(-volume // capacity)).max()))
    best = max(best, int(n[2 * s > capacity].sum()))
    # rounding by a factor k: x (k + 1) / C where that is whole, else its floor over k
    for k in range(1, 30):
        scaled = s * (k + 1)
        exact = scaled % capacity == 0
        value = float((s[exact] * n[exact]).sum() / capacity + (scaled[~exact] // capacity * n[~exact]).sum() / k)
        best = max(best, int(np.ceil(value - 1e-9)))
    return best


_STATE = "container_kind string, capacity long, doc_id long, r long, piece int, tokens long, part long, bin long, fill long, bins long, least long"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["tokens", "r", "piece"], ascending=[False, True, True], kind="stable")
    sizes = pdf["tokens"].to_numpy(np.int64)
    place, n = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(place, weights=sizes, minlength=n).astype(np.int64)
    return pdf.assign(bin=place, fill=fill[place], bins=n, least=lower_bound(sizes, capacity))


def pack(sizes: DataFrame, containers: DataFrame, doc: str = "doc_id", tokens: str = "tokens", rounds: int = ROUNDS, partition: int = PARTITION) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens, capacity, containers, bound): the container of every text, for each kind of container.

    ``containers`` and ``bound`` are the certificate: so many containers hold the partition the text was packed in, and no packing of it needs
    fewer than ``bound``.  Exchange ends when no kind gains by it, or after ``rounds``.

    A text over the capacity is cut into full pieces, which have containers of their own, and a rest, which is packed like a text (piece
    numbers from 0); all others are whole (piece 0).  Rows with a null id or repeated ids are texts of their own; a null or negative size
    counts as 0; texts of size 0 have a place too.  Kinds with a null or non-positive capacity are left out; a repeated kind counts once,
    with its least capacity; any number of kinds is packed.  No texts, no rows.
    """
    spark = sizes.sparkSession
    stage = Stage(spark, "packing")
    items = sizes.select(F.col(doc).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    items = stage.cut(items.withColumn("r", F.monotonically_increasing_id()), "sizes")
    kinds = containers.filter("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.min(F.col("capacity_tokens").cast("long")).alias("capacity"))
    # the result has a row for every text and kind, so there are few kinds; one literal holds them
    listed = json.dumps([{"container_kind": x["container_kind"], "capacity": x["capacity"]} for x in kinds.orderBy("container_kind").collect()])
    kind = F.explode(F.from_json(F.lit(listed), "array<struct<container_kind:string,capacity:long>>")).alias("k")
    each = items.select("doc_id", "r", "tokens", kind).select("k.container_kind", "k.capacity", "doc_id", "r", "tokens")
    over = each.filter("tokens > capacity").select("*", F.floor(F.col("tokens") / F.col("capacity")).alias("whole"))
    full = over.select("container_kind", "capacity", "doc_id", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    rest = over.filter("tokens > whole * capacity").select("container_kind", "capacity", "doc_id", "r", F.col("whole").cast("int").alias("piece"), (F.col("tokens") - F.col("whole") * F.col("capacity")).alias("tokens"))
    loose = each.filter("tokens <= capacity").select("container_kind", "capacity", "doc_id", "r", F.lit(0).alias("piece"), "tokens").unionByName(rest)
    count = items.count()
    parts = max(1, -(-count // partition))
    empty = [F.lit(0).cast("long").alias(c) for c in ("bin", "fill", "bins", "least")]

    def packed(rows: DataFrame, n: int, turn: int) -> DataFrame:
        part = F.pmod(F.xxhash64("r", "piece", F.lit(turn)), F.lit(n)).cast("long").alias("part")
        rows = rows.select("container_kind", "capacity", "doc_id", "r", "piece", "tokens", part, *empty)
        return rows.groupBy("container_kind", "part").applyInPandas(_pack, _STATE).withColumn("turn", F.lit(turn))

    state = stage.cut(packed(loose, parts, 0), "packed")
    done = []
    for turn in range(1, rounds + 1):
        # partitions with a gap open their unfilled containers; all else is final
        opened = (F.col("bins") > F.col("least")) & (F.col("fill") < F.col("capacity"))
        again = state.filter(opened)
        n = again.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part", "bin").alias("before"))
        n = {x["container_kind"]: (x["n"], x["before"]) for x in n.collect()}
        if not n:
            break
        pooled = max(1, -(-max(x[0] for x in n.values()) // partition))
        fresh = stage.cut(packed(again, pooled, turn), "packed")
        after = {x["container_kind"]: x["n"] for x in fresh.groupBy("container_kind").agg(F.countDistinct("part", "bin").alias("n")).collect()}
        better = [k for k, (_, before) in n.items() if after[k] < before]
        done.append(state.filter(~(opened & F.col("container_kind").isin(better)) if better else F.lit(True)))
        if not better:
            state = None
            break
        state = fresh.filter(F.col("container_kind").isin(better))
    if state is not None:
        done.append(state)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    # names cannot overflow, whatever the numbers of partitions and pieces
    name = F.concat_ws("-", "turn", "part", "bin").alias("container_id")
    rows = rows.select("container_kind", name, "doc_id", "piece", "tokens", "capacity", F.col("bins").alias("containers"), F.col("least").alias("bound"))
    name = F.concat_ws("-", F.lit("full"), "r", "piece").alias("container_id")
    one = F.lit(1).cast("long")
    return rows.unionByName(full.select("container_kind", name, "doc_id", "piece", F.col("capacity").alias("tokens"), "capacity", one.alias("containers"), one.alias("bound")))


def fill(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity, n_containers, bound, gap, fill, fullest) of a packing.

    ``bound``: containers that any packing of all texts of the kind needs, if full pieces are alone: by the dual feasible functions over the counts of
    sizes (as many rows as there are sizes up to the capacity); ``gap``: containers over the bound; ``fill``: the share of their room that is used.
    """
    each = packed.groupBy("container_kind", "container_id", "capacity").agg(F.sum("tokens").alias("tokens"))
    used = each.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.max("tokens").alias("fullest"), F.sum("tokens").alias("tokens"))
    counts = packed.groupBy("container_kind", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n"))
    schema = "container_kind string, bound long"

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        return pd.DataFrame({"container_kind": pdf["container_kind"].iloc[:1], "bound": [lower_bound(pdf["tokens"].to_numpy(np.int64), capacity, pdf["n"].to_numpy(np.int64))]})

    bound = counts.groupBy("container_kind").applyInPandas(bounded, schema)
    return used.join(bound, "container_kind").select(
        "container_kind", "capacity", "n_containers", "bound", (F.col("n_containers") - F.col("bound")).alias("gap"), (F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"), "fullest",
    )
