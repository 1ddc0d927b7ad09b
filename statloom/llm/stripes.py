"""Problem 2: items that appear together, by stripes and the log-likelihood ratio."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Stage

#: Entries of the stripes that a task merges in memory before it hands them on.
STRIPE_ENTRIES = 400_000
#: Baskets of an item for which its stripe has one part; a hot item's stripe has more, cut by neighbour.
PART_BASKETS = 1_000_000
#: Names of items that tasks are given, at most.
NAMES = 200_000
#: Log-likelihood ratio of pairs that chance alone gives once in 20 times.
SIGNIFICANT = 3.84

def without_package(name: Column) -> Column:
    """The name without ``pkg::`` or ``pkg:::``."""
    return F.regexp_replace(name, r"^[A-Za-z0-9._]+:::?", "")


def _rows(stripes: list[tuple[str, int, dict[str, int]]]) -> pa.RecordBatch:
    neighbours = pa.array([list(x) for _, _, x in stripes], pa.list_(pa.string()))
    counts = pa.array([list(x.values()) for _, _, x in stripes], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in stripes], pa.string()), pa.array([p for _, p, _ in stripes], pa.int64()), neighbours, counts], ["item", "part", "neighbours", "counts"])


_STRIPE = "item string, part long, neighbours array<string>, counts array<long>"


def _stripes(keep: set[str] | None, parts: dict[str, int]):
    """Baskets in, stripes out: per item an associative array of the neighbours after it, merged within the task; ``keep``: only these items count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
        entries = 0
        for batch in batches:
            for basket in batch.column(0).to_pylist():
                basket = sorted(basket if keep is None else keep.intersection(basket))
                for i, a in enumerate(basket[:-1]):
                    n = parts.get(a, 1)
                    for b in basket[i + 1:]:
                        stripe = stripes[a, crc32(b.encode()) % n if n > 1 else 0]
                        entries += b not in stripe
                        stripe[b] = stripe.get(b, 0) + 1
                    if entries >= STRIPE_ENTRIES:
                        yield _rows([(*k, x) for k, x in stripes.items()])
                        stripes.clear()
                        entries = 0
        if stripes:
            yield _rows([(*k, x) for k, x in stripes.items()])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by (item, part) in, pairs out: the arrays of a key are merged by adding their counts."""
    key: tuple | None = None
    stripe: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(stripe), pa.string()), pa.array(list(stripe), pa.string()), pa.array(list(stripe.values()), pa.int64())], ["item_a", "item_b", "n"])  # type: ignore[index]

    for batch in batches:
        for item, part, neighbours, counts in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if (item, part) != key:
                if stripe:
                    yield out()
                key, stripe = (item, part), {}
            for b, n in zip(neighbours, counts):
                stripe[b] = stripe.get(b, 0) + n
    if stripe:
        yield out()


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n: Column, a: Column, b: Column, total: Column) -> Column:
    """Dunning's G2 of the two-by-two table of a pair."""
    n, a, b, total = (x.cast("double") for x in (n, a, b, total))
    cells = _xlogx(n) + _xlogx(a - n) + _xlogx(b - n) + _xlogx(total - a - b + n)
    margins = _xlogx(a) + _xlogx(total - a) + _xlogx(b) + _xlogx(total - b)
    return F.greatest(F.lit(0.0), 2.0 * (cells - margins + _xlogx(total)))


def cooccurrence(events: DataFrame, basket: list[str], item: Column, min_count: int = 5, min_share: float = 0.001, significance: float = SIGNIFICANT) -> DataFrame:
    """Pairs of items in at least ``min_count`` baskets and at least ``min_share`` of all baskets, more often together than by chance.

    Only pairs with a log-likelihood ratio of ``significance`` or more and a ratio over 1 are kept; 0 keeps all.  A pair in n baskets, r times as
    often as by chance, has at least 2 n (ln r - 1 + 1 / r): 8.09 if n and r are 5 or more, so the default loses none of these.

    Result: (item_a, item_b, n, n_a, n_b, n_baskets, ratio, llr), item_a < item_b by code point; ``ratio`` is n over
    what chance would give.  Items count once per basket.  Rows with a null item or null basket key are left out; repeated
    rows, other columns and the row order do not matter; an empty table gives no pairs.

    One shuffle brings baskets together.  Items below the support of a pair cannot be in one, so stripes are built without them (exact).  Stripes are merged within each
    task, then by key: (item, part), where a hot item's stripe is cut into parts by its neighbours, so no task merges an unbounded array.
    """
    spark = events.sparkSession
    stage = Stage(spark, "stripes")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(basket)]
    names = [f"k{i}" for i in range(len(basket))]
    rows = events.select(*keys, item.alias("item")).filter(F.col("item").isNotNull())
    for c in names:
        rows = rows.filter(F.col(c).isNotNull())
    baskets = stage.cut(rows.groupBy(*names).agg(F.collect_set("item").alias("b")), "baskets")
    total = baskets.count()
    need = max(min_count, 1)
    support = baskets.select(F.explode("b").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c")).filter(
        (F.col("c") >= need) & (F.col("c").cast("double") >= F.lit(min_share) * F.lit(float(total)) * (1 - 1e-12))
    )
    support = stage.cut(support, "support")
    # items with the support are at most items per basket / min_share; where a share bounds them so, tasks get their names
    few = min_share > 0 and support.count() <= NAMES
    keep = {r["item"] for r in support.select("item").collect()} if few else None
    hot = support.filter(F.col("c") >= PART_BASKETS).select("item", (F.lit(1) + F.floor(F.col("c") / F.lit(PART_BASKETS))).alias("parts"))
    parts = {r["item"]: int(r["parts"]) for r in hot.collect()}
    stripes = baskets.filter(F.size("b") > 1).select("b").mapInArrow(_stripes(keep, parts), _STRIPE).repartition("item", "part").sortWithinPartitions("item", "part")
    pairs = stripes.mapInArrow(_merged, "item_a string, item_b string, n long")
    pairs = pairs.filter(F.col("n") >= need)
    n_b = support.select(F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    n_a = support.select(F.col("item").alias("item_a"), F.col("c").alias("n_a"))
    pairs = pairs.join(n_a, "item_a").join(n_b, "item_b").withColumn("n_baskets", F.lit(total).cast("long"))
    if min_share > 0:
        pairs = pairs.filter(F.col("n").cast("double") >= F.lit(min_share) * F.col("n_baskets") * (1 - 1e-12))
    chance = F.col("n_a").cast("double") * F.col("n_b") / F.col("n_baskets")
    pairs = pairs.select(
        "item_a", "item_b", "n", "n_a", "n_b", "n_baskets", (F.col("n") / chance).alias("ratio"),
        log_likelihood_ratio(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("n_baskets")).alias("llr"),
    )
    return pairs.filter((F.col("llr") >= significance) & (F.col("ratio") > 1)) if significance > 0 else pairs
