"""Runs, stripes and sequences against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import runs, sequences, stripes


def _runs(rows):
    """(group, first, last) by a plain loop."""
    seen = {}
    for g, i, t, o in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[3] is None, r[3] or 0, r[2] is None, r[2] or "")):
        seen.setdefault((g, i), t)
    out, by = set(), defaultdict(list)
    for (g, i), t in seen.items():
        by[g].append((i, t))
    for g, v in by.items():
        v.sort()
        start = 0
        for k in range(1, len(v) + 1):
            if k == len(v) or not runs.same_event(v[k - 1][1], v[k][1]):
                if k - start > 1:
                    out.add((g, v[start][0], v[k - 1][0]))
                start = k
    return out


@pytest.mark.parametrize("a,b,same", [
    ("print(x)", "print( x )  ", True), ("f('a')", 'f("a");', True), ("f(1) # ok", "f(1)", True), ("f(1)", "f(25.5)", True), ("f(1, 2)", "f(2, 3)", False),
    ("summary(x)", "sumary(x)", True), ("summary(x)", "smmuary(x)", True), ("head(x)", "heda(x)", False), ("View(d)", "nrow(d)", False), ('f("#1")', 'f("#2")', True),
    ("elevation", "elevatoinn", True), ("elevation", "elavatoinn", False), (None, "x", False), ("", "", True), ("x <- 1", "x<-1", True), ("table(x)", "tabel(y)", False),
])
def test_same_event(a, b, same):
    assert runs.same_event(a, b) is same and runs.same_event(b, a) is same


def test_edits_of_long_words():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert runs.edits_within("x" + "ab" * 400 + "y", "z" + "ab" * 400 + "w") and not runs.edits_within("xx" + "ab" * 400 + "y", "zz" + "ab" * 400 + "w")
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        b = "".join(rng.choices("ab", k=rng.randint(0, 9)))
        assert runs.edits_within(a, b) == (distance(a, b) <= 2), (a, b)


def test_runs_against_a_loop(spark):
    rng = random.Random(1)
    texts = ["print(x)", "print( x )", "mean(y)", "mean(yy)", "summary(a)", "sumary(a)", None, "", "f(1)", "f(2)"]
    rows = []
    for g in (0, 1, 2, None):
        i, t = 0, texts[0]
        for _ in range(300 if g == 0 else 40):
            i += rng.choice([1, 1, 1, 5, 9])
            t = t if rng.random() < 0.6 else rng.choice(texts)
            rows += [(g, i, t, 1)] * rng.choice([1, 1, 2])
    rows += [(1, None, "print(x)", 1)] * 2 + [(5, i, "same(x)", 1) for i in range(100, 400, 3)]
    # indexes far sparser than the blocks, below zero too
    rows += [(6, (i - 20) * 997, "same(x)" if i % 7 else "other()", 1) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file_id long, command_index long, command string, loaded_at int").withColumn("entered_at", F.timestamp_seconds("command_index")).withColumn("g", F.lit(1))
    # narrow blocks, so that runs cross many of them
    got = runs.run_bounds(df, block=16)
    assert {tuple(r) for r in got.collect()} == _runs(rows)
    full = {(r["file_id"], r["first_index"]): r for r in runs.collapse_runs(df, block=16).collect()}
    r = full[5, 100]
    assert (r["last_index"], r["n_events"], r["span_seconds"]) == (397, 100, 297.0)
    assert runs.collapse_runs(df.limit(0)).collect() == []


def test_stripes_against_counts(spark):
    rng = random.Random(2)
    names = [f"pkg::f{i}" if i % 3 else f"f{i}" for i in range(12)] + [None, "f1"]
    rows = [(b, 0, rng.choice(names[: 4 + b % 9])) for b in range(400) for _ in range(rng.randint(1, 6))]
    rows += [(None, 0, "f1"), (7, None, "f1")]
    df = spark.createDataFrame(rows + rows[:50], "file_id long, command_index long, function_name string").withColumn("item", F.lit("x"))
    item = stripes.without_package(F.col("function_name"))
    baskets = defaultdict(set)
    for a, b, n in rows:
        if n is not None and a is not None and b is not None:
            baskets[a, b].add(n.split("::")[-1])
    pairs, single = Counter(), Counter()
    for s in baskets.values():
        single.update(s)
        pairs.update(combinations(sorted(s), 2))
    want = {(a, b, n, single[a], single[b], len(baskets)) for (a, b), n in pairs.items() if n >= 5 and n >= 0.01 * len(baskets)}
    got = stripes.cooccurrence(df, ["file_id", "command_index"], item, 5, 0.01, 0.0).collect()
    assert {tuple(r)[:6] for r in got} == want and len(got) == len(want)
    some = stripes.cooccurrence(df, ["file_id", "command_index"], item, 5, 0.01, 2.0).collect()
    assert {tuple(r) for r in some} == {tuple(r) for r in got if r["llr"] >= 2.0 and r["ratio"] > 1} and 0 < len(some) < len(got)
    # stripes of hot items in parts, handed on often
    with pytest.MonkeyPatch.context() as m:
        m.setattr(stripes, "PART_BASKETS", 20)
        m.setattr(stripes, "STRIPE_ENTRIES", 7)
        m.setattr(stripes, "NAMES", 3)
        assert {tuple(r) for r in stripes.cooccurrence(df, ["file_id", "command_index"], item, 5, 0.01, 0.0).collect()} == {tuple(r) for r in got}
    r = max(got, key=lambda r: r["llr"])
    k = np.array([[r["n"], r["n_a"] - r["n"]], [r["n_b"] - r["n"], r["n_baskets"] - r["n_a"] - r["n_b"] + r["n"]]], float)
    e = k.sum(1, keepdims=True) * k.sum(0, keepdims=True) / k.sum()
    assert r["llr"] == pytest.approx(2 * (k[k > 0] * np.log(k[k > 0] / e[k > 0])).sum())
    assert r["ratio"] == pytest.approx(r["n"] * r["n_baskets"] / r["n_a"] / r["n_b"])
    assert stripes.cooccurrence(df.limit(0), ["file_id", "command_index"], item).collect() == []


def test_all_pairs_come_out(spark, tmp_path):
    from statloom.llm import queries

    rng = random.Random(5)
    rows = [(b, 0, k, f"f{n}") for b in range(2000) for k, n in enumerate(rng.sample(range(60), rng.randint(1, 3)))]
    spark.createDataFrame(rows, "file_id long, command_index long, call_order long, function_name string").write.parquet(str(tmp_path / "function_calls.parquet"))
    baskets = defaultdict(set)
    for b, _, _, f in rows:
        baskets[b].add(f)
    want = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    got = {(r["function_a"], r["function_b"]): r["n"] for r in queries.p2_all(spark, str(tmp_path)).collect()}
    assert min(want.values()) < 5 and got == want


def test_stripes_are_handed_on_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(stripes, "STRIPE_ENTRIES", 3)
    basket = pa.array([list("dxacb")] * 3)
    rows = [(a, p, b, n) for batch in stripes._stripes(set("abcd"), {"a": 2, "b": 2})(iter([pa.RecordBatch.from_arrays([basket], ["b"])])) for a, p, bs, ns in zip(*(batch.column(c).to_pylist() for c in range(4))) for b, n in zip(bs, ns)]
    out = Counter()
    for a, _, b, n in rows:
        out[a, b] += n
    assert out == {p: 3 for p in combinations("abcd", 2)} and len({(a, b, p) for a, p, b, _ in rows}) == len(out)
    rows.sort()
    batches = [stripes._rows([(a, p, {b: n})]) for a, p, b, n in rows]
    got = [(x["item_a"], x["item_b"], x["n"]) for batch in stripes._merged(iter(batches)) for x in batch.to_pylist()]
    assert sorted(got) == [(*p, 3) for p in combinations("abcd", 2)]


def _contains(s, p):
    it = iter(s)
    return all(x in it for x in p)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
def test_shortening_keeps_subsequences(s, k):
    short = sequences.shorten(np.array(s, np.int64), k, 4).tolist()
    found = lambda x: {c for n in range(1, k + 1) for c in combinations(x, n)}
    assert found(short) == found(s)
    assert len(short) <= len(s)


def _frequent(seqs, need, most):
    items = sorted({x for s in seqs for x in s})
    out, level = {}, [()]
    for _ in range(most):
        new = {}
        for p in level:
            for x in items:
                n = sum(_contains(s, (*p, x)) for s in seqs)
                if n >= need:
                    new[*p, x] = n
        out.update(new)
        level = list(new)
    return out


@pytest.mark.parametrize("bound,block", [(8, 16384), (2, 7)])
def test_sequences_against_all_patterns(spark, monkeypatch, bound, block):
    monkeypatch.setattr(sequences, "BLOCK", block)
    monkeypatch.setattr(sequences, "BLOCKS", 64 if block > 7 else 4)
    monkeypatch.setattr(sequences, "PREFIXES", 5)
    rng = random.Random(3)
    seqs = [[rng.choice("abcde") for _ in range(rng.choice([3, 5, 8, 30]))] for _ in range(30)]
    rows = [(g, i * 3, "pkg::" + x if i % 2 else x) for g, s in enumerate(seqs) for i, x in enumerate(s)]
    rows += rows[:40] + [(0, 1, None), (1, 1, ""), (None, 1, "a"), (50, None, "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file_id long, command_index long, f string").withColumn("s", F.lit(0))
    found = sequences.frequent_sequences(df, "file_id", "command_index", stripes.without_package(F.col("f")), 20, 0.1, bound)
    want = _frequent(seqs, 20, 9)
    closed = {tuple(r["pattern"]): r["support"] for r in found.closed.collect()}
    is_closed = {p: n for p, n in want.items() if not any(n == m and len(q) == len(p) + 1 and _contains(q, p) for q, m in want.items())}
    assert closed == is_closed and found.n_sequences == 30
    assert {tuple(r["pattern"]): r["support"] for r in found.of_length(3).collect()} == {p: n for p, n in want.items() if len(p) == 3}
    assert {tuple(r["pattern"]) for r in found.of_length(3, different=True).collect()} == {p for p in want if len(p) == 3 and len(set(p)) == 3}


def test_no_sequences(spark):
    df = spark.createDataFrame([], "file_id long, command_index long, f string")
    assert sequences.frequent_sequences(df, "file_id", "command_index", F.col("f")).of_length(3).collect() == []
