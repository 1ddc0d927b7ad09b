"""The training-data queries and, where SQL can state them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import leakage, mojibake, nearcopies, packing, quality, runs, secrets, sequences, stripes
from statloom.llm.common import Stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_bounds(table(spark, d, "commands"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "commands"))


def _pairs(spark: SparkSession, d: str, **least: float) -> DataFrame:
    calls = table(spark, d, "function_calls")
    return stripes.cooccurrence(calls, ["file_id", "command_index"], stripes.without_package(F.col("function_name")), **least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    exact = [F.col(c).cast("decimal(19,0)") for c in ("n", "n_baskets", "n_a", "n_b")]
    lifted = exact[0] * exact[1] >= F.lit(5).cast("decimal(1,0)") * exact[2] * exact[3]
    return _pairs(spark, d).filter(lifted).select(F.col("item_a").alias("function_a"), F.col("item_b").alias("function_b"))


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("item_a").alias("function_a"), F.col("item_b").alias("function_b"), "n", "n_a", "n_b", "n_baskets",
        F.round("ratio", 6).alias("ratio"), F.round("llr", 4).alias("llr"),
    )


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the support of p2_found, as the SQL states them."""
    return _measured(_pairs(spark, d, significance=0.0))


def p2_all(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of functions that stand in one command, and whether they do so more often than chance gives once in 20 times."""
    pairs = _measured(_pairs(spark, d, min_count=1, min_share=0.0, significance=0.0))
    return pairs.withColumn("significant", (F.col("llr") >= stripes.SIGNIFICANT) & (F.col("ratio") > 1))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(table(spark, d, "documents"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_secrets(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_garbled(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # doc_id is unique in this table
    return nearcopies.NearCopies(table(spark, d, "documents"), threshold=0.6, unique_ids=True).pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, d, "documents"), threshold=0.8, unique_ids=True).groups()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumnRenamed("words", "longest_run")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), how="near").withColumnRenamed("words", "rare_terms")


def _prose(spark: SparkSession, d: str) -> quality.Prose:
    return quality.fit_prose(table(spark, d, "documents"), table(spark, d, "quality_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_prose(table(spark, d, "documents"), _prose(spark, d))


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), _prose(spark, d))


def _patterns(spark: SparkSession, d: str) -> sequences.Patterns:
    return sequences.frequent_sequences(table(spark, d, "commands"), "file_id", "command_index", stripes.without_package(F.col("primary_function")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pattern")
    return _patterns(spark, d).of_length(3, different=True).select(p[0].alias("function_1"), p[1].alias("function_2"), p[2].alias("function_3"))


def p5_closed(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).closed


def p5_supports(spark: SparkSession, d: str) -> DataFrame:
    """The closed patterns as texts."""
    return _patterns(spark, d).closed.select(F.array_join("pattern", " > ").alias("pattern"), "support")


#: Rank file of the tokenizer that sizes are counted with.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents"), RANKS), table(spark, d, "containers"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used by kind, their bound, the gap between them, and the share of their room that is used."""
    return packing.fill(_packed(spark, d))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """By kind: texts packed, containers over their capacity, texts whose pieces do not add up, and texts cut though they fit."""
    sizes = Stage(spark, "sizes").cut(packing.token_counts(table(spark, d, "documents"), RANKS), "tokens")
    packed = packing.pack(sizes, table(spark, d, "containers"))
    packed = Stage(spark, "packed").cut(packed, "rows")
    kind = ["container_kind", "capacity"]
    over = packed.groupBy(*kind, "container_id").agg(F.sum("tokens").alias("t")).groupBy(*kind).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    texts = packed.groupBy(*kind, "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id", "left")
    texts = texts.groupBy(*kind).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("t").eqNullSafe(F.col("tokens"))).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut"),
    )
    return texts.join(over, kind).select("container_kind", "capacity", "texts", "overfull", "lost", "cut")


_P2 = r"""
WITH i AS (SELECT DISTINCT file_id, command_index, regexp_replace(function_name, '^[A-Za-z0-9._]+:::?', '') AS f
           FROM function_calls WHERE function_name IS NOT NULL AND file_id IS NOT NULL AND command_index IS NOT NULL),
t AS (SELECT count(*) AS n_baskets FROM (SELECT DISTINCT file_id, command_index FROM i)),
c AS (SELECT f, count(*) AS c FROM i GROUP BY f),
p AS (SELECT a.f AS function_a, b.f AS function_b, count(*) AS n FROM i a JOIN i b
      ON a.file_id = b.file_id AND a.command_index = b.command_index AND a.f < b.f GROUP BY 1, 2),
q AS (SELECT function_a, function_b, n, x.c AS n_a, y.c AS n_b, n_baskets
      FROM p JOIN c x ON x.f = function_a JOIN c y ON y.f = function_b CROSS JOIN t
      WHERE n >= 5 AND 1000 * n >= n_baskets)
"""

_P5 = r"""
WITH s AS (SELECT file_id AS g, command_index AS i, min(regexp_replace(primary_function, '^[A-Za-z0-9._]+:::?', '')) AS f
           FROM commands WHERE primary_function IS NOT NULL AND primary_function <> '' AND file_id IS NOT NULL AND command_index IS NOT NULL GROUP BY 1, 2),
n AS (SELECT greatest(5, 0.08 * count(DISTINCT g)) AS need FROM s),
o AS (SELECT s.* FROM s JOIN (SELECT f FROM s GROUP BY f HAVING count(DISTINCT g) >= (SELECT need FROM n)) USING (f)),
a AS (SELECT g, f, min(i) AS i, max(i) AS z FROM o GROUP BY g, f),
ab AS (SELECT a.g, a.f AS f1, o.f AS f2, min(o.i) AS i FROM a JOIN o ON a.g = o.g AND o.i > a.i AND o.f <> a.f GROUP BY 1, 2, 3)
SELECT f1 AS function_1, f2 AS function_2, c.f AS function_3 FROM ab JOIN a c ON c.g = ab.g AND c.z > ab.i AND c.f <> f1 AND c.f <> f2
GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT need FROM n)
"""

# patterns grow by the leftmost instance; closed is what no pattern longer by one item equals in support
_P5_SUPPORTS = _P5.partition("a AS (")[0].replace("WITH s AS", "WITH RECURSIVE s AS") + r"""
r AS (SELECT [f] AS pattern, g, min(i) AS e FROM o GROUP BY f, g
      UNION ALL
      SELECT pattern, g, e FROM (SELECT list_append(r.pattern, o.f) AS pattern, r.g AS g, min(o.i) AS e FROM r JOIN o ON o.g = r.g AND o.i > r.e GROUP BY 1, 2)
      QUALIFY count(*) OVER (PARTITION BY pattern) >= (SELECT need FROM n)),
c AS (SELECT pattern, count(*) AS support FROM r GROUP BY 1),
b AS (SELECT DISTINCT list_concat(pattern[1:k - 1], pattern[k + 1:]) AS pattern, support FROM (SELECT pattern, support, unnest(range(1, len(pattern) + 1)) AS k FROM c WHERE len(pattern) > 1))
SELECT array_to_string(pattern, ' > ') AS pattern, support FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pattern = c.pattern AND b.support = c.support)
"""

_P6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.6 * (a.n + b.n - shared)
"""

_P8 = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (s)
"""

_P8_NEAR = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
it AS (SELECT DISTINCT item_id, unnest(w) AS t FROM i),
dw AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d) WHERE t IN (SELECT t FROM it)),
c AS (SELECT t, count(DISTINCT doc_id) AS n FROM dw GROUP BY t),
k AS (SELECT item_id, count(*) AS terms FROM it GROUP BY 1),
r AS (SELECT item_id, t FROM (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS place FROM it JOIN c USING (t)) WHERE place <= 8),
h AS (SELECT doc_id, item_id, p, t FROM dw JOIN r USING (t)),
s AS (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.t) AS n FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p - 63 AND a.p GROUP BY 1, 2, 3)
SELECT doc_id, item_id, max(n) AS rare_terms FROM s JOIN k USING (item_id) WHERE n >= least(6, terms) GROUP BY 1, 2
"""

# the longest run: windows of the document and the item on one diagonal, without a gap
_P8_RUNS = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT item_id, k AS q, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
dg AS (SELECT doc_id, k AS p, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT doc_id, item_id, p - q AS diagonal, p FROM dg JOIN ig USING (s)),
g AS (SELECT doc_id, item_id, diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM m),
n AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM g GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, max(n) AS longest_run FROM n GROUP BY 1, 2
"""

# connected parts of the links between classes of equal sets, by the least document
_P6_GROUPS = _P6.partition("SELECT x AS doc_id_a")[0].replace("WITH w AS", "WITH RECURSIVE w AS").rstrip() + r""",
cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id FROM (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS f FROM s GROUP BY 1)),
l AS (SELECT x AS a, y AS b FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y JOIN cl u ON u.doc_id = x AND u.class_id = x JOIN cl v ON v.doc_id = y AND v.class_id = y WHERE shared >= 0.8 * (a.n + b.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT class_id AS a, class_id AS b FROM cl UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a, min(b) AS group_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM cl JOIN g ON g.a = class_id LEFT JOIN k ON k.a = class_id
"""

_L = "CASE WHEN {0} > 0 THEN ({0})::DOUBLE * ln(({0})::DOUBLE) ELSE 0 END"


def _xlx(x: str) -> str:
    return "(" + _L.format(f"({x})") + ")"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    llr = (
        f"2 * ({_xlx('n')} + {_xlx('n_a - n')} + {_xlx('n_b - n')} + {_xlx('n_baskets - n_a - n_b + n')}"
        f" - {_xlx('n_a')} - {_xlx('n_baskets - n_a')} - {_xlx('n_b')} - {_xlx('n_baskets - n_b')} + {_xlx('n_baskets')})"
    )
    measured = (
        "SELECT function_a, function_b, n, n_a, n_b, n_baskets, round(n::DOUBLE / (n_a::DOUBLE * n_b / n_baskets), 6) AS ratio, "
        f"round(greatest(0, {llr}), 4) AS llr FROM q"
    )
    every = _P2.replace("WHERE n >= 5 AND 1000 * n >= n_baskets)", ")")
    return {
        "p2_all": f"{every} SELECT *, llr >= 3.84 AND ratio > 1 AS significant FROM ({measured})",
        "p5_found": _P5,
        "p5_supports": _P5_SUPPORTS,
        # what any right packing gives
        "p7_valid": "SELECT container_kind, capacity, n AS texts, 0::BIGINT AS overfull, 0::BIGINT AS lost, 0::BIGINT AS cut FROM (SELECT container_kind, min(capacity_tokens) AS capacity FROM containers "
        "WHERE capacity_tokens > 0 AND container_kind IS NOT NULL GROUP BY 1), (SELECT count(*) AS n FROM documents)",
        "p6_found": _P6,
        "p8_found": _P8,
        "p8_near": _P8_NEAR,
        "p8_runs": _P8_RUNS,
        "p6_groups": _P6_GROUPS,
        "p2_found": _P2 + "SELECT function_a, function_b FROM q WHERE n * n_baskets >= 5 * n_a * n_b",
        "p2_pairs": _P2
        + "SELECT function_a, function_b, n, n_a, n_b, n_baskets, round(n::DOUBLE / (n_a::DOUBLE * n_b / n_baskets), 6) AS ratio, "
        + f"round(greatest(0, {llr}), 4) AS llr FROM q",
    }
