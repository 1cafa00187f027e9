"""Mixing sources to target weights.

Words are summed per source (partial sums before the shuffle, so a hot source is no single task's work). Sources in code point order, null last, weigh
3, 1, 2, repeating. They share `share` times all words by weight; a target stops at `most` times its source's words and the excess is shared again by
weight among the others until none is above. That fixed point is a water level: sorted by capacity over weight, the sources below the level are full and
the others get level x weight. The repetition rate is target / words; each document is emitted floor(rate) times, and once more if a number that
depends on the seed and its doc_id alone falls below the fraction. Everything is DataFrame or SQL functions.

Defined cases: a null text has no words; a source without words has target 0 and its documents are not taken; null doc_ids share one draw and so do
repeated rows; an empty table gives an empty result; other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, small, table, uniform, written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17

_SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target, rate; one row per source, so the windows below see no documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    rising = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns({
        "full": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "all": F.sum("source_size").over(everything),
    })
    level = (F.col("all") * share - F.col("full")) / F.col("open")
    per = per.withColumn("level", F.max(F.when(level * F.col("w") <= cap, level)).over(everything))
    target = F.coalesce(F.least(F.col("level") * F.col("w"), cap.cast("double")), cap.cast("double"))
    per = per.select("source", "source_size", target.alias("target"))
    return per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_rates(rows: DataFrame, per: DataFrame, source: str) -> DataFrame:
    """Joins on the source: by broadcast if the written table of sources is small, else with each source's row repeated for salts, so that a hot source spreads."""
    per = per.withColumnRenamed("source", "__source")
    if (hinted := small(per)) is not per:
        return rows.join(hinted, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    per = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("__own", F.pmod(F.xxhash64("doc_id", "size"), F.lit(_SALTS)).cast("int"))
    return rows.join(per, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt")), "left").drop("__source", "__own", "__salt")


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + (uniform(doc_id, seed) < rate - whole).cast("long")).cast("long")


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sizes = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    rows = _with_rates(sizes, written(rates(sizes.select("source", "size")), "rates"), "source")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    per = written(rates(docs.select("source", words(F.col("text")).alias("size"))), "rates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source").alias("__from"), F.length("text").alias("size"))
    rows = _with_rates(rows, per.drop("source_size"), "__from")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.lit(MOST))).alias("n"), copies(F.col("rate"), F.col("doc_id"), seed).alias("c")).where("n <= c").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
q AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM p),
r AS (SELECT *, CAST(coalesce(sum(2 * source_size) OVER b, 0) AS BIGINT) AS filled, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS rest,
             CAST(sum(source_size) OVER () AS BIGINT) AS total
      FROM q WINDOW b AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(filled AS DOUBLE)) / rest AS level FROM r),
t AS (SELECT *, max(CASE WHEN level * w <= 2 * source_size THEN level END) OVER () AS water FROM s),
u AS (SELECT source, source_size, coalesce(least(water * w, CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target FROM t),
v AS (SELECT d.doc_id, d.size, u.source_size, u.target, CASE WHEN u.source_size > 0 THEN u.target / u.source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                            < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM v
"""
