"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's frequent-items sketch, `approx_top_k`) names at most `winners` candidates. They are recounted exactly,
and the verified ones (digest, smallest doc_id, count) are broadcast: rows of heavy groups are settled where they are read and never meet in one task.
The remaining digests, none of which is frequent, take an ordinary shuffle. Everything is DataFrame or SQL functions.

Defined cases: a null text counts as empty; an empty table gives an empty result; null doc_ids sort last, so that such a row stays only if its group has
no other; of repeated rows that share the smallest doc_id exactly one stays; other columns, whatever their names, are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, table, written

#: Rows of the broadcast table at most, and counters of the summary: a digest held by more than about 1 in 4,000 rows can't be missed.
WINNERS, COUNTERS = 1024, 16384

_DIGEST, _ID, _KEEP, _SIZE, _FIRST = "__digest", "__id", "__keep", "__size", "__first"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias(_ID), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias(_DIGEST))


def winners(rows: DataFrame, most: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """The verified heavy digests of `rows`: digest, smallest doc_id and exact count; `most` rows at most."""
    seen = rows.select(F.hex(_DIGEST).alias("d")).agg(F.expr(f"approx_top_k(d, {most}, {counters})").alias("top"))
    likely = seen.select(F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias(_DIGEST))
    exact = rows.join(F.broadcast(likely), _DIGEST).groupBy(_DIGEST).agg(F.min(_ID).alias(_KEEP), F.count(F.lit(1)).alias(_SIZE))
    return exact.where(F.col(_SIZE) > 1)


def _split(rows: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = rows.join(F.broadcast(heavy), _DIGEST, "left")
    return marked.where(F.col(_SIZE).isNotNull()), marked.where(F.col(_SIZE).isNull())


def _one(rows: DataFrame) -> DataFrame:
    """Adds whether a row is the first of its digest."""
    order = Window.partitionBy(_DIGEST).orderBy(F.col(_ID).asc_nulls_last())
    return rows.withColumn(_FIRST, F.row_number().over(order) == 1)


def groups(rows: DataFrame) -> DataFrame:
    """rows of digests(): per row keep_id, group_size and kept, with the digest in hexadecimal."""
    heavy, rest = _split(rows, written(winners(rows), "winners"))
    least = F.col(_ID).eqNullSafe(F.col(_KEEP))
    whole = Window.partitionBy(_DIGEST)
    rest = rest.withColumns({_KEEP: F.min(_ID).over(whole), _SIZE: F.count(F.lit(1)).over(whole)})
    out = _one(rest).unionByName(_one(heavy.where(least))).unionByName(heavy.where(~least).withColumn(_FIRST, F.lit(False)))
    return out.select(
        F.col(_ID).alias("doc_id"),
        F.col(_KEEP).alias("keep_id"),
        F.col(_SIZE).cast("long").alias("group_size"),
        F.col(_FIRST).alias("kept"),
        F.lower(F.hex(_DIGEST)).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a row with a smaller doc_id; all columns stay. Losers of heavy groups go before the shuffle."""
    heavy = written(winners(written(digests(docs, doc_id, text), "digests")), "winners")
    marked = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias(_ID), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias(_DIGEST))
    marked = marked.join(F.broadcast(heavy), _DIGEST, "left").where(F.col(_SIZE).isNull() | F.col(_ID).eqNullSafe(F.col(_KEEP)))
    return _one(marked).where(_FIRST).select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(written(digests(table(spark, sf_dir, "documents")), "digests"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
             row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) AS rn FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM g
"""
