"""How bursts move over time: from bursts per snapshot to ranks, segments and markers of a bump chart, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.storage import written

#: Ranks beyond this one aren't drawn.
DRAWN = 10


def top_bursts(bursts: DataFrame, k: int = 5) -> DataFrame:
    """bursts: t, bin, recent_count, ratio, representative. The k strongest of each snapshot: t, place, bin, term, ratio."""
    order = Window.partitionBy("t").orderBy(F.col("ratio").desc(), F.col("recent_count").desc(), "bin")
    best = bursts.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
    return best.select("t", "place", "bin", F.col("representative").alias("term"), "ratio")


def terms(top: DataFrame) -> DataFrame:
    """A term once per snapshot: its last ratio, at its first place."""
    return top.groupBy("t", "term").agg(F.max_by("ratio", "place").alias("ratio"), F.min("place").alias("place"))


def outer(per_term: DataFrame, interval: int) -> DataFrame:
    """The full outer join of all snapshots on the term, in long form: t, term, ratio; null where the term is absent. Rows are terms times snapshots, as
    they are what the join means; `terms` has those that aren't null."""
    per_term = written(per_term, "terms")
    ends = per_term.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends.a is None:
        return per_term.select("t", "term", "ratio")
    every = per_term.select("term").distinct().select("term", F.explode(F.sequence(F.lit(ends.a), F.lit(ends.b), F.lit(interval).cast("long"))).alias("t"))
    return every.join(per_term.select("t", "term", "ratio"), ["t", "term"], "left").select("t", "term", "ratio")


def wide(per_term: DataFrame, times: list[int]) -> DataFrame:
    """A row per term, a column t_<time> per snapshot; null where it is absent. For a list of times that is known."""
    return per_term.groupBy("term").pivot("t", times).agg(F.first("ratio")).select("term", *(F.col(str(t)).alias(f"t_{t}") for t in times))


def ranks(per_term: DataFrame) -> DataFrame:
    """t, term, rank by falling ratio; of equals the term that appeared first. No rows without snapshots."""
    per_term = per_term.withColumn("seen", F.min(F.struct("t", "place")).over(Window.partitionBy("term")))
    order = Window.partitionBy("t").orderBy(F.col("ratio").desc(), "seen")
    return per_term.select("t", "term", F.row_number().over(order).cast("long").alias("rank"))


def markers(ranked: DataFrame) -> DataFrame:
    """term, appearances, marker: 1 to 4, or 5 for five and more."""
    n = ranked.groupBy("term").agg(F.count(F.lit(1)).alias("appearances"))
    return n.withColumn("marker", F.least("appearances", F.lit(5).cast("long")))


def segments(ranked: DataFrame, interval: int) -> DataFrame:
    """Unbroken stretches in which a term is drawn: term, first_t, last_t, points."""
    drawn = ranked.where(F.col("rank") <= DRAWN)
    island = F.col("t") / interval - F.row_number().over(Window.partitionBy("term").orderBy("t"))
    return drawn.withColumn("island", island).groupBy("term", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("points")).drop("island")
