"""Bursts: terms, or bins of the Count-Min Sketch, that occur more often in the later half of the window than in the half before. Exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Burst, CountMin
from tidemark.operators.frequency import cells_of
from tidemark.operators.sequence import running
from tidemark.plans.storage import hinted


def per_message(toks: DataFrame) -> DataFrame:
    """seq, tok, n, and pos, the first place in the message."""
    return toks.groupBy("seq", "tok").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))


def _ratio(config: Burst) -> Column:
    return (F.col("recent_count").cast("double") + config.epsilon) / (F.col("prev_count").cast("double") + config.epsilon)


def _judged(counts: DataFrame, config: Burst) -> DataFrame:
    return counts.withColumn("ratio", _ratio(config)).where((F.col("recent_count") >= config.min_count) & (F.col("ratio") >= config.threshold))


def at(events: DataFrame, times: DataFrame, key: str, config: Burst) -> DataFrame:
    """events: seq, key, n. times: t. Returns t, key, recent_count, prev_count, ratio of what bursts at each time.

    The range join goes by blocks as long as the window: a time meets the events of its own block and of the one before, an equi-join."""
    w, h = config.window, config.half
    times = times.select("t", F.explode(F.array(F.floor(F.col("t") / w), F.floor(F.col("t") / w) - 1)).alias("block"))
    rows = events.withColumn("block", F.floor(F.col("seq") / w)).join(hinted(times), "block").where((F.col("seq") <= F.col("t")) & (F.col("seq") > F.col("t") - 2 * h))
    late = F.col("seq") > F.col("t") - h
    counts = rows.groupBy("t", key).agg(F.sum(F.when(late, F.col("n")).otherwise(0)).alias("recent_count"), F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("prev_count"))
    return _judged(counts, config)


def bin_events(messages_tokens: DataFrame, config: CountMin) -> DataFrame:
    """seq, bin, n: every occurrence counts once in each of its cells' columns; rows of the sketch share one bank of bins."""
    return cells_of(messages_tokens, config).groupBy("seq", F.col("c").alias("bin")).agg(F.sum("n").alias("n"))


def running_estimates(messages_tokens: DataFrame, config: CountMin) -> DataFrame:
    """seq, tok, pos, bin, r, est: each token's estimate at the end of its message, for each of its cells."""
    cells = cells_of(messages_tokens, config)
    grown = running(cells.groupBy("r", "c", "seq").agg(F.sum("n").alias("n")), "n", "v", ("r", "c")).drop("n")
    own = cells.join(grown, ["r", "c", "seq"])
    est = own.groupBy("seq", "tok").agg(F.min("v").alias("est"))
    return own.join(est, ["seq", "tok"]).select("seq", "tok", "pos", F.col("c").alias("bin"), "r", "est")


def _best() -> Column:
    """The higher estimate, of equals the earlier."""
    return F.max(F.struct(F.col("est"), (-F.col("seq")).alias("s"), (-F.col("pos")).alias("p"), (-F.col("r")).alias("q"), F.col("tok")))


def representatives(messages_tokens: DataFrame, config: CountMin) -> DataFrame:
    """bin, representative, best_score: the token with the highest estimate that its bin ever saw."""
    best = running_estimates(messages_tokens, config).groupBy("bin").agg(_best().alias("b"))
    return best.select("bin", F.col("b.tok").alias("representative"), F.col("b.est").alias("best_score"))


def bins_at(messages_tokens: DataFrame, times: DataFrame, sketch: CountMin, config: Burst) -> DataFrame:
    """t, bin, recent_count, prev_count, ratio, representative (as of t) of the bins that burst at each time."""
    bursts = at(bin_events(messages_tokens, sketch), times, "bin", config)
    seen = running_estimates(messages_tokens, sketch).groupBy("bin", "seq").agg(_best().alias("b"))
    probes = bursts.select("bin", F.col("t").alias("seq"), F.lit(None).cast(seen.schema["b"].dataType).alias("b"), "t", "recent_count", "prev_count", "ratio")
    both = probes.unionByName(seen, allowMissingColumns=True)
    named = running(both, "b", "best", ("bin",), "max").where("t IS NOT NULL")  # peers included: the message at t counts
    return named.select("t", "bin", "recent_count", "prev_count", "ratio", F.col("best.tok").alias("representative"))


def ordered(bursts: DataFrame) -> DataFrame:
    """Adds place: ratio falling, then recent count falling, then bin."""
    order = Window.partitionBy("t").orderBy(F.col("ratio").desc(), F.col("recent_count").desc(), "bin")
    return bursts.withColumn("place", F.row_number().over(order).cast("long"))
