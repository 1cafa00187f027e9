"""Term frequencies: exact counts, and the Count-Min Sketch as a table of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CountMin
from tidemark.functions.hashing import cms_cells_of
from tidemark.operators.sequence import running
from tidemark.plans.storage import written


def counts(toks: DataFrame) -> DataFrame:
    """tok, n."""
    return toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def recent(toks: DataFrame, interval: int) -> DataFrame:
    """Distinct tokens of each interval between snapshots: interval_id (from 1), tok."""
    return toks.select(F.ceil(F.col("seq") / interval).alias("interval_id"), "tok").distinct()


def cells_of(rows: DataFrame, config: CountMin, key: str = "tok") -> DataFrame:
    """rows with a line per cell of the key: r, c."""
    return rows.select("*", F.inline(cms_cells_of(F.col(key), config)))


def cms_add(rows: DataFrame, config: CountMin, key: str = "tok", count: str = "n") -> DataFrame:
    """The sketch of keys with counts: r, c, v. Keys are hashed once each: counts are summed first. Zero counts add nothing; negative ones are an error."""
    bad = F.raise_error(F.lit("count must not be negative")).cast("long")
    rows = rows.select(F.col(key).alias("tok"), F.when(F.col(count) < 0, bad).otherwise(F.col(count)).alias("n")).where("n <> 0")
    return cells_of(rows, config).groupBy("r", "c").agg(F.sum("n").alias("v"))


def cms_estimate(keys: DataFrame, cells: DataFrame, config: CountMin, key: str = "tok") -> DataFrame:
    """keys with est: the least of the key's cells, an empty cell being 0. The table has width x depth rows at most, so it is broadcast."""
    probe = cells_of(keys.select(key).distinct(), config, key)
    least = probe.join(F.broadcast(cells), ["r", "c"], "left").groupBy(key).agg(F.min(F.coalesce("v", F.lit(0))).alias("est"))
    return keys.join(least, key)


def cms_merge(a: DataFrame, b: DataFrame, config_a: CountMin, config_b: CountMin) -> DataFrame:
    """The sketch of both streams. Only sketches of one shape and seed can merge."""
    if config_a != config_b:
        raise ValueError("only sketches with equal width, depth and seed can merge")
    return a.unionByName(b).groupBy("r", "c").agg(F.sum("v").alias("v"))


def cms_stats(cells: DataFrame, config: CountMin) -> DataFrame:
    """width, depth, used cells, memory_bytes, total_count."""
    first = F.sum(F.when(F.col("r") == 0, F.col("v")).otherwise(0))
    return cells.agg(F.count(F.lit(1)).alias("used_cells"), F.coalesce(first, F.lit(0)).alias("total_count")).select(
        F.lit(config.width).alias("width"), F.lit(config.depth).alias("depth"), "used_cells", F.lit(config.memory_bytes).cast("long").alias("memory_bytes"), "total_count"
    )


def estimate_terms(terms: list[str], cells: DataFrame, config: CountMin) -> DataFrame:
    """Estimates of terms, lower-cased for the lookup, under their own spelling: term, est."""
    rows = cells.sparkSession.createDataFrame([(t,) for t in terms], "term string").withColumn("tok", F.lower("term"))
    return cms_estimate(rows, cells, config).select("term", "est")


def top(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest, ties by token; adds rk."""
    best = rows.orderBy(F.col(by).desc(), "tok").limit(n)
    return best.withColumn("rk", F.row_number().over(Window.orderBy(F.col(by).desc(), "tok")).cast("long"))


def sketched(keys: DataFrame, rows: DataFrame, config: CountMin) -> DataFrame:
    """keys: tok. rows: tok, n. Returns keys with est through the sketch of rows."""
    return cms_estimate(keys, cms_add(rows, config), config)


def counted(keys: DataFrame, rows: DataFrame, config: CountMin) -> DataFrame:
    """The same, exactly: an unseen key has 0."""
    n = rows.groupBy("tok").agg(F.sum("n").alias("est"))
    return keys.join(n, "tok", "left").na.fill(0, ["est"])


# Reports at every snapshot. A row per term and snapshot would be far more than the few per snapshot that are asked for, so snapshots 1, 2, 3-4, 5-8, ...
# are taken as ranges: a term's number only grows, so in a range only terms can be on top that reach, at its end, what the last of the top had at its start.

_STRIDE = 4096


def _range_of(i: Column) -> Column:
    """0 for snapshot 1, then the j for which 2**(j-1) < i <= 2**j."""
    return F.when(i <= 1, 0).otherwise(F.length(F.bin(i - 1))).cast("int")


def ends(changes: DataFrame, keys: list[str], last: int) -> DataFrame:
    """changes: keys, i, k. Returns keys, j, v: the sum of k up to the end of range j, for every range from a key's first on; at most 64 a key."""
    per = changes.groupBy(*keys, _range_of(F.col("i")).alias("j")).agg(F.sum("k").alias("k"))
    order = Window.partitionBy(*keys).orderBy("j")
    runs = per.select(*keys, "j", F.sum("k").over(order).alias("v"), F.lead("j").over(order).alias("nxt"))
    final = max(last - 1, 0).bit_length()
    return runs.select(*keys, "v", F.explode(F.sequence("j", F.coalesce(F.col("nxt") - 1, F.lit(final)))).alias("j"))


def contenders(at_ends: DataFrame, n: int) -> DataFrame:
    """at_ends: tok, j, v. Returns tok, j of the terms that may be among the n greatest somewhere in range j."""
    rank = F.row_number().over(Window.partitionBy("j").orderBy(F.col("v").desc(), "tok"))
    least = at_ends.withColumn("rk", rank).where(F.col("rk") <= n).groupBy((F.col("j") + 1).alias("j")).agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("many"))
    reached = at_ends.join(F.broadcast(least.where(F.col("many") >= n)), "j", "left")  # 64 ranges at most
    return reached.where(F.col("v") >= F.coalesce("least", F.lit(0))).select("tok", "j")


def dense(wanted: DataFrame, changes: DataFrame, at_ends: DataFrame, keys: list[str], last: int) -> DataFrame:
    """wanted: keys, j. Returns keys, j, seq, v: the running sum at each snapshot of range j."""
    base = at_ends.select(*keys, (F.col("j") + 1).alias("j"), F.col("v").alias("base"))
    power = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    first = F.when(F.col("j") == 0, F.lit(1).cast("long")).otherwise(power(F.col("j") - 1) + 1)
    end = F.least(power(F.col("j")), F.lit(last).cast("long"))
    rows = wanted.join(base, [*keys, "j"], "left").select(*keys, "j", "base", first.alias("first"), end.alias("end")).where("first <= end")
    rows = rows.select("*", F.explode(F.sequence(F.floor(F.col("first") / _STRIDE), F.floor(F.col("end") / _STRIDE))).alias("part"))
    low, high = F.greatest("first", F.col("part") * _STRIDE), F.least("end", F.col("part") * _STRIDE + _STRIDE - 1)
    rows = rows.select(*keys, "j", "base", "first", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("i")).join(changes, [*keys, "i"], "left")
    step = F.coalesce("k", F.lit(0)) + F.when(F.col("i") == F.col("first"), F.coalesce("base", F.lit(0))).otherwise(0)
    return running(rows.select(*keys, "j", F.col("i").alias("seq"), step.alias("step")), "step", "v", (*keys, "j")).drop("step")


def top_at_snapshots(toks: DataFrame, interval: int, n: int) -> DataFrame:
    """The n most frequent tokens up to every snapshot: t, tok, n, rk."""
    per = written(toks.groupBy(F.ceil(F.col("seq") / interval).alias("i"), "tok").agg(F.count(F.lit(1)).alias("k")), "intervals")
    last = toks.agg(F.floor(F.coalesce(F.max("seq"), F.lit(0)) / interval).alias("last")).first().last
    per = per.where(F.col("i") <= last)
    at_ends = ends(per, ["tok"], last)
    at = dense(contenders(at_ends, n), per, at_ends, ["tok"], last).where("v > 0")
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.col("v").desc(), "tok"))
    return at.withColumn("rk", rank.cast("long")).where(F.col("rk") <= n).select((F.col("seq") * interval).alias("t"), "tok", F.col("v").alias("n"), "rk")
