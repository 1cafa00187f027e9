"""Global order: sequence numbers and running totals that need no single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.storage import small, written

#: Up to so many rows of so many bytes in all (by the optimizer's estimate) one sorted task numbers them; beyond, sorted ranges are numbered side by side.
ONE_TASK, ONE_TASK_BYTES = 200_000, 32 << 20

_ROW_BITS = 33


def sequenced(rows: DataFrame, order: list[str], limit: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """rows with seq, 1 for the first in the given order, nulls last; only the first `limit` if given (a top-k, before numbering)."""
    by = [F.col(c).asc_nulls_last() for c in order]
    if limit is not None:
        rows = rows.orderBy(*by).limit(limit)
    narrow = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_TASK_BYTES
    if (limit is not None and limit <= one_task) or narrow and small(rows, one_task):
        numbered = rows.select(F.row_number().over(Window.orderBy(*by)).cast("long").alias("seq"), "*")
        # dealt out by number: what follows works on all cores, and windows by seq need no further shuffle
        return numbered.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "seq")
    # the ranges come from a sample, so they are written before they are counted
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    within = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.select((F.col("__before") + within + 1).alias("seq"), *rows.columns)


def running(rows: DataFrame, value: str, name: str, by: tuple[str, ...] = (), how: str = "sum", block: int = 1 << 16) -> DataFrame:
    """rows: seq, the columns `by`, and a value. Adds its sum or maximum up to and with each seq (rows of one seq are peers): within blocks of numbers side
    by side, together with what stands before each block. So a key that has a row for every seq is no single task's work."""
    f = {"sum": F.sum, "max": F.max}[how]
    rows = rows.withColumn("__block", F.floor(F.col("seq") / block))
    totals = rows.groupBy(*by, "__block").agg(f(value).alias("__t"))
    before = f("__t").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    inside = f(value).over(Window.partitionBy(*by, "__block").orderBy("seq"))
    out = rows.withColumn("__in", inside).join(totals.select(*by, "__block", before.alias("__before")), [*by, "__block"])
    total = F.col("__in") + F.coalesce("__before", F.lit(0)) if how == "sum" else F.greatest("__in", "__before")
    return out.withColumn(name, total).drop("__block", "__in", "__before")


def running_total(rows: DataFrame, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """rows: seq and a value. Adds the total up to and with each seq."""
    return running(rows, value, name, block=block)
