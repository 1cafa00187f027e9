"""The detectors over a live stream.

Structured Streaming has no windows by count, so each micro-batch numbers its messages on from what came before (arrival by batch, within a batch the
given order) and appends to state tables in the shared folder. Every table is keyed by batch, and a batch that is played again overwrites its own part,
so a restart neither loses nor repeats messages. Counts are added per batch and summed when asked for. The sketch's cells and the tracked terms are state
of bounded size: each batch writes them anew from the batch before. First sightings of k-grams are kept for good, as a duplicate may come at any time, so the
join with them is the one step of a batch whose work grows with the stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Run
from tidemark.functions import text as X
from tidemark.operators import burst, duplicates, frequency
from tidemark.operators.sequence import sequenced
from tidemark.plans.storage import release, scratch, written

_KEEP = {
    "progress": "prev long, last long",
    "counts": "tok string, n long",
    "cells": "r int, c int, v long",
    "tracked": "tok string",
    "firsts": "h1 long, h2 long, first_seq long",
    "scores": "seq long, n_shingles long, n_hits long, duplicate_score double, is_duplicate boolean",
    "events": "seq long, bin int, n long",
}


class MessageStream:
    """State of one stream. `play` runs a streaming DataFrame (body and the order columns) to the end of what is there; `batch` takes one micro-batch."""

    def __init__(self, spark: SparkSession, config: Run, order: list[str], path: str | None = None):
        self.spark, self.config, self.order = spark, config, order
        self.path = path or f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def _exists(self, at: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _drop(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _table(self, name: str, before: int | None = None) -> DataFrame:
        schema = f"{_KEEP[name]}, batch long"
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _part(self, name: str, batch: int | None) -> DataFrame:
        """What one batch wrote; nothing for no batch."""
        if batch is None or not self._exists(f"{self.path}/{name}/batch={batch}"):
            return self.spark.createDataFrame([], _KEEP[name])
        return self.spark.read.schema(_KEEP[name]).parquet(f"{self.path}/{name}/batch={batch}")

    def _put(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self._part(name, batch)

    def _last(self, before: int | None = None) -> tuple[int | None, int]:
        """The last batch (before that one) and the number of its last message."""
        row = self._table("progress", before).orderBy(F.col("batch").desc()).limit(1).select("batch", "last").first()
        return (row.batch, row.last) if row else (None, 0)

    def batch(self, rows: DataFrame, batch: int) -> None:
        rows = rows.where(X.has_token(F.col("body")))
        before, start = self._last(batch)
        messages = written(sequenced(rows, self.order).withColumn("seq", F.col("seq") + F.lit(start)), "batch")
        toks = X.tokens(messages).persist()
        counts = self._put("counts", batch, frequency.counts(toks))
        sketch = self.config.count_min
        cells = self._put("cells", batch, frequency.cms_merge(self._part("cells", before), frequency.cms_add(counts, sketch), sketch, sketch))
        known = self._part("tracked", before).unionByName(counts.select("tok")).distinct()
        best = frequency.cms_estimate(known, cells, sketch).orderBy(F.col("est").desc(), "tok").limit(self.config.tracked)
        self._put("tracked", batch, best.select("tok"))
        self._put("events", batch, burst.bin_events(burst.per_message(toks), sketch))
        toks.unpersist()
        g = written(duplicates.grams(messages, self.config.duplicates.shingle), "grams")
        own = g.groupBy("h1", "h2").agg(F.min("seq").alias("own_seq"))
        seen = own.join(self._table("firsts", batch).drop("batch"), ["h1", "h2"], "left")
        seen = written(seen.select("h1", "h2", F.coalesce("first_seq", "own_seq").alias("first_seq"), F.col("first_seq").isNull().alias("new")), "seen")
        self._put("firsts", batch, seen.where("new").drop("new"))
        hits = g.join(seen, ["h1", "h2"]).select("seq", "n", (F.col("first_seq") < F.col("seq")).alias("hit"))
        self._put("scores", batch, duplicates._scored(messages.select("seq"), hits, self.config.duplicates))
        last = messages.agg(F.coalesce(F.max("seq"), F.lit(start)).alias("last"))
        self._put("progress", batch, last.select(F.lit(before).cast("long").alias("prev"), "last"))
        release(messages, g, seen)
        if before is not None:  # the part before is still there if this batch is played again
            older = self._part("progress", before).first().prev
            for name in ("cells", "tracked"):
                self._drop(f"{self.path}/{name}/batch={older}")

    def play(self, messages: DataFrame) -> None:
        query = messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def frequencies(self) -> DataFrame:
        """tok, n."""
        return self._table("counts").groupBy("tok").agg(F.sum("n").alias("n"))

    def cells(self) -> DataFrame:
        """The Count-Min Sketch of all messages so far: r, c, v."""
        return self._part("cells", self._last()[0])

    def estimates(self, terms: list[str]) -> DataFrame:
        """term, est."""
        return frequency.estimate_terms(terms, self.cells(), self.config.count_min)

    def top(self, n: int | None = None) -> DataFrame:
        """tok, est, rk: the tracked terms with the highest estimates now. At most config.tracked terms are tracked: after each batch those of the tracked
        ones and its own that are estimated highest."""
        known = self._part("tracked", self._last()[0])
        return frequency.top(frequency.cms_estimate(known, self.cells(), self.config.count_min), "est", n or self.config.top)

    def duplicates(self) -> DataFrame:
        return self._table("scores").drop("batch")

    def bursts(self) -> DataFrame:
        """Bins that burst at the last message: t, bin, recent_count, prev_count, ratio. Reads the last window's events only."""
        _, last = self._last()
        recent = self._table("events").drop("batch").where(F.col("seq") > last - self.config.burst.window)
        return burst.at(recent, self.spark.range(1).select(F.lit(last).cast("long").alias("t")).where("t > 0"), "bin", self.config.burst)

    def counts_over_time(self, events: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
        """A streaming count by window of time and key; rows up to `late` behind the newest time of earlier batches are taken in, later ones are dropped."""
        events = events.withColumn(time, F.col(time).cast("timestamp"))
        return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))

    def play_over_time(self, events: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
        """Plays a stream of events to the end of what is there. Returns start, key, n. Each batch writes the windows that it changed; the last batch counts."""
        at = f"{self.path}/over-time"

        def put(rows: DataFrame, batch: int) -> None:
            rows.select(F.col("w.start").alias("start"), key, "n").write.mode("overwrite").parquet(f"{at}/batch={batch}")

        counts = self.counts_over_time(events, time, key, length, late)
        query = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{self.path}/over-time-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        kind = events.schema[key].dataType.simpleString()
        schema = f"start timestamp, {key} {kind}, n long, batch long"
        rows = self.spark.read.schema(schema).parquet(at) if self._exists(at) else self.spark.createDataFrame([], schema)
        return rows.groupBy("start", key).agg(F.max_by("n", "batch").alias("n"))
