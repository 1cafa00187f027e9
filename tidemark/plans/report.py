"""The run over a message stream: snapshots every so many processed messages, and the summary document."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Run
from tidemark.functions.text import tokens
from tidemark.operators import burst, duplicates, frequency, ranks
from tidemark.operators.sequence import running, running_total
from tidemark.plans.storage import scratch, written

_BURST = ("bin", "ratio", "recent_count", "prev_count", "representative")


def processed_order(scored: DataFrame, exclude: bool) -> DataFrame:
    """scored: seq, is_duplicate. Adds upto, how many messages up to and with this one were not excluded, and processed, the same but null for excluded ones."""
    keep = ~F.col("is_duplicate") if exclude else F.lit(True)
    return running_total(scored.withColumn("__one", keep.cast("long")), "__one", "upto").withColumn("processed", F.when(keep, F.col("upto"))).drop("__one")


@dataclass(frozen=True)
class Detectors:
    """What a run asks. Each can be replaced by a function that takes and returns the same, such as `duplicates.through_bloom` or `frequency.counted`.

    duplicates: messages (seq, body) and its parameters -> seq, n_shingles, n_hits, duplicate_score, is_duplicate
    bursts: seq, tok, n, pos of all messages, times (t), the sketch's and its own parameters -> t, bin, recent_count, prev_count, ratio, representative
    frequencies: keys (tok), rows (tok, n) and the sketch's parameters -> keys with est"""

    duplicates: Callable[..., DataFrame] = duplicates.exact
    bursts: Callable[..., DataFrame] = burst.bins_at
    frequencies: Callable[..., DataFrame] = frequency.sketched


#: Messages that a summary holds itself; more are written beside it.
INLINE = 10_000


class MessageRun:
    """One pass of all detectors over a stream of messages (seq, body). Tokens, scores and cells are computed once and shared by every report."""

    def __init__(self, messages: DataFrame, config: Run = Run(), detectors: Detectors = Detectors()):
        self.config, self.detectors = config, detectors
        if config.max_messages is not None:
            messages = messages.where(F.col("seq") <= config.max_messages)
        self.messages = messages
        self.tokens = written(tokens(messages), "tokens")
        self.per_message = burst.per_message(self.tokens)
        self.scored = written(processed_order(detectors.duplicates(messages, config.duplicates), config.exclude_duplicates), "scored")

    def snapshot_times(self, final: bool = False) -> DataFrame:
        """t, processed: the messages after which a snapshot is due; with `final` the last message too."""
        rows = self.scored.where(F.col("processed").isNotNull())
        due = rows.where(F.col("processed") % self.config.interval == 0).select(F.col("seq").alias("t"), "processed")
        if final:
            due = due.unionByName(rows.orderBy(F.col("seq").desc()).limit(1).select(F.col("seq").alias("t"), "processed")).distinct()
        return due

    def top_tokens(self) -> DataFrame:
        """t, tok, est, rk: the sketch's estimates over all messages up to t of tokens that non-excluded messages brought."""
        n, sketch, times = self.config.interval, self.config.count_min, self.snapshot_times().select("t", F.floor(F.col("processed") / self.config.interval).alias("i"))
        last = times.agg(F.coalesce(F.max("i"), F.lit(0)).alias("last")).first().last
        due = F.when(F.col("processed").isNull(), F.floor(F.col("upto") / n) + 1).otherwise(F.ceil(F.col("processed") / n))
        rows = self.per_message.join(self.scored.select("seq", due.alias("i"), F.col("processed").isNotNull().alias("shown")), "seq").where(F.col("i") <= last)
        cells = written(frequency.cells_of(rows, sketch).groupBy("r", "c", "i").agg(F.sum("n").alias("k")), "cells")
        known = written(rows.where("shown").groupBy("tok").agg(F.min("i").alias("first")), "known")
        filled = frequency.ends(cells, ["r", "c"], last)
        seen = frequency.ends(known.select("tok", F.col("first").alias("i"), F.lit(1).alias("k")), ["tok"], last).select("tok", "j")
        at_ends = written(frequency.cells_of(seen, sketch).join(filled, ["r", "c", "j"]).groupBy("tok", "j").agg(F.min("v").alias("v")), "ends")
        some = frequency.cells_of(frequency.contenders(at_ends, self.config.top), sketch)
        totals = frequency.dense(some.select("r", "c", "j").distinct(), cells, filled, ["r", "c"], last)
        est = some.join(totals, ["r", "c", "j"]).groupBy("seq", "tok").agg(F.min("v").alias("est"))
        est = est.join(known, "tok").where(F.col("first") <= F.col("seq")).drop("first")
        rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.col("est").desc(), "tok"))
        return est.withColumn("rk", rank.cast("long")).where(F.col("rk") <= self.config.top).join(times, F.col("seq") == F.col("i")).select("t", "tok", "est", "rk")

    def _bursts_at(self, times: DataFrame) -> DataFrame:
        return self.detectors.bursts(self.per_message, times, self.config.count_min, self.config.burst)

    def bursts(self, final: bool = False) -> DataFrame:
        """t, bin, recent_count, prev_count, ratio, representative."""
        return self._bursts_at(self.snapshot_times(final).select("t"))

    def estimates(self, terms: list[str]) -> DataFrame:
        """Estimates of terms, lower-cased for the lookup, under their own spelling: term, est."""
        asked = self.messages.sparkSession.createDataFrame([(t,) for t in terms], "term string").withColumn("tok", F.lower("term"))
        return asked.join(self.detectors.frequencies(asked.select("tok").distinct(), self.per_message, self.config.count_min), "tok").select("term", "est")

    def snapshots(self) -> DataFrame:
        """t, message_count, top_tokens, burst, duplicates_so_far."""
        times = self.snapshot_times()
        top = self.top_tokens().groupBy("t").agg(F.array_sort(F.collect_list(F.struct("rk", "tok", "est"))).alias("top_tokens"))
        found = burst.ordered(self.bursts()).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("place", *_BURST))).alias("burst"))
        seen = running_total(self.scored.withColumn("d", (F.col("processed").isNotNull() & F.col("is_duplicate")).cast("long")), "d", "duplicates_so_far").select(F.col("seq").alias("t"), "duplicates_so_far")
        rows = times.join(top, "t", "left").join(found, "t", "left").join(seen, "t")
        return rows.select("t", F.col("processed").alias("message_count"), "top_tokens", "burst", "duplicates_so_far")

    def echo(self) -> DataFrame:
        """Every processed message with its duplicate result: seq, body, is_duplicate, duplicate_score."""
        return self.messages.select("seq", "body").join(self.scored.where(F.col("processed").isNotNull()), "seq").select("seq", "body", "is_duplicate", "duplicate_score")

    def message_results(self, terms: tuple[str, ...] = ()) -> DataFrame:
        """What each processed message gave when it came: seq, text, duplicate (is_duplicate, duplicate_score, fill_ratio), burst (in order), and for the
        terms asked for their counts up to then as frequencies."""
        fill = duplicates.fill_ratio(self.messages, self.config.duplicates)
        found = burst.ordered(self._bursts_at(self.scored.where(F.col("processed").isNotNull()).select(F.col("seq").alias("t"))))
        found = found.groupBy(F.col("t").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("place", *_BURST))).alias("burst"))
        rows = self.echo().join(fill, "seq").join(found, "seq", "left")
        duplicate = F.struct("is_duplicate", "duplicate_score", "fill_ratio").alias("duplicate")
        rows = rows.select("seq", F.col("body").alias("text"), duplicate, F.transform(F.coalesce("burst", F.array()), lambda b: F.struct(*(b[c].alias(c) for c in _BURST))).alias("burst"))
        terms = tuple(dict.fromkeys(terms))
        asked = [t.lower() for t in terms]
        if not asked:
            return rows
        own = self.per_message.where(F.col("tok").isin(asked)).select("seq", "tok", "n")
        every = self.messages.select("seq").select("seq", F.explode(F.array(*map(F.lit, dict.fromkeys(asked)))).alias("tok")).join(own, ["seq", "tok"], "left").na.fill(0, ["n"])
        upto = running(every, "n", "v", ("tok",)).groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("tok", "v"))).alias("m"))
        return rows.join(upto, "seq").withColumn("frequencies", F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*(F.col("m")[t] for t in asked)))).drop("m")

    def write_messages(self, path: str) -> None:
        """The results of all messages as JSON lines."""
        self.message_results().write.json(path)

    def summary(self, split: str = "test", queries: tuple[str, ...] = (), show_text: bool = False) -> dict:
        """The report as a document. Its parts are bounded: snapshots, top terms, bins, and, if asked for, messages: up to INLINE of them; more are written
        as JSON lines to a folder beside the other tables, which is named instead."""
        c = self.config
        n = duplicates.summary(self.scored, c.exclude_duplicates).first()
        last = {r.t for r in self.snapshot_times(True).agg(F.max("t").alias("t")).collect() if r.t is not None}
        shots = [r.asDict(recursive=True) for r in self.snapshots().orderBy("t").collect()]
        final = [r for r in burst.ordered(self.bursts(True)).orderBy("t", "place").collect() if r.t in last]
        shown = self.scored.where(F.col("processed").isNotNull()).select("seq")
        known = self.per_message.join(shown, "seq").select("tok").distinct()
        top = frequency.top(self.detectors.frequencies(known, self.per_message, c.count_min), "est", c.top).orderBy("rk").collect()
        out = {
            "split": split,
            "processed": n.processed,
            "excluded_duplicates": n.excluded,
            "update_interval": c.interval,
            "frequency_estimates": {r.term: r.est for r in self.estimates(list(queries)).collect()} if queries else {},
            "duplicates": {"total": n.total, "rate": n.rate, "avg_score": n.avg_score},
            "periodic_snapshots": [
                {
                    "message_count": s["message_count"],
                    "top_10_tokens": {x["tok"]: x["est"] for x in s["top_tokens"] or ()},
                    "burst": [{k: x[k] for k in _BURST} for x in s["burst"] or ()],
                    "duplicates_so_far": s["duplicates_so_far"],
                }
                for s in shots
            ],
            "final burst": [{k: r[k] for k in _BURST} for r in final],
            "final top_tokens": {r.tok: r.est for r in top},
        }
        if show_text and n.processed > INLINE:
            out["messages_at"] = f"{scratch(self.messages.sparkSession)}/messages-{uuid.uuid4().hex}"
            self.write_messages(out["messages_at"])
        elif show_text:
            out["messages"] = [{k: v for k, v in r.asDict(recursive=True).items() if k != "seq"} for r in self.message_results().orderBy("seq").collect()]
        return out

    def rank_table(self, k: int = 5) -> DataFrame:
        """t, term, rank; t is the number of messages processed, a multiple of the interval. No rows without snapshots."""
        found = self.bursts().join(self.snapshot_times(), "t").drop("t").withColumnRenamed("processed", "t")
        return ranks.ranks(ranks.terms(ranks.top_bursts(found, k)))


def as_json(summary: dict) -> str:
    return json.dumps(summary, ensure_ascii=False, indent=2)
