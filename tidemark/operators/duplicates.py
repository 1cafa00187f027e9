"""Near-duplicate messages by word k-grams seen in earlier messages: exactly, and through a Bloom filter as a table of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Bloom, Duplicates
from tidemark.functions.hashing import bits_of, bloom_key
from tidemark.functions.text import gram_rows
from tidemark.operators.sequence import running_total
from tidemark.plans.storage import hinted, written

_GRAM = ["h1", "h2"]


def grams(messages: DataFrame, k: int) -> DataFrame:
    """messages: seq, body. Returns seq, h1, h2, n: a message's k-grams by a 128-bit digest, repeats counted. A message is one row, so its counts are whole
    before anything is shuffled."""
    g = gram_rows(messages, k).select("seq", F.xxhash64("g").alias("h1"), F.xxhash64(F.lit(1), "g").alias("h2"))
    return g.groupBy("seq", *_GRAM).agg(F.count(F.lit(1)).alias("n"))


def _scored(messages: DataFrame, hits: DataFrame, config: Duplicates) -> DataFrame:
    """Score: hits over k-grams; messages without any score 0 and are no duplicates."""
    per = hits.groupBy("seq").agg(F.sum("n").alias("n_shingles"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_hits"))
    rows = messages.select("seq").join(per, "seq", "left").na.fill(0, ["n_shingles", "n_hits"])
    score = F.when(F.col("n_shingles") > 0, F.col("n_hits") / F.col("n_shingles")).otherwise(0.0)
    return rows.withColumn("duplicate_score", score).withColumn("is_duplicate", (F.col("n_shingles") > 0) & (F.col("duplicate_score") >= config.threshold))


def exact(messages: DataFrame, config: Duplicates) -> DataFrame:
    """seq, n_shingles, n_hits, duplicate_score, is_duplicate. First sightings are summed before the shuffle, and a frequent k-gram's rows can be split in the join."""
    g = written(grams(messages, config.shingle), "grams")
    first = g.groupBy(*_GRAM).agg(F.min("seq").alias("first_seq"))
    return _scored(messages, g.join(first, _GRAM).select("seq", "n", (F.col("first_seq") < F.col("seq")).alias("hit")), config)


def _keyed(messages: DataFrame, config: Duplicates) -> DataFrame:
    """seq, key, n: k-grams by the 64 bits that the filter sees of them; k-grams that share those are one to it."""
    g = gram_rows(messages, config.shingle).select("seq", bloom_key(F.col("g"), config.bloom).alias("key"))
    return g.groupBy("seq", "key").agg(F.count(F.lit(1)).alias("n"))


def bit_firsts(keys: DataFrame, config: Bloom) -> DataFrame:
    """The filter as a table: b, first_seq (the message that set it). Each distinct key is hashed once."""
    first = keys.groupBy("key").agg(F.min("seq").alias("seq"))
    return first.select("seq", F.explode(bits_of(F.col("key"), config)).alias("b")).groupBy("b").agg(F.min("seq").alias("first_seq"))


def through_bloom(messages: DataFrame, config: Duplicates) -> DataFrame:
    """The same columns with the filter's false positives. After its first sighting a key's bits are all set, so only first sightings are probed: each bit
    of each key once, in a window over the bit. Bits are evenly hashed and hold one row per distinct key, so no bit is hot."""
    g = written(_keyed(messages, config), "grams")
    first = g.groupBy("key").agg(F.min("seq").alias("first_seq"))
    bits = first.select("key", "first_seq", F.explode(F.array_distinct(bits_of(F.col("key"), config.bloom))).alias("b"))
    late = F.min("first_seq").over(Window.partitionBy("b")) < F.col("first_seq")
    known = bits.select("key", "first_seq", late.alias("on")).groupBy("key", "first_seq").agg(F.min("on").alias("luck"))
    return _scored(messages, g.join(known, "key").select("seq", "n", ((F.col("first_seq") < F.col("seq")) | F.col("luck")).alias("hit")), config)


def fill_ratio(messages: DataFrame, config: Duplicates) -> DataFrame:
    """seq, fill_ratio: the share of bits that are set after each message."""
    new = bit_firsts(_keyed(messages, config), config.bloom).groupBy(F.col("first_seq").alias("seq")).agg(F.count(F.lit(1)).alias("new"))
    rows = messages.select("seq").join(new, "seq", "left").na.fill(0, ["new"])
    return running_total(rows, "new", "bits").select("seq", (F.col("bits") / F.lit(float(config.bloom.bits))).alias("fill_ratio"))


def membership(of: DataFrame, messages: DataFrame, config: Duplicates) -> DataFrame:
    """of: texts of a fixed corpus (seq, body), whose k-grams make a filter. Returns seq, n_shingles, n_hits: how many of a message's k-grams the filter has."""
    bits = _keyed(of, config).select("key").distinct().select(F.explode(bits_of(F.col("key"), config.bloom)).alias("b")).distinct()
    g = written(_keyed(messages, config), "grams")
    probe = g.select("key").distinct().select("key", F.explode(F.array_distinct(bits_of(F.col("key"), config.bloom))).alias("b"))
    found = probe.join(hinted(bits.withColumn("on", F.lit(1))), "b", "left").groupBy("key").agg((F.count("on") == F.count(F.lit(1))).alias("hit"))
    return g.join(found, "key").groupBy("seq").agg(F.sum("n").alias("n_shingles"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_hits"))


def summary(scored: DataFrame, exclude: bool = False) -> DataFrame:
    """processed, excluded, total, rate, avg_score. With exclusion, duplicates are not processed and total is 0."""
    counted = ~F.col("is_duplicate") if exclude else F.lit(True)
    sums = scored.agg(
        F.count_if(counted).alias("processed"),
        F.count_if(~counted).alias("excluded"),
        F.count_if(counted & F.col("is_duplicate")).alias("total"),
        F.sum(F.when(counted, F.col("duplicate_score"))).alias("s"),
    )
    return sums.select("processed", "excluded", "total", F.coalesce(F.try_divide("total", "processed"), F.lit(0.0)).alias("rate"), F.coalesce(F.try_divide("s", "processed"), F.lit(0.0)).alias("avg_score"))
