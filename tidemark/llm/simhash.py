"""SimHash near-dedup with anchor-point covering.

Fingerprints of 64 bits that differ in at most 2 have a half in which they differ in at most 1. On a half, the anchors are the words of a covering code:
the perfect Hamming code on 31 bits times the free 32nd bit, with covering radius 1. A fingerprint has its home at the one anchor within the radius, and
is replicated to every anchor within radius plus threshold, 1 + 1: at most 17 of a half's 2**27. If x and y differ in at most 1 bit there, then y has a
replica at the home of x; so homes are compared with replicas, anchor by anchor, on the whole fingerprint.

Only distinct fingerprints take part, so copies are never compared, and one fingerprint has at most 2,080 others within the threshold: links grow in
proportion to the fingerprints. Components come from alternating large-star and small-star steps over the link table; each step is written to the shared
folder, and no links, labels or fingerprints go to the driver.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; a text of fewer words than a shingle is one shingle; repeated rows
share one fingerprint; a null doc_id is never a component's smallest unless there is no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, small, table, written

SHINGLE, SEED, DISTANCE = 3, 42, 2

_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a whole text as a signed 64-bit number."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        starts, ends = [0], [len(joined)]
    else:
        after = list(accumulate(len(w) + 1 for w in words))
        starts, ends = [0, *after[: n - 1]], [x - 1 for x in after[shingle - 1 :]]
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        grams = [joined[a:b] for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(grams))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "__fp", shingle: int = SHINGLE) -> DataFrame:
    """docs, whose last column is the text, with the fingerprint in its place. Only narrow columns should stand before it."""
    *kept, _ = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([fingerprint(x.as_py(), shingle) for x in b.columns[-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], [*b.schema.names[:-1], name])

    return arrow_map(docs, run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the position (from 1) of the one bit that is off the code, or 0."""
    s = np.zeros(x.shape, np.int64)
    for i in range(31):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
    return s


def _flips() -> np.ndarray:
    """By syndrome: what turns a word into each code word within distance 2. Off the code: the one at distance 1 first, then the 15 at distance 2."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out[s] = [1 << (s - 1), *pairs]
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the fingerprints (uint64) its replicas as anchor and index of the fingerprint, and which of the replicas is the home. Both halves."""
    flips, keys, which, homes = _flips(), [], [], []
    low, top = np.uint64((1 << 31) - 1), np.uint64(1 << 31)
    index = np.arange(len(prints))
    for half in (0, 1):
        word = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = _syndromes(word & low)
        near = word[:, None] ^ flips[s]
        side = np.uint64(half << 32)
        real = np.ones(near.shape, bool)
        real[s == 0, 1:] = False
        keys += [(near | side)[real], (near[:, 0] ^ top) | side]
        which += [np.broadcast_to(index[:, None], near.shape)[real], index]
        first = np.zeros(near.shape, bool)
        first[:, 0] = True
        homes += [first[real], np.zeros(len(prints), bool)]
    return np.concatenate(keys), np.concatenate(which), np.concatenate(homes)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints: distinct __fp. Returns pairs u < v of fingerprints that differ in at most `distance` (2 at most) bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the covering is made for a distance of at most 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), _BLOCK):
                part = fp[i : i + _BLOCK]
                key, which, home = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[which]), pa.array(home)], ["a", "fp", "home"])

    # Spark sizes replicas as if they were no more than the fingerprints, so without the hint it sends up to 34 times its broadcast limit to the driver
    at = prints.select("__fp").mapInArrow(run, "a long, fp long, home boolean").hint("merge")
    homes, all_of = at.where("home").select("a", F.col("fp").alias("u")), at.select("a", F.col("fp").alias("v"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return homes.join(all_of, (homes["a"] == all_of["a"]) & (F.col("u") < F.col("v")) & (apart <= distance)).select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns u, root for every node but the roots themselves; a root is its component's smallest node."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == state or not seen[0]:
            return edges.select("u", F.col("v").alias("root"))
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints: doc_id, __fp. Returns __fp, root, component_id, one row per fingerprint."""
    per = written(prints.groupBy("__fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(per, distance))
    marked = per.join(roots.withColumnRenamed("u", "__fp"), "__fp", "left").select("__fp", "first", F.coalesce("root", "__fp").alias("root"))
    marked = written(marked, "roots")
    named = marked.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that joins with it are plain shuffles and a hot fingerprint's rows can be split
    return written(marked.join(named, "root").select("__fp", "root", "component_id"), "classes")


def near_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    prints = written(with_fingerprint(docs.select("doc_id", "text")), "prints")
    out = prints.join(classes(prints, distance), "__fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def _free(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def distinct_documents(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id; of several rows with that doc_id the one whose text has the smallest digest,
    a null text being empty; of rows that have both in common, one. All columns stay.

    What stays is chosen on doc_ids and digests. Whole rows are then filtered by those that go, by broadcast if they are few, else by one semi-join with
    those that stay; only rows that share doc_id and text with another are numbered."""
    digest = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
    prints = written(with_fingerprint(docs.select("doc_id", digest.alias("digest"), "text")), "prints")
    per = prints.groupBy("__fp", F.col("doc_id").alias("id"), "digest").agg(F.count(F.lit(1)).alias("n"))
    per = written(per.join(classes(prints, distance), "__fp").select("root", "id", "digest", "n"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n"))
    stay = written(per.groupBy("root").agg(first.alias("of")).select("of.id", "of.digest", "of.n"), "stay")
    go = written(per.select("id", "digest").join(stay, per["id"].eqNullSafe(stay["id"]) & (per["digest"] == stay["digest"]), "left_anti"), "go")
    text, at = _free(docs, "text_digest"), _free(docs, "at")
    here = docs.withColumn(text, digest)

    def same(t: DataFrame) -> Column:
        return here["doc_id"].eqNullSafe(t["id"]) & (here[text] == t["digest"])

    few = small(go)
    kept = here.join(few, same(few), "left_anti") if few is not go else here.join(stay, same(stay), "left_semi")
    twice = stay.where("n > 1")
    if not twice.limit(1).count():
        return kept.drop(text)
    more = small(written(twice, "repeated"))
    one = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.lit(1)))
    again = kept.join(more, same(more), "left_semi").withColumn(at, one).where(F.col(at) == 1)
    return kept.join(more, same(more), "left_anti").unionByName(again.drop(at)).drop(text)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
