"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are runs of ORDER characters of any script, white space being one space; neither characters nor n-grams are capped, so the counts grow with the
text. They are counted over the trusted documents but those of a held-out fold (one in FOLDS). Below the highest order, counts are of different characters
to the left; below the lowest, all characters seen and one for the unseen are alike.

Documents are judged by count joins that are sharded by n-gram: each batch of texts names its distinct n-grams, summed over all documents before anything
is joined; these are joined with the counts of each order and of its contexts, from the lowest order up, which gives the probability of every n-gram that
any document has. If these are at most BROADCAST, they are sent to the texts; else each document's n-grams go to the probabilities and are summed there.

A document is kept if its perplexity is at most the QUANTILE of the held-out trusted documents of its language, which the model hasn't seen; quantiles
come from counts of log-perplexity in steps of STEP, summed over all those documents. A language without any takes the quantile over all; without
any in all, trusted documents that were trained on set it.

Defined cases: a null text, or one of white space only, has no n-grams, no perplexity, and isn't kept; a null language is a language of its own; without
trusted documents every document with n-grams is kept; of documents as bad as the threshold all are kept; repeated rows are judged each on their own;
repeated labels count once; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, others, small, table, written

ORDER, QUANTILE, STEP, FOLDS = 5, 0.99, 1e-3, 5

#: N-grams (12 bytes each) that are sent to every task at most.
BROADCAST = 4_000_000

_SLICE, _BLOCK = 1 << 20, 1 << 20
#: A character is its code point plus 1 in 21 bits; the last three of an n-gram are in b, those before in a; 0 is none.
_BITS, _SPACE = 21, 33
_ONE, _TWO, _ALL = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1, (1 << 3 * _BITS) - 1
_MASKS = {1: (0, _ONE), 2: (0, _TWO), 3: (0, _ALL), 4: (_ONE, _ALL), 5: (_TWO, _ALL), 6: (_ALL, _ALL)}
_IS_SPACE = np.array([chr(k).isspace() for k in range(0x3002)])


def symbols(text: str) -> Iterator[np.ndarray]:
    """The characters of a whole text in slices, each led by the ORDER - 1 before it; spaces lead the first. White space at the start is dropped."""
    tail, space = np.full(ORDER - 1, _SPACE, np.int64), True
    for i in range(0, len(text), _SLICE):
        x = np.frombuffer(text[i : i + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        white = _IS_SPACE[np.minimum(x, 0x3001)]
        keep = ~(white & np.concatenate([[space], white[:-1]]))
        space = bool(white[-1])
        out = np.concatenate([tail, np.where(white, _SPACE - 1, x)[keep] + 1])
        tail = out[len(out) - ORDER + 1 :]
        yield out


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for each n-gram."""
    h = (a.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of all texts, a block at a time: a, b, and which text each belongs to. Texts without other characters than white space have none."""
    held, owners, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, lengths = np.concatenate(held), np.array([len(h) for h in held])
        n = len(x) - ORDER + 1
        a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(ORDER):
            part = a if k < ORDER - 3 else b
            part <<= _BITS
            part |= x[k : k + n]
        real = np.ones(len(x), bool)
        starts = np.cumsum(lengths) - lengths
        for k in range(ORDER - 1):
            real[starts + k] = False
        real = real[ORDER - 1 :]
        return a[real], b[real], np.repeat(owners, lengths - ORDER + 1)

    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        for x in symbols(text):
            if len(x) >= ORDER:
                held.append(x)
                owners.append(i)
                size += len(x)
            if size >= _BLOCK:
                yield flush()
                held, owners, size = [], [], 0
    if held:
        yield flush()


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams as key and place of one of each, which of them each is, and how often they occur."""
    codes, keys = pd.factorize(_key(a, b))
    place = np.empty(len(keys), np.int64)
    place[codes] = np.arange(len(codes))
    return keys, place, codes, np.bincount(codes, minlength=len(keys))


def counts(texts: DataFrame) -> DataFrame:
    """How often each n-gram of the highest order occurs in all texts: a, b, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _ in _blocks(batch.column(0).to_pylist()):
                _, place, _, n = _distinct(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[place]), pa.array(b[place]), pa.array(n)], ["a", "b", "n"])

    return arrow_map(texts.select("text"), run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> tuple[Column, Column]:
    return tuple(F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(("a", "b"), _MASKS[order], strict=True))


def _context() -> tuple[Column, Column]:
    """An n-gram without its last character."""
    last = F.shiftleft(F.col("a").bitwiseAND(F.lit(_ONE).cast("long")), 2 * _BITS)
    return F.shiftright("a", _BITS), F.shiftright("b", _BITS).bitwiseOR(last)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 0, 1, 2, 3 and more, from the counts of counts; where these are lacking, from the nearest that isn't."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") >= 3, d[3]).when(F.col("n") == 2, d[2]).when(F.col("n") == 1, d[1]).otherwise(0.0)


def model(gram_counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """By order, from 1: the n-grams with their count less its discount (a, b, rest), and their contexts (a, b, total, freed)."""
    levels = {ORDER: gram_counts}
    for m in range(ORDER - 1, 0, -1):
        a, b = _suffix(m)
        levels[m] = written(levels[m + 1].groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")), f"grams-{m}")
    few = None
    for m, rows in levels.items():
        part = rows.where("n <= 4").groupBy(F.lit(m).alias("m"), "n").agg(F.count(F.lit(1)).alias("k"))
        few = part if few is None else few.unionByName(part)
    of = {(r.m, r.n): r.k for r in few.collect()}
    out = []
    for m in range(1, ORDER + 1):
        d = _discount(_discounts(*(of.get((m, n), 0) for n in (1, 2, 3, 4))))
        a, b = _context()
        contexts = levels[m].groupBy(a.alias("a"), b.alias("b")).agg(F.sum("n").alias("total"), F.sum(d).alias("freed"))
        out.append((levels[m].select("a", "b", (F.col("n") - d).alias("rest")), contexts))
    return out


def probabilities(grams: DataFrame, gram_counts: DataFrame) -> DataFrame:
    """grams: distinct a, b. Returns a, b, log_p under the model of these counts."""
    orders = model(gram_counts)
    seen = orders[0][0].count()
    levels = {ORDER: grams}
    for m in range(ORDER - 1, 0, -1):
        a, b = _suffix(m)
        levels[m] = written(levels[m + 1].select(a.alias("a"), b.alias("b")).distinct(), f"asked-{m}")
    lower = None
    for m in range(1, ORDER + 1):
        known, contexts = orders[m - 1]
        (ca, cb), (sa, sb) = _context(), _suffix(max(m - 1, 1))
        rows = levels[m].join(known, ["a", "b"], "left").select("a", "b", "rest", ca.alias("ca"), cb.alias("cb"), sa.alias("sa"), sb.alias("sb"))
        rows = rows.join(contexts.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "total", "freed"), ["ca", "cb"], "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / (seen + 1)))
        else:
            rows = rows.join(lower.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("below")), ["sa", "sb"])
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"))
        lower = written(rows.select("a", "b", p.alias("p")), f"probabilities-{m}")
    return lower.select("a", "b", F.log("p").alias("log_p"))


def _digest() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _scored_here(docs: DataFrame, log_p: DataFrame, name: str) -> DataFrame:
    """Every text is scored where it is read, from all probabilities."""

    def packed() -> tuple[np.ndarray, np.ndarray]:
        t = log_p.toArrow()
        key = _key(t.column("a").to_numpy(), t.column("b").to_numpy())
        order = np.argsort(key)
        return key[order], t.column("log_p").to_numpy()[order].astype(np.float32)

    shared, at = docs.sparkSession.sparkContext.broadcast(packed()), docs.columns.index("text")
    keep, places = others(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, owner in _blocks(batch.column(at).to_pylist()):
                key, _, codes, _ = _distinct(a, b)
                total += np.bincount(owner, values[np.searchsorted(known, key)][codes], batch.num_rows)
                size += np.bincount(owner, minlength=batch.num_rows)
            out = np.exp(-total / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(out, mask=size == 0)], [*(f.name for f in keep), name])

    return arrow_map(docs, run, T.StructType([*keep, T.StructField(name, T.DoubleType())]))


def _scored_apart(docs: DataFrame, log_p: DataFrame, name: str) -> DataFrame:
    """Every text sends its n-grams to the probabilities. Sums are by the text's digest, and a mean is the same over copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b, _ in _blocks([text]):
                    _, place, _, n = _distinct(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(n), pa.binary()), pa.array(a[place]), pa.array(b[place]), pa.array(n)], ["digest", "a", "b", "n"])

    asked = arrow_map(docs.select(_digest().alias("digest"), "text"), run, "digest binary, a long, b long, n long")
    sums = asked.join(log_p, ["a", "b"]).groupBy("digest").agg((F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("mean"))
    sums = written(sums, "sums")
    keep, places = others(docs, name)
    rows = docs.select(F.struct(*(F.col(f"`{docs.columns[i]}`") for i in places)).alias("row"), _digest().alias("digest"))
    return rows.join(sums, "digest", "left").select("row.*", F.exp(-F.col("mean")).alias(name))


def with_perplexity(docs: DataFrame, gram_counts: DataFrame, name: str = "perplexity", most: int = BROADCAST) -> DataFrame:
    """docs with the perplexity per character of each whole text in a new column, null without n-grams; needs a column text. A name that is taken gets the new
    meaning."""
    asked = written(counts(docs).select("a", "b"), "asked")
    log_p = probabilities(asked, gram_counts)
    return (_scored_here if log_p.limit(most + 1).count() <= most else _scored_apart)(docs, log_p, name)


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scored: lang, perplexity of trusted documents. Returns lang, known, threshold; known is false in the one row for all languages."""
    bins = scored.where("perplexity IS NOT NULL").groupBy("lang", F.ceil(F.log("perplexity") / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("known", F.lit(True)).unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "known": F.lit(False)}))
    of = Window.partitionBy("lang", "known")
    upto = F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    enough = bins.withColumns({"upto": upto, "all": F.sum("n").over(of)}).where(F.col("upto") >= quantile * F.col("all"))
    return enough.groupBy("lang", "known").agg(F.exp(F.min("bin") * STEP).alias("threshold"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, most: int = BROADCAST) -> DataFrame:
    """docs: doc_id, text, lang. trusted: doc_id. Returns doc_id, lang, perplexity, threshold, kept."""
    ids = small(written(trusted.select("doc_id").distinct(), "trusted"))
    own = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").where(~held_out(F.col("doc_id")))
    found = written(counts(own), "grams")
    scored = written(with_perplexity(docs.select("doc_id", "lang", "text"), found, most=most).drop("text"), "perplexity")
    of_trusted = written(scored.join(ids, "doc_id", "left_semi"), "of-trusted")
    apart = of_trusted.where(held_out(F.col("doc_id")) & F.col("perplexity").isNotNull())
    limits = written(thresholds(apart if apart.limit(1).count() else of_trusted, quantile), "thresholds")
    by_lang = small(limits.where("known").select(F.col("lang").alias("__lang"), "threshold"))
    every = limits.where("NOT known").select("threshold").first()
    rows = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce("threshold", F.lit(every.threshold if every else None).cast("double"))
    kept = F.col("perplexity").isNotNull() & (F.coalesce(limit, F.col("perplexity")) >= F.col("perplexity"))
    return rows.select("doc_id", "lang", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return judged(table(spark, sf_dir, "documents"), trusted)
