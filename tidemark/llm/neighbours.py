"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Smallest Euclidean distance is greatest inner product once each vector carries half its squared norm: q.x - |x|^2 / 2. The norm is kept as it is; x is
product-quantised to four bits for every two dimensions, under a loss that counts the residual's part along x ETA times (what errs there errs in the
score). Codes are set by coordinate descent over the parts, code words by the normal equations of that loss.

The codebook is fitted on a bounded sample (the SAMPLE vectors of smallest hash); every vector is encoded, and keeps its residual's length and the part of
its residual along it, which is added to its scores. What then errs in the score of a vector x is (q - x).r, at most its distance to the query times the
length of its residual r. Queries are taken in blocks of about QUERIES; a block is broadcast (bounded), and every partition of codes is scanned with the
block's tables of partial scores: the exact distances in double precision of the RERANK best by score bound the k-th distance, and then every vector whose
score is within its error of that bound is reranked exactly, however many they are. Each partition gives k for a query, the best of all partitions count.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length than the
commonest in the sample; rows that share a vec_id count as one, at the nearest of their distances; a null vec_id takes no part; ties go to the smaller
vec_id; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SAMPLE, QUERIES, RERANK, K = 16_384, 4_096, 256, 10
WORDS, PART, ROUNDS, THRESHOLD = 16, 2, 8, 0.2

_SLAB = 1 << 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).where(F.exists(x, lambda v: v != 0))


def _padded(x: np.ndarray) -> np.ndarray:
    """Vectors by parts: rows, parts, PART; padded with zeros to an even number of parts, so that two codes fill a byte."""
    n, d = x.shape
    wide = -(-d // (2 * PART)) * 2 * PART
    return np.pad(x, ((0, 0), (0, wide - d))).reshape(n, -1, PART)


class Codebook:
    """Code words by part: words has parts, WORDS, PART."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.dim = sample.shape[1]
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = _padded(sample)
        r = np.random.default_rng(seed)
        self.words = np.stack([x[r.permutation(len(x))[np.arange(WORDS) % len(x)], p] for p in range(x.shape[1])])
        codes = self._nearest(x)
        for _ in range(ROUNDS):
            self._refit(x, codes, 1.0)
            codes = self._nearest(x)
        for _ in range(ROUNDS // 2):
            codes = self.encode(sample, codes)
            self._refit(x, codes, self.eta)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, p, None, :] - w) ** 2).sum(-1).argmin(1) for p, w in enumerate(self.words)], 1)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=(1, 2), keepdims=True)

    def _residual(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return x - np.stack([self.words[p][codes[:, p]] for p in range(x.shape[1])], 1)

    def _refit(self, x: np.ndarray, codes: np.ndarray, eta: float) -> None:
        """Code words that minimise the loss for these codes, part by part."""
        unit, res = self._unit(x), self._residual(x, codes)
        along = (res * unit).sum((1, 2))
        for p in range(x.shape[1]):
            u = unit[:, p]
            rest = along - (res[:, p] * u).sum(1)
            goal = x[:, p] + (eta - 1) * u * (rest + (x[:, p] * u).sum(1))[:, None]
            for k in range(WORDS):
                own = codes[:, p] == k
                if own.any():
                    m = own.sum() * np.eye(PART) + (eta - 1) * u[own].T @ u[own]
                    self.words[p, k] = np.linalg.solve(m, goal[own].sum(0))
            new = x[:, p] - self.words[p][codes[:, p]]
            along = rest + (new * u).sum(1)
            res[:, p] = new

    def encode(self, vectors: np.ndarray, start: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by vector and part."""
        x = _padded(vectors)
        codes = self._nearest(x) if start is None else start.copy()
        unit, res = self._unit(x), self._residual(x, codes)
        along = (res * unit).sum((1, 2))
        for _ in range(sweeps):
            for p, w in enumerate(self.words):
                u = unit[:, p]
                rest = along - (res[:, p] * u).sum(1)
                each = x[:, p, None, :] - w
                cost = (each**2).sum(-1) + (self.eta - 1) * (rest[:, None] + (each * u[:, None, :]).sum(-1)) ** 2
                codes[:, p] = cost.argmin(1)
                res[:, p] = each[np.arange(len(x)), codes[:, p]]
                along = rest + (res[:, p] * u).sum(1)
        return codes

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Partial scores of a query for every byte of two codes: bytes, 256."""
        part = np.einsum("pkd,pd->pk", self.words, _padded(query[None])[0])
        return (part[0::2, :, None] + part[1::2, None, :]).reshape(-1, WORDS * WORDS).astype(np.float32)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k greatest are; of equals those with smaller ids."""
    if len(score) <= k:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - k)[len(score) - k]
    over = np.flatnonzero(score > edge)
    level = np.flatnonzero(score == edge)
    need = k - len(over)
    return np.concatenate([over, level[np.argpartition(ids[level], need - 1)[:need]] if need < len(level) else level])


def fit(vectors: DataFrame, rows: int = SAMPLE) -> Codebook | None:
    """A hash bound lets through about twice the sample, however many partitions there are; of those the ones of smallest hash."""
    n = vectors.count()
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40)) / float(1 << 40)
    some = vectors.select("vec_id", "embedding", place.alias("place")).where(F.col("place") < 2.0 * rows / max(n, 1))
    found = [r.embedding for r in some.orderBy("place", "vec_id").limit(rows).select("embedding").collect()]
    if not found:
        return None
    (dim, _), *_ = sorted(Counter(map(len, found)).items(), key=lambda x: (-x[1], x[0]))
    return Codebook(np.array([x for x in found if len(x) == dim], np.float64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame, book: Codebook) -> DataFrame:
    """The code of every vector: vec_id, embedding, code (a byte for two parts), offset (what is added to its score), apart (the residual's length)."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(book), book.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                c = shared.value.encode(x)
                packed = (c[:, 0::2] * WORDS + c[:, 1::2]).astype(np.uint8)
                r = shared.value._residual(_padded(x), c)
                offset = (r * _padded(x)).sum((1, 2)) - (x**2).sum(1) / 2
                cols = [b.column(0), b.column(1), pa.array([v.tobytes() for v in packed], pa.binary()), pa.array(offset), pa.array(np.sqrt((r**2).sum((1, 2))))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "embedding", "code", "offset", "apart"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").where(F.size("embedding") == dim).mapInArrow(run, f"vec_id long, embedding {kind}, code binary, offset double, apart double")


def _nearest_of(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, each id once at its smallest distance; of equals those with smaller ids."""
    order = np.lexsort((ids, far))
    far, ids = far[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return far[keep], ids[keep]


def scan(codes: DataFrame, book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int = K, rerank: int = RERANK) -> DataFrame:
    """Each query's k nearest of every partition of codes by exact distance: query_id, vec_id, score."""
    shared = codes.sparkSession.sparkContext.broadcast((book, ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, ids, queries = shared.value
        tables: list[np.ndarray | None] = [None] * len(ids)
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            for at in range(0, b.num_rows, _SLAB):
                part = b.slice(at, _SLAB)
                own, x = part.column(0).to_numpy(), _matrix(part.column(1), book.dim)
                code = np.ascontiguousarray(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(own), -1).T)
                offset, apart = part.column(3).to_numpy(), part.column(4).to_numpy()
                size = np.sqrt((x**2).sum(1).max())
                for i, q in enumerate(queries):
                    if tables[i] is None:
                        tables[i] = book.tables(q)
                    score = offset.copy()
                    for lut, c in zip(tables[i], code, strict=True):
                        score += lut[c]
                    score[own == ids[i]] = -np.inf

                    def add(some: np.ndarray, i: int = i, q: np.ndarray = q) -> None:
                        far = np.sqrt(((x[some] - q) ** 2).sum(1))
                        top[i] = _nearest_of(np.concatenate([top[i][0], far]), np.concatenate([top[i][1], own[some]]), k)

                    some = _best(score, own, rerank)
                    add(some[score[some] > -np.inf])
                    edge = top[i][0][-1] if len(top[i][0]) == k else np.inf
                    half = (q**2).sum() / 2
                    slack = 1e-4 * (half + np.sqrt(2 * half) * size + size**2)  # single precision of the tables
                    close = np.flatnonzero((score > -np.inf) & (score + edge * apart + slack >= half - edge**2 / 2)) if edge < np.inf else np.flatnonzero(score > -np.inf)
                    for start in range(0, len(close), 4096):
                        add(close[start : start + 4096])
        for i in range(0, len(ids), 64):
            some = top[i : i + 64]
            if any(len(s) for s, _ in some):
                who = np.repeat(ids[i : i + 64], [len(s) for s, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([v for _, v in some])), pa.array(np.concatenate([s for s, _ in some]))], ["query_id", "vec_id", "score"])

    return codes.mapInArrow(run, "query_id long, vec_id long, score double")


def _first(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def nearest(vectors: DataFrame, is_query, k: int = K, rerank: int = RERANK, block: int = QUERIES) -> DataFrame:
    """For every row for which is_query (a Column) holds, its k nearest others: query_id, rank, vec_id, score."""
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    vectors = usable(vectors)
    book = fit(vectors)
    if book is None:
        return spark.createDataFrame([], empty)
    vectors = vectors.where(F.size("embedding") == book.dim)
    codes = written(index(vectors, book), "codes")
    queries = written(vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q")).dropDuplicates(["query_id"]), "queries")
    blocks = -(-queries.count() // block)
    found = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()
        if rows:
            part = scan(codes, book, np.array([r.query_id for r in rows], np.int64), np.array([r.q for r in rows], np.float64), k, max(rerank, k))
            part = written(part, "candidates") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], empty)
    exact = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _first(exact, [F.col("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
