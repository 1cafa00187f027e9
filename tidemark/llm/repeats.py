"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts anywhere else are removed.

Prefix doubling sorts pairs of ranks at growing offsets until a rank is unique or its prefix is long enough. Over every byte of a corpus that is a row
per byte and round. Here the positions are a sparse, content-chosen set, and the rounds are three:

1. Of every WINDOW neighbouring positions the one whose eight bytes hash lowest is an anchor; equal strings have equal anchors. A string of LENGTH bytes
   has its first anchor at some offset x < WINDOW, so that it holds the CORE bytes from there on whatever x is.
2. An anchor's rank is that of its half core, paired with that of the half core one offset further: the rank of the whole core. Ranks are fingerprints, so
   they need no numbering. Spark counts equal pairs, summed before the shuffle; anchors with a unique pair drop out and with them every string they head.
3. For the others the offset grows to both sides: positions are sorted by rank pair, and for each x the pair is extended by the x bytes before the anchor
   and those up to LENGTH after the core. A string whose extended rank is not unique is a repeat; neighbouring ones merge to spans.

Passages are found along with it: runs of WORDS words, whatever white space parts them, that another document has too. They take the same rounds by words
instead of bytes: of every WORDS - GRAM + 1 neighbouring runs of GRAM words the one that hashes lowest is an anchor, its hash is its rank, and for shared
ranks the runs of WORDS words around the anchor are compared. They are reported beside what is removed, and remove nothing.

Heavy groups of whole-text copies are settled first, by verified winners that are broadcast; one copy of each stays among the texts to compare with. A
core that more than HOT positions share is extended with one row per string and sums before the shuffle, so that it never meets in one task. Shuffle
files of a step go when its table is written, tables of the shared folder when nothing reads them any more.

All ranks are 64-bit fingerprints. That two different strings of a corpus share one is as likely as n * n / 2**65 for n compared strings: 4e-4 for the
1e8 anchors of 10 GB. A wrong match of cores is undone by the extension, whose fingerprints are compared within a core only.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows are copies of each other; doc_id is only carried along, null
or not; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup
from tidemark.llm.common import arrow_map, release, table, written

LENGTH, WINDOW, HOT = 400, 192, 50_000
#: Words of a passage, and of the runs that its anchors are chosen from.
WORDS, GRAM = 51, 8

_GRAM, _SEGMENT, _PAIR = 8, 1 << 20, ["r1", "r2"]
#: Runs of words that are sorted at once.
_SORTED = 1 << 18
#: The second rank of anchors by words.
_BY_WORDS = -51
_LONG_WORD = 1 << 12
_SPACES = np.isin(np.arange(256), [*range(9, 14), 32])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Fingerprints of substrings modulo 2**64: each byte becomes a random number, positions weigh by powers of an odd base."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.of = r.integers(0, 1 << 64, 256, np.uint64)
        self.base = np.uint64(int(r.integers(0, 1 << 62)) * 4 + 3)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            for name, b in (("powers", self.base), ("inverse", self.back)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sums(self, text: np.ndarray) -> np.ndarray:
        self.grow(len(text) + 1)
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.of[text] * self.powers[: len(text)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        return (sums[start + length] - sums[start]) * self.inverse[start]


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    """One per Python worker; the same numbers in each."""
    return Hasher()


def _lowest(text: np.ndarray, window: int, count: int) -> np.ndarray:
    """For each of the first `count` windows the position of the gram that hashes lowest, of equals the first."""
    grams = np.ndarray((len(text) - _GRAM + 1,), "<u8", text, strides=(1,)) * _MIX
    grams ^= grams >> np.uint64(29)
    grams *= _MIX
    return _least(grams, window, count)


def _least(hashes: np.ndarray, window: int, count: int) -> np.ndarray:
    """For each of the first `count` windows the position of the least hash by its upper half, of equals the first."""
    m = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < window:
        m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
    return (m[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(text: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchors of a text: their positions, the least and greatest x at which they are the first anchor of a string, and the rank pair of their core."""
    core = length - window + 1
    half = (core + 1) // 2
    out: list[tuple[np.ndarray, ...]] = []
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(text) - length + 1, _SEGMENT):
        part = np.ascontiguousarray(whole[at : at + _SEGMENT + length - 1])
        n = len(part) - length + 1
        first = _lowest(part, window, n)
        cut = np.flatnonzero(np.diff(first)) + 1
        low, high = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
        a, h = first[low], hasher()
        sums = h.sums(part)
        out.append((a + at, low + at, high + at, h.at(sums, a, half), h.at(sums, a + core - half, half)))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    a, low, high, r1, r2 = (np.concatenate(x) for x in zip(*out, strict=True))
    again = np.concatenate([[False], a[1:] == a[:-1]])  # an anchor at a segment's edge
    last = np.concatenate([np.flatnonzero(~again)[1:], [len(a)]]) - 1
    return a[~again], a[~again] - high[last], a[~again] - low[~again], r1[~again], r2[~again]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, and their fingerprints."""
    whole, h = np.frombuffer(text, np.uint8), hasher()
    edge = np.diff(np.concatenate([[True], _SPACES[whole], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(end - start > _LONG_WORD)
    for i in long.tolist():
        out[i] = int.from_bytes(blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    for lo, hi in zip([0, *(long + 1)], [*long, len(start)], strict=True):
        while lo < hi:
            to = min(hi, int(np.searchsorted(start, start[lo] + _SEGMENT)))
            base = start[lo]
            sums = h.sums(whole[base : end[to - 1]])
            out[lo:to] = h.at(sums, start[lo:to] - base, end[lo:to] - start[lo:to])
            lo = to
    out ^= out >> np.uint64(31)
    return start, end, out * _MIX


def _runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = hasher()
    h.grow(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * h.powers[: len(words)], out=sums[1:])
    out = h.at(sums, np.arange(len(words) - n + 1), n)
    out ^= out >> np.uint64(29)
    return out * _MIX


def word_anchors(text: bytes, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The same by words: the anchors' places among the words, how many words before them the runs begin that they head, and their rank pair."""
    _, _, h = word_hashes(text)
    n = len(h) - words + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    ranks = _runs_of(h, gram)
    first = _least(ranks, words - gram + 1, n)
    cut = np.flatnonzero(np.diff(first)) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
    a = first[low]
    return a, a - high, a - low, ranks[a], np.full(len(a), _BY_WORDS, np.int64).view(np.uint64)


def _ranked(texts: DataFrame, length: int, window: int, words: int) -> DataFrame:
    """texts: key, text. Returns key, a, x1, x2 and the rank pair, for every anchor by bytes and by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                found = [f(x, *how) for x in ((x.as_py() or "").encode() for x in some.column(1)) for f, how in ((anchors, (length, window)), (word_anchors, (words,)))]
                owner = np.repeat(np.arange(len(found)) // 2, [len(f[0]) for f in found])
                a, x1, x2, r1, r2 = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner)), pa.array(a.astype(np.int32)), pa.array(x1.astype(np.int16)), pa.array(x2.astype(np.int16)), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64))],
                    ["key", "a", "x1", "x2", "r1", "r2"],
                )

    return arrow_map(texts.select("key", "text"), run, "key binary, a int, x1 short, x2 short, r1 long, r2 long")


def _contexts(rows: DataFrame, length: int, window: int, words: int) -> DataFrame:
    """rows: key, text, found (anchors that are left). Adds the bytes before each anchor and after its core; for anchors by words the fingerprints of the
    runs that they head, and where these begin and end in the text."""
    core = length - window + 1

    def around(text: bytes, anchors: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        runs = None
        for a, x1, x2, r2 in anchors:
            if r2 != _BY_WORDS:
                yield text[max(0, a - window + 1) : a], text[a + core : a + length]
            else:
                if runs is None:
                    start, end, h = word_hashes(text)
                    runs, ends = _runs_of(h, words), np.stack([start[: len(h) - words + 1], end[words - 1 :]], 1).astype(np.int32)
                yield runs[a - x2 : a - x1 + 1].tobytes(), ends[a - x2 : a - x1 + 1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                found = some.column(2)
                flat, size = found.flatten(), found.value_lengths().to_numpy()
                anchors, k = list(zip(*(flat.field(c).to_pylist() for c in ("a", "x1", "x2", "r2")), strict=True)), 0
                left, right = [], []
                for x, n in zip(some.column(1), size, strict=True):
                    for before, after in around((x.as_py() or "").encode(), anchors[k : k + n]):
                        left.append(before)
                        right.append(after)
                    k += n
                owner = np.repeat(np.arange(some.num_rows), size)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner)), *(flat.field(c) for c in ("a", "x1", "x2", "r1", "r2", "n")), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    ["key", "a", "x1", "x2", "r1", "r2", "n", "before", "after"],
                )

    return arrow_map(rows.select("key", "text", "found"), run, "key binary, a int, x1 short, x2 short, r1 long, r2 long, n long, before binary, after binary")


def _bytes(column: pa.Array, width: int, at_end: bool) -> np.ndarray:
    parts = column.to_pylist()
    fill = bytes.rjust if at_end else bytes.ljust
    return np.frombuffer(b"".join([fill(x, width, b"\0") for x in parts]), np.uint8).reshape(len(parts), width)


def _extended(before: np.ndarray, after: np.ndarray, salt: np.ndarray) -> Iterator[np.ndarray]:
    """For each x the extended ranks by row: of the x bytes before, the bytes after up to the length, and the salt (which tells rank pairs apart). One x at
    a time, since all of them take 1.5 KB a row, and a core may have HOT rows."""
    n, w = before.shape
    h = hasher()
    h.grow(2 * w + 3)
    before, after = np.ascontiguousarray(before.T), np.ascontiguousarray(after.T)
    own = salt * _MIX
    for j in range(w):
        own += h.of[after[j]] * h.powers[w + 1 + j]
    for x in range(w + 1):
        u = own ^ (own >> np.uint64(32))
        yield u * _MIX
        if x < w:
            own += h.of[before[w - 1 - x]] * h.powers[1 + x]
            own -= h.of[after[w - 1 - x]] * h.powers[2 * w - x]


def _runs(is_repeat: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """is_repeat by x and row. Returns row, start and end of each stretch of bytes that neighbouring x cover."""
    edge = np.diff(np.pad(is_repeat.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, a[row] - (high - 1), a[row] - low + length


def _repeated(extended: Iterator[np.ndarray], valid: np.ndarray) -> np.ndarray:
    """Where, by x, a valid extended rank occurs more than once."""
    out = np.zeros(valid.shape, bool)
    for x, u in enumerate(extended):
        own = np.flatnonzero(valid[x])
        if len(own) > 1:
            k = u[own]
            order = np.argsort(k)
            same = k[order[1:]] == k[order[:-1]]
            out[x, own[order[1:][same]]] = out[x, own[order[:-1][same]]] = True
    return out


def _valid(b: pa.RecordBatch | pa.Table, window: int) -> np.ndarray:
    x = np.arange(window)[:, None]
    return (x >= b.column("x1").to_numpy()) & (x <= b.column("x2").to_numpy())


def _shared(h: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs another document, or a copy of this one, has too."""
    order = np.lexsort((start, key, h))
    h, k, s = h[order], key[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    last = np.concatenate([head[1:], [len(h)]]) - 1
    copy = np.concatenate([[False], (h[1:] == h[:-1]) & (k[1:] == k[:-1]) & (s[1:] == s[:-1])])
    shared = (k[head] != k[last]) | (np.bincount(group, copy, len(head)) > 0)
    on = np.zeros(len(order), bool)
    on[order] = shared[group]
    return on


def _passages(b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """b: anchors by words. Row, start and end of each stretch of runs that another document, or a copy of this one, has too."""
    size = pa.compute.binary_length(b.column("before")).to_numpy() // 8
    row = np.repeat(np.arange(b.num_rows, dtype=np.int32), size)
    h = np.frombuffer(b"".join(b.column("before").to_pylist()), np.uint64)
    span = np.frombuffer(b"".join(b.column("after").to_pylist()), np.int32).reshape(-1, 2)
    key = b.column("key").combine_chunks().dictionary_encode().indices.to_numpy()[row]
    on, parts = np.zeros(len(h), bool), 1 + len(h) // _SORTED
    part = (h >> np.uint64(32)) % np.uint64(parts)
    for p in range(parts):  # equal runs are in one part
        own = np.flatnonzero(part == p)
        if len(own):
            on[own] = _shared(h[own], key[own], span[own, 0])
    begin = np.flatnonzero(on & np.concatenate([[True], (row[1:] != row[:-1]) | ~on[:-1]]))
    stop = np.flatnonzero(on & np.concatenate([(row[1:] != row[:-1]) | ~on[1:], [True]]))
    yield row[begin], span[begin, 0], span[stop, 1]


def _resolved(rows: DataFrame, length: int, window: int) -> DataFrame:
    """rows with contexts, cores of up to HOT positions. Returns key, start, end of repeats, and whether by words."""

    def by_bytes(b: pa.Table, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        u = _extended(_bytes(b.column("before"), window - 1, True), _bytes(b.column("after"), window - 1, False), salt)
        yield _runs(_repeated(u, _valid(b, window)), b.column("a").to_numpy(), length)

    def spans(t: pa.Table) -> Iterator[pa.RecordBatch]:
        r1, r2 = t.column("r1").to_numpy(), t.column("r2").to_numpy()
        salt = np.concatenate([[0], np.cumsum((r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]))]).astype(np.uint64)
        ends = np.concatenate([np.flatnonzero(np.diff(salt)) + 1, [len(salt)]])
        at = 0
        while at < len(salt):  # whole groups, about 8,192 rows at a time
            end = int(ends[min(np.searchsorted(ends, at + 8192), len(ends) - 1)])
            b, worded = t.slice(at, end - at).combine_chunks(), r2[at:end] == _BY_WORDS
            for which, find in ((np.flatnonzero(worded), _passages), (np.flatnonzero(~worded), lambda p, salt=salt[at:end][~worded]: by_bytes(p, salt))):
                if len(which):
                    part = b.take(pa.array(which)).combine_chunks()
                    for row, start, stop in find(part):
                        yield pa.RecordBatch.from_arrays(
                            [part.column("key").combine_chunks().take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(np.full(len(row), find is _passages))], ["key", "start", "end", "worded"]
                        )
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            r1, r2 = b.column("r1").to_numpy(), b.column("r2").to_numpy()
            other = np.flatnonzero((r1 != r1[-1]) | (r2 != r2[-1]))
            if len(other) and (len(other) >= 4096 or len(held) > 8):  # the last group may go on in the next batch
                cut = int(other[-1]) + 1
                yield from spans(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from spans(pa.Table.from_batches(held))

    return rows.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(run, "key binary, start int, end int, worded boolean")


def _resolved_hot(rows: DataFrame, length: int, window: int) -> DataFrame:
    """The same for cores of any number of positions: a row per string, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                u = np.stack(list(_extended(_bytes(s.column("before"), window - 1, True), _bytes(s.column("after"), window - 1, False), np.zeros(s.num_rows, np.uint64))))
                x, row = np.nonzero(_valid(s, window))
                start = s.column("a").to_numpy()[row] - x
                yield found(s, row, start, start + length, x, u[x, row].view(np.int64))

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                row = np.repeat(np.arange(s.num_rows), pa.compute.binary_length(s.column("before")).to_numpy() // 8)
                u, span = (np.frombuffer(b"".join(s.column(c).to_pylist()), t) for c, t in (("before", np.int64), ("after", np.int32)))
                yield found(s, row, span[0::2], span[1::2], np.full(len(row), -1), u)

    def found(s: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        cols = [*(s.column(c).take(pa.array(row)) for c in ("key", "r1", "r2")), *(pa.array(c.astype(np.int32)) for c in (start, end, x)), pa.array(u)]
        return pa.RecordBatch.from_arrays(cols, ["key", "r1", "r2", "start", "end", "x", "u"])

    schema = "key binary, r1 long, r2 long, start int, end int, x int, u long"
    each = rows.where(F.col("r2") != _BY_WORDS).mapInArrow(run, schema).unionByName(rows.where(F.col("r2") == _BY_WORDS).mapInArrow(worded, schema))
    one = each.groupBy("r1", "r2", "x", "u", "key", "start").agg(F.count(F.lit(1)).alias("k"))
    sums = one.groupBy("r1", "r2", "x", "u").agg(F.sum("k").alias("c"), F.max("k").alias("copies"), (F.min("key") != F.max("key")).alias("apart"))
    # written, so that both sides of the join are plain shuffles and hot strings can be split
    again = _settled(sums.where(F.when(F.col("r2") == _BY_WORDS, F.col("apart") | (F.col("copies") > 1)).otherwise(F.col("c") > 1)), "again")
    return each.join(again, ["r1", "r2", "x", "u"], "left_semi").select("key", "start", "end", (F.col("r2") == _BY_WORDS).alias("worded"))


def _settled(df: DataFrame, name: str) -> DataFrame:
    """`written`, whose shuffle files go as soon as the table stands. Else they stay until the driver collects its garbage and finds nothing that holds on
    to them; the next step's files come on top."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(rows: DataFrame, length: int, words: int) -> DataFrame:
    """rows: doc_id, text, copied (a heavy copy), spans. Returns doc_id, n_bytes, spans (removed, merged), kept (the bytes that are left), passages."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merged(spans: list[dict] | None, worded: bool) -> list[tuple[int, int]]:
        own = [s for s in spans or () if s["worded"] == worded]
        return _merged([s["start"] for s in own], [s["end"] for s in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                n, gone, left, passages = [], [], [], []
                for text, copied, spans in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns[1:]), strict=True):
                    raw = (text or "").encode()
                    whole = [(0, len(raw))]
                    out = (whole if len(raw) >= length else []) if copied else merged(spans, False)
                    inner = [(len(raw) - len(raw.lstrip()), len(raw.rstrip()))]
                    said = (inner if len(raw.split()) >= words else []) if copied else merged(spans, True)
                    kept, p = [], 0
                    for s, e in out:
                        kept.append(raw[p:s])
                        p = e
                    n.append(len(raw))
                    gone.append([{"start": s, "end": e} for s, e in out])
                    passages.append([{"start": s, "end": e} for s, e in said])
                    left.append(b"".join([*kept, raw[p:]]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1000), pa.array(n, pa.int64()), pa.array(gone, kind), pa.array(left, pa.binary()), pa.array(passages, kind)], ["doc_id", "n_bytes", "spans", "kept", "passages"]
                )

    return arrow_map(rows.select("doc_id", "text", "copied", "spans"), run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, passages array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """docs: doc_id, text. Returns per row doc_id, n_bytes, spans (what is removed), kept (the remaining bytes), passages (where runs of `words` words are
    that another document has too)."""
    if not _GRAM <= window <= length - _GRAM:
        raise ValueError("the window must leave room for a core")
    if words < GRAM:
        raise ValueError(f"a passage must have {GRAM} words at least")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))
    marks = _settled(docs.select(F.col("doc_id").alias("__id"), F.col("key").alias("__digest")), "marks")
    heavy = _settled(exact_dedup.winners(marks).select(F.col("__digest").alias("key"), F.col("__keep").alias("keep"), F.lit(True).alias("copied")), "heavy")
    docs = docs.join(F.broadcast(heavy), "key", "left")
    pool = docs.where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).where(F.octet_length("text") >= min(length, 2 * words - 1)).select("key", "text")

    ranked = _settled(_ranked(pool, length, window, words), "ranked")
    shared = _settled(ranked.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    release(marks)
    left = _settled(ranked.join(shared, _PAIR), "left")
    release(ranked, shared)
    # a set, so that copies of a text don't each bring the anchors of all
    found = left.groupBy("key").agg(F.collect_set(F.struct("a", "x1", "x2", "r1", "r2", "n")).alias("found"))
    near = _contexts(pool.join(found, "key"), length, window, words)
    is_hot = left.where(F.col("n") > hot).limit(1).count() > 0
    if is_hot:
        near = _settled(near, "contexts")
        release(left)
        spans = _settled(_resolved(near.where(F.col("n") <= hot), length, window).unionByName(_resolved_hot(near.where(F.col("n") > hot), length, window)), "spans")
        release(near)
    else:
        spans = _settled(_resolved(near, length, window), "spans")
        release(left)
    own = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end", "worded")).alias("spans"))
    alone = docs.where(F.col("copied").isNull()).join(own, "key", "left").select("doc_id", "text", "copied", "spans")
    copies = docs.where("copied").select("doc_id", "text", "copied", F.lit(None).cast("array<struct<start:int,end:int,worded:boolean>>").alias("spans"))
    return _cut(alone.unionByName(copies), length, words)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns n_passage: bytes in passages of over 50 words that another document has too, however few bytes these take."""
    out = without_repeats(table(spark, sf_dir, "documents"))

    def total(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

    return out.select("doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_passage"))
