"""Language ID by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases that occur in that text; the fewer
phrases per letter, the closer the language. The language that needs fewest wins; of equals, the first by code point.

The automata are fitted on a bounded sample, whose bounds are arguments: per language at most `rows` documents of smallest hash (those of up to `long`
characters first), no more of them than have `train` letters, `train` symbols of them at most, and `states` symbols over all languages. The prediction
itself reads every whole text: its letters of any script, in lower case, other characters as one space, in blocks of BLOCK symbols side by side; a phrase
ends with its block, for each language alike. Letters that aren't among the sample's commonest are spelled by three symbols each, so that rarer scripts
don't collapse.

Defined cases: a null text, or one without letters, is `und` with score 0, and so is any text if nothing is labelled; a null language teaches nothing, a
blank one is a language; repeated rows are predicted each on their own; a column that has the name of a new one gives way to it. The score is
1 - fewest / second fewest phrases, and 1 if there is one language only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, held, others, small, table, written

ROWS, LONG, TRAIN, STATES, BLOCK, FOLDS, OVER = 200, 20_000, 48_000, 480_000, 1024, 5, 4
UNKNOWN = "und"

#: Symbols of an automaton: a space, the commonest letters of the sample, _NIBBLES to spell other letters with; and one that fills up blocks.
_LETTERS, _NIBBLES, _LANES = 44, 16, 1 << 13
_SPELLED = 255


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def sample(docs: DataFrame, rows: int = ROWS, train: int = TRAIN, long: int = LONG) -> list[tuple[str, str]]:
    """The labelled texts to learn from, by language: `rows` of each at most, and none once those before it have `train` letters. What a language sends to
    the driver is so at most 3 * train characters and what stands between train letters, and no cut of it would have been used.

    Documents are counted by language first. Of a language only those travel whose hash is below a bound that lets through about OVER * rows, however many
    partitions there are."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    usable = usable.select("lang", "doc_id", "text", (F.length("text") > long).alias("is_long"), place.alias("place"))
    sizes = usable.groupBy("lang", "is_long").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("is_long").rowsBetween(-1, -1)), F.lit(0))
    bound = written(sizes.withColumn("before", before).where(F.col("before") < rows).select("lang", "is_long", (F.lit(float(OVER * rows)) / F.col("n")).alias("bound")), "bounds")
    order = Window.partitionBy("lang").orderBy("is_long", "place", "doc_id")
    some = usable.join(small(bound), ["lang", "is_long"]).where(F.col("place") < F.col("bound"))
    first = some.select("lang", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= rows)
    first = first.select("lang", "n", F.substring("text", 1, 2 * train).alias("text"))
    before = F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    enough = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < train)
    return [(r.lang, r.text) for r in enough.select("lang", "n", "text").orderBy("lang", "n").collect()]


def _letters(texts: list[str]) -> str:
    counts = np.bincount(np.concatenate([np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]), minlength=128)
    common = [chr(k) for k in np.argsort(-counts, kind="stable")[: 4 * _LETTERS] if counts[k] and chr(k).isalpha()]
    return "".join(common[:_LETTERS])


def _symbols(letters: str) -> np.ndarray:
    """By code point: 0 for what is no letter, from 1 on the common letters, _SPELLED for others."""
    place = {c: i + 1 for i, c in enumerate(letters)}
    out = np.zeros(0x110000, np.uint8)
    for k in range(0x32400):  # no letters beyond
        c = chr(k)
        if c.isalpha():
            out[k] = place.get(c.lower()[0], _SPELLED)
    return out


def coded(text: str, symbols: np.ndarray, letters: int) -> np.ndarray:
    """The text as symbols; runs of other characters than letters are one 0; letters beside the `letters` common ones are three symbols after those."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    x = symbols[points]
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    x, points = x[keep], points[keep]
    rare = x == _SPELLED
    if not rare.any():
        return x
    size = np.where(rare, 3, 1)
    out, at = np.repeat(x, size), (np.cumsum(size) - size)[rare]
    for k in range(3):
        out[at + k] = letters + 1 + (points[rare] >> np.uint32(4 * k)) % _NIBBLES
    return out


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of text as a table by state and symbol, flat, states times width: where to go next; negative where a phrase ends and the
    next one begins with that symbol. The last symbol leaves every state as it is."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in text.tolist():
        cur = len(to)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(to)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(to[q].copy())
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    n = len(to)
    out = np.full((n + 1, width), -1, np.int32)
    for s, edges in enumerate(to):
        for c, q in edges.items():
            out[s, c] = q
    start = np.where(out[0] < 0, n, out[0])  # state n: after a symbol that the text lacks, a phrase of its own
    out[0] = start
    # states count from 1, so that the sign can tell
    out = np.where(out < 0, -(start + 1)[None, :], out + 1) * width
    out[:, width - 1] = np.arange(1, n + 2) * width
    return np.concatenate([np.zeros(width, np.int32), out.ravel()])


class Model:
    def __init__(self, texts: tuple[tuple[str, str], ...], train: int = TRAIN, states: int = STATES):
        self.langs = sorted({lang for lang, _ in texts})
        letters = _letters([t for _, t in texts]) if texts else ""
        self.symbols, self.letters, self.width = _symbols(letters), len(letters), len(letters) + _NIBBLES + 2
        most = min(train, states // max(1, len(self.langs)))
        self.tables = []
        for lang in self.langs:
            parts = [coded(t + " ", self.symbols, self.letters) for name, t in texts if name == lang]
            self.tables.append(automaton(np.concatenate(parts)[:most], self.width))

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """blocks: symbols by position and block. Phrases by language and block, without the last."""
        out = np.zeros((len(self.langs), blocks.shape[1]), np.int32)
        for k, t in enumerate(self.tables):
            state, count = np.full(blocks.shape[1], self.width, np.int32), out[k]
            for row in blocks:
                state = t.take(state + row)
                count += state < 0
                np.abs(state, out=state)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores, waiting, owners, held = [UNKNOWN] * len(texts), [0.0] * len(texts), [], [], 0
        total = np.zeros((len(self.langs), len(texts)), np.int64)

        def flush() -> None:
            if waiting:
                m = np.ascontiguousarray(np.concatenate(waiting).reshape(-1, BLOCK).T)
                own = np.concatenate(owners)
                for row, n in zip(total, self.phrases(m), strict=True):
                    row += np.bincount(own, n, len(texts)).astype(np.int64)
                waiting.clear()
                owners.clear()

        known = []
        for i, text in enumerate(texts):
            x = coded(text, self.symbols, self.letters) if text else None
            if x is None or not self.langs or not x.any():
                continue
            known.append(i)
            n = -(-len(x) // BLOCK)
            total[:, i] = n  # the last phrase of each block
            waiting.append(np.concatenate([x, np.full(n * BLOCK - len(x), self.width - 1, np.uint8)]))
            owners.append(np.full(n, i))
            held += n
            if held >= _LANES:
                flush()
                held = 0
        flush()
        for i in known:
            own = total[:, i]
            best = int(own.argmin())
            names[i] = self.langs[best]
            rest = np.delete(own, best)
            scores[i] = float(1 - own[best] / rest.min()) if len(rest) else 1.0
        return names, scores


def model(texts: tuple[tuple[str, str], ...], train: int, states: int) -> Model:
    """One per Python worker."""
    return held(("language", texts, train, states), lambda: Model(texts, train, states))


def with_language(docs: DataFrame, texts: list[tuple[str, str]], name: str = "lang_pred", score: str = "score", within: str | None = None, train: int = TRAIN, states: int = STATES) -> DataFrame:
    """docs with the predicted language and its score in two new columns; needs a column text, or a struct `within` that has it. texts: of `sample`."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(texts))
    at, (keep, places) = docs.columns.index(within or "text"), others(docs, name, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value, train, states)
        for b in batches:
            text = b.column(at).field("text") if within else b.column(at)
            names, scores = m.predict(text.to_pylist())
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), *new], [*(f.name for f in keep), name, score])

    return arrow_map(docs, run, T.StructType([*keep, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told; all columns stay. Learns from the labelled rows of docs; if there are none, texts with letters stay."""
    texts = sample(docs)
    if not texts:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return with_language(docs.select(F.struct("*").alias("row")), texts, within="row").where(F.col("lang_pred") != UNKNOWN).select("row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", "text"), sample(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
