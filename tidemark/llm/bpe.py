"""BPE encoding and decoding with tree concatenation.

Two facts make pieces exact. The pre-tokeniser's pattern has a boundary wherever white space follows something else, whatever stands around it, so text
may be cut there. And within one pre-token, a token sequence is the encoding of its text if every two neighbours are what their own joint text encodes to;
so if a window over a join, encoded anew, begins with the very token that the left side has there and ends with the very token that the right side has
there, then left side, window and right side spliced together are the encoding of the whole.

A text is cut at such boundaries into pieces of about PIECE characters. What the pattern leaves unsplit for more than LEAF characters (a run of letters,
digits, signs or spaces) is halved until each leaf is short; leaves are encoded side by side, and joined pairwise up the tree, each join with a window
that doubles on both sides until both agree. At worst the window grows to the whole run, which is then plainly encoded.

Strings of special tokens in a text become those tokens, as the vocabulary file's own library has it. Decoding joins the tokens' bytes; what isn't
UTF-8 becomes U+FFFD.

Defined cases: a null text counts as empty and has no tokens; other columns are carried along unread; repeated rows are encoded each on their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, held, others, table

PIECE, LEAF, WINDOW, THREADS = 1 << 16, 1 << 11, 16, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        vocab = {bytes(letters[c] for c in k): v for k, v in data["model"]["vocab"].items() if k not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        merged = [data["model"]["vocab"]["".join(m)] for m in pairs]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids don't rise with its merges")
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.special = special
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.units = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for k, v in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[v] = k
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        ids, at = [], 0
        for m in self.marks.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.bpe.encode_ordinary(piece) if self._split(piece) else self._units(piece)
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        """text, cut at boundaries of white space into about PIECE characters each."""
        at = 0
        while len(text) - at > PIECE:
            m = self.cut.search(text, at + PIECE)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def _split(self, piece: str) -> bool:
        """Whether white space splits the piece at least every LEAF characters."""
        return max(map(len, piece.split(" "))) <= LEAF and " " * LEAF not in piece

    def _units(self, piece: str) -> list[int]:
        """Encodes a piece with long runs: what the pattern splits goes to the library together, long units go up the tree."""
        ids: list[int] = []
        waiting: list[str] = []
        for m in self.units.finditer(piece):
            if m.end() - m.start() > LEAF:
                ids += self._closed(waiting) + self.tree(m[0])
                waiting = []
            else:
                waiting.append(m[0])
        return ids + self._closed(waiting)

    def _closed(self, units: list[str]) -> list[int]:
        """Encodes units as they are; how white space at their end was split depends on what follows, so there each unit is encoded alone."""
        n = len(units)
        while n and units[n - 1].isspace():
            n -= 1
        ids = self.bpe.encode_ordinary("".join(units[:n]))
        for x in units[n:]:
            ids += self.bpe.encode_ordinary(x)
        return ids

    def tree(self, unit: str) -> list[int]:
        """The ids of one long unit, by halves."""
        leaves = [unit[i : i + LEAF] for i in range(0, len(unit), LEAF)]
        level = list(zip(leaves, self.bpe.encode_ordinary_batch(leaves, num_threads=THREADS), strict=True))
        while len(level) > 1:
            level = [self.join(*level[i], *level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][1]

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> tuple[str, list[int]]:
        """Splices two encodings of neighbouring texts of one unit."""
        reach = WINDOW
        while True:
            i, back = self._edge(left, reach, -1)
            j, ahead = self._edge(right, reach, 1)
            if i == 0 and j == len(right):
                return a + b, self.bpe.encode_ordinary(a + b)
            window = self.bpe.encode_ordinary((back + ahead).decode())
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return a + b, left[:i] + window + right[j:]
            reach *= 2

    def _edge(self, ids: list[int], reach: int, step: int) -> tuple[int, bytes]:
        """The last (step -1) or first tokens of ids, as many as reach and then to the next whole character: where they begin or end, and their bytes."""
        if step < 0:
            i = max(0, len(ids) - reach)
            while i > 0 and self.bytes_of[ids[i]][0] & 0xC0 == 0x80:
                i -= 1
            return i, b"".join(self.bytes_of[k] for k in ids[i:])
        j = min(len(ids), reach)
        while j < len(ids) and self.bytes_of[ids[j]][0] & 0xC0 == 0x80:
            j += 1
        return j, b"".join(self.bytes_of[k] for k in ids[:j])

    def decode(self, ids: list[int] | None) -> str:
        of = self.bytes_of
        return b"".join([of[k] for k in ids or ()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One per Python worker."""
    return held(("codec", path), lambda: Codec(path))


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text in a new column. A name that is taken gets the new meaning."""
    keep, places = others(docs, ids)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            new = pa.array([c.encode(x) for x in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), new], [*(f.name for f in keep), ids])

    return arrow_map(docs, run, T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids in a new column; a null list gives an empty text."""
    keep, places = others(rows, text)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            new = pa.array([c.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), new], [*(f.name for f in keep), text])

    return arrow_map(rows, run, T.StructType([*keep, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the ids and of the text they decode to, and on demand the ids. Encodes and decodes in one pass, so that ids needn't travel."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        sha, decimal = hashlib.sha256, c.decimal
        for b in batches:
            n, one, two, all_ids = [], [], [], []
            for x in b.column(1):
                ids = c.encode(x.as_py())
                n.append(len(ids))
                one.append(sha(",".join([decimal[k] for k in ids]).encode()).hexdigest())
                two.append(sha(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
            cols, names = [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array([0, *_running(n)], pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, schema)


def _running(n: list[int]) -> list[int]:
    out, s = [], 0
    for x in n:
        s += x
        out.append(s)
    return out


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
