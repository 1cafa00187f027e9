"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once, so that no token differs from those of the full text. Tokens' byte lengths give their character spans; an interval join
of spans with sections, both in rising order, finds each token's section, and tokens that cross a boundary are allocated by one of the rules

- `largest`: to the section with most of its characters, of equals the first;
- `first`: to the section where it begins;
- `shares`: to each section in proportion to its characters.

Sections are the lines of a text, each with its line feed, or what another separator ends. A byte of a character counts with that character, so a token
within one character belongs to the section of that character.

Defined cases: a null or empty text has one empty section without tokens; repeated rows are counted each on their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import Codec, codec, default_vocabulary
from tidemark.llm.common import arrow_map, table

RULES = ("largest", "first", "shares")


def sections(text: str, separator: str = "\n") -> np.ndarray:
    """Where the sections of a text end, in characters."""
    ends, at = [], text.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = text.find(separator, ends[-1])
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def spans(text: str, ids: list[int], c: Codec) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(c.lengths[ids])
    return char[ends - c.lengths[ids]], char[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section, and how many tokens of another section's reach into it or out of it."""
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
    n = len(ends)
    inside = a == b
    counts = np.bincount(a[inside], minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for i in np.flatnonzero(~inside):
        lo, hi = int(a[i]), int(b[i])
        share = np.minimum(ends[lo : hi + 1], last[i] + 1) - np.maximum(starts[lo : hi + 1], first[i])
        crossing[lo : hi + 1] += 1
        if rule == "shares":
            counts[lo : hi + 1] += share / share.sum()
        else:
            counts[lo if rule == "first" else lo + int(share.argmax())] += 1
    return counts, crossing


def by_section(docs: DataFrame, vocabulary: str, rule: str = "largest", separator: str = "\n") -> DataFrame:
    """Per section: doc_id, section (from 0), start, end (characters), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    kind = "double" if rule == "shares" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sizes, every_end, every_count, every_crossing = [], [], [], []
                for x in part.column(1):
                    text = x.as_py() or ""
                    ends, ids = sections(text, separator), c.encode(text)
                    counts, crossing = attribute(*spans(text, ids, c), ends, rule) if ids else (np.zeros(len(ends)), np.zeros(len(ends), np.int64))
                    sizes.append(len(ends))
                    every_end.append(ends)
                    every_count.append(counts)
                    every_crossing.append(crossing)
                n, end = np.array(sizes), np.concatenate(every_end)
                head = np.cumsum(n) - n
                start = np.concatenate([[0], end[:-1]])
                start[head] = 0
                owner = np.repeat(np.arange(len(n)), n)
                count = np.concatenate(every_count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(np.arange(len(end)) - head[owner]), pa.array(start), pa.array(end), pa.array(count if kind == "double" else count.astype(np.int64)), pa.array(np.concatenate(every_crossing))],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, f"doc_id long, section long, start long, end long, n_tokens {kind}, n_crossing long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_section(table(spark, sf_dir, "documents"), default_vocabulary())
