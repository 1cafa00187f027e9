import os
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import repeats
from tidemark.plans.storage import scratch


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(r):
            if gone[i]:
                j = i
                while j < len(r) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(r), spans, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def brute_passages(texts, words):
    """Bytes of runs of words that another text, or a copy, has too."""
    import re

    owners, runs = {}, []
    for i, t in enumerate(texts):
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        own = [(tuple((t or "").encode()[a:b] for a, b in found[k : k + words]), found[k][0], found[k + words - 1][1]) for k in range(len(found) - words + 1)]
        runs.append(own)
        for w, *_ in own:
            owners.setdefault(w, set()).add(i)
    out = []
    for own in runs:
        on = set()
        for w, a, b in own:
            if len(owners[w]) > 1:
                on.update(range(a, b))
        out.append(len(on))
    return out


def corpus(r, n, alphabet="abcdé \n"):
    passages = ["".join(r.choice(alphabet) for _ in range(r.randrange(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 8)):
            p = r.choice(passages)
            parts.append(r.choice([p, p[r.randrange(len(p)) :], p[: r.randrange(1, len(p))], "".join(r.choice(alphabet) for _ in range(r.randrange(150)))]))
        texts.append("".join(parts))
    return [*texts, texts[0], texts[0], "", None, "x" * 500, "ab" * 300, texts[1] * 3]


def check(spark, texts, length, window, hot=repeats.HOT, words=repeats.WORDS):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, key int, n int")
    rows = repeats.without_repeats(docs, length, window, hot, words).collect()
    got = {x.doc_id: (x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in rows}
    want = brute(texts, length)
    assert got == dict(enumerate(want))
    passages = {x.doc_id: sum(e - s for s, e in x.passages) for x in rows}
    assert passages == dict(enumerate(brute_passages(texts, words)))
    return passages


def test_anchors_head_every_string():
    r = random.Random(10)
    for n in (400, 401, 900, 5000):
        text = "".join(r.choice("ab \n") for _ in range(n)).encode()
        a, x1, x2, _, _ = repeats.anchors(text)
        heads = np.concatenate([np.arange(p - hi, p - lo + 1) for p, lo, hi in zip(a, x1, x2)])
        assert sorted(heads.tolist()) == list(range(n - 399))
        assert len(set(a.tolist())) == len(a) and x1.min() >= 0 and x2.max() < repeats.WINDOW


def test_segments_change_nothing(monkeypatch):
    r = random.Random(11)
    text = "".join(r.choice("abc") for _ in range(4000)).encode()
    want = repeats.anchors(text)
    monkeypatch.setattr(repeats, "_SEGMENT", 300)
    for a, b in zip(repeats.anchors(text), want):
        assert (a == b).all()


@pytest.mark.parametrize("seed, length, window", [(0, 60, 24), (1, 40, 32), (2, 60, 8)])
def test_against_brute_force(spark, seed, length, window):
    check(spark, corpus(random.Random(seed), 60), length, window)


def test_hot_cores_give_the_same(spark):
    check(spark, corpus(random.Random(3), 40, "abc"), 60, 24, hot=3)
    assert any(check(spark, corpus(random.Random(5), 40), 60, 24, hot=1, words=9).values())


def peak(f):
    """What f() gives, and the MB it takes at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_core_that_many_share_takes_little_memory():
    r, n, w = np.random.default_rng(1), repeats.HOT, repeats.WINDOW - 1
    before, after = r.integers(0, 256, (2, n, w), np.uint8)
    before[1], after[1] = before[0], after[0]
    found, most = peak(lambda: repeats._repeated(repeats._extended(before, after, np.zeros(n, np.uint64)), np.ones((w + 1, n), bool)))
    assert found[:, :2].all() and not found[:, 2:].any()
    assert most < 80


def test_a_run_that_many_share_takes_little_memory():
    r, n, k = np.random.default_rng(2), 20_000, repeats.WORDS - repeats.GRAM + 1
    h = r.integers(0, 1 << 63, (n, k), np.uint64)
    h[7, 3:9] = h[5, 2:8]
    span = np.stack([np.tile(np.arange(k), (n, 1)), np.tile(np.arange(k) + 9, (n, 1))], 2).astype(np.int32)
    b = pa.table({"key": [b"%d" % i for i in range(n)], "before": [x.tobytes() for x in h], "after": [x.tobytes() for x in span]}).combine_chunks()
    found, most = peak(lambda: [[tuple(map(int, x)) for x in zip(*f, strict=True)] for f in repeats._passages(b)])
    assert found == [[(5, 2, 16), (7, 3, 17)]]
    assert most < 60


def test_finished_steps_leave_no_files(spark, monkeypatch):
    home, seen = f"{scratch(spark).removeprefix('file://')}/tables-{spark.sparkContext.applicationId}", []
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        shuffles = {"_".join(x.split("_")[:2]) for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
        return shuffles | (set(os.listdir(home)) if os.path.isdir(home) else set())

    def resolved(*how, plain=repeats._resolved):
        for _ in range(50):  # files go in the background
            if len(left := files() - before) > 2:
                time.sleep(0.1)
        seen.append(sorted(x.split("-")[0] for x in left))
        return plain(*how)

    before = files()
    monkeypatch.setattr(repeats, "_resolved", resolved)
    check(spark, corpus(random.Random(3), 40, "abc"), 60, 24, hot=3)
    assert seen == [["contexts", "heavy"]]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_passages_are_runs_of_words(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 6)))
    passage = [word() for _ in range(51)]
    other = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(r.randrange(80))] + passage + [word() for _ in range(r.randrange(80))]) for _ in range(4)]
    texts += ["\n".join(passage), " ".join(passage[:50]), " ".join(other + ["x"] + other), "z" * 9000 + " " + " ".join(passage[1:]), " ".join(other[:9] * 20), " ".join(other[:9] * 20)]
    found = check(spark, texts, repeats.LENGTH, repeats.WINDOW)
    assert all(found[i] for i in (0, 1, 2, 3, 4, 8, 9)) and not any(found[i] for i in (5, 6, 7))


def test_query_against_brute_force(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    texts = [t for _, t in rows]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in repeats.op4_repeats(spark, sf).collect()}
    want = zip(brute(texts, 400), brute_passages(texts, 51))
    assert got == {d: (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), p) for (d, _), ((n, spans, kept), p) in zip(rows, want)}
    assert any(r[1] for r in got.values())


def test_rows_without_ids_are_rows(spark):
    line = "some words that stand here " * 20
    docs = spark.createDataFrame([(None, line), (None, line), (1, "short"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in repeats.without_repeats(docs).collect())
    assert got == [("1", 5, 5), ("2", 0, 0), ("None", len(line), 0), ("None", len(line), 0)]


def test_production_length(spark):
    r = random.Random(4)
    line = "".join(r.choice("theino ") for _ in range(450))
    texts = ["".join(r.choice("theino ") for _ in range(r.randrange(600))) + line[r.randrange(60) :] + str(i) for i in range(40)]
    check(spark, [*texts, *["copy " * 200] * 30, None, "short"], repeats.LENGTH, repeats.WINDOW)


def test_empty(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
