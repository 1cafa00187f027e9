import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    return bpe.Codec(path), Tokenizer.from_file(path)


def same(both, text):
    ids = both[1].encode(text, add_special_tokens=False).ids
    assert both[0].encode(text) == ids
    assert both[0].decode(ids) == both[1].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a", "\n\n  a\t b", "it's 1st <|endoftext|>x<|endoftext|>", "naïve ＡＢ 😀 é", "\x1c\x85  x"])
def test_short_texts(both, text):
    same(both, text)


def test_long_unsplit_runs(both):
    r = random.Random(1)
    for alphabet in ("ab", "a", "  ", "é", "日本語文字", "😀a", "0123456789", "!?'-", "theingst"):
        for n in (2047, 2048, 2049, 5000, 9001):
            run = "".join(r.choice(alphabet) for _ in range(n))
            for text in (run, f"x {run} y", f"a \n{run}", f"a  {run}\n\n{run}", f"it's{run}'s"):
                same(both, text)


def test_long_mixed_text(both):
    r = random.Random(2)
    parts = ["the ", "ing", "\n", "  ", "é", "12", "...", "'s", "<|endoftext|>", "x" * 3000, " " * 2500, "\n \n"]
    for _ in range(8):
        same(both, "".join(r.choice(parts) for _ in range(400)))
    same(both, " ".join(r.choice(["alpha", "be", "…", "c9"]) for _ in range(60_000)))


def test_decode_of_broken_bytes(both):
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(20)]
        assert both[0].decode(ids) == both[1].decode(ids, skip_special_tokens=False)


def test_frames(spark, both):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (None, "zz" * 4000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decoded(bpe.encoded(docs, bpe.default_vocabulary()), bpe.default_vocabulary())
    got = sorted(out.select("doc_id", "ids", "decoded").collect(), key=str)
    want = sorted(((d, both[1].encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in rows), key=lambda x: str(x))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(docs.limit(0), bpe.default_vocabulary(), True).count() == 0
    assert [r.n_tokens for r in bpe.round_trip(docs, bpe.default_vocabulary(), True).where("doc_id = 1").collect()] == [2]


def test_query_against_the_library(spark, both):
    import hashlib

    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op1_bpe(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = both[1].encode(text, add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False)))
