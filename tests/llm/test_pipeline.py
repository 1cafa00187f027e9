import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

from tidemark.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        frames.append(out)
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [{r.doc_id: r.asDict() for r in f.collect()} for f in frames[:4]]
    assert all(any(c.isalpha() for c in rows[0][d]["text"]) != (d not in rows[1]) for d in rows[0])
    first = {}
    for d in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[1][d]["text"]), d)
    assert set(rows[2]) == set(first.values())
    items = [(d, brute_print(r["text"])) for d, r in rows[2].items()]
    assert set(rows[3]) == set(brute_components(items).values())
    taken = Counter(r.doc_id for r in frames[4].collect())
    plan = {r.doc_id: r for r in mixing.plan(frames[3]).collect()}
    assert all(taken[d] * r.size == r.taken for d, r in plan.items())
    t = Tokenizer.from_file(bpe.default_vocabulary())
    got = defaultdict(list)
    for r in frames[5].collect():
        got[r.doc_id].append(r)
    assert {d: len(x) for d, x in got.items()} == dict(taken)
    for d, x in got.items():
        text = rows[3][d]["text"]
        ids = t.encode(text, add_special_tokens=False).ids
        assert all(r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() for r in x)


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, size int, __fp string, score double, n int, spans int"
    text = "the cat sat on the mat and looked at the dog " * 4
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (None, text + "x", None, None, None), (3, "", "fr", "b", 0), (4, "!!", "fr", "b", 0), (5, "chat " * 30_000, "fr", None, 1), (6, text.upper(), "en", "a", 9)]
    docs = spark.createDataFrame([(*r, 1, 2, "f", 0.5, 3, 4) for r in rows], schema)
    for start in (docs, docs.limit(0)):
        frame = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
        assert {r.doc_id for r in out} <= {None, 1, 5, 6} and bool(out) == (start is docs)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == ["1", "1", "5", "6", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.exact(spark, docs, SF).collect()) == ["1", "2", "4", "5", "6", "None"]
    kept = [str(r.doc_id) for r in corpus_pipeline.near(spark, docs, SF).collect()]
    assert kept.count("1") == 1 and "6" not in kept and "3" not in kept


def test_near_copies_are_found_without_large_broadcasts(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "72m")  # a hash table of several columns takes a page of up to 64 MB, however few its rows are
    try:
        docs = spark.range(42_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id") % 40_000).alias("text"))
        assert tuple(corpus_pipeline.near(spark, docs, SF).agg(F.count("doc_id"), F.max("doc_id")).first()) == (40_000, 39_999)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
