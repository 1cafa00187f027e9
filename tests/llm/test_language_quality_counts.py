import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, quality, token_counts

SF = "/root/testdata/sf0.001"


def longest_phrases(text, corpus):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in corpus:
            j += 1
        n, i = n + 1, j
    return n


def test_automaton_parses_into_longest_phrases():
    r = random.Random(8)
    for _ in range(60):
        corpus = bytes(r.choice([0, 1, 2, 3]) for _ in range(r.randrange(1, 80)))
        text = bytes(r.choice([0, 1, 2, 3, 4]) for _ in range(r.randrange(1, 60)))
        m = language.Model(())
        m.langs, m.width = ["x"], 6
        m.tables = [language.automaton(np.frombuffer(corpus, np.uint8), 6)]
        blocks = np.frombuffer(text + bytes([5] * 7), np.uint8)[:, None]
        assert m.phrases(blocks)[0, 0] + 1 == longest_phrases(text, corpus)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == want.keys() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == want[d] for d in held) >= 0.97 * len(held)


def test_language_edge_cases(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat " * 50, "en"), ("le chat " * 50, "fr")] * 10)]
    rows += [(90, None, "en", 1), (91, "", None, 1), (92, "12 !?", "fr", 1), (None, "the cat", None, 1), (93, "the cat " * 9000, None, 1), (93, "the cat " * 9000, None, 1), (95, "x", " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    frame = language.with_language(docs, language.sample(docs))
    assert frame.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = frame.collect()
    pred = defaultdict(set)
    for r in out:
        pred[r.doc_id].add(r.lang_pred)
    assert pred[90] == pred[91] == pred[92] == {"und"} and pred[93] == pred[None] == {"en"} and pred[1] == {"fr"} and pred[95] == {" "}
    assert {r.doc_id for r in language.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {*range(20), None, 93, 95}
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language.accepted(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.with_language(docs.withColumnRenamed("score", "LANG_PRED"), []).collect()} == {"und"}


def test_language_sample_is_bounded_and_loses_nothing_that_is_used(spark):
    rows = [(i, f"{'ab ' * 10}{i}", lang) for i in range(60) for lang in ("x", "y")] + [(99, "rare word", "z"), (100, "\U00030000" * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for rows in (language.ROWS, 6):
        full = {}
        for lang, text in language.sample(docs.repartition(3), rows, train=100):
            full.setdefault(lang, []).append(text)
        assert set(full) == {"x", "y", "z"} and len(full["x"]) == len(full["y"]) == 5 and full["z"] == ["rare word"]
        assert all(sum(map(str.isalpha, "".join(t[:-1]))) < 100 for t in full.values())
    long = docs.withColumn("text", F.when(F.col("doc_id") < 57, F.repeat("text", 40)).otherwise(F.col("text")))
    assert {len(t) for lang, t in language.sample(long, 3, train=10**6, long=100) if lang == "x"} == {32}
    assert {r.doc_id: r.lang_pred for r in language.with_language(docs, language.sample(docs)).collect()}[100] != "und"


def test_rare_scripts_are_told_apart(spark):
    r = random.Random(2)
    scripts = {"en": "thequickbrownfxjmpsvlazydg", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "zh": "".join(chr(0x4E00 + k) for k in range(400)), "ja": "".join(chr(0x6E00 + k) for k in range(400))}
    words = {k: ["".join(r.choice(v) for _ in range(r.randrange(1, 6))) for _ in range(60)] for k, v in scripts.items()}
    docs = spark.createDataFrame([(100 * j + i, " ".join(r.choice(words[k]) for _ in range(40)), k) for j, k in enumerate(scripts) for i in range(40)], "doc_id long, text string, lang string")
    got = language.with_language(docs, language.sample(docs)).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.99 * len(got)


def test_language_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 700")
    docs.limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    m = language.Model(tuple(language.sample(docs)))
    learned = {lang: b"".join(language.coded(t + " ", m.symbols, m.letters).tobytes() for x, t in language.sample(docs) if x == lang)[: language.TRAIN] for lang in m.langs}

    def phrases(x, corpus):
        n, i = 0, 0
        while i < len(x):
            end = min(len(x), (i // language.BLOCK + 1) * language.BLOCK)
            j = i + 1
            while j < end and x[i : j + 1] in corpus:
                j += 1
            n, i = n + 1, j
        return n

    got = {r.doc_id: r for r in language.op5_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        if not d.text or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = language.coded(d.text, m.symbols, m.letters).tobytes()
        n = {lang: phrases(x, learned[lang]) for lang in m.langs}
        best, second = sorted(n.values())[:2]
        assert n[r.lang_pred] == best and r.lang_pred == min(k for k in n if n[k] == best) and r.score == pytest.approx(1 - best / second)


def brute_symbols(text):
    return " " * 4 + re.sub(r"\s+", " ", text).removeprefix(" ") if text and not text.isspace() else ""


def brute_kneser_ney(texts):
    """Textbook formulas over strings: the perplexity of a text per character."""
    top = Counter(x[i : i + 5] for x in map(brute_symbols, texts) for i in range(len(x) - 4))
    levels = [top]
    for _ in range(4):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    of = [Counter(c.values()) for c in levels]
    discounts = [quality._discounts(*(o[k] for k in (1, 2, 3, 4))) for o in of]
    contexts = []
    for c, d in zip(levels, discounts):
        sums = defaultdict(lambda: [0, 0.0])
        for g, n in c.items():
            sums[g[:-1]][0] += n
            sums[g[:-1]][1] += d[min(n, 3)]
        contexts.append(sums)

    def p(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        k = len(gram) - 1
        total, freed = contexts[k].get(gram[:-1], (0, 0))
        if not total:
            return p(gram[1:])
        n = levels[k].get(gram, 0)
        return (n - discounts[k][min(n, 3)]) / total + freed / total * p(gram[1:])

    def perplexity(text):
        x = brute_symbols(text or "")
        return math.exp(-sum(math.log(p(x[i : i + 5])) for i in range(len(x) - 4)) / (len(x) - 4)) if x else None

    return perplexity


def test_slices_change_nothing(monkeypatch):
    text = "  one two \n three\t\u3000 été  " * 30
    whole = [tuple(x) for x in zip(*(c.tolist() for c in next(quality._blocks([text]))))]
    monkeypatch.setattr(quality, "_SLICE", 7)
    monkeypatch.setattr(quality, "_BLOCK", 100)
    assert [x for block in quality._blocks([text]) for x in zip(*(c.tolist() for c in block))] == whole


@pytest.mark.parametrize("most", [quality.BROADCAST, 0])
def test_model_against_textbook_formulas(spark, most):
    texts = ["the cat sat on the mat", "a cat, a  mat. the cat sat\n", "été 12 x the cat", "кот сидел на ковре и кот спал", None, " \n"]
    docs = spark.createDataFrame([(t, 1) for t in [*texts, "the cat sat", "zzz", "ковре на сидел", "кот", "ток", "\u3000😀", texts[0]]], "text string, PERPLEXITY int")
    out = quality.with_perplexity(docs, quality.counts(docs.limit(6)), most=most)
    assert out.columns == ["text", "perplexity"] and out.count() == docs.count()
    want = brute_kneser_ney([t for t in texts if t])
    got = [(r.text, r.perplexity) for r in out.collect()]
    assert all((v is None) == (want(t) is None) and v == (v and pytest.approx(want(t), rel=1e-5)) for t, v in got)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    perplexity = brute_kneser_ney([t for d, t, _ in docs if d in good and not fold(d)])
    want = {d: perplexity(t) for d, t, _ in docs}

    def limit(values):
        bins = sorted(math.ceil(math.log(v) / quality.STEP) for v in values)
        return math.exp(bins[math.ceil(quality.QUANTILE * len(bins)) - 1] * quality.STEP)

    apart = {d for d in good if fold(d) and want[d]}
    langs = {x for d, _, x in docs if d in apart}
    limits = {x: limit([want[d] for d, _, y in docs if d in apart and (y == x or x is ...)]) for x in [*langs, ...]}
    out = quality.op10_quality(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.perplexity == (want[r.doc_id] and pytest.approx(want[r.doc_id], rel=1e-5))
        assert r.threshold == pytest.approx(limits.get(r.lang, limits[...]), rel=2 * quality.STEP)
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold)
    assert sum(r.kept for r in out if r.doc_id in good) >= 0.9 * len(good)


def test_quality_keeps_trusted_and_drops_noise_in_any_script(spark):
    r = random.Random(9)
    scripts = {"en": "the cat sat on mat".split(), "ru": "кот сидел на ковре долго".split(), "zh": list("我们今天去看山水很好的人")}
    good = [(1000 * k + i, ("" if lang == "zh" else " ").join(r.choice(words) for _ in range(60)), lang, 1) for k, (lang, words) in enumerate(scripts.items()) for i in range(120)]
    noise = [(9000 + 100 * k + i, "".join(r.sample(x, len(x))), lang, 1) for k, lang in enumerate(scripts) for i in range(9) for x in [r.choice([t for _, t, y, _ in good if y == lang])]]
    noise = [(d, t if lang != "zh" else "".join(chr(0x4E00 + r.randrange(5000)) for _ in t), lang, 1) for d, t, lang, _ in noise]
    odd = [(20000, None, "en", 1), (20001, " \n", None, 1), (20002, "the cat sat", None, 1), (20002, "the cat sat", None, 1), (None, "the cat", "zz", 1), (20003, "the cat sat mat " * 20_000, "en", 1)]
    docs = spark.createDataFrame(good + noise + odd, "doc_id long, text string, lang string, threshold int")
    trusted = spark.createDataFrame([(d,) for d, *_ in good if d % 2] * 2 + [(None,)], "doc_id long")
    got = quality.judged(docs, trusted).collect()
    assert len(got) == docs.count()
    kept = Counter(x.doc_id for x in got if x.kept)
    assert sum(kept[d] for d, *_ in good) >= 0.9 * len(good) and not any(kept[d] for d, *_ in noise)
    assert not kept[20000] and not kept[20001] and [x.perplexity > 1 for x in got if x.doc_id == 20003] == [True]
    assert quality.judged(docs.limit(0), trusted).count() == 0
    assert all(x.kept == (x.perplexity is not None) for x in quality.judged(docs, trusted.limit(0)).collect())


def test_ties_at_the_threshold_are_kept(spark):
    docs = spark.createDataFrame([(i, "the same text for all of them", "en") for i in range(40)], "doc_id long, text string, lang string")
    assert all(x.kept for x in quality.judged(docs, docs.select("doc_id")).collect())


def test_counts_of_trusted_text_grow_with_it(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdefghijklmnop ") for _ in range(600))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = [quality.counts(docs.where(f"doc_id < {k}")).count() for k in (20, 200)]
    assert n[1] > 8 * n[0]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_against_offsets(spark, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["", "a b\nc", "\n\n\n", "naïve 😀\n\n x\n", "end\n\n\n\nof  \n y", None, "w " * 9000]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, section int")
    got = defaultdict(dict)
    for r in token_counts.by_section(docs, bpe.default_vocabulary(), rule).collect():
        got[r.doc_id][r.section] = (r.start, r.end, r.n_tokens)
    for i, x in enumerate(texts):
        x = x or ""
        ends = [k + 1 for k, c in enumerate(x) if c == "\n"]
        ends += [len(x)] * (not ends or ends[-1] < len(x))
        want = [0.0] * len(ends)
        for a, b in t.encode(x, add_special_tokens=False).offsets:
            share = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends], ends)]
            if rule == "shares":
                want = [w + s / sum(share) for w, s in zip(want, share)]
            else:
                want[share.index(max(share)) if rule == "largest" else next(k for k, s in enumerate(share) if s)] += 1
        assert [got[i][k][1] for k in sorted(got[i])] == ends
        assert [got[i][k][2] for k in sorted(got[i])] == pytest.approx(want)
    assert token_counts.by_section(docs.limit(0), bpe.default_vocabulary(), rule).count() == 0


def test_section_counts_of_repeated_rows_and_rows_without_ids(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "x\ny"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.section, r.start, r.end) for r in token_counts.by_section(docs, bpe.default_vocabulary()).collect())
    assert got == {(1, 0, 0, 4): 2, (1, 1, 4, 7): 2, (None, 0, 0, 2): 1, (None, 1, 2, 3): 1, (None, 0, 0, 0): 1}
