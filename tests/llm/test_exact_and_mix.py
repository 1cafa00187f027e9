import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import exact_dedup, mixing


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(7)
    texts = [None, "", " ", "a b", "a\n\n b", "a b", "c" * 90_000, *(f"t{i}" for i in range(40))]
    rows = [(i, r.choice(texts), i) for i in range(300)] + [(1000 + i, "hot  text" if i % 2 else "hot\ttext", i) for i in range(400)]
    rows += [(5, rows[5][1], 1), (None, "hot text", 2), (None, "only null", 3), (1000, "hot text", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[norm(t)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    got = exact_dedup.groups(exact_dedup.digests(docs)).collect()
    assert sorted((str(x.doc_id), x.text_sha256, x.keep_id, x.group_size) for x in got) == sorted(
        (str(d), hashlib.sha256(norm(t).encode()).hexdigest(), least[norm(t)], len(groups[norm(t)])) for d, t, _ in rows
    )
    kept = [x for x in got if x.kept]
    assert len(kept) == len(groups) == len({x.text_sha256 for x in kept}) and all(x.doc_id == x.keep_id for x in kept)
    out = exact_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted((str(x.doc_id), norm(x.text)) for x in out.collect()) == sorted((str(v), k) for k, v in least.items())
    assert exact_dedup.distinct_documents(docs.limit(0)).count() == 0
    heavy = exact_dedup.winners(exact_dedup.digests(docs), most=4, counters=64).collect()
    assert len(heavy) <= 4 and max(x["__size"] for x in heavy) == 402


def water(sizes, weights, total):
    target = dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > 2 * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / w for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_resharing(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "none"][: 2 + seed]
    rows = [(i, " w\n" * r.randrange(1, 9) if s != "none" else None, s, 1) for i in range(400) for s in [r.choice(names + ["a"] * 3)]]
    rows += [rows[0]] * 3 + [(None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    source = {d: s for d, _, s, _ in rows}
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(target[s], abs=1e-6) and 0 <= x.taken <= 2 * x.size
    taken = sum(x.taken for x in got)
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.12 * taken
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and sum(len((x.text or "").split()) for x in mix.collect()) == taken
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_many_sources_are_joined_with_salts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 7}") for i in range(70)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "small", lambda df: df)
    assert sorted(map(tuple, mixing.plan(docs).collect())) == want
