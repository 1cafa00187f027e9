import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def brute_components(items):
    root = {p: p for p in {p for _, p in items}}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = sorted(root)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    first = {}
    for d, p in items:
        r = find(p)
        first[r] = min(x for x in (first.get(r), d) if x is not None) if d is not None or r in first else None
    return {(d, p): first.get(find(p)) for d, p in items}


def test_every_close_pair_shares_an_anchor_with_a_home():
    r = random.Random(5)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for k in r.sample(range(64), r.randrange(3)):
            y ^= 1 << k
        key, which, home = simhash.anchors(np.array([x, y], np.uint64))
        homes = {int(k) for k, w, h in zip(key, which, home) if w == 0 and h}
        assert len(homes) == 2 and homes & {int(k) for k, w in zip(key, which) if w == 1}
        assert len({(int(k), int(w)) for k, w in zip(key, which)}) == len(key)


def test_groups_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(120):
        words = [r.choice(["Alpha", "beta", "gamma", "delta", "É"]) for _ in range(r.choice([1, 2, 3, 60, 300]))]
        rows.append((i, " \n".join(words)))
        for j in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(["beta", "zeta"])
            rows.append((1000 * (j + 1) + i, "\t".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (3, rows[3][1]), (None, rows[4][1]), (5003, "w " * 70_000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, component_id int, row int")
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_groups(docs).collect()), key=str)
    items = [(d, brute_print(t)) for d, t in rows]
    want = brute_components(items)
    assert got == sorted(((d, f"{p:016x}", want[d, p]) for d, p in items), key=str)
    assert len({c for *_, c in got}) < len(rows) - 20
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_chains_join_into_one_component(spark):
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (3 << k))
    fps = spark.createDataFrame([(i, p) for i, p in enumerate(chain)], "doc_id long, __fp long")
    assert {x.component_id for x in simhash.classes(fps).collect()} == {0}


def test_one_stays_of_groups_without_ids_and_of_repeated_rows(spark):
    a, b = "one two three four five six", "quite another text about other things"
    rows = [(None, a, 1), (None, a, 1), (None, b, 2), (7, a + " seven eight nine ten", 3), (7, a + " seven eight nine ten", 4), (7, b + " and more of it all", 5), (8, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").withColumns({"text_digest": F.lit(1), "id": F.lit(2), "n": F.lit(3), "digest": F.lit(4)})
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.text or "") for x in kept.collect()) == sorted([("None", a), ("None", b), ("7", rows[3][1]), ("7", rows[5][1]), ("8", "")])


def test_many_losers_are_filtered_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i % 20} of the twenty", i) for i in range(200)], "doc_id long, text string, n int")
    want = sorted(map(tuple, simhash.distinct_documents(docs).collect()))
    monkeypatch.setattr(simhash, "small", lambda df: df)
    assert sorted(map(tuple, simhash.distinct_documents(docs).collect())) == want
    assert len({x[1] for x in want}) == len(want)


def test_replicas_are_shuffled_whatever_spark_takes_their_size_for(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id") % 30_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "72m")
    try:
        rows = simhash.op9_simhash(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(i, i % 30_000) for i in range(40_000)]
    plan = simhash.links(spark.range(9).select(F.col("id").alias("__fp")))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan
