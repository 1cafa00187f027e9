import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.config import Bloom, Burst, CountMin, Duplicates, Run
from tidemark.operators import burst, dgim, duplicates, frequency


def test_sizes():
    c = CountMin.from_error_delta(0.005, 1e-3)
    assert (c.width, c.depth, c.memory_bytes) == (544, 7, 30_464) and c == CountMin()
    b = Bloom()
    assert (b.bits, b.hashes) == (958_506, 7)
    assert Burst(window=51).half == 25


@pytest.mark.parametrize("make", [
    lambda: CountMin(0, 1), lambda: CountMin(1, 0), lambda: CountMin.from_error_delta(0, 0.5), lambda: CountMin.from_error_delta(0.5, 1), lambda: Bloom(0), lambda: Bloom(1, 1.0),
    lambda: Burst(window=1), lambda: Burst(epsilon=0), lambda: Duplicates(0), lambda: Duplicates(3, 0.0), lambda: Run(interval=0), lambda: Run(top=0), lambda: Run(tracked=0), lambda: dgim.Histogram(0),
])
def test_bad_parameters_are_refused(make):
    with pytest.raises(ValueError):
        make()


def words(r, n):
    return [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") * r.randrange(3) for _ in range(n)]


def test_count_min_laws(spark):
    r = random.Random(1)
    a, b = Counter(words(r, 4000)), Counter(words(r, 3000))
    config = CountMin(64, 5)
    frame = lambda c: spark.createDataFrame(list(c.items()), "tok string, n long")
    cells = frequency.cms_add(frame(a), config)
    est = {x.tok: x.est for x in frequency.cms_estimate(frame(a).select("tok"), cells, config).collect()}
    assert est.keys() == a.keys() and all(est[k] >= a[k] for k in a)
    over = sum(est[k] > a[k] + 2.72 / 64 * a.total() for k in a)
    assert over <= 0.02 * len(a) + 1
    merged = frequency.cms_merge(cells, frequency.cms_add(frame(b), config), config, config)
    assert {tuple(x) for x in merged.collect()} == {tuple(x) for x in frequency.cms_add(frame(a + b), config).collect()}
    assert frequency.cms_stats(cells, config).first().total_count == a.total()
    with pytest.raises(ValueError):
        frequency.cms_merge(cells, cells, config, CountMin(64, 5, seed=1))
    one = frequency.cms_add(frame(a), CountMin(1, 1))
    assert [x.est for x in frequency.estimate_terms(["Nothing"], one, CountMin(1, 1)).collect()] == [a.total()]
    assert [x.est for x in frequency.estimate_terms(["x"], cells.limit(0), config).collect()] == [0]
    assert frequency.cms_add(frame({"a": 0}), config).count() == 0
    with pytest.raises(Exception, match="negative"):
        frequency.cms_add(frame({"a": -1}), config).collect()


def stream(spark, texts):
    m = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "seq long, body string")
    from tidemark.functions.text import tokens

    return m, tokens(m)


def brute_duplicates(texts, threshold=0.7):
    seen, out = set(), []
    for t in texts:
        w = t.split()
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        score = sum(x in seen for x in g) / len(g) if g else 0.0
        out.append((score, bool(g) and score >= threshold))
        seen.update(g)
    return out


def test_duplicates(spark):
    r = random.Random(2)
    base = ["a b c a b c a b c", "a b c a b c a b c", "x y", "x", "p q r s t u v w x y z m", "p q r s t u v w x o n k", "p q r s t u v w x y z o"]
    texts = base + [" ".join(words(r, r.randrange(1, 12))) for _ in range(60)] + base
    m, _ = stream(spark, texts)
    exact = {x.seq: x for x in duplicates.exact(m, Duplicates()).collect()}
    assert [(exact[i + 1].duplicate_score, exact[i + 1].is_duplicate) for i in range(len(texts))] == brute_duplicates(texts)
    assert exact[1].duplicate_score == 0.0 and exact[2].duplicate_score == 1.0 and exact[6].duplicate_score == 0.7 and exact[6].is_duplicate
    for bits in (200, 100_000):
        config = Duplicates(bloom=Bloom(bits))
        lax = {x.seq: x for x in duplicates.through_bloom(m, config).collect()}
        assert all(lax[s].n_hits >= exact[s].n_hits for s in exact)
        b = {x.b: x.first_seq for x in duplicates.bit_firsts(duplicates._keyed(m, config), config.bloom).collect()}
        fill = {x.seq: x.fill_ratio for x in duplicates.fill_ratio(m, config).collect()}
        assert all(fill[s] == pytest.approx(sum(f <= s for f in b.values()) / config.bloom.bits) for s in fill)
    s = duplicates.summary(duplicates.exact(m, Duplicates())).first()
    d = sum(x for _, x in brute_duplicates(texts))
    assert (s.processed, s.excluded, s.total) == (len(texts), 0, d) and s.rate == d / len(texts)
    s = duplicates.summary(duplicates.exact(m, Duplicates()), exclude=True).first()
    assert (s.processed, s.excluded, s.total) == (len(texts) - d, d, 0)
    s = duplicates.summary(duplicates.exact(m.limit(0), Duplicates())).first()
    assert tuple(s) == (0, 0, 0, 0.0, 0.0)
    all_in = duplicates.membership(m, m, Duplicates(bloom=Bloom(10_000))).collect()
    assert all(x.n_hits == x.n_shingles for x in all_in)


@pytest.mark.parametrize("window", [6, 7, 50])
def test_bursts_against_brute_force(spark, window):
    r = random.Random(window)
    texts = [" ".join(words(r, r.randrange(1, 5))) for _ in range(70)] + ["spike spike"] * 3
    m, toks = stream(spark, texts)
    config, h = Burst(window=window), window // 2
    got = {(x.t, x.tok): (x.recent_count, x.prev_count) for x in burst.at(burst.per_message(toks), spark.createDataFrame([(t,) for t in (1, 5, 30, 73)], "t long"), "tok", config).collect()}
    want = {}
    for t in (1, 5, 30, 73):
        late, early = Counter(" ".join(texts[max(0, t - h) : t]).split()), Counter(" ".join(texts[max(0, t - 2 * h) : max(0, t - h)]).split())
        for w, n in late.items():
            if (n + 1e-6) / (early[w] + 1e-6) >= 2:
                want[t, w] = (n, early[w])
    assert got == want and (73, "spike") in got


def test_representatives(spark):
    m, toks = stream(spark, ["a b", "b", "c c c", "a a"])
    config = CountMin(1, 2)
    assert {x.bin: x.representative for x in burst.representatives(burst.per_message(toks), config).collect()} == {0: "a"}
    config = CountMin(100_000, 1)
    found = {x.representative: x.best_score for x in burst.representatives(burst.per_message(toks), config).collect()}
    assert found == {"a": 3, "b": 2, "c": 3}


def test_histogram_laws():
    r = random.Random(3)
    for _ in range(200):
        w = r.randrange(1, 60)
        h, ones, now = dgim.Histogram(w), [], 0
        for _ in range(200):
            now += r.randrange(3)
            for _ in range(r.randrange(4)):
                h.add(now)
                ones.append(now)
            sizes = [s for _, s in h.buckets]
            assert sizes == sorted(sizes) and max(Counter(sizes).values(), default=0) <= 2 and all(s & (s - 1) == 0 for s in sizes)
            k = r.randrange(1, w + 1)
            true = sum(x > now - k for x in ones)
            inside = [s for t, s in h.buckets if t > now - k]
            outside = next((s for t, s in h.buckets if t <= now - k), 0)
            assert true <= h.count(now, k) <= true + max([s - 1 for s in inside[-1:]], default=0) + outside // 2
            assert h.count(now, 0) == 0


def test_histogram_bursts_reach_quiet_bins(spark):
    r = random.Random(4)
    rows = sorted({(r.randrange(1, 120), r.randrange(6)): r.randrange(1, 4) for _ in range(150)}.items())
    events = spark.createDataFrame([(s, b, n) for (s, b), n in rows], "seq long, bin int, n long")
    config, times = Burst(window=20), [10, 55, 90, 200]
    got = {(x.t, x.bin): (x.recent_count, x.prev_count) for x in dgim.bursts(events, times, config).collect()}
    want = {}
    for b in range(6):
        h, k = dgim.Histogram(20), 0
        for (s, bb), n in rows:
            if bb == b:
                while k < len(times) and times[k] < s:
                    want[times[k], b] = (h.count(times[k], 10), max(0, h.count(times[k], 20) - h.count(times[k], 10)))
                    k += 1
                for _ in range(n):
                    h.add(s)
        for t in times[k:]:
            want[t, b] = (h.count(t, 10), max(0, h.count(t, 20) - h.count(t, 10)))
    assert got == {k: v for k, v in want.items() if v[0] >= 1 and (v[0] + 1e-6) / (v[1] + 1e-6) >= 2}


def test_histogram_segments_keep_the_bounds(spark):
    r = random.Random(6)
    rows = sorted({(r.randrange(1, 600), r.randrange(4)): r.randrange(1, 4) for _ in range(500)}.items())
    events = spark.createDataFrame([(s, b, n) for (s, b), n in rows], "seq long, bin int, n long")
    config, times = Burst(window=20, threshold=1e-9), range(7, 601, 7)
    got = {(x.t, x.bin): x.recent_count for x in dgim.bursts(events, times, config, segment=64).collect()}
    for t in times:
        for b in range(4):
            true = sum(n for (s, bb), n in rows if bb == b and t - 10 < s <= t)
            assert true <= got.get((t, b), 0) <= 2 * true + 2 * sum(n for (s, bb), n in rows if bb == b and t - 20 < s <= t - 10) if true else got.get((t, b), 0) >= 0


def test_running_by_blocks(spark):
    r = random.Random(7)
    rows = [(r.randrange(300), r.choice("ab"), r.randrange(9)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "seq long, k string, v long")
    from tidemark.operators.sequence import running

    for how, f in (("sum", sum), ("max", max)):
        for x in running(frame, "v", "out", ("k",), how, block=16).collect():
            assert x.out == f(v for s, k, v in rows if k == x.k and s <= x.seq)


def test_tops_over_many_snapshots(spark):
    r = random.Random(8)
    toks = [(s, r.choice("abc") if s % 3 else f"w{s // 500}") for s in range(1, 5000) for _ in range(2)]
    frame = spark.createDataFrame(toks, "seq long, tok string")
    got = {(x.t, x.rk): (x.tok, x.n) for x in frequency.top_at_snapshots(frame, 5, 3).collect()}
    seen, want = Counter(), {}
    by = {}
    for s, t in toks:
        by.setdefault(s, []).append(t)
    for s in range(1, 5000):
        seen.update(by[s])
        if s % 5 == 0:
            want |= {(s, k + 1): x for k, x in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert got == want


def test_a_hundred_thousand_snapshots(spark):
    toks = spark.range(1, 200_001).select(F.col("id").alias("seq"), F.concat(F.lit("w"), F.length(F.bin(F.col("id").bitwiseAND(-F.col("id"))))).alias("tok"))
    out = frequency.top_at_snapshots(toks, 2, 2)
    assert out.count() == 200_000
    assert {(r.tok, r.n, r.rk) for r in out.where("t = 200000").collect()} == {("w1", 100_000, 1), ("w2", 50_000, 2)}
