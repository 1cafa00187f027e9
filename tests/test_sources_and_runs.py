import datetime as dt
import json
import random
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import CountMin, Run
from tidemark.functions import text as X
from tidemark.operators import duplicates, frequency, ranks, sampling
from tidemark.operators.sequence import running_total, sequenced
from tidemark.plans.chart import bump_chart
from tidemark.plans.report import Detectors, MessageRun
from tidemark.queries import QUERIES, RUN
from tidemark.sources import conversations as S
from tidemark.streaming.stream import MessageStream

SF = "/root/testdata/sf0.001"


def msg(body, time=None, medium="Email", is_inbound=True):
    return {k: v for k, v in {"body": body, "time": time, "medium": medium, "is_inbound": is_inbound}.items() if v is not None}


@pytest.fixture
def data(tmp_path):
    files = {
        "test_convs/a.json": {"messages": [msg("first words here", 3), msg("out going", 1, is_inbound=False), msg("", 2), msg(None, 2), msg("!!! ...", 2)]},
        "test_convs/sub/b.json": {"messages": [msg("Description for file 12: café pictures", 1, medium=None), msg("no time given"), {"body": "no mark", "time": 5}]},
        "test_convs/c.json": {"messages": [msg("mail text", 1), msg("chat text", 1, medium="Telegram")]},
        "test_convs/d.json": {"other": 1},
        "train_convs/e.json": {"messages": [msg(X.BOILERPLATE + " kept words", 1), msg(X.BOILERPLATE.replace("it.Here", "it. Here"), 2)]},
    }
    for name, what in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(what))
    return tmp_path


def test_files_to_stream(spark, data):
    rows = S.ChatFiles(str(data)).load(spark, force_reload=True)
    test = rows.where("split = 'test'")
    assert {r.conv_id.rsplit("/", 1)[1] for r in test.collect()} == {"a.json", "b.json", "d.json"}
    out = [(r.seq, r.raw_body, r.body) for r in S.stream(S.flattened(test)).orderBy("seq").collect()]
    assert out == [(1, " café pictures", "café picture"), (2, "first words here", "first word"), (3, "no time given", "time given")]
    assert [r.body for r in S.stream(S.flattened(test, None)).orderBy("seq").collect()] == [" café pictures", "first words here", "no time given"]
    everything = S.ChatFiles(str(data)).load(spark, force_reload=True, all_messages=True)
    assert everything.where("split = 'test'").count() == 4
    train = {r.raw_body for r in S.flattened(everything.where("split = 'train'")).collect()}
    assert " kept words" in train and any("ignore it. Here" in b for b in train)
    assert S.flattened(test, None).where("body <> raw_body").count() == 0
    assert S.ChatFiles(str(data)).messages(spark, "nowhere").count() == 0
    assert {(r.label, r.dataset) for r in rows.collect()} == {("scam", "ChatFiles")}
    assert rows.where("split = 'none'").count() == 0


def test_loading_keeps_results_by_all_options(spark, data):
    a = S.ChatFiles(str(data), dataset_name="one")
    n = a.load(spark).count()
    (data / "test_convs/d.json").unlink()
    assert a.load(spark).count() == n and a.load(spark, force_reload=True).count() == n - 1
    swapped = S.ChatFiles(str(data), "test_convs", "train_convs", dataset_name="one")
    assert swapped.load(spark).where("split = 'train'").count() == n - 2
    assert S.ChatFiles(str(data), sample_size=1).load(spark).groupBy("split").count().where("count > 1").count() == 0
    found = S.load_all(spark, [a, S.ChatFiles(str(data), dataset_name="two")])
    assert set(found) == {"one", "two"} and [x.count() for x in S.splits_of(found, "none")] == [0, 0, 0]
    assert S.splits_of(found, "one")[2].count() == n - 2


def test_text_rules(spark):
    cases = {
        "abc123 well-known don't Été (hello) o'clock x": ["été", "hello", "x"],
        "  A\tB\n'c' ": ["a", "b", "c"],
        "12 ... !": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "seq long, body string")
    got = {i: [] for i in range(len(cases))}
    for r in X.tokens(rows).orderBy("seq", "pos").collect():
        got[r.seq].append(r.tok)
    assert list(got.values()) == list(cases.values())
    assert [r.b for r in rows.select(X.has_token(F.col("body")).alias("b")).collect()] == [bool(v) for v in cases.values()]
    assert {r.seq: r.body for r in X.joined(X.tokens(rows)).collect()} == {0: "été hello x", 1: "a b c"}
    assert X.shingles(X.tokens(rows), 1).count() == 6 and X.shingles(X.tokens(rows), 3).count() == 2
    one = [r.t for r in spark.createDataFrame([("cats",), ("boxes",), ("parties",), ("glass",), ("was",), ("bus",)], "t string").select(X.singular(F.col("t")).alias("t")).collect()]
    assert one == ["cat", "box", "party", "glass", "was", "bus"]
    assert X.ENGLISH_STOPS == StopWordsRemover.loadDefaultStopWords("english")
    assert {"u", "enron"} <= set(X.stop_words()) and "u" not in X.stop_words(False)
    assert X.tokens(rows, stops=["été", "a"]).count() == 4 and X.tokens(rows, lemma=True).count() == 6


def test_numbers_in_ranges_are_those_of_one_task(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(r.choice([None, *range(40)]), i) for i in range(700)], "time int, id int")
    a = {x.id: x.seq for x in sequenced(rows, ["time", "id"]).collect()}
    assert a == {x.id: x.seq for x in sequenced(rows.repartition(7), ["time", "id"], one_task=10).collect()}
    assert sorted(a.values()) == list(range(1, 701))
    assert {x.id for x in sequenced(rows, ["time", "id"], 5).collect()} == {i for i, s in a.items() if s <= 5}
    runs = running_total(spark.range(1, 300).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("v")), "v", "total", block=16).collect()
    assert all(x.total == sum(i % 7 for i in range(x.seq + 1)) for x in runs)


def test_splits(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"))
    n = {r.split: r["count"] for r in sampling.row_split(rows, "k").groupBy("split").count().collect()}
    assert 340 < n["test"] < 460 and 140 < n["val"] < 260
    files = sampling.split_files(rows.limit(11), "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in files} == {"train": 7, "test": 4}
    assert sampling.sample_n(rows, "k", 5000).count() == 2000 and sampling.sample_n(rows, "k", 9).distinct().count() == 9


def test_ranks(spark):
    rows = [(10, 1, 3, 5.0, "a"), (10, 2, 3, 4.0, "b"), (10, 3, 3, 3.0, "a"), (20, 1, 3, 2.0, "b"), (30, 1, 3, 9.0, "a"), (30, 2, 3, 9.0, "c")]
    found = spark.createDataFrame(rows, "t long, bin int, recent_count long, ratio double, representative string")
    top = ranks.terms(ranks.top_bursts(found, 3))
    assert {(r.t, r.term): (r.ratio, r.place) for r in top.collect()}[10, "a"] == (3.0, 1)
    ranked = ranks.ranks(top)
    assert {(r.t, r.term): r["rank"] for r in ranked.collect()} == {(10, "b"): 1, (10, "a"): 2, (20, "b"): 1, (30, "a"): 1, (30, "c"): 2}
    assert {(r.term, r.first_t, r.last_t, r.points) for r in ranks.segments(ranked, 10).collect()} == {("a", 10, 10, 1), ("a", 30, 30, 1), ("b", 10, 20, 2), ("c", 30, 30, 1)}
    assert {r.term: (r.appearances, r.marker) for r in ranks.markers(ranked).collect()} == {"a": (2, 2), "b": (2, 2), "c": (1, 1)}
    assert ranks.wide(top, [10, 20]).columns == ["term", "t_10", "t_20"]
    assert sorted((r.t, r.term, r.ratio or 0) for r in ranks.outer(top, 10).collect()) == sorted([(10, "a", 3.0), (10, "b", 4.0), (10, "c", 0), (20, "a", 0), (20, "b", 2.0), (20, "c", 0), (30, "a", 9.0), (30, "b", 0), (30, "c", 9.0)])
    drawing = bump_chart(ranked, 10)
    assert drawing.count("<polyline") == 4 and ">c</text>" in drawing and ElementTree.fromstring(drawing).tag.endswith("svg")
    assert "<polyline" not in bump_chart(ranked.limit(0), 10)


@pytest.mark.parametrize("exclude", [False, True])
def test_a_run_and_its_summary(spark, exclude):
    texts = ["alpha beta gamma delta"] * 3 + [f"word{chr(97 + i)} beta gamma other{chr(97 + i)}" for i in range(6)]
    texts = [t.replace("word", "wo").replace("other", "ot") for t in texts]
    m = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "seq long, body string")
    out = MessageRun(m, Run(interval=3, top=2, exclude_duplicates=exclude)).summary("test", ("BETA", "alpha beta"), True)
    assert (out["processed"], out["excluded_duplicates"], out["duplicates"]["total"]) == ((7, 2, 0) if exclude else (9, 0, 2))
    assert [s["message_count"] for s in out["periodic_snapshots"]] == ([3, 6] if exclude else [3, 6, 9])
    assert out["frequency_estimates"]["BETA"] >= 9 and out["final top_tokens"] == {"beta": 9, "gamma": 9}
    first = out["periodic_snapshots"][0]
    assert first["top_10_tokens"] == ({"beta": 5, "gamma": 5} if exclude else {"alpha": 3, "beta": 3})
    assert first["duplicates_so_far"] == (0 if exclude else 2)
    assert len(out["messages"]) == out["processed"]
    json.dumps(out)
    few = MessageRun(m.limit(2), Run(interval=3))
    assert few.snapshots().count() == 0 and few.rank_table().count() == 0 and few.summary()["periodic_snapshots"] == []
    none = MessageRun(m.limit(0), Run()).summary()
    assert none["processed"] == 0 and none["duplicates"] == {"total": 0, "rate": 0.0, "avg_score": 0.0} and none["final burst"] == []


def test_command_line(spark, data, capsys):
    out = json.loads(cli.main(["--data-dir", str(data), "--update-interval", "2", "--freq-query", "words", "--show-text"], spark))
    assert out["processed"] == 3 and out["frequency_estimates"] == {"words": 0} and len(out["messages"]) == 3
    assert json.loads(capsys.readouterr().out) == out
    assert out["messages"][0]["text"] == "café picture" and {x["representative"] for x in out["messages"][0]["burst"]} == {"café", "picture"}
    assert set(out["messages"][0]["duplicate"]) == {"is_duplicate", "duplicate_score", "fill_ratio"}


def test_stop_words_never_reach_the_detectors(spark, tmp_path):
    (tmp_path / "test_convs").mkdir()
    for i in range(6):
        (tmp_path / f"test_convs/{i}.json").write_text(json.dumps({"messages": [msg("the of and", 3 * i), msg("It is the account of Jenkins and accounts are in it", 3 * i + 1), msg(f"transfer the money{'s' * i} to them", 3 * i + 2)]}))
    chart = tmp_path / "chart.svg"
    out = json.loads(cli.main(["--data-dir", str(tmp_path), "--update-interval", "4", "--exclude-duplicates", "--freq-query", "account", "--freq-query", "the", "--chart", str(chart)], spark))
    assert out["processed"] + out["excluded_duplicates"] == 12
    assert out["frequency_estimates"] == {"account": 12, "the": 0} and next(iter(out["final top_tokens"])) == "account"
    assert not set(out["final top_tokens"]) & set(X.stop_words()) and chart.read_text().startswith("<svg")


def test_detectors_can_be_replaced(spark):
    m = spark.createDataFrame([(i + 1, "red green blue dark") for i in range(4)], "seq long, body string")
    none = lambda messages, config: messages.select("seq", *(F.lit(0).cast("long").alias(c) for c in ("n_shingles", "n_hits")), F.lit(0.0).alias("duplicate_score"), F.lit(False).alias("is_duplicate"))
    run = MessageRun(m, Run(interval=2, top=2, count_min=CountMin(1, 1)), Detectors(duplicates=none, frequencies=frequency.counted))
    out = run.summary("test", ("RED", "none"))
    assert out["duplicates"]["total"] == 0 and out["frequency_estimates"] == {"RED": 4, "none": 0} and out["final top_tokens"] == {"blue": 4, "dark": 4}
    usual = MessageRun(m, Run(interval=2), Detectors(duplicates=duplicates.through_bloom)).summary("test")
    assert usual["duplicates"]["total"] == 3
    per = {r.seq: r for r in MessageRun(m, Run()).message_results(("Red", "x")).collect()}
    assert [per[s].frequencies for s in (1, 2, 3, 4)] == [{"Red": s, "x": 0} for s in (1, 2, 3, 4)] and per[2].duplicate.is_duplicate


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_stream_equals_batch(spark, batches):
    table = S.conversations_table(spark, SF).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("body"))
    whole = MessageStream(spark, RUN, ["conv_id", "turn"])
    rows = table.orderBy("conv_id", "turn").collect() * 2
    whole.batch(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], table.schema), 0)
    parts = MessageStream(spark, RUN, ["conv_id", "turn"])
    size = -(-len(rows) // batches)
    for b in range(batches):
        part = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)][b * size : (b + 1) * size], table.schema)
        parts.batch(part, b)
        if b == 0:
            parts.batch(part, b)  # a batch that is played again
    for report in (MessageStream.frequencies, MessageStream.duplicates, MessageStream.bursts):
        assert sorted(map(str, report(whole).collect())) == sorted(map(str, report(parts).collect()))
    assert whole.duplicates().where("is_duplicate").count() >= len(rows) // 2 - 1


@pytest.mark.parametrize("name", sorted(k for k, q in QUERIES.items() if q.sql))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "events", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name].run(spark, SF)
    want = con.sql(QUERIES[name].sql)
    assert sorted(got.columns) == sorted(want.columns)
    value = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    flat = lambda rows: sorted(str([value(v) for v in r]) for r in rows)
    assert flat(got.select(sorted(got.columns)).collect()) == flat(want.project(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["t", "tok", "n", "rk"]
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_late_events_by_watermark(spark, tmp_path):
    s = MessageStream(spark, RUN, [])
    at = str(tmp_path / "events")
    write = lambda rows: spark.createDataFrame([(dt.datetime(2024, 1, d, h), k) for d, h, k in rows], "ts timestamp, k string").coalesce(1).write.mode("append").parquet(at)
    play = lambda: {(r.start.day, r.k): r.n for r in s.play_over_time(spark.readStream.schema("ts timestamp, k string").parquet(at), "ts", "k", "1 day", "6 hours").collect()}
    write([(1, 1, "a"), (1, 2, "a"), (2, 3, "b")])
    assert play() == {(1, "a"): 2, (2, "b"): 1}
    write([(2, 1, "b"), (3, 20, "a")])
    assert play() == {(1, "a"): 2, (2, "b"): 2, (3, "a"): 1}
    write([(1, 5, "a"), (3, 2, "a")])  # the first is too late, the second isn't
    assert play() == {(1, "a"): 2, (2, "b"): 2, (3, "a"): 2}


def test_tracked_terms_are_bounded(spark):
    s = MessageStream(spark, Run(top=2, tracked=2), ["k"])
    for b, text in enumerate(["a a a b", "c c d", "c c e", "a e"]):
        s.batch(spark.createDataFrame([(1, text)], "k int, body string"), b)
    assert [(r.tok, r.est) for r in s.top().orderBy("rk").collect()] == [("a", 4), ("c", 4)]
    assert s._part("tracked", 3).count() == 2 and not s._exists(f"{s.path}/cells/batch=0")


def test_stream_reports(spark):
    s = MessageStream(spark, Run(top=2), ["k"])
    assert s.frequencies().count() == 0 and s.bursts().count() == 0 and s.top().count() == 0
    s.batch(spark.createDataFrame([(1, "red red blue"), (2, "blue green red")], "k int, body string"), 0)
    assert [(r.tok, r.est, r.rk) for r in s.top().orderBy("rk").collect()] == [("red", 3, 1), ("blue", 2, 2)]
    assert {r.term: r.est for r in s.estimates(["RED", "none"]).collect()} == {"RED": 3, "none": 0}
