"""Named queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Bloom, Burst, CountMin, Duplicates, Run
from tidemark.functions import text as X
from tidemark.functions.hashing import cms_cells_of
from tidemark.operators import burst, dgim, duplicates, frequency, ranks, sampling
from tidemark.plans.report import MessageRun
from tidemark.plans.storage import written
from tidemark.sources import conversations as S
from tidemark.streaming.stream import MessageStream


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}

CMS, BURST, DUP = CountMin(), Burst(), Duplicates(bloom=Bloom(capacity=1_000_000))
INTERVAL, TOP, BUMP = 20, 10, 5
RUN = Run(interval=INTERVAL, top=TOP, max_messages=None, count_min=CMS, burst=BURST, duplicates=DUP)
TERMS = ["the", "The", "OF", "thing", "no such phrase", "zzzz"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = Query(f, "WITH " + sql if sql else None)
        return f

    return add


# --- SQL that several queries share ---

_S = r"[ \t\n\x0B\f\r]"
_HAS = r"(^|[ \t\n\x0B\f\r])[^\p{L}\p{N} \t\n\x0B\f\r]*\p{L}+[^\p{L}\p{N} \t\n\x0B\f\r]*($|[ \t\n\x0B\f\r])"
_TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _msg(source: str = "conversations") -> str:
    if source == "conversations":
        rows, order = "SELECT conv_id, turn, text AS body FROM conversations WHERE role = 'user'", "conv_id, turn"
    else:
        rows, order = "SELECT doc_id, text AS body FROM documents", "doc_id"
    return f"m AS (SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS seq, * FROM ({rows}) WHERE regexp_matches(body, '{_HAS}'))"


def _tok(of: str = "m", name: str = "tk", body: str = "body") -> str:
    return f"""{name} AS (SELECT seq, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT seq, pos, regexp_replace(w[pos], '{_TRIM}', '', 'g') AS tok FROM (
        SELECT seq, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT seq, string_split(trim(regexp_replace(lower({body}), '{_S}+', ' ', 'g')), ' ') AS w FROM {of})))
        WHERE regexp_matches(tok, '^\\p{{L}}+$'))"""


def _gram(of: str = "tk", name: str = "g3") -> str:
    return f"""{name} AS (SELECT seq, pos, tok || ' ' || t1 || ' ' || t2 AS g FROM (SELECT *, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2 FROM {of} WINDOW w AS (PARTITION BY seq ORDER BY pos)) WHERE t2 IS NOT NULL)"""


def _c(row: str, key: str) -> str:
    return f"CAST(('0x' || substr(md5('{CMS.seed}-' || {row} || '-' || {key}), 1, 8))::BIGINT % {CMS.width} AS INT)"


_PM = "pm AS (SELECT seq, tok, CAST(count(*) AS BIGINT) AS n, min(pos) AS pos FROM tk GROUP BY seq, tok)"
_PC = f"pc AS (SELECT seq, tok, pos, n, CAST(r AS INT) AS r, {_c('r', 'tok')} AS c FROM pm, range({CMS.depth}) t(r))"
_CELLS = "cells AS (SELECT r, c, CAST(sum(n) AS BIGINT) AS v FROM pc GROUP BY r, c)"
_BASE = ", ".join([_msg(), _tok()])
_BASE_C = ", ".join([_BASE, _PM, _PC])
_BASE_D = ", ".join([_msg("documents"), _tok(), _gram(), "gs AS (SELECT seq, g, count(*) AS n FROM g3 GROUP BY seq, g)"])
_SCORE = f"""sc AS (SELECT m.seq, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, CAST(coalesce(h, 0) AS BIGINT) AS n_hits, CASE WHEN k > 0 THEN CAST(h AS DOUBLE) / k ELSE 0.0::DOUBLE END AS duplicate_score,
      coalesce(k > 0 AND CAST(h AS DOUBLE) / k >= {DUP.threshold}::DOUBLE, false) AS is_duplicate
      FROM m LEFT JOIN (SELECT seq, sum(n) AS k, sum(CASE WHEN hit THEN n ELSE 0 END) AS h FROM hits GROUP BY seq) USING (seq))"""
_HITS = "fs AS (SELECT g, min(seq) AS f FROM gs GROUP BY g), hits AS (SELECT gs.seq, n, f < gs.seq AS hit FROM gs JOIN fs USING (g))"
_TIMES = f"ts AS (SELECT seq AS t FROM m WHERE seq % {INTERVAL} = 0)"
_BURSTS = f"""ev AS (SELECT seq, c AS bin, sum(n) AS n FROM pc GROUP BY seq, c),
  bc AS (SELECT t, bin, CAST(sum(CASE WHEN seq > t - {BURST.half} THEN n ELSE 0 END) AS BIGINT) AS recent_count, CAST(sum(CASE WHEN seq > t - {BURST.half} THEN 0 ELSE n END) AS BIGINT) AS prev_count
         FROM ev JOIN ts ON seq <= t AND seq > t - {2 * BURST.half} GROUP BY t, bin),
  br AS (SELECT *, (recent_count::DOUBLE + 1e-6::DOUBLE) / (prev_count::DOUBLE + 1e-6::DOUBLE) AS ratio FROM bc),
  bf AS (SELECT * FROM br WHERE recent_count >= {BURST.min_count} AND ratio >= {BURST.threshold}::DOUBLE)"""
_RUNNING = """rv AS (SELECT *, sum(n) OVER (PARTITION BY r, c ORDER BY seq RANGE UNBOUNDED PRECEDING) AS v FROM pc),
  re AS (SELECT *, CAST(min(v) OVER (PARTITION BY seq, tok) AS BIGINT) AS est FROM rv)"""
_NAMED = f"""bn AS (SELECT bf.t, bf.bin, bf.recent_count, bf.prev_count, bf.ratio, arg_max(tok, (est, -seq, -pos, -r)) AS representative
      FROM bf JOIN re ON re.c = bf.bin AND re.seq <= bf.t GROUP BY ALL)"""
_BUMP = ", ".join([_BASE_C, _TIMES, _BURSTS, _RUNNING, _NAMED]) + f""",
  tp AS (SELECT t, place, bin, representative AS term, ratio FROM (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY ratio DESC, recent_count DESC, bin) AS BIGINT) AS place FROM bn) WHERE place <= {BUMP}),
  tm AS (SELECT t, term, arg_max(ratio, place) AS ratio, min(place) AS place FROM tp GROUP BY t, term),
  fa AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY t, place) AS k FROM tm),
  rk AS (SELECT a.t, a.term, CAST(row_number() OVER (PARTITION BY a.t ORDER BY a.ratio DESC, b.t, b.place) AS BIGINT) AS rank FROM tm a JOIN fa b ON a.term = b.term AND b.k = 1)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return S.messages_from_conversations(spark, d)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.tokens(_messages(spark, d))


def _doc_messages(spark: SparkSession, d: str) -> DataFrame:
    return S.messages_from_documents(spark, d)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return frequency.cms_add(frequency.counts(_tokens(spark, d)), CMS)


# --- scans, projections, filters ---


@query("a AS (SELECT conv_id, turn, role, text FROM conversations) SELECT * FROM a WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def conv_exclude_any(spark, d):
    rows = S.conversations_table(spark, d)
    return rows.join(rows.where("role = 'system'").select("conv_id"), "conv_id", "left_anti").select("conv_id", "turn", "role", "text")


@query("a AS (SELECT 1) SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def inbound_only(spark, d):
    return S.conversations_table(spark, d).where("role = 'user'").select("conv_id", "turn", "text")


@query("a AS (SELECT 1) SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> ''")
def nonempty(spark, d):
    return S.conversations_table(spark, d).where("text IS NOT NULL AND text <> ''").select("conv_id", "turn")


@query(f"{_msg()} SELECT seq, conv_id, turn FROM m")
def sequenced(spark, d):
    return _messages(spark, d).select("seq", "conv_id", "turn")


@query("a AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seq, event_id FROM events) SELECT * FROM a WHERE seq <= 200")
def limited(spark, d):
    from tidemark.operators.sequence import sequenced as number

    return number(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id"), ["ts", "event_id"], 200).select("seq", "event_id")


@query("a AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id FROM a ORDER BY md5('42-' || conv_id), conv_id LIMIT 20")
def sample_n(spark, d):
    return sampling.sample_n(S.conversations_table(spark, d).select("conv_id").distinct(), "conv_id", 20)


@query("""u AS (SELECT DISTINCT conv_id, ('0x' || substr(md5('42-' || conv_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM conversations)
SELECT conv_id, CASE WHEN u < 0.2::DOUBLE THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM u""")
def row_split(spark, d):
    return sampling.row_split(S.conversations_table(spark, d).select("conv_id").distinct(), "conv_id")


@query("""f AS (SELECT DISTINCT 'conv' || conv_id || '.json' AS name FROM conversations), r AS (SELECT name, row_number() OVER (ORDER BY md5('42-' || name), name) AS k, count(*) OVER () AS n FROM f)
SELECT name, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_files(spark, d):
    names = S.conversations_table(spark, d).select(F.concat(F.lit("conv"), F.col("conv_id"), F.lit(".json")).alias("name")).distinct()
    return sampling.split_files(names, "name")


@query("""a AS (SELECT conv_id, turn, 'Description for file ' || turn || ':' || text || ' """ + X.BOILERPLATE.replace("'", "''") + """' AS b FROM conversations)
SELECT conv_id, turn, regexp_replace(replace(b, '""" + X.BOILERPLATE.replace("'", "''") + r"""', ''), 'Description for file \p{Nd}+:', '', 'g') AS body FROM a""")
def scrub(spark, d):
    described = F.concat(F.lit("Description for file "), F.col("turn"), F.lit(":"), F.col("text"), F.lit(" " + X.BOILERPLATE))
    return S.conversations_table(spark, d).select("conv_id", "turn", X.scrub(described).alias("body"))


@query(f"{_BASE} SELECT * FROM tk")
def tokens(spark, d):
    return _tokens(spark, d)


_STOPS = "s AS (SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.stop_words()) + "]) AS w)"


@query(f"{_BASE}, {_STOPS} SELECT seq, pos, tok FROM tk WHERE tok NOT IN (SELECT w FROM s)")
def stopwords(spark, d):
    return X.tokens(_messages(spark, d), stops=X.stop_words())


_LEMMA = r"""CASE WHEN length(tok) <= 3 OR regexp_matches(tok, '(ss|us|is)$') THEN tok WHEN regexp_matches(tok, '[^aeiou]ies$') THEN regexp_replace(tok, 'ies$', 'y')
  WHEN regexp_matches(tok, '(x|ch|sh|ss|z)es$') THEN regexp_replace(tok, 'es$', '') WHEN regexp_matches(tok, 's$') THEN regexp_replace(tok, 's$', '') ELSE tok END"""


@query(f"""{_BASE}, {_STOPS}, l AS (SELECT seq, pos, {_LEMMA} AS lemma FROM tk), p AS (SELECT seq, string_agg(lemma, ' ' ORDER BY pos) AS body FROM l WHERE lemma NOT IN (SELECT w FROM s) GROUP BY seq)
SELECT conv_id, turn, m.body AS raw_body, p.body AS body FROM m JOIN p USING (seq)""")
def processed(spark, d):
    rows = S.conversations_table(spark, d).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("raw_body"))
    return rows.withColumn("body", X.processed(F.col("raw_body"), X.stop_words())).where("body <> ''")


@query(f"{_BASE} SELECT DISTINCT tok, {_LEMMA} AS lemma FROM tk")
def lemma_rules(spark, d):
    return _tokens(spark, d).select("tok").distinct().select("tok", X.singular(F.col("tok")).alias("lemma"))


@query(f"{_BASE}, {_gram()} SELECT * FROM g3")
def shingles(spark, d):
    return X.shingles(_tokens(spark, d))


@query("a AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id) SELECT CAST(count(*) AS BIGINT) AS conversations, CAST(sum(n) AS BIGINT) AS messages, max(n) AS longest, CAST(sum(chars) AS BIGINT) AS chars FROM a")
def corpus_stats(spark, d):
    per = S.conversations_table(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return per.agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"), F.max("n").alias("longest"), F.sum("chars").alias("chars"))


# --- frequencies and the Count-Min Sketch ---


@query(f"{_BASE} SELECT tok, CAST(count(*) AS BIGINT) AS n FROM tk GROUP BY tok")
def token_freq(spark, d):
    return frequency.counts(_tokens(spark, d))


@query(f"{_BASE} SELECT DISTINCT CAST(ceil(seq / {INTERVAL}) AS BIGINT) AS interval_id, tok FROM tk")
def recent_tokens(spark, d):
    return frequency.recent(_tokens(spark, d), INTERVAL)


@query(f"""{_BASE}, {_TIMES}, k AS (SELECT t, tok, CAST(count(*) AS BIGINT) AS n FROM tk JOIN ts ON seq <= t GROUP BY t, tok),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY n DESC, tok) AS BIGINT) AS rk FROM k) SELECT * FROM r WHERE rk <= {TOP}""")
def top_tokens(spark, d):
    return frequency.top_at_snapshots(_tokens(spark, d), INTERVAL, TOP)


@query(f"""{_BASE_C}, {_TIMES}, {_RUNNING.split(',' + chr(10))[0]}, e AS (SELECT t, tok, r, c FROM (SELECT tok, r, c, min(seq) AS f FROM pc GROUP BY tok, r, c) JOIN ts ON f <= t),
v AS (SELECT t, r, c, sum(n) AS v FROM pc JOIN ts ON seq <= t GROUP BY t, r, c), x AS (SELECT t, tok, CAST(min(v) AS BIGINT) AS est FROM e JOIN v USING (t, r, c) GROUP BY t, tok),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY est DESC, tok) AS BIGINT) AS rk FROM x) SELECT * FROM r WHERE rk <= {TOP}""")
def top_tokens_cms(spark, d):
    return MessageRun(_messages(spark, d), RUN).top_tokens()


@query(f"{_BASE}, k AS (SELECT DISTINCT tok FROM tk) SELECT tok, CAST(r AS INT) AS r, {_c('r', 'tok')} AS c FROM k, range({CMS.depth}) t(r)")
def cms_hash(spark, d):
    return _tokens(spark, d).select("tok").distinct().select("tok", F.inline(cms_cells_of(F.col("tok"), CMS)))


@query(f"{_BASE_C}, {_CELLS} SELECT * FROM cells")
def cms_cells(spark, d):
    return _cells(spark, d)


@query(f"{_BASE_C}, {_CELLS}, k AS (SELECT DISTINCT tok, r, c FROM pc) SELECT tok, CAST(min(v) AS BIGINT) AS est FROM k JOIN cells USING (r, c) GROUP BY tok")
def cms_estimate(spark, d):
    n = frequency.counts(_tokens(spark, d))
    return frequency.cms_estimate(n.select("tok"), frequency.cms_add(n, CMS), CMS)


@query(f"""{_BASE_C}, b AS (SELECT item_id AS seq, text AS body FROM benchmark), {_tok('b', 'tb')}, bc AS (SELECT CAST(r AS INT) AS r, {_c('r', 'tok')} AS c, 1 AS n FROM tb, range({CMS.depth}) t(r)),
u AS (SELECT r, c, n FROM pc UNION ALL SELECT * FROM bc) SELECT r, c, CAST(sum(n) AS BIGINT) AS v FROM u GROUP BY r, c""")
def cms_merge(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("seq"), F.col("text").alias("body"))
    return frequency.cms_merge(_cells(spark, d), frequency.cms_add(frequency.counts(X.tokens(items)), CMS), CMS, CMS)


@query(f"""{_BASE_C}, {_CELLS} SELECT CAST({CMS.width} AS INT) AS width, CAST({CMS.depth} AS INT) AS depth, CAST(count(*) AS BIGINT) AS used_cells, CAST({CMS.memory_bytes} AS BIGINT) AS memory_bytes,
CAST(sum(v) FILTER (r = 0) AS BIGINT) AS total_count FROM cells""")
def cms_stats(spark, d):
    return frequency.cms_stats(_cells(spark, d), CMS)


@query(f"""{_BASE_C}, {_CELLS}, q AS (SELECT unnest({TERMS!r}) AS term), k AS (SELECT term, CAST(r AS INT) AS r, {_c('r', 'lower(term)')} AS c FROM q, range({CMS.depth}) t(r))
SELECT term, CAST(min(coalesce(v, 0)) AS BIGINT) AS est FROM k LEFT JOIN cells USING (r, c) GROUP BY term""")
def freq_queries(spark, d):
    return frequency.estimate_terms(TERMS, _cells(spark, d), CMS)


@query(f"{_BASE_C}, {_RUNNING} SELECT c AS bin, arg_max(tok, (est, -seq, -pos, -r)) AS representative, max(est) AS best_score FROM re GROUP BY c")
def bin_representative(spark, d):
    return burst.representatives(burst.per_message(_tokens(spark, d)), CMS)


# --- duplicates and the Bloom filter ---


@query(f"{_BASE_D}, {_HITS}, {_SCORE} SELECT * FROM sc")
def dup_exact(spark, d):
    return duplicates.exact(_doc_messages(spark, d), DUP)


def _bits(key: str) -> str:
    h1, h2 = (f"('0x' || substr(md5('{DUP.bloom.seed}-' || {key}), {i}, 8))::BIGINT" for i in (1, 9))
    return f"({h1} + {h2} * i + i * i) % {DUP.bloom.bits}"


_BLOOM = f"""gb AS (SELECT seq, g, n, {_bits('g')} AS b FROM gs, range({DUP.bloom.hashes}) t(i)), bf AS (SELECT b, min(seq) AS f FROM gb GROUP BY b)"""


@query(f"{_BASE_D}, {_BLOOM}, hits AS (SELECT seq, n, hit FROM (SELECT gb.seq, g, n, bool_and(f < gb.seq) AS hit FROM gb JOIN bf USING (b) GROUP BY gb.seq, g, n)), {_SCORE} SELECT * FROM sc")
def dup_bloom(spark, d):
    return duplicates.through_bloom(_doc_messages(spark, d), DUP)


@query(f"""{_BASE_D}, {_BLOOM}, w AS (SELECT f AS seq, count(*) AS k FROM bf GROUP BY f)
SELECT m.seq, CAST(sum(coalesce(k, 0)) OVER (ORDER BY m.seq) AS DOUBLE) / {DUP.bloom.bits}::DOUBLE AS fill_ratio FROM m LEFT JOIN w USING (seq)""")
def bloom_fill(spark, d):
    return duplicates.fill_ratio(_doc_messages(spark, d), DUP)


@query(f"""{_BASE_D}, b AS (SELECT item_id AS seq, text AS body FROM benchmark), {_tok('b', 'tb')}, {_gram('tb', 'gq')}, fb AS (SELECT DISTINCT {_bits('g')} AS b FROM (SELECT DISTINCT g FROM gq), range({DUP.bloom.hashes}) t(i)),
p AS (SELECT g, count(x.b) = count(*) AS hit FROM (SELECT DISTINCT g, {_bits('g')} AS b FROM (SELECT DISTINCT g FROM gs), range({DUP.bloom.hashes}) t(i)) y LEFT JOIN fb x ON x.b = y.b GROUP BY g)
SELECT seq, CAST(sum(n) AS BIGINT) AS n_shingles, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS n_hits FROM gs JOIN p USING (g) GROUP BY seq""")
def bloom_membership(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("seq"), F.col("text").alias("body"))
    return duplicates.membership(items, _doc_messages(spark, d), DUP)


_SUMMARY = "CAST(count(*) FILTER ({k}) AS BIGINT) AS processed, CAST(count(*) FILTER (NOT {k}) AS BIGINT) AS excluded, CAST(count(*) FILTER ({k} AND is_duplicate) AS BIGINT) AS total"


@query(f"""{_BASE_D}, {_HITS}, {_SCORE}, s AS (SELECT {_SUMMARY.format(k='true')}, sum(duplicate_score) AS q FROM sc)
SELECT processed, excluded, total, CAST(total AS DOUBLE) / processed AS rate, CAST(round(q / processed * 1e6::DOUBLE) AS BIGINT) AS avg_score_e6 FROM s""")
def dup_summary(spark, d):
    scored = duplicates.exact(_doc_messages(spark, d), DUP)
    return duplicates.summary(scored).select("processed", "excluded", "total", "rate", F.round(F.col("avg_score") * 1e6).cast("long").alias("avg_score_e6"))


@query(f"{_BASE_D}, {_HITS}, {_SCORE} SELECT tok, CAST(count(*) AS BIGINT) AS n FROM tk JOIN sc USING (seq) WHERE NOT is_duplicate GROUP BY tok")
def freq_excluding_dups(spark, d):
    m = _doc_messages(spark, d)
    shown = duplicates.exact(m, DUP).where("NOT is_duplicate").select("seq")
    return frequency.counts(m.join(shown, "seq", "left_semi").select(F.explode(X.token_array(F.col("body"))).alias("tok")))


@query(f"{_BASE_D}, {_HITS}, {_SCORE} SELECT m.seq, body, is_duplicate, duplicate_score FROM m JOIN sc USING (seq)")
def message_echo(spark, d):
    return MessageRun(S.messages_from_documents(spark, d), RUN).echo()


# --- bursts, snapshots, ranks ---


@query(f"{_BASE_C}, ts AS (SELECT max(seq) AS t FROM m), {_BURSTS} SELECT t, bin, recent_count, prev_count, ratio, CAST(row_number() OVER (PARTITION BY t ORDER BY ratio DESC, recent_count DESC, bin) AS BIGINT) AS place FROM bf")
def burst_exact(spark, d):
    m = _messages(spark, d)
    per = burst.per_message(X.tokens(m))
    return burst.ordered(burst.at(burst.bin_events(per, CMS), m.agg(F.max("seq").alias("t")), "bin", BURST))


@query(f"{_BASE_C}, {_TIMES}, {_BURSTS.replace('c AS bin', 'tok AS bin').replace('FROM pc GROUP BY seq, c', 'FROM pm GROUP BY seq, tok')} SELECT t, bin AS tok, recent_count, prev_count, ratio FROM bf")
def burst_tokens(spark, d):
    m = _messages(spark, d)
    return burst.at(burst.per_message(X.tokens(m)), m.where(F.col("seq") % INTERVAL == 0).select(F.col("seq").alias("t")), "tok", BURST)


@query(f"{_BASE_C}, {_TIMES}, {_BURSTS}, {_RUNNING}, {_NAMED} SELECT * FROM bn")
def burst_snapshots(spark, d):
    return _bursts(spark, d)


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    per = written(burst.per_message(X.tokens(m)), "per-message")
    return burst.bins_at(per, m.where(F.col("seq") % INTERVAL == 0).select(F.col("seq").alias("t")), CMS, BURST)


@query()
def burst_dgim(spark, d):
    m = _messages(spark, d)
    last = m.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first().last
    return dgim.bursts(burst.bin_events(burst.per_message(X.tokens(m)), CMS), range(INTERVAL, last + 1, INTERVAL), BURST)


@query(f"""{_BASE_C}, {_TIMES}, {_BURSTS}, k AS (SELECT t, tok, count(*) AS n FROM tk JOIN ts ON seq <= t GROUP BY t, tok), b AS (SELECT t, count(*) AS n_bursts FROM bf GROUP BY t),
s AS (SELECT t, sum(n) AS n_tokens, count(*) AS n_distinct FROM k GROUP BY t)
SELECT t, t AS message_count, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_distinct AS BIGINT) AS n_distinct, CAST(coalesce(n_bursts, 0) AS BIGINT) AS n_bursts FROM s LEFT JOIN b USING (t)""")
def snapshots(spark, d):
    run = MessageRun(_messages(spark, d), RUN)
    times = run.snapshot_times()
    new = run.per_message.groupBy("tok").agg(F.min("seq").alias("f")).groupBy(F.ceil(F.col("f") / INTERVAL).alias("i")).agg(F.count(F.lit(1)).alias("d"))
    n = run.per_message.groupBy(F.ceil(F.col("seq") / INTERVAL).alias("i")).agg(F.sum("n").alias("n"))
    both = n.join(new, "i", "full").na.fill(0)
    order = Window.orderBy("i")  # a row per snapshot interval
    sums = both.select((F.col("i") * INTERVAL).alias("t"), F.sum("n").over(order).alias("n_tokens"), F.sum("d").over(order).alias("n_distinct"))
    upto = times.join(sums, "t")
    found = burst.at(burst.bin_events(run.per_message, CMS), times.select("t"), "bin", BURST).groupBy("t").agg(F.count(F.lit(1)).alias("n_bursts"))
    return upto.join(found, "t", "left").select("t", F.col("processed").alias("message_count"), "n_tokens", "n_distinct", F.coalesce("n_bursts", F.lit(0)).cast("long").alias("n_bursts"))


@query(f"""{_BASE_C}, s AS (SELECT count(DISTINCT tok) AS d, sum(n) AS n FROM pm) SELECT CAST((SELECT count(*) FROM m) AS BIGINT) AS processed, CAST(n AS BIGINT) AS tokens, CAST(d AS BIGINT) AS distinct_tokens,
CAST((SELECT count(*) FROM m) // {INTERVAL} AS BIGINT) AS snapshots FROM s""")
def summary_counts(spark, d):
    m = _messages(spark, d)
    n = m.count()
    sums = frequency.counts(X.tokens(m)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))
    return sums.select(F.lit(n).cast("long").alias("processed"), "tokens", "distinct_tokens", F.lit(n // INTERVAL).cast("long").alias("snapshots"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return ranks.top_bursts(_bursts(spark, d), BUMP)


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranks.ranks(ranks.terms(_top(spark, d)))


@query(f"{_BUMP} SELECT * FROM tp")
def bump_topk(spark, d):
    return _top(spark, d)


@query(f"{_BUMP} SELECT * FROM tm")
def bump_terms(spark, d):
    return ranks.terms(_top(spark, d))


@query(f"{_BUMP} SELECT b.t, a.term, c.ratio FROM (SELECT DISTINCT term FROM tm) a CROSS JOIN (SELECT unnest(range(min(t), max(t) + 1, {INTERVAL})) AS t FROM tm) b LEFT JOIN tm c ON c.term = a.term AND c.t = b.t")
def bump_wide(spark, d):
    """The outer join over all snapshots in long form: a row per term and snapshot, the ratio null where the term is absent."""
    return ranks.outer(ranks.terms(_top(spark, d)), INTERVAL)


@query(f"{_BUMP} SELECT * FROM rk")
def bump_ranks(spark, d):
    return _ranks(spark, d)


@query(f"{_BUMP} SELECT term, CAST(count(*) AS BIGINT) AS appearances, CAST(least(count(*), 5) AS BIGINT) AS marker FROM rk GROUP BY term")
def bump_markers(spark, d):
    return ranks.markers(_ranks(spark, d))


@query(f"""{_BUMP}, i AS (SELECT *, t // {INTERVAL} - row_number() OVER (PARTITION BY term ORDER BY t) AS island FROM rk WHERE rank <= {ranks.DRAWN})
SELECT term, min(t) AS first_t, max(t) AS last_t, CAST(count(*) AS BIGINT) AS points FROM i GROUP BY term, island""")
def bump_segments(spark, d):
    return ranks.segments(_ranks(spark, d), INTERVAL)


# --- count and time windows over events; streams ---


@query("""e AS (SELECT event_type, ts, event_id, value, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seq FROM events),
k AS (SELECT (seq - 1) // 500 AS w, event_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL) SELECT CAST(w AS BIGINT) AS w, event_type, n FROM k""")
def count_windows(spark, d):
    from tidemark.operators.sequence import sequenced as number

    e = number(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "event_type"), ["ts", "event_id"])
    return e.groupBy(F.floor((F.col("seq") - 1) / 500).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type FROM events) SELECT strftime(start, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def time_windows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type FROM events) SELECT strftime(start, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def stream_time_windows(spark, d):
    table = spark.read.parquet(f"{d}/events.parquet")
    events = spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")
    out = MessageStream(spark, RUN, []).play_over_time(events, "ts", "event_type", "1 day", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(f"{_BASE} SELECT tok, CAST(count(*) AS BIGINT) AS n FROM tk GROUP BY tok")
def stream_freq(spark, d):
    return _stream(spark, d).frequencies()


@query(f"{_BASE}, {_gram()}, gs AS (SELECT seq, g, count(*) AS n FROM g3 GROUP BY seq, g), {_HITS}, {_SCORE} SELECT * FROM sc")
def stream_dup(spark, d):
    return _stream(spark, d).duplicates()


@query(f"{_BASE_C}, ts AS (SELECT max(seq) AS t FROM m), {_BURSTS} SELECT t, bin, recent_count, prev_count, ratio FROM bf")
def stream_burst(spark, d):
    return _stream(spark, d).bursts()


def _stream(spark: SparkSession, d: str) -> MessageStream:
    """The conversations as a stream of files, played to its end."""
    table = S.conversations_table(spark, d)
    rows = spark.readStream.schema(table.schema).parquet(f"{d}/conversations.parque[t]")
    messages = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("body"))
    out = MessageStream(spark, RUN, ["conv_id", "turn"])
    out.play(messages)
    return out
