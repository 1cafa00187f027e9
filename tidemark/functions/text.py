"""Text expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that separates words, as a character class body of Java and RE2.
SPACE = r" \t\n\x0B\f\r"

_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_TOKEN = rf"(?<![^{SPACE}])[^\p{{L}}\p{{N}}{SPACE}]*+(\p{{L}}++)[^\p{{L}}\p{{N}}{SPACE}]*+(?![^{SPACE}])"

# The sentence that exported chats put before described files, and the label of a file.
BOILERPLATE = "This message contains files. If the description for a file does not make sense, ignore it.Here are descriptions of those files:\nDescription for file 1:"
FILE_LABEL = r"Description for file \p{Nd}+:"

# Spark's default English stop words, here so that SQL can be written without a session.
ENGLISH_STOPS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't
aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's
ought that's there's what's when's where's who's why's would
""".split()

# Names and noise of the corpora, beside the English stop words.
EXTRA_STOPS = ("cindy", "jenkins", "enron", "u")


def scrub(body: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Removes the boilerplate sentence and file labels."""
    return F.regexp_replace(F.replace(body, F.lit(boilerplate), F.lit("")), FILE_LABEL, "")


def words(body: Column) -> Column:
    """Lower-cased words, as an array; a token is a word without signs at its ends, if only letters are left."""
    return F.split(F.trim(F.regexp_replace(F.lower(body), f"[{SPACE}]+", " ")), " ")


def has_token(body: Column) -> Column:
    """Whether the text has any token; no explode needed."""
    return body.rlike(rf"(^|[{SPACE}])[^\p{{L}}\p{{N}}{SPACE}]*\p{{L}}+[^\p{{L}}\p{{N}}{SPACE}]*($|[{SPACE}])")


def tokens(messages: DataFrame, body: str = "body", lemma: bool = False, stops: list[str] | None = None) -> DataFrame:
    """messages: seq, body. Returns seq, pos (place among the words, from 1), tok. Stop words go after lemmatising."""
    rows = messages.select("seq", F.posexplode(words(F.col(body))).alias("p", "w"))
    tok = F.regexp_replace("w", _EDGE, "")
    rows = rows.select("seq", (F.col("p") + 1).cast("long").alias("pos"), tok.alias("tok")).where(F.col("tok").rlike(r"^\p{L}+$"))
    if lemma:
        rows = rows.withColumn("tok", singular(F.col("tok")))
    return rows if stops is None else rows.where(~F.col("tok").isin(stops))


def token_array(body: Column) -> Column:
    """The same tokens in order, as an array: one pass over the text, no explode."""
    return F.regexp_extract_all(F.lower(body), F.lit(_TOKEN), 1)


def processed(body: Column, stops: list[str] | None = None, lemma: bool = True) -> Column:
    """The text that the detectors stream: its tokens, lemmatised, without stop words, joined by a space; empty if none is left."""
    toks = token_array(body)
    if lemma:
        toks = F.transform(toks, singular)
    if stops is not None:
        toks = F.filter(toks, lambda t: ~t.isin(stops))
    return F.array_join(toks, " ")


def singular(tok: Column) -> Column:
    """The rule lemmatiser: plural endings of English nouns. Words of up to three letters, and in -ss, -us or -is, stay."""
    return (
        F.when((F.length(tok) <= 3) | tok.rlike("(ss|us|is)$"), tok)
        .when(tok.rlike("[^aeiou]ies$"), F.regexp_replace(tok, "ies$", "y"))
        .when(tok.rlike("(x|ch|sh|ss|z)es$"), F.regexp_replace(tok, "es$", ""))
        .when(tok.rlike("s$"), F.regexp_replace(tok, "s$", ""))
        .otherwise(tok)
    )


def stop_words(extended: bool = True) -> list[str]:
    """English stop words, with the extras if extended."""
    return sorted({*ENGLISH_STOPS, *(EXTRA_STOPS if extended else ())})


def joined(toks: DataFrame) -> DataFrame:
    """tokens back to one processed body per message: seq, body."""
    return toks.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("body"))


def shingles(toks: DataFrame, k: int = 3) -> DataFrame:
    """Word k-grams, repeats kept: seq, pos, g. k = 1 gives the tokens; messages of fewer than k tokens give none. `gram_rows` has them without places, and
    without a sort."""
    if k <= 1:
        return toks.select("seq", "pos", F.col("tok").alias("g"))
    order = Window.partitionBy("seq").orderBy("pos")
    nexts = [F.lead("tok", i).over(order).alias(f"t{i}") for i in range(1, k)]
    rows = toks.select("seq", "pos", "tok", *nexts).where(F.col(f"t{k - 1}").isNotNull())
    return rows.select("seq", "pos", F.concat_ws(" ", "tok", *(f"t{i}" for i in range(1, k))).alias("g"))


def gram_rows(messages: DataFrame, k: int = 3) -> DataFrame:
    """messages: seq, body. Returns seq, g of every word k-gram, repeats kept. A message's k-grams come from its own token array, shifted k - 1 times and
    zipped: nothing is shuffled or sorted."""
    k = max(k, 1)
    toks = messages.select("seq", token_array(F.col("body")).alias("t0")).where(F.size("t0") >= k)
    shifted = toks.select("seq", "t0", *(F.slice("t0", i + 1, F.size("t0")).alias(f"t{i}") for i in range(1, k)))
    rows = shifted.select("seq", F.inline(F.arrays_zip(*(f"t{i}" for i in range(k)))))
    return rows.where(F.col(f"t{k - 1}").isNotNull()).select("seq", F.concat_ws(" ", *(f"t{i}" for i in range(k))).alias("g"))
