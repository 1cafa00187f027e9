"""Sources: nested conversation files, tables, and the message stream that both become."""

from __future__ import annotations

import abc
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.sequence import sequenced
from tidemark.plans.storage import scratch, written

#: Unknown keys of the files are dropped.
SCHEMA = "messages array<struct<body:string,time:double,medium:string,is_inbound:boolean>>"

# Conversations with a message over one of these are left out.
EXCLUDED_MEDIA = ("Instagram", "Telegram")


def read_files(spark: SparkSession, data_dir: str, splits: dict[str, str] | None = None) -> DataFrame:
    """Every .json file below each split's folder, one conversation each: conv_id (its path), split, messages. Missing messages are an empty list, and a
    missing folder has no conversations."""
    out = spark.createDataFrame([], f"conv_id string, split string, {SCHEMA}")
    for split, folder in (splits or {"train": "train_convs", "test": "test_convs"}).items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{folder}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        files = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{data_dir}/{folder}")
        rows = files.select(F.col("_metadata.file_path").alias("conv_id"), F.lit(split).alias("split"), F.coalesce("messages", F.array().cast("array<struct<body:string,time:double,medium:string,is_inbound:boolean>>")).alias("messages"))
        out = out.unionByName(rows)
    return out


def exclude_media(conversations: DataFrame, media: tuple[str, ...] = EXCLUDED_MEDIA) -> DataFrame:
    """Drops a conversation whole if any of its messages came over one of the media; a missing medium is none of them."""
    return conversations.where(~F.exists("messages", lambda m: F.coalesce(m["medium"].isin(*media), F.lit(False))))


def inbound(conversations: DataFrame) -> DataFrame:
    """Keeps inbound messages; where the mark is missing, the message goes."""
    return conversations.withColumn("messages", F.filter("messages", lambda m: F.coalesce(m["is_inbound"], F.lit(False))))


def flattened(conversations: DataFrame, use_skipwords: bool | None = True) -> DataFrame:
    """A row per message: conv_id, split, turn, and the message's fields. Null and empty bodies go; the scrubbed text is kept as raw_body, and body becomes
    what is streamed: lemmatised tokens without stop words, with use_skipwords those of the corpora too. None leaves body scrubbed only."""
    rows = conversations.select("conv_id", "split", F.posexplode("messages").alias("turn", "m")).select("conv_id", "split", "turn", "m.*")
    rows = rows.withColumn("raw_body", X.scrub(F.col("body"))).where("raw_body IS NOT NULL AND raw_body <> ''")
    return rows.withColumn("body", F.col("raw_body") if use_skipwords is None else X.processed(F.col("raw_body"), X.stop_words(use_skipwords)))


def stream(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages whose processed body has tokens, numbered from 1 in order of time, missing time last, then conversation and turn."""
    rows = messages.where(X.has_token(F.col("body")))
    return sequenced(rows, ["time", "conv_id", "turn"], limit)


class Loader(abc.ABC):
    """A data set: subclasses say how its conversations are read; splits and results are kept by configuration."""

    def __init__(self, data_dir: str, label: str = "", sample_size: int | None = None, dataset_name: str | None = None, use_skipwords: bool = True, random_state: int = 42):
        self.data_dir, self.label, self.sample_size, self.use_skipwords, self.random_state = data_dir, label, sample_size, use_skipwords, random_state
        self.dataset_name = dataset_name or type(self).__name__

    @abc.abstractmethod
    def process(self, spark: SparkSession, all_messages: bool = False) -> DataFrame:
        """Conversations of all splits: conv_id, split, messages."""

    def options(self, all_messages: bool) -> dict:
        """All that the result depends on."""
        return {k: str(v) for k, v in vars(self).items()} | {"all_messages": str(all_messages), "kind": type(self).__name__}

    def load(self, spark: SparkSession, force_reload: bool = False, all_messages: bool = False) -> DataFrame:
        """The processed conversations with label and dataset; read from the shared folder if the same configuration was loaded before."""
        key = hashlib.md5(json.dumps(self.options(all_messages), sort_keys=True).encode()).hexdigest()
        path = f"{scratch(spark)}/loaded-{key}"
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        done = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path.suffix("/_SUCCESS"))
        if force_reload or not done:
            rows = self.process(spark, all_messages)
            rows.withColumns({"label": F.lit(self.label), "dataset": F.lit(self.dataset_name)}).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


    def messages(self, spark: SparkSession, split: str, limit: int | None = None, **how) -> DataFrame:
        """The message stream of one split, processed as the loader says; empty for a split that isn't there."""
        found = self.load(spark, **how)
        return stream(flattened(found.where(F.col("split") == split), self.use_skipwords), limit)


class ChatFiles(Loader):
    """Chat and e-mail conversations as JSON files in one folder per split."""

    def __init__(self, data_dir: str, train_data_dir: str = "train_convs", test_data_dir: str = "test_convs", **options):
        super().__init__(data_dir, **({"label": "scam"} | options))
        self.train_data_dir, self.test_data_dir = train_data_dir, test_data_dir

    def process(self, spark: SparkSession, all_messages: bool = False) -> DataFrame:
        from tidemark.operators.sampling import sample_per_split

        rows = read_files(spark, self.data_dir, {"train": self.train_data_dir, "test": self.test_data_dir})
        if not all_messages:
            rows = inbound(exclude_media(rows))
        return rows if self.sample_size is None else sample_per_split(rows, self.sample_size, self.random_state)


def load_all(spark: SparkSession, loaders: list[Loader], test_size: float = 0.2, val_size: float = 0.1, **how) -> dict[str, DataFrame]:
    """Data sets by name; of equal names the last one stays. Rows whose split is `all` are dealt to train, val and test."""
    from tidemark.operators.sampling import row_split

    out = {}
    for one in loaders:
        rows = one.load(spark, **how)
        whole = rows.where("split = 'all'")
        out[one.dataset_name] = rows.where("split <> 'all'").unionByName(row_split(whole, "conv_id", test_size, val_size, one.random_state), allowMissingColumns=True)
    return out


def splits_of(found: dict[str, DataFrame], name: str) -> tuple[DataFrame, ...]:
    """train, val, test of one data set; three empty results if there's no such set."""
    rows = found.get(name)
    if rows is None:
        rows = SparkSession.active().createDataFrame([], f"conv_id string, split string, {SCHEMA}, label string, dataset string")
    return tuple(rows.where(F.col("split") == s) for s in ("train", "val", "test"))


def conversations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's stream: what users wrote, in order of conversation and turn. seq, conv_id, turn, body."""
    rows = conversations_table(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("body"))
    return sequenced(rows.where(X.has_token(F.col("body"))), ["conv_id", "turn"])


def messages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages, in order of doc_id, numbered once: seq, doc_id, body."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    return written(sequenced(rows.where(X.has_token(F.col("body"))), ["doc_id"]), "messages")
