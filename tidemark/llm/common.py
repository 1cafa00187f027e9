"""What the corpus operators share: reading tables, bounded Arrow batches, checked broadcasts; shared scratch space is that of the whole library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.storage import release, written  # noqa: F401  used through this module

#: ASCII white space as the contracts define it, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"

#: Most rows that `small()` lets through to a broadcast.
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch at most, beside a single row that is larger: texts may be long, and a batch exists several times over on both sides.
ARROW_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded batches; the bound holds for the session from then on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(run, schema)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make() gives, once per Python worker. A worker serves one stage after the other, so it holds one such object at a time: a vocabulary or a model."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *taken: str) -> tuple[list[T.StructField], list[int]]:
    """The columns of df but those whose names are taken (in any case, as Spark compares names), and their places."""
    low = {t.lower() for t in taken}
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in low]
    return [df.schema.fields[i] for i in places], places


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many (narrow) rows, else as it is. df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone; 52 bits of an MD5 digest, so that any SQL engine can repeat it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
