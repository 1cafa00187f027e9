"""Shared scratch space for what must be computed once."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SWEPT: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only if driver and executors are one process;
    on a cluster each machine would write to a disk of its own, and later reads would miss rows."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session is gone, and with it all that could delete
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once. The session's tables go when the driver ends, or by
    `release` before."""
    spark = df.sparkSession
    home = f"{scratch(spark)}/tables-{spark.sparkContext.applicationId}"
    if home not in _SWEPT:
        _SWEPT.add(home)
        atexit.register(_sweep, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets go of the shuffle files of finished steps."""
    spark = tables[0].sparkSession
    for t in tables:
        for folder in {x.rpartition("/")[0] for x in t.inputFiles()}:
            _delete(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df
