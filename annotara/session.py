"""Session helpers: table loading, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_STORED: list[tuple[SparkSession, str]] = []


def get_session(app: str = "annotara", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where it is
    unset and the session runs in one process (tests), a temporary folder is
    made and set. A cluster that names none is an error: its executors could
    not read what one machine keeps to itself."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="annotara-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives the
    loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files of a write are deleted when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; release() deletes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/annotara-{uuid.uuid4().hex}"
    _STORED.append((spark, path))
    return path


def put(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write df there, in a folder for each value of by; its shuffle files go at once."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written there; nothing may read it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, path) in _STORED:
        _STORED.remove((spark, path))


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage like cut(), but
    columnar and compressed. release() deletes the session's tables."""
    path = path or folder(df.sparkSession)
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables stored() wrote in this session; call it when their
    results are no longer read."""
    for s, path in [x for x in _STORED if x[0] is spark]:
        discard(s, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def testdata(sf: str) -> str:
    return os.path.join(os.environ.get("ANNOTARA_DATA", "/root/testdata"), f"sf{sf}")


__all__ = ["F", "checkpoint_dir", "cut", "discard", "folder", "get_session", "partitions", "put", "release", "stored", "table", "testdata"]
