"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast at once: 8 MB as longs.
BROADCAST_ROWS = 1_000_000

_own_dir: list[str] = []
#: The scratch paths of this session that were not deleted.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets one of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="stratafile-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    made.append(f"{shared_dir(spark)}/stratafile/{name}-{uuid.uuid4().hex}")
    return made[-1]


def forget(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Deletes the scratch paths that were made since `made` had that length, but `keep`. Frames that read them can't be read afterwards."""
    for path in made[since:]:
        if path != keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made[since:] = [keep] if keep in made[since:] else []


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, whole after the loss of any executor."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; written first, so that counting doesn't compute it twice."""
    return F.broadcast(df) if df.count() <= most else df
