"""Working tables in the folder that the cluster shares, made once and read by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's part of spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corvane-')}")
            current = context._jsc.sc().getCheckpointDir()
        base = current.get()
    return f"{base}/tables-{context.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> tuple | None:
    """The plan of df and the files it reads, with their lengths and times: equal only while both are the same. None if it reads no files."""
    spark = df.sparkSession
    paths, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for f in sorted(df.inputFiles()):
        status = paths(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(paths(f))
        found.append((f, status.getLen(), status.getModificationTime()))
    return (df.semanticHash(), *found) if found else None


_MADE: dict[tuple, object] = {}


def once(sources: list[DataFrame], name: str, make: Callable[[], object]):
    """What make() gives, made once an application for sources that read the same rows of the same files; make stores the tables it returns."""
    prints = [fingerprint(s) for s in sources]
    if None in prints:
        return make()
    key = sources[0].sparkSession.sparkContext.applicationId, name, *prints
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]
