"""Session memo for what several queries of one session share: small statistics read back as
literals, and stage tables written to the shared folder. Keys name the input files with
their sizes and modification times, so replaced files are read anew."""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_MEMO: dict[tuple, Any] = {}


def input_key(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, bytes, modification time) of every file under ``paths``, from the file system
    that Spark reads them with."""
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    found = []
    for path in sorted(set(paths)):
        root = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def memo_stat(df: DataFrame, name: str, compute: Callable[[], Any]) -> Any:
    """``compute()``, once per session for the same plan over the same input files; each time
    for tables that come from no file. Plan text and hash are both part of the key."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return compute()
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    key = (spark.sparkContext.applicationId, name, df.semanticHash(), plan, input_key(spark, files))
    if key not in _MEMO:
        _MEMO[key] = compute()
    return _MEMO[key]


def clear() -> None:
    _MEMO.clear()


def memo_stage(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame],
               write: Callable[[DataFrame, str], None]) -> DataFrame:
    """The stage table ``name``, written once per session and set of input files to the
    shared folder, and read back as Parquet (so scans prune columns, partitions and row
    groups). The path is remembered only after the write has ended."""
    key = (spark.sparkContext.applicationId, "stage", name, input_key(spark, inputs))
    if key not in _MEMO:
        path = scratch_path(spark, name)
        write(build(), path)
        _MEMO[key] = path
    return spark.read.parquet(_MEMO[key])
