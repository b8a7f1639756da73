"""Stage reuse: a stage's output is kept as Parquet next to a one-row pointer table, which
names the folder and the fingerprint (config and input files) it was built from. A later run
reuses the output only when the fingerprint is equal.

Each build writes to a folder of its own, and the pointer is written after the data: a failed
or killed build leaves the old pointer, whose folder is untouched."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.memo import input_key
from .readers import _exists


def stage(spark: SparkSession, base: str, name: str, fingerprint: str, build: Callable[[], DataFrame],
          fresh: bool = False, inputs: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(stage output, reused?). ``inputs``: paths whose files are part of the fingerprint.
    ``fresh`` ignores any stored output."""
    home = f"{base.rstrip('/')}/{name}"
    full = f"{fingerprint}|{input_key(spark, inputs or [])}"
    schema = "fingerprint string, data string, version long"
    pointers = f"{home}/pointers"
    last = None
    if _exists(spark, pointers):
        last = spark.read.schema(schema).json(pointers).orderBy("version", ascending=False).first()
    if last is not None and not fresh and last["fingerprint"] == full and _exists(spark, f"{last['data']}/_SUCCESS"):
        return spark.read.parquet(last["data"]), True
    data = f"{home}/data-{uuid.uuid4().hex[:12]}"
    build().write.option("compression", "zstd").parquet(data)
    version = 0 if last is None else last["version"] + 1
    spark.createDataFrame([(full, data, version)], schema).coalesce(1).write.mode("append").json(pointers)
    return spark.read.parquet(data), False
