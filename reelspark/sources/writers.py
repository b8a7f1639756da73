"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

METADATA_ORDER = ["movieId", "tmdbId", "overview", "cast", "director", "release_year",
                  "poster_path", "poster_url", "fetch_status", "fetch_error"]


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Files a task may have open at once (more splits than that: the writer sorts), and bytes of a row
#: group, so that the open files together hold about as much as one with the default size.
OPEN_FILES = 8
SPLIT_ROW_GROUP = 32 * 1024 * 1024


def sink_splits(rows: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Split rows to Parquet, zstd, at most ``max_records`` rows per file, one directory per
    split. No shuffle: there are only three split values, so clustering by them would put
    each split (70 % of all rows for train) into one task; every task writes its own rows
    into the split directories instead. It keeps a file of each split open, as otherwise the writer
    sorts all the wide rows of a task by split first, which takes its memory and then spills."""
    conf = rows.sparkSession.conf
    before = conf.get(WRITERS, "0")
    conf.set(WRITERS, str(OPEN_FILES))
    try:
        (rows.write.mode("overwrite")
         .option("compression", "zstd").option("maxRecordsPerFile", max_records)
         .option("parquet.block.size", SPLIT_ROW_GROUP).partitionBy("split").parquet(path))
    finally:
        conf.set(WRITERS, before)


def sink_metadata(metadata: DataFrame, base: str, stem: str = "metadata_df") -> None:
    """Ordered columns to Parquet and CSV."""
    cols = [c for c in METADATA_ORDER if c in metadata.columns]
    ordered = metadata.select(*cols)
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{base.rstrip('/')}/{stem}.parquet")
    ordered.write.mode("overwrite").option("header", True).csv(f"{base.rstrip('/')}/{stem}.csv")


def sink_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").option("compression", "zstd").parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_sink(comparison: DataFrame, clean_stats: DataFrame, base: str, summary: DataFrame | None = None) -> None:
    """Model comparison as CSV; under ``report``, as JSON: all models by validation RMSE, the
    clean statistics per split, and the summary (best model, global mean, row counts, histories)."""
    base = base.rstrip("/")
    comparison.write.mode("overwrite").option("header", True).csv(f"{base}/model_comparison.csv")
    comparison.orderBy("val_RMSE").write.mode("overwrite").json(f"{base}/report/models")
    clean_stats.write.mode("overwrite").json(f"{base}/report/clean_stats")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{base}/report/summary")
