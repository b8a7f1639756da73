"""A training corpus from ``documents``, in five stages of the llm operators.

Every stage works on all rows that the stage before it kept, and returns the columns of
``documents`` (the last one its packing). Each is written as Parquet to the shared
folder and read again before the next.

1. ``language_id``: documents whose language is rejected (no letter, or a calibrated score
   below the limit) go.
2. ``jaccard_join``: of each group of near duplicates (3 of 4 shingles shared) the document
   with the smallest doc_id stays. Rows with the same doc_id and text are one document; rows
   with the same doc_id and different texts are different ones.
3. ``substring_dedup``: passages of 50 words or more that an earlier document has are cut; a
   document of which nothing is left goes.
4. ``decontaminate``: words in passages of benchmark items are cut; a document that is mostly
   such passages goes.
5. ``best_fit_packing``: what is left is packed into sequences of 4096 tokens.

Changed texts get a new ``n_chars``; unchanged rows stay as they are. Documents without a
doc_id are kept by stages 2 to 4 (they have no near duplicate and no earlier document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, jaccard, langid, packing, substring
from reelspark.llm.components import written
from reelspark.llm.identity import text_key
from reelspark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHER = ["lang", "source", "n_chars"]


def _columns(rows: DataFrame, changed=None) -> DataFrame:
    """The columns of documents, with the length of changed texts."""
    n_chars = F.col("carried.n_chars")
    if changed is not None:
        n_chars = F.when(changed, F.length("text").cast("long")).otherwise(n_chars)
    return rows.select("doc_id", "text", "carried.lang", "carried.source", n_chars.alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(langid.classify(spark, docs, carry=OTHER).where("NOT rejected"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = jaccard.link_rows(spark, docs.select("doc_id", "text"))
    first = written(spark, linked.where("first").select("doc_id", "text_key").distinct(), "pipeline-first")
    stay = (docs.select(*COLUMNS).withColumn("text_key", text_key()).join(first, ["doc_id", "text_key"], "left_semi")
            .dropDuplicates(["doc_id", "text_key"]))
    return stay.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(spark, docs, width=50, carry=OTHER)
    return _columns(cut.where("n_removed = 0 OR n_removed < n_words"), F.col("n_removed") > 0)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontaminate.remove_hits(spark, docs, table(spark, sf_dir, "benchmark"), width=10, carry=OTHER)
    return _columns(clean, F.col("n_hit") > 0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers have the memory of four stages behind them: a smaller table of chunks than packing alone takes
    return packing.pack_documents(spark, docs, capacity=4096, max_chunks=150_000)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminated),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer and the classifier have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
