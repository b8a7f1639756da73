"""Connected components of an edge table, by Spark joins.

Every node takes the smallest label among its neighbours and then the label of its label
(pointer jumping), until nothing changes; a round is a few joins whose lineage is cut by
writing the labels to the shared folder. The edges of a hub are split by the adaptive
skew join; minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, is computed once."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by ``written``, once all that reads them has been written itself."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, carry: list[str] | None = None, **types: str) -> DataFrame:
    """The named columns, cast to their types, whatever else the table has (also columns
    whose names differ in case only, or repeat: the first exact match counts). With
    ``carry``, those columns come along as one struct column ``carried``."""
    names = df.columns
    missing = [c for c in [*types, *(carry or ())] if c not in names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    at = df.toDF(*[f"c{i}" for i in range(len(names))])

    def col(name):
        return at[f"c{names.index(name)}"]

    out = [col(c).cast(t).alias(c) for c, t in types.items()]
    if carry is not None:
        out.append(F.struct(*[col(c).alias(c) for c in carry] or [F.lit(None).cast("int").alias("nothing")]).alias("carried"))
    return at.select(*out)


def carried_type(df: DataFrame) -> str:
    return df.schema["carried"].dataType.simpleString()


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """edges(a, b) -> (id, component): component is the smallest id that can be reached.
    Only ids that occur in an edge are returned. No edges: an empty table."""
    both = written(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = written(spark, both.groupBy(F.col("a").alias("id"))
                     .agg(F.min("b").alias("m"))
                     .select("id", F.least("id", "m").alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a")
                .agg(F.min("component").alias("near")))
        best = labels.join(near, labels["id"] == near["a"]).select(
            "id", "component", F.least("component", "near").alias("best"))
        up = labels.select(F.col("id").alias("up_id"), F.col("component").alias("up"))
        step = best.join(up, best["best"] == up["up_id"], "left").select(
            "id", F.least("best", "up").alias("component"),
            (F.least("best", "up") < F.col("component")).alias("moved"))
        step = written(spark, step, "cc-labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
