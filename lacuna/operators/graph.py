"""Connected components as iterated joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one in use, or else that of spark.checkpoint.dir.

    Without either, a local master gets a temporary one; on a cluster that would be a folder of each machine's own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lacuna-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _forget(df: DataFrame) -> DataFrame:
    """The same rows without the size that the planner has estimated for them.

    A checkpoint keeps the estimate of its plan, which for a join is a product of sizes: in an iteration
    it soon has more digits than the planner can multiply.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that an edge names; component is the least id that it reaches.

    Each round every vertex looks at its neighbours' labels' labels. The least of them it takes itself, and
    hands to the vertex that it is labelled by, so that whole trees hook on to each other; then its own
    label's label (pointer jumping). Rounds grow with the logarithm of the size, long chains included.
    All are equi-joins and aggregations with map-side combine; a vertex with very many edges is a skewed
    join side, which adaptive execution splits. Null ends are no edges; loops and repeated edges do no
    harm; without edges no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id")
    before = None
    while True:
        up = labels.join(labels.select(F.col("id").alias("label"), F.col("label").alias("above")), "label")
        near = both.join(up.select(F.col("id").alias("v"), "above"), "v").groupBy("u").agg(F.min("above").alias("near"))
        seen = up.join(near.withColumnRenamed("u", "id"), "id")
        hook = seen.groupBy("label").agg(F.min("near").alias("hook")).withColumnRenamed("label", "id")
        labels = seen.join(hook, "id", "left").select("id", F.least("label", "above", "near", "hook").alias("label"))
        labels = _forget(cut(labels))
        # labels only ever fall, so their sum tells whether any did
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels.select("id", F.col("label").alias("component"))
        before = total
