"""Numbers along an order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import cut


def numbered(df: DataFrame, order: list[Column | str], name: str, groups: list[str] | None = None) -> DataFrame:
    """df with name: 1, 2, ... in that order, within each group (null is a group of its own).

    Rows are dealt to ranges of (groups, order) and numbered inside their range; what comes before a range is
    a running sum over one row for each range and group in it. The ranges are written down, as they come from
    a sample that another run may draw differently. A group of any size spans as many ranges as it needs;
    rows that agree on the whole order stay together and are numbered in any sequence, so name a last key that tells them apart.
    """
    groups = groups or []
    own = cut(df.repartitionByRange(*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("_range", F.spark_partition_id()))
    size = own.groupBy(*groups, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = size.select(*[F.col(g).alias(f"_group_{g}") for g in groups], F.col("_range").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    meet = F.col("_range") == F.col("_of")
    for g in groups:
        meet &= F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    return own.withColumn("_inside", inside).join(start, meet).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))
