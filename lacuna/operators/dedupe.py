"""Removal of repeated and near points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.djoin import distance_join
from lacuna.operators.graph import connected_components, cut


def first_wins(points: DataFrame, order: str = "seq") -> DataFrame:
    """The first row, by order, of each position (six decimals)."""
    w = Window.partitionBy(F.round("x", 6), F.round("y", 6)).orderBy(order)
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sequential_keep(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """In order, a point stays unless it is nearer than tolerance (strictly) to one that has stayed."""
    kept: dict[tuple[int, int], list[int]] = {}
    out = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        u, v = int(a // tolerance), int(b // tolerance)
        near = (j for du in (-1, 0, 1) for dv in (-1, 0, 1) for j in kept.get((u + du, v + dv), ()))
        if all((x[j] - a) ** 2 + (y[j] - b) ** 2 >= tolerance * tolerance for j in near):
            out[i] = True
            kept.setdefault((u, v), []).append(i)
    return out


#: Rounds of joins before what is still undecided goes chain by chain.
ROUNDS = 12


def tolerance_dedupe(points: DataFrame, tolerance: float, order: str = "seq") -> DataFrame:
    """Points by order (an integer, unique), each kept unless it is nearer than tolerance to a kept one.

    Rounds over the close pairs: a point without an undecided earlier neighbour is kept, and its later
    neighbours go. Where points come in any order a few rounds decide all. Of chains numbered along their
    length, such as lines of samples, what ROUNDS rounds leave is decided chain by chain.
    """
    own = points.select(order, "x", "y")
    pairs = cut(distance_join(own, own, tolerance, strict=True).where(f"{order} < r_{order}").select(F.col(order).alias("a"), F.col(f"r_{order}").alias("b")))
    dropped, turn = pairs.select("b").limit(0), 0
    while turn < ROUNDS and not pairs.isEmpty():
        turn += 1
        kept = pairs.select(F.col("a").alias("k")).distinct().join(pairs.select(F.col("b").alias("k")), "k", "left_anti")
        gone = cut(pairs.join(kept.withColumnRenamed("k", "a"), "a", "left_semi").select("b").distinct())
        dropped = cut(dropped.unionByName(gone))
        # pairs of a dropped point say nothing more, nor do those of a kept one
        pairs = cut(pairs.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
    if not pairs.isEmpty():
        chains = connected_components(pairs).withColumnRenamed("id", order)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            return pdf[~sequential_keep(pdf["x"].to_numpy(), pdf["y"].to_numpy(), tolerance)][[order]].rename(columns={order: "b"})

        dropped = dropped.unionByName(own.join(chains, order).groupBy("component").applyInPandas(run, "b long"))
    return points.join(dropped.select(F.col("b").alias(order)), order, "left_anti")


def assemble(first: DataFrame, removed: list[DataFrame], added: list[DataFrame]) -> DataFrame:
    """(first - removed2) + added2 - removed3 + added3 ..., by position; the first of equal positions wins (F1)."""
    key = lambda df: df.withColumns({"kx": F.round("x", 6), "ky": F.round("y", 6)})
    out = key(first).withColumn("_turn", F.lit(0))
    for turn, (gone, new) in enumerate(zip(removed, added, strict=True), 1):
        out = out.join(key(gone).select("kx", "ky").distinct(), ["kx", "ky"], "left_anti")
        out = out.unionByName(key(new).withColumn("_turn", F.lit(turn)), allowMissingColumns=True)
    w = Window.partitionBy("kx", "ky").orderBy("_turn", "x", "y")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_turn", "kx", "ky")


def not_readded(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Added points that no cluster has removed (F2)."""
    key = [F.round("x", 6).alias("kx"), F.round("y", 6).alias("ky")]
    return added.withColumns({"kx": key[0], "ky": key[1]}).join(removed.select(*key).distinct(), ["kx", "ky"], "left_anti").drop("kx", "ky")


def position_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of a that b lacks."""
    key = lambda df: df.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return key(a).distinct().exceptAll(key(b).distinct())


def restore_missing(sites: DataFrame, must: DataFrame) -> DataFrame:
    """Sites with those of `must` that are missing at one decimal place."""
    key = {"kx": F.round("x", 1), "ky": F.round("y", 1)}
    missing = must.withColumns(key).join(sites.withColumns(key).select("kx", "ky").distinct(), ["kx", "ky"], "left_anti").drop("kx", "ky")
    return sites.unionByName(missing, allowMissingColumns=True)
