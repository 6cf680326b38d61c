"""Point and test-data sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.scalar import safe_depth

# The columns of the points file.
REQUIRED = ["Easting", "Northing", "Location ID"]
TEST_KINDS = {"spt": "has_spt", "triaxial_total": "has_txt", "triaxial_effective": "has_txe"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text, header names trimmed."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """location_id, x, y, depth; rows without coordinates are dropped."""
    df = _csv(spark, path)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    depth = safe_depth(F.col("`Final Depth`")) if "Final Depth" in df.columns else F.lit(0.0)
    out = df.select(F.col("`Location ID`").alias("location_id"), F.col("Easting").try_cast("double").alias("x"), F.col("Northing").try_cast("double").alias("y"), depth.alias("depth"))
    return out.dropna(subset=["x", "y"])


def read_test_ids(spark: SparkSession, paths: dict[str, str | None]) -> DataFrame:
    """kind and location_id of the distinct ids of each test file; a missing file or column gives none."""
    parts = []
    for kind in TEST_KINDS:
        path = paths.get(kind)
        try:
            df = _csv(spark, path) if path else None
        except Exception as e:  # only a path that isn't there counts as no data
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = None
        if df is not None and "Location ID" in df.columns:
            parts.append(df.select(F.lit(kind).alias("kind"), F.col("`Location ID`").alias("location_id")).dropna().distinct())
    empty = spark.createDataFrame([], "kind string, location_id string")
    return reduce(DataFrame.unionByName, parts, empty)


def with_flags(points: DataFrame, tests: DataFrame) -> DataFrame:
    """Points with has_spt, has_txt and has_txe, from one join on the id."""
    flags = tests.groupBy("location_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(c) for k, c in TEST_KINDS.items()])
    out = points.join(flags, "location_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c) == 1, F.lit(False)) for c in TEST_KINDS.values()})


def extent(points: DataFrame) -> tuple[float, float, float, float] | None:
    """The points' bounding box."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if r[0] is None else tuple(r)


def clip_to_box(layer: DataFrame, box: tuple[float, float, float, float], buffer: float = 0.0) -> DataFrame:
    """Features (x0, y0, x1, y1) that meet the buffered box (A5). Comparisons of plain columns, so they reach a Parquet scan."""
    x0, y0, x1, y1 = box
    return layer.where((F.col("x1") >= x0 - buffer) & (F.col("x0") <= x1 + buffer) & (F.col("y1") >= y0 - buffer) & (F.col("y0") <= y1 + buffer))


def saved_positions(spark: SparkSession, folder: str) -> DataFrame | None:
    """id, x, y of the newest CSV of saved positions that has ID, Easting and Northing (A8, E5); None if there is none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").collect()  # a folder listing
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    for f in files:
        df = _csv(spark, f["path"])
        if {"ID", "Easting", "Northing"} <= set(df.columns):
            return df.select(F.col("ID").alias("id"), F.col("Easting").cast("double").alias("x"), F.col("Northing").cast("double").alias("y"))
    return None
