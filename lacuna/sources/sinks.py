"""CSV, GeoJSON and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import ranking

# The prefixes of the numbered ids in each file.
PREFIX = {"proposed": "PROP", "First Pass": "FP", "Second Pass": "SP", "Third Pass": "TP"}


def numbered(sites: DataFrame, prefix: str, groups: list[str] | None = None) -> DataFrame:
    """Adds Location_ID, prefix_001 ... in order of x, y within each group of the file."""
    return ranking.numbered(sites, ["x", "y"], "_number", groups).withColumn("Location_ID", F.format_string(prefix + "_%03d", "_number")).drop("_number")


def proposed_table(sites: DataFrame) -> DataFrame:
    """The proposed-sites file: coordinates to two places (halves to even)."""
    out = numbered(sites, PREFIX["proposed"], ["combo_key"])
    return out.select("Location_ID", F.bround("x", 2).alias("Easting"), F.bround("y", 2).alias("Northing"), F.col("source_pass").alias("Source_Pass"), F.col("combo_key").alias("Filter_Combination"))


def pass_table(sites: DataFrame, source_pass: str) -> DataFrame:
    """One pass's file: radius to one place."""
    out = numbered(sites, PREFIX[source_pass], ["combo_key"])
    return out.select("combo_key", "Location_ID", F.bround("x", 2).alias("Easting"), F.bround("y", 2).alias("Northing"), F.bround("coverage_radius", 1).alias("Coverage_Radius"), F.col("source_pass").alias("Source_Pass"), F.col("status").alias("Status"), F.col("is_centreline").alias("Is_Centreline"))


def write_csv(table: DataFrame, path: str, by: list[str] | None = None) -> None:
    """With a header; an empty table makes a file with the header alone. by: a folder for each value."""
    w = table.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def feature(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def point_features(df: DataFrame, properties: list[str]) -> DataFrame:
    return df.select(feature("Point", F.array("x", "y"), properties).alias("value"))


def cell_features(cells: DataFrame, h: float, properties: list[str]) -> DataFrame:
    """A square polygon for each cell."""
    x0, y0, x1, y1 = F.col("ix") * h, F.col("iy") * h, (F.col("ix") + 1) * h, (F.col("iy") + 1) * h
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return cells.select(feature("Polygon", F.array(ring), properties).alias("value"))


def ring_features(df: DataFrame, properties: list[str], ring: str = "ring") -> DataFrame:
    """Rings of struct<x, y> as a polygon, closed, of one ring (hexagons) or several."""
    one = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    coords = F.array(one(F.col(ring))) if dict(df.dtypes)[ring].startswith("array<struct") else F.transform(ring, one)
    return df.select(feature("Polygon", coords, properties).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line (newline-delimited GeoJSON), so that it is written in parallel whatever its size."""
    features.write.mode("overwrite").text(path)


def collection(features: DataFrame) -> DataFrame:
    """One row, a FeatureCollection document; for documents that a client reads whole (A14). Empty: no features."""
    doc = features.agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("f"))
    return doc.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value"))


def edited_points_csv(points: DataFrame, excluded: DataFrame) -> DataFrame:
    """ID, Easting, Northing, Zone of the edited points without the excluded indices."""
    out = points.join(excluded.select("index").distinct(), "index", "left_anti")
    return out.select(F.col("id").alias("ID"), F.bround("x", 2).alias("Easting"), F.bround("y", 2).alias("Northing"), F.array_join("zone_ids", ", ").alias("Zone"))


def pass_statistics(sites: DataFrame) -> DataFrame:
    """Sites by combination, pass and status."""
    return sites.groupBy("combo_key", "source_pass", "status").agg(F.count("*").alias("sites")).orderBy("combo_key", "source_pass", "status")


def markdown(table: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a small table; refuses one of more rows."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)
