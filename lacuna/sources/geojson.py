"""GeoJSON and zone-layer sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGON = "array<array<array<double>>>"
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
COLLECTION = f"type string, features array<{FEATURE}>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """properties, geometry_type and coordinates (as JSON) of each feature of FeatureCollection documents, one document a file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", COLLECTION).alias("d"))
    f = doc.select(F.explode("d.features").alias("f"))
    return f.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def polygons(features: DataFrame) -> DataFrame:
    """One row for each polygon (parts of multipolygons too), its rings without the closing point."""
    single = F.from_json("coordinates", POLYGON)
    multi = F.from_json("coordinates", f"array<{POLYGON}>")
    parts = F.when(F.col("geometry_type") == "Polygon", F.array(single)).when(F.col("geometry_type") == "MultiPolygon", multi)
    df = features.where(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select("properties", F.posexplode(parts).alias("part", "rings"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r), point)
    return df.select("properties", "part", F.transform("rings", ring).alias("ring"))


def points(features: DataFrame) -> DataFrame:
    """properties, x, y of point features. Coordinates beyond 1000 are metres already."""
    xy = F.from_json("coordinates", "array<double>")
    return features.where(F.col("geometry_type") == "Point").select("properties", xy[0].alias("x"), xy[1].alias("y"), (F.abs(xy[0]) > 1000).alias("is_metres"))


def named_zones(zones: DataFrame, number: str = "zone_number") -> DataFrame:
    """Adds zone_name and max_spacing_m by the properties' fallback chains."""
    p = lambda k: F.col("properties")[k]
    name = F.coalesce(p("Name"), p("name"), p("zone_name"), p("display_name"), F.concat(F.lit("Zone_"), F.col(number).cast("string")))
    spacing = F.coalesce(p("max_spacing_m").try_cast("double"), p("max_spacing").try_cast("double"), p("spacing").try_cast("double"), F.lit(100.0))
    return zones.withColumns({"zone_name": name, "max_spacing_m": spacing})


def read_layers(spark: SparkSession, layers: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """The polygons of several layers (key, path) in order, tagged with source_layer; a layer that can't be found is left out and named (A2)."""
    found, failed = [], []
    for key, path in layers:
        try:
            found.append(polygons(read_features(spark, path)).withColumn("source_layer", F.lit(key)))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            failed.append(key)
    if not found:
        return spark.createDataFrame([], "properties map<string,string>, part int, ring array<array<struct<x:double,y:double>>>, source_layer string"), failed
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), failed


def staleness(sources: DataFrame, most_seconds: int = 3600) -> DataFrame:
    """One row: oldest and newest source and whether they are more than an hour apart (A17). sources: source, modified, is_dynamic."""
    own = sources.where("is_dynamic").agg(F.count("*").alias("sources"), F.min_by("source", "modified").alias("oldest"), F.max_by("source", "modified").alias("newest"), F.min("modified").alias("a"), F.max("modified").alias("b"))
    seconds = F.unix_timestamp("b") - F.unix_timestamp("a")
    return own.select("sources", "oldest", "newest", seconds.alias("apart_s"), F.coalesce(seconds > most_seconds, F.lit(False)).alias("is_stale"))
