"""Areas of interest from files of several formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import geometry
from terralode.sources import geojson, kml

_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """(source, ord, ring, box): the outer rings of the polygons in a .geojson, .json, .kml or .kmz file, without repeated
    corners and turning counter-clockwise; rings that can't be mended are left out. Other suffixes raise ValueError."""
    suffix = path.lower().rpartition(".")[2]
    if suffix in ("kml", "kmz"):
        rows = kml.read_placemarks(spark, path).where("geometry_type = 'Polygon'").select("source", "ord", F.col("points").alias("ring"))
    elif suffix in ("geojson", "json"):
        found = geojson.read_features(spark, path).where(F.col("geometry_type").isin("Polygon", "MultiPolygon"))
        one = F.array(F.from_json("coordinates", _POLYGON))
        many = F.from_json("coordinates", _MULTI)
        parts = F.when(F.col("geometry_type") == "Polygon", one).otherwise(many)
        corners = F.transform(F.col("part")[0], lambda p: geometry.point(p[0], p[1]))
        rows = found.select("source", "ord", F.explode(parts).alias("part")).select("source", "ord", corners.alias("ring"))
    else:
        raise ValueError(f"no reader for areas in {path}")
    rows = rows.withColumn("ring", geometry.repaired(F.col("ring"))).where("ring is not null")
    return rows.withColumn("box", geometry.bbox(F.col("ring")))
