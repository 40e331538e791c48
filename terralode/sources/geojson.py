"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "type string, features array<struct<type string, properties map<string,string>, geometry struct<type string, coordinates string>>>"


def read_features(spark: SparkSession, path: str | list[str], bbox: tuple[float, float, float, float] | None = None, *, skip_invalid: bool = False) -> DataFrame:
    """(source, ord, properties, geometry_type, coordinates, box) of every feature of one or many files. coordinates is
    JSON; box the extent of all its positions. A file that isn't a FeatureCollection with a list of features is an error
    when it is read, or gives no rows if invalid ones may be skipped. bbox keeps features whose box meets it. A file is
    one row of the scan: large layers should be many files."""
    files = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(SCHEMA).json(path).withColumn("source", F.input_file_name())
    sound = F.coalesce(F.col("type") == "FeatureCollection", F.lit(False)) & F.col("features").isNotNull()
    if skip_invalid:
        files = files.where(sound)
    else:
        wrong = F.raise_error(F.concat(F.lit("not a FeatureCollection: "), "source")).cast(files.schema["features"].dataType)
        files = files.withColumn("features", F.when(sound, F.col("features")).otherwise(wrong))
    rows = files.select("source", F.posexplode("features").alias("ord", "f"))
    rows = rows.select("source", "ord", "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    rows = rows.withColumn("box", extent(F.col("coordinates")))
    if bbox:
        x0, y0, x1, y1 = bbox
        b = F.col("box")
        rows = rows.where((b["min_x"] <= x1) & (b["max_x"] >= x0) & (b["min_y"] <= y1) & (b["max_y"] >= y0))
    return rows


def extent(coordinates: Column) -> Column:
    """The extent of the positions in a coordinates array, however nested, as JSON text."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    pairs = F.regexp_extract_all(coordinates, F.lit(rf"\[\s*({number})\s*,\s*{number}"), F.lit(0))
    xs = F.transform(pairs, lambda p: F.regexp_extract(p, f"({number})", 1).cast("double"))
    ys = F.transform(pairs, lambda p: F.regexp_extract(p, rf",\s*({number})", 1).cast("double"))
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def parse_bbox(c: Column) -> Column:
    """'minx,miny,maxx,maxy' as a struct; null unless it is four numbers."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull())
    return F.when(good, F.struct(*(parts[i].alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y")))))


def feature_json(properties: Column, geometry_type: Column, coordinates: Column) -> Column:
    """A feature as JSON text; coordinates are JSON text already."""
    return F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":{"type":"'), geometry_type, F.lit('","coordinates":'), coordinates, F.lit("}}")
    )


def write_features(features: DataFrame, path: str, *, schema_version: str, generated_at: str, source: str, json: str = "json", order: str = "ord", crs: str | None = None) -> None:
    """Writes GeoJSON: the stamp, then the features in the order of a column, in part files whose names sort, the same
    bytes for the same rows and stamp. Each part but the first begins with a comma, so that the parts together are one
    FeatureCollection; nothing is gathered in one task. crs is the name of a reference system, if it is to be told."""
    named = f'"crs":{{"type":"name","properties":{{"name":"{crs}"}}}},' if crs else ""
    stamp = f'{{"type":"FeatureCollection",{named}"metadata":{{"schema_version":"{schema_version}","generated_at":"{generated_at}","source":"{source}"}},"features":['
    # Equal features with equal places are one line, so that just one line is the first.
    ordered = features.groupBy(F.col(order).cast("long").alias("o"), F.col(json).alias("j")).agg(F.count("*").cast("int").alias("n"))
    first = ordered.agg(F.min(F.struct("o", "j")).alias("first"))
    comma = F.when(F.struct("o", "j") == F.col("first"), "").otherwise(",")
    lines = ordered.crossJoin(F.broadcast(first)).select("o", F.concat(comma, F.array_join(F.array_repeat("j", F.col("n")), ",")).alias("value"))
    spark = features.sparkSession
    edges = spark.createDataFrame([(-(1 << 62), stamp), ((1 << 62), "]}")], "o long, value string")
    lines.union(edges).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line): the lines of part files, numbered from 1 as they follow each other by the files' names. Lines are counted
    by piece of a file, and only these counts are summed up in order."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    pieces = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("file", "start", "first", before.alias("before"))  # a row for each piece of a file
    return lines.join(pieces, ["file", "start"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("place"), "line")
