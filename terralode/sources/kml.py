"""KML and KMZ in and out: placemarks in document order, with their folders, styles and geometry."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions.text import xml_escape

_ROW = "source string, ord int, name string, description string, folder string, style string, geometry_type string, points array<struct<x double, y double>>, holes array<array<struct<x double, y double>>>"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element, name: str) -> str | None:
    return next(((k.text or "").strip() for k in e if _tag(k) == name), None)


def _positions(text: str | None) -> list[dict[str, float]]:
    """Longitude and latitude; altitude is dropped."""
    return [{"x": float(p[0]), "y": float(p[1])} for t in (text or "").split() if len(p := t.split(",")) >= 2]


def _placemarks(root: ET.Element) -> Iterator[dict]:
    def walk(e: ET.Element, folders: tuple[str, ...]) -> Iterator[tuple[ET.Element, tuple[str, ...]]]:
        if _tag(e) == "Placemark":
            yield e, folders
            return
        inner = (*folders, _text(e, "name") or "") if _tag(e) == "Folder" else folders
        for kid in e:
            yield from walk(kid, inner)

    for mark, folders in walk(root, ()):
        found = {_tag(e): e for e in reversed(list(mark.iter()))}
        # A line goes before a polygon, and a polygon before a point.
        kind = next((k for k in ("LineString", "Polygon", "Point") if k in found), None)
        points = _positions(next((e.text for e in found[kind].iter() if _tag(e) == "coordinates"), None)) if kind else []
        if kind == "Polygon" and points and points[0] != points[-1]:
            points.append(points[0])
        holes = []
        if kind == "Polygon":
            inner = [r for b in found[kind].iter() if _tag(b) == "innerBoundaryIs" for r in b.iter() if _tag(r) == "coordinates"]
            holes = [[*ring, *(ring[:1] if ring[0] != ring[-1] else [])] for r in inner if (ring := _positions(r.text))]
        yield {
            "name": _text(mark, "name"), "description": _text(mark, "description"), "folder": "/".join(folders), "style": (_text(mark, "styleUrl") or "").lstrip("#") or None,
            "geometry_type": kind, "points": points, "holes": holes,
        }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source", "ord", "name", "description", "folder", "style", "geometry_type", "points", "holes"]
    types = [pa.string(), pa.int32(), *[pa.string()] * 5, _POINTS, pa.list_(_POINTS)]
    for batch in batches:
        rows = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path.lower().endswith(".kmz"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
            rows += [{"source": path, "ord": i, **p} for i, p in enumerate(_placemarks(ET.fromstring(content)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML and KMZ files, one task for some files."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, _ROW)


def geometry_xml(kind: Column, points: Column) -> Column:
    """A point, line or polygon (its ring closed) as KML; null for other kinds."""
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    inner = F.concat(F.lit("<coordinates>"), text, F.lit("</coordinates>"))
    ring = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing>"), inner, F.lit("</LinearRing></outerBoundaryIs></Polygon>"))
    plain = F.concat(F.lit("<"), kind, F.lit(">"), inner, F.lit("</"), kind, F.lit(">"))
    return F.when(kind.isin("Point", "LineString"), plain).when(kind == "Polygon", ring)


def placemark_xml(name: Column, points: Column) -> Column:
    """A placemark with a line."""
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    return F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><LineString><coordinates>"), text, F.lit("</coordinates></LineString></Placemark>"))


def folder_xml(rows: DataFrame, folder: str, order: str, placemark: str) -> DataFrame:
    """(folder, xml): one Folder element for each folder, placemarks in order."""
    lists = rows.groupBy(folder).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(placemark).alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    return lists.select(folder, F.concat(F.lit("<Folder><name>"), xml_escape(F.col(folder)), F.lit("</name>"), body, F.lit("</Folder>")).alias("xml"))
