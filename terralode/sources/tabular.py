"""Tables from uploads: CSV in either of two encodings, XLSX, and the choice between them."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What uploads call the columns of the registry.
ALIASES = {"apellidos": "apellido", "nombres": "nombre", "mail": "email", "correo": "email", "tel": "telefono", "celular": "telefono", "has": "hectareas", "ha": "hectareas", "nro_cuit": "cuit", "cuil": "cuit"}

_ROW = "source string, row_number int, cells map<string,string>"


def header(name: str) -> str:
    """Lower case, trimmed, one underscore for white space, and the name that an alias stands for."""
    plain = re.sub(r"\s+", "_", (name or "").strip().lower())
    return ALIASES.get(plain, plain)


def _csv(content: bytes) -> list[list[str | None]]:
    import csv

    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return list(csv.reader(io.StringIO(text)))


def _xlsx(content: bytes) -> list[list[str | None]]:
    """The first sheet."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ET.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for row in (e for e in sheet.iter() if local(e) == "row"):
        cells: list[str | None] = []
        for c in row:
            letters = re.match("[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for letter in letters:
                at = at * 26 + ord(letter) - 64
            cells += [None] * (at - 1 - len(cells))
            value = next(("".join(x.itertext()) for x in c if local(x) in ("v", "is")), None)
            cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
        rows.append(cells)
    return rows


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind = path.lower().rpartition(".")[2]
            if kind not in ("csv", "xlsx"):
                raise ValueError(f"no reader for {path}")
            rows = (_csv if kind == "csv" else _xlsx)(content)
            names = [header(n or "") for n in (rows[0] if rows else [])]
            for k, row in enumerate(rows[1:], 2):
                out.append((path, k, list(zip(names, [*row, *[None] * (len(names) - len(row))], strict=False))))
        columns = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.map_(pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "row_number", "cells"])


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(source, row_number, cells) of uploaded tables; the header is row 1, short rows are filled with nulls. Other
    kinds of files raise ValueError."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, _ROW)


def read_large_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV that Spark may split."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def latest_layer(layers: DataFrame, kind: str, area: str | None = None) -> DataFrame:
    """The path of the newest layer of a kind, and of an area if one is given; its overview file if it has one."""
    rows = layers.where(F.col("tipo") == kind)
    if area is not None:
        rows = rows.where(F.col("area_id") == area)
    return rows.agg(F.max_by(F.coalesce("cog_path", "path"), "created_at").alias("path"))


# Plain names of the geometry types that tile servers report.
GEOMETRIES = {"POINT": "point", "MULTIPOINT": "point", "LINESTRING": "line", "MULTILINESTRING": "line", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}


def vector_layers(layers: DataFrame, name: str, geometry: str, address: str, prefix: str = "vt_") -> DataFrame:
    """Layers whose name has a prefix, with a plain geometry type ('unknown' for others) and the address of their tiles."""
    known = F.create_map([F.lit(x) for pair in GEOMETRIES.items() for x in pair])
    rows = layers.where(F.startswith(F.col(name), F.lit(prefix)))
    return rows.withColumn("geometry_type", F.coalesce(known[F.upper(F.col(geometry))], F.lit("unknown"))).withColumn("url", F.concat(F.lit(address), F.col(name), F.lit("/{z}/{x}/{y}")))
