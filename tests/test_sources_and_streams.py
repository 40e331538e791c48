import io
import json
import zipfile

from pyspark.sql import functions as F

from terralode.sources import geojson, kml, tabular
from terralode.streaming import jobs

KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>Norte</name><Placemark><name>A &amp; B</name><description>x</description>
<styleUrl>#s1</styleUrl><LineString><coordinates>-62.5,-32.1,0 -62.4,-32.0,5</coordinates></LineString></Placemark></Folder>
<Placemark><name>P</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""


def test_geojson(spark, tmp_path):
    rows = spark.createDataFrame([(i, {"id": str(i)}, f"[{i}, {-i}.5]") for i in range(50)], "ord long, properties map<string,string>, c string")
    features = rows.select("ord", geojson.feature_json(F.col("properties"), F.lit("Point"), F.col("c")).alias("json")).repartition(7)
    parts = []
    for out in ("a", "b"):
        geojson.write_features(features, f"{tmp_path}/{out}", schema_version="1.2", generated_at="2024-01-01T00:00:00Z", source="test")
        parts.append("".join(p.read_text() for p in sorted((tmp_path / out).glob("part-*"))))
    assert parts[0] == parts[1]
    whole = json.loads(parts[0])
    assert [f["properties"]["id"] for f in whole["features"]] == [str(i) for i in range(50)] and whole["metadata"]["schema_version"] == "1.2"
    (tmp_path / "layer.geojson").write_text(parts[0])
    got = geojson.read_features(spark, f"{tmp_path}/layer.geojson", bbox=(3, -10, 5, 0)).orderBy("ord").collect()
    assert [r.ord for r in got] == [3, 4, 5] and got[0].box.min_y == -3.5
    boxes = spark.createDataFrame([("1, 2,3,4",), ("1,2,3",), ("a,b,c,d",)], "b string").select(geojson.parse_bbox(F.col("b")).alias("x")).collect()
    assert tuple(boxes[0].x) == (1, 2, 3, 4) and boxes[1].x is None and boxes[2].x is None


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    rows = kml.read_placemarks(spark, f"{tmp_path}/*.km?").orderBy("source", "ord").collect()
    assert [(r.name, r.folder, r.style, r.geometry_type, len(r.points)) for r in rows] == [("A & B", "Norte", "s1", "LineString", 2), ("P", "", None, "Polygon", 4)] * 2
    lines = kml.read_placemarks(spark, f"{tmp_path}/a.kml").where("geometry_type = 'LineString'")
    out = kml.folder_xml(lines.withColumn("xml", kml.placemark_xml(F.col("name"), F.col("points"))), "folder", "ord", "xml").first()
    assert out.xml.startswith("<Folder><name>Norte</name><Placemark><name>A &amp; B</name>") and "-62.5,-32.1 -62.4,-32.0" in out.xml


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Nombres,Nro CUIT,Ha\nJosé,20-1,3\nAna,\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Nombre\nPeñón\n".encode("latin-1"))
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Nombre</t></si><si><t>Eva</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.xlsx").write_bytes(book.getvalue())
    rows = tabular.read_uploads(spark, f"{tmp_path}/*.*").orderBy("source", "row_number").collect()
    assert [(r.row_number, r.cells) for r in rows] == [(2, {"nombre": "José", "cuit": "20-1", "hectareas": "3"}), (3, {"nombre": "Ana", "cuit": "", "hectareas": None}), (2, {"nombre": "Peñón"}), (2, {"nombre": "Eva", "7": None})]


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    events = spark.read.parquet(path)
    landed = tmp_path / "landed"
    events.coalesce(1).write.parquet(str(landed))
    stream = spark.readStream.schema(events.schema).parquet(str(landed))
    q = jobs.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("windowed").collect()}
    want = {(r.start, r.event_type): r.n for r in jobs.windowed(events).collect()}
    assert got == want and len(got) > 100

    requests = spark.createDataFrame([("a", i) for i in range(0, 50, 10)] + [("b", 0)], "key string, s int").select("key", F.timestamp_seconds(F.col("s")).alias("ts"))
    requests.coalesce(1).write.parquet(f"{tmp_path}/requests")
    limited = jobs.rate_limited(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/requests"), limit=2, seconds=25)
    q = limited.writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").where("key = 'a'").orderBy("ts").collect()] == [True, True, False, True, True]

    scored = spark.createDataFrame([("z1", "critico"), ("z1", "alto"), ("z2", "bajo"), ("z3", "alto")], "zona_id string, nivel string")
    active = spark.createDataFrame([("z3", True), ("z1", False)], "zona_id string, activa boolean")
    assert {r.zona_id for r in jobs.new_alerts(scored, active).collect()} == {"z1"}


def test_alert_job_raises_the_worst_row(spark, tmp_path):
    """Of all rows of a zone since the last run the most severe and latest counts, whatever comes first."""
    rows = [("z1", "bajo", 1), ("z1", "critico", 2), ("z1", "critico", 3), ("z1", "alto", 4), ("z2", "bajo", 5), ("z3", "critico", 6), ("z4", "alto", 7), ("z4", "alto", 8), ("z4", "bajo", 9)]
    scored = spark.createDataFrame(rows, "zona_id string, nivel string, s int").select("zona_id", "nivel", F.timestamp_seconds("s").alias("ts"), "s")
    scored.coalesce(1).write.parquet(f"{tmp_path}/scored")
    active = spark.createDataFrame([("z3", True), ("z1", False)], "zona_id string, activa boolean")
    raised = []
    stream = spark.readStream.schema(scored.schema).parquet(f"{tmp_path}/scored")
    query = jobs.alert_job(stream, lambda: active, lambda df: raised.extend(df.collect()), f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert sorted((r.zona_id, r.nivel, r.s) for r in raised) == [("z1", "critico", 3), ("z4", "alto", 8)]
