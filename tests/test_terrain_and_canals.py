import math

from pyspark.sql import functions as F

from terralode.functions import projection
from terralode.functions.geometry import point
from terralode.operators import canals, terrain
from terralode.sources import kml


def snyder(lon, lat, central):
    """The same projection by another series."""
    a, e2 = 6378137.0, 2 / 298.257223563 - 1 / 298.257223563**2
    p, ep = math.radians(lat), e2 / (1 - e2)
    n, t, c, x = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep * math.cos(p) ** 2, math.cos(p) * math.radians(lon - central)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    east = 500_000 + 0.9996 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * x**5 / 120)
    north = 0.9996 * (m + n * math.tan(p) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * x**6 / 720))
    return east, north + 10_000_000


def test_projection_and_lengths(spark):
    lon, lat = F.lit(-62.1), F.lit(-32.6)
    east, north = projection.transverse_mercator(lon, lat, projection.utm_central(lon))
    p = lambda x, y: point(F.lit(x), F.lit(y))
    got = spark.range(1).select(east, north, projection.geodesic(p(0.0, 0.0), p(1.0, 0.0)), projection.geodesic(p(0.0, 0.0), p(0.0, 1.0)), projection.geodesic(p(5.0, 5.0), p(5.0, 5.0))).first()
    want = snyder(-62.1, -32.6, -63)
    assert abs(got[0] - want[0]) < 0.01 and abs(got[1] - want[1]) < 0.01
    assert abs(got[2] - 111_319.49) < 0.5 and abs(got[3] - 110_574.39) < 0.5 and got[4] == 0


def test_canals(spark, tmp_path):
    mark = lambda name, coordinates: f"<Placemark><name>{name}</name><styleUrl>#s</styleUrl><LineString><coordinates>{coordinates}</coordinates></LineString></Placemark>"
    line = "0,0 1,0"
    body = mark("N12 · Canal norte · 1.355,5 m · Media-Alta ★ alto ROI", line) + mark("Canal sur (P3) · 800 m", line) + mark("Canal sur (P3)", line)
    (tmp_path / "c.kml").write_text(f"<kml><Folder><name>Zona / Tramo B</name>{body}</Folder></kml>")
    got = canals.canals(kml.read_placemarks(spark, f"{tmp_path}/c.kml"), "propuesto").orderBy("ord").collect()
    assert [(r.id, r.codigo, r.descripcion, r.longitud_declarada_m, r.prioridad, r.featured) for r in got] == [
        ("n12-canal-norte", "N12", "Canal norte", 1355.5, "Media-Alta", True), ("p3-canal-sur-p3", "P3", "Canal sur (P3)", 800.0, None, False), ("p3-canal-sur-p3-zona-tramo-b-0", "P3", "Canal sur (P3)", None, None, False),
    ]
    assert got[0].longitud_m == 111319.5 and got[0].tramo_folder == " Tramo B"
    rate = canals.failure_rate(spark.createDataFrame([("a",), (None,)], "x string"), F.col("x")).first().rate
    assert rate == 0.5


def test_schools(spark):
    rows = [(0, "Esc. Belgrano", "<b>Localidad:</b> Marcos<br><b>Director:</b> X", "Point", [(1.0, 2.0)]), (1, "Esc. Belgrano", None, "Point", [(3.0, 4.0)])]
    marks = spark.createDataFrame(rows, "ord int, name string, description string, geometry_type string, points array<struct<x double, y double>>")
    got = sorted(tuple(r)[:5] for r in canals.schools(marks).collect())
    assert got == [("esc-belgrano", "Escuela Belgrano", "Marcos", "", ""), ("esc-belgrano-2", "Escuela Belgrano", "", "", "")]


def test_flood_class(spark):
    rows = [(0.5, 9.0, 50.0), (0.7, 8.0, 1.0), (1.2, 5.0, 1.0), (5.0, 9.0, 1.0), (None, 9.0, 1.0)]
    cells = spark.createDataFrame(rows, "hand double, twi double, flow double")
    got = [r[0] for r in cells.select(terrain.flood_class(F.col("hand"), F.col("twi"), F.col("flow"), F.lit(4.0), F.lit(7.0), F.lit(40.0))).collect()]
    assert got == [3, 2, 1, 0, 255]
