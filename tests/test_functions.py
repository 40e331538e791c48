from pyspark.sql import functions as F

from terralode.functions import geometry, maps, numeric, temporal, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    s = F.lit
    got = one(
        spark, text.normal_key(s(" 12.34 .5\t6 ")), text.normal_key(s(" . ")), text.normal_key(s("None")), text.slug(s("  Canal Ñandú — Nº 3!")), text.spanish_number(s("tramo de 1.355,5 m aprox")),
        text.spanish_number(s("800 m")), text.spanish_number(s("sin largo")), text.leading_code(s("N12 Canal")), text.bracket_code(s("Canal (P12)")), text.cuit(s("20 12345678 6")), text.cuit(s("12")),
        text.cuit_check_digit(s("2012345678")), text.is_phone(s("+54 (351) 555-1234")), text.is_email(s("a@b..c")), text.xml_escape(s("a<b>&'\"")), text.last_segment(s("/a/b/")), text.checklist(s("a\r\n\n b \n")),
        text.soil_class(s(" iiiws ")), text.title_from_id(s("vt_puntos_conflicto")), text.distance_text(s(999.4)), text.distance_text(s(1500.0)), text.distance_text(s(None).cast("double")),
    )
    assert got == ("123456", None, None, "canal-nandu-n-3", 1355.5, 800.0, None, "N12", "P12", "20-12345678-6", "12", 6, True, False, "a&lt;b&gt;&amp;&apos;&quot;", "b", ["a", "b"], "III", "Puntos Conflicto", "999 m", "1.5 km", "— m")
    found = one(spark, text.labels(F.lit("<b>Nivel:</b> Primario<br><b>Nivel</b>: Otro<br><b>Localidad:</b> Marcos")))[0]
    assert found == {"nivel": "Primario"}


def test_numbers(spark):
    s = F.lit
    points, factors = numeric.flood_points(s(0.5), s(13.0), s(60000.0), s(0.1))
    got = one(
        spark, numeric.safe_double(s("x")), numeric.safe_double(s("2.5")), numeric.hectares(s("123456")), numeric.hectares(s(None).cast("string")), numeric.percent(s(1), s(0)), numeric.percent(s(1), s(3)),
        numeric.score(s(130.0)), numeric.criticality(s(1.0), s(1.0), s(1.0), s(1.0), s(1.0)), numeric.risk_level(s(75.0)), numeric.risk_level(s(24.9)), numeric.near(s(2500.0)), points, factors, numeric.flood_level(points),
        numeric.min_max(s(3.0), s(3.0), s(3.0)), numeric.trend(s(1.0), s(2.5)), numeric.ratio_index(s(0.0), s(0.0)), numeric.utm_epsg(s(-62.5), s(-32.5)), numeric.conflict_severity(s(100.0), s(1.0)),
    )
    assert got == (0.0, 2.5, 12.3, None, 0.0, 33.3, 100.0, 100.0, "critico", "bajo", 0.5, 70, [numeric.FLOOD_POINTS["hand"][1][3], numeric.FLOOD_POINTS["twi"][1][3], "Flow accumulation alto", numeric.FLOOD_POINTS["slope"][0][3]], "critico", 0.0, "increasing", 0.0, 32720, "media")
    assert one(spark, *numeric.terrain_rgb(F.lit(123.4))) == (1, 139, 114)


def test_dates_and_maps(spark):
    day = F.lit("2024-02-10").cast("date")
    low, high = temporal.month_bounds(day)
    assert [str(x) for x in one(spark, low, high, temporal.years_back(day, 2), temporal.buffer_days(day, day))] == ["2024-02-01", "2024-03-01", "2022-02-10", "10"]
    m = F.create_map(F.lit("2021"), F.lit("b"), F.lit("2018"), F.lit("a"), F.lit("DNI"), F.lit("x"))
    assert one(spark, maps.years_within(m, ["2019", "2020", "2021"]), maps.drop_private(m, ["dni"]), maps.merged(m, F.create_map(F.lit("2018"), F.lit("z"))))[:2] == (["2021"], {"2021": "b", "2018": "a"})


def test_geometry(spark):
    ring = F.array(*(geometry.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    clipped = geometry.clip_to_box(ring, F.lit(1.0), F.lit(1.0), F.lit(6.0), F.lit(3.0))
    got = one(spark, geometry.ring_area(ring), geometry.within(F.lit(1.0), F.lit(1.0), ring), geometry.within(F.lit(5.0), F.lit(1.0), ring), geometry.line_length(ring), geometry.ring_area(clipped), F.size(geometry.clip_to_box(ring, F.lit(9.0), F.lit(9.0), F.lit(10.0), F.lit(10.0))))
    assert got == (16.0, True, False, 12.0, 6.0, 0)
    degree = one(spark, geometry.line_length(F.array(geometry.point(F.lit(0.0), F.lit(0.0)), geometry.point(F.lit(1.0), F.lit(0.0))), geometry.haversine))[0]
    assert abs(degree - 111_195) < 10


def test_flood_bands(spark):
    """Each band's points by itself, at and beside its edges; nulls give none."""
    cases = [
        ((0.49, None, None, None), 40, 1), ((0.5, None, None, None), 30, 1), ((0.99, None, None, None), 30, 1), ((1.0, None, None, None), 15, 1), ((2.0, None, None, None), 0, 0),
        ((None, 14.1, None, None), 30, 1), ((None, 14.0, None, None), 20, 1), ((None, 11.0, None, None), 5, 0), ((None, 8.0, None, None), 0, 0),
        ((None, None, 100_001.0, None), 20, 1), ((None, None, 100_000.0, None), 10, 1), ((None, None, 10_000.0, None), 0, 0),
        ((None, None, None, 0.29), 10, 1), ((None, None, None, 0.3), 5, 0), ((None, None, None, 0.5), 0, 0), ((0.1, 15.0, 200_000.0, 0.1), 100, 4), ((None,) * 4, 0, 0),
    ]
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, hand double, twi double, flow double, slope double")
    points, factors = numeric.flood_points(*map(F.col, ("hand", "twi", "flow", "slope")))
    got = [(r.p, r.n) for r in rows.select("i", points.alias("p"), F.size(factors).alias("n")).orderBy("i").collect()]
    assert got == [(p, n) for _, p, n in cases]
    levels = spark.createDataFrame([(29,), (30,), (50,), (70,)], "p int").select(numeric.flood_level(F.col("p"))).collect()
    assert [r[0] for r in levels] == ["bajo", "moderado", "alto", "critico"]


def test_scores_of_canals_and_roads(spark):
    s = lambda v: F.lit(v).cast("double")
    got = one(
        spark, numeric.canal_priority(s(20_000), s(5), s(250)), numeric.canal_priority(s(5000), s(20), s(None)), numeric.canal_priority(s(None), s(1), s(0)), numeric.road_risk(s(5000), s(1), s(7.5), s(250)), numeric.road_risk(s(1), s(1), s(None), s(0)),
        numeric.gap_severity(s(80.1), s(5.1)), numeric.gap_severity(s(80.1), s(5.0)), numeric.gap_severity(s(60.0), s(9.0)), numeric.zonal_share(s(60), 45.0), numeric.zonal_share(s(None), 45.0), numeric.trend(s(10), s(11)), numeric.trend(s(10), s(8.9)),
    )
    assert got == (77.5, 50.0, 0.0, 57.5, 0.0, "critico", "alto", "moderado", 1.0, 0.5, "stable", "decreasing")


def test_validators_and_labels(spark):
    s = F.lit
    phones = ["3515551234", "+54 351 555-1234", "54 3515551234", "0351 5551234", "12345678", "+1 5551234567", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(phones)], "i int, p string")
    assert [r[0] for r in rows.orderBy("i").select(text.is_phone(F.col("p"))).collect()] == [True, True, True, True, False, False, False, False]
    got = one(
        spark, text.is_email(s("a.b+c@x-y.com.ar")), text.is_email(s("a@-b.com")), text.is_email(s("a" * 250 + "@b.co")), text.is_cuit(s("20-12345678-6")), text.is_cuit(s("20123456786")), text.is_cuit(s("20-12345678-5")), text.is_cuit(s("2012345678-6")),
        text.distance_text(s(999.9)), text.distance_text(s(-5.0)), text.area_text(s(9999.4)), text.area_text(s(25_000.0)), text.area_text(s(float("inf"))), text.length_text(s(100.4), s(100.0)), text.length_text(s(1355.6), s(1300.0)),
        text.money_text(s(1234.5)), text.coordinate_text(s(-32.5), s(-62.25)), text.data_url_bytes(s("data:image/png;base64,aGk=")), text.data_url_bytes(s("x")), text.humanised(s("siembra_directa"), {}), text.file_name(s("Canal Ñ 1"), s("2024-01-02").cast("date")),
    )
    assert got[:7] == (True, False, False, True, True, False, False)
    assert got[7:] == ("1000 m", "0 m", "9999 m²", "2.5 ha", "— m²", "100 m", "1.356 m · (1.300 m declarada)", "$ 1,234.50", "-32.500000, -62.250000", b"hi", None, "Siembra directa", "canal_n_1_2024-01-02")


def test_shapes(spark):
    """Clipping, repair, middles and simplification of small shapes, with values worked out by hand."""
    p = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    ring = lambda *c: F.array(*(p(float(x), float(y)) for x, y in c))
    square, diamond = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, -1), (5, 2), (2, 5), (-1, 2))
    got = one(
        spark, geometry.ring_area(geometry.clip_to_convex(square, diamond)), F.size(geometry.clip_to_convex(square, ring((9, 9), (10, 9), (9, 10)))), geometry.signed_area(geometry.repaired(ring((0, 0), (0, 2), (2, 2), (2, 2), (0, 0)))),
        geometry.repaired(ring((0, 0), (1, 1), (0, 0))), geometry.length_in_convex(ring((-2, 2), (6, 2)), square), geometry.length_in_convex(ring((-2, 9), (6, 9)), square), geometry.middle(ring((0, 0), (4, 0), (4, 2)))["x"], geometry.middle(ring((7, 8)))["y"],
        geometry.centroid(square)["x"], geometry.nearest_on(p(2.0, 3.0), ring((0, 0), (4, 0)))["d"], geometry.from_wkt(F.lit("LINESTRING (1 2, 3 4)"))[1]["y"], geometry.from_wkt(F.lit("x")),
    )
    assert got == (14.0, 0, 2.0, None, 4.0, 0.0, 3.0, 8.0, 2.0, 3.0, 4.0, None)
    rows = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)],), ([(0.0, 0.0)],), (None,)], "line array<struct<x:double,y:double>>")
    assert [len(r[0]) if r[0] else None for r in rows.select(geometry.simplified(F.col("line"), 0.1)).collect()] == [4, 1, None]
    assert [len(r[0]) for r in rows.where("line is not null").select(geometry.simplified(F.col("line"), 0.1, 100)).collect()] == [5, 1]


def test_private_fields(spark):
    rows = spark.createDataFrame([("a", "1", ("x", "y", ("m",)))], "nombre string, Telefono string, datos struct<email: string, zona: string, mas: struct<CUE: string>>")
    out = rows.select(maps.strip_private(rows.schema, F.struct(*rows.columns), ["telefono", "email", "cue"]).alias("r")).select("r.*")
    assert out.schema.simpleString() == "struct<nombre:string,datos:struct<zona:string>>" and out.first() == ("a", ("y",))


def test_values_that_expressions_name_often_are_worked_out_once(spark):
    """Repaired rings and the points nearest to a centre grew with each mention of what they are made of."""
    ring = F.reverse(F.col("ring"))
    rows = spark.createDataFrame([([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (2.0, 0.0)],), (None,)], "ring array<struct<x:double,y:double>>")
    c = geometry.centroid(geometry.repaired(ring))
    out = rows.select(geometry.repaired(ring).alias("r"), geometry.nearest_on(c, F.col("ring"))["d"].alias("d"))
    assert out._jdf.queryExecution().analyzed().toString().count("reverse(ring") <= 2
    got = out.collect()
    assert got[1].r is None and got[1].d is None and got[0].d == 1.0 and len(got[0].r) == 4
