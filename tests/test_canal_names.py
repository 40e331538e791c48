"""Names of canals and the ids that come of them, with the values that a careful reader of the rules gets."""

from pyspark.sql import functions as F

from terralode.operators import canals


def parsed(spark, names):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = rows.select("i", canals.parsed_name(F.col("name")).alias("n")).orderBy("i").select("n.*").collect()
    return [tuple(r) for r in got]


def test_names(spark):
    cases = {
        "N4 · Canal norte · 1.355 m · ALTA ★": ("N4", "Canal norte", 1355.0, "Alta", True),
        "E21 · 468 m · Media-Alta ★ alto ROI": ("E21", "E21 · 468 m · Media-Alta", 468.0, "Media-Alta", True),
        "S2 complemento opcional (P12) · 5.916 m · sujeto a presupuesto": ("P12", "S2 complemento opcional (P12) · sujeto a presupuesto", 5916.0, "Opcional", False),
        "Canal (P14a norte)": ("P14a", "Canal (P14a norte)", None, None, False),
        "Canal NE (sin intervención)": (None, "Canal NE (sin intervención)", None, None, False),
        "alta · Canal X · N7": (None, "Canal X · N7", None, "Alta", False),
        "Canal X · N7 · 12,5 m largo  plazo": ("N7", "Canal X", 12.5, "Largo plazo", False),
        "Canal X · readecuación · largo plazo del sur": (None, "Canal X · readecuación · largo plazo del sur", None, "Largo plazo", False),
        "N1 · 10 m resto · 20 m": ("N1", "resto · 20 m", 10.0, None, False),
        "media_alta": (None, "media_alta", None, "Media-Alta", False), "muy alta": (None, "muy alta", None, None, False), "": (None, "", None, None, False),
    }
    assert parsed(spark, list(cases)) == list(cases.values())
    assert parsed(spark, [None]) == [(None, "", None, None, False)]


def test_ids_pass_over_what_is_taken(spark):
    rows = [("f", 0, "a", "B"), ("f", 1, "a", "B"), ("f", 2, "a-b-1", "X"), ("f", 3, "a", "B"), ("f", 4, "a", ""), ("f", 5, "a-b", "1 B"), ("g", 0, "a", "B"), ("f", 6, "a-b-1", "X")]
    df = spark.createDataFrame(rows, "source string, ord int, base string, folder string")
    got = {(r.source, r.ord): r.id for r in canals.with_ids(df, "base", "ord", "folder", "source").collect()}
    assert got == {("f", 0): "a", ("f", 1): "a-b-0", ("f", 2): "a-b-1", ("f", 3): "a-b-2", ("f", 4): "a-3", ("f", 5): "a-b", ("g", 0): "a", ("f", 6): "a-b-1-x-0"}


def test_outputs(spark):
    rows = [("a", None, "N", "D", "relevado", 10.0, None, None, False, None, None, [(1.0, 2.0), (3.0, 4.0)], 0), ("b", "P1", "N · x", "D", "propuesto", 10.0, None, None, True, "T", "s", [(1.0, 2.0)], 1)]
    fields = "id string, codigo string, nombre string, descripcion string, estado string, longitud_m double, longitud_declarada_m double, prioridad string, featured boolean, tramo_folder string, source_style string"
    df = spark.createDataFrame(rows, f"{fields}, points array<struct<x double, y double>>, ord int")
    feature = canals.canal_features(df).orderBy("ord").first().json
    assert feature == '{"type":"Feature","properties":{"id":"a","codigo":null,"nombre":"N","descripcion":"D","estado":"relevado","longitud_m":10.0,"longitud_declarada_m":null,"prioridad":null,"featured":false,"tramo_folder":null,"source_style":null},"geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}}'
    index = [r.json for r in canals.canal_index(df).orderBy("ord").collect()]
    assert '"prioridad"' not in index[0] and '"prioridad":null' in index[1]
    assert tuple(canals.index_counts(df).first()) == (1, 1, 2)
    assert tuple(canals.parse_failures(df.withColumn("codigo", F.lit(None).cast("string"))).first()) == (2, 1, 0.5) and tuple(canals.parse_failures(df.limit(0)).first()) == (0, 0, 0.0)
