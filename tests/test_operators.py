import pytest
from pyspark.sql import functions as F

from terralode.operators import changes, grid, parcels, ranks, spatial
from terralode.operators import relational as R


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 1, True), (2, "a", 2, False), (3, None, 1, True)], "id int, g string, version int, is_active boolean")
    kept, gone = changes.delete_where(base, F.col("g") == "a")
    assert [r.id for r in kept.collect()] == [3] and gone.first().deleted == 2
    new = spark.createDataFrame([(9, "a"), (8, "b")], "id int, g string")
    out = {r.id: (r.version, r.is_active) for r in changes.activate(base, new, "g").collect()}
    assert out == {1: (1, False), 2: (2, False), 3: (1, True), 9: (3, True), 8: (1, True)}
    assert sorted(r.id for r in changes.replace_groups(base, base.where("id = 2"), ["g"]).collect()) == [2, 3]
    children = spark.createDataFrame([(1, 1), (2, 7)], "cid int, parent int")
    assert [r.cid for r in changes.cascade(children, base.select("id"), "parent").collect()] == [2]
    assert {r.cid: r.parent for r in changes.cascade(children, base.select("id"), "parent", set_null=True).collect()} == {1: None, 2: 7}
    assert {r.id: r.version for r in changes.reorder(base, "id", [3, 1], "version").collect()} == {3: 0, 1: 1, 2: 2}
    with pytest.raises(ValueError, match="'positive': 3"):
        changes.require(base, {"positive": F.col("version") > 5})
    with pytest.raises(ValueError, match="empty"):
        changes.require_rows({"a": base, "b": base.limit(0)})


def test_joins_and_ranks(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "x")], "key string, ord int, v string")
    assert [tuple(r) for r in R.last_wins(rows, "key", "ord").collect()] == [("k", 2, "new")]
    assert [tuple(r) for r in R.first_wins(rows, "key", "ord").collect()] == [("k", 1, "old")]
    assert R.where_given(rows, key="k", v=None).count() == 2
    assert R.search(rows, "NE", "v").count() == 1 and R.search(rows, None, "v").count() == 3
    patch = spark.createDataFrame([("k", None), ("n", "given")], "key string, v string")
    got = {r.key: (r.ord, r.v) for r in R.upsert(R.last_wins(rows, "key", "ord"), patch, "key").collect()}
    assert got == {"k": (2, "new"), "n": (None, "given")}


def test_parcels(spark):
    cadastre = spark.createDataFrame([("1.2 3", "123456"), ("456", None), ("789", "50000"), (None, "1"), ("789", "50000")], "Nro_Cuenta string, Superficie_Tierra_Rural string")
    practice = "cuenta string, activa boolean, superficie_bpa double, practicas map<string,string>, ord int"
    practices = spark.createDataFrame([("123", True, 5.0, {"rotacion": "No"}, 1), ("12.3", True, 7.5, {"rotacion": "Si", "cobertura": "No"}, 2), ("456", False, 0.0, {"rotacion": "Si"}, 3)], practice)
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "lista_cuenta string")
    past = spark.createDataFrame([("456", "El Ombu", 1), ("456", "El Ceibo", 2), ("123", " ", 1)], "cuenta string, n_explotacion string, ord int")
    out = parcels.enrich(cadastre, practices, key("123", "x"), key("12 3", "456"), {"2018": past, "2021": past, "2025": past})
    got = {r.cuenta: r for r in out.collect()}
    assert out.count() == 4 and got["789"].bpa_2025 is None
    assert {k: r.ley_forestal for k, r in got.items()} == {"123": "aceptada", "456": "presentada", "789": "no_inscripta"}
    assert got["123"].bpa_2025.superficie_bpa == 7.5 and got["123"].anios_lista == ["2021", "2025"]
    assert got["456"].bpa_historico == {"2018": "El Ceibo", "2021": "El Ceibo"} and got["456"].anios_lista == ["2021", "2025"] and got["456"].superficie_ha is None
    law = parcels.law_status(out).first()
    assert (law.aceptada_count, law.presentada_count, law.no_inscripta_count, law.aceptada_superficie_ha, law.cumplimiento_pct_parcelas, law.cumplimiento_pct_superficie) == (1, 1, 2, 12.3, 50.0, 100.0)
    nothing = parcels.law_status(out.limit(0)).first()
    assert (nothing.aceptada_count, nothing.cumplimiento_pct_parcelas, nothing.cumplimiento_pct_superficie) == (0, 0.0, 0.0)
    ranked = parcels.practice_ranking(out, ["cobertura", "rotacion", "terrazas"]).collect()
    assert [(r.practice, r.n, r.pct) for r in ranked] == [("rotacion", 1, 100.0), ("cobertura", 0, 0.0), ("terrazas", 0, 0.0)]
    k = parcels.kpis(out, 75.0).first()
    assert (k.n_active, k.ha_active, k.coverage_pct, k.parcels_pct) == (1, 7.5, 10.0, 25.0)
    h = parcels.historic_coverage(out).first()
    assert (h.ever, h.dropped, h.never, h.ever_pct) == (2, 0, 2, 50.0)
    assert [(r.year, r.n) for r in parcels.yearly(out).collect()][2] == ("2021", 2)


def test_grid(spark):
    cells = spark.createDataFrame([(r, c, float(10 * c)) for r in range(3) for c in range(4)], "row long, col long, value double")
    got = {(r.row, r.col): r.slope for r in grid.slope_aspect(cells, 10.0).collect()}
    assert all(abs(s - 45.0) < 1e-9 for s in got.values()) and len(got) == 12
    kept = lambda df: df.checkpoint()
    flow = grid.traced(grid.downstream(grid.d8_pointers(cells)), kept).collect()
    assert {r.area for r in flow} == {1, 2, 3, 4} and max(r.steps for r in flow) == 3


def test_traces_end(spark):
    """A circle of pointers has no outlet; paths stop where they began to turn, and after so many steps."""
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None)], "cell long, next long")
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    got = {r.cell: (r.outlet, r.steps, r.area) for r in grid.traced(flow, keep).collect()}
    assert got == {1: (None,) * 3, 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3, 5: (6, 1, 1), 6: (6, 0, 2)}
    starts = spark.createDataFrame([(4,), (5,)], "cell long")
    paths = sorted((r.start, r.steps, r.cell) for r in grid.paths(flow, starts, keep).collect())
    assert paths == [(4, 0, 4), (4, 1, 1), (4, 2, 2), (4, 3, 3), (5, 0, 5), (5, 1, 6)]
    assert len(grid.paths(flow, starts.limit(1), keep, 2).collect()) == 2


def test_percentiles(spark):
    """Against Spark's own, for ties, one value, and none; in more ranges than there are values."""
    rows = [(g, float(v)) for g, vs in (("a", [3, 1, 1, 1, 9, 4]), ("b", [5]), ("d", range(100))) for v in vs] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    keep = lambda x: spark.createDataFrame(x.collect(), x.schema)
    got = {(r.g, r.share): r.value for r in ranks.percentiles(df, "v", [0.0, 0.3, 0.5, 1.0], keep, ["g"]).collect()}
    want = {(r.g, s): x for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.3, 0.5, 1.0)))).alias("p")).collect() for s, x in zip((0.0, 0.3, 0.5, 1.0), r.p or [], strict=False)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    row = ranks.percentile_row(df.where("g = 'c'"), ["v"], [0.5], keep, 0.0).first()
    assert row.p50_v == 0.0


def test_boxes_of_all_sizes(spark):
    """Small and very large boxes, against comparing all."""
    boxes = [(i, i * 37 % 100 - 50.0, i * 91 % 100 - 50.0, (1000.0 if i % 10 == 0 else 0.5) * (1 + i % 3)) for i in range(60)]
    df = spark.createDataFrame([(i, (x, y, x + s, y + s / 2)) for i, x, y, s in boxes], "id int, box struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    got = sorted((r.id, r.other) for r in spatial.join_boxes(df, df.select(F.col("id").alias("other"), F.col("box").alias("zone")), 1.0).collect())
    at = {i: (x, y, x + s, y + s / 2) for i, x, y, s in boxes}
    assert got == sorted((i, j) for i, a in at.items() for j, b in at.items() if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3])
