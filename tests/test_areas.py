import json

import pytest

from terralode.sources import areas


def test_areas_of_all_formats(spark, tmp_path):
    ring = [[0, 0], [0, 2], [2, 2], [0, 0]]  # clockwise
    line = {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    feature = lambda kind, c: {"type": "Feature", "properties": {}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring, ring]), line, feature("MultiPolygon", [[ring], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]), feature("Polygon", [[[0, 0], [1, 1], [0, 0]]])]}))
    got = [tuple((p.x, p.y) for p in r.ring) for r in areas.read_area(spark, f"{tmp_path}/a.geojson").orderBy("ord", "box").collect()]
    assert len(got) == 3 and set(got[0]) == {(0.0, 0.0), (2.0, 2.0), (0.0, 2.0)} and got[0] == got[1] and got[2] == ((5.0, 5.0), (6.0, 5.0), (6.0, 6.0))
    text = " ".join(f"{x},{y},9" for x, y in ring)
    inner = "<innerBoundaryIs><LinearRing><coordinates>0.5,1 0.6,1 0.6,1.2</coordinates></LinearRing></innerBoundaryIs>"
    (tmp_path / "b.kml").write_text(f"<kml><Placemark><name>z</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{text}</coordinates></LinearRing></outerBoundaryIs>{inner}</Polygon></Placemark></kml>")
    assert [len(r.ring) for r in areas.read_area(spark, f"{tmp_path}/b.kml").collect()] == [3]
    from terralode.sources import kml

    mark = kml.read_placemarks(spark, f"{tmp_path}/b.kml").first()
    assert len(mark.points) == 4 and [[tuple(p) for p in h] for h in mark.holes] == [[(0.5, 1.0), (0.6, 1.0), (0.6, 1.2), (0.5, 1.0)]]
    with pytest.raises(ValueError):
        areas.read_area(spark, f"{tmp_path}/c.shp")


def test_invalid_files_raise_or_are_skipped(spark, tmp_path):
    from terralode.sources import geojson

    (tmp_path / "good.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    (tmp_path / "bad.geojson").write_text("{not json")
    (tmp_path / "other.geojson").write_text('{"type": "Feature"}')
    assert geojson.read_features(spark, str(tmp_path), skip_invalid=True).count() == 1
    with pytest.raises(Exception, match="not a FeatureCollection"):
        geojson.read_features(spark, str(tmp_path)).collect()
