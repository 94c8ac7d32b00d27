import json

import pytest
from palimpsest.operators.integrity import EngineError
from palimpsest.plans import index as X
from palimpsest.sources import readers as R
from palimpsest.sources import sinks as K
from palimpsest.sources.paged import PagedCatalogue
from palimpsest.sources.schemas import INDEX_COLUMNS, SUPPORT


def test_csv_header_is_exact(spark, tmp_path):
    (tmp_path / "a.csv").write_text("alignment_id,observation_id,role,confidence,note\na,o,existence,high,\n")
    assert R.csv_exact(spark, str(tmp_path / "a.csv"), SUPPORT).count() == 1
    (tmp_path / "b.csv").write_text("alignment_id,observation,role,confidence,note\na,o,existence,high,\n")
    with pytest.raises(Exception):
        R.csv_exact(spark, str(tmp_path / "b.csv"), SUPPORT).collect()


def test_features_have_one_shape(spark, tmp_path):
    shapes = [("Point", [1, 2]), ("LineString", [[0, 0], [1, 1]]), ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]])]
    doc = {"type": "FeatureCollection", "features": [{"geometry": {"type": t, "coordinates": c}, "properties": {"id": t}} for t, c in shapes]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    rows = R.features(spark, str(tmp_path / "f.geojson"), "id string").orderBy("position").collect()
    assert [len(r.rings[0]) for r in rows] == [1, 2, 4] and rows[0].id == "Point"
    (tmp_path / "g.geojson").write_text(json.dumps(doc | {"crs": {"properties": {"name": "EPSG:3857"}}}))
    with pytest.raises(EngineError):
        R.features(spark, str(tmp_path / "g.geojson"), "id string")


def test_json_lines_number_rows(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"k": "a"}\n\nbroken\n{"k": "b"}\n')
    rows = R.json_lines(spark, str(tmp_path / "l.jsonl"), "k string").orderBy("line").collect()
    assert [(r.line, r.bad, r.k) for r in rows if not r.bad] == [(1, False, "a"), (4, False, "b")] and rows[1].bad


def test_paged_catalogue_and_index(spark, tmp_path):
    item = lambda n: {"urls": {"GeoTIFF": f"https://h/CA_Truckee_{n}_19{40 + n}_24000_geo.tif"}, "boundingBox": {"minX": -1.0, "minY": 0.0, "maxX": 1.0, "maxY": 2.0}, "sizeInBytes": 5}
    for at in (0, 2):
        (tmp_path / f"page-{at}.json").write_text(json.dumps({"total": 3, "items": [item(n) for n in range(at, min(at + 2, 3))]}))
    spark.dataSource.register(PagedCatalogue)
    items = spark.read.format("paged").option("path", str(tmp_path)).option("size", 2).load()
    rows = X.build_rows(items)
    assert sorted(r.date_on_map for r in rows.collect()) == ["1940", "1941", "1942"]
    assert len(INDEX_COLUMNS) == 28
    coded = {"urls": {"GeoTIFF": "https://h/CA_Lake%20Combie_123_1950_24000_geo.tif"}, "metaUrl": "https://m"}
    row = X.build_rows(spark.createDataFrame([(json.dumps(coded),)], "item string")).first()
    assert (row.topo_id, row.map_name, row.metadata_url, row.sciencebase_url, row.source_id, row.rights) == ("CA_Lake_Combie_123_1950_24000", "Lake Combie", "", "https://m", "123", "public_domain")


def test_xml(spark):
    xml = "<metadata><procstep><procdesc> Survey </procdesc><procdate>1950</procdate></procstep><horizdn>NAD27</horizdn></metadata>"
    rows = R.xml_records(spark.createDataFrame([(1, xml), (2, "broken <")], "i int, x string"), "x", ["Survey"]).orderBy("i").collect()
    assert (rows[0].Survey, rows[0].datum, rows[1].datum) == ("1950", "NAD27", None)


def test_sinks_repeat_bytes(tmp_path):
    p = str(tmp_path / "d/x.json")
    assert K.write_json(p, {"b": 1, "a": 2}) and not K.write_json(p, {"a": 2, "b": 1})
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/f").write_bytes(b"data")
    row = {"raw_path": "f", "sha256": K.sha256(str(tmp_path / "raw/f"))}
    name = K.backup([row], str(tmp_path / "raw"), str(tmp_path / "store"))
    assert K.restore(name, str(tmp_path / "store"), str(tmp_path / "again")) == 1
    with pytest.raises(EngineError):
        K.copy_verified(str(tmp_path / "raw/f"), str(tmp_path / "other"), "0" * 64)
