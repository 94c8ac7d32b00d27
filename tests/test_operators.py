import numpy as np
import pandas as pd
import pytest
from palimpsest.operators import coverage as C
from palimpsest.operators import integrity as I
from palimpsest.operators import ledger as L
from palimpsest.operators import raster as R
from palimpsest.operators import spatial as G
from palimpsest.operators.leak import substring_join
from palimpsest.operators.temporal import decade_states
from palimpsest.plans import evidence
from palimpsest.streaming import session as V
from pyspark.sql import functions as F


def state(spark, decade, *evidence_rows):
    ev = spark.createDataFrame([("s", *e) for e in evidence_rows] or [("other", "attests_closure", "1900", None)], "subject string, role string, date_start string, date_end string")
    r = decade_states(ev, spark.createDataFrame([("s", decade)], "subject string, decade int")).first()
    return r.state, r.reason


def test_decade_states(spark):
    assert state(spark, 1960) == ("unobserved", "no_resolving_evidence")
    assert state(spark, 1960, ("attests_existence", "1965", None)) == ("documented_open", "documented_evidence")
    assert state(spark, 1960, ("attests_closure", "1965", None)) == ("documented_closed", "documented_evidence")
    assert state(spark, 1960, ("attests_existence", "1965", None), ("attests_closure", "1966", None)) == ("unobserved", "conflicting_evidence")
    assert state(spark, 1960, ("attests_existence", "1955", None), ("attests_public_use", "1975", None)) == ("inferred_open", "inferred_between_observations")
    assert state(spark, 1960, ("attests_existence", "1955", None), ("attests_closure", "1957", None), ("attests_existence", "1975", None)) == ("unobserved", "closure_in_bracket")
    assert state(spark, 1960, ("attests_existence", "1958", "1963")) == ("unobserved", "date_range_unresolved")
    assert state(spark, 1960, ("attests_alignment", "1965", None)) == ("unobserved", "no_resolving_evidence")
    assert state(spark, 1960, ("attests_existence", "1955", None)) == ("unobserved", "no_resolving_evidence")


def test_box_join_matches_all_pairs(spark):
    rng = np.random.default_rng(3)

    def boxes(n, name):
        w, s = rng.uniform(0, 10, (2, n)).round(1)
        return pd.DataFrame({name: range(n), "west": w, "south": s, "east": w + rng.integers(1, 30, n) / 10, "north": s + rng.integers(1, 30, n) / 10})

    a, b = boxes(60, "a"), boxes(50, "b")
    for closed in (False, True):
        got = {(r.a, r.b) for r in G.box_join(spark.createDataFrame(a), spark.createDataFrame(b), 1.0, 1.0, closed).collect()}
        ge = np.greater_equal if closed else np.greater
        want = {(i.a, j.b) for i in a.itertuples() for j in b.itertuples() if ge(min(i.east, j.east), max(i.west, j.west)) and ge(min(i.north, j.north), max(i.south, j.south))}
        assert got == want


def test_polygons():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], float)
    assert abs(G.area_of(G.clip_ring(square, (1, 1, 5, 5)))) == 1
    assert G.invalid_reason(square) is None
    assert G.invalid_reason(np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)) is not None
    assert G.hausdorff(square, square + 1) == pytest.approx(2**0.5)


def test_references(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, None, 9)], "id int, fk string, sup int")
    p = spark.createDataFrame([("x",), (None,)], "k string")
    assert [r.record for r in I.missing_target(a, "fk", p, "k", "references", "id").collect()] == ["2"]
    assert I.self_reference(a, "id", "sup", "references").count() == 1
    assert [r.record for r in I.missing_target(a, "sup", a, "id", "references", "id").collect()] == ["3"]


def test_evidence_graph(spark):
    trails = spark.createDataFrame([(0, "t1"), (1, "t1")], "position int, trail_id string")
    al = spark.createDataFrame(
        [(0, "a1", "t1", "1960", "1959", None, None, None, ["apn-9"], "LineString", [[[0.0, 0.0], [1.0, 1.0]]]), (1, "a2", "t9", None, None, None, None, "a2", [], "Point", [[[200.0, 0.0]]])],
        "position int, alignment_id string, trail_id string, earliest_known_open string, latest_known_open string, earliest_known_closed string, latest_known_closed string, superseded_by string, parcel_apns array<string>, geometry_type string, rings array<array<array<double>>>",
    )
    obs = spark.createDataFrame(
        [(0, "o1", "1999-02-30", None, "restricted", "Jane Roe Smith", None, "Point", [[[0.0, 0.0]]])],
        "position int, observation_id string, date_start string, date_end string, sensitivity string, declarant_name string, document_path string, geometry_type string, rings array<array<array<double>>>",
    )
    sup = spark.createDataFrame([("a1", "o1"), ("a1", "o9")], "alignment_id string, observation_id string")
    files = spark.createDataFrame([("p.html", "told by Jane Roe Smith once"), ("q.html", "nothing")], "path string, text string")
    found = {(r.check, r.record) for r in evidence.validate(trails, al, obs, sup, files).collect()}
    assert {("references", "t1"), ("references", "a2"), ("orphans", "a2"), ("temporal", "a1"), ("temporal", "o1"), ("geometry", "a2"), ("leak", "o1")} <= found


def test_leaks_find_values_without_tokens(spark):
    files = spark.createDataFrame([(1, "x secret-value here"), (2, "none")], "id int, text string")
    values = spark.createDataFrame([("secret-value",), ("re",), ("  ",)], "value string")
    assert {(r.id, r.value) for r in substring_join(files, "text", values, "value").collect()} == {(1, "secret-value"), (1, "re")}


def test_cube_is_filled(spark):
    areas = spark.createDataFrame([("a", ["n", "p"]), ("b", ["n"])], "area_id string, county_geoids array<string>")
    cells = spark.createDataFrame([("a", 1950, ["topo:1"], ["r1", "r2"], ["not_digitized"]), ("b", 1950, [], ["r2"], ["not_digitized", "partially_examined"]), ("b", 1960, [], [], [])], "area_id string, decade int, source_refs array<string>, review_ids array<string>, gap_codes array<string>")
    reviews = spark.createDataFrame([("r1", "whole_source_footprint"), ("r2", "part")], "review_id string, scope string")
    batches = spark.createDataFrame([("n", 1950, "ready"), ("n", 1950, "planned")], "county_geoid string, decade int, status string")
    rows = {(r.county, r.decade): r for r in C.inventory_cube(cells, reviews, batches, areas, spark.createDataFrame([(1950,), (1960,)], "decade int")).collect()}
    r = rows["n", 1950]
    assert (r.cells, r.located, r.examined_whole, r.examined_partial, r.unexamined, r.not_digitized, r.partially_examined, r.ready) == (2, 1, 1, 1, 0, 2, 1, 1)
    assert rows["n", 1960].unexamined == 1
    assert rows["p", 1960].cells == 0 and len(rows) == 4


def test_ledger(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    assert [r.k for r in L.append_once(old, spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), ["k"], "v").collect()] == ["b"]
    with pytest.raises(I.EngineError):
        L.append_once(old, spark.createDataFrame([("a", "2")], "k string, v string"), ["k"], "v")


def test_raster(spark):
    mask = R.crop_mask([np.array([[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]], float)], [1, 0, 0, 0, 1, 0], 4, 4)
    assert (mask > 0).sum() == 4
    rng = np.random.default_rng(57)
    a = rng.normal(size=(128, 128))
    dy, dx, ratio = R.phase_shift(a, np.roll(a, (-3, 5), (0, 1)))
    assert abs(dy + 3) < 0.2 and abs(dx - 5) < 0.2 and ratio > 2
    block = np.full((2, 4, 4), 255, np.uint8)
    assert R.png(block)[:4] == b"\x89PNG" and R.png(block) == R.png(block)
    tiles = R.cut_pyramid(spark.createDataFrame([(3, x, y, bytearray(block.tobytes())) for x in (0, 1) for y in (0, 1)], "z int, x long, y long, data binary"), 3, 2, 2, 4)
    assert {(r.z, r.tiles, r.opaque_px) for r in R.tile_stats(tiles).collect()} == {(3, 4, 64), (2, 1, 16)}


def test_affine(spark):
    rows = [(1, float(c), float(r), 10 + 2.0 * c + 0.5 * r, 20 - 0.25 * c - 3.0 * r) for c in range(4) for r in range(3)]
    fit = G.fit_affine(spark.createDataFrame(rows, "g int, col double, row double, x double, y double"), ["g"]).first()
    assert fit.transform == pytest.approx([2, 0.5, 10, -0.25, -3, 20])


def events(*kinds):
    return [{"session": "s", "seq": i, "type": k, "edition_id": e, "source_id": None, "message": None, "source_loaded": True} for i, (k, e) in enumerate(kinds)]


def test_session_rejects_late_answers(spark):
    names = ["a", "b", "c"]
    s = V.opening(names)
    idle = {"type": "idle", "source_loaded": True}
    assert (s.requested, s.status, s.displayed) == ("a", "loading", None)
    assert V.step(s, idle, names) == ["reveal:a"] and V.step(s, {"type": "previous"}, names) == []
    assert V.step(s, {"type": "next"}, names) == ["show:b"] and s.generation == 1
    assert V.step(s, idle | {"generation": 0}, names) == [] and s.status == "loading"
    V.step(s, {"type": "movestart"}, names)
    assert V.step(s, idle | {"generation": 1, "viewport_token": 0}, names) == [] and s.status == "loading"
    assert V.step(s, idle | {"generation": 1, "viewport_token": 1}, names) == ["reveal:b", "hide:a"]
    assert V.step(s, {"type": "select", "edition_id": "zz"}, names) == [] and (s.rejected, s.requested, s.status) == ("unknown edition zz", "b", "displayed")


def test_session_keeps_a_warning_until_a_display_or_a_retry():
    names = ["a", "b", "c"]
    s = V.opening(names)
    V.step(s, {"type": "idle", "source_loaded": True}, names)
    V.step(s, {"type": "error", "source_id": "a", "message": "gap"}, names)
    assert (s.warning, s.status) == ("gap", "displayed")
    V.step(s, {"type": "select", "edition_id": "b"}, names)
    V.step(s, {"type": "error", "source_id": "b"}, names)
    assert (s.status, s.error, s.warning) == ("error", "tile request failed", "gap")
    assert V.step(s, {"type": "idle", "source_loaded": True}, names) == [] and s.displayed == "a"
    assert V.step(s, {"type": "select", "edition_id": "a"}, names) == ["hide:b"] and (s.status, s.warning) == ("displayed", "gap")
    assert V.step(s, {"type": "retry"}, names) == ["reload:a:1"] and s.warning is None
    V.step(s, {"type": "error", "source_id": "a", "message": "again"}, names)
    V.step(s, {"type": "select", "edition_id": "c"}, names)
    assert V.step(s, {"type": "retry"}, names) == ["reload:c:1", "show:c"] and s.warning == "again"
    V.step(s, {"type": "idle", "source_loaded": True}, names)
    assert s.displayed == "c" and s.warning is None


def test_session_stream_equals_replay(spark, tmp_path):
    from palimpsest.sources.schemas import EVENTS

    df = spark.createDataFrame([(*e.values(), None, None) for e in events(("select", "b"), ("idle", None), ("select", "a"), ("error", None))], EVENTS)
    df.write.json(str(tmp_path / "in"))
    out = V.stream(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), ["a", "b"])
    q = out.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = sorted(map(tuple, V.replay(df, ["a", "b"]).collect()))
    assert sorted(map(tuple, spark.table("sessions").collect())) == rows and rows[1][-1] == "reveal:b"
    with pytest.raises(I.EngineError):
        V.replay(df, ["a"], "b")


def test_decade_states_ignore_other_roles(spark):
    assert state(spark, 1960, ("attests_existence", "1968", "1972")) == ("unobserved", "date_range_unresolved")
    assert state(spark, 1960, ("existence", "1963", None)) == ("unobserved", "no_resolving_evidence")
    assert state(spark, 1960, ("attests_existence", "1954", None), ("attests_public_use", "1978", None), ("attests_closure", "1958", None)) == ("unobserved", "closure_in_bracket")
    assert state(spark, 1960, ("attests_existence", "1954", None), ("attests_public_use", "1978", None), ("attests_closure", "1962", None)) == ("documented_closed", "documented_evidence")


def test_refresh_marks_new_cells(spark):
    full = spark.createDataFrame([("a", 1950), ("a", 1960)], "area_id string, decade int")
    old = "area_id string, decade int, source_refs array<string>, search_ids array<string>, review_ids array<string>, batch_ids array<string>, gap_codes array<string>, gap_note string"
    cells = spark.createDataFrame([("a", 1950, ["candidate:1", "topo:old"], ["s"], [], [], ["unsearched"], None)], old)
    made = spark.createDataFrame([("a", 1950, ["topo:2"]), ("a", 1960, ["topo:3"])], "area_id string, decade int, refs array<string>")
    rows = {r.decade: r for r in C.refresh(full, cells, made).collect()}
    assert rows[1950].source_refs == ["candidate:1", "topo:2"] and rows[1950].gap_codes == ["unsearched"]
    assert rows[1960].source_refs == ["topo:3"] and rows[1960].gap_codes == C.NEW_CELL_GAP_CODES and rows[1960].search_ids == []


def test_release_counts_qualifying_batches(spark):
    kind = "batch_id string, county_geoid string, decade int, status string, alignment_ids array<string>, tasks array<string>, source_refs array<string>, review_ids array<string>, area_ids array<string>"
    row = lambda i, c, d, s, r: (i, c, d, s, [], ["t"], ["topo:1"], r, ["a"])
    batches = spark.createDataFrame([row("b1", "n", 1950, "ready", ["r1"]), row("b2", "n", 2010, "ready", ["r2"]), row("b3", "p", 1960, "ready", ["r3"]), row("b4", "p", 2000, "planned", [])], kind)
    reviews = spark.createDataFrame(
        [("r1", "n", 1950, "a", "resolved", "yes", "sheet 1"), ("r2", "n", 2010, "a", "resolved", "yes", "sheet 2"), ("r3", "p", 1960, "a", "resolved", "yes", " ")],
        "review_id string, county_geoid string, decade int, area_id string, dating string, foot_trail_evidence string, evidence_locator string",
    )
    good = C.qualifying_batches(batches, reviews)
    assert sorted(r.batch_id for r in good.collect()) == ["b1", "b2"]
    gate = C.release_gate(good, spark.createDataFrame([("n",), ("p",)], "county string")).collect()
    assert {(r.record, r.message) for r in gate} == {
        ("county p", "needs two decades of status ready batches, has none"),
        ("county p", "no status ready batch in a decade before 2000"),
        ("county p", "no status ready batch in a decade from 2000 onward"),
    }


def test_public_editions_are_checked(spark):
    from palimpsest.plans import publish

    names = [k for k in publish.PUBLIC_KEYS if k not in ("id", "native_max_zoom", "tile_url")]
    m = spark.createDataFrame([("a", 18, "x"), ("b", 12, "x"), ("c", 12, "x")], "id string, native_max_zoom int, crop_wgs84 string").select("*", *(F.lit("v").alias(k) for k in names))
    rows = publish.public_editions(m, ["b", "a"], 16, "b").orderBy("position").collect()
    assert [r.id for r in rows] == ["b", "a"] and rows[1].native_max_zoom == 16 and "crop_wgs84" not in rows[0] and rows[0].source_id == "v"
    for bad in ((m.unionByName(m), ["a"], "a"), (m, ["a", "z"], "a"), (m, ["a"], "b")):
        with pytest.raises(I.EngineError):
            publish.public_editions(bad[0], bad[1], 16, bad[2])


def test_six_places_are_exact(spark):
    rings = [[[-121.0, 39.0], [-120.123456, 39.5], [-120.0, 39.0], [-121.0, 39.0]], [[-121.0, 39.0], [-120.1234560001, 39.5], [-120.0, 39.0], [-121.0, 39.0]]]
    df = spark.createDataFrame([("good", "Polygon", [rings[0]]), ("fine", "Polygon", [rings[1]])], "id string, geometry_type string, rings array<array<array<double>>>")
    assert {r.record for r in evidence.geometry(df, "id", ["Polygon"]).collect()} == {"fine"}


def test_plan_status_of_files_with_and_without_receipts(spark):
    index = spark.createDataFrame([(c, size) for c, size in zip("abcdefghi", ["10", "10", "10", "10", "100", "100", "100", "x", ""])], "topo_id string, size_bytes string")
    receipts = spark.createDataFrame([("a", "h", 10), ("b", "h", 10), ("c", "h", 10), ("d", "h", 10)], "topo_id string, sha256 string, byte_count long")
    disk = spark.createDataFrame([("b", "h", 10), ("c", "h", 9), ("d", "k", 10), ("e", "h", 116), ("f", "h", 117), ("g", "h", 0), ("h", "h", 5)], "topo_id string, sha256 string, byte_count long")
    got = {r.topo_id: (r.status, r.detail) for r in L.plan_status(index, receipts, disk).collect()}
    assert got == {
        "a": ("missing", "receipted file absent"),
        "b": ("present", "verified against the receipt"),
        "c": ("mismatch", "size differs from the receipt"),
        "d": ("mismatch", "hash differs from the receipt"),
        "e": ("present", "unreceipted file within tolerance"),
        "f": ("mismatch", "size differs from the index"),
        "g": ("mismatch", "file needs a review"),
        "h": ("present", "unreceipted file within tolerance"),
        "i": ("missing", "not fetched"),
    }
