"""One change to a sound graph gives the failures of that change and no others."""

import json

import pytest
from palimpsest.operators.json_schema import check_json, marks
from palimpsest.plans.evidence import validate_folder
from pyspark.sql import functions as F

SLUG = {"type": "string", "pattern": "^[a-z0-9]+(-[a-z0-9]+)*$", "x-sensitivity": "public"}
DATE = {"type": ["string", "null"], "pattern": "^[0-9]{4}(-[0-9]{2}-[0-9]{2})?$", "x-sensitivity": "public"}
POSITION = {"type": "array", "minItems": 2, "maxItems": 2, "prefixItems": [{"type": "number", "minimum": -180, "maximum": 180}, {"type": "number", "minimum": -90, "maximum": 90}]}


def closed(properties: dict, **more) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties, **more}


def form(kind: str, coordinates: dict) -> dict:
    return closed({"type": {"const": kind}, "coordinates": coordinates})


def feature(geometry: dict, properties: dict, **more) -> dict:
    return closed({"type": {"const": "Feature", "x-sensitivity": "public"}, "geometry": geometry | {"x-sensitivity": "public"}, "properties": closed(properties)}, **more)


LINE = form("LineString", {"type": "array", "minItems": 2, "items": POSITION})
PLACE = {"type": "object", "oneOf": [form("Point", {"$ref": "#/$defs/position"}), LINE]}
RESTRICTED = {"type": ["string", "null"], "minLength": 1, "x-sensitivity": "restricted"}
DATES = ["earliest_known_open", "latest_known_open", "earliest_known_closed", "latest_known_closed"]
SCHEMAS = {
    "trails": closed({"trail_id": SLUG, "name": {"type": "string", "minLength": 1, "x-sensitivity": "public"}, "aka": {"type": "array", "items": {"type": "string", "minLength": 1}, "x-sensitivity": "public"}}),
    "alignments": feature(
        LINE,
        {"alignment_id": SLUG, "trail_id": SLUG, **dict.fromkeys(DATES, DATE), "superseded_by": SLUG | {"type": ["string", "null"]}, "parcel_apns": {"type": "array", "items": {"type": "string", "minLength": 1}, "x-sensitivity": "restricted"}},
    ),
    "observations": feature(
        PLACE,
        {"observation_id": SLUG, "date_start": DATE, "date_end": DATE, "sensitivity": {"enum": ["public", "restricted"], "x-sensitivity": "public"}, "declarant_name": RESTRICTED, "document_path": RESTRICTED},
        **{"$defs": {"position": POSITION}},
    ),
    "support": closed({"alignment_id": SLUG, "observation_id": SLUG, "role": {"enum": ["attests_existence", "attests_closure"], "x-sensitivity": "public"}, "confidence": {"enum": ["high", "low"], "x-sensitivity": "public"}, "note": {"type": "string", "x-sensitivity": "public"}}),
}


def sound() -> dict:
    return {
        "trails": [{"trail_id": "t", "name": "Ditch path", "aka": ["The ditch"]}],
        "alignments": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-120.5, 39.3], [-120.499, 39.301]]}, "properties": {"alignment_id": "a", "trail_id": "t", **dict.fromkeys(DATES), "superseded_by": None, "parcel_apns": ["012-345-678"]}}],
        "observations": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-120.5, 39.3]}, "properties": {"observation_id": "o", "date_start": "1950", "date_end": None, "sensitivity": "public", "declarant_name": "Ada Example", "document_path": None}}],
        "support": [["a", "o", "attests_existence", "high", ""]],
        "header": "alignment_id,observation_id,role,confidence,note",
    }


def failures(spark, folder, g: dict, files=None) -> set:
    folder.mkdir(exist_ok=True)
    (folder / "trails.json").write_text(g["trails"] if isinstance(g["trails"], str) else json.dumps(g["trails"], indent=2))
    for n in ("alignments", "observations"):
        (folder / f"{n}.geojson").write_text(json.dumps(g[n] if isinstance(g[n], dict) else {"type": "FeatureCollection", "features": g[n]}))
    (folder / "support.csv").write_text("\n".join([g["header"], *(",".join(r) for r in g["support"]), ""]))
    return {tuple(r) for r in validate_folder(spark, str(folder), SCHEMAS, files).collect()}


def put(g: dict, path: str, value) -> None:
    *steps, last = [int(s) if s.isdigit() else s for s in path.split(".")]
    for s in steps:
        g = g[s]
    g[last] = value


CHANGES = [
    ("trails.0.tier", 1, [("schema", "trails.json[0] t")]),
    ("trails.0.name", None, [("schema", "trails.json[0] t")]),
    ("trails.0.aka", ["x", ""], [("schema", "trails.json[0] t")]),
    ("trails.0.trail_id", 7, [("schema", "trails.json[0] <unidentified>"), ("references", "alignments.geojson[0] a")]),
    ("alignments.0.properties.trail_id", "no-trail", [("references", "alignments.geojson[0] a")]),
    ("alignments.0.properties.superseded_by", "a", [("references", "alignments.geojson[0] a")]),
    ("alignments.0.properties.earliest_known_open", "1950-02-30", [("temporal", "alignments.geojson[0] a")]),
    ("alignments.0.geometry", None, [("schema", "alignments.geojson[0] a"), ("geometry", "alignments.geojson[0] a")]),
    ("alignments.0.geometry.coordinates.0.0", -120.5000001, [("geometry", "alignments.geojson[0] a")]),
    ("alignments.0.geometry.coordinates.0.0", 200.0, [("schema", "alignments.geojson[0] a"), ("geometry", "alignments.geojson[0] a")]),
    ("observations.0.geometry", {"type": "Point", "coordinates": [1]}, [("schema", "observations.geojson[0] o"), ("geometry", "observations.geojson[0] o")]),
    ("observations.0.properties.sensitivity", "secret", [("schema", "observations.geojson[0] o")]),
    ("support.0", ["a", "x", "attests_existence", "high", ""], [("references", "support.csv[0] a -> x")]),
    ("support.0", ["a", "o", "attests_existence", "high"], [("schema", "support.csv[0] a -> o")]),
    ("support", [], [("orphans", "alignments.geojson[0] a")]),
    ("header", "alignment_id,observation_id,role,confidence,note,sensitivity", [("schema", "support.csv")]),
    ("trails", "{broken", [("schema", "trails.json")]),
    ("trails", {}, [("schema", "trails.json")]),
    ("observations", {"type": "Feature"}, [("schema", "observations.geojson")]),
    ("observations", {"type": "FeatureCollection"}, [("schema", "observations.geojson")]),
]


def copies(n: int) -> dict:
    """A graph of n sound graphs; the ids of each end in its number."""
    out = {"trails": [], "alignments": [], "observations": [], "support": [], "header": sound()["header"]}
    for i in range(n):
        g = sound()
        g["trails"][0]["trail_id"] = f"t{i}"
        g["alignments"][0]["properties"] |= {"alignment_id": f"a{i}", "trail_id": f"t{i}"}
        g["observations"][0]["properties"]["observation_id"] = f"o{i}"
        g["support"] = [[f"a{i}", f"o{i}", *g["support"][0][2:]]]
        for k in FIELDS:
            out[k] += g[k]
    return out


FIELDS = ["trails", "alignments", "observations", "support"]


def test_a_sound_graph_passes(spark, tmp_path):
    assert failures(spark, tmp_path, sound()) == set()


def test_each_change_to_a_record_fails_alone(spark, tmp_path):
    changes = [c for c in CHANGES if c[0].count(".")]
    g, expected = copies(len(changes)), set()
    for i, (path, value, found) in enumerate(changes):
        own = lambda s: s if s in ("x", "no-trail") else f"{s}{i}"  # noqa: B023, E731
        name, _, rest = path.split(".", 2) if path.count(".") > 1 else (*path.split("."), "")
        if name == "support":
            value = [own(value[0]), own(value[1]), *value[2:]]
        elif rest.endswith("superseded_by"):
            value = own(value)
        put(g, f"{name}.{i}" + f".{rest}" * (rest != ""), value)
        for check, record in found:
            file, _, ids = record.partition("[0] ")
            expected.add((check, f"{file}[{i}] " + (ids if ids.startswith("<") else " -> ".join(map(own, ids.split(" -> "))))))
    assert {f[:2] for f in failures(spark, tmp_path, g)} == expected


def test_files_that_do_not_load(spark, tmp_path):
    for i, (path, value, expected) in enumerate(c for c in CHANGES if not c[0].count(".")):
        g = sound()
        put(g, path, value)
        assert {f[:2] for f in failures(spark, tmp_path / str(i), g)} == set(expected), path


def test_repeated_records_and_missing_files(spark, tmp_path):
    g = sound()
    for n in ("trails", "alignments", "observations"):
        g[n] = g[n] * 2
    found = {f[:2] for f in failures(spark, tmp_path / "g", g)}
    assert found == {("references", f) for f in ("trails.json[1] t", "alignments.geojson[1] a", "observations.geojson[1] o")}
    for n in ("trails.json", "support.csv"):
        (tmp_path / "g" / n).unlink()
    assert {tuple(r) for r in validate_folder(spark, str(tmp_path / "g"), SCHEMAS).collect()} == {("schema", n, "file is missing") for n in ("trails.json", "support.csv")}


def test_restricted_values_are_found_by_their_marks(spark, tmp_path):
    files = spark.createDataFrame([("p", "by Ada Example"), ("q", "lot 012-345-678 here"), ("r", "clean")], "path string, text string")
    assert {f[:2] for f in failures(spark, tmp_path / "g", sound(), files)} == {("leak", "observations.geojson[0] o"), ("leak", "alignments.geojson[0] a")}
    assert marks(SCHEMAS["alignments"])[0] == [("properties", "parcel_apns")]
    assert marks(closed({"a": {"type": "string"}, "b": closed({"c": {"type": "string"}})}))[1] == [("a",), ("b", "c")]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": "integer", "multipleOf": 10}, ["10", "-20", "30.0"], ["15", "1.5", '"10"', "null"]),
        ({"uniqueItems": True}, ["[1,2]", "[]", '"x"'], ["[1,1]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
        ({"if": {"properties": {"k": {"const": "x"}}, "required": ["k"]}, "then": {"required": ["v"]}, "else": {"not": {"required": ["v"]}}}, ['{"k":"x","v":1}', '{"k":"y"}'], ['{"k":"x"}', '{"k":"y","v":1}']),
        ({"oneOf": [{"type": "string"}, {"minLength": 3}]}, ['"ab"'], ['"abcd"']),
        ({"exclusiveMinimum": 0, "enum": [1, 2, None]}, ["1", "null"], ["0", "3", '"1"']),
        ({"items": {"items": {"type": "number"}}}, ["[[1,2],[]]", "[]"], ['[[1],["a"]]', "[[null]]"]),
    ],
)
def test_keywords(spark, schema, good, bad):
    df = spark.createDataFrame([(x,) for x in good + bad], "raw string")
    assert {r.record for r in check_json(df, "raw", schema, F.col("raw")).collect()} == set(bad)
