"""Sources: JSON, GeoJSON, exact-header CSV, JSON Lines with line numbers, XML, YAML, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.integrity import EngineError
from palimpsest.sources.schemas import FEATURES, INDEX


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document (or an array of rows); a broken one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        df = json_document(spark, path, schema)
        df.limit(1).count()
        return df
    except Exception as e:
        if any(s in str(e) for s in ("PATH_NOT_FOUND", "MALFORMED", "FAILED_READ_FILE")):
            return None
        raise


def shape(raw: Column) -> tuple[Column, Column]:
    """Geometry type and rings of a feature's JSON text."""
    kind = F.get_json_object(raw, "$.geometry.type")
    text = F.get_json_object(raw, "$.geometry.coordinates")
    rings = (
        F.when(kind == "Point", F.array(F.array(F.from_json(text, "array<double>"))))
        .when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>")))
        .when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>"))
    )
    return kind, rings


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON collection: position, geometry type, uniform coordinates, properties.

    A point is one ring of one position and a line one ring, so that all kinds
    share a type. An unknown reference system or a null geometry is an error.
    """
    doc = json_document(spark, path, FEATURES)
    crs = F.col("crs.properties.name")
    from palimpsest.operators.constraints import CRS_NAMES

    if doc.where((F.col("type") != "FeatureCollection") | F.col("features").isNull() | (crs.isNotNull() & ~crs.isin(*CRS_NAMES))).limit(1).count():
        raise EngineError("load", f"{path} is not a collection of features in lon/lat")
    each = doc.select(F.posexplode("features").alias("position", "raw"))
    kind, rings = shape(F.col("raw"))
    return each.select("position", kind.alias("geometry_type"), rings.alias("rings"), F.from_json(F.get_json_object("raw", "$.properties"), properties).alias("p"), "raw").select("position", "geometry_type", "rings", "p.*", "raw")


def csv_exact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header is exactly the schema's; ragged rows are errors."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The source index, with safe and distinct ids."""
    df = csv_exact(spark, path, INDEX)
    unsafe = df.where(F.col("topo_id").isNull() | F.col("topo_id").isin("", ".", "..") | F.col("topo_id").rlike(r"[/\\]"))
    if unsafe.limit(1).count() or df.groupBy("topo_id").count().where("count > 1").limit(1).count():
        raise EngineError("index", "ids must be safe and distinct")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with ``line``, and ``bad`` where a line is no such object.

    Line numbers need the file whole, so it is read as one text and exploded.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("n", "raw")).where(F.trim("raw") != "")
    row = F.from_json("raw", schema)
    return lines.select((F.col("n") + 1).alias("line"), F.try_parse_json("raw").isNull().alias("bad"), row.alias("r")).select("line", "bad", "r.*")


def xml_records(df: DataFrame, xml: str, labels: list[str]) -> DataFrame:
    """Dates of process steps by label, horizontal datum and projection of metadata records.

    Text that is no metadata record gives nulls.
    """
    good = F.when(F.col(xml).rlike(r"(?s)^\s*(<\?xml[^>]*\?>)?\s*<metadata[\s>].*</metadata>\s*\z"), F.col(xml)).otherwise("<none/>")
    many = {label: F.try_element_at(F.xpath(good, F.lit(f'//procstep[normalize-space(procdesc)="{label}"]/procdate/text()')), F.lit(-1)) for label in labels}
    first = lambda tag: F.try_element_at(F.xpath(good, F.lit(f"//{tag}/text()")), F.lit(1))
    return df.withColumns(many | {"datum": first("horizdn"), "projection": first("mapprojn"), "supplinf": first("supplinf")})


def yaml_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a small YAML manifest, read on the driver through Spark's file reader."""
    import yaml

    text = spark.read.text(path, wholetext=True).first().value
    rows = yaml.safe_load(text) or []
    rows = rows.get("sources", []) if isinstance(rows, dict) else rows
    return spark.createDataFrame([(r["id"], r.get("title"), r.get("rights")) for r in rows], "id string, title string, rights string")


def selection(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Ids of a selection in order; all or nothing."""
    doc = json_document(spark, path, "version int, topo_ids array<string>").first()
    ids = (doc.topo_ids or []) if doc and doc.version == 1 else []
    if not ids or any(not i or not i.strip() for i in ids) or len(set(ids)) != len(ids):
        raise EngineError("selection", "version 1 with distinct ids is needed")
    rows = spark.createDataFrame(list(enumerate(ids)), "position int, topo_id string")
    lost = [r.topo_id for r in rows.join(index, "topo_id", "left_anti").orderBy("position").limit(5).collect()]
    if lost:
        raise EngineError("selection", f"not in the index: {', '.join(lost)}")
    return rows


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
