"""Validation of an evidence graph: trails, alignments, observations and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import integrity as I
from palimpsest.operators.constraints import check_rows
from palimpsest.operators.json_schema import check_json, marks, strings_at
from palimpsest.operators.leak import substring_join
from palimpsest.operators.spatial import ring_problem
from palimpsest.operators.temporal import temporal_failures
from palimpsest.sources.evidence import FILES, load
from palimpsest.sources.readers import shape
from palimpsest.sources.schemas import ALIGNMENTS, OBSERVATIONS, SUPPORT

DATE_PAIRS = [("earliest_known_open", "latest_known_open"), ("earliest_known_closed", "latest_known_closed")]


def label(df: DataFrame, key: str) -> str:
    """Column that names a record: ``record`` where the loader gave one, else its id."""
    return "record" if "record" in df.columns else key


def record(df: DataFrame, key: str) -> Column:
    return F.col(label(df, key))


def duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    return I.failures(I.first_duplicate(df.where(F.col(key).isNotNull()), [key], [position]), "references", record(df, key), I.says(f"duplicate {key}", F.col(key)))


def references(trails: DataFrame, alignments: DataFrame, observations: DataFrame, support: DataFrame) -> DataFrame:
    return I.union_failures(
        duplicates(trails, "trail_id", "position"),
        duplicates(alignments, "alignment_id", "position"),
        duplicates(observations, "observation_id", "position"),
        I.missing_target(alignments, "trail_id", trails, "trail_id", "references", label(alignments, "alignment_id")),
        I.missing_target(alignments, "superseded_by", alignments, "alignment_id", "references", label(alignments, "alignment_id")),
        I.failures(alignments.where("alignment_id = superseded_by"), "references", record(alignments, "alignment_id"), F.lit("superseded_by points at itself")),
        I.missing_target(support, "alignment_id", alignments, "alignment_id", "references", label(support, "alignment_id")),
        I.missing_target(support, "observation_id", observations, "observation_id", "references", label(support, "alignment_id")),
    )


def geometry(df: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Types, ranges, precision of six places, and the validity of rings."""
    flat = F.flatten("rings")
    rows = df.withColumn("_flat", flat).withColumn("_fine", F.exists(F.flatten("_flat"), lambda v: v != F.round(v, 6)))
    rules = [("geometry_type", "geometry_type", kinds), ("_flat", "in_range", None), ("_fine", "expression", "NOT _fine")]
    rules += [] if "Point" in kinds else [("_flat", "positions", 2)]
    shapes = df.where("geometry_type = 'Polygon'").select(F.col(key), ring_problem(F.col("rings")[0]).alias("_p")).where("_p IS NOT NULL")
    return check_rows(rows, rules, key, "geometry").unionByName(I.failures(shapes, "geometry", F.col(key), F.col("_p")))


def leaks(files: DataFrame, values: DataFrame) -> DataFrame:
    """Published files (path, text) that hold a restricted value (record, value)."""
    found = substring_join(files, "text", values, "value")
    return I.failures(found, "leak", F.col("record"), F.concat(F.lit("found in "), F.col("path")))


def restricted_columns(alignments: DataFrame, observations: DataFrame) -> DataFrame:
    """As ``restricted_values``, of typed tables."""
    parts = [
        alignments.select(record(alignments, "alignment_id").alias("record"), F.explode("parcel_apns").alias("value")),
        observations.select(record(observations, "observation_id").alias("record"), F.explode(F.array("declarant_name", "document_path")).alias("value")),
        observations.where("sensitivity = 'restricted'").select(record(observations, "observation_id").alias("record"), F.col("observation_id").alias("value")),
    ]
    return I.union_failures(*parts).where("trim(value) <> ''")


def restricted_values(rows: dict[str, DataFrame], schemas: dict[str, dict]) -> DataFrame:
    """Values (record, value) that the schemas mark restricted, and ids of observations withheld as a whole."""
    found = [strings_at(rows[n], "raw", marks(schemas[n])[0], F.col("record")) for n in rows]
    withheld = rows["observations"].where(F.get_json_object("raw", "$.properties.sensitivity") == "restricted")
    return I.union_failures(*found, strings_at(withheld, "raw", [("properties", "observation_id")], F.col("record")))


def graph(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed tables of the rows of JSON text; what has another type is null here and a schema failure there."""
    kind, rings = shape(F.col("raw"))
    placed = {"geometry_type": kind, "rings": rings}

    def typed(name: str, schema: str, at: str, more: dict) -> DataFrame:
        p = F.from_json(F.get_json_object("raw", at), schema)
        return rows[name].withColumns({**more, "p": p}).select("position", "record", *more, "p.*")

    return {
        "trails": typed("trails", "trail_id string", "$", {}),
        "alignments": typed("alignments", ALIGNMENTS, "$.properties", placed),
        "observations": typed("observations", OBSERVATIONS, "$.properties", placed),
        "support": typed("support", SUPPORT, "$", {}),
    }


def validate(trails: DataFrame, alignments: DataFrame, observations: DataFrame, support: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Failures of the typed graph (references, dates, shapes, and leaks into ``files``), as (check, record, message)."""
    lone = I.failures(I.orphans(alignments, "alignment_id", support, "alignment_id"), "orphans", record(alignments, "alignment_id"), F.lit("no support row"))
    found = [
        references(trails, alignments, observations, support),
        lone,
        temporal_failures(alignments, DATE_PAIRS, label(alignments, "alignment_id")),
        temporal_failures(observations, [("date_start", "date_end")], label(observations, "observation_id")),
        geometry(alignments, label(alignments, "alignment_id"), ["LineString"]),
        geometry(observations, label(observations, "observation_id"), ["Point", "LineString", "Polygon"]),
    ]
    if files is not None:
        found.append(leaks(files, restricted_columns(alignments, observations)))
    return I.union_failures(*found)


def validate_folder(spark: SparkSession, folder: str, schemas: dict[str, dict], files: DataFrame | None = None) -> DataFrame:
    """Everything that is wrong with the evidence in a folder; a file that does not load is all that is told.

    ``schemas``: the JSON schema of each of trails, alignments, observations and
    support. ``files`` (path, text): what is published, searched for restricted values.
    """
    rows, broken = load(spark, folder)
    if not rows:
        return broken
    bare = [("schema", f"{n}.schema.json", f"{'.'.join(p)}: no x-sensitivity") for n in FILES for p in marks(schemas[n])[1]]
    found = [spark.createDataFrame(bare, I.FAILURES)] + [check_json(rows[n], "raw", schemas[n], F.col("record")) for n in FILES]
    found.append(validate(**graph(rows)))
    if files is not None:
        found.append(leaks(files, restricted_values(rows, schemas)))
    return I.union_failures(*found)
