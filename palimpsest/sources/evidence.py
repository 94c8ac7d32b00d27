"""The four evidence files as rows of JSON text; a file that cannot be read is a failure row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.integrity import FAILURES
from palimpsest.operators.json_schema import items, kind, part, text

FILES = {"trails": "trails.json", "alignments": "alignments.geojson", "observations": "observations.geojson", "support": "support.csv"}
# The header of the support file, and where each record has its name.
SUPPORT_HEADER = ["alignment_id", "observation_id", "role", "confidence", "note"]
IDS = {"trails": "$.trail_id", "alignments": "$.properties.alignment_id", "observations": "$.properties.observation_id"}


def _whole(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.text(path, wholetext=True)
        df.limit(1).count()
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _list_in(value: Column, name: str) -> tuple[Column, Column]:
    """The array of records of a document, and what keeps it from being one."""
    if name == "trails":
        return items(value), F.when(kind(value) != "array", "must be an array of objects")
    inside = part(value, "features")
    wrong = F.when((kind(value) != "object") | ~F.coalesce(text(part(value, "type")) == "FeatureCollection", F.lit(False)), "top level must be a FeatureCollection")
    return items(inside), wrong.when(F.coalesce(kind(inside) != "array", F.lit(True)), "features must be an array")


def _support(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    head = spark.read.text(path).first()
    header = head.value if head else ""
    if header.removeprefix("\ufeff").replace('"', "").rstrip("\r") != ",".join(SUPPORT_HEADER):
        return None, f"header must be {','.join(SUPPORT_HEADER)}, got {header}"
    schema = ", ".join(f"{c} string" for c in SUPPORT_HEADER) + ", _corrupt string"
    # a cell may hold a line feed, so the file is one split, and its rows are numbered as they stand
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    cells = F.struct(*(F.coalesce(c, F.when(F.col("_corrupt").isNull(), "")).alias(c) for c in SUPPORT_HEADER))
    return rows.select(F.monotonically_increasing_id().alias("position"), F.to_json(cells).alias("raw")), None


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows (position, record, raw) of each file, or no rows at all and why, as failures.

    All missing files are told at once; after that the first file that is broken.
    """
    paths = {n: f"{folder.rstrip('/')}/{f}" for n, f in FILES.items()}
    docs = {n: _whole(spark, p) for n, p in paths.items()}
    said = [("schema", FILES[n], "file is missing") for n, d in docs.items() if d is None]
    out: dict[str, DataFrame] = {}
    for name, doc in docs.items():
        if said:
            return {}, spark.createDataFrame(said, FAILURES)
        if name == "support":
            rows, wrong = _support(spark, paths[name])
            where = F.concat_ws(" -> ", *(F.get_json_object("raw", f"$.{k}") for k in SUPPORT_HEADER[:2]))
            known = (F.get_json_object("raw", "$.alignment_id") != "") & (F.get_json_object("raw", "$.observation_id") != "")
        else:
            doc = doc.select(F.try_parse_json("value").alias("v"))
            each, problem = _list_in(F.col("v"), name)
            first = doc.select(F.when(F.col("v").isNull(), "not valid JSON").otherwise(problem).alias("p")).first()
            wrong = first.p if first else "not valid JSON"
            rows = doc.select(F.posexplode(each).alias("position", "v")).select("position", F.to_json("v").alias("raw"))
            where = F.when(kind(F.try_variant_get(F.try_parse_json("raw"), IDS[name], "variant")) == "string", F.get_json_object("raw", IDS[name]))
            known = where != ""
        if wrong is not None:
            said.append(("schema", FILES[name], wrong))
            continue
        label = F.concat(F.lit(f"{FILES[name]}["), F.col("position"), F.lit("] "), F.when(known, where).otherwise("<unidentified>"))
        out[name] = rows.select("position", label.alias("record"), "raw")
    return (out if not said else {}), spark.createDataFrame(said, FAILURES)
