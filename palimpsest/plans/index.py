"""The source index: rows from catalogue items, years, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import strings as S

ITEM = "urls struct<GeoTIFF:string>, boundingBox struct<minX:double,minY:double,maxX:double,maxY:double>, vendorMetaUrl string, metaUrl string, extent string, sourceId string, sizeInBytes long"
YEARS = ["aerial_photo_year", "photo_revision_year", "field_check_year", "edit_year", "photo_inspection_year", "survey_year"]


def build_rows(items: DataFrame, item: str = "item") -> DataFrame:
    """Index rows of items with a sheet's file; others are left out."""
    df = items.select(F.from_json(item, ITEM).alias("i"))
    parts = S.sheet_parts(F.col("i.urls.GeoTIFF"))
    df = df.withColumn("p", parts).where("p IS NOT NULL")
    decoded = F.concat_ws("_", "p.state", F.replace(F.col("p.name"), F.lit(" "), F.lit("_")), "p.scan", "p.year", "p.scale")
    return df.select(
        decoded.alias("topo_id"),
        F.col("p.name").alias("map_name"),
        F.col("p.scale").alias("scale"),
        F.col("i.extent").alias("extent"),
        F.col("p.year").alias("date_on_map"),
        *(F.col(f"i.boundingBox.{a}").alias(b) for a, b in (("minX", "west"), ("minY", "south"), ("maxX", "east"), ("maxY", "north"))),
        F.col("i.sizeInBytes").cast("string").alias("size_bytes"),
        F.col("i.urls.GeoTIFF").alias("geotiff_url"),
        F.lit("public_domain").alias("rights"),
        F.coalesce("i.vendorMetaUrl", F.lit("")).alias("metadata_url"),
        F.coalesce("i.metaUrl", F.lit("")).alias("sciencebase_url"),
        F.coalesce(F.nullif("i.sourceId", F.lit("")), "p.scan").alias("source_id"),
    )


def latest_year(*years: Column) -> Column:
    """Largest of the years that are four digits; null if none is."""
    return F.array_max(F.filter(F.transform(F.array(*years), lambda y: F.when(y.rlike(r"^\d{4}\z"), y.try_cast("int"))), lambda y: y.isNotNull()))


def guarded_sum(text: Column) -> Column:
    return F.sum(F.when(text.rlike(r"^\d+\z"), text.try_cast("long")))


def to_harvest(index: DataFrame, prior: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows whose metadata must be fetched: new, moved, or never read."""
    p = prior.select(F.col("topo_id").alias("_k"), F.col("metadata_url").alias("_u"), F.col("datum").alias("_d"))
    joined = index.join(p, F.col("topo_id") == F.col("_k"), "left")
    need = F.lit(refresh) | F.col("_k").isNull() | ~F.col("metadata_url").eqNullSafe(F.col("_u")) | (F.coalesce("_d", F.lit("")) == "")
    return joined.where((F.coalesce("metadata_url", F.lit("")) != "") & need).select(index.columns)


def carry_forward(index: DataFrame, prior: DataFrame, columns: list[str]) -> DataFrame:
    """Harvested columns of the prior index, where the metadata address is the same."""
    p = prior.select("topo_id", "metadata_url", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns))
    out = index.join(p, ["topo_id", "metadata_url"], "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c) if c in index.columns else F.lit(None).cast("string")) for c in columns}).drop(*(f"_{c}" for c in columns))


def ordered(index: DataFrame) -> DataFrame:
    return index.orderBy(F.col("scale").try_cast("int"), "map_name", "date_on_map", "topo_id")


def by_scale(index: DataFrame) -> DataFrame:
    """Sheets, gigabytes, and first and last year per scale, and over all (null scale)."""
    return (
        index.withColumn("scale", F.col("scale").try_cast("int"))
        .groupingSets([["scale"], []], "scale")
        .agg(F.count("*").alias("sheets"), (guarded_sum(F.col("size_bytes")) / 1e9).alias("gb"), F.coalesce(F.min("date_on_map"), F.lit("?")).alias("first_year"), F.coalesce(F.max("date_on_map"), F.lit("?")).alias("last_year"), F.count_if(F.col("content_year") != F.col("date_on_map")).alias("later"))
    )


def report(index: DataFrame) -> list[str]:
    """Markdown lines of the summary by scale."""
    rows = by_scale(index).orderBy(F.col("scale").isNull(), "scale").collect()  # a row per scale
    out = ["| scale | sheets | GB | years |", "| --- | --- | --- | --- |"]
    return out + [f"| {f'1:{r.scale:,}' if r.scale else '**all**'} | {r.sheets} | {(r.gb or 0):.1f} | {r.first_year}–{r.last_year} |" for r in rows]


def coverage_report(cube: DataFrame, totals: DataFrame, counters: list[str]) -> list[str]:
    """Markdown by county and decade with bold totals; counties overlap and are never added."""
    bold = {r.county: r for r in totals.collect()}  # a row per county
    out, county = [], None
    for r in cube.orderBy("county", "decade").toLocalIterator():
        if r.county != county:
            if county is not None:
                out.append("| **all** | " + " | ".join(f"**{bold[county][c]}**" for c in counters) + " |")
            county = r.county
            out += ["", f"## {county}", "", "| decade | " + " | ".join(counters) + " |", "| --- |" + " --- |" * len(counters)]
        out.append(f"| {r.decade}s | " + " | ".join(str(r[c]) for c in counters) + " |")
    if county is not None:
        out.append("| **all** | " + " | ".join(f"**{bold[county][c]}**" for c in counters) + " |")
    return out
