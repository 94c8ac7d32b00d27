"""Public projections of an edition manifest, cards, notices and the checks before publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.integrity import EngineError, failures

# Keys that a public edition shows, in this order.
PUBLIC_KEYS = [
    "id", "source_id", "kind", "source_kind", "label", "sheet_name", "scale", "citation", "source_url", "rights", "attribution", "printed_credit_note",
    "publication_date", "dates", "component_dates", "date_note", "native_resolution_metres", "native_max_zoom", "tile_url",
]


def public_editions(manifest: DataFrame, order: list[str], built_max: int, initial: str | None = None) -> DataFrame:
    """Editions in contract order with allowlisted keys and capped zoom.

    Ids that repeat, an order that names unknown ones and an initial edition
    outside it are errors; editions are a short list.
    """
    at = F.array_position(F.array(*map(F.lit, order)), F.col("id"))
    df = manifest.withColumns({"tile_url": F.concat(F.lit("tiles/"), F.col("id"), F.lit("/{z}/{x}/{y}.png")), "native_max_zoom": F.least("native_max_zoom", F.lit(built_max))})
    lost = [k for k in PUBLIC_KEYS if k not in df.columns]
    if lost:
        raise EngineError("publish", f"manifest lacks {', '.join(lost)}")
    counts = {r["id"]: r["count"] for r in manifest.groupBy("id").count().collect()}
    twice, unknown = sorted(str(k) for k, n in counts.items() if n > 1), [k for k in order if k not in counts]
    if twice:
        raise EngineError("publish", f"the manifest holds two editions with the id {', '.join(twice)}")
    if unknown:
        raise EngineError("publish", f"the order names unknown editions {', '.join(unknown)}")
    if initial is not None and initial not in order:
        raise EngineError("publish", f"the initial edition {initial} is not in the order")
    return df.withColumn("position", at).where("position > 0").select("position", *PUBLIC_KEYS)


def neighbours(df: DataFrame, key: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The rows before and after each, without wrapping."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return df.withColumns({"previous_id": F.lag(key).over(w), "next_id": F.lead(key).over(w)})


def card(df: DataFrame, key: str, rows: dict[str, Column]) -> DataFrame:
    """Label and value rows of each record; a null value has no row."""
    all_rows = F.array(*(F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in rows.items()))
    return df.select(F.col(key), F.posexplode(F.filter(all_rows, lambda r: r["value"].isNotNull())).alias("position", "r")).select(key, "position", "r.label", "r.value")


def notice(status: Column, name: Column, error: Column) -> Column:
    return (
        F.when(status == "loading", F.format_string("Loading %s.", name))
        .when(status == "error", F.format_string("%s could not be shown: %s", name, F.coalesce(error, F.lit("no detail"))))
        .when(status == "displayed", F.format_string("Showing %s.", name))
        .otherwise(F.lit(""))
    )


def unexpected(listing: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """Entries on disk that the record does not name."""
    return failures(listing.join(expected.select(path), path, "left_anti"), "publish", F.col(path), F.lit("unexpected entry"))


def record_agrees(disk: DataFrame, record: DataFrame, key: str = "edition_id") -> DataFrame:
    """Tile trees whose digest, count or bytes are not the recorded ones."""
    r = record.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("digest", "tiles", "bytes")))
    each = disk.join(r, F.col(key) == F.col("_k"), "full_outer")
    differs = sum(((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int") for c in ("digest", "tiles", "bytes")), F.lit(0)) > 0
    return failures(each.where(differs), "publish", F.coalesce(key, "_k"), F.lit("tiles are not those of the record"))


def contract_fields(manifest: DataFrame, contract: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Editions whose fields differ from the contract's, one failure a field."""
    c = contract.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    each = manifest.join(c, F.col(key) == F.col("_k"), "left")
    said = F.array(F.when(F.col("_k").isNull(), "not in the contract"), *(F.when(F.col("_k").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f"{f} differs")) for f in fields))
    return failures(each.withColumn("_m", F.explode(F.filter(said, lambda m: m.isNotNull()))), "contract", F.col(key), F.col("_m"))


def pick_operation(operations: DataFrame, key: str) -> DataFrame:
    """Most accurate named operation that is available, and whether a better one was not."""
    named = operations.where(~F.contains(F.lower("name"), F.lit("ballpark")) & F.col("accuracy").isNotNull())
    best = F.min_by(F.struct("name", "accuracy"), F.when(F.col("available"), F.struct("accuracy", "name")))
    out = named.groupBy(key).agg(best.alias("b"), F.min(F.when(~F.col("available"), F.col("accuracy"))).alias("missing"))
    return out.select(key, "b.name", "b.accuracy", F.coalesce(F.col("missing") < F.col("b.accuracy"), F.lit(False)).alias("better_unavailable"))
