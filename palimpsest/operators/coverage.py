"""Coverage inventory: spine, links by footprint and decade, cube, rollup, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import decades
from palimpsest.operators.integrity import failures
from palimpsest.operators.spatial import box_join


# Gap codes, and those of a cell that nobody has looked at yet.
GAP_CODES = ["unsearched", "no_source_located", "access_blocked", "dating_unresolved", "not_examined", "partially_examined", "not_digitized"]
NEW_CELL_GAP_CODES = ["not_digitized", "not_examined", "unsearched"]


def spine(areas: DataFrame, periods: DataFrame) -> DataFrame:
    """Every area with every period; a broadcast of the periods is left to their measured size."""
    return areas.crossJoin(periods)


def spine_problems(full: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks, with ``side``: missing or unknown."""
    a, b = full.select(*keys), cells.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("unknown")))


def associate(sources: DataFrame, areas: DataFrame, bin_size: float = 0.125, first_decade: int = 1950) -> DataFrame:
    """Sorted references of each (area, decade) whose area a dated footprint overlaps.

    ``sources``: ref, box, and an array ``spans`` of (start, end) years.
    """
    pairs = box_join(sources.dropna(subset=["west", "south", "east", "north"]), areas, bin_size, bin_size)
    dated = pairs.withColumn("span", F.explode("spans")).withColumn("decade", F.explode(decades(F.col("span.start"), F.col("span.end")))).where(F.col("decade") >= first_decade)
    return dated.groupBy("area_id", "decade").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def refresh(full: DataFrame, cells: DataFrame, generated: DataFrame) -> DataFrame:
    """Spine cells with manual fields kept, and references made anew beside manual ones.

    A cell that was not there gets the codes of one that nobody has looked at.
    """
    empty = F.array().cast("array<string>")
    manual = F.filter(F.coalesce("source_refs", empty), lambda r: r.startswith("candidate:"))
    out = full.select("area_id", "decade").join(cells.withColumn("_old", F.lit(True)), ["area_id", "decade"], "left").join(generated, ["area_id", "decade"], "left")
    lists = {c: F.coalesce(c, empty) for c in ("search_ids", "review_ids", "batch_ids")}
    lists["gap_codes"] = F.when(F.col("_old"), F.coalesce("gap_codes", empty)).otherwise(F.array(*map(F.lit, NEW_CELL_GAP_CODES)))
    return out.withColumns({"source_refs": F.array_sort(F.array_union(manual, F.coalesce("refs", empty))), **lists}).drop("refs", "_old")


def orphaned_work(cells: DataFrame, full: DataFrame) -> DataFrame:
    """Cells outside the spine that hold recorded work, which a refresh must not drop."""
    worked = sum((F.size(c) for c in ("source_refs", "search_ids", "review_ids", "batch_ids", "gap_codes")), F.lit(0)) > 0
    lost = cells.join(full.select("area_id", "decade"), ["area_id", "decade"], "left_anti").where(worked | F.col("gap_note").isNotNull())
    return failures(lost, "refresh", F.concat_ws(" ", "area_id", "decade"), F.lit("would lose recorded work"))


def cube(facts: DataFrame, groups: list[str], counters: dict[str, Column], full: DataFrame | None = None) -> DataFrame:
    """Conditional counts per group, zero for the groups of ``full`` without facts."""
    out = facts.groupBy(*groups).agg(*(F.count_if(c).alias(n) for n, c in counters.items()))
    return out if full is None else full.select(*groups).join(out, groups, "left").fillna(0, list(counters))


def examination(scopes: Column) -> Column:
    """``whole`` if some review covered the whole source footprint, else ``partial``, else ``none``."""
    return F.when(F.array_contains(scopes, "whole_source_footprint"), "whole").when(F.size(scopes) > 0, "partial").otherwise("none")


def inventory_cube(cells: DataFrame, reviews: DataFrame, batches: DataFrame, areas: DataFrame, decades_list: DataFrame) -> DataFrame:
    """Counts per county and decade; an area counts once in each county that it meets.

    A cell is examined as far as the reviews that it names reach, and counts once
    for each of its gap codes; batches count unless they are only planned.
    """
    named = cells.select("area_id", "decade", F.explode("review_ids").alias("review_id")).distinct()
    seen = named.join(reviews.select("review_id", "scope"), "review_id").groupBy("area_id", "decade").agg(F.collect_set("scope").alias("scopes"))
    each = cells.join(seen, ["area_id", "decade"], "left").join(areas.select("area_id", F.explode("county_geoids").alias("county")), "area_id")
    how = examination(F.coalesce("scopes", F.array().cast("array<string>")))
    counters = {
        "cells": F.lit(True),
        "located": F.size("source_refs") > 0,
        "examined_whole": how == "whole",
        "examined_partial": how == "partial",
        "unexamined": how == "none",
        **{code: F.array_contains("gap_codes", code) for code in GAP_CODES},
    }
    counties = areas.select(F.explode("county_geoids").alias("county")).distinct()
    full = spine(counties, decades_list)
    done = batches.where("status <> 'planned'").groupBy(F.col("county_geoid").alias("county"), "decade").pivot("status", ["ready", "digitized"]).agg(F.count(F.lit(1)))
    return cube(each, ["county", "decade"], counters, full).join(done, ["county", "decade"], "left").fillna(0)


def rollup(counts: DataFrame, by: str, over: str, counters: list[str]) -> DataFrame:
    """Rows per (by, over) and per by; there is no grand total, as groups may overlap."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in counters)
    return counts.sparkSession.sql(f"SELECT {by}, {over}, {sums} FROM {{df}} GROUP BY GROUPING SETS (({by}, {over}), ({by}))", df=counts)


def membership(areas: DataFrame, array: str) -> DataFrame:
    """Per member of the arrays: how many rows name it, and how many of those name others too."""
    each = areas.select(F.explode(array).alias("member"), (F.size(array) > 1).alias("shared"))
    return each.groupBy("member").agg(F.count("*").alias("n"), F.count_if("shared").alias("n_shared"))


def release_gate(qualifying: DataFrame, counties: DataFrame) -> DataFrame:
    """What each county lacks: two decades, one before 2000, one from 2000 on.

    ``qualifying``: the ready batches that pass (see ``qualifying_batches``).
    """
    got = qualifying.groupBy("county_geoid").agg(F.array_sort(F.collect_set("decade")).alias("d"))
    each = counties.join(got, counties["county"] == F.col("county_geoid"), "left").withColumn("d", F.coalesce("d", F.array().cast("array<int>")))
    have = F.when(F.size("d") == 0, "none").otherwise(F.concat(F.lit("["), F.array_join("d", ", "), F.lit("]")))
    said = F.array(
        F.when(F.size("d") < 2, F.concat(F.lit("needs two decades of status ready batches, has "), have)),
        F.when(~F.exists("d", lambda x: x < 2000), F.lit("no status ready batch in a decade before 2000")),
        F.when(~F.exists("d", lambda x: x >= 2000), F.lit("no status ready batch in a decade from 2000 onward")),
    )
    lacks = each.select("county", F.explode(F.filter(said, lambda m: m.isNotNull())).alias("_m"))
    return failures(lacks, "release", F.concat(F.lit("county "), F.col("county")), F.col("_m"))


def reasons(df: DataFrame, problems: dict[str, Column]) -> Column:
    """What is wrong with a row, joined; empty if nothing is."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(m)) for m, c in problems.items())), lambda m: m.isNotNull()), "; ")


def _backed(batches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Batches that name a resolved, evidenced review of their own county, decade and area."""
    located = F.trim(F.coalesce("evidence_locator", F.lit(""))) != ""
    good = reviews.where("dating = 'resolved' AND foot_trail_evidence = 'yes'").where(located).select(
        F.col("review_id").alias("_rid"), F.col("county_geoid").alias("_rc"), F.col("decade").alias("_rd"), F.col("area_id").alias("_ra")
    )
    backed = batches.select("*", F.explode("review_ids").alias("_id")).join(good, (F.col("_id") == F.col("_rid")) & (F.col("county_geoid") == F.col("_rc")) & (F.col("decade") == F.col("_rd")))
    return backed.where(F.array_contains("area_ids", F.col("_ra"))).select("batch_id").distinct()


def qualifying_batches(batches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Ready batches without a failure of their own."""
    bad = batch_failures(batches, reviews).select(F.col("record").alias("batch_id"))
    return batches.where("status = 'ready'").join(bad, "batch_id", "left_anti")


def batch_failures(batches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Lifecycle rules, and ready batches without a resolved, evidenced review of their own."""
    bad = reasons(
        batches,
        {
            "digitized is not accepted yet": F.col("status") == "digitized",
            "alignment_ids must be empty": F.size("alignment_ids") > 0,
            "ready needs tasks": (F.col("status") == "ready") & (F.size("tasks") == 0),
            "ready needs sources": (F.col("status") == "ready") & (F.size("source_refs") == 0),
        },
    )
    rules = failures(batches.withColumn("_m", bad).where("_m <> ''"), "batch", F.col("batch_id"), F.col("_m"))
    bare = batches.where("status = 'ready'").join(_backed(batches, reviews), "batch_id", "left_anti")
    return rules.unionByName(failures(bare, "batch", F.col("batch_id"), F.lit("ready without a resolved review")))
