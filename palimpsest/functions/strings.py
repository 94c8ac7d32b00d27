"""Text functions: file names, percent codes, key-value runs, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of a scanned sheet's file name.
SHEET_NAME = r"(?i)^([A-Z]{2})_(.+)_(\d+)_(\d{4})_(\d+)_geo\.tif\z"


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sheet_parts(url: Column) -> Column:
    """State, name, scan, year and scale of a sheet's file name; null if it has another shape."""
    name = last_segment(url)
    get = lambda k: F.regexp_extract(name, SHEET_NAME, k)
    return F.when(name.rlike(SHEET_NAME), F.struct(get(1).alias("state"), F.translate(percent_decode(get(2)), "_", " ").alias("name"), get(3).alias("scan"), get(4).alias("year"), get(5).alias("scale")))


def percent_decode(text: Column) -> Column:
    """Percent codes only: a plus sign stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def kind_of(ref: Column) -> Column:
    return F.substring_index(ref, ":", 1)


def rest_of(ref: Column) -> Column:
    """What follows the first colon, else an empty text."""
    return F.when(F.instr(ref, ":") > 0, F.regexp_replace(ref, r"^[^:]*:", "")).otherwise(F.lit(""))


def run_value(run: Column, key: str) -> Column:
    """Last value of ``key`` in a run ``a: 1; b: 2``."""
    pairs = F.transform(F.split(run, ";"), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(rest_of(p)).alias("v")))
    return F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1))


def canonical(text: Column) -> Column:
    """For comparison: no NUL, bars or dot runs, single spaces, lower case."""
    t = F.regexp_replace(F.translate(text, "\0", ""), r"\||\.{2,}", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " ")))


def cleaned(text: Column) -> Column:
    """For display: no NUL, dot runs as an ellipsis, single spaces."""
    t = F.regexp_replace(F.translate(text, "\0", ""), r"\.{3,}", " ... ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


def segments(text: Column) -> Column:
    """Parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def all_printed(parts: Column, printed: Column) -> Column:
    return F.forall(parts, lambda s: F.contains(canonical(printed), canonical(s)))


def tile_path(edition: Column, z: Column, x: Column, y: Column) -> Column:
    return F.format_string("tiles/%s/%d/%d/%d.png", edition, z, x, y)


def scale_label(scale: Column) -> Column:
    return F.concat(F.lit("1:"), F.format_number(scale, 0))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def references(html: Column) -> Column:
    """Values of src and href attributes that point somewhere."""
    found = F.regexp_extract_all(html, F.lit(r'(?:src|href)="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda r: (r != "") & ~r.startswith("#") & ~r.startswith("data:"))


def absolute(ref: Column) -> Column:
    return ref.startswith("/") | F.contains(ref, F.lit("://"))


def without_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def datum_steps(operation: Column) -> Column:
    """Steps of a composed operation, without axis swaps; none for ``none ...``."""
    steps = F.filter(F.transform(F.split(operation, r" \+ "), lambda s: F.trim(s)), lambda s: ~F.contains(F.lower(s), F.lit("axis")))
    return F.when(operation.startswith("none "), F.array().cast("array<string>")).otherwise(steps)


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def retry_url(url: Column, times: Column) -> Column:
    return F.when(times > 0, F.concat(url, F.lit("?reload="), times.cast("string"))).otherwise(url)


def blank(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "") == ""


def listed(values: Column, sep: str = ", ") -> Column:
    return F.array_join(F.array_sort(values), sep)


def safe_path(path: Column) -> Column:
    """Relative, with no step up and no backslash."""
    parts = F.split(path, "/")
    return ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.array_contains(parts, "..") & ~F.array_contains(parts, "") & ~F.array_contains(parts, ".")


def holds_any(payload: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(payload), F.lower(t)))
