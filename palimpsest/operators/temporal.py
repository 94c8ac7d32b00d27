"""Decade states: what dated evidence says about each (subject, decade).

Evidence has a role: existence and public use are positive, closure closes, all
else is ignored. A range resolves to a decade if it lies inside it, and crosses
if it meets two. Choices where the rules leave one: a bracket broken by a
crossing range is ``date_range_unresolved``; the nearest positives on either
side bracket; a closure on a bracketing day is between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import bound, decade

# The roles that open a decade and the one that closes it.
POSITIVE = ["attests_existence", "attests_public_use"]
CLOSING = "attests_closure"


def ranges(evidence: DataFrame) -> DataFrame:
    """Rows (subject, role, date_start, date_end) with lo, hi, and what they are."""
    df = evidence.withColumns({"lo": bound(F.col("date_start")), "hi": bound(F.coalesce("date_end", "date_start"), upper=True)})
    sign = F.when(F.col("role").isin(*POSITIVE), "open").when(F.col("role") == CLOSING, "closed")
    df = df.withColumns({"sign": sign, "first": decade(F.year("lo")), "last": decade(F.year("hi"))}).where("sign IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    return df.withColumn("crossing", F.col("first") != F.col("last"))


def decade_states(evidence: DataFrame, subjects: DataFrame, key: str = "subject") -> DataFrame:
    """``state`` and ``reason`` for each row (key, decade) of ``subjects``."""
    known = ranges(evidence).select(F.col(key).alias("_k"), "lo", "hi", "sign", "crossing", "first", "last")
    pairs = subjects.join(known, subjects[key] == F.col("_k"), "left")
    start, end = F.make_date(F.col("decade"), F.lit(1), F.lit(1)), F.make_date(F.col("decade") + 9, F.lit(12), F.lit(31))
    whole = ~F.col("crossing")
    here = whole & (F.col("first") == F.col("decade"))
    is_open, is_closed = F.col("sign") == "open", F.col("sign") == "closed"
    span = F.struct("lo", "hi")
    found = pairs.groupBy(*subjects.columns).agg(
        F.coalesce(F.bool_or(here & is_open), F.lit(False)).alias("open"),
        F.coalesce(F.bool_or(here & is_closed), F.lit(False)).alias("closed"),
        F.max_by(F.when(whole & is_open, span), F.when(whole & is_open & (F.col("hi") < start), F.struct("hi", "lo"))).alias("before"),
        F.min_by(F.when(whole & is_open, span), F.when(whole & is_open & (F.col("lo") > end), F.struct("lo", "hi"))).alias("after"),
        F.coalesce(F.bool_or(F.col("crossing") & (F.col("lo") <= end) & (F.col("hi") >= start)), F.lit(False)).alias("touched"),
    )
    again = found.join(known, found[key] == F.col("_k"), "left")
    between = (F.col("hi") >= F.col("before.lo")) & (F.col("lo") <= F.col("after.hi"))
    judged = again.groupBy(*subjects.columns, "open", "closed", "touched", F.col("before").isNotNull().alias("b"), F.col("after").isNotNull().alias("a")).agg(
        F.coalesce(F.bool_or(between & whole & is_closed), F.lit(False)).alias("shut"), F.coalesce(F.bool_or(between & F.col("crossing")), F.lit(False)).alias("blocked")
    )
    bracket = F.col("b") & F.col("a")

    def answer(state: str, reason: str):
        return F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))

    verdict = (
        F.when(F.col("open") & F.col("closed"), answer("unobserved", "conflicting_evidence"))
        .when(F.col("closed"), answer("documented_closed", "documented_evidence"))
        .when(F.col("open"), answer("documented_open", "documented_evidence"))
        .when(bracket & F.col("shut"), answer("unobserved", "closure_in_bracket"))
        .when(bracket & F.col("blocked"), answer("unobserved", "date_range_unresolved"))
        .when(bracket, answer("inferred_open", "inferred_between_observations"))
        .when(F.col("touched"), answer("unobserved", "date_range_unresolved"))
        .otherwise(answer("unobserved", "no_resolving_evidence"))
    )
    return judged.withColumn("_v", verdict).select(*subjects.columns, "_v.state", "_v.reason")


def temporal_failures(df: DataFrame, pairs: list[tuple[str, str]], record: str) -> DataFrame:
    """Dates that do not exist, and pairs in the wrong order, in one pass."""
    from palimpsest.functions.dates import calendar_ok, out_of_order
    from palimpsest.operators.integrity import failures

    fields = sorted({f for p in pairs for f in p})
    said = [F.when(calendar_ok(F.col(f)) == F.lit(False), F.concat(F.lit(f"{f} is not a real date: "), F.col(f))) for f in fields]
    said += [F.when(out_of_order(F.col(a), F.col(b)), F.concat(F.lit(f"{a} "), F.col(a), F.lit(f" is after {b} "), F.col(b))) for a, b in pairs]
    each = df.select(F.col(record).alias("_r"), F.explode(F.filter(F.array(*said), lambda m: m.isNotNull())).alias("_m"))
    return failures(each, "temporal", F.col("_r"), F.col("_m"))
