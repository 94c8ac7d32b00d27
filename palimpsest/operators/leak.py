"""Restricted values inside published contents: a substring join.

Each value is anchored by its longest inner token, so that values meet only contents
that hold the token; the substring test then confirms. Values without a token
are tested directly, and there are few of them by the check of their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"


def substring_join(contents: DataFrame, content: str, values: DataFrame, value: str, most_plain: int = 1000) -> DataFrame:
    """Rows of contents with each value that occurs in them.

    A token strictly inside a value stands whole in any content that holds the
    value; its longest inner token is the anchor.
    """
    values = values.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    parts = F.split(value, TOKEN)
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda t: t != "")
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    marked = values.withColumn("_anchor", longest)
    anchored, plain = marked.where("_anchor IS NOT NULL"), marked.where("_anchor IS NULL").drop("_anchor")
    # tokens travel with a hash of their row, which only picks candidates; texts are joined once, by that hash
    row = F.xxhash64(*contents.columns)
    tokens = contents.select(row.alias("_row"), F.explode(F.array_distinct(F.split(content, TOKEN))).alias("_anchor"))
    hits = tokens.join(anchored.select("_anchor").distinct(), "_anchor", "left_semi").distinct()
    found = contents.withColumn("_row", row).join(hits, "_row").join(anchored, "_anchor").where(F.contains(content, value)).drop("_row", "_anchor")
    if plain.limit(most_plain + 1).count() <= most_plain:
        plain = F.broadcast(plain)
    return found.unionByName(contents.join(plain, F.contains(content, value)).select(*found.columns))
