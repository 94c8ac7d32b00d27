"""Connected components over an edge table, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import remove, save


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the least id reachable, for every id in ``a`` or ``b``.

    Labels move to neighbours as minima, which are combined before the shuffle,
    and each label is then replaced by its own label, so that chains halve.
    """
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("comp").alias("near"))
        least = labels.join(near, F.col("id") == F.col("b"), "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("comp").alias("above"))
        step = save(least.join(up, "new", "left").select("id", "old", F.least("new", "above").alias("comp")), "labels")
        changed = step.where("comp <> old").limit(1).count()
        remove(labels)
        labels = step
        if not changed:
            remove(both)
            return labels.select("id", "comp")
