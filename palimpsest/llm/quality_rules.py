"""Quality rules as a learned decision list (operator 3).

Statistics of each text are Spark expressions. A bounded, hash-ordered sample
of labelled rows is collected as numbers; sequential covering grows one
conjunction of thresholds at a time on two thirds of it, prunes it on the last
third, removes what it covers and goes on. The list becomes a chain of
CASE WHEN conditions, so that judging is a projection.

Cases: null or wordless texts have zero statistics and fail the base; unlabelled
documents are judged like others; a null label or id is not learned from;
without labels of both kinds the list is empty and its default keeps; repeated
label rows count once, the worst label deciding; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import aside, read, restored, text_of

SPACE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics and a few more, all long, in place of columns of these names."""
    docs, names = aside(docs)
    t = text_of(docs, {c: new for new, c in names.items()}.get(text, text))
    df = docs.withColumn("_p_w", F.array_remove(F.split(t, SPACE), ""))
    grams = F.transform(F.sequence(F.lit(1), F.size("_p_w") - 2), lambda i: F.struct(F.xxhash64(F.slice("_p_w", i, F.lit(3))).alias("h"), i.alias("i")))
    df = df.withColumn("_p_g", F.when(F.size("_p_w") > 3, F.sort_array(grams)))
    again = F.expr(
        """array_sort(transform(filter(_p_g, (g, k) -> (k > 0 AND _p_g[k - 1].h = g.h) OR (k + 1 < size(_p_g) AND _p_g[k + 1].h = g.h)), g -> g.i))"""
    )
    df = df.withColumn("_p_r", F.when(F.size("_p_w") > 3, again))
    covered = F.expr("aggregate(_p_r, struct(0L AS n, -9 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns(
        {
            "n_words": F.size("_p_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
            "n_marks": F.length(F.regexp_replace(t, r"[^!?;:_=~^+/\\@]+", "")).cast("long"),
            "n_digits": F.length(F.regexp_replace(t, r"[^0-9]+", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_p_w")).cast("long"),
        }
    ).drop("_p_w", "_p_g", "_p_r")
    return restored(out, names)


# Ratios that the rules speak about, as SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "dup_lines": "double(n_dup_lines)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ``<=`` or ``>``, threshold) and its verdict."""

    tests: tuple[tuple[str, str, float], ...]
    keep: bool
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.tests)


def _covers(tests, row: dict) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in tests)


def _precision(rows: list[tuple[dict, int]], target: int) -> float:
    hit = sum(y == target for _, y in rows)
    return (hit + 1) / (len(rows) + 2)


def _grow(rows: list[tuple[dict, int]], target: int, most_tests: int, cuts: int, least: int) -> tuple:
    tests: tuple = ()
    while len(tests) < most_tests and any(y != target for _, y in rows):
        best, total, hits = None, len(rows), sum(y == target for _, y in rows)
        for f in FEATURES:
            order = sorted((x[f], y == target) for x, y in rows)
            prefix, n = [0], 0
            for _, y in order:
                n += y
                prefix.append(n)
            step = max(1, total // cuts)
            edges = {k for k in range(step, total, step)} | {k for k in range(1, total) if order[k - 1][1] != order[k][1] and total <= 64 * cuts}
            for k in edges:
                a, b = order[k - 1][0], order[k][0]
                if a == b:
                    continue
                for op, n_in, n_hit in (("<=", k, prefix[k]), (">", total - k, hits - prefix[k])):
                    if n_in >= least and n_hit:
                        # information gain of the rule, as in FOIL
                        gain = n_hit * ((n_hit + 1) / (n_in + 2) / ((hits + 1) / (total + 2)) - 1)
                        if best is None or gain > best[0]:
                            best = (gain, (f, op, (a + b) / 2))
        if best is None or best[0] <= 1e-9:
            break
        tests += (best[1],)
        rows = [r for r in rows if _covers(tests[-1:], r[0])]
    return tests


def learn(rows: list[tuple[dict, int]], most_rules: int = 8, most_tests: int = 3, cuts: int = 64, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Ordered rules for label 0; what no rule covers is kept.

    ``rows`` are (features, label) with label 1 for good documents. A rule stays
    if its precision on rows it was not grown on reaches ``precision``.
    """
    rules: list[Rule] = []
    grow_on = [r for k, r in enumerate(rows) if k % 3]
    prune_on = [r for k, r in enumerate(rows) if not k % 3]
    while len(rules) < most_rules and any(y == 0 for _, y in grow_on):
        tests = _grow(grow_on, 0, most_tests, cuts, least)
        if not tests:
            break

        def worth(t: tuple) -> float:
            got = [r for r in prune_on if _covers(t, r[0])]
            return _precision(got, 0) if got else 0.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        both = [r for r in grow_on + prune_on if _covers(tests, r[0])]
        if _precision(both, 0) < precision or (len(prune_on) > 30 and worth(tests) < precision - 0.1):
            break
        rules.append(Rule(tests, False, _precision(both, 0), len(both)))
        grow_on = [r for r in grow_on if not _covers(tests, r[0])]
        prune_on = [r for r in prune_on if not _covers(tests, r[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the statistics."""
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {str(r.keep).lower()}" for r in rules) + " ELSE true END") if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 12_000) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, the first by hash of id."""
    chosen = (
        labels.select(labels[key].cast("long").alias("_p_key"), labels[label].cast("int").alias("_p_y"))
        .dropna()
        .groupBy("_p_key")
        .agg(F.min("_p_y").alias("_p_y"))
        .orderBy(F.xxhash64("_p_key"), "_p_key")
        .limit(sample)
    )
    few = docs.select(docs[key].cast("long").alias("_p_key"), docs[text].alias("text")).join(F.broadcast(chosen), "_p_key")
    got = statistics(few).select("_p_key", "_p_y", "n_words", "n_repeat_words", *(F.expr(e).alias(f"f_{n}") for n, e in FEATURES.items()))
    rows = got.orderBy(F.xxhash64("_p_key"), "_p_key", "f_words", "f_word_length").collect()  # bounded by the sample
    return learn([({n: r[f"f_{n}"] for n in FEATURES}, r["_p_y"]) for r in rows if not _base_failed(r["n_words"], r["n_repeat_words"])])


def _base_failed(n_words, n_repeat):
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    out = statistics(docs, text).withColumn("base_failed", _base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *BASE, "base_failed", "kept")
