"""URL filter: rules first, then logistic regression on hashed n-grams (operator 7).

Host and path are cut by expressions. The longest rule that fits decides; where
none fits, a logistic regression over hashed character n-grams of host and path
does. Features are hashed by Spark both when training and when judging; the
small labelled table is fitted on the driver, and the weights, whose number is
fixed, are a constant array in the plan.

Cases: a null url or one without ``://`` has an empty host and path, no rule,
and the verdict of the intercept; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, aside, read, restored

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Labelled hosts and paths: 1 is to be blocked.
LABELLED = [
    (1, "casino-bonus.example.com", "/slots/free-spins"), (1, "cheap-pills.example.org", "/buy/online-pharmacy"),
    (1, "win-big.bet.example.com", "/casino/jackpot"), (1, "xxx-tube.example.org", "/adult/videos"),
    (1, "hot-singles.example.com", "/dating/xxx"), (1, "free-movies.example.org", "/download/torrent/crack"),
    (1, "warez.example.com", "/keygen/serial-crack"), (1, "poker-online.example.org", "/bet/poker-bonus"),
    (1, "payday-loans.example.com", "/loan/instant-cash"), (1, "replica-watches.example.org", "/buy/cheap-replica"),
    (1, "porn-hd.example.com", "/adult/porn/1"), (1, "slots777.example.org", "/casino/slots777"),
    (1, "click-ads.example.com", "/redirect/popup-ads"), (1, "seo-links.example.org", "/buy-backlinks/cheap"),
    (1, "miracle-diet.example.com", "/weight-loss/pills"), (1, "crypto-double.example.org", "/earn/bitcoin-bonus"),
    (0, "www.example.org", "/en/1234"), (0, "blog.example.com", "/en/2024/report"),
    (0, "docs.example.org", "/manual/install.html"), (0, "news.example.com", "/world/article/551"),
    (0, "m.example.org", "/de/20331"), (0, "library.example.com", "/catalog/history/maps"),
    (0, "www.example.com", "/fr/8812/"), (0, "university.example.org", "/department/geography"),
    (0, "wiki.example.org", "/es/9943"), (0, "blog.example.org", "/en/30125.html"),
    (0, "museum.example.com", "/collection/item/77"), (0, "www.example.org", "/de/4410/"),
    (0, "science.example.com", "/journal/volume-3/paper-12"), (0, "school.example.org", "/courses/algebra"),
    (0, "m.example.com", "/es/15221"), (0, "city.example.org", "/council/minutes/2023"),
]
BUCKETS = 4096
SIZES = (3, 4, 5)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_p_url, instr(_p_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    name, say = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        say = F.when(fits, F.lit(verdict)).otherwise(say)
    return name, say


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets, 1..n, of the n-grams of the host and of the path."""
    def grams(text: Column, n: int, seed: int) -> Column:
        spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.substr(text, i, F.lit(n))), F.lit(buckets)) + 1).cast("int"))

    ends = [F.concat(F.lit("^"), part, F.lit("$")) for part in (host, path)]
    return F.concat(*(grams(text, n, seed) for seed, text in enumerate(ends) for n in SIZES))


def train(spark: SparkSession, labelled: list[tuple[int, str, str]] = LABELLED, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights by bucket and intercept, by gradient descent on the small table."""
    table = spark.createDataFrame([(y, h, p) for y, h, p in labelled], "y int, host string, path string")
    rows = [(r.y, r.f) for r in table.select("y", features(F.col("host"), F.col("path")).alias("f")).collect()]
    weights, bias = [0.0] * (BUCKETS + 1), 0.0
    for _ in range(rounds):
        step: dict[int, float] = {}
        shift = 0.0
        for y, f in rows:
            z = bias + sum(weights[k] for k in f) / math.sqrt(len(f))
            error = y - 1 / (1 + math.exp(-z))
            shift += error
            for k in f:
                step[k] = step.get(k, 0.0) + error / math.sqrt(len(f))
        bias += rate * shift / len(rows)
        for k, g in step.items():
            weights[k] += rate * (g - ridge * weights[k])
    return weights[1:], bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``."""
    weights, bias = model
    pages, names = aside(pages)
    df = pages.withColumn("_p_url", pages[{c: new for new, c in names.items()}.get(url, url)].cast("string"))
    host, path = host_path(F.col("_p_url"))
    df = df.withColumns({"host": host, "path": path})
    name, say = rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": name, "_p_say": say, "_p_f": features(F.col("host"), F.col("path"))})
    table = F.from_json(F.lit("[" + ",".join(f"{w:.6g}" for w in weights) + "]"), "array<double>")
    total = F.aggregate(F.transform("_p_f", lambda k: F.element_at(table, k)), F.lit(0.0), lambda a, x: a + x)
    z = total / F.sqrt(F.greatest(F.size("_p_f"), F.lit(1))) + F.lit(bias)
    df = df.withColumn("score", 1 / (1 + F.exp(-z)))
    out = df.withColumn("verdict", F.coalesce("_p_say", F.when(F.col("score") >= threshold, "block").otherwise("allow")))
    return restored(out.drop("_p_url", "_p_say", "_p_f"), names)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(spark)).select("page_id", "host", "path", "rule", "verdict")
