"""Queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates as D
from palimpsest.functions import maths as M
from palimpsest.functions import strings as S
from palimpsest.operators import coverage as C
from palimpsest.operators import integrity as I
from palimpsest.operators import ledger as L
from palimpsest.operators.constraints import check_rows
from palimpsest.operators.leak import substring_join
from palimpsest.operators.raster import phase_correlation
from palimpsest.operators.spatial import box_join, clipped_area, common_box, fit_affine, ring_holds
from palimpsest.operators.temporal import decade_states
from palimpsest.plans import index as X
from palimpsest.plans.publish import card, neighbours

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_orders(t) -> DataFrame:
    return I.orphans(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    """SELECT 'references' AS "check", CAST(l_orderkey AS VARCHAR) AS record, 'unknown l_partkey ''' || l_partkey || '''' AS message FROM lineitem l
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)
       UNION ALL SELECT 'references', CAST(l_orderkey AS VARCHAR), 'unknown l_suppkey ''' || l_suppkey || '''' FROM lineitem l
       WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)"""
)
def fk_unknown(t) -> DataFrame:
    li = t("lineitem")
    return I.union_failures(
        I.missing_target(li, "l_partkey", t("part").where("p_size <= 40"), "p_partkey", "references", "l_orderkey"),
        I.missing_target(li, "l_suppkey", t("supplier").where("s_acctbal > 0"), "s_suppkey", "references", "l_orderkey"),
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey = c_nationkey")
def self_reference(t) -> DataFrame:
    return I.self_reference(t("customer"), "c_custkey", "c_nationkey", "references").select(F.col("record").cast("long").alias("c_custkey"))


@query(
    """SELECT event_id, user_id, event_type, rn AS occurrence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INT) AS rn FROM events) WHERE rn > 1"""
)
def first_duplicate(t) -> DataFrame:
    return I.first_duplicate(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "occurrence")


@query("SELECT l_partkey FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1")
def listed_duplicates(t) -> DataFrame:
    return I.listed_duplicates(t("lineitem"), "l_partkey")


@query(
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'part:' || l_partkey ELSE 'supp:' || l_suppkey END AS ref FROM lineitem)
       SELECT 'references' AS "check", CAST(l_orderkey AS VARCHAR) AS record, 'unknown source ''' || ref || '''' AS message FROM r
       WHERE (split_part(ref, ':', 1) = 'part' AND NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 40 AND CAST(p_partkey AS VARCHAR) = split_part(ref, ':', 2)))
          OR (split_part(ref, ':', 1) = 'supp' AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 0 AND CAST(s_suppkey AS VARCHAR) = split_part(ref, ':', 2)))"""
)
def polymorphic_fk(t) -> DataFrame:
    ref = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("part:"), F.col("l_partkey"))).otherwise(F.concat(F.lit("supp:"), F.col("l_suppkey")))
    targets = {"part": (t("part").where("p_size <= 40"), "p_partkey"), "supp": (t("supplier").where("s_acctbal > 0"), "s_suppkey")}
    return I.polymorphic_target(t("lineitem").select("l_orderkey", ref.alias("ref")), "ref", targets, "references", "l_orderkey")


@query(
    """SELECT 'references' AS "check", CAST(l_orderkey AS VARCHAR) AS record, 'parts names unknown ''' || l_partkey || '''' AS message
       FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 45)"""
)
def array_fk(t) -> DataFrame:
    orders = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return I.array_target(orders, "parts", t("part").where("p_size <= 45"), "p_partkey", "references", "l_orderkey")


@query(
    """SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"""
)
def containment(t) -> DataFrame:
    have = t("customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").groupBy(F.lit(1).alias("one")).agg(F.collect_set("c_nationkey").alias("nations"))
    found = I.not_contained(t("supplier").withColumn("one_key", F.lit(1)), "s_nationkey", "one_key", have, "one", "nations", "references", "s_suppkey")
    return found.select(F.col("record").cast("long").alias("s_suppkey"))


_DATE = "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(
    f"""SELECT o_orderkey, v, CASE WHEN length(v) = 4 THEN CAST(v || '-01-01' AS DATE) ELSE CAST(v AS DATE) END AS lo,
        CASE WHEN length(v) = 4 THEN CAST(v || '-12-31' AS DATE) ELSE CAST(v AS DATE) END AS hi FROM (SELECT o_orderkey, {_DATE} AS v FROM orders)"""
)
def partial_date_bounds(t) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", v.alias("v")).withColumns({"lo": D.bound(F.col("v")), "hi": D.bound(F.col("v"), upper=True)})


@query(
    """WITH s AS (SELECT c_nationkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
       SELECT c_nationkey, CAST(unnest(range(a // 10 * 10, b // 10 * 10 + 1, 10)) AS INT) AS decade FROM s"""
)
def decade_sequence(t) -> DataFrame:
    spans = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return spans.select("c_nationkey", F.explode(D.decades(F.col("a"), F.col("b"))).alias("decade"))


_MONTH = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)"


@query(
    f"""WITH m AS (SELECT DISTINCT {_MONTH} AS month FROM orders),
        seen AS (SELECT DISTINCT c_nationkey AS n_nationkey, {_MONTH} AS month FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 300000)
        SELECT n_nationkey, month FROM nation CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.n_nationkey = nation.n_nationkey AND s.month = m.month)"""
)
def spine_missing(t) -> DataFrame:
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month")
    full = C.spine(t("nation").select("n_nationkey"), t("orders").select(month).distinct())
    seen = t("orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), month).distinct()
    return C.spine_problems(full, seen, ["n_nationkey", "month"]).where("side = 'missing'").drop("side")


_COUNTS = """count(*) AS orders, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderstatus = 'P') AS status_p,
 count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o"""
_COUNTERS = {
    "orders": F.lit,
    "large": lambda _: F.col("o_totalprice") > 200000,
    "status_p": lambda _: F.col("o_orderstatus") == "P",
    "status_f": lambda _: F.col("o_orderstatus") == "F",
    "status_o": lambda _: F.col("o_orderstatus") == "O",
}


def _cube(t) -> DataFrame:
    facts = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate"))
    full = C.spine(t("nation").select(F.col("n_nationkey").alias("c_nationkey")), t("orders").select(F.year("o_orderdate").alias("y")).distinct())
    return C.cube(facts, ["c_nationkey", "y"], {k: f(True) for k, f in _COUNTERS.items()}, full)


@query(
    f"""WITH s AS (SELECT n_nationkey AS c_nationkey, y FROM nation CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders)),
        f AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS y, {_COUNTS} FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        SELECT s.c_nationkey, s.y, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTERS)} FROM s LEFT JOIN f USING (c_nationkey, y)"""
)
def coverage_cube(t) -> DataFrame:
    return _cube(t)


@query(
    f"""WITH f AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS y, {_COUNTS} FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        SELECT c_nationkey, y, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNTERS)} FROM f GROUP BY GROUPING SETS ((c_nationkey, y), (c_nationkey))"""
)
def coverage_rollup(t) -> DataFrame:
    facts = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate"))
    counts = C.cube(facts, ["c_nationkey", "y"], {k: f(True) for k, f in _COUNTERS.items()})
    return C.rollup(counts, "c_nationkey", "y", list(_COUNTERS))


@query(
    """SELECT event_type AS member, count(*) AS n, count(*) FILTER (k > 1) AS n_shared FROM (SELECT DISTINCT user_id, event_type FROM events)
       JOIN (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1) USING (user_id) GROUP BY 1"""
)
def shared_membership(t) -> DataFrame:
    return C.membership(t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("types")), "types")


@query(
    """WITH a AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, p_retailprice AS s, p_size + 1.5 AS e, p_retailprice + 0.75 AS n FROM part),
       g AS (SELECT CAST(i AS DOUBLE) AS w, 900.0 + j * 2 AS s, i + 5.0 AS e, 902.0 + j * 2 AS n, i * 1000 + j AS cell FROM (SELECT unnest(range(0, 55, 5)) AS i), (SELECT unnest(range(0, 51)) AS j))
       SELECT p_partkey, CAST(cell AS BIGINT) AS cell FROM a JOIN g ON least(a.e, g.e) > greatest(a.w, g.w) AND least(a.n, g.n) > greatest(a.s, g.s)"""
)
def range_join_bbox(t) -> DataFrame:
    part = t("part")
    boxes = part.select("p_partkey", F.col("p_size").cast("double").alias("west"), F.col("p_retailprice").alias("south"), (F.col("p_size") + 1.5).cast("double").alias("east"), (F.col("p_retailprice") + 0.75).alias("north"))
    spark = part.sparkSession
    cells = spark.range(11).select((F.col("id") * 5).alias("i")).crossJoin(spark.range(51).select(F.col("id").alias("j")))
    cells = cells.select(F.col("i").cast("double").alias("west"), (F.lit(900.0) + F.col("j") * 2).alias("south"), (F.col("i") + 5.0).cast("double").alias("east"), (F.lit(902.0) + F.col("j") * 2).alias("north"), (F.col("i") * 1000 + F.col("j")).alias("cell"))
    return box_join(boxes, cells, 5.0, 2.0).select("p_partkey", "cell")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS record FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""
)
def existential_gap(t) -> DataFrame:
    back = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return I.lacking(t("orders").where("o_orderstatus = 'F'"), back, F.col("o_orderkey") == F.col("l_orderkey"), "gap", "o_orderkey", "no return").select("record")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY 1")
def ref_sets(t) -> DataFrame:
    refs = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return refs.select("l_orderkey", F.concat_ws(",", F.transform("s", lambda x: x.cast("string"))).alias("suppliers"))


@query(
    """SELECT p_size, count(*) AS sheets, CAST(sum(try_cast(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS BIGINT)) AS BIGINT) AS total,
       min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY GROUPING SETS ((p_size), ())"""
)
def scale_summary(t) -> DataFrame:
    text = F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_partkey").cast("string"))
    return t("part").withColumn("size_text", text).groupingSets([["p_size"], []], "p_size").agg(F.count("*").alias("sheets"), X.guarded_sum(F.col("size_text")).alias("total"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"))


@query(
    """WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1950 + o_orderkey % 60 AS VARCHAR) END AS b FROM orders)
       SELECT o_orderkey, greatest(try_cast(nullif(a, '') AS INT), try_cast(b AS INT)) AS latest FROM y"""
)
def row_max_years(t) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy"))
    b = F.when(F.col("o_orderkey") % 5 != 0, (F.lit(1950) + F.col("o_orderkey") % 60).cast("string"))
    return t("orders").select("o_orderkey", X.latest_year(a, b).alias("latest"))


@query(
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'wrong segment' END, CASE WHEN c_nationkey < 3 THEN 'far away' END) AS problems FROM customer"""
)
def problem_reasons(t) -> DataFrame:
    df = t("customer")
    return df.select("c_custkey", C.reasons(df, {"in debt": F.col("c_acctbal") < 0, "wrong segment": F.col("c_mktsegment") == "MACHINERY", "far away": F.col("c_nationkey") < 3}).alias("problems"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top1_area(t) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return t("orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query(
    """SELECT conv_id, turn, lag(turn) OVER w AS previous_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"""
)
def paging_neighbors(t) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ranked = t("conversations").withColumn("_n", F.row_number().over(w))
    return neighbours(ranked, "turn", "_n", ["conv_id"]).select("conv_id", "turn", "previous_id", "next_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_contamination(t) -> DataFrame:
    return substring_join(t("documents").select("doc_id", "text"), "text", t("benchmark").select("item_id", F.col("text").alias("value")), "value").select("doc_id", "item_id")


@query(
    """SELECT page_id, ref, starts_with(ref, '/') OR contains(ref, '://') AS is_absolute FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:src|href)="([^"]*)"', 1)) AS ref FROM pages)
       WHERE ref <> '' AND NOT starts_with(ref, '#') AND NOT starts_with(ref, 'data:')"""
)
def href_audit(t) -> DataFrame:
    return t("pages").select("page_id", F.explode(S.references(F.col("html"))).alias("ref")).withColumn("is_absolute", S.absolute(F.col("ref")))


@query(
    r"""SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\||\.{2,}', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS digest FROM documents"""
)
def canon_text(t) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(S.canonical(F.col("text")), 256).alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def kv_run(t) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    """SELECT c_nationkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT c_nationkey, c_custkey || ' ' || c_name AS line FROM customer) GROUP BY 1"""
)
def digest(t) -> DataFrame:
    return L.digest_of_lines(t("customer"), ["c_nationkey"], F.concat_ws(" ", "c_custkey", "c_name"))


_LON, _LAT = "(-179.3 + (c_custkey * 37) % 358)", "(-79.7 + (c_custkey * 53) % 159)"


@query(
    f"""SELECT c_custkey, CAST(z AS INT) AS z, CAST(floor((radians({_LON}) / pi() + 1) / 2 * pow(2, z)) AS BIGINT) AS x,
        CAST(floor((1 - ln(tan(pi() / 4 + radians({_LAT}) / 2)) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y FROM customer, (SELECT unnest([4, 8, 12]) AS z)"""
)
def xyz_tiles(t) -> DataFrame:
    lon, lat = F.lit(-179.3) + (F.col("c_custkey") * 37) % 358, F.lit(-79.7) + (F.col("c_custkey") * 53) % 159
    rows = t("customer").select("c_custkey", F.explode(F.array(F.lit(4), F.lit(8), F.lit(12))).alias("z"), lon.alias("lon"), lat.alias("lat"))
    x, y = M.tile_of(F.col("lon"), F.col("lat"), F.col("z"))
    return rows.select("c_custkey", "z", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey, CAST(ceil(log2(2 * pi() * 6378137.0 * cos(radians(39.1)) / 256 / (p_size / 7.3))) AS BIGINT) AS zoom FROM part")
def native_zoom(t) -> DataFrame:
    return t("part").select("p_partkey", M.native_max_zoom(F.col("p_size") / 7.3, F.lit(39.1)).alias("zoom"))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING min(props) <> max(props)")
def ledger_conflicts(t) -> DataFrame:
    return L.conflicts(t("events"), ["user_id", "event_type"], "props")


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def ledger_latest(t) -> DataFrame:
    return L.latest(t("events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(
    """SELECT 'schema' AS "check", CAST(p_partkey AS VARCHAR) AS record, m AS message FROM (
         SELECT p_partkey, unnest(list_filter([CASE WHEN p_size NOT BETWEEN 1 AND 45 THEN 'p_size: range (1, 45)' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'p_brand: enum [''Brand#11'', ''Brand#12'', ''Brand#13'']' END,
           CASE WHEN p_size % 10 <> 0 THEN 'p_size: multiple_of 10' END], lambda x: x IS NOT NULL)) AS m FROM part)"""
)
def row_constraints(t) -> DataFrame:
    return check_rows(t("part"), [("p_size", "range", (1, 45)), ("p_brand", "enum", ["Brand#11", "Brand#12", "Brand#13"]), ("p_size", "multiple_of", 10)], "p_partkey")


@query(
    """WITH b AS (SELECT p_brand, max(CAST(p_size AS DOUBLE) - 60) AS west, max(p_retailprice - 90) AS south, min(p_size + 60.0) AS east, min(p_retailprice + 90) AS north FROM part GROUP BY 1)
       SELECT p_brand, CAST(west AS DOUBLE) AS west, south, CAST(east AS DOUBLE) AS east, north FROM b WHERE west < east AND south < north"""
)
def common_footprint(t) -> DataFrame:
    boxes = t("part").select("p_brand", (F.col("p_size") - 60).cast("double").alias("west"), (F.col("p_retailprice") - 90).alias("south"), (F.col("p_size") + 60).cast("double").alias("east"), (F.col("p_retailprice") + 90).alias("north"))
    return common_box(boxes, ["p_brand"]).where("west IS NOT NULL")


@query(
    """WITH j AS (SELECT o_orderkey, l_orderkey IS NOT NULL AS has, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
       SELECT o_orderkey, CASE WHEN NOT has THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'verified' END AS status FROM j"""
)
def exactly_one(t) -> DataFrame:
    return I.exactly_one(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").select("o_orderkey", "status")


@query(
    """(SELECT s_nationkey AS k, 'left' AS side FROM supplier EXCEPT SELECT c_nationkey, 'left' FROM customer WHERE c_acctbal < -900)
       UNION ALL (SELECT c_nationkey, 'right' FROM customer WHERE c_acctbal < -900 EXCEPT SELECT s_nationkey, 'right' FROM supplier)"""
)
def set_difference(t) -> DataFrame:
    return I.set_difference(t("supplier").select(F.col("s_nationkey").alias("k")), t("customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("k")))


@query(
    """SELECT s_suppkey, position, label, value FROM (SELECT s_suppkey, CAST(unnest(range(len(r))) AS INT) AS position, unnest(r).l AS label, unnest(r).v AS value FROM (
         SELECT s_suppkey, list_filter([{'l': 'Name', 'v': s_name}, {'l': 'Nation', 'v': CASE WHEN s_nationkey > 4 THEN CAST(s_nationkey AS VARCHAR) END}, {'l': 'Key', 'v': CAST(s_suppkey AS VARCHAR)}], lambda x: x.v IS NOT NULL) AS r FROM supplier))"""
)
def source_card(t) -> DataFrame:
    return card(t("supplier"), "s_suppkey", {"Name": F.col("s_name"), "Nation": F.when(F.col("s_nationkey") > 4, F.col("s_nationkey")), "Key": F.col("s_suppkey")})


_ROLE = "CASE WHEN event_type = 'error' THEN 'attests_closure' WHEN event_id % 3 = 0 AND event_type = 'view' THEN 'attests_existence' WHEN event_id % 3 = 0 AND event_type = 'purchase' THEN 'attests_public_use' WHEN event_id % 3 = 0 THEN 'attests_alignment' ELSE 'attests_name' END"


@query(
    f"""WITH ev AS (SELECT user_id AS subject, {_ROLE} AS role, 1950 + CAST((event_id * 7919) % 80 AS INT) AS y1, 1950 + CAST((event_id * 7919) % 80 AS INT) + CAST(event_id % 4 AS INT) AS y2 FROM events),
        r AS (SELECT subject, CASE WHEN role = 'attests_closure' THEN 'closed' ELSE 'open' END AS sign, make_date(y1, 1, 1) AS lo, make_date(y2, 12, 31) AS hi, y1 // 10 * 10 AS fd, y2 // 10 * 10 AS ld FROM ev WHERE role NOT IN ('attests_alignment', 'attests_name')),
        p AS (SELECT subject, d AS decade FROM (SELECT DISTINCT user_id AS subject FROM events), (SELECT CAST(unnest(range(1950, 2040, 10)) AS INT) AS d)),
        f AS (SELECT p.subject, p.decade, coalesce(bool_or(fd = ld AND fd = decade AND sign = 'open'), false) AS o, coalesce(bool_or(fd = ld AND fd = decade AND sign = 'closed'), false) AS c,
              max({{'hi': hi, 'lo': lo}}) FILTER (fd = ld AND sign = 'open' AND hi < make_date(decade, 1, 1)) AS bef, min({{'lo': lo, 'hi': hi}}) FILTER (fd = ld AND sign = 'open' AND lo > make_date(decade + 9, 12, 31)) AS aft,
              coalesce(bool_or(fd <> ld AND lo <= make_date(decade + 9, 12, 31) AND hi >= make_date(decade, 1, 1)), false) AS touched FROM p LEFT JOIN r USING (subject) GROUP BY 1, 2),
        g AS (SELECT f.subject, f.decade, o, c, touched, bef IS NOT NULL AND aft IS NOT NULL AS b,
              coalesce(bool_or(hi >= bef.lo AND lo <= aft.hi AND fd = ld AND sign = 'closed'), false) AS shut, coalesce(bool_or(hi >= bef.lo AND lo <= aft.hi AND fd <> ld), false) AS blocked
              FROM f LEFT JOIN r USING (subject) GROUP BY ALL),
        v AS (SELECT subject, decade, CASE WHEN o AND c THEN 'unobserved conflicting_evidence' WHEN c THEN 'documented_closed documented_evidence' WHEN o THEN 'documented_open documented_evidence'
              WHEN b AND shut THEN 'unobserved closure_in_bracket' WHEN b AND blocked THEN 'unobserved date_range_unresolved' WHEN b THEN 'inferred_open inferred_between_observations'
              WHEN touched THEN 'unobserved date_range_unresolved' ELSE 'unobserved no_resolving_evidence' END AS s FROM g)
        SELECT subject, decade, split_part(s, ' ', 1) AS state, split_part(s, ' ', 2) AS reason FROM v"""
)
def decade_state(t) -> DataFrame:
    y = F.lit(1950) + (F.col("event_id") * 7919) % 80
    ev = t("events").select(F.col("user_id").alias("subject"), F.expr(_ROLE).alias("role"), y.cast("string").alias("date_start"), (y + F.col("event_id") % 4).cast("string").alias("date_end"))
    subjects = t("events").select(F.col("user_id").alias("subject")).distinct().withColumn("decade", F.explode(F.sequence(F.lit(1950), F.lit(2030), F.lit(10))))
    return decade_states(ev, subjects)


@query(
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
)
def hourly_counts(t) -> DataFrame:
    from palimpsest.streaming.session import windowed_counts

    return windowed_counts(t("events"))


@query()
def session_state(t) -> DataFrame:
    from palimpsest.streaming.session import replay

    kinds = ["select", "idle", "movestart", "error", "next", "retry", "previous", "reset"]
    names = ["e1", "e2", "e3", "e4"]
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    df = t("events").select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_id").alias("seq"),
        pick(kinds, F.abs(F.hash("event_id"))).alias("type"),
        pick(names, F.abs(F.hash("event_id", "user_id"))).alias("edition_id"),
        F.lit(None).cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("message"),
        F.lit(True).alias("source_loaded"),
    )
    return replay(df, names)


@query()
def phase_shift(t) -> DataFrame:
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    turned = F.concat(F.slice("a", 17, 48), F.slice("a", 1, 16))
    return e.select("vec_id", phase_correlation("a", turned).alias("s")).select("vec_id", F.round("s.dy", 6).alias("dy"), F.round("s.dx", 6).alias("dx"), F.round("s.ratio", 6).alias("ratio"))


@query("SELECT p_partkey, round(CAST(greatest(0, least(p_size + 6, 40) - greatest(p_size, 10)) AS DOUBLE) * 4, 6) AS area FROM part")
def clip_area(t) -> DataFrame:
    x = F.col("p_size").cast("double")
    ring = F.array(*(F.array(a, b) for a, b in ((x, F.lit(-1.0)), (x + 6, F.lit(-1.0)), (x + 6, F.lit(9.0)), (x, F.lit(9.0)), (x, F.lit(-1.0)))))
    return t("part").select("p_partkey", F.round(clipped_area(ring, F.lit(10.0), F.lit(2.0), F.lit(40.0), F.lit(6.0)), 6).alias("area"))


@query("SELECT p_partkey, abs(p_size - 25.25) + abs(p_retailprice - 950.125) < 20 AS inside FROM part")
def point_in_ring(t) -> DataFrame:
    cx, cy, r = 25.25, 950.125, 20.0
    ring = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((cx - r, cy), (cx, cy - r), (cx + r, cy), (cx, cy + r), (cx - r, cy))))
    return t("part").select("p_partkey", ring_holds(ring, F.col("p_size").cast("double"), F.col("p_retailprice")).alias("inside"))


@query("SELECT p_brand, count(*) AS n, '2.0,0.5,10.0,-0.25,-3.0,20.0' AS transform FROM part GROUP BY 1")
def affine_fit(t) -> DataFrame:
    c, r = F.col("p_size").cast("double"), (F.col("p_partkey") % 97).cast("double")
    points = t("part").select("p_brand", c.alias("col"), r.alias("row"), (10 + 2 * c + 0.5 * r).alias("x"), (20 - 0.25 * c - 3 * r).alias("y"))
    text = F.concat_ws(",", F.transform("transform", lambda v: F.round(v, 6).cast("string")))
    return fit_affine(points, ["p_brand"]).select("p_brand", "n", text.alias("transform"))


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2"""
)
def pricing_summary(t) -> DataFrame:
    kept = t("lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("2001-06-01")))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round("l_quantity").cast("long")).alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sum_cents"), F.count("*").alias("n"))
