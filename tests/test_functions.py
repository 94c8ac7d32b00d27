import math

import pytest
from palimpsest.functions import dates as D
from palimpsest.functions import maths as M
from palimpsest.functions import strings as S
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


def test_partial_dates(spark):
    good = ["2000", "2000-02-29", "0001", "9999-12-31"]
    bad = ["2023-02-29", "2000-13-01", "2000-00-10", "2000-04-31", "0000", "10000", "1954-7", None, ""]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", D.bound(F.col("v")).alias("lo"), D.bound(F.col("v"), upper=True).alias("hi"))
    rows = {r.v: r for r in df.collect()}
    assert all(rows[v].lo is not None for v in good) and all(rows[v].lo is None for v in bad)
    assert str(rows["2000"].lo) == "2000-01-01" and str(rows["2000"].hi) == "2000-12-31"
    assert one(spark, D.out_of_order(F.col("a"), F.col("b")), a="1960", b="1959-12-31") is True
    assert one(spark, D.out_of_order(F.col("a"), F.col("b")), a="1960", b="1960-01-01") is False
    assert one(spark, D.out_of_order(F.col("a"), F.col("b")), a="1960", b=None) is False
    assert one(spark, D.decades(F.col("a"), F.col("b")), a=1957, b=1981) == [1950, 1960, 1970, 1980]
    assert one(spark, D.instant(F.col("a")).isNull(), a="2023-02-30T00:00:00Z") is True


def test_strings(spark):
    url = "https://host/x/CA_Nevada%20City_12345_1953_24000_geo.tif"
    parts = one(spark, S.sheet_parts(F.col("u")), u=url)
    assert (parts.state, parts.name, parts.year, parts.scale) == ("CA", "Nevada City", "1953", "24000")
    assert one(spark, S.percent_decode(F.col("u")), u="a+b%20c") == "a+b c"
    assert one(spark, S.rest_of(F.col("u")), u="topo:a:b") == "a:b" and one(spark, S.rest_of(F.col("u")), u="topo") == ""
    assert one(spark, S.run_value(F.col("u"), "b"), u="a: 1; b: 2; b: 3") == "3"
    assert one(spark, S.canonical(F.col("u")), u="  A|B...c \n d ") == "a b c d"
    assert one(spark, S.html_escape(F.col("u")), u="<a href='x'>&") == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert one(spark, S.scale_label(F.col("u")), u=24000) == "1:24,000"
    assert one(spark, S.datum_steps(F.col("u")), u="axis order change + Inverse of UTM + NADCON") == ["Inverse of UTM", "NADCON"]
    assert [one(spark, S.safe_path(F.col("u")), u=p) for p in ("a/b.png", "../a", "/a", "a\\b")] == [True, False, False, False]


def test_tiles(spark):
    assert one(spark, M.native_max_zoom(F.col("p"), F.col("lat")), p=2.032, lat=39.25) == 16
    x, y = M.tile_of(F.col("lon"), F.col("lat"), F.lit(16))
    span = 360 / 2**16
    assert one(spark, x, lon=-121.0, lat=39.0) == math.floor((-121.0 + 180) / span)
    grid = M.common_grid((-121.1, 39.2, -121.0, 39.3), 12)
    t = grid["tile_range"]
    assert grid["width"] == 256 * (t["x_max"] - t["x_min"] + 1)
    tiles = M.tile_rows(spark.createDataFrame([(12, t["x_min"], t["x_max"], t["y_min"], t["y_max"])], "z int, x_min int, x_max int, y_min int, y_max int"))
    assert tiles.count() == (t["x_max"] - t["x_min"] + 1) * (t["y_max"] - t["y_min"] + 1)


def test_numbers(spark):
    df = spark.createDataFrame([(1.0000005,), (2.675,)], "v double").select(M.round6("v").alias("r"))
    assert [r.r for r in df.collect()] == [round(1.0000005, 6), 2.675]
    ring = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))))
    assert spark.range(1).select(M.shoelace(ring)).first()[0] == 2.0
    assert M.fingerprint({"b": 1, "a": [2]}) == M.fingerprint({"a": [2], "b": 1})
    d, east, north = M.vincenty(0.0, 0.0, 1.0, 0.0)
    assert d == pytest.approx(111319.49, abs=0.05) and east == pytest.approx(d) and abs(north) < 1e-6
