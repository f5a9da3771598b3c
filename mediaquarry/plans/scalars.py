from pyspark.sql import functions as F

from ..functions import scalars as C
from ..registry import query
from ..sources.tables import table

ID = "o_orderkey AS id"
X = "(o_orderkey % 2001 - 1000) / 500"
PLACES = "(SELECT c_custkey AS id, c_nationkey * 2.5 - 30 AS lat1, c_custkey % 180 - 90.5 AS lon1, c_custkey % 70 - 20.25 AS lat2, c_nationkey * 7.5 AS lon2 FROM customer)"
DPLACES = "(SELECT id, CAST(lat1 AS DOUBLE) AS lat1, CAST(lon1 AS DOUBLE) AS lon1, CAST(lat2 AS DOUBLE) AS lat2, CAST(lon2 AS DOUBLE) AS lon2 FROM " + PLACES + " p)"


def xs(spark, d):
    return table(spark, d, "orders").selectExpr(ID, f"{X} AS x", "o_custkey AS n", "o_totalprice AS p")


def places(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS id", "CAST(c_nationkey * 2.5 - 30 AS DOUBLE) AS lat1", "CAST(c_custkey % 180 - 90.5 AS DOUBLE) AS lon1", "CAST(c_custkey % 70 - 20.25 AS DOUBLE) AS lat2", "CAST(c_nationkey * 7.5 AS DOUBLE) AS lon2")


@query("sc01_quantise", "SELECT o_orderkey AS id, round_even(o_totalprice / 7, 6) AS q FROM orders")
def sc01(spark, d):
    return xs(spark, d).select("id", C.quantise(F.col("p") / 7).alias("q"))


@query("sc02_round_half_up", "SELECT o_orderkey AS id, CAST(floor(o_totalprice / 10 + 0.5) AS BIGINT) AS q FROM orders")
def sc02(spark, d):
    return xs(spark, d).select("id", F.floor(F.col("p") / 10 + F.lit(0.5)).alias("q"))


@query("sc03_clamp", f"SELECT o_orderkey AS id, least(greatest({X}, 0), 1) AS q FROM orders")
def sc03(spark, d):
    return xs(spark, d).select("id", C.clamp01(F.col("x")).alias("q"))


@query("sc04_haversine", f"SELECT id, round(2 * 6371.0088 * asin(least(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), 1)), 4) AS km FROM {DPLACES} p")
def sc04(spark, d):
    return places(spark, d).select("id", F.round(C.haversine_km(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))), 4).alias("km"))


@query("sc05_geo_cell", f"SELECT id, CAST(CAST(floor(lat1 / 0.05::DOUBLE) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon1 / 0.05::DOUBLE) AS BIGINT) AS VARCHAR) AS cell FROM {DPLACES} p")
def sc05(spark, d):
    return places(spark, d).select("id", C.geo_cell(F.col("lat1"), F.col("lon1")).alias("cell"))


@query("sc09_bucket_gain", "SELECT o_orderkey AS id, pow(0.5::DOUBLE, o_custkey % 20) AS gain FROM orders")
def sc09(spark, d):
    return xs(spark, d).select("id", C.bucket_gain(F.col("n") % 20).alias("gain"))


@query("sc10_saturating", "SELECT o_orderkey AS id, round(o_totalprice / (o_totalprice + 1000), 9) AS s FROM orders")
def sc10(spark, d):
    return xs(spark, d).select("id", F.round(C.saturating(F.col("p"), 1000.0), 9).alias("s"))


@query("sc11_ramp", f"SELECT o_orderkey AS id, round(least(greatest(({X} - 0.55) / (0.9 - 0.55), 0), 1), 9) AS s FROM orders")
def sc11(spark, d):
    return xs(spark, d).select("id", F.round(C.ramp(F.col("x"), 0.55, 0.9), 9).alias("s"))


@query("sc12_calibration", f"SELECT o_orderkey AS id, round(CASE WHEN s <= 0.4 THEN 0.92 * (s + 1) / 1.4 ELSE 0.92 + 0.08 * (s - 0.4) / 0.6 END, 6) AS c, round((s + 1) / 2, 6) AS u FROM (SELECT o_orderkey, ({X}) / 2 AS s FROM orders)")
def sc12(spark, d):
    s = F.col("x") / 2
    return xs(spark, d).select("id", F.round(C.piecewise_calibrated(s, 0.4, 0.92), 6).alias("c"), F.round(C.uncalibrated(s), 6).alias("u"))


@query("sc13_sigmoid", f"SELECT o_orderkey AS id, round(1 / (1 + exp(-(1.7 * ({X}) - 0.3))), 9) AS p FROM orders")
def sc13(spark, d):
    return xs(spark, d).select("id", F.round(C.platt(F.col("x"), 1.7, -0.3), 9).alias("p"))


@query("sc14_linear_head", "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))) * 2 + 0.5, 6) AS logit FROM embeddings")
def sc14(spark, d):
    part = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(part * 2 + 0.5, 6).alias("logit"))


@query("sc15_firing", f"SELECT o_orderkey AS id, list_filter([CASE WHEN {X} >= 0.3 THEN 'explicit' END, CASE WHEN -({X}) >= 0.3 THEN 'suggestive' END, CASE WHEN {X} >= 1 THEN 'medical' END], lambda x: x IS NOT NULL) AS fired FROM orders")
def sc15(spark, d):
    x = F.col("x")
    return xs(spark, d).select("id", C.firing([("explicit", x), ("suggestive", -x), ("medical", x)], {"explicit": 0.3, "suggestive": 0.3, "medical": 1.0}).alias("fired"))


LEVELS = "['minor', 'unknown', 'adult']"


@query("sc16_more_cautious", f"SELECT o_orderkey AS id, {LEVELS}[least(o_orderkey % 3, o_custkey % 3) + 1] AS level FROM orders")
def sc16(spark, d):
    names = F.array(*[F.lit(x) for x in ("minor", "unknown", "adult")])
    at = lambda c: F.element_at(names, (F.col(c) % 3 + 1).cast("int"))
    return xs(spark, d).select("id", C.more_cautious(at("id"), at("n"), ["minor", "unknown", "adult"]).alias("level"))


@query("sc17_consent", "SELECT o_orderkey AS id, o_custkey <= 700 AND (o_orderkey % 4 = 0 OR 700 < o_custkey + o_orderkey % 100) AND o_orderkey % 9 <> 0 AND o_orderstatus = 'O' AS live FROM orders")
def sc17(spark, d):
    rows = table(spark, d, "orders").withColumn("expires", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") + F.col("o_orderkey") % 100)).withColumn("revoked", F.when(F.col("o_orderkey") % 9 == 0, F.lit(1)))
    return rows.select(F.col("o_orderkey").alias("id"), C.consent_live(F.col("o_custkey"), F.col("expires"), F.col("revoked"), F.col("o_orderstatus"), "O", F.lit(700)).alias("live"))


@query("sc19_rational_time", "SELECT o_orderkey AS id, CAST(sign(o_orderkey * 30 - o_custkey * 24) AS INTEGER) AS cmp, o_orderkey * 30 // 24 AS lo, (o_orderkey * 30 + 23) // 24 AS hi, (2 * o_orderkey * 30 + 24) // 48 AS near FROM orders")
def sc19(spark, d):
    lo, hi, near = C.rescale(F.col("id"), F.lit(24), F.lit(30))
    return xs(spark, d).select("id", C.rational_compare(F.col("id"), F.lit(24), F.col("n"), F.lit(30)).alias("cmp"), lo.alias("lo"), hi.alias("hi"), near.alias("near"))


@query("sc21_uuid5", "SELECT o_orderkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(o_orderkey AS VARCHAR))) AS h FROM orders)")
def sc21(spark, d):
    return xs(spark, d).select("id", C.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("id").cast("string")).alias("u"))


@query("sc22_json", "SELECT event_id, json_valid(props) AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sc22(spark, d):
    return table(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sc28_iou", "SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT *, l_discount * 10 AS a, greatest(least(l_discount * 10 + 0.5, 0.3 + l_tax * 10) - greatest(l_discount * 10, 0.3), 0) * greatest(least(0.5, 0.2 + 0.6) - 0.2, 0) AS i, 0.25 + l_tax * 10 * 0.6 - greatest(least(l_discount * 10 + 0.5, 0.3 + l_tax * 10) - greatest(l_discount * 10, 0.3), 0) * (0.5 - 0.2) AS u FROM lineitem)")
def sc28(spark, d):
    c = lambda v: F.lit(v)
    x = table(spark, d, "lineitem")
    box = C.iou(F.col("l_discount") * 10, c(0.0), c(0.5), c(0.5), c(0.3), c(0.2), F.col("l_tax") * 10, c(0.6))
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(box, 6).alias("iou"))


@query("sc29_people_category", "SELECT o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'detail' WHEN 1 THEN 'portrait' WHEN 2 THEN 'couple' ELSE 'group' END AS category FROM orders")
def sc29(spark, d):
    return xs(spark, d).select("id", C.people_category(F.col("n") % 5).alias("category"))


@query("sc30_pages", "SELECT o_orderkey AS id, CASE WHEN p <= 200 THEN p END AS pages FROM (SELECT o_orderkey, CAST(20 + ceil(greatest(o_custkey % 300 - 20, 0) / 4) * 4 AS BIGINT) AS p FROM orders)")
def sc30(spark, d):
    return xs(spark, d).select("id", C.padded_pages(F.col("n") % 300, 20, 200, 4).alias("pages"))


@query("vr01_effective_dpi", "SELECT l_orderkey * 10 + l_linenumber AS id, floor(least(0.8::DOUBLE * l_partkey * 25.4::DOUBLE / (l_quantity * 10), 0.9::DOUBLE * l_suppkey * 25.4::DOUBLE / (l_quantity * 8)) * 100) / 100 AS dpi FROM lineitem")
def vr01(spark, d):
    x = table(spark, d, "lineitem")
    dpi = C.effective_dpi(F.lit(0.8), F.lit(0.9), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity") * 10, F.col("l_quantity") * 8)
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), dpi.alias("dpi"))


UNIT = "list_transform(embedding, lambda e: CAST(e AS DOUBLE) / sqrt(list_dot_product(list_transform(embedding, lambda f: CAST(f AS DOUBLE)), list_transform(embedding, lambda f: CAST(f AS DOUBLE)))))"


@query("sc07_unit_dot", f"WITH u AS (SELECT vec_id, {UNIT} AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(least(greatest(list_dot_product(a.v, b.v), -1), 1), 6) AS similarity FROM u a JOIN u b ON b.vec_id = a.vec_id - a.vec_id % 2")
def sc07(spark, d):
    length = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    u = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / length).alias("v"))
    other = u.toDF("b", "w")
    rows = u.withColumn("b", F.expr("vec_id - vec_id % 2")).join(other, "b")
    return rows.select(F.col("vec_id").alias("a"), "b", F.round(C.unit_dot(F.col("v"), F.col("w"), F.lit("face"), F.lit("face")), 6).alias("similarity"))


@query(
    "sc20_joint_angle",
    """SELECT vec_id, CASE WHEN sqrt(ux * ux + uy * uy) >= 1e-6 AND sqrt(vx * vx + vy * vy) >= 1e-6 THEN round(degrees(acos(greatest(least((ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)), 1), -1))), 6) END AS angle
    FROM (SELECT vec_id, e[1] - e[3] AS ux, e[2] - e[4] AS uy, e[5] - e[3] AS vx, e[6] - e[4] AS vy FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 4) AS DOUBLE)) AS e FROM embeddings))""",
)
def sc20_angle(spark, d):
    e = lambda i: F.round(F.get("embedding", i) * 4).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(C.joint_angle(*[e(i) for i in range(6)]), 6).alias("angle"))


POSE = "list_transform(embedding[1:8], lambda x: CASE WHEN x > -0.1 THEN 90 + CAST(x AS DOUBLE) * 90 END)"


@query(
    "sc20_pose_distance",
    f"""WITH p AS (SELECT vec_id, {POSE} AS s FROM embeddings), q AS (SELECT a.vec_id, list_filter(list_transform(list_zip(a.s, b.s), lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x: x IS NOT NULL) AS d,
    list_filter(list_transform(list_zip(a.s, list_concat(b.s[5:8], b.s[1:4])), lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x: x IS NOT NULL) AS m FROM p a JOIN p b ON b.vec_id = a.vec_id - a.vec_id % 5)
    SELECT vec_id, round(coalesce(least(CASE WHEN len(d) >= 3 THEN sqrt(list_sum(d) / len(d)) END, CASE WHEN len(m) >= 3 THEN sqrt(list_sum(m) / len(m)) END), 999), 6) AS distance FROM q""",
)
def sc20_distance(spark, d):
    pose = F.transform(F.slice("embedding", 1, 8), lambda x: F.when(x > F.lit(-0.1).cast("float"), 90 + x.cast("double") * 90))
    p = table(spark, d, "embeddings").select("vec_id", pose.alias("s"))
    rows = p.withColumn("o", F.expr("vec_id - vec_id % 5")).join(p.toDF("o", "t"), "o")
    mirrored = F.concat(F.slice("t", 5, 4), F.slice("t", 1, 4))
    return rows.select("vec_id", F.round(C.pose_distance(F.col("s"), F.col("t"), mirrored), 6).alias("distance"))
