from pyspark.sql import functions as F

from ..operators import listing as L
from ..registry import query
from ..sources.tables import EVENTS_SQL, FACES_SQL, MEDIA_SQL, SIGNALS_SQL, events, faces, media, signals, table

OPEN = "NOT excluded AND NOT hidden"
DATED = "captured IS NOT NULL AND time_precision IN ('second', 'minute', 'hour', 'day')"


@query("flt01_point_lookup", f"SELECT media_id, kind, captured, time_precision FROM {MEDIA_SQL} m WHERE media_id = 1234")
def flt01(spark, d):
    return media(spark, d).filter("media_id = 1234").select("media_id", "kind", "captured", "time_precision")


SOURCE_EXPRS = ("l_orderkey AS media_id", "concat('/p', CAST(l_partkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS path", "l_returnflag <> 'R' AS present", "CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS volume_id")


@query(
    "flt02_best_path",
    f"""SELECT media_id, path FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY NOT present, volume_id IS NOT NULL, path) AS rn
    FROM (SELECT {', '.join(SOURCE_EXPRS)} FROM lineitem)) WHERE rn = 1""",
)
def flt02(spark, d):
    return L.best_path(table(spark, d, "lineitem").selectExpr(*SOURCE_EXPRS))


@query("flt03_proxy_owner", "SELECT l_partkey AS proxy_id, min(l_orderkey) AS media_id FROM lineitem GROUP BY l_partkey")
def flt03(spark, d):
    return L.proxy_owner(table(spark, d, "lineitem").selectExpr("l_partkey AS proxy_id", "l_orderkey AS media_id"))


@query("flt05_span_members", "SELECT l_orderkey AS span_id, l_linenumber AS member, l_partkey AS media_id FROM lineitem WHERE l_orderkey = 77 AND l_returnflag <> 'R' ORDER BY l_linenumber, l_partkey")
def flt05(spark, d):
    rows = table(spark, d, "lineitem").filter("l_orderkey = 77 AND l_returnflag <> 'R'")
    return rows.orderBy("l_linenumber", "l_partkey").selectExpr("l_orderkey AS span_id", "l_linenumber AS member", "l_partkey AS media_id")


@query(
    "flt06_listing",
    f"""SELECT media_id, kind, captured, time_precision, aesthetic, excluded, hidden, group_id, is_primary FROM {MEDIA_SQL} m
    WHERE {OPEN} AND {DATED} AND kind <> 'audio' AND (group_id IS NULL OR is_primary) AND EXISTS (SELECT 1 FROM {FACES_SQL} f WHERE f.media_id = m.media_id AND eligible)
    ORDER BY captured, media_id LIMIT 200""",
)
def flt06(spark, d):
    rows = L.with_any_face(media(spark, d).filter("kind <> 'audio'"), faces(spark, d))
    return L.listing(rows, chronological=True, primaries_only=True, limit=200).select(*L.SUMMARY)


@query("flt06_page", f"SELECT media_id, kind FROM {MEDIA_SQL} m WHERE {OPEN} AND aesthetic >= 0.4 AND kind = 'image' ORDER BY media_id LIMIT 50 OFFSET 100")
def flt06_page(spark, d):
    return L.listing(media(spark, d), kind="image", min_aesthetic=0.4, limit=50, offset=100).select("media_id", "kind")


@query("flt07_summary", f"SELECT media_id, kind, captured, time_precision, aesthetic, excluded, hidden, group_id, is_primary FROM {MEDIA_SQL} m")
def flt07(spark, d):
    return media(spark, d).select(*L.SUMMARY)


@query("flt08_faces_of_media", f"SELECT face_id, person_id, confidence FROM {FACES_SQL} f WHERE eligible ORDER BY face_id LIMIT 300 OFFSET 50")
def flt08(spark, d):
    return faces(spark, d).filter("eligible").orderBy("face_id").offset(50).limit(300).select("face_id", "person_id", "confidence")


@query("flt09_analysis_candidates", f"SELECT media_id FROM {MEDIA_SQL} m WHERE kind IN ('image', 'video') AND priority NOT IN ('5-LOW', '1-URGENT') ORDER BY media_id")
def flt09(spark, d):
    rows = media(spark, d).filter(F.col("kind").isin("image", "video") & ~F.col("priority").isin("5-LOW", "1-URGENT"))
    return rows.orderBy("media_id").select("media_id")


@query("flt10_claim_job", "SELECT o_orderkey AS job_id, o_orderstatus AS job_type FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority <> '5-LOW' ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 1")
def flt10(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS job_type", "CASE WHEN o_orderpriority = '5-LOW' THEN 'done' ELSE 'pending' END AS status", "o_totalprice AS priority", "o_orderdate AS created")
    return L.claim_next(jobs, ["O", "F"]).select("job_id", "job_type")


@query("flt11_jobs_by_status", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def flt11(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(100).selectExpr("o_orderkey AS job_id")


@query(
    "flt12_review_queue",
    f"""SELECT face_id, assignment, round(abs(coalesce(threshold, 0.92) - coalesce(confidence, 0)), 6) AS distance FROM {FACES_SQL} f
    WHERE NOT eligible AND assignment IN ('unassigned', 'suggested', 'ambiguous') ORDER BY 3, 1 LIMIT 100""",
)
def flt12(spark, d):
    return L.review_queue(faces(spark, d)).select("face_id", "assignment", "distance")


@query(
    "flt13_keyset_page",
    """WITH p AS (SELECT o_totalprice AS k, o_orderkey AS id FROM orders WHERE o_totalprice > 100000 OR (o_totalprice = 100000 AND o_orderkey > 10) ORDER BY 1, 2 LIMIT 41)
    SELECT k, id, (SELECT count(*) > 40 FROM p) AS has_more FROM (SELECT * FROM p ORDER BY k, id LIMIT 40)""",
)
def flt13(spark, d):
    return L.keyset_page(table(spark, d, "orders").selectExpr("o_totalprice AS k", "o_orderkey AS id"), "k", "id", (100000.0, 10), 40)


@query("flt14_time_filter", f"SELECT media_id FROM {MEDIA_SQL} m WHERE captured IS NULL OR (captured >= TIMESTAMP '1996-01-01' AND captured < TIMESTAMP '1996-07-01')")
def flt14(spark, d):
    a, b = (F.to_timestamp_ntz(F.lit(x)) for x in ("1996-01-01 00:00:00", "1996-07-01 00:00:00"))
    return L.time_filter(media(spark, d), "captured", a, b, include_undated=True).select("media_id")


@query("flt15_quality_order", f"SELECT media_id, aesthetic FROM {MEDIA_SQL} m ORDER BY aesthetic IS NULL, aesthetic DESC, media_id LIMIT 150")
def flt15(spark, d):
    return L.by_quality(media(spark, d), "aesthetic", "media_id", 150).select("media_id", "aesthetic")


@query("flt16_sensitivity", f"SELECT media_id, CASE WHEN aesthetic IS NULL THEN 'unknown' WHEN aesthetic >= 0.7 THEN 'sensitive' ELSE 'clear' END AS state FROM {MEDIA_SQL} m")
def flt16(spark, d):
    return media(spark, d).select("media_id", L.sensitivity(F.col("aesthetic"), 0.7).alias("state"))


@query(
    "flt17_undated_reason",
    f"""SELECT media_id, CASE WHEN captured IS NULL THEN 'no_timestamp' WHEN time_precision = 'unknown' THEN 'precision_unknown' WHEN time_precision IN ('month', 'year') THEN 'precision_too_coarse'
    WHEN coalesce(time_confidence, 0) < 0.5 THEN 'low_time_confidence' END AS reason FROM {MEDIA_SQL} m""",
)
def flt17(spark, d):
    return media(spark, d).select("media_id", L.undated_reason().alias("reason"))


PLACE = ("c_custkey AS id", "CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey - 12 END AS lat", "CASE WHEN c_custkey % 15 <> 0 THEN c_custkey % 5 - 2 END AS lon")


@query("flt18_usable_coordinate", f"SELECT id, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AS usable FROM (SELECT {', '.join(PLACE)} FROM customer)")
def flt18(spark, d):
    rows = table(spark, d, "customer").selectExpr(*PLACE)
    return rows.select("id", F.coalesce(L.usable_coordinate(F.col("lat"), F.col("lon")), F.lit(False)).alias("usable"))


@query("flt19_elimination", f"SELECT media_id, CASE WHEN is_black_frame THEN 'black_frame' WHEN is_lens_obstructed THEN 'lens_obstructed' WHEN sharpness < 0.1 THEN 'below_sharpness_floor' END AS reason FROM {SIGNALS_SQL} s")
def flt19(spark, d):
    return signals(spark, d).select("media_id", L.elimination_reason(0.1).alias("reason"))


@query(
    "flt20_hard_gates",
    f"""SELECT media_id, CASE WHEN media_id % 50 = 0 THEN NULL WHEN media_id % 31 = 0 THEN 'excluded_set' WHEN hidden THEN 'hidden' WHEN excluded THEN 'excluded'
    WHEN group_id IS NOT NULL AND NOT is_primary THEN 'secondary_duplicate' WHEN aesthetic IS NULL THEN 'rejected_score' END AS reason FROM {MEDIA_SQL} m""",
)
def flt20(spark, d):
    rules = [("excluded_set", F.col("media_id") % 31 == 0), ("hidden", F.col("hidden")), ("excluded", F.col("excluded")), ("secondary_duplicate", F.col("group_id").isNotNull() & ~F.col("is_primary")), ("rejected_score", F.col("aesthetic").isNull())]
    return media(spark, d).select("media_id", L.hard_gate(F.col("media_id") % 50 == 0, rules).alias("reason"))


@query("flt22_roll_up", "SELECT l_orderkey AS media_id, bool_and(l_returnflag <> 'R') AS analysed FROM lineitem GROUP BY l_orderkey")
def flt22(spark, d):
    steps = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.collect_list(F.when(F.col("l_returnflag") != "R", "done").otherwise("open")).alias("steps"))
    return steps.select("media_id", L.all_steps_done(F.col("steps")).alias("analysed"))


@query("jn01_media_with_person", f"SELECT media_id, kind FROM {MEDIA_SQL} m WHERE media_id IN (SELECT media_id FROM {FACES_SQL} f WHERE eligible AND person_id = 7)")
def jn01(spark, d):
    return L.with_person(media(spark, d), faces(spark, d), 7).select("media_id", "kind")


@query(
    "jn02_media_with_uncertain_person",
    f"""SELECT DISTINCT m.media_id FROM {MEDIA_SQL} m JOIN {FACES_SQL} f ON m.media_id = f.media_id LEFT JOIN (SELECT face_id, (face_id * 7) % 100 + 1 AS person_id FROM {FACES_SQL} g) c ON f.face_id = c.face_id
    WHERE (f.eligible AND f.person_id = 7) OR c.person_id = 7""",
)
def jn02(spark, d):
    f = faces(spark, d)
    candidates = f.selectExpr("face_id", "(face_id * 7) % 100 + 1 AS person_id")
    return L.with_person(media(spark, d), f, 7, candidates).select("media_id")


@query("jn04_best_moments_of_person", f"SELECT media_id, aesthetic FROM {MEDIA_SQL} m WHERE aesthetic >= 0.2 AND media_id IN (SELECT media_id FROM {FACES_SQL} f WHERE person_id = 5) ORDER BY aesthetic DESC, media_id LIMIT 30")
def jn04(spark, d):
    rows = media(spark, d).filter("aesthetic >= 0.2").join(faces(spark, d).filter("person_id = 5"), "media_id", "left_semi")
    return rows.orderBy(F.desc("aesthetic"), "media_id").limit(30).select("media_id", "aesthetic")


@query("jn05_people_in_media", f"SELECT DISTINCT media_id, person_id FROM {FACES_SQL} f WHERE eligible AND person_id IS NOT NULL")
def jn05(spark, d):
    return L.people_in_media(faces(spark, d))


@query("set02_in_list", f"SELECT media_id FROM {MEDIA_SQL} m WHERE priority IN ('1-URGENT', '2-HIGH')")
def set02(spark, d):
    return media(spark, d).filter(F.col("priority").isin("1-URGENT", "2-HIGH")).select("media_id")


@query("set01_uncovered_people", f"SELECT DISTINCT person_id FROM {FACES_SQL} f WHERE person_id IS NOT NULL EXCEPT SELECT DISTINCT person_id FROM {FACES_SQL} f WHERE eligible AND media_id % 100 < 3")
def set01(spark, d):
    f = faces(spark, d).filter("person_id IS NOT NULL")
    return f.select("person_id").distinct().join(f.filter("eligible AND media_id % 100 < 3"), "person_id", "left_anti")


@query("top03_best_moments", f"SELECT media_id, aesthetic FROM {MEDIA_SQL} m WHERE NOT excluded AND aesthetic >= 0.35 ORDER BY aesthetic DESC, media_id LIMIT 100")
def top03(spark, d):
    return media(spark, d).filter("NOT excluded AND aesthetic >= 0.35").orderBy(F.desc("aesthetic"), "media_id").limit(100).select("media_id", "aesthetic")


@query("jn06_json_unnest", f"SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {EVENTS_SQL} e WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL")
def jn06(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k IS NOT NULL")
