from pyspark.sql import functions as F

from ..operators import store as S
from ..registry import query
from ..sources.tables import FACES_SQL, MEDIA_SQL, events, faces, media, table


def orders(spark, d, where):
    return table(spark, d, "orders").filter(where)


@query(
    "ups01_last_write",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""",
)
def ups01(spark, d):
    old = orders(spark, d, "o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "o_orderstatus AS state", "1 AS seq")
    new = orders(spark, d, "o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "'new' AS state", "2 AS seq")
    return S.last_write(old, new, ["id"], "seq").drop("seq")


@query("ups02_replace_children", "SELECT l_orderkey AS media_id, CASE WHEN l_orderkey % 4 = 0 THEN -l_partkey ELSE l_partkey END AS child FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber = 1")
def ups02(spark, d):
    rows = table(spark, d, "lineitem")
    children = rows.selectExpr("l_orderkey AS media_id", "l_partkey AS child")
    fresh = rows.filter("l_orderkey % 4 = 0 AND l_linenumber = 1").selectExpr("l_orderkey AS media_id", "-l_partkey AS child")
    return S.replace_children(children, "media_id", orders(spark, d, "o_orderkey % 4 = 0").selectExpr("o_orderkey AS media_id"), fresh)


@query("ups03_first_tag", "SELECT l_orderkey AS media_id, l_returnflag AS label, min(l_partkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_orderkey, l_returnflag")
def ups03(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS media_id", "l_returnflag AS label", "l_partkey * 10 + l_linenumber AS pos")
    return S.first_of_key(rows, ["media_id", "label"], "pos")


@query(
    "ups04_partial_upsert",
    """SELECT o_orderkey AS face_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS media_id, CASE WHEN o_orderkey % 3 = 0 THEN 'revised' ELSE o_orderstatus END AS assignment
    FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
)
def ups04(spark, d):
    old = orders(spark, d, "o_orderkey % 2 = 0").selectExpr("o_orderkey AS face_id", "o_custkey AS media_id", "o_orderstatus AS assignment")
    new = orders(spark, d, "o_orderkey % 3 = 0").selectExpr("o_orderkey AS face_id", "CAST(-1 AS BIGINT) AS media_id", "'revised' AS assignment")
    return S.partial_upsert(old, new, "face_id", ["assignment"])


@query("ups05_bridge_insert_or_ignore", "SELECT DISTINCT l_orderkey AS moment_id, l_suppkey AS person_id FROM lineitem")
def ups05(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS moment_id", "l_suppkey AS person_id").dropDuplicates()


@query("ups06_keep_created_at", "SELECT c_custkey AS person_id, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS name, c_acctbal AS created FROM customer")
def ups06(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey AS person_id", "c_name AS name", "c_acctbal AS created")
    new = old.filter("person_id % 5 = 0").selectExpr("person_id", "'renamed' AS name", "CAST(0 AS DOUBLE) AS created")
    return S.partial_upsert(old, new, "person_id", ["name"])


@query("ups08_cascade", "SELECT l_orderkey AS media_id, l_linenumber AS n, l_partkey AS part FROM lineitem WHERE l_orderkey % 7 <> 0")
def ups08(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS media_id", "l_linenumber AS n", "l_partkey AS part")
    return S.cascade(rows, "media_id", orders(spark, d, "o_orderkey % 7 = 0").selectExpr("o_orderkey AS media_id"))


@query("ups08_set_null", f"SELECT face_id, CASE WHEN person_id % 4 <> 0 THEN person_id END AS person_id FROM {FACES_SQL} f")
def ups08_null(spark, d):
    gone = table(spark, d, "supplier").filter("s_suppkey % 4 = 0").selectExpr("s_suppkey AS person_id")
    return S.set_null(faces(spark, d).select("face_id", "person_id"), "person_id", gone)


@query(
    "ups09_violations",
    f"""SELECT face_id, rule FROM (SELECT face_id, unnest([CASE WHEN NOT (NOT eligible OR confidence >= 0.3) THEN 'eligible_below_threshold' END, CASE WHEN NOT (assignment <> 'user_confirmed' OR person_id IS NOT NULL) THEN 'confirmed_without_person' END]) AS rule
    FROM {FACES_SQL} f) WHERE rule IS NOT NULL""",
)
def ups09(spark, d):
    rules = {"eligible_below_threshold": ~F.col("eligible") | (F.col("confidence") >= 0.3), "confirmed_without_person": (F.col("assignment") != "user_confirmed") | F.col("person_id").isNotNull()}
    return S.violations(faces(spark, d), "face_id", rules)


RECORD = """concat('{"proxies":[{"proxy_id":"p', CAST(o_orderkey AS STRING), '","kind":"thumb"},{"proxy_id":"v', CAST(o_custkey AS STRING), '","kind":"video"}]}')"""


@query("ups10_backfill_proxies", "SELECT o_orderkey AS media_id, 0 AS pos, 'p' || CAST(o_orderkey AS VARCHAR) AS proxy_id, 'thumb' AS kind FROM orders UNION ALL SELECT o_orderkey, 1, 'v' || CAST(o_custkey AS VARCHAR), 'video' FROM orders")
def ups10(spark, d):
    return S.proxies(table(spark, d, "orders").selectExpr("o_orderkey AS media_id", f"{RECORD} AS record"))


@query("src16_video_proxies", "SELECT o_orderkey AS media_id, 'v' || CAST(o_custkey AS VARCHAR) AS proxy_id FROM orders")
def src16(spark, d):
    rows = S.proxies(table(spark, d, "orders").selectExpr("o_orderkey AS media_id", f"{RECORD} AS record"))
    return rows.filter("kind = 'video'").select("media_id", "proxy_id")


@query("flt04_proxies_of_record", "SELECT o_orderkey AS media_id, ['p' || CAST(o_orderkey AS VARCHAR)] AS proxies FROM orders")
def flt04(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS media_id", f"from_json({RECORD}, 'struct<proxies:array<struct<proxy_id:string,kind:string>>>').proxies AS p")
    return rows.select("media_id", F.transform(F.filter("p", lambda x: x["kind"] == "thumb"), lambda x: x["proxy_id"]).alias("proxies"))


@query(
    "src10_inventory_diff",
    """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 <> 0 THEN 'added' WHEN o_orderkey % 3 <> 0 THEN 'removed' ELSE 'changed' END AS status FROM orders
    WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND NOT (o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0)""",
)
def src10(spark, d):
    old = orders(spark, d, "o_orderkey % 2 = 0").selectExpr("o_orderkey AS path", "o_totalprice AS size", "o_orderdate AS mtime")
    new = orders(spark, d, "o_orderkey % 3 = 0").selectExpr("o_orderkey AS path", "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size", "o_orderdate AS mtime")
    return S.diff(old, new, "path", ["size", "mtime"])


@query("src12_insert_missing", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def src12(spark, d):
    arriving = table(spark, d, "lineitem").selectExpr("l_partkey AS id")
    return S.insert_missing(table(spark, d, "part").filter("p_size > 10").selectExpr("p_partkey AS id"), arriving, "id")


NAMES = "CASE o_orderkey % 4 WHEN 0 THEN concat('IMG-', replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '-WA0001.jpg') WHEN 1 THEN concat('WhatsApp Image ', substr(CAST(o_orderdate AS STRING), 1, 10), ' at 07.08.09.jpeg') WHEN 2 THEN 'IMG-20241399-WA0001.jpg' ELSE 'DSC0001.JPG' END"


@query(
    "src06_filename_dates",
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 10) || ' 00:00:00' WHEN 1 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 10) || ' 07:08:09' END AS captured,
    CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'second' END AS time_precision FROM orders""",
)
def src06(spark, d):
    at, precision = S.filename_time(F.col("name"))
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{NAMES} AS name").select("id", at.alias("captured"), precision.alias("time_precision"))


@query(
    "src08_chapters",
    """WITH f AS (SELECT l_orderkey % 2 AS fam, l_orderkey % 10000 AS rec, l_linenumber AS ch FROM lineitem)
    SELECT CASE fam WHEN 0 THEN 'GX' ELSE 'GH' END AS family, lpad(CAST(rec AS VARCHAR), 4, '0') AS recording, count(*) AS files, count(*) > count(DISTINCT ch) AS conflict, max(ch) - min(ch) + 1 = count(DISTINCT ch) AS complete FROM f GROUP BY fam, rec HAVING count(*) > 1""",
)
def src08(spark, d):
    name = "concat(CASE l_orderkey % 2 WHEN 0 THEN 'GX' ELSE 'GH' END, lpad(CAST(l_linenumber AS STRING), 2, '0'), lpad(CAST(l_orderkey % 10000 AS STRING), 4, '0'), '.MP4')"
    return S.chapters(table(spark, d, "lineitem").selectExpr(f"{name} AS name"))


TIMELINE = "(SELECT l_orderkey AS span_id, l_linenumber AS member, max(CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END) AS duration FROM lineitem GROUP BY 1, 2)"


@query(
    "src09_span_timeline",
    f"""SELECT span_id, member, CASE WHEN count(*) OVER (PARTITION BY span_id) = count(duration) OVER (PARTITION BY span_id) THEN CAST(coalesce(sum(duration) OVER (PARTITION BY span_id ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS "offset"
    FROM {TIMELINE} t""",
)
def src09(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("span_id"), F.col("l_linenumber").alias("member"))
    return S.timeline(rows.agg(F.max(F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey"))).alias("duration")))


@query(
    "src13_stage_times",
    """WITH l AS (SELECT user_id AS run, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'done' END AS event, epoch_us(ts) AS us FROM events),
    s AS (SELECT run, stage, max(us) AS began FROM l WHERE event = 'start' GROUP BY 1, 2)
    SELECT s.run, s.stage, round((min(us) - any_value(began)) / 1e6, 6) AS seconds FROM s LEFT JOIN l ON l.run = s.run AND l.stage = s.stage AND l.event = 'done' AND l.us >= s.began GROUP BY 1, 2""",
)
def src13(spark, d):
    log = events(spark, d).selectExpr("user_id AS run", "event_type AS stage", "CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'done' END AS event", "us")
    return S.stage_times(log)


@query("str03_reclaim", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def str03(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE o_orderstatus END AS status")
    return S.reclaim(jobs)


@query("str05_idempotent_jobs", "SELECT o_custkey AS digest, min(o_orderkey) AS job_id FROM orders GROUP BY o_custkey")
def str05(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey AS digest", "o_orderkey AS job_id")
    return S.first_of_key(rows, ["digest"], "job_id")


@query("agg18_library_stats", f"SELECT count(*) AS media, count(*) FILTER (WHERE kind = 'video') AS videos, count(*) FILTER (WHERE aesthetic IS NULL) AS awaiting_analysis, (SELECT count(DISTINCT person_id) FROM {FACES_SQL} f) AS people FROM {MEDIA_SQL} m")
def agg18(spark, d):
    m = media(spark, d).agg(F.count("*").alias("media"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("aesthetic").isNull()).alias("awaiting_analysis"))
    return m.crossJoin(faces(spark, d).agg(F.count_distinct("person_id").alias("people")))
