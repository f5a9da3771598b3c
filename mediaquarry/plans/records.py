from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import store as S
from ..registry import query
from ..sources import files as S2
from ..sources.tables import FACES_SQL, MEDIA_SQL, faces, media, table


def broken(rules: dict[str, str], source: str, key: str) -> str:
    return f"SELECT {key}, rule FROM (SELECT {key}, unnest([{', '.join(f'CASE WHEN NOT ({t}) THEN {chr(39)}{n}{chr(39)} END' for n, t in rules.items())}]) AS rule FROM {source} x) WHERE rule IS NOT NULL"


FACE_RULES = {
    "eligible_needs_person": "NOT eligible OR person_id IS NOT NULL",
    "automatic_needs_confidence": "NOT (eligible AND assignment = 'auto_high_confidence') OR coalesce(confidence >= threshold, false)",
    "open_assignment_is_not_eligible": "NOT eligible OR assignment IN ('user_confirmed', 'auto_high_confidence')",
}


@query("vr11_face_rules", broken(FACE_RULES, FACES_SQL, "face_id"))
def vr11(spark, d):
    return S.violations(faces(spark, d), "face_id", R.face_rules())


MEDIA_RULES = {"quarantined_is_excluded": "kind <> 'audio' OR excluded", "unknown_precision_has_no_time": "time_precision <> 'unknown' OR captured IS NULL", "primary_has_group": "NOT is_primary OR group_id IS NOT NULL"}


@query("vr12_media_rules", broken(MEDIA_RULES, MEDIA_SQL, "media_id"))
def vr12(spark, d):
    return S.violations(media(spark, d), "media_id", R.media_rules())


MOMENT = "(SELECT l_orderkey AS moment_id, min(l_linenumber) AS lo, max(l_linenumber) AS hi, list(l_partkey % 8 ORDER BY l_partkey, l_linenumber) AS snaps FROM lineitem GROUP BY 1)"


@query("vr13_moment_rules", broken({"snaps_sorted": "list_sort(snaps) = snaps", "snaps_inside": "len(list_filter(snaps, lambda s: s < lo OR s >= hi)) = 0", "trim_ordered": "lo < hi"}, MOMENT, "moment_id"))
def vr13(spark, d):
    snaps = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda s: s["l_partkey"] % 8)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("moment_id")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), snaps.alias("snaps"))
    return S.violations(rows, "moment_id", R.moment_rules())


@query("vr14_job_rules", broken({"egress_needs_consent": "NOT egress OR consent IS NOT NULL", "local_has_no_consent": "egress OR consent IS NULL", "journal_is_local": "egress OR NOT list_contains(journal, 'network')"}, "(SELECT o_orderkey AS job_id, o_orderkey % 2 = 0 AS egress, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS consent, ['disk', CASE WHEN o_orderkey % 5 = 0 THEN 'network' ELSE 'disk' END] AS journal FROM orders)", "job_id"))
def vr14(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderkey % 2 = 0 AS egress", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS consent", "array('disk', CASE WHEN o_orderkey % 5 = 0 THEN 'network' ELSE 'disk' END) AS journal")
    return S.violations(rows, "job_id", R.job_rules())


@query("sc18_rfc3339", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) - 3600000000 WHEN 1 THEN epoch_us(ts) END AS us FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def sc18(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "+01:00").when(F.col("event_id") % 3 == 1, "Z").otherwise(""))
    return table(spark, d, "events").select("event_id", R.strict_rfc3339(text).alias("us"))


@query("sc23_display_text", "SELECT page_id, CASE WHEN length(t) > 20 THEN substr(t, 1, 19) || '…' ELSE t END AS shown FROM (SELECT page_id, replace(url, '/', '') AS t FROM pages)")
def sc23(spark, d):
    return table(spark, d, "pages").select("page_id", R.display_text(F.replace(F.col("url"), F.lit("/"), F.lit("\u0007")), 20).alias("shown"))


@query("sc26_price", "SELECT o_orderkey AS id, round(o_custkey * CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 3::DOUBLE ELSE 2::DOUBLE END / 1000000, 6) AS cost FROM orders")
def sc26(spark, d):
    rates = spark.createDataFrame([("1900-01-01", "1996-01-01", 3.0), ("1996-01-01", "2100-01-01", 2.0)], "since string, until string, rate double")
    rates = rates.select(F.to_timestamp_ntz(F.concat("since", F.lit(" 00:00:00"))).alias("since"), F.to_timestamp_ntz(F.concat("until", F.lit(" 00:00:00"))).alias("until"), "rate")
    rows = table(spark, d, "orders").join(F.broadcast(rates), (F.col("o_orderdate") >= F.col("since")) & (F.col("o_orderdate") < F.col("until")))
    return rows.select(F.col("o_orderkey").alias("id"), R.price(F.col("o_custkey"), F.col("rate")).alias("cost"))


@query("sc32_leaks", "SELECT page_id, page_id % 3 = 0 AS leaks FROM pages")
def sc32(spark, d):
    value = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/home/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", R.leaks(F.create_map(F.lit("url"), F.col("url"), F.lit("v"), value)).alias("leaks"))


FLOAT_HEX = """SELECT vec_id, pos, s * 2147483648 + CASE WHEN a = 0 THEN 0 ELSE (e + 127) * 8388608 + CAST((a / power(2::DOUBLE, e) - 1) * 8388608 AS BIGINT) END AS n
    FROM (SELECT *, CASE WHEN a > 0 THEN CAST(floor(log2(a) + 1e-12) AS BIGINT) END AS e FROM (SELECT vec_id, pos, CASE WHEN x < 0 THEN 1 ELSE 0 END AS s, abs(CAST(x AS DOUBLE)) AS a FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)))"""


@query("sc08_vector_bytes", f"""SELECT vec_id, 256 AS bytes, true AS same, string_agg(format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216), '' ORDER BY pos) AS hexed FROM ({FLOAT_HEX}) GROUP BY vec_id""")
def sc08(spark, d):
    rows = table(spark, d, "embeddings").withColumn("b", R.pack_vector("embedding"))
    return rows.select("vec_id", F.octet_length("b").alias("bytes"), (R.unpack_vector("b") == F.col("embedding")).alias("same"), F.lower(F.hex("b")).alias("hexed"))


@query("sc24_lenient_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' ELSE 'no_object' END AS status, CASE WHEN event_id % 3 < 2 THEN props END AS payload FROM events")
def sc24(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(",}"))).otherwise("none")
    return table(spark, d, "events").select("event_id", R.lenient_json(text).alias("r")).select("event_id", "r.status", "r.payload")


@query("snk04_canonical_json", "SELECT o_orderkey AS id, '{\"a\":' || CAST(o_custkey AS VARCHAR) || ',\"b\":[null,true,1.5]}' AS canonical FROM orders")
def snk04(spark, d):
    text = F.concat(F.lit('{ "b" : [null, true, 1.50e0], "a": '), F.col("o_custkey").cast("string"), F.lit("}"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.canonical_json(text).alias("canonical"))


@query("src03_sniff", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'wav' WHEN 2 THEN 'iso_bmff' END AS format FROM orders")
def src03(spark, d):
    head = F.when(F.col("o_orderkey") % 4 == 0, "89504E470D0A1A0A0000").when(F.col("o_orderkey") % 4 == 1, "524946460000000057415645").when(F.col("o_orderkey") % 4 == 2, "00000018667479706D703432").otherwise("00")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S2.sniff(F.unhex(head)).alias("format"))


@query("src05_exif_utc", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts + INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S') END AS utc FROM events")
def src05(spark, d):
    offset = F.when(F.col("event_id") % 4 == 0, "+01:30").when(F.col("event_id") % 4 == 1, "-08:00").when(F.col("event_id") % 4 == 2, "").otherwise("+19:00")
    return table(spark, d, "events").select("event_id", S2.exif_utc(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), offset).alias("utc"))


@query("src14_frame_index", "SELECT user_id AS media_id, count(*) AS frames, min(s) AS step, coalesce(min(s) = max(s), true) AS uniform FROM (SELECT user_id, p - lag(p) OVER (PARTITION BY user_id ORDER BY f) AS s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f, CASE WHEN user_id % 2 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 40 ELSE event_id * 3 END AS p FROM events)) GROUP BY 1")
def src14(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id", "event_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame")
    rows = rows.selectExpr("user_id AS media_id", "to_json(struct(frame, CASE WHEN user_id % 2 = 0 THEN frame * 40 ELSE event_id * 3 END AS pts)) AS value")
    return S2.frame_index(rows)


@query("jn19_box_relations", "SELECT a.id AS a, b.id AS b FROM (SELECT l_orderkey AS g, l_orderkey * 10 + l_linenumber AS id, l_discount AS x, l_quantity AS w FROM lineitem) a JOIN (SELECT l_orderkey AS g, l_orderkey * 10 + l_linenumber AS id, l_discount AS x, l_quantity AS w FROM lineitem) b ON a.g = b.g AND a.id <> b.id AND a.x <= b.x AND a.x + a.w >= b.x + b.w")
def jn19(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS g", "l_orderkey * 10 + l_linenumber AS id", "l_discount AS x", "l_quantity AS w")
    b = rows.selectExpr("g AS g2", "id AS b", "x AS bx", "w AS bw")
    return rows.join(b, (F.col("g") == F.col("g2")) & (F.col("id") != F.col("b")) & (F.col("x") <= F.col("bx")) & (F.col("x") + F.col("w") >= F.col("bx") + F.col("bw"))).select(F.col("id").alias("a"), "b")


@query("top06_capacity", "SELECT l_orderkey AS plan, l_linenumber AS n, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def top06(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return rows.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))


@query("top08_shortlist", f"SELECT media_id, aesthetic FROM {MEDIA_SQL} m WHERE aesthetic IS NOT NULL AND NOT hidden ORDER BY aesthetic DESC, media_id LIMIT 40")
def top08(spark, d):
    return media(spark, d).filter("aesthetic IS NOT NULL AND NOT hidden").orderBy(F.desc("aesthetic"), "media_id").limit(40).select("media_id", "aesthetic")
