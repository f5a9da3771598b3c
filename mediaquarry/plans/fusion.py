from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion as U
from ..registry import query
from ..sources.tables import FACES_SQL, MEDIA_SQL, SIGNALS_SQL, faces, media, signals, table

W = U.WEIGHTS
D = lambda x: f"{x}::DOUBLE"
LIVE = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {D(w)} ELSE 0::DOUBLE END" for n, w in W.items())
MASS = " + ".join(f"coalesce({n} * {D(w)}, 0::DOUBLE)" for n, w in W.items())
SET = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in W) + "], lambda x: x IS NOT NULL), ',')"
FACELESS, ALL = sum(w for n, w in W.items() if n != "face_quality"), sum(W.values())
FUSED = f"(SELECT *, CASE WHEN live > 0 THEN round_even(({MASS}) / live, 6) END AS value, round_even(least(live / CASE WHEN face_state = 'none' THEN {D(FACELESS)} ELSE {D(ALL)} END, 1::DOUBLE), 6) AS coverage, {SET} AS signal_set FROM (SELECT *, {LIVE} AS live FROM {SIGNALS_SQL} s))"


@query("agg04_fuse", f"SELECT media_id, value, coverage, signal_set FROM {FUSED} f")
def agg04(spark, d):
    return U.fuse(signals(spark, d)).select("media_id", "value", "coverage", "signal_set")


@query("top07_explain", f"SELECT media_id, list(signal ORDER BY minus, signal) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY minus, signal) AS rn FROM ({' UNION ALL '.join(f'SELECT media_id, {chr(39)}{n}{chr(39)} AS signal, -round({n} * {D(w)} / live, 9) AS minus FROM {FUSED} f WHERE {n} IS NOT NULL' for n, w in W.items())})) WHERE rn <= 3 GROUP BY media_id")
def top07(spark, d):
    return U.explain(signals(spark, d), 3).filter(F.size("signals") > 0)


@query(
    "agg05_face_quality",
    f"""SELECT media_id, faces, round(CASE WHEN eyes IS NULL THEN (0.45::DOUBLE * lo + 0.20::DOUBLE * p10 + 0.20::DOUBLE * mean) / 0.85::DOUBLE ELSE 0.45::DOUBLE * lo + 0.20::DOUBLE * p10 + 0.20::DOUBLE * mean + 0.15::DOUBLE * eyes END, 6) AS face_quality
    FROM (SELECT media_id, count(*) AS faces, min(quality) AS lo, quantile_disc(quality, 0.1) AS p10, avg(quality) AS mean, avg(CASE WHEN eyes_open >= 0.5 THEN 1.0::DOUBLE WHEN eyes_open IS NOT NULL THEN 0.0::DOUBLE END) AS eyes FROM {FACES_SQL} f GROUP BY media_id)""",
)
def agg05(spark, d):
    return U.aggregate_faces(faces(spark, d))


@query(
    "agg06_face_statistics",
    f"""SELECT media_id, count(*) FILTER (WHERE area >= 0.1::DOUBLE) AS large, count(*) FILTER (WHERE area >= 0.3::DOUBLE) AS very_large, max(area) AS max_area, min(eyes_open) AS min_eyes, round(quantile_cont(eyes_open, 0.1), 6) AS p10_eyes, round(avg(eyes_open), 6) AS mean_eyes, min(smile) AS min_smile, round(avg(smile), 6) AS mean_smile
    FROM {FACES_SQL} f GROUP BY media_id""",
)
def agg06(spark, d):
    return U.face_statistics(faces(spark, d))


@query("agg07_people_summary", f"SELECT media_id, coalesce(list_sort(list_distinct(list(person_id) FILTER (WHERE eligible))), []) AS people, count(*) FILTER (WHERE NOT eligible) AS pending FROM {FACES_SQL} f GROUP BY media_id")
def agg07(spark, d):
    return U.people_summary(faces(spark, d))


@query("agg03_face_counts", f"SELECT m.media_id, coalesce(n, owner_id) AS face_count FROM {MEDIA_SQL} m LEFT JOIN (SELECT media_id, count(*) AS n FROM {FACES_SQL} f GROUP BY media_id) c ON c.media_id = m.media_id")
def agg03(spark, d):
    return U.counts_with_fallback(media(spark, d), faces(spark, d), "owner_id")


@query("agg02_group_counts", f"SELECT count(DISTINCT group_id) AS groups, count(group_id) AS grouped FROM {MEDIA_SQL} m")
def agg02(spark, d):
    return media(spark, d).agg(F.count_distinct("group_id").alias("groups"), F.count("group_id").alias("grouped"))


@query("agg09_person_counts", f"SELECT person_id, count(DISTINCT media_id) AS media FROM {FACES_SQL} f WHERE eligible GROUP BY person_id")
def agg09(spark, d):
    return faces(spark, d).filter("eligible").groupBy("person_id").agg(F.count_distinct("media_id").alias("media"))


@query("agg17_culling_summary", f"SELECT kind, count(*) AS items, count(aesthetic) AS measured, round(sum(aesthetic), 4) AS total FROM {MEDIA_SQL} m GROUP BY kind")
def agg17(spark, d):
    return media(spark, d).groupBy("kind").agg(F.count("*").alias("items"), F.count("aesthetic").alias("measured"), F.round(F.sum("aesthetic"), 4).alias("total"))


@query("agg19_people_list", f"SELECT person_id, count(*) AS faces, min(face_id) AS cover FROM {FACES_SQL} f WHERE eligible GROUP BY person_id")
def agg19(spark, d):
    return faces(spark, d).filter("eligible").groupBy("person_id").agg(F.count("*").alias("faces"), F.min("face_id").alias("cover"))


@query("agg20_mode_group", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def agg20(spark, d):
    o = table(spark, d, "orders")
    best = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(1)
    return o.join(best, "o_orderpriority", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("agg21_pacing_spread", "SELECT l_orderkey AS id, round((max(l_quantity) - min(l_quantity)) / avg(l_quantity), 6) AS spread FROM lineitem GROUP BY l_orderkey")
def agg21(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round((F.max(q) - F.min(q)) / F.avg(q), 6).alias("spread"))


@query("agg23_agreement", "SELECT round(avg(CASE WHEN l.o_orderkey IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS agreement FROM orders e LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) l ON l.o_orderkey = e.o_orderkey WHERE e.o_orderstatus = 'O'")
def agg23(spark, d):
    o = table(spark, d, "orders")
    local = o.filter("o_totalprice > 200000").select("o_orderkey", F.lit(1.0).alias("hit"))
    return o.filter("o_orderstatus = 'O'").join(local, "o_orderkey", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("agreement"))


@query("agg24_library_digest", "SELECT o_custkey AS owner, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS sha256 FROM orders GROUP BY o_custkey")
def agg24(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner"))
    return rows.agg(F.sha2(F.expr("listagg(CAST(o_orderkey AS STRING), ',') WITHIN GROUP (ORDER BY o_orderkey)"), 256).alias("sha256"))


@query("win05_standing", f"SELECT media_id, round_even((c * n + value * 4) / (n + 4), 6) AS standing FROM (SELECT media_id, value, cume_dist() OVER (PARTITION BY klass ORDER BY value) AS c, count(*) OVER (PARTITION BY klass) AS n FROM {FUSED} f WHERE value IS NOT NULL)")
def win05(spark, d):
    return U.standing(U.fuse(signals(spark, d)).filter("value IS NOT NULL"), "klass", "value").select("media_id", "standing")


@query(
    "win06_mid_rank",
    f"""SELECT media_id, CASE WHEN exposure IS NULL THEN 0.5::DOUBLE ELSE round_even((rank() OVER (PARTITION BY klass, exposure IS NULL ORDER BY exposure) - 1 + count(*) OVER (PARTITION BY klass, exposure) / 2) / count(*) OVER (PARTITION BY klass, exposure IS NULL), 6) END AS percentile FROM {SIGNALS_SQL} s""",
)
def win06(spark, d):
    return U.mid_rank(signals(spark, d), "klass", "exposure").select("media_id", "percentile")


@query("win07_rank", f"SELECT media_id, CAST(row_number() OVER (ORDER BY is_black_frame, value DESC NULLS LAST, media_id) AS INTEGER) AS place FROM {FUSED} f WHERE klass = 2")
def win07(spark, d):
    return U.rank_best(U.fuse(signals(spark, d)).filter("klass = 2"), "klass", "value", F.col("is_black_frame")).select("media_id", "place")


@query("win08_primary", f"SELECT group_id, media_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY hidden DESC, aesthetic DESC NULLS LAST, media_id) AS rn FROM {MEDIA_SQL} m WHERE group_id IS NOT NULL) WHERE rn = 1")
def win08(spark, d):
    rows = media(spark, d).filter("group_id IS NOT NULL").selectExpr("group_id", "media_id", "hidden AS favorite", "aesthetic AS quality")
    return U.primary_of_group(rows).select("group_id", "media_id")


@query("win31_undated_last", f"SELECT media_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY captured NULLS LAST, media_id) AS INTEGER) AS place FROM {MEDIA_SQL} m")
def win31(spark, d):
    w = Window.partitionBy("owner_id").orderBy(F.asc_nulls_last("captured"), "media_id")
    return media(spark, d).select("media_id", F.row_number().over(w).alias("place"))


@query("win10_time_bucket", "SELECT event_id, CAST(least(floor((epoch_us(ts) - lo) / ((hi - lo) / 8)), 7) AS BIGINT) AS bucket FROM (SELECT *, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events)")
def win10(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS us")
    ends = rows.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    bucket = F.floor((F.col("us") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 8))
    return rows.crossJoin(F.broadcast(ends)).select("event_id", F.least(bucket, F.lit(7)).cast("long").alias("bucket"))
