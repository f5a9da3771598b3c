from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import vectors as V
from ..registry import query
from ..sources.tables import FRAMES_SQL, frames, table
from .vectors import BANDS, COS, HAMMING, PAIRS


def vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", V.sign_hash(F.col("embedding")).alias("hash"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), (F.col("vec_id") % 7 == 0).alias("favorite"), (F.col("vec_id") % 11 / 11).alias("quality"))


def links(spark, d):
    return P.duplicate_links(vectors(spark, d), 30, 24, 0.8)


DIST = COS.format(a="x.v", b="y.v")
DUP = f"""e AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
    k AS (SELECT a, b, {HAMMING} AS bits, CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN {DIST} END AS d FROM p JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b WHERE {HAMMING} <= 30)"""


@query("clu01_duplicate_links", f"WITH {BANDS}, {PAIRS}, {DUP} SELECT a, b, round(CASE WHEN d IS NOT NULL THEN 1 - d ELSE 1 - bits / 64 END, 6) AS similarity FROM k WHERE CASE WHEN d IS NOT NULL THEN d <= 0.8 ELSE bits <= 24 END")
def clu01(spark, d):
    return links(spark, d)


@query("clu01_duplicate_groups")
def clu01_groups(spark, d):
    return P.duplicate_groups(vectors(spark, d), links(spark, d))


@query("clu05_complete_linkage")
def clu05(spark, d):
    v = table(spark, d, "embeddings")
    return P.complete_linkage(v, V.pairs_within(v, 0.75, "label"), 0.75)


def faces(spark, d):
    """Vectors as faces, some on tracks, some without a vector, with pairs that a person joined or parted."""
    rows = table(spark, d, "embeddings").selectExpr(
        "vec_id AS face_id", "label", "CASE WHEN vec_id % 4 = 0 THEN vec_id div 12 END AS track", "vec_id % 36 = 4 AS declared",
        "CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 13) / 13 END AS quality", "CASE WHEN vec_id % 17 <> 3 THEN embedding END AS embedding",
    )
    must = rows.filter("vec_id % 19 = 1".replace("vec_id", "face_id")).selectExpr("face_id AS a", "face_id + 1 AS b")
    near = V.pairs_within(table(spark, d, "embeddings"), 0.75, "label")
    return rows.drop("label"), near, must, near.filter("(a + b) % 5 = 0")


@query("clu05_constrained_clusters")
def clu05_constrained(spark, d):
    return P.constrained_clusters(*faces(spark, d), 0.75)


@query("clu12_greedy_selection")
def clu12(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey % 50 AS event", "o_orderkey AS media_id", "o_totalprice / 500000 AS score", "o_orderkey % 5 AS place", "o_custkey % 7 AS person")
    return P.greedy_selection(rows, 12, 6)


@query("clu13_lock_cut", f"SELECT media_id, frame, beat FROM (SELECT c.media_id, c.frame, b.frame AS beat, row_number() OVER (PARTITION BY c.media_id, c.frame ORDER BY abs(b.frame - c.frame) - CASE WHEN b.speech THEN 1.5 ELSE 0.0 END, NOT b.speech, abs(b.frame - c.frame), b.frame) AS rn FROM {FRAMES_SQL} c JOIN {FRAMES_SQL} b ON b.media_id = c.media_id AND b.frame BETWEEN c.frame - 6 AND c.frame + 6 WHERE c.boundary AND b.event_type IN ('click', 'view') AND (NOT b.speech OR abs(b.frame - c.frame) <= 3)) WHERE rn = 1")
def clu13(spark, d):
    f = frames(spark, d)
    beats = f.filter("event_type IN ('click', 'view')").select("media_id", "frame", F.col("speech").alias("downbeat"))
    return P.lock_cut(f.filter("boundary").select("media_id", "frame"), beats, 3, 6, 1.5)


ENERGY = "CASE WHEN motion IS NULL AND shake IS NULL THEN NULL ELSE (coalesce(motion * 0.6::DOUBLE, 0) + coalesce(shake * 0.4::DOUBLE, 0)) / (CASE WHEN motion IS NOT NULL THEN 0.6::DOUBLE ELSE 0::DOUBLE END + CASE WHEN shake IS NOT NULL THEN 0.4::DOUBLE ELSE 0::DOUBLE END) END"


@query("clu15_hold_seconds", f"SELECT media_id, frame, round(least(greatest(5 * CASE WHEN e IS NULL THEN 1::DOUBLE ELSE 1.3::DOUBLE - 0.6::DOUBLE * e END, 1.5::DOUBLE), 8::DOUBLE), 6) AS seconds FROM (SELECT *, {ENERGY} AS e FROM {FRAMES_SQL} f)")
def clu15(spark, d):
    return frames(spark, d).select("media_id", "frame", F.round(P.hold_seconds(P.hold_energy(F.col("motion"), F.col("shake")), 5.0), 6).alias("seconds"))


@query(
    "win29_act_bounds",
    f"""WITH r AS (SELECT media_id, frame, sharpness AS score, row_number() OVER (PARTITION BY media_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM {FRAMES_SQL} f WHERE event_type = 'click'), t AS (SELECT *, first_value(i) OVER (PARTITION BY media_id ORDER BY score DESC, i) AS turn FROM r)
    SELECT media_id, frame, CASE WHEN i < least(floor(n * 0.25::DOUBLE + 0.5::DOUBLE), turn) THEN 1 WHEN i < greatest(n - floor(n * 0.2::DOUBLE + 0.5::DOUBLE), turn + 1) THEN 2 ELSE 3 END AS act FROM t""",
)
def win29(spark, d):
    return P.act_bounds(frames(spark, d).filter("event_type = 'click'").select("media_id", "frame", F.col("sharpness").alias("score")))


@query("win28_turn", f"SELECT media_id, frame FROM (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN every THEN shake ELSE sharpness END DESC, frame) AS rn FROM (SELECT *, bool_and(shake IS NOT NULL) OVER (PARTITION BY media_id) AS every FROM {FRAMES_SQL} f WHERE boundary)) WHERE rn = 1")
def win28(spark, d):
    from pyspark.sql import Window

    rows = frames(spark, d).filter("boundary").withColumn("every", F.every(F.col("shake").isNotNull()).over(Window.partitionBy("media_id")))
    value = F.when(F.col("every"), F.col("shake")).otherwise(F.col("sharpness"))
    return rows.withColumn("v", value).groupBy("media_id").agg(F.min_by("frame", F.struct(-F.col("v"), "frame")).alias("frame"))


CHOSEN = "SELECT o_orderkey AS rank, o_orderdate AS captured, o_custkey % 4 AS scene, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 END AS group_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 60 END AS person FROM {t}"


@query(
    "agg10_constraint_report",
    f"""WITH c AS ({CHOSEN.format(t='orders')}), s AS (SELECT *, lag(captured) OVER (ORDER BY rank) AS b, lag(scene) OVER (ORDER BY rank) AS sb FROM c)
    SELECT 'duplicates' AS "constraint", CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM c WHERE group_id IS NOT NULL GROUP BY group_id)) AS BIGINT) AS measured UNION ALL SELECT 'person_cap', (SELECT count(*) FROM (SELECT count(*) AS n FROM c WHERE person IS NOT NULL GROUP BY person) WHERE n > 3)
    UNION ALL SELECT 'out_of_order', (SELECT count(*) FROM s WHERE captured < b) UNION ALL SELECT 'adjacent_scene', (SELECT count(*) FROM s WHERE scene = sb)""",
)
def agg10(spark, d):
    return P.constraint_report(spark.sql(CHOSEN.format(t="{orders}"), orders=table(spark, d, "orders")), 3)


@query("win32_greedy_labels")
def win32(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 5).cast("long").alias("bucket"), F.col("vec_id").alias("ord"), F.slice("embedding", 1, 4).alias("x"))
    return P.greedy_labels(rows, 0.08)


@query("agg22_platt")
def agg22(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderpriority AS klass", "o_totalprice / 500000 AS x", "CASE WHEN o_totalprice / 500000 + (o_orderkey % 10) / 20 > 0.7 THEN 1 ELSE 0 END AS y")
    return P.platt_fit(rows, 200)


@query("win19_word_safe", f"""WITH w AS (SELECT media_id, min(frame) - 1 AS lo, max(frame) + 2 AS hi FROM (SELECT media_id, frame, frame - row_number() OVER (PARTITION BY media_id ORDER BY frame) AS g FROM {FRAMES_SQL} f WHERE speech) GROUP BY media_id, g),
    g AS (SELECT *, max(hi) OVER (PARTITION BY media_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w), i AS (SELECT *, sum(CASE WHEN lo <= r THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY lo, hi) AS k FROM g), m AS (SELECT media_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY media_id, k)
    SELECT f.media_id, f.frame, coalesce(min(m.hi), f.frame) AS safe FROM {FRAMES_SQL} f LEFT JOIN m ON m.media_id = f.media_id AND m.lo < f.frame AND f.frame < m.hi WHERE boundary GROUP BY 1, 2""")
def win19(spark, d):
    from ..operators.frames import runs

    f = frames(spark, d)
    words = runs(f, F.col("speech")).selectExpr("media_id", "lo - 1 AS lo", "hi + 1 AS hi")
    return P.word_safe(f.filter("boundary").select("media_id", "frame"), words, later=True)


@query("win17_snap_points", f"SELECT media_id, frame, kind FROM (SELECT media_id, frame, unnest([CASE WHEN boundary THEN 'shot' END, CASE WHEN motion - m >= 0.2::DOUBLE THEN 'motion_rise' END, CASE WHEN motion - m <= -0.2::DOUBLE THEN 'motion_fall' END, CASE WHEN abs(luma - l) >= 0.6::DOUBLE THEN 'light' END]) AS kind FROM (SELECT *, lag(motion) OVER w AS m, lag(luma) OVER w AS l FROM {FRAMES_SQL} f WINDOW w AS (PARTITION BY media_id ORDER BY frame))) WHERE kind IS NOT NULL")
def win17(spark, d):
    return P.snap_points(frames(spark, d))


@query("win21_classical_cuts", f"WITH x AS (SELECT media_id, frame, abs(luma - lag(luma) OVER (PARTITION BY media_id ORDER BY frame)) AS dd FROM {FRAMES_SQL} f), y AS (SELECT *, median(dd) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW) AS mid FROM x) SELECT media_id, frame FROM y WHERE dd >= 0.5::DOUBLE AND dd >= 1.5::DOUBLE * greatest(coalesce(mid, 0), 0.1::DOUBLE)")
def win21(spark, d):
    return P.classical_cuts(frames(spark, d), "luma", 0.5, 1.5, 0.1, 4)


def signatures(spark, d):
    """Two blocks of a picture for each frame: scenes that change now and then, with flashes, ringing and noise."""
    scene = "CAST(frame div 9 + media_id AS INT)"
    white = "CASE WHEN (frame + media_id) % 31 = 3 OR (frame + media_id) % 47 IN (5, 6) THEN 60.0D WHEN (frame + media_id) % 31 = 4 THEN 5.0D ELSE 0.0D END"
    parts = [f"CAST({scene} * {k} % 23 AS DOUBLE) + {white} + luma * {k} / 4" for k in (3, 5, 7, 2, 11, 13)]
    return frames(spark, d).selectExpr("media_id", "frame", f"array({', '.join(parts)}) AS signature")


CUTS = dict(high=8.0, low=5.0, ratio=3.0, floor=1.0, back=6.0, radius=5, near=1, merge=1, least=2, flash=2)


@query("win21_detect_cuts")
def win21_detect(spark, d):
    return P.detect_cuts(signatures(spark, d), **CUTS)


BOX = ("l_orderkey * 10 + l_linenumber AS id", "l_discount * 9 AS x", "l_tax * 10 AS y", "l_quantity / 200 AS w", "l_quantity / 100 AS h")


@query("vr03_face_findings", f"SELECT id, finding FROM (SELECT id, unnest([CASE WHEN x < 0.05::DOUBLE OR y < 0.05::DOUBLE OR x + w > 1 - 0.05::DOUBLE OR y + h > 1 - 0.05::DOUBLE THEN 'face_in_trim_zone' END, CASE WHEN x < 0.52::DOUBLE AND x + w > 0.48::DOUBLE THEN 'face_in_gutter' END]) AS finding FROM (SELECT {', '.join(BOX)} FROM lineitem)) WHERE finding IS NOT NULL")
def vr03(spark, d):
    return P.box_findings(table(spark, d, "lineitem").selectExpr(*BOX), 0.05, 0.02)


@query("vr00_rule_report", "SELECT r.rule, count(o.o_orderkey) AS ran, count(*) FILTER (WHERE o.o_totalprice <= 1000) AS failures, count(o.o_orderkey) > 0 AND count(*) FILTER (WHERE o.o_totalprice <= 1000) = 0 AS passed FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS rule) r LEFT JOIN orders o ON o.o_orderstatus = r.rule GROUP BY r.rule")
def vr00(spark, d):
    required = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in "FOPX"])).alias("rule"))
    results = table(spark, d, "orders").selectExpr("o_orderstatus AS rule", "o_totalprice > 1000 AS passed")
    return P.rule_report(required, results).toDF("rule", "ran", "failures", "passed")


CLIPS = "SELECT l_orderkey AS plan, l_linenumber AS place, max(l_linenumber * 10 - 10) AS start, max(CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE 10 END) AS length, max(l_partkey % 40) AS \"offset\", 45 AS available FROM {t} GROUP BY 1, 2"


@query("vr08_timeline", f"WITH c AS ({CLIPS.format(t='lineitem')}), e AS (SELECT *, coalesce(lag(start + length) OVER (PARTITION BY plan ORDER BY place), 0) AS expected FROM c) SELECT plan, place, finding FROM (SELECT plan, place, unnest([CASE WHEN start <> expected THEN 'gap_or_overlap' END, CASE WHEN \"offset\" + length > available THEN 'beyond_source' END]) AS finding FROM e) WHERE finding IS NOT NULL")
def vr08(spark, d):
    clips = spark.sql(CLIPS.format(t="{items}").replace('"', "`"), items=table(spark, d, "lineitem"))
    return P.timeline_findings(clips)
