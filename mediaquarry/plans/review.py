from pyspark.sql import functions as F

from ..operators import review as R
from ..registry import query
from ..sources.tables import FRAMES_SQL, events, frames, table

C = "SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 500000 END AS score, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS person FROM {t}"


@query(
    "flt21_quality_floor",
    f"""WITH c AS ({C.format(t='orders')}), a AS (SELECT DISTINCT person FROM c WHERE score >= 0.6::DOUBLE), r AS (SELECT person FROM c WHERE person IS NOT NULL GROUP BY person HAVING count(*) < 8 AND person NOT IN (SELECT person FROM a WHERE person IS NOT NULL)),
    b AS (SELECT media_id FROM (SELECT media_id, row_number() OVER (PARTITION BY person ORDER BY score DESC, media_id) AS rn FROM c WHERE score IS NOT NULL AND person IN (SELECT person FROM r)) WHERE rn = 1)
    SELECT media_id, CASE WHEN score >= 0.6::DOUBLE THEN 'pass' WHEN media_id IN (SELECT media_id FROM b) THEN 'rescued' ELSE 'below' END AS verdict FROM c""",
)
def flt21(spark, d):
    return R.quality_floor(spark.sql(C.format(t="{orders}"), orders=table(spark, d, "orders")), 0.6, 8)


@query("clu09_decision_fold")
def clu09(spark, d):
    log = events(spark, d).selectExpr("user_id AS face", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'merge' WHEN 'error' THEN 'reject' ELSE 'revoke' END AS kind", "event_id % 4 AS person")
    return R.fold_decisions(log)


@query("clu03_shot_groups")
def clu03(spark, d):
    from pyspark.sql import Window

    from ..operators.frames import lookback_pairs

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, d).withColumn("frame", F.row_number().over(w)).selectExpr("user_id AS media_id", "frame", "event_id AS item", "us", "1 + event_id % 9 AS area")
    return R.shot_groups(lookback_pairs(rows, 8, 1800), rows.select("item", "area"), 2.0)


@query("clu18_box_suppression")
def clu18(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS image", "l_partkey * 10 + l_linenumber AS id", "l_discount * 5 AS x", "l_tax * 5 AS y", "0.4D AS w", "0.4D AS h", "l_quantity / 50 AS score")
    return R.box_suppression(rows, 0.45)


@query(
    "vr10_audit_cuts",
    """SELECT o_orderkey AS cut, unnest(list_filter([CASE WHEN o_custkey % 50 >= 40 THEN 'no_such_beat' END, CASE WHEN o_custkey % 50 < 40 AND (o_orderkey % 4 = 0) <> (o_custkey % 50 % 4 = 0) THEN 'downbeat_flag' END,
    CASE WHEN o_custkey % 50 < 40 AND abs((o_orderkey % 8) / 64 - (o_orderkey % 5) / 64) > 0.000001::DOUBLE THEN 'error_differs' END, CASE WHEN o_custkey % 50 < 40 AND (o_orderkey % 8) / 64 > 0.05::DOUBLE THEN 'beyond_gate' END], lambda x: x IS NOT NULL)) AS finding FROM orders""",
)
def vr10(spark, d):
    plan = table(spark, d, "orders").selectExpr("o_orderkey AS cut", "o_custkey % 50 AS beat", "(o_custkey % 50) / 2 + (o_orderkey % 8) / 64 AS at", "(o_orderkey % 5) / 64 AS error", "o_orderkey % 4 = 0 AS downbeat")
    beats = spark.range(40).selectExpr("id AS beat", "id / 2 AS seconds", "id % 4 = 0 AS downbeat")
    return R.audit_cuts(plan, beats, 0.05)


@query("vr05_bleed", "SELECT id, edge, finding FROM (SELECT l_orderkey * 10 + l_linenumber AS id, edge, CASE WHEN (edge = 'left' OR l_linenumber % 2 = 0) AND over < 3 THEN 'short_bleed' WHEN NOT (edge = 'left' OR l_linenumber % 2 = 0) AND over > 0 THEN 'undeclared_spill' END AS finding FROM (SELECT *, unnest(['left', 'right']) AS edge, unnest([l_quantity % 6, l_partkey % 4]) AS over FROM lineitem)) WHERE finding IS NOT NULL")
def vr05(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "map('left', l_quantity % 6, 'right', CAST(l_partkey % 4 AS DOUBLE)) AS overhang", "CASE WHEN l_linenumber % 2 = 0 THEN array('left', 'right') ELSE array('left') END AS declared")
    return R.bleed_findings(rows, 3.0)


# a frame 60 and more back weighs under 1e-18
@query(
    "win25_decayed_novelty",
    f"""SELECT f.media_id, f.frame, CASE WHEN count(g.luma) > 0 AND any_value(f.luma) IS NOT NULL THEN round(abs(any_value(f.luma) - sum(g.luma * power(0.5::DOUBLE, f.frame - g.frame)) / sum(CASE WHEN g.luma IS NOT NULL THEN power(0.5::DOUBLE, f.frame - g.frame) END)), 6) END AS novelty
    FROM {FRAMES_SQL} f LEFT JOIN {FRAMES_SQL} g ON g.media_id = f.media_id AND g.frame < f.frame AND g.frame >= f.frame - 60 GROUP BY 1, 2""",
)
def win25(spark, d):
    return R.decayed_novelty(frames(spark, d), "luma", 0.5)
