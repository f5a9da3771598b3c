from pyspark.sql import functions as F

from ..operators import album as A
from ..operators import frames as N
from ..operators import planning as P
from ..operators import review as R
from ..operators import vectors as V
from ..registry import query
from ..sources.tables import frames, table

POLICY = A.Policy(size=12, person_cap=4)


def candidates(spark, d):
    """Orders as photos of events of customers, some with the vector of their number."""
    rows = table(spark, d, "orders").selectExpr(
        "o_custkey % 40 AS event", "o_orderkey AS media_id", "CAST(o_totalprice AS DOUBLE) / 500000 AS score", "o_orderkey % 6 AS time", "o_custkey % 5 AS place", "o_orderkey % 9 AS moment",
        "o_orderkey % 13 AS shot", "o_orderkey % 7 AS family", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 8 END AS pose",
        "CASE WHEN o_orderkey % 4 <> 0 THEN array(o_orderkey % 5, o_custkey % 7) END AS people", "o_orderkey % 10 = 1 AS sleeping", "o_orderkey % 97 = 0 AS pinned", "o_orderkey % 29 = 0 AS dominated",
    )
    vectors = table(spark, d, "embeddings").selectExpr("vec_id AS media_id", "embedding")
    return rows.join(vectors, "media_id", "left")


@query("clu12_constrained_selection")
def clu12_constrained(spark, d):
    return A.constrained_selection(candidates(spark, d), POLICY)


PARTS = "SELECT p_partkey AS media_id, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey // 6 END AS group_id, p_size AS standing, p_retailprice AS quality, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 100 END AS width, p_size * 80 AS height FROM part"
SLOTS = "SELECT l_partkey AS media_id, l_orderkey AS page, min(l_quantity) / 4 AS slot_width, min(l_quantity) / 5 AS slot_height FROM {t} WHERE l_partkey % 2 = 0 GROUP BY 1, 2"


@query(
    "jn17_selection_report",
    f"""WITH c AS ({PARTS}), k AS (SELECT media_id AS carrier, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY standing DESC, media_id) AS rn FROM c WHERE media_id % 3 = 0 AND group_id IS NOT NULL) WHERE rn = 1),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY page) AS rn FROM ({SLOTS.format(t='lineitem')})) WHERE rn = 1)
    SELECT carrier, c.media_id, CAST(row_number() OVER (PARTITION BY carrier ORDER BY quality DESC, c.media_id) AS INTEGER) AS rank, page,
    CASE WHEN slot_width IS NULL THEN 'no_slot' WHEN width IS NULL THEN 'no_size' WHEN least(width / slot_width, height / slot_height) >= 300 THEN 'fits' ELSE 'too_small' END AS fit
    FROM c JOIN k USING (group_id) LEFT JOIN s ON s.media_id = carrier WHERE c.media_id % 3 <> 0""",
)
def jn17(spark, d):
    rows = spark.sql(PARTS.replace("//", "div").replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    slots = spark.sql(SLOTS.format(t="{items}"), items=table(spark, d, "lineitem"))
    return A.selection_report(rows, rows.filter("media_id % 3 = 0"), slots, 300.0)


COS = "1 - list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"


@query(
    "clu10_merge_questions",
    f"""WITH r AS (SELECT vec_id, label, label * 1000000 + vec_id // 20 AS cluster, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 10 < 2),
    p AS (SELECT x.cluster AS a, y.cluster AS b, max(round({COS}, 6)) AS linkage, bool_or((x.vec_id + y.vec_id) % 17 = 0) AS known FROM r x JOIN r y ON x.label = y.label AND x.cluster < y.cluster GROUP BY 1, 2)
    SELECT a, b, linkage, round(1 - (linkage - 0.85::DOUBLE) / 0.15::DOUBLE, 6) AS proximity FROM p WHERE NOT known AND linkage > 0.85 AND linkage <= 1.0""",
)
def clu10_merge(spark, d):
    reps = table(spark, d, "embeddings").filter("vec_id % 10 < 2").selectExpr("vec_id", "label", "label * 1000000 + vec_id div 20 AS cluster", "embedding")
    near = V.pairs_within(reps, 1.0, "label")
    return R.merge_questions(reps.select("vec_id", "cluster"), near, near.filter("(a + b) % 17 = 0"), 0.85, 0.15)


RULES = {
    "trim": "l_discount * 9 >= 0.05 AND l_tax * 10 >= 0.05 AND l_discount * 9 + l_quantity / 200 <= 0.95 AND l_tax * 10 + l_quantity / 100 <= 0.95",
    "gutter": "NOT (l_discount * 9 < 0.52 AND l_discount * 9 + l_quantity / 200 > 0.48)",
    "bleed": "l_quantity % 6 >= 3",
    "resolution": "l_partkey % 400 >= 20",
    "source": "l_partkey % 50 <> 7",
    "colour": "true",
}


@query("clu17_print_report", "SELECT rule, count(*) AS ran, count(*) FILTER (WHERE NOT ok) AS failures, bool_and(ok) AS passed FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, {v} AS ok FROM lineitem" for k, v in RULES.items()) + ") GROUP BY rule UNION ALL SELECT 'pages', 0, 0, false")
def clu17(spark, d):
    required = [*RULES, "pages"]
    return P.composed_report(table(spark, d, "lineitem"), {k: F.expr(v) for k, v in RULES.items()}, required)


@query("clu19_moment_records")
def clu19(spark, d):
    return N.plan_moments(frames(spark, d), width=4, hop=2, apart=6, pull=2)
