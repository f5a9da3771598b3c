from pyspark.sql import functions as F

from ..operators import selection as G
from ..registry import query
from ..sources.tables import FACES_SQL, faces, table

VEC = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query("clu04_dominated", "WITH r AS (SELECT p_partkey AS id, p_partkey // 6 AS shot, p_size / 50 AS a, (p_partkey % 7) / 7 AS b FROM part) SELECT id FROM r WHERE EXISTS (SELECT 1 FROM r o WHERE o.shot = r.shot AND o.id <> r.id AND (o.a - r.a > 0.1::DOUBLE OR o.b - r.b > 0.2::DOUBLE) AND NOT (o.a < r.a OR o.b < r.b))")
def clu04(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "p_partkey div 6 AS shot", "p_size / 50 AS a", "(p_partkey % 7) / 7 AS b")
    return G.dominated(rows, "shot", "id", {"a": 0.1, "b": 0.2})


@query(
    "clu11_redundancy",
    f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, greatest(count(*) OVER () // 48, 1) AS st FROM {VEC} v) WHERE i % st = 0 AND i / st < 48),
    s AS (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM p a JOIN p b ON a.vec_id < b.vec_id)
    SELECT round(s, 6) AS redundancy FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS m FROM s) WHERE rn = m // 2 + 1""",
)
def clu11(spark, d):
    return G.calibrated_redundancy(table(spark, d, "embeddings"), 48)


RULE = "CASE WHEN assignment = 'user_confirmed' THEN 'user_confirmed' WHEN part9 THEN 'no_embedding' WHEN confidence < 0.6 THEN 'unassigned' WHEN confidence - smile < 0.05 THEN 'ambiguous' WHEN quality < 0.35 THEN 'suggested' WHEN confidence >= 0.92 THEN 'auto_high_confidence' ELSE 'suggested' END"


@query("clu08_identity_decision", f"SELECT face_id, {RULE.replace('0.05', '0.05::DOUBLE').replace('0.6 ', '0.6::DOUBLE ').replace('0.35', '0.35::DOUBLE').replace('0.92', '0.92::DOUBLE')} AS decision FROM (SELECT *, person_id IS NULL AS part9 FROM {FACES_SQL} f)")
def clu08(spark, d):
    x = faces(spark, d)
    rule = G.identity_decision(F.col("confidence"), F.col("smile"), F.col("quality"), F.col("assignment") == "user_confirmed", F.col("person_id").isNotNull(), 0.6, 0.92, 0.05, 0.35)
    return x.select("face_id", rule.alias("decision"))


@query("top05_review_items", "SELECT o_orderkey AS item_id, round(o_custkey * (o_totalprice / 500000) / (1 + o_orderkey % 4), 6) AS informativeness FROM orders ORDER BY 2 DESC, 1 LIMIT 50")
def top05(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS item_id", "o_custkey AS affected", "o_totalprice / 500000 AS proximity", "o_orderkey % 4 AS deferrals")
    return G.review_items(rows, 50).select("item_id", "informativeness")


@query("agg11_clearance", """WITH v AS (SELECT d.source, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'cleared' WHEN quality = 0 THEN 'odd' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT source, count(*) AS items, count(*) FILTER (WHERE verdict = 'cleared') AS cleared, count(*) FILTER (WHERE verdict = 'blocked') AS blocked, count(*) FILTER (WHERE verdict IS NULL OR verdict = 'odd') AS indeterminate, count(*) FILTER (WHERE verdict = 'cleared') = count(*) AS publishable FROM v GROUP BY source""")
def agg11(spark, d):
    labels = table(spark, d, "labels")
    v = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "cleared").when(F.col("quality") == 0, "odd")
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select("source", v.alias("verdict"))
    return G.clearance(rows, "source")


@query("jn18_manifest_differences", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 <> 0 THEN 'extra' WHEN o_orderkey % 3 <> 0 THEN 'missing' ELSE 'order' END AS difference FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND NOT (o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0)")
def jn18(spark, d):
    o = table(spark, d, "orders")
    want = o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "o_orderkey AS pos")
    have = o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS pos")
    return G.manifest_differences(want, have)


CASES = "SELECT o_orderpriority AS category, o_orderkey AS case_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 500000 END AS baseline, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 500000 - (o_orderkey % 10) / 200 END AS candidate FROM {t}"


def cases(spark, d):
    return spark.sql(CASES.format(t="{orders}"), orders=table(spark, d, "orders"))


@query("agg12_category_gate", f"SELECT category, count(*) AS cases, round(avg(baseline), 6) AS baseline, round(avg(candidate), 6) AS candidate, round(avg(CASE WHEN baseline - candidate > 0.0301::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS regressed, avg(baseline) - avg(candidate) <= 0.0301::DOUBLE AND avg(CASE WHEN baseline - candidate > 0.0301::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= 0.5::DOUBLE AS holds FROM ({CASES.format(t='orders')}) c WHERE baseline IS NOT NULL AND candidate IS NOT NULL GROUP BY category")
def agg12(spark, d):
    return G.category_gate(cases(spark, d), 0.0301, 0.5)


@query("agg12_overall", f"SELECT round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM (SELECT avg(candidate) AS m, sum(candidate) AS s, count(*) AS n FROM ({CASES.format(t='orders')}) c WHERE candidate IS NOT NULL GROUP BY category)")
def agg12b(spark, d):
    return G.overall_gate(cases(spark, d))


@query("agg13_repeat_spread", "SELECT l_orderkey AS case_id, count(*) AS repeats, round(max(l_discount) - min(l_discount), 6) AS spread, CASE WHEN count(*) < 3 THEN 'too_few' WHEN round(max(l_discount) - min(l_discount), 6) > 0.05::DOUBLE THEN 'nondeterministic' ELSE 'stable' END AS status FROM lineitem GROUP BY l_orderkey")
def agg13(spark, d):
    return G.repeat_spread(table(spark, d, "lineitem").selectExpr("l_orderkey AS case_id", "l_discount AS value"), 3, 0.05)


@query(
    "clu06_cluster_members",
    """WITH x AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY 1, 2),
    c AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM m), d AS (SELECT vec_id, x.label, 1 - sum(x * m) / sqrt(sum(x * x)) AS d FROM x JOIN c ON c.label = x.label AND c.pos = x.pos GROUP BY 1, 2)
    SELECT vec_id, d.label, size, round(d, 6) AS distance, CASE WHEN size > 1 THEN round(greatest(least(1 - d / 0.9::DOUBLE, 1), 0), 6) END AS strength FROM d JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) s ON s.label = d.label""",
)
def clu06(spark, d):
    return G.cluster_finalise(table(spark, d, "embeddings"), 0.9)


@query("clu07_track_representative", f"SELECT media_id, face_id FROM (SELECT media_id, face_id, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(eyes_open, -1) DESC, face_id) AS rn FROM {FACES_SQL} f) WHERE rn = 1")
def clu07(spark, d):
    return G.track_representative(faces(spark, d).select("media_id", "face_id", F.col("eyes_open").alias("quality")), "media_id")


@query("clu10_review_groups", f"SELECT person_id, CASE min(CASE assignment WHEN 'ambiguous' THEN 1 WHEN 'suggested' THEN 2 ELSE 3 END) WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'suggested' ELSE 'unassigned' END AS reason, count(*) AS affected FROM {FACES_SQL} f WHERE assignment IN ('ambiguous', 'suggested', 'unassigned') GROUP BY person_id")
def clu10(spark, d):
    return G.review_groups(faces(spark, d), "person_id", ["ambiguous", "suggested", "unassigned"])


@query("vr02_unresolvable_sources", "SELECT l_orderkey AS placement, l_partkey AS source FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)")
def vr02(spark, d):
    have = table(spark, d, "part").filter("p_partkey % 10 <> 0").selectExpr("p_partkey AS source")
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS placement", "l_partkey AS source").join(have, "source", "left_anti").select("placement", "source")


@query("vr07_page_gaps", "SELECT l_orderkey AS album, count(*) AS pages FROM lineitem GROUP BY 1 HAVING min(l_linenumber - 1) <> 0 OR max(l_linenumber - 1) <> count(*) - 1 OR count(DISTINCT l_linenumber) <> count(*)")
def vr07(spark, d):
    return G.page_gaps(table(spark, d, "lineitem").selectExpr("l_orderkey AS album", "l_linenumber - 1 AS page"))


@query("vr06_colour_profile", "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE regexp_replace(lower(l_returnflag || ' ' || l_linestatus), '[^a-z0-9]', '', 'g') <> 'no'")
def vr06(spark, d):
    name = F.regexp_replace(F.lower(F.concat("l_returnflag", F.lit(" "), "l_linestatus")), "[^a-z0-9]", "")
    return table(spark, d, "lineitem").filter(name != "no").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query("vr16_first_deny", f"SELECT face_id, CASE WHEN person_id IS NULL THEN 'no_person' WHEN coalesce(eyes_open < 0.2::DOUBLE, true) THEN 'eyes_unverified' WHEN NOT eligible THEN 'not_eligible' END AS deny FROM {FACES_SQL} f")
def vr16(spark, d):
    rules = [("no_person", F.col("person_id").isNull()), ("eyes_unverified", F.col("eyes_open") < 0.2), ("not_eligible", ~F.col("eligible"))]
    return faces(spark, d).select("face_id", G.first_deny(rules).alias("deny"))
