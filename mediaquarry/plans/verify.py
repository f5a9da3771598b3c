from pyspark.sql import functions as F

from ..operators import verify as Y
from ..registry import query
from ..sources.tables import table

CLASSES = ["bare", "explicit", "gore"]
SHA = "sha2(CAST({} AS STRING), 256)"


def both(text: str) -> tuple[str, str]:
    """A SELECT for Spark, and the same for the other engine."""
    return text, text.replace(SHA.split("{}")[0], "sha256(CAST(").replace(" AS STRING), 256)", " AS VARCHAR))").replace("array(", "list_value(")


MANIFESTS, MANIFESTS_SQL = both(
    """SELECT o_orderkey AS pub, o_orderkey % 41 <> 1 AS present, CASE WHEN o_orderkey % 43 = 2 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 47 <> 3 THEN '1.0.0' END AS schema,
    CASE o_custkey % 2 WHEN 0 THEN 'print' ELSE 'share' END AS sink, CASE WHEN o_orderkey % 37 = 4 THEN 'share' WHEN o_custkey % 2 = 0 THEN 'print' ELSE 'share' END AS wanted_sink,
    CASE WHEN o_orderkey % 53 = 5 THEN 'explicit,bare,gore' ELSE 'bare,explicit,gore' END AS class_order, CASE WHEN o_orderkey % 59 = 6 THEN 'development' WHEN o_orderkey % 61 = 7 THEN 'other' ELSE 'release' END AS load_mode,
    CASE WHEN o_orderkey % 67 <> 8 THEN 'm' END AS model, CASE WHEN o_orderkey % 71 = 9 THEN 'k' ELSE 'm' END AS wanted_model,
    CASE WHEN o_orderkey % 73 = 10 THEN 2.0 ELSE 0.9 END AS threshold_bare, 0.95 AS threshold_explicit, 1.0 AS threshold_gore, CASE WHEN o_orderkey % 79 = 11 THEN 0.5 ELSE 0.9 END AS wanted_bare, 0.95 AS wanted_explicit, 1.0 AS wanted_gore,
    o_orderkey % 17 <> 1 AS told, o_orderkey % 23 = 2 AS wrong, 'a' AS stated_id, CASE WHEN o_orderkey % 13 = 3 THEN 'b' ELSE 'a' END AS body_id FROM {t}"""
)
#: Numbers of items as the manifests tell them.
COUNTS = "SELECT pub, count(*) AS items, count_if(verdict = 'cleared') AS cleared, count_if(verdict = 'blocked') AS blocked, count_if(verdict = 'indeterminate') AS indeterminate FROM {t} GROUP BY pub"
LINES = "SELECT l_orderkey AS pub, l_linenumber AS place, CASE WHEN l_orderkey % 83 = 12 THEN 1 ELSE max(l_partkey) END AS media_id, max(l_partkey) AS k, max(l_suppkey) AS s FROM {t} GROUP BY 1, 2"
ITEMS, ITEMS_SQL = both(
    """SELECT pub, place, media_id, CASE WHEN k % 97 = 1 THEN 'odd' WHEN k % 89 = 2 THEN 'indeterminate' WHEN k % 83 = 3 THEN 'blocked' WHEN k % 41 >= 39 THEN 'blocked' ELSE 'cleared' END AS verdict,
    CASE WHEN k % 79 <> 4 THEN sha2(CAST(media_id AS STRING), 256) ELSE 'x' END AS evidence, CASE WHEN k % 73 <> 5 THEN (k % 41) / 41 END AS score_bare, (k % 31) / 41 AS score_explicit, (k % 7) / 41 AS score_gore,
    CASE WHEN k % 41 >= 39 AND s % 5 <> 0 OR k % 67 = 6 THEN CASE WHEN s % 7 = 1 THEN 'sink' ELSE 'item_and_sink' END END AS scope, CASE WHEN k % 41 >= 39 AND s % 5 <> 0 OR k % 67 = 6 THEN CASE WHEN s % 11 = 2 THEN ' ' ELSE 'me' END END AS decided_by,
    CASE WHEN k % 41 >= 39 AND s % 5 <> 0 OR k % 67 = 6 THEN 'then' END AS decided_at FROM {t} WHERE pub % 29 <> 13"""
)
PUBLISHED, PUBLISHED_SQL = both(
    "SELECT pub, CASE WHEN pub % 19 = 14 THEN 0 - place ELSE place END AS place, media_id, CASE WHEN k % 61 = 7 THEN 'old' WHEN k % 59 <> 8 THEN sha2(CAST(media_id AS STRING), 256) END AS evidence FROM {t} WHERE pub % 31 <> 15 AND NOT (pub % 11 = 4 AND place = 1)"
)
UNIT = " AND ".join(f"coalesce({{0}}_{c} BETWEEN 0 AND 1, false)" for c in CLASSES)


@query(
    "vr16_clearance",
    f"""WITH l AS ({LINES.format(t='lineitem')}), i AS ({ITEMS_SQL.format(t='l')}), p AS ({PUBLISHED_SQL.format(t='l')}), c AS ({COUNTS.format(t='i')}), m AS ({MANIFESTS_SQL.format(t='orders')}),
    a AS (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY place) AS n, count(*) OVER (PARTITION BY pub, media_id) AS copies FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY place) AS n FROM p),
    j AS (SELECT coalesce(a.pub, b.pub) AS pub, a.n AS n, b.n AS m, a.copies, a.verdict, a.scope, a.decided_by, a.decided_at, a.evidence, b.evidence AS wanted, {', '.join(f'score_{c}' for c in CLASSES)} FROM a FULL JOIN b ON a.pub = b.pub AND a.media_id = b.media_id),
    k AS (SELECT j.*, CASE WHEN n IS NULL THEN NULL WHEN verdict NOT IN ('cleared', 'blocked', 'indeterminate') THEN 'unknown_verdict' WHEN length(evidence) <> 64 OR wanted IS NULL THEN 'evidence_missing' WHEN evidence <> wanted THEN 'evidence_stale'
        WHEN verdict = 'indeterminate' THEN CASE WHEN scope IS NULL THEN 'indeterminate_item' ELSE 'override_on_indeterminate' END WHEN NOT ({UNIT.format('score')}) THEN 'scores_missing'
        WHEN ({' OR '.join(f'score_{c} >= threshold_{c}' for c in CLASSES)}) <> (verdict = 'blocked') THEN 'verdict_disagrees_with_scores' WHEN verdict = 'cleared' THEN CASE WHEN scope IS NOT NULL THEN 'override_on_cleared' END
        WHEN scope IS NULL THEN 'blocked_without_override' WHEN scope <> 'item_and_sink' THEN 'override_scope_invalid' WHEN trim(decided_by) = '' THEN 'override_unattributed' END AS code FROM j JOIN m ON m.pub = j.pub),
    s AS (SELECT pub, count(n) AS items, count(m) AS published, max(copies) AS copies, count(*) FILTER (WHERE n IS NULL OR m IS NULL) AS unmatched, count(*) FILTER (WHERE n <> m) AS moved, arg_min(code, n) FILTER (WHERE code IS NOT NULL) AS code, count(*) FILTER (WHERE verdict = 'blocked') AS blocked FROM k GROUP BY pub),
    o AS (SELECT m.pub, s.blocked, CASE WHEN NOT present THEN 'clearance_missing' WHEN version <> 1 THEN 'unknown_manifest_version' WHEN schema IS NULL THEN 'unknown_schema_version' WHEN sink <> wanted_sink THEN 'sink_mismatch' WHEN class_order <> '{','.join(CLASSES)}' THEN 'class_order_mismatch'
        WHEN load_mode = 'other' THEN 'unknown_load_mode' WHEN load_mode = 'development' THEN 'development_load_mode' WHEN model IS NULL THEN 'classifier_missing' WHEN model <> wanted_model THEN 'classifier_mismatch' WHEN threshold_bare > 1 THEN 'thresholds_missing' WHEN threshold_bare <> wanted_bare THEN 'threshold_mismatch'
        WHEN coalesce(s.items, 0) = 0 THEN 'items_missing' WHEN s.published = 0 THEN 'publication_empty' WHEN copies > 1 THEN 'duplicate_item' WHEN unmatched > 0 THEN 'item_set_mismatch' WHEN moved > 0 THEN 'item_order_mismatch' WHEN code IS NOT NULL THEN code
        WHEN NOT told THEN 'decision_missing' WHEN wrong THEN 'decision_disagrees_with_items' WHEN stated_id <> body_id THEN 'manifest_id_mismatch' END AS deny FROM m LEFT JOIN s ON s.pub = m.pub)
    SELECT pub, deny, CASE WHEN deny IS NULL THEN blocked ELSE 0 END AS overridden FROM o""",
)
def vr16_clearance(spark, d):
    lines = spark.sql(LINES.format(t="{x}"), x=table(spark, d, "lineitem"))
    items = spark.sql(ITEMS.format(t="{x}"), x=lines)
    manifests = spark.sql(MANIFESTS.format(t="{x}"), x=table(spark, d, "orders"))
    manifests = manifests.select("*", *[F.col(f"{k}_{c}").cast("double").alias(f"d_{k}_{c}") for k in ("threshold", "wanted") for c in CLASSES])
    manifests = manifests.drop(*[f"{k}_{c}" for k in ("threshold", "wanted") for c in CLASSES]).withColumnsRenamed({f"d_{k}_{c}": f"{k}_{c}" for k in ("threshold", "wanted") for c in CLASSES})
    counts = spark.sql(COUNTS.format(t="{x}"), x=items)
    decided = F.when(F.col("told"), F.struct((F.col("items") + F.col("wrong").cast("int")).alias("items"), "cleared", "blocked", "indeterminate", F.lit(True).alias("publish")))
    manifests = manifests.join(counts, "pub", "left").withColumn("decided", decided).drop("items", "cleared", "blocked", "indeterminate")
    return Y.clearance_denials(manifests, items, spark.sql(PUBLISHED.format(t="{x}"), x=lines), CLASSES)


REPLIES = "SELECT o_orderkey AS reply, CAST(o_custkey AS {s}) AS wanted_id, CASE WHEN o_orderkey % 13 = 1 THEN CAST(o_custkey + 1 AS {s}) WHEN o_orderkey % 17 <> 2 THEN ' ' || CAST(o_custkey AS {s}) END AS given_id, o_orderkey % 19 <> 3 AS has_items, 2 AS least, 6 AS most, 0 AS lo, 0.95 AS hi FROM {t}"
ANSWERS = "SELECT l_orderkey AS reply, CAST(l_linenumber AS INTEGER) AS position, CASE WHEN l_partkey % 23 = 4 THEN NULL WHEN l_partkey % 29 = 5 THEN 'img_' || CAST(l_partkey AS {s}) WHEN l_orderkey % 31 = 6 THEN 'IMG-1' WHEN l_partkey % 37 = 7 THEN 'none' ELSE 'IMG-' || CAST(l_partkey AS {s}) END AS id, CASE WHEN l_suppkey % 11 <> 8 THEN (l_partkey % 101) / 101 END AS score FROM {t}"
ALLOWED = "SELECT l_orderkey AS reply, 'IMG-' || CAST(l_partkey AS {s}) AS id FROM {t} WHERE l_partkey % 41 <> 9"
REPLY_SQL = f"""WITH r AS ({REPLIES.format(s='VARCHAR', t='orders')}), i AS ({ANSWERS.format(s='VARCHAR', t='lineitem')}), w AS (SELECT DISTINCT * FROM ({ALLOWED.format(s='VARCHAR', t='lineitem')})),
    e AS (SELECT r.*, coalesce(n, 0) AS n, CASE WHEN given_id IS NULL THEN 'request_id_missing' WHEN trim(given_id) <> wanted_id THEN 'request_mismatch' END AS c1, CASE WHEN NOT has_items THEN 'missing_items' WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < least OR n > most THEN 'count' END AS c2 FROM r LEFT JOIN (SELECT reply, count(*) AS n FROM i GROUP BY reply) q ON q.reply = r.reply),
    x AS (SELECT i.*, e.least, w.id IS NOT NULL AS known, EXISTS (SELECT 1 FROM w v WHERE v.reply = i.reply AND regexp_replace(lower(v.id), '[^a-z0-9]', '', 'g') = regexp_replace(lower(i.id), '[^a-z0-9]', '', 'g')) AS near, e.hi FROM i JOIN e ON e.reply = i.reply AND c1 IS NULL AND c2 IS NULL LEFT JOIN w ON w.reply = i.reply AND w.id = i.id),
    y AS (SELECT *, CASE WHEN id IS NULL THEN 'id_missing' WHEN NOT known THEN 'unknown_id' WHEN score IS NULL THEN 'score_missing' WHEN score > hi THEN 'score_out_of_range' END AS code FROM x),
    d AS (SELECT reply, id FROM y WHERE id IS NOT NULL GROUP BY reply, id HAVING count(*) > 1),
    f AS (SELECT reply, NULL::INTEGER AS position, c1 AS code, false AS near_miss FROM e WHERE c1 IS NOT NULL UNION ALL SELECT reply, NULL, c2, false FROM e WHERE c2 IS NOT NULL UNION ALL SELECT reply, position, code, code = 'unknown_id' AND near FROM y WHERE code IS NOT NULL UNION ALL SELECT reply, NULL, 'duplicate_id', false FROM d
        UNION ALL SELECT reply, NULL, 'too_few_usable', false FROM y WHERE reply NOT IN (SELECT reply FROM d) GROUP BY reply HAVING count(*) FILTER (WHERE code IS NULL) < max(least))"""


def replies(spark, d):
    asked = spark.sql(REPLIES.format(s="STRING", t="{x}"), x=table(spark, d, "orders"))
    answers = spark.sql(ANSWERS.format(s="STRING", t="{x}"), x=table(spark, d, "lineitem"))
    return asked, Y.reply_rejections(asked, answers, spark.sql(ALLOWED.format(s="STRING", t="{x}"), x=table(spark, d, "lineitem")))


@query("sc25_reply_rejections", f"{REPLY_SQL} SELECT reply, position, code, near_miss FROM f")
def sc25_rejections(spark, d):
    return replies(spark, d)[1]


@query("sc25_reply_status", f"{REPLY_SQL} SELECT r.reply, CASE WHEN count(f.code) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE f.position IS NULL) = 0 THEN 'partial' ELSE 'rejected' END AS status FROM r LEFT JOIN f ON f.reply = r.reply GROUP BY r.reply")
def sc25_status(spark, d):
    return Y.reply_status(*replies(spark, d))


SURVIVORS, SURVIVORS_SQL = both(
    """SELECT o_custkey AS album, o_orderkey AS media_id, CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey % 4 = 0 THEN o_orderkey ELSE o_orderkey % 1000 END END AS place, CASE WHEN o_custkey % 8 < 4 THEN o_orderkey WHEN o_orderkey % 50 <> 0 THEN o_orderkey % 1000 END AS captured,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 END AS scene, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 97 END AS group_id, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 4 <> 0 THEN CASE WHEN o_custkey % 5 < 2 THEN array(1, 1) WHEN o_custkey % 5 = 2 THEN array(o_orderkey % 3) ELSE array(o_orderkey % 5, o_orderkey % 3) END END AS people, (o_orderkey % 103) / 103 AS score FROM {t}"""
)


@query(
    "agg10_selection_constraints",
    f"""WITH v AS ({SURVIVORS_SQL.format(t='(SELECT DISTINCT o_orderkey, o_custkey FROM orders)')}), c AS (SELECT * FROM v WHERE place IS NOT NULL),
    s AS (SELECT album, captured < max(captured) OVER w OR (captured IS NOT NULL AND bool_or(captured IS NULL) OVER w) AS late, scene = lag(scene) OVER (PARTITION BY album ORDER BY place, media_id) AS again FROM c WINDOW w AS (PARTITION BY album ORDER BY place, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT album, count(*) FILTER (WHERE late) AS out_of_order, count(*) FILTER (WHERE again) AS repeats FROM s GROUP BY album), g AS (SELECT album, count(*) AS shared FROM (SELECT album FROM c WHERE group_id IS NOT NULL GROUP BY album, group_id HAVING count(*) > 1) GROUP BY album),
    p AS (SELECT album, media_id, place IS NOT NULL AS taken, unnest(list_distinct(people)) AS person FROM v), t AS (SELECT album, person, count(*) FILTER (WHERE taken) AS times FROM p GROUP BY 1, 2), b AS (SELECT album, max(times) AS busiest, count(*) FILTER (WHERE times = 0) AS uncovered FROM t GROUP BY album),
    h AS (SELECT album, count(*) AS held FROM (SELECT p.album, media_id FROM p JOIN t ON t.album = p.album AND t.person = p.person WHERE NOT taken GROUP BY 1, 2 HAVING max(times) >= 2) GROUP BY album),
    a AS (SELECT album, count(*) AS n, count(place) AS chosen, count(*) FILTER (WHERE place IS NOT NULL AND people IS NULL) AS scenery, least(1, count(*) FILTER (WHERE people IS NULL)) AS wanted, coalesce(max(score) FILTER (WHERE place IS NOT NULL), 0) AS best FROM v GROUP BY album),
    r AS (SELECT a.*, coalesce(out_of_order, 0) AS out_of_order, coalesce(repeats, 0) AS repeats, coalesce(shared, 0) AS shared, coalesce(busiest, 0) AS busiest, coalesce(uncovered, 0) AS uncovered, CASE WHEN chosen < 4 AND n > chosen AND held = n - chosen THEN 4 - chosen ELSE 0 END AS short_by FROM a LEFT JOIN o USING (album) LEFT JOIN g USING (album) LEFT JOIN b USING (album) LEFT JOIN h USING (album))
    SELECT album, 'no_near_duplicates_on_spread' AS name, shared::DOUBLE AS measured, 0::DOUBLE AS wanted, shared = 0 AS satisfied, uncovered, short_by FROM r UNION ALL SELECT album, 'max_per_person_per_section', busiest, 2, busiest <= 2 AND uncovered = 0 AND short_by = 0, uncovered, short_by FROM r
    UNION ALL SELECT album, 'chronological_within_section', out_of_order, 0, out_of_order = 0, uncovered, short_by FROM r UNION ALL SELECT album, 'no_consecutive_same_scene', repeats, 0, repeats = 0, uncovered, short_by FROM r
    UNION ALL SELECT album, 'people_scenery_detail_balance', scenery, wanted, scenery >= wanted, uncovered, short_by FROM r UNION ALL SELECT album, 'min_hero_quality', best, 0.98::DOUBLE, best >= 0.98::DOUBLE, uncovered, short_by FROM r""",
)
def agg10_constraints(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").distinct()
    return Y.selection_constraints(spark.sql(SURVIVORS.format(t="{x}"), x=orders), 4, 2, 0.25, 0.98)


PLANS, PLANS_SQL = both("SELECT o_orderkey AS plan, o_custkey % 2 = 0 AS film, CASE WHEN o_custkey % 5 <> 0 THEN 48 END AS most, -14 AS lufs, CASE WHEN o_custkey % 7 = 0 THEN -16 WHEN o_custkey % 3 = 0 THEN -14 END AS wanted_lufs, CASE WHEN o_custkey % 31 = 1 THEN 'x' ELSE sha2(CAST(o_orderkey AS STRING), 256) END AS digest FROM {t}")
DENSE = "SELECT pub, CAST(row_number() OVER (PARTITION BY pub ORDER BY place) AS INTEGER) AS place, k, s FROM {t}"
STEPS = """SELECT pub AS plan, place, CASE WHEN place = 3 AND pub % 3 = 0 THEN 'transition' WHEN place = 2 AND pub % 5 = 1 THEN 'gap' ELSE 'clip' END AS kind, CASE WHEN NOT (place = 3 AND pub % 3 = 0) THEN k END AS source,
    CASE WHEN place > 3 AND pub % 3 = 0 THEN 10 * (place - 2) ELSE 10 * (place - 1) END AS start, CASE WHEN s % 29 = 5 THEN 9 ELSE 10 END AS length, k % 23 AS "offset", CASE WHEN s % 19 = 2 THEN 8 END AS tail, k % 9 AS out_offset, s % 5 AS in_offset,
    CASE WHEN k % 3 = 1 THEN (s % 13 - 6) * 9.5 END AS lock_error_ms, CASE WHEN pub % 2 = 0 THEN CASE WHEN k % 61 = 1 THEN 1 ELSE 0 END END AS words FROM {t}"""
SOURCES = "SELECT p_partkey AS source, CASE WHEN p_partkey % 17 = 0 THEN 3 ELSE 0 END AS lo, 30 + p_size AS hi FROM {t} WHERE p_partkey % 53 <> 0"
ARC = "SELECT pub AS plan, s % 2 = 0 AS required, CASE WHEN k % 67 = 1 THEN 0 ELSE 1 END AS clips FROM {t}"
CUES = "SELECT pub AS plan, place - 4 AS cue, k % 50 AS source, k % 47 <> 3 AS cleared FROM {t} WHERE place IN (5, 6)"
CLAIMS = "SELECT pub AS plan, CASE WHEN k % 43 = 5 AND place = 6 THEN 1 ELSE place - 4 END AS cue, CASE WHEN k % 59 = 4 THEN place - 1 ELSE place END AS clip FROM {t} WHERE place IN (5, 6) AND k % 53 <> 2"
MUSIC = "SELECT pub AS plan, place AS clip, CASE WHEN s % 41 = 1 THEN 99 ELSE k % 50 END AS source FROM {t} WHERE place IN (5, 6)"
CHECKS_SQL = f"""WITH l0 AS ({LINES.format(t='lineitem')}), l AS ({DENSE.format(t='l0')}), p AS ({PLANS_SQL.format(t='orders')}), i AS (SELECT x.*, lo, hi FROM ({STEPS.format(t='l')}) x LEFT JOIN ({SOURCES.format(t='part')}) y ON y.source = x.source), q AS ({CUES.format(t='l')}), w AS ({CLAIMS.format(t='l')}), u AS ({MUSIC.format(t='l')}),
    g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'gap' THEN length END) OVER (PARTITION BY plan ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps FROM i),
    c AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'clip' THEN start + length - gaps END IGNORE NULLS) OVER (PARTITION BY plan ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gaps AS cursor FROM g),
    t AS (SELECT t.plan, CASE WHEN coalesce(a.kind = 'clip' AND b.kind = 'clip' AND a.hi IS NOT NULL AND b.hi IS NOT NULL, false) THEN CAST(a."offset" + a.length + t.out_offset > a.hi AS INTEGER) + CAST(b."offset" - t.in_offset < b.lo AS INTEGER) ELSE 1 END AS bad FROM i t LEFT JOIN i a ON a.plan = t.plan AND a.place = t.place - 1 LEFT JOIN i b ON b.plan = t.plan AND b.place = t.place + 1 WHERE t.kind = 'transition'),
    s AS (SELECT plan, count(*) FILTER (WHERE hi IS NULL) AS unknown, count(*) FILTER (WHERE "offset" < lo OR "offset" + length + coalesce(tail, 0) > hi) AS escapes, count(*) FILTER (WHERE start <> cursor) AS moved, count(lock_error_ms) AS locks, count(*) FILTER (WHERE abs(lock_error_ms) > 50) AS off_beat, count(words) AS heard, sum(coalesce(words, 0)) AS in_word, max(start + length) AS frames FROM c WHERE kind = 'clip' GROUP BY plan),
    m AS (SELECT coalesce(u.plan, k.plan) AS plan, count(*) AS n FROM u FULL JOIN (SELECT w.plan, w.clip, count(*) AS n, list(q.source) AS licensed FROM w JOIN q ON q.plan = w.plan AND q.cue = w.cue GROUP BY 1, 2) k ON k.plan = u.plan AND k.clip = u.clip WHERE k.n IS NULL OR u.source IS NULL OR k.n > 1 OR NOT list_contains(licensed, u.source) GROUP BY 1),
    z AS (SELECT p.*, s.* EXCLUDE (plan), (SELECT count(*) FROM t WHERE t.plan = p.plan) AS steps, (SELECT sum(bad) FROM t WHERE t.plan = p.plan) AS handles, (SELECT count(*) FROM q WHERE q.plan = p.plan) AS cues, (SELECT count(*) FROM q WHERE q.plan = p.plan AND NOT cleared) AS uncleared,
        (SELECT count(*) FROM q WHERE q.plan = p.plan AND NOT EXISTS (SELECT 1 FROM w WHERE w.plan = q.plan AND w.cue = q.cue)) AS idle, coalesce(m.n, 0) AS misplaced, (SELECT count(*) FROM ({ARC.format(t='l')}) a WHERE a.plan = p.plan AND required AND clips = 0) AS open_beats FROM p LEFT JOIN s ON s.plan = p.plan LEFT JOIN m ON m.plan = p.plan),
    f AS (SELECT plan, 'references' AS name, 'error' AS severity, coalesce(unknown, 0) AS failures FROM z UNION ALL SELECT plan, 'source_range', 'error', coalesce(escapes, 0) FROM z UNION ALL SELECT plan, 'contiguous', 'error', coalesce(moved, 0) FROM z UNION ALL SELECT plan, 'handles', 'error', handles FROM z WHERE steps > 0
        UNION ALL SELECT plan, 'beat_tolerance', 'error', off_beat FROM z WHERE NOT film AND locks > 0 UNION ALL SELECT plan, 'mid_word', 'warning', in_word FROM z WHERE heard > 0 UNION ALL SELECT plan, 'max_duration', 'error', CAST(coalesce(frames, 0) > most AS INTEGER) FROM z WHERE most IS NOT NULL
        UNION ALL SELECT plan, 'licence', 'error', uncleared FROM z WHERE cues > 0 UNION ALL SELECT plan, 'cues_placed_once', 'error', misplaced + idle FROM z WHERE film AND cues > 0 UNION ALL SELECT plan, 'story_beats', 'error', open_beats FROM z
        UNION ALL SELECT plan, 'loudness', 'warning', CAST(coalesce(lufs <> wanted_lufs, false) AS INTEGER) FROM z UNION ALL SELECT plan, 'digest', 'error', CAST(length(digest) <> 64 AS INTEGER) FROM z)"""


def checks(spark, d):
    lines = spark.sql(LINES.format(t="{x}"), x=table(spark, d, "lineitem"))
    lines = spark.sql(DENSE.format(t="{x}"), x=lines)
    of = lambda text, rows: spark.sql(text.replace('"', "`").format(t="{x}"), x=rows)
    parts = [of(PLANS, table(spark, d, "orders")), of(STEPS, lines), of(SOURCES, table(spark, d, "part")), *[of(x, lines) for x in (ARC, CUES, CLAIMS, MUSIC)]]
    return Y.plan_checks(*parts, 50.0)


@query("vr09_plan_checks", f"{CHECKS_SQL} SELECT plan, name, severity, CAST(failures AS BIGINT) AS failures, failures = 0 AS passed FROM f")
def vr09(spark, d):
    return checks(spark, d)


@query("vr08_plan_status", f"{CHECKS_SQL} SELECT plan, CASE WHEN count(*) FILTER (WHERE failures > 0 AND severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE failures > 0) > 0 THEN 'warn' ELSE 'pass' END AS status FROM f GROUP BY plan")
def vr08_status(spark, d):
    return Y.plan_status(checks(spark, d))


@query(
    "vr15_clearance_problems",
    f"""WITH l AS ({LINES.format(t='lineitem')}), i AS ({ITEMS_SQL.format(t='l')}), m AS ({MANIFESTS_SQL.format(t='orders')}), c AS (SELECT pub, count(*) AS n, count(DISTINCT media_id) AS different, count(*) FILTER (WHERE verdict = 'cleared') AS a, count(*) FILTER (WHERE verdict = 'blocked') AS b, count(*) FILTER (WHERE verdict = 'indeterminate') AS x,
    count(*) FILTER (WHERE verdict = 'indeterminate' OR verdict = 'blocked' AND scope IS NULL) AS u FROM i GROUP BY pub), j AS (SELECT m.pub, sink, load_mode, wrong, told, coalesce(n, 0) AS n, coalesce(different, 0) AS different, coalesce(u, 0) AS u FROM m LEFT JOIN c ON c.pub = m.pub)
    SELECT pub, problem FROM (SELECT pub, unnest([CASE WHEN wrong THEN 'item_count' END, CASE WHEN wrong THEN 'blocked_count' END, CASE WHEN different < n THEN 'duplicate_media' END, CASE WHEN told AND u > 0 THEN 'cleared_while_unresolved' END, CASE WHEN NOT told AND u = 0 THEN 'denied_without_cause' END, CASE WHEN told AND load_mode = 'development' THEN 'development_cleared' END]) AS problem FROM j) WHERE problem IS NOT NULL""",
)
def vr15_clearance(spark, d):
    items = spark.sql(ITEMS.format(t="{x}"), x=spark.sql(LINES.format(t="{x}"), x=table(spark, d, "lineitem")))
    more, zero = F.col("wrong").cast("int"), F.lit(0)
    rows = spark.sql(MANIFESTS.format(t="{x}"), x=table(spark, d, "orders")).join(spark.sql(COUNTS.format(t="{x}"), x=items), "pub", "left")
    decided = F.struct((F.coalesce("items", zero) + more).alias("items"), F.coalesce("cleared", zero).alias("cleared"), (F.coalesce("blocked", zero) + more).alias("blocked"), F.coalesce("indeterminate", zero).alias("indeterminate"), F.col("told").alias("publish"))
    return Y.clearance_problems(rows.select("pub", "sink", "load_mode", decided.alias("decided")), items.select("pub", "media_id", "verdict", F.col("scope").isNotNull().alias("overridden")))


PREFERENCES = """SELECT o_orderkey AS event, o_custkey % 5 AS subject, CASE o_custkey % 3 WHEN 0 THEN 'variant_picked' WHEN 1 THEN 'recropped' ELSE 'kept' END AS kind, o_orderkey % 37 = 1 AS pixels, o_orderkey % 2 = 0 AS shareable, CASE WHEN o_custkey % 11 <> 2 THEN 'c' END AS consent, CASE WHEN o_custkey % 13 <> 3 THEN o_custkey % 7 = 4 END AS local_ids,
    CASE o_custkey % 17 WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'v' END AS anonymised, CASE WHEN o_custkey % 19 = 7 THEN 2 END AS people, CASE WHEN o_custkey % 23 = 8 THEN 't' END AS instruction, 'f' AS features, CASE WHEN o_orderkey % 5 <> 1 THEN 1 END AS crop_before, CASE WHEN o_orderkey % 7 <> 2 THEN 1 END AS crop_after, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 9 END AS n_dense, 4 AS n_named FROM {t}"""
ALTERNATIVES = "SELECT l_orderkey AS event, l_partkey % 5 AS subject, l_linenumber = 1 OR l_partkey % 29 = 1 AS chosen, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 50 END AS rank, CASE WHEN l_partkey % 31 = 3 THEN 'g' WHEN l_partkey % 31 <> 4 THEN 'f' END AS features FROM {t}"


@query(
    "vr15_preference_problems",
    f"""WITH e AS ({PREFERENCES.format(t='orders')}), a AS ({ALTERNATIVES.format(t='lineitem')}), s AS (SELECT event, count(*) AS n, count(*) FILTER (WHERE chosen) AS n_chosen, min(subject) FILTER (WHERE chosen) AS picked, count(rank) > count(DISTINCT rank) AS same_rank, bool_or(features = 'g') AS other FROM a GROUP BY event), j AS (SELECT e.*, coalesce(n, 0) AS n, n_chosen, picked, same_rank, other FROM e LEFT JOIN s ON s.event = e.event)
    SELECT event, problem FROM (SELECT event, unnest([CASE WHEN pixels THEN 'pixels' END, CASE WHEN shareable AND consent IS NULL THEN 'no_consent' END, CASE WHEN shareable AND coalesce(local_ids, true) THEN 'local_identifiers' END, CASE WHEN shareable AND coalesce(anonymised, '') = '' THEN 'not_anonymised' END, CASE WHEN shareable AND people > 0 THEN 'names_people' END, CASE WHEN shareable AND instruction IS NOT NULL THEN 'free_text' END,
        CASE WHEN n > 0 AND n_chosen <> 1 THEN 'not_one_chosen' END, CASE WHEN n_chosen = 1 AND picked <> subject THEN 'chosen_is_not_subject' END, CASE WHEN same_rank THEN 'shared_rank' END, CASE WHEN other THEN 'other_feature_set' END, CASE WHEN kind = 'variant_picked' AND n = 0 THEN 'no_alternatives' END, CASE WHEN kind = 'recropped' AND (crop_before IS NULL OR crop_after IS NULL) THEN 'no_crop' END, CASE WHEN n_dense <> n_named THEN 'dense_length' END]) AS problem FROM j) WHERE problem IS NOT NULL""",
)
def vr15_preference(spark, d):
    events = spark.sql(PREFERENCES.format(t="{x}"), x=table(spark, d, "orders"))
    return Y.preference_problems(events, spark.sql(ALTERNATIVES.format(t="{x}"), x=table(spark, d, "lineitem")))
