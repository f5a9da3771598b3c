from pyspark.sql import functions as F

from ..operators import frames as N
from ..registry import query
from ..sources.tables import EVENTS_SQL, FRAMES_SQL, events, frames

RUNS = "(SELECT media_id, min(frame) AS lo, max(frame) + 1 AS hi FROM (SELECT media_id, frame, frame - row_number() OVER (PARTITION BY media_id ORDER BY frame) AS g FROM {f} f WHERE {mask}) GROUP BY media_id, g)"
STILL = RUNS.format(f=FRAMES_SQL, mask="motion <= 0.02")
CLEAN = RUNS.format(f=FRAMES_SQL, mask="luma > 0.02 AND (shake IS NULL OR shake < 0.55)")
SPEECH = RUNS.format(f=FRAMES_SQL, mask="speech")
SHOTS = f"(SELECT media_id, min(frame) AS lo, max(frame) + 1 AS hi FROM (SELECT media_id, frame, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame) AS s FROM {FRAMES_SQL} f) GROUP BY media_id, s)"
HOPS = f"(SELECT DISTINCT media_id, s AS lo, s + 4 AS hi FROM (SELECT media_id, unnest(list_append(range(lo, hi - 4 + 1, 2), hi - 4)) AS s FROM {CLEAN} c WHERE hi - lo >= 4))"


def clean(spark, d):
    return N.runs(frames(spark, d), (F.col("luma") > 0.02) & (F.col("shake").isNull() | (F.col("shake") < 0.55)))


@query("win11_runs", f"SELECT media_id, lo, hi FROM {STILL} r")
def win11(spark, d):
    return N.runs(frames(spark, d), F.col("motion") <= 0.02)


@query("win12_dead_time", f"SELECT r.media_id, lo, hi FROM {STILL} r JOIN {FRAMES_SQL} f ON f.media_id = r.media_id AND frame >= lo AND frame < hi WHERE hi - lo >= 2 GROUP BY ALL HAVING avg(CASE WHEN speech THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= 0.2::DOUBLE")
def win12(spark, d):
    return N.dead_time(frames(spark, d), 2)


@query("win13_frame_elimination", f"SELECT media_id, frame, list_filter([CASE WHEN luma <= 0.02 THEN 'black' END, CASE WHEN shake >= 0.55 THEN 'shaky' END, CASE WHEN motion <= 0.02 THEN 'still' END], lambda x: x IS NOT NULL) AS reasons FROM {FRAMES_SQL} f")
def win13(spark, d):
    return N.elimination(frames(spark, d))


@query("jn11_segments_in_shots", f"SELECT a.media_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM {CLEAN} a JOIN {SHOTS} b ON a.media_id = b.media_id WHERE greatest(a.lo, b.lo) < least(a.hi, b.hi)")
def jn11(spark, d):
    return N.segments_in_shots(clean(spark, d), N.shots(frames(spark, d)))


@query("win14_hopping_windows", f"SELECT media_id, lo, hi FROM {HOPS} h")
def win14(spark, d):
    return N.hopping(clean(spark, d), 4, 2)


@query(
    "agg08_covered_aggregate",
    f"""SELECT h.media_id, lo, hi, CASE WHEN count(motion) >= ceil(0.5::DOUBLE * (hi - lo)) THEN round(avg(motion), 6) END AS mean, CASE WHEN count(motion) >= ceil(0.5::DOUBLE * (hi - lo)) THEN round(max(motion), 6) END AS most, CASE WHEN count(motion) >= ceil(0.5::DOUBLE * (hi - lo)) THEN round(min(motion), 6) END AS least
    FROM {HOPS} h LEFT JOIN {FRAMES_SQL} f ON f.media_id = h.media_id AND frame >= lo AND frame < hi GROUP BY h.media_id, lo, hi""",
)
def agg08(spark, d):
    return N.covered_aggregate(frames(spark, d), N.hopping(clean(spark, d), 4, 2), "motion")


@query("win15_suppress")
def win15(spark, d):
    scored = N.covered_aggregate(frames(spark, d), N.hopping(clean(spark, d), 4, 2), "sharpness")
    return N.suppress(scored.filter("mean IS NOT NULL").selectExpr("media_id", "lo", "hi", "mean AS score"), 6)


MAX = "max(motion) OVER (PARTITION BY media_id ORDER BY frame RANGE BETWEEN {a} AND {b})"


@query("win16_local_maxima", f"SELECT media_id, frame, motion FROM (SELECT *, {MAX.format(a='3 PRECEDING', b='1 PRECEDING')} AS b, {MAX.format(a='1 FOLLOWING', b='3 FOLLOWING')} AS a FROM {FRAMES_SQL} f) WHERE motion IS NOT NULL AND coalesce(motion > b, true) AND coalesce(motion >= a, true)")
def win16(spark, d):
    return N.local_maxima(frames(spark, d), "motion", 3).select("media_id", "frame", "motion")


WORDS = f"(SELECT media_id, lo - 1 AS lo, hi + 1 AS hi FROM {SPEECH} s)"


def words(spark, d):
    return N.runs(frames(spark, d), F.col("speech")).selectExpr("media_id", "lo - 1 AS lo", "hi + 1 AS hi")


@query("jn12_inside_word", f"SELECT media_id, frame, s.lo AS lo, s.hi AS hi FROM (SELECT f.media_id, f.frame, min({{'lo': w.lo, 'hi': w.hi}}) AS s FROM {FRAMES_SQL} f JOIN {WORDS} w ON f.media_id = w.media_id AND w.lo < f.frame AND f.frame < w.hi WHERE f.boundary GROUP BY 1, 2)")
def jn12(spark, d):
    return N.inside_word(frames(spark, d).filter("boundary").select("media_id", "frame"), words(spark, d))


BEATS = f"(SELECT media_id, frame FROM {FRAMES_SQL} f WHERE event_type = 'click')"


@query("jn13_nearest_beat", f"SELECT media_id, frame, beat FROM (SELECT p.media_id, p.frame, b.frame AS beat, row_number() OVER (PARTITION BY p.media_id, p.frame ORDER BY abs(b.frame - p.frame), b.frame) AS rn FROM {FRAMES_SQL} p JOIN {BEATS} b ON b.media_id = p.media_id WHERE p.boundary) WHERE rn = 1")
def jn13(spark, d):
    f = frames(spark, d)
    return N.nearest_beat(f.filter("boundary").select("media_id", "frame"), f.filter("event_type = 'click'")).filter("beat IS NOT NULL")


@query("jn14_beats_between", f"SELECT s.media_id, s.lo, count(b.frame) AS beats FROM {SHOTS} s LEFT JOIN {BEATS} b ON b.media_id = s.media_id AND b.frame >= s.lo AND b.frame < s.hi GROUP BY 1, 2")
def jn14(spark, d):
    f = frames(spark, d)
    b = f.filter("event_type = 'click'").select(F.col("media_id").alias("m"), F.col("frame").alias("beat"))
    s = N.shots(f)
    rows = s.join(b, (F.col("media_id") == F.col("m")) & (F.col("beat") >= F.col("lo")) & (F.col("beat") < F.col("hi")), "left")
    return rows.groupBy("media_id", "lo").agg(F.count("beat").alias("beats"))


@query("win18_best_snap", f"SELECT media_id, frame, snap FROM (SELECT t.media_id, t.frame, p.frame AS snap, row_number() OVER (PARTITION BY t.media_id, t.frame ORDER BY round(p.sharpness - 0.25::DOUBLE * abs(p.frame - t.frame), 9) DESC, abs(p.frame - t.frame), p.frame) AS rn FROM {FRAMES_SQL} t JOIN {FRAMES_SQL} p ON p.media_id = t.media_id AND p.frame BETWEEN t.frame - 3 AND t.frame + 3 WHERE t.boundary) WHERE rn = 1")
def win18(spark, d):
    f = frames(spark, d)
    return N.best_snap(f.filter("boundary").select("media_id", "frame"), f.selectExpr("media_id", "frame", "sharpness AS strength"), 3)


BLEND = "CASE WHEN shake IS NULL THEN round((sharpness * 0.5::DOUBLE + 0 + luma * 0.2::DOUBLE) / (0.5::DOUBLE + 0.2::DOUBLE), 9) ELSE round((sharpness * 0.5::DOUBLE + (1 - shake) * 0.3::DOUBLE + luma * 0.2::DOUBLE) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE), 9) END"


@query("win20_representative", f"SELECT media_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY {BLEND} DESC, frame) AS rn FROM {FRAMES_SQL} f) WHERE rn = 1")
def win20(spark, d):
    return N.representative(frames(spark, d))


@query("win22_loudness", f"SELECT media_id, frame, round(greatest(least(CASE WHEN q > 0 THEN 10 * log10(q) ELSE -80 END, 0), -80), 6) AS db FROM (SELECT media_id, frame, avg(sharpness * sharpness) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS q FROM {FRAMES_SQL} f)")
def win22(spark, d):
    return N.loudness(frames(spark, d), "sharpness", 3)


LOUD = f"(SELECT media_id, frame, CASE WHEN q IS NOT NULL THEN greatest(least(CASE WHEN q > 0 THEN 10 * log10(q) ELSE -80 END, 0), -80) END AS db FROM (SELECT media_id, frame, avg(sharpness * sharpness) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS q FROM {FRAMES_SQL} f))"


@query("win23_silence_runs", f"SELECT media_id, min(frame) AS lo, max(frame) + 1 AS hi FROM (SELECT media_id, frame, frame - row_number() OVER (PARTITION BY media_id ORDER BY frame) AS g FROM {LOUD} l WHERE round(db, 6) < -7) GROUP BY media_id, g HAVING max(frame) + 1 - min(frame) >= 2")
def win23_silence(spark, d):
    return N.silence_runs(N.loudness(frames(spark, d), "sharpness", 1), -7.0, 2)


@query("win23_loudness_rises", f"SELECT media_id, count(*) FILTER (WHERE sharpness - p >= 0.25::DOUBLE) AS rises FROM (SELECT *, lag(sharpness) OVER (PARTITION BY media_id ORDER BY frame) AS p FROM {FRAMES_SQL} f) GROUP BY media_id")
def win23(spark, d):
    return N.rises(frames(spark, d), "sharpness", 0.25)


@query("win24_exposure_stability", f"SELECT media_id, frame, round(greatest(1 - stddev_pop(luma) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 0.1::DOUBLE, 0), 6) AS stability FROM {FRAMES_SQL} f")
def win24(spark, d):
    return N.exposure_stability(frames(spark, d), 4)


@query("win26_tempo_anomalies", f"SELECT media_id, frame, i AS interval, round(60 / i, 6) AS bpm FROM (SELECT *, median(i) OVER (PARTITION BY media_id) AS mid FROM (SELECT media_id, frame, lead(frame) OVER (PARTITION BY media_id ORDER BY frame) - frame AS i FROM {BEATS} b) WHERE i IS NOT NULL) WHERE i > mid * 1.5 OR i * 1.5 < mid")
def win26(spark, d):
    return N.tempo_anomalies(frames(spark, d).filter("event_type = 'click'").select("media_id", "frame"))


@query("win27_merge_ranges", f"SELECT media_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY lo, hi) AS g FROM (SELECT media_id, lo, hi, max(hi) OVER (PARTITION BY media_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {WORDS} w)) GROUP BY media_id, g")
def win27(spark, d):
    return N.merge_ranges(words(spark, d))


@query("win30_acts", f"SELECT media_id, frame, role FROM (SELECT media_id, frame, CASE WHEN rn = 1 THEN 'hook' WHEN rn = 2 THEN 'peak' WHEN frame = max(CASE WHEN rn > 2 THEN frame END) OVER (PARTITION BY media_id) THEN 'button' END AS role FROM (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id ORDER BY sharpness DESC, frame) AS rn FROM {FRAMES_SQL} f WHERE boundary)) WHERE role IS NOT NULL")
def win30(spark, d):
    return N.acts(frames(spark, d).filter("boundary"), "sharpness")


@query("win09_rare_moments", f"SELECT event_id FROM (SELECT event_id, coalesce(us - lag(us) OVER w > 40000000000, true) AND coalesce(lead(us) OVER w - us > 40000000000, true) AS rare FROM {EVENTS_SQL} e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE rare")
def win09(spark, d):
    from ..operators.selection import rare_moments

    return rare_moments(events(spark, d), 40_000)


@query("jn10_lookback_pairs", f"WITH o AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM {EVENTS_SQL} e) SELECT a.event_id AS item, b.event_id AS earlier FROM o a JOIN o b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 8 AND a.n - 1 AND a.us - b.us <= 3600000000")
def jn10(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, d).withColumn("frame", F.row_number().over(w)).selectExpr("user_id AS media_id", "frame", "event_id AS item", "us")
    return N.lookback_pairs(rows, 8, 3600)
