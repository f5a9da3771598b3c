"""Media-shaped views over the relational test tables, as expressions that Spark and plain SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEDIA = (
    "o_orderkey AS media_id",
    "o_custkey AS owner_id",
    "CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'video' ELSE 'audio' END AS kind",
    "CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate END AS captured",
    "CASE o_orderkey % 7 WHEN 0 THEN 'second' WHEN 1 THEN 'minute' WHEN 2 THEN 'hour' WHEN 3 THEN 'day' WHEN 4 THEN 'month' WHEN 5 THEN 'year' ELSE 'unknown' END AS time_precision",
    "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 500000 END AS aesthetic",
    "CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 100) / 100 END AS time_confidence",
    "o_orderkey % 13 = 0 AS excluded",
    "o_orderkey % 17 = 0 AS hidden",
    "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 END AS group_id",
    "o_orderkey % 6 = 0 AS is_primary",
    "o_orderpriority AS priority",
)
FACE_ROWS = (
    "l_orderkey * 10 + l_linenumber AS face_id",
    "l_orderkey AS media_id",
    "max(l_partkey) AS part",
    "max(l_suppkey) AS person",
    "max(l_returnflag) AS flag",
    "max(l_discount) * 10 AS confidence",
    "max(l_quantity) / 50 AS quality",
    "max(l_tax) * 10 AS smile",
)
FACES = (
    "face_id",
    "media_id",
    "CASE WHEN part % 9 <> 0 THEN person END AS person_id",
    "flag <> 'R' AND part % 9 <> 0 AS eligible",
    "confidence",
    "CASE WHEN media_id % 5 <> 0 THEN CAST(0.92 AS DOUBLE) END AS threshold",
    "CASE media_id % 4 WHEN 0 THEN 'unassigned' WHEN 1 THEN 'suggested' WHEN 2 THEN 'ambiguous' ELSE 'user_confirmed' END AS assignment",
    "quality",
    "smile",
    "CASE WHEN part % 4 <> 0 THEN smile END AS eyes_open",
    "quality / 2 AS area",
)
SIGNALS = (
    "p_partkey AS media_id",
    "p_size % 4 AS klass",
    "CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50 END AS sharpness",
    "CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 97) / 97 END AS exposure",
    "CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 89) / 89 END AS noise",
    "CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 83) / 83 END AS contrast",
    "CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 79) / 79 END AS technical_iqa",
    "CASE WHEN p_partkey % 8 <> 0 THEN (p_partkey % 73) / 73 END AS aesthetic",
    "CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 71) / 71 END AS composition",
    "CASE WHEN p_partkey % 2 <> 0 THEN (p_partkey % 67) / 67 END AS face_quality",
    "CASE p_partkey % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'none' ELSE 'not_run' END AS face_state",
    "p_partkey % 41 = 0 AS is_black_frame",
    "p_partkey % 43 = 0 AS is_lens_obstructed",
)
FRAMES = (
    "user_id AS media_id",
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame",
    "CASE WHEN event_id % 23 <> 0 THEN value / 500 END AS motion",
    "(event_id % 101) / 101 AS luma",
    "CASE WHEN event_id % 7 <> 0 THEN (event_id % 31) / 31 END AS shake",
    "(event_id % 53) / 53 AS sharpness",
    "event_type = 'view' AS speech",
    "event_id % 29 = 0 AS boundary",
    "event_type",
)


def text_of(exprs: tuple[str, ...], source: str, group: str = "") -> str:
    return f"SELECT {', '.join(exprs)} FROM {source}" + (f" GROUP BY {group}" if group else "")


MEDIA_SQL = f"({text_of(MEDIA, 'orders')})"
FACES_SQL = f"({text_of(FACES, '(' + text_of(FACE_ROWS, 'lineitem', 'l_orderkey, l_linenumber') + ') face_rows')})"
SIGNALS_SQL = f"({text_of(SIGNALS, 'part')})"
FRAMES_SQL = f"({text_of(FRAMES, 'events')})"
#: Events with their times as microseconds.
EVENTS_SQL = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*MEDIA)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(text_of(FACE_ROWS, "{lineitem}", "l_orderkey, l_linenumber"), lineitem=table(spark, sf_dir, "lineitem"))
    return rows.selectExpr(*FACES)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*SIGNALS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*FRAMES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", "props", "unix_micros(CAST(ts AS TIMESTAMP)) AS us")
