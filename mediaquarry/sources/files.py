"""File sources: recursive listings, content sniffing, metadata times, frame indexes and verified artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes of the formats that are told apart, as hex digits with any-byte dots.
MAGIC = (
    ("png", "^89504e470d0a1a0a"),
    ("gif", "^474946383[79]61"),
    ("bmp", "^424d"),
    ("webp", "^52494646.{8}57454250"),
    ("avi", "^52494646.{8}41564920"),
    ("wav", "^52494646.{8}57415645"),
    ("tiff", "^(49492a00|4d4d002a)"),
    ("iso_bmff", "^.{8}66747970"),
    ("jpeg", "^ffd8ff"),
    ("matroska", "^1a45dfa3"),
    ("flac", "^664c6143"),
    ("mp3", "^(494433|fff[23ab])"),
)


def walk(spark: SparkSession, path: str, include_hidden: bool = False) -> DataFrame:
    """Files below a folder: path, length, modificationTime; hidden names are left out.  Contents are not read.

    Spark's reader passes over files of no bytes.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return rows if include_hidden else rows.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def with_content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def sniff(content: Column) -> Column:
    """Format by leading bytes, never by name; null where none fits."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def quarantine(files: DataFrame) -> DataFrame:
    """Every file with its format and the reason it is held back, if any; nothing is dropped."""
    kind = sniff(F.col("content"))
    reason = F.when(F.col("length") == 0, "zero_bytes").when(kind.isNull(), "unknown_format").when(F.col("length") < 16, "truncated")
    return files.select("path", "length", kind.alias("format"), reason.alias("quarantine"))


def offset_minutes(text: Column) -> Column:
    """Minutes of an explicit UTC offset; null for blank or out-of-range ones (beyond 18 hours), never 0."""
    m = lambda i: F.regexp_extract(text, r"^([+-])(\d{2}):?(\d{2})$", i)
    minutes = m(2).try_cast("int") * 60 + m(3).try_cast("int")
    return F.when((m(1) != "") & (minutes <= 18 * 60), F.when(m(1) == "-", -minutes).otherwise(minutes))


def exif_utc(local: Column, offset: Column) -> Column:
    """UTC text of an EXIF local time, only where the offset is explicit."""
    at = F.try_to_timestamp(local, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(at) - offset_minutes(offset) * 60), "yyyy-MM-dd HH:mm:ss")


def frame_index(lines: DataFrame) -> DataFrame:
    """Frames of an index of JSON lines (value: text), and whether their times lie on one grid."""
    from pyspark.sql import Window

    rows = lines.select("media_id", F.from_json("value", "struct<frame:long,pts:long>").alias("j")).select("media_id", "j.frame", "j.pts")
    rows = rows.withColumn("step", F.col("pts") - F.lag("pts").over(Window.partitionBy("media_id").orderBy("frame")))
    return rows.groupBy("media_id").agg(F.count("*").alias("frames"), F.min("step").alias("step"), F.coalesce(F.min("step") == F.max("step"), F.lit(True)).alias("uniform"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artefacts whose size, SHA-256 and JSON are as declared; others with the first reason against them."""
    rows = manifest.join(files.select("path", "length", "content"), "path", "left")
    text = F.decode("content", "UTF-8")
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("byte_size"), "size").when(F.sha2("content", 256) != F.col("sha256"), "digest").when(F.try_parse_json(text).isNull(), "json")
    return rows.select("path", reason.alias("unreadable"))
