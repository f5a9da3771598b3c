"""Store semantics as table operations: upserts, child replacement, cascades, constraints, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows together, of each key the one written last."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def replace_children(children: DataFrame, parent: str, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Children of touched parents go, fresh ones come."""
    return children.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def first_of_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in array order."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def partial_upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """New rows come in; on conflict only the ``updated`` columns take the new value, the others stay as they were."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key], F.lit(True).alias("arrived"))
    both = old.withColumn("stored", F.lit(True)).join(fresh, key, "full_outer")
    pick = lambda c: F.when(F.col("stored").isNull() | (F.col("arrived") & F.lit(c in updated)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(F.col(key), *[pick(c) for c in old.columns if c != key])


def insert_missing(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store does not hold yet, one for each key."""
    return arriving.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def cascade(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return children.join(gone.select(key), key, "left_anti")


def set_null(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """References to rows that are gone become null."""
    marks = gone.select(F.col(key).alias("gone_key")).distinct()
    return rows.join(marks, F.col(key) == F.col("gone_key"), "left").withColumn(key, F.when(F.col("gone_key").isNull(), F.col(key))).drop("gone_key")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that fails; a rule that is null does not fail."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(failed).alias("rule"))


def enforce(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, or an error that names the first rule broken; the check is part of a selected column."""
    out = rows
    for name, ok in rules.items():
        first = out.columns[0]
        out = out.withColumn(first, F.when(F.coalesce(ok, F.lit(True)), F.col(first)).otherwise(F.raise_error(F.lit(name)).cast(out.schema[first].dataType)))
    return out


def diff(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """added, changed or removed for each key that differs."""
    a = previous.select(F.col(key), F.struct(*fields).alias("was"), F.lit(True).alias("in_old"))
    b = current.select(F.col(key), F.struct(*fields).alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, status.alias("status")).filter("status IS NOT NULL")


def filename_time(name: Column) -> tuple[Column, Column]:
    """Timestamp text and precision that a file name gives: messenger names to the day, dated titles to the second."""
    day = F.regexp_extract(name, r"^(?:IMG|VID|AUD)-(\d{8})-WA\d+", 1)
    second = F.regexp_extract(name, r"^WhatsApp \w+ (\d{4}-\d{2}-\d{2} at \d{2}\.\d{2}\.\d{2})", 1)
    at = F.coalesce(F.try_to_timestamp(F.when(second != "", second), F.lit("yyyy-MM-dd 'at' HH.mm.ss")), F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd")))
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(at.isNull(), F.lit(None).cast("string")).when(second != "", "second").otherwise("day")


def chapters(files: DataFrame) -> DataFrame:
    """Chaptered recordings: chapter count, conflicts and completeness of each (family, recording) of two or more."""
    r = lambda i: F.regexp_extract("name", r"^(GH|GX|GP)(\d{2})(\d{4})\.MP4$", i)
    rows = files.select("name", r(1).alias("family"), r(2).cast("int").alias("chapter"), r(3).alias("recording")).filter("family <> ''")
    out = rows.groupBy("family", "recording").agg(
        F.count("*").alias("files"), F.count_distinct("chapter").alias("chapters"), F.min("chapter").alias("lo"), F.max("chapter").alias("hi")
    )
    return out.filter("files > 1").select("family", "recording", "files", (F.col("files") > F.col("chapters")).alias("conflict"), (F.col("hi") - F.col("lo") + 1 == F.col("chapters")).alias("complete"))


def timeline(members: DataFrame) -> DataFrame:
    """Offset of each member in its span: exclusive running sum of durations; all null if a duration is unknown."""
    span = Window.partitionBy("span_id")
    before = span.orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("duration").over(before), F.lit(0))
    whole = F.count("*").over(span) == F.count("duration").over(span)
    return members.select("span_id", "member", F.when(whole, offset).alias("offset"))


def proxies(records: DataFrame) -> DataFrame:
    """Rows of a JSON array column of proxies, in array order."""
    kind = "array<struct<proxy_id:string,kind:string>>"
    rows = records.select("media_id", F.posexplode(F.from_json("record", f"struct<proxies:{kind}>")["proxies"]).alias("pos", "p"))
    return rows.select("media_id", "pos", F.col("p.proxy_id").alias("proxy_id"), F.col("p.kind").alias("kind"))


def stage_times(log: DataFrame) -> DataFrame:
    """Seconds of each stage: from its last start to the first end after that; open stages have none."""
    last = log.filter("event = 'start'").groupBy("run", "stage").agg(F.max("us").alias("began"))
    ends = log.filter("event = 'done'").select("run", "stage", F.col("us").alias("ended"))
    rows = last.join(ends, ["run", "stage"], "left").filter("ended IS NULL OR ended >= began OR ended < began")
    first = rows.groupBy("run", "stage", "began").agg(F.min(F.when(F.col("ended") >= F.col("began"), F.col("ended"))).alias("ended"))
    return first.select("run", "stage", F.round((F.col("ended") - F.col("began")) / 1e6, 6).alias("seconds"))


def reclaim(jobs: DataFrame) -> DataFrame:
    """Jobs left running by a crash are pending again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))
