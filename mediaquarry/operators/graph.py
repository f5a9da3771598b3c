"""Graphs as link tables: connected components by minimum labels with pointer jumping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark) -> str:
    """A folder of this application in spark.checkpoint.dir; where that is unset, in the warehouse, which executors share too.

    In local mode alone, where there is no other machine, a temporary folder serves; it goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local"):
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="mediaquarry-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        where = _OWN[app]
    return f"{(where or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/mediaquarry-{app}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the folder that all executors share and reads it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark) -> None:
    """Deletes all tables that this application staged, once their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (id, label), the smallest id of each component; rounds end when no label moves."""
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("near"))
        far = labels.toDF("label", "far")
        new = labels.join(near, "id", "left").join(far, "label", "left").select("id", F.least("label", "near", "far").alias("next"), "label")
        new = stage(new, "labels")
        labels = new.select("id", F.col("next").alias("label"))
        if not new.filter("next <> label").limit(1).count():
            return labels
