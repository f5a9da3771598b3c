"""Selection, identity and release gates: decision tables, standings within groups and measured constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def rare_moments(items: DataFrame, seconds: float) -> DataFrame:
    """Items with no neighbour within the time; the ends count as far apart."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    far = lambda gap: F.coalesce(gap > seconds * 1e6, F.lit(True))
    rows = items.withColumn("rare", far(F.col("us") - F.lag("us").over(w)) & far(F.lead("us").over(w) - F.col("us")))
    return rows.filter("rare").select("event_id")


def dominated(rows: DataFrame, group: str, key: str, margins: dict[str, float]) -> DataFrame:
    """Members that another of their group beats beyond the margin on some axis and nowhere loses to.

    Groups are shots, a handful of frames each.
    """
    a = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), *[F.col(c).alias(f"a_{c}") for c in margins])
    b = rows.select(F.col(group).alias("h"), F.col(key).alias("l"), *[F.col(c).alias(f"b_{c}") for c in margins])
    wins = F.lit(False)
    loses = F.lit(False)
    for c, m in margins.items():
        wins = wins | F.coalesce(F.col(f"b_{c}") - F.col(f"a_{c}") > m, F.lit(False))
        loses = loses | F.coalesce(F.col(f"b_{c}") < F.col(f"a_{c}"), F.lit(False))
    return a.join(b, (F.col("g") == F.col("h")) & (F.col("k") != F.col("l")) & wins & ~loses, "left_semi").select(F.col("k").alias(key))


def calibrated_redundancy(vectors: DataFrame, sample: int) -> DataFrame:
    """Upper median of the similarities within a stride sample of at most ``sample`` vectors."""
    from .vectors import dot, norm

    n = vectors.agg(F.count("*").alias("n"))
    rows = numbered(vectors.select("vec_id"), F.col("vec_id"), [], "i").withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(n))
    stride = F.greatest(F.floor(F.col("n") / sample), F.lit(1))
    ids = rows.filter((F.col("i") % stride == 0) & (F.col("i") / stride < sample)).select("vec_id")
    picked = vectors.select("vec_id", "embedding").join(F.broadcast(ids), "vec_id")
    b = picked.select(F.col("vec_id").alias("other"), F.col("embedding").alias("oe"))
    sims = picked.join(b, F.col("vec_id") < F.col("other")).select((dot(F.col("embedding"), F.col("oe")) / (norm(F.col("embedding")) * norm(F.col("oe")))).alias("s"))
    ranked = sims.withColumn("rn", F.row_number().over(Window.orderBy("s"))).withColumn("m", F.count("*").over(Window.partitionBy()))
    return ranked.filter(F.col("rn") == F.floor(F.col("m") / 2) + 1).select(F.round("s", 6).alias("redundancy"))


def identity_decision(best: Column, second: Column, quality: Column, confirmed: Column, embedded: Column, review: float, automatic: float, margin: float, least_quality: float) -> Column:
    """The first rule that applies, from a confirmed person to automatic assignment."""
    return (
        F.when(confirmed, "user_confirmed")
        .when(~embedded, "no_embedding")
        .when(best.isNull(), "no_gallery")
        .when(best < review, "unassigned")
        .when(F.coalesce(best - second < margin, F.lit(False)), "ambiguous")
        .when(F.coalesce(quality < least_quality, F.lit(False)), "suggested")
        .when(best >= automatic, "auto_high_confidence")
        .otherwise("suggested")
    )


def review_items(rows: DataFrame, limit: int) -> DataFrame:
    """Questions by what an answer settles: affected faces times nearness, halved and so on by deferrals."""
    value = F.round(F.col("affected") * F.col("proximity") / (1 + F.col("deferrals")), 6)
    return rows.withColumn("informativeness", value).orderBy(F.desc("informativeness"), "item_id").limit(limit)


def clearance(items: DataFrame, by: str) -> DataFrame:
    """Counts by verdict, unknown verdicts as indeterminate, and the all-or-nothing decision."""
    known = F.coalesce(F.col("verdict"), F.lit("indeterminate"))
    out = items.groupBy(by).agg(
        F.count("*").alias("items"), F.count_if(known == "cleared").alias("cleared"), F.count_if(known == "blocked").alias("blocked"), F.count_if(~known.isin("cleared", "blocked")).alias("indeterminate")
    )
    return out.withColumn("publishable", (F.col("items") > 0) & (F.col("cleared") == F.col("items")))


def manifest_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Positions and ids that differ: missing, extra, moved or duplicate."""
    e = expected.groupBy("id").agg(F.min("pos").alias("want"))
    a = actual.groupBy("id").agg(F.min("pos").alias("have"), F.count("*").alias("n"))
    both = e.join(a, "id", "full_outer")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(F.col("want") != F.col("have"), "order")
    return both.select("id", kind.alias("difference")).filter("difference IS NOT NULL")


def category_gate(cases: DataFrame, drop: float, share: float) -> DataFrame:
    """Category means over comparable cases, the share that regressed, and whether the category holds."""
    rows = cases.filter("baseline IS NOT NULL AND candidate IS NOT NULL")
    lost = F.col("baseline") - F.col("candidate") > drop
    out = rows.groupBy("category").agg(F.count("*").alias("cases"), F.avg("baseline").alias("b"), F.avg("candidate").alias("c"), F.avg(lost.cast("double")).alias("r"))
    return out.select("category", "cases", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), F.round("r", 6).alias("regressed"), ((F.col("b") - F.col("c") <= drop) & (F.col("r") <= share)).alias("holds"))


def overall_gate(cases: DataFrame) -> DataFrame:
    """Mean of category means and mean of all cases."""
    rows = cases.filter("candidate IS NOT NULL")
    per = rows.groupBy("category").agg(F.avg("candidate").alias("m"), F.sum("candidate").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"))


def repeat_spread(samples: DataFrame, least: int, tolerance: float) -> DataFrame:
    """Spread of a case's repeats and what it says."""
    out = samples.groupBy("case_id").agg(F.count("*").alias("repeats"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))
    status = F.when(F.col("repeats") < least, "too_few").when(F.col("spread") > tolerance, "nondeterministic").otherwise("stable")
    return out.withColumn("status", status)


def cluster_finalise(members: DataFrame, threshold: float) -> DataFrame:
    """Size, distance of each member to its cluster's spherical centre, and membership strength (null for singletons)."""
    long = members.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    centre = long.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    length = Window.partitionBy("label")
    centre = centre.select("label", "pos", (F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(length))).alias("m"))
    size = members.groupBy("label").agg(F.count("*").alias("size"))
    rows = long.join(centre, ["label", "pos"]).groupBy("vec_id", "label").agg((1 - F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("d"))
    strength = F.when(F.col("size") > 1, F.round(F.greatest(F.least(1 - F.col("d") / threshold, F.lit(1.0)), F.lit(0.0)), 6))
    return rows.join(size, "label").select("vec_id", "label", "size", F.round("d", 6).alias("distance"), strength.alias("strength"))


def track_representative(faces: DataFrame, track: str) -> DataFrame:
    """The best face of each track, unmeasured quality last, ties by id."""
    w = Window.partitionBy(track).orderBy(F.desc(F.coalesce("quality", F.lit(-1.0))), "face_id")
    return faces.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(track, "face_id")


def review_groups(faces: DataFrame, group: str, priority: list[str]) -> DataFrame:
    """One question for each group: its most pressing reason and how many faces it affects."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("assignment"))
    return faces.filter(rank > 0).groupBy(group).agg(F.min_by("assignment", rank).alias("reason"), F.count("*").alias("affected"))


def page_gaps(pages: DataFrame) -> DataFrame:
    """Albums whose page numbers are not exactly 0 to n - 1."""
    out = pages.groupBy("album").agg(F.count("*").alias("pages"), F.count_distinct("page").alias("different"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    return out.filter((F.col("lo") != 0) | (F.col("hi") != F.col("pages") - 1) | (F.col("different") != F.col("pages"))).select("album", "pages")


def first_deny(rules: list[tuple[str, Column]]) -> Column:
    """The first deny code that applies; a test that is null denies, for absence is no pass."""
    out = None
    for code, test in rules:
        test = F.coalesce(test, F.lit(True))
        out = F.when(test, code) if out is None else out.when(test, code)
    return out
