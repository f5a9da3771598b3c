"""Verification: clearances of publications, replies of a model against their request, measured selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_code(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that is true, null where none is; a rule that is null does not apply."""
    return F.coalesce(*[F.when(test, code) for code, test in rules])


def in_unit(x: Column) -> Column:
    return F.coalesce(x.between(0, 1) & ~F.isnan(x), F.lit(False))


def clearance_denials(manifests: DataFrame, items: DataFrame, published: DataFrame, classes: list[str], development: bool = False) -> DataFrame:
    """pub, deny (the first code against each publication, null where it may go out) and overridden (its items let through).

    manifests: pub, present, version, schema, sink, wanted_sink, class_order (joined by commas), load_mode, model,
    wanted_model, decided (struct of items, cleared, blocked, indeterminate, publish), stated_id, body_id, and for each
    class a threshold_ and a wanted_ column.  items: pub, place, media_id, verdict, evidence, a score_ column for each
    class, scope, decided_by, decided_at (all null: no override).  published: pub, place, media_id, evidence.
    What a manifest says is never trusted: verdicts, counts and the decision are worked out again.  Whatever is
    missing denies.
    """
    number = F.row_number().over(Window.partitionBy("pub").orderBy("place", "media_id"))
    copies = F.count("*").over(Window.partitionBy("pub", "media_id"))
    stated = items.select("*", number.alias("n"), copies.alias("copies"), F.lit(True).alias("stated"))
    wanted = published.select("pub", "media_id", F.col("evidence").alias("wanted_evidence"), number.alias("m"))
    limits = manifests.select("pub", *[f"threshold_{c}" for c in classes])
    rows = stated.join(wanted, ["pub", "media_id"], "full").join(limits, "pub")

    override = F.coalesce("scope", "decided_by", "decided_at").isNotNull()
    hex64 = F.coalesce(F.col("evidence").rlike("^[0-9a-f]{64}$"), F.lit(False))
    scored = in_unit(F.col(f"score_{classes[0]}"))
    fired = F.lit(False)
    for c in classes:
        scored &= in_unit(F.col(f"score_{c}"))
        fired |= F.col(f"score_{c}") >= F.col(f"threshold_{c}")
    verdict = F.col("verdict")
    blocked = verdict == "blocked"
    code = first_code(
        ("unknown_verdict", ~F.coalesce(verdict.isin("cleared", "blocked", "indeterminate"), F.lit(False))),
        ("evidence_missing", ~hex64 | F.col("wanted_evidence").isNull()),
        ("evidence_stale", F.col("wanted_evidence") != F.col("evidence")),
        ("override_on_indeterminate", (verdict == "indeterminate") & override),
        ("indeterminate_item", verdict == "indeterminate"),
        ("scores_missing", ~scored),
        ("verdict_disagrees_with_scores", fired != blocked),
        ("blocked_without_override", blocked & ~override),
        ("override_scope_invalid", blocked & ~F.col("scope").eqNullSafe("item_and_sink")),
        ("override_unattributed", blocked & ((F.trim(F.coalesce("decided_by", F.lit(""))) == "") | F.col("decided_at").isNull())),
        ("override_on_cleared", override & ~blocked),
    )
    own = F.col("stated").isNotNull()
    sums = rows.withColumn("code", F.when(own, code)).groupBy("pub").agg(
        F.count("n").alias("n_items"),
        F.count("m").alias("n_published"),
        F.max(F.coalesce("copies", F.lit(1))).alias("copies"),
        F.count_if(F.col("n").isNull() | F.col("m").isNull()).alias("unmatched"),
        F.count_if(F.col("n") != F.col("m")).alias("moved"),
        F.min(F.when(F.col("code").isNotNull(), F.struct("n", "code")))["code"].alias("item_code"),
        *[F.count_if(own & (verdict == v)).alias(f"n_{v}") for v in ("cleared", "blocked", "indeterminate")],
    )
    rows = manifests.join(sums, "pub", "left")
    number_of = lambda name: F.coalesce(name, F.lit(0))
    told = F.col("decided")
    as_told = told["items"].eqNullSafe(F.col("n_items")) & told["publish"].eqNullSafe(F.lit(True))
    for v in ("cleared", "blocked", "indeterminate"):
        as_told &= told[v].eqNullSafe(F.col(f"n_{v}"))
    limits_known, as_wanted = F.lit(True), F.lit(True)
    for c in classes:
        limits_known &= in_unit(F.col(f"threshold_{c}"))
        as_wanted &= F.col(f"wanted_{c}").isNull() | F.col(f"threshold_{c}").eqNullSafe(F.col(f"wanted_{c}"))
    deny = first_code(
        ("clearance_missing", ~F.coalesce("present", F.lit(False))),
        ("unknown_manifest_version", ~F.col("version").eqNullSafe(1)),
        ("unknown_schema_version", ~F.col("schema").eqNullSafe("1.0.0")),
        ("sink_mismatch", ~F.col("sink").eqNullSafe(F.col("wanted_sink"))),
        ("class_order_mismatch", ~F.col("class_order").eqNullSafe(",".join(classes))),
        ("unknown_load_mode", ~F.coalesce(F.col("load_mode").isin("release", "development"), F.lit(False))),
        ("development_load_mode", (F.col("load_mode") == "development") & F.lit(not development)),
        ("classifier_missing", F.col("model").isNull()),
        ("classifier_mismatch", F.col("wanted_model") != F.col("model")),
        ("thresholds_missing", ~limits_known),
        ("threshold_mismatch", ~as_wanted),
        ("items_missing", number_of("n_items") == 0),
        ("publication_empty", number_of("n_published") == 0),
        ("duplicate_item", F.col("copies") > 1),
        ("item_set_mismatch", F.col("unmatched") > 0),
        ("item_order_mismatch", F.col("moved") > 0),
    )
    last = first_code(("decision_missing", told.isNull()), ("decision_disagrees_with_items", ~as_told), ("manifest_id_mismatch", ~F.coalesce(F.col("stated_id") == F.col("body_id"), F.lit(False))))
    out = rows.withColumn("deny", F.coalesce(deny, F.col("item_code"), last))
    return out.select("pub", "deny", F.when(F.col("deny").isNull(), F.col("n_blocked")).otherwise(0).alias("overridden"))


def plain_id(x: Column) -> Column:
    """Letters and digits of an id in lower case; only tells that an unknown id is nearly a known one."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def reply_rejections(replies: DataFrame, items: DataFrame, allowed: DataFrame) -> DataFrame:
    """reply, position (null: the whole reply), code, near_miss: what is wrong with the replies of a model.

    replies: reply, wanted_id, given_id, has_items, least, most, lo, hi.  items: reply, position, id, score.  allowed:
    reply, id.  Faults of the envelope hide those of items.  Nothing is repaired: no item is clamped, cut or matched
    by a nearly equal id.
    """
    counts = items.groupBy("reply").agg(F.count("*").alias("n"))
    rows = replies.join(counts, "reply", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = first_code(("missing_items", ~F.coalesce("has_items", F.lit(False))), ("empty", (F.col("n") == 0) & (F.col("least") > 0)), ("count", ~F.col("n").between(F.col("least"), F.col("most"))))
    asked = first_code(("request_id_missing", F.col("given_id").isNull()), ("request_mismatch", F.trim("given_id") != F.col("wanted_id")))
    rows = rows.withColumn("codes", F.array_compact(F.array(asked, count)))
    nothing = F.lit(None).cast("int").alias("position")
    envelope = rows.select("reply", nothing, F.explode("codes").alias("code"), F.lit(False).alias("near_miss"))

    good = rows.filter(F.size("codes") == 0).select("reply", "least", "lo", "hi")
    known = allowed.select("reply", "id").distinct().withColumn("known", F.lit(True))
    near = allowed.select("reply", plain_id(F.col("id")).alias("plain")).distinct().withColumn("near", F.lit(True))
    each = items.join(good, "reply").join(known, ["reply", "id"], "left").withColumn("plain", plain_id(F.col("id"))).join(near, ["reply", "plain"], "left")
    code = first_code(
        ("id_missing", F.col("id").isNull()),
        ("unknown_id", F.col("known").isNull()),
        ("score_missing", F.col("score").isNull()),
        ("score_not_number", F.isnan("score") | (F.abs("score") == float("inf"))),
        ("score_out_of_range", ~F.col("score").between(F.col("lo"), F.col("hi"))),
    )
    each = each.withColumn("code", code).withColumn("near_miss", (F.col("code") == "unknown_id") & F.col("near").isNotNull() & (F.col("plain") != ""))
    of_items = each.filter("code IS NOT NULL").select("reply", "position", "code", "near_miss")
    twice = each.filter("id IS NOT NULL").groupBy("reply", "id").agg(F.count("*").alias("n")).filter("n > 1")
    doubled = twice.select("reply", nothing, F.lit("duplicate_id").alias("code"), F.lit(False).alias("near_miss"))
    usable = each.groupBy("reply", "least").agg(F.count_if(F.col("code").isNull()).alias("n")).filter(F.col("n") < F.col("least"))
    few = usable.join(twice.select("reply").distinct(), "reply", "left_anti").select("reply", nothing, F.lit("too_few_usable").alias("code"), F.lit(False).alias("near_miss"))
    return envelope.unionByName(of_items).unionByName(doubled).unionByName(few)


def reply_status(replies: DataFrame, rejections: DataFrame) -> DataFrame:
    """reply and status: ok without rejections, partial if only items were rejected, else rejected."""
    found = rejections.groupBy("reply").agg(F.count_if(F.col("position").isNull()).alias("whole"))
    status = F.when(F.col("whole").isNull(), "ok").when(F.col("whole") == 0, "partial").otherwise("rejected")
    return replies.select("reply").join(found, "reply", "left").select("reply", status.alias("status"))


def selection_constraints(survivors: DataFrame, size: int, cap: int, share: float, hero: float) -> DataFrame:
    """Six measured constraints of each album's selection: album, name, measured, wanted, satisfied, uncovered, short_by.

    survivors: album, media_id, place (in the album; null: not chosen), captured, scene, group_id, people, score.
    Everything is measured on what was chosen.  ``uncovered`` people have a survivor but no chosen photo; ``short_by``
    is what lacks in an album whose left photos are all of people at the cap.  Undated photos belong last.
    """
    chosen = survivors.filter("place IS NOT NULL")
    order = Window.partitionBy("album").orderBy("place", "media_id")
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    seq = chosen.select(
        "album",
        ((F.col("captured") < F.max("captured").over(seen)) | (F.col("captured").isNotNull() & F.max(F.col("captured").isNull()).over(seen))).alias("late"),
        (F.col("scene") == F.lag("scene").over(order)).alias("again"),
    )
    order_of = seq.groupBy("album").agg(F.count_if("late").alias("out_of_order"), F.count_if("again").alias("repeats"))
    shared = chosen.filter("group_id IS NOT NULL").groupBy("album", "group_id").agg(F.count("*").alias("n")).groupBy("album").agg(F.count_if(F.col("n") > 1).alias("shared"))
    person = survivors.select("album", "media_id", (F.col("place").isNotNull()).alias("in"), F.explode(F.array_distinct("people")).alias("person"))
    times = person.groupBy("album", "person").agg(F.count_if("in").alias("times"))
    busy = times.groupBy("album").agg(F.max("times").alias("busiest"), F.count_if(F.col("times") == 0).alias("uncovered"))
    held = person.filter("NOT in").join(times, ["album", "person"]).groupBy("album", "media_id").agg(F.max("times").alias("most")).groupBy("album").agg(F.count_if(F.col("most") >= cap).alias("held"))
    empty = F.size(F.coalesce("people", F.array())) == 0
    taken = F.col("place").isNotNull()
    base = survivors.groupBy("album").agg(
        F.count("*").alias("n"), F.count_if(taken).alias("chosen"), F.count_if(taken & empty).alias("scenery"), F.count_if(empty).alias("all_scenery"), F.max(F.when(taken, F.col("score"))).alias("best")
    )
    rows = base
    for more in (order_of, shared, busy, held):
        rows = rows.join(more, "album", "left")
    rows = rows.na.fill(0)
    left = F.col("n") - F.col("chosen")
    short = F.when((F.col("chosen") < size) & (left > 0) & (F.col("held") == left), size - F.col("chosen")).otherwise(0)
    wanted = F.least(F.lit(int(size * share)), F.col("all_scenery"))
    line = lambda name, measured, bound, ok: F.struct(F.lit(name).alias("name"), measured.cast("double").alias("measured"), bound.cast("double").alias("wanted"), ok.alias("satisfied"))
    lines = F.array(
        line("no_near_duplicates_on_spread", F.col("shared"), F.lit(0), F.col("shared") == 0),
        line("max_per_person_per_section", F.col("busiest"), F.lit(cap), (F.col("busiest") <= cap) & (F.col("uncovered") == 0) & (short == 0)),
        line("chronological_within_section", F.col("out_of_order"), F.lit(0), F.col("out_of_order") == 0),
        line("no_consecutive_same_scene", F.col("repeats"), F.lit(0), F.col("repeats") == 0),
        line("people_scenery_detail_balance", F.col("scenery"), wanted, F.col("scenery") >= wanted),
        line("min_hero_quality", F.col("best"), F.lit(hero), F.col("best") >= hero),
    )
    return rows.select("album", "uncovered", short.cast("long").alias("short_by"), F.explode(lines).alias("x")).select("album", "x.*", "uncovered", "short_by")


def plan_checks(plans: DataFrame, items: DataFrame, sources: DataFrame, beats: DataFrame, cues: DataFrame, claims: DataFrame, music: DataFrame, tolerance_ms: float) -> DataFrame:
    """plan, name, severity, failures and passed of each check of a reel or film; a check without subject has no row.

    plans: plan, film, most (frames, null: any), lufs, wanted_lufs (null: any), digest.  items: plan, place, kind (clip,
    gap or transition), source, start, length, offset, tail, out_offset, in_offset, lock_error_ms (null: not locked),
    words (null: none heard; else how many hold an edge of the clip).  sources: source, lo, hi.  beats: plan, required,
    clips.  cues: plan, cue, source, cleared.  claims: plan, cue, clip.  music: plan, clip, source.
    """
    order = Window.partitionBy("plan").orderBy("place")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    clip, step = F.col("kind") == "clip", F.col("kind") == "transition"
    end = F.col("offset") + F.col("length")
    rows = items.join(sources, "source", "left").withColumn("gaps", F.coalesce(F.sum(F.when(F.col("kind") == "gap", F.col("length"))).over(past), F.lit(0)))
    rows = rows.withColumn("cursor", F.coalesce(F.last(F.when(clip, F.col("start") + F.col("length") - F.col("gaps")), True).over(past), F.lit(0)) + F.col("gaps"))
    beside = lambda f: f(F.struct(clip.alias("clip"), (F.col("hi") - end).alias("after"), (F.col("offset") - F.col("lo")).alias("before"))).over(order)
    rows = rows.withColumn("out", beside(F.lag)).withColumn("into", beside(F.lead))
    between = F.coalesce(F.col("out.clip") & F.col("into.clip") & F.col("out.after").isNotNull() & F.col("into.before").isNotNull(), F.lit(False))
    handles = F.when(~between, 1).otherwise((F.col("out_offset") > F.col("out.after")).cast("int") + (F.col("in_offset") > F.col("into.before")).cast("int"))
    sums = rows.groupBy("plan").agg(
        F.count_if(clip & F.col("hi").isNull()).alias("unknown"),
        F.count_if(clip & ((F.col("offset") < F.col("lo")) | (end + F.coalesce("tail", F.lit(0)) > F.col("hi")))).alias("escapes"),
        F.count_if(clip & (F.col("start") != F.col("cursor"))).alias("moved"),
        F.count_if(step).alias("steps"),
        F.sum(F.when(step, handles).otherwise(0)).alias("handles"),
        F.count(F.when(clip, F.col("lock_error_ms"))).alias("locks"),
        F.count_if(clip & (F.abs("lock_error_ms") > tolerance_ms)).alias("off_beat"),
        F.count(F.when(clip, F.col("words"))).alias("heard"),
        F.sum(F.when(clip, F.col("words")).otherwise(0)).alias("in_word"),
        F.max(F.when(clip, F.col("start") + F.col("length")).otherwise(0)).alias("frames"),
    )
    open_beats = beats.groupBy("plan").agg(F.count_if(F.col("required") & (F.coalesce("clips", F.lit(0)) == 0)).alias("open_beats"))
    claimed = claims.join(cues.withColumnRenamed("source", "licensed"), ["plan", "cue"]).groupBy("plan", "clip").agg(F.count("*").alias("n"), F.collect_set("licensed").alias("licensed"))
    met = music.join(claimed, ["plan", "clip"], "full")
    misplaced = met.groupBy("plan").agg(F.count_if(F.col("n").isNull() | F.col("source").isNull() | (F.col("n") > 1) | ~F.array_contains("licensed", F.col("source"))).alias("misplaced"))
    idle = cues.join(claims.select("plan", "cue").distinct().withColumn("used", F.lit(True)), ["plan", "cue"], "left")
    idle = idle.groupBy("plan").agg(F.count("*").alias("cues"), F.count_if(~F.coalesce("cleared", F.lit(False))).alias("uncleared"), F.count_if(F.col("used").isNull()).alias("idle"))
    out = plans
    for more in (sums, open_beats, misplaced, idle):
        out = out.join(more, "plan", "left")
    out = out.na.fill(0, [c for c in out.columns if c not in plans.columns])
    film, one = F.coalesce("film", F.lit(False)), lambda bad: F.coalesce(bad, F.lit(False)).cast("long")
    check = lambda name, failures, applies=F.lit(True), severity="error": F.when(applies, F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), failures.cast("long").alias("failures")))
    checks = F.array_compact(F.array(
        check("references", F.col("unknown")),
        check("source_range", F.col("escapes")),
        check("contiguous", F.col("moved")),
        check("handles", F.col("handles"), F.col("steps") > 0),
        check("beat_tolerance", F.col("off_beat"), ~film & (F.col("locks") > 0)),
        check("mid_word", F.col("in_word"), F.col("heard") > 0, "warning"),
        check("max_duration", one(F.col("frames") > F.col("most")), F.col("most").isNotNull()),
        check("licence", F.col("uncleared"), F.col("cues") > 0),
        check("cues_placed_once", F.col("misplaced") + F.col("idle"), film & (F.col("cues") > 0)),
        check("story_beats", F.col("open_beats")),
        check("loudness", one(F.col("wanted_lufs").isNotNull() & ~F.col("lufs").eqNullSafe(F.col("wanted_lufs"))), severity="warning"),
        check("digest", one(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)))),
    ))
    return out.select("plan", F.explode(checks).alias("x")).select("plan", "x.*", (F.col("x.failures") == 0).alias("passed"))


def plan_status(checks: DataFrame) -> DataFrame:
    """fail where an error check failed, warn where only a warning did, else pass."""
    lost = checks.groupBy("plan").agg(F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"), F.count_if(~F.col("passed")).alias("all"))
    return lost.select("plan", F.when(F.col("errors") > 0, "fail").when(F.col("all") > 0, "warn").otherwise("pass").alias("status"))


def clearance_problems(manifests: DataFrame, items: DataFrame) -> DataFrame:
    """pub, problem: what disagrees within a clearance record itself.

    manifests: pub, sink, load_mode, decided (struct of items, cleared, blocked, indeterminate, publish).  items: pub,
    media_id, verdict, overridden.
    """
    of = lambda v: F.count_if(F.col("verdict") == v)
    unresolved = (F.col("verdict") == "indeterminate") | ((F.col("verdict") == "blocked") & ~F.col("overridden"))
    sums = items.groupBy("pub").agg(F.count("*").alias("n"), F.count_distinct("media_id").alias("different"), of("cleared").alias("n_cleared"), of("blocked").alias("n_blocked"), of("indeterminate").alias("n_indeterminate"), F.count_if(unresolved).alias("unresolved"))
    rows = manifests.join(sums, "pub", "left").na.fill(0, [c for c in sums.columns if c != "pub"])
    told, out = F.col("decided"), F.col("decided.publish")
    found = F.array_compact(F.array(
        F.when(told["items"] != F.col("n"), "item_count"),
        *[F.when(told[v] != F.col(f"n_{v}"), f"{v}_count") for v in ("cleared", "blocked", "indeterminate")],
        F.when(F.col("different") < F.col("n"), "duplicate_media"),
        F.when(out & (F.col("unresolved") > 0), "cleared_while_unresolved"),
        F.when(~out & (F.col("unresolved") == 0), "denied_without_cause"),
        F.when(out & (F.col("load_mode") == "development") & F.col("sink").isin("print", "share", "frontier_egress"), "development_cleared"),
    ))
    return rows.select("pub", F.explode(found).alias("problem"))


def preference_problems(events: DataFrame, alternatives: DataFrame) -> DataFrame:
    """event, problem: cross-field rules of a recorded preference.

    events: event, subject, kind, pixels, shareable, consent, local_ids (null: unknown, so held), anonymised, people,
    instruction, features, crop_before, crop_after, n_dense (null: none), n_named.  alternatives: event, subject,
    chosen, rank, features.
    """
    picked = F.when(F.col("chosen"), F.col("subject"))
    sums = alternatives.groupBy("event").agg(
        F.count("*").alias("n"), F.count(picked).alias("n_chosen"), F.min(picked).alias("picked"), (F.count("rank") > F.count_distinct("rank")).alias("same_rank"),
        F.collect_set("features").alias("spaces"),
    )
    rows = events.join(sums, "event", "left")
    shared, n = F.coalesce("shareable", F.lit(False)), F.coalesce("n", F.lit(0))
    found = F.array_compact(F.array(
        F.when(F.col("pixels"), "pixels"),
        F.when(shared & F.col("consent").isNull(), "no_consent"),
        F.when(shared & F.coalesce("local_ids", F.lit(True)), "local_identifiers"),
        F.when(shared & (F.coalesce("anonymised", F.lit("")) == ""), "not_anonymised"),
        F.when(shared & (F.coalesce("people", F.lit(0)) > 0), "names_people"),
        F.when(shared & (F.coalesce("instruction", F.lit("")) != ""), "free_text"),
        F.when((n > 0) & (F.col("n_chosen") != 1), "not_one_chosen"),
        F.when((F.col("n_chosen") == 1) & (F.col("picked") != F.col("subject")), "chosen_is_not_subject"),
        F.when(F.col("same_rank"), "shared_rank"),
        F.when(F.size(F.array_except("spaces", F.array("features"))) > 0, "other_feature_set"),
        F.when((F.col("kind") == "variant_picked") & (n == 0), "no_alternatives"),
        F.when((F.col("kind") == "recropped") & (F.col("crop_before").isNull() | F.col("crop_after").isNull()), "no_crop"),
        F.when(F.col("n_dense") != F.col("n_named"), "dense_length"),
    ))
    return rows.select("event", F.explode(found).alias("problem"))
