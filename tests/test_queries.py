"""Every query of the library against its SQL in another engine, on the smallest tables."""

import collections
import datetime
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry import registry
from mediaquarry.operators import album as album_operators
from mediaquarry.operators import events as events_operators
from mediaquarry.operators import frames as frame_operators
from mediaquarry.operators import linkage
from mediaquarry.operators import planning as planning_operators
from mediaquarry.operators import search as search_operators
from mediaquarry.operators import vectors as vector_operators
from mediaquarry.plans import album as album_plan
from mediaquarry.plans import events as events_plan
from mediaquarry.plans import frames as frames_plan
from mediaquarry.plans import planning
from mediaquarry.sources.tables import frames


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(cell, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    got = registry.queries()[name](spark, sf_dir)
    want = sql.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


BRUTE_FORCE = {"clu05_constrained_clusters", "win21_detect_cuts", "clu12_constrained_selection", "clu19_moment_records", "agg22_platt", "clu01_duplicate_groups", "clu03_shot_groups", "clu05_complete_linkage", "clu09_decision_fold", "clu12_greedy_selection", "clu18_box_suppression", "win04_max_span_split", "win15_suppress", "win32_greedy_labels"}


def test_every_query_has_sql_or_a_plain_version():
    assert set(registry.queries()) - set(registry.oracle_sql()) == BRUTE_FORCE


def plain_components(links):
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def cosine(a, b):
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def test_duplicate_groups_equal_a_plain_version(spark, sf_dir):
    items = {r["vec_id"]: r for r in planning.vectors(spark, sf_dir).collect()}
    links = {(r["a"], r["b"]): r["similarity"] for r in planning.links(spark, sf_dir).collect()}
    groups = collections.defaultdict(list)
    for x, label in plain_components(links).items():
        groups[label].append(x)
    want = set()
    for label, members in groups.items():
        best = min(members, key=lambda i: (not items[i]["favorite"], -items[i]["quality"], i))
        want |= {(i, label, best, 1.0 if i == best else links.get((min(i, best), max(i, best)), 0.0)) for i in members}
    got = registry.queries()["clu01_duplicate_groups"](spark, sf_dir).collect()
    assert {(r["id"], r["group_id"], r["primary_id"], r["similarity"]) for r in got} == want and len(got) == len(want) > 4


def test_complete_linkage_equals_a_plain_version(spark, sf_dir, sql):
    rows = sql.sql("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    vectors, label = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    far = {(a, b): round(cosine(vectors[a], vectors[b]), 9) for a in vectors for b in vectors if a < b and label[a] == label[b]}
    of = plain_components([p for p, d in far.items() if round(d, 6) <= 0.75])
    want = {}
    for block in set(of.values()):
        clusters = {x: [x] for x in of if of[x] == block}
        while len(clusters) > 1:
            link = {(a, b): max(far.get((min(x, y), max(x, y)), round(cosine(vectors[x], vectors[y]), 9)) for x in clusters[a] for y in clusters[b]) for a in clusters for b in clusters if a < b}
            a, b = min(link, key=lambda p: (link[p], p))
            if link[a, b] > 0.75:
                break
            clusters[a] += clusters.pop(b)
        want |= {x: c for c, members in clusters.items() for x in members}
    got = {r["id"]: r["cluster"] for r in registry.queries()["clu05_complete_linkage"](spark, sf_dir).collect()}
    assert got == want and len(set(want.values())) > 5


def test_decision_fold_equals_a_plain_version(spark, sf_dir, sql):
    kinds = {"click": "confirm", "view": "merge", "error": "reject"}
    log = sql.sql("SELECT user_id, event_id, event_type, event_id % 4 FROM events ORDER BY event_id").fetchall()
    seen, state = set(), {}
    for face, _, kind, person in log:
        kind = kinds.get(kind, "revoke")
        if (face, kind, person) in seen:
            continue
        seen.add((face, kind, person))
        now = state.get(face, (None, "open"))
        if kind == "confirm":
            now = (person, "confirmed")
        elif kind == "reject" and now[0] == person:
            now = (None, "rejected")
        elif kind == "merge" and now[1] == "confirmed":
            now = (person, "confirmed")
        elif kind == "revoke":
            now = (None, "revoked")
        state[face] = now
    got = {r["face"]: (r["person"], r["state"]) for r in registry.queries()["clu09_decision_fold"](spark, sf_dir).collect()}
    assert got == state and len(set(s for _, s in state.values())) > 1


def test_shot_groups_equal_a_plain_version(spark, sf_dir, sql):
    rows = collections.defaultdict(list)
    for user, event, us in sql.sql("SELECT user_id, event_id, epoch_us(ts) AS us FROM events ORDER BY us, event_id").fetchall():
        rows[user].append((event, us))
    links = [(e, p) for items in rows.values() for i, (e, us) in enumerate(items) for p, before in items[max(0, i - 8) : i] if us - before <= 1800 * 1e6]
    of = plain_components(links)
    largest = collections.defaultdict(int)
    for x, label in of.items():
        largest[label] = max(largest[label], 1 + x % 9)
    want = {x: (label, math.floor(math.log2(largest[label] / (1 + x % 9)))) for x, label in of.items()}
    got = {r["item"]: (r["shot"], r["band"]) for r in registry.queries()["clu03_shot_groups"](spark, sf_dir).collect()}
    assert got == want and want


def test_box_suppression_equals_a_plain_version(spark, sf_dir, sql):
    rows = collections.defaultdict(list)
    for image, i, x, y, score in sql.sql("SELECT l_orderkey, l_partkey * 10 + l_linenumber, l_discount * 5.0, l_tax * 5.0, l_quantity / 50 FROM lineitem").fetchall():
        rows[image].append((-float(score), i, float(x), float(y)))
    want = set()
    for image, boxes in rows.items():
        kept = []
        for _, i, x, y in sorted(boxes):
            cuts = [max(0.0, min(x, a) + 0.4 - max(x, a)) * max(0.0, min(y, b) + 0.4 - max(y, b)) for _, a, b in kept]
            if all(c <= 0.45 * (0.32 - c) for c in cuts):
                kept.append((i, x, y))
                want.add((image, i))
    got = {tuple(r) for r in registry.queries()["clu18_box_suppression"](spark, sf_dir).collect()}
    assert got == want and len(want) < sum(map(len, rows.values()))


def plain_split(items, longest):
    items = sorted(items)
    lo, hi = items[0][0], items[-1][0]
    if hi - lo <= longest:
        return [items]
    steps = [(items[k][0] - items[k - 1][0], -abs(items[k][0] + items[k - 1][0] - (lo + hi)), -items[k][0], -items[k][1], k) for k in range(1, len(items))]
    k = max(steps)[4]
    return plain_split(items[:k], longest) + plain_split(items[k:], longest)


@pytest.mark.parametrize("longest", [10, 60, 4 * 86_400_000_000])
def test_max_span_split_equals_a_plain_version(spark, sf_dir, longest):
    if longest < 100:
        rng = random.Random(5)
        rows = spark.createDataFrame([(k % 4, k, rng.randrange(300), k % 3) for k in range(200)], "user_id long, event_id long, us long, event_no long")
    else:
        rows = events_plan.sessioned(spark, sf_dir)
    groups = collections.defaultdict(list)
    for r in rows.collect():
        groups[r["user_id"], r["event_no"]].append((r["us"], r["event_id"]))
    want = {(key, tuple(i for _, i in part)) for key, items in groups.items() for part in plain_split(items, longest)}
    parts = collections.defaultdict(list)
    for r in events_operators.split_long(rows, longest).collect():
        parts[r["user_id"], r["event_no"], r["part"]].append((r["us"], r["event_id"]))
    assert {((u, e), tuple(i for _, i in sorted(v))) for (u, e, _), v in parts.items()} == want
    assert len(want) > len(groups) or longest > 100


def test_suppression_equals_a_plain_version(spark, sf_dir):
    scored = frame_operators.covered_aggregate(frames(spark, sf_dir), frame_operators.hopping(frames_plan.clean(spark, sf_dir), 4, 2), "sharpness").filter("mean IS NOT NULL")
    rows = collections.defaultdict(list)
    for r in scored.collect():
        rows[r["media_id"]].append((-r["mean"], r["lo"], r["hi"]))
    want = set()
    for media, windows in rows.items():
        kept = []
        for _, lo, hi in sorted(windows):
            if all(abs((lo + hi) / 2 - c) > 6 for c in kept):
                kept.append((lo + hi) / 2)
                want.add((media, lo, hi))
    got = {(r["media_id"], r["lo"], r["hi"]) for r in registry.queries()["win15_suppress"](spark, sf_dir).collect()}
    assert got == want and len(want) < sum(map(len, rows.values()))


def test_greedy_labels_equal_a_plain_version(spark, sf_dir, sql):
    want, reps = {}, collections.defaultdict(list)
    for i, label, x in sql.sql("SELECT vec_id, label % 5, embedding[1:4] FROM embeddings ORDER BY vec_id").fetchall():
        own = reps[label]
        d = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, r, strict=True)) / 4) for r in own]
        if not own or (min(d) > 0.08 and len(own) < 8):
            own.append(x)
            want[i] = len(own) - 1
        else:
            want[i] = d.index(min(d))
    got = {r["ord"]: r["label"] for r in registry.queries()["win32_greedy_labels"](spark, sf_dir).collect()}
    assert got == want and max(want.values()) > 2


def test_platt_fit_minimises_the_loss_over_all_samples(spark, sf_dir, sql):
    rows = collections.defaultdict(list)
    for k, x, y in sql.sql("SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) / 500000, CAST(CAST(o_totalprice AS DOUBLE) / 500000 + (o_orderkey % 10) / 20 > 0.7 AS INTEGER) FROM orders").fetchall():
        rows[k].append((x, y))
    got = {r["klass"]: r for r in registry.queries()["agg22_platt"](spark, sf_dir).collect()}
    assert set(got) == {k for k, v in rows.items() if len(v) >= 200} and got
    for k, r in got.items():
        loss = lambda a, b: sum(math.log1p(math.exp(-abs(a * x + b))) + max(a * x + b, 0) - y * (a * x + b) for x, y in rows[k]) + 5e-4 * a * a  # noqa: B023, E731
        here = loss(r["a"], r["b"])
        assert r["examples"] == len(rows[k]) and all(loss(r["a"] + p, r["b"] + q) >= here for p, q in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)))


def plain_selection(rows, p):
    """One event by the definition: pins, people, then the best gain under caps that open one by one."""
    rows = {r["media_id"]: r for r in rows}
    people = {i: sorted(set(r["people"] or [])) for i, r in rows.items()}
    key = {i: {"time": r["time"], "place": r["place"], "moment": r["moment"], "shot": r["shot"], "family": r["family"], "pose": ("none", i) if r["pose"] is None else r["pose"]} for i, r in rows.items()}
    count, shown, chosen = collections.Counter(), collections.Counter(), []
    alike = lambda a, b: 0.0 if rows[a]["embedding"] is None or rows[b]["embedding"] is None else round(1 - cosine(rows[a]["embedding"], rows[b]["embedding"]), 9)
    closest = lambda i: max([0.0, *[alike(i, j) for j, _ in chosen]])

    def gain(i):
        k = key[i]
        value = p.quality * rows[i]["score"] + sum(w * 0.5 ** count[c, k[c]] for c, w in (("time", p.time), ("place", p.place), ("moment", p.moment), ("pose", p.pose)))
        who = people[i] or [None]
        value += p.person * sum(0.5 ** shown[x] for x in who) / len(who)
        return round(value - p.redundancy * min(1, max(0, (closest(i) - p.free_similarity) / (p.shot_similarity - p.free_similarity))), 9)

    def take(i, why):
        chosen.append((i, why))
        count.update((c, v) for c, v in key[i].items())
        shown.update(people[i] or [None])

    left = lambda: [i for i in sorted(rows) if i not in {j for j, _ in chosen}]
    for i in sorted(rows):
        if rows[i]["pinned"]:
            take(i, "pinned")
    while len(chosen) < p.size:
        new = {i: sum(shown[x] < p.least_per_person for x in people[i]) for i in left()}
        if not any(new.values()):
            break
        take(min(left(), key=lambda i: (-new[i], -gain(i), i)), "person")
    reserve = min(int(p.size * p.no_people_share), sum(not x for x in people.values()), p.size)
    shot_cap, family_cap, pose_cap = 1, p.family_cap, p.pose_cap
    while len(chosen) < p.size:
        only_empty = reserve - sum(not people[i] for i, _ in chosen) >= p.size - len(chosen)
        asleep = sum(rows[i]["sleeping"] for i, _ in chosen) >= max(1, int(p.size * p.sleeping_share))
        fits = [i for i in left() if not rows[i]["dominated"] and all(shown[x] < p.person_cap for x in people[i]) and not (only_empty and people[i]) and not (asleep and rows[i]["sleeping"])]
        if not fits:
            break
        shot = [i for i in fits if count["shot", key[i]["shot"]] < shot_cap]
        reachable = [i for i in fits if count["pose", key[i]["pose"]] < pose_cap]
        fresh = [i for i in reachable if i in shot and count["family", key[i]["family"]] < family_cap]
        if fresh:
            distinct = [i for i in fresh if closest(i) < p.distinct_similarity]
            if distinct:
                take(min(distinct, key=lambda i: (-gain(i), i)), "gain")
            else:
                take(min(fresh, key=lambda i: (round(closest(i), 2), -gain(i), i)), "repeat")
        elif not reachable:
            pose_cap += 1
        elif set(reachable) & set(shot):
            family_cap += 1
        else:
            shot_cap += 1
    return [(i, k, why) for k, (i, why) in enumerate(chosen, 1)]


@pytest.mark.parametrize("policy", [album_plan.POLICY, album_operators.Policy(size=30, person_cap=5, distinct_similarity=0.3, free_similarity=0.0, shot_similarity=0.4, sleeping_share=0.05, no_people_share=0.5, family_cap=1)])
def test_constrained_selection_equals_a_plain_version(spark, sf_dir, policy):
    rows = album_plan.candidates(spark, sf_dir).filter("event < 12")
    events = collections.defaultdict(list)
    for r in rows.collect():
        events[r["event"]].append(r)
    want = {(e, *x) for e, items in events.items() for x in plain_selection(items, policy)}
    got = album_operators.constrained_selection(rows, policy).collect()
    assert {(r["event"], r["media_id"], r["rank"], r["why"]) for r in got} == want and len(got) == len(want)
    assert {r["why"] for r in got} >= {"pinned", "person", "gain"}


def test_moment_records_equal_a_plain_version(spark, sf_dir):
    media = collections.defaultdict(dict)
    for r in frames(spark, sf_dir).collect():
        media[r["media_id"]][r["frame"]] = r
    want = set()
    for m, rows in media.items():
        why = {f: [n for n, x in (("black", r["luma"] <= 0.02), ("shaky", r["shake"] is not None and r["shake"] >= 0.55), ("still", r["motion"] is not None and r["motion"] <= 0.02)) if x] for f, r in rows.items()}
        spans = []
        for bad in (False, True):
            run = []
            for f in [*sorted(rows), None]:
                if run and (f is None or f != run[-1] + 1 or bool(why[f]) != bad):
                    spans.append((bad, run[0], run[-1] + 1))
                    run = []
                if f is not None and bool(why[f]) == bad:
                    run.append(f)
        want |= {(m, lo, hi, "eliminated", None, tuple(sorted({x for f in range(lo, hi) for x in why[f]}))) for bad, lo, hi in spans if bad}
        windows = {(s, s + 4) for bad, lo, hi in spans if not bad and hi - lo >= 4 for s in [*range(lo, hi - 3, 2), hi - 4]}
        scored = []
        for lo, hi in windows:
            x = [rows[f]["sharpness"] for f in range(lo, hi) if rows[f]["sharpness"] is not None]
            if len(x) >= 2:
                scored.append((-round(sum(x) / len(x), 6), lo, hi))
        kept = []
        for s, lo, hi in sorted(scored):
            if all(abs((lo + hi) / 2 - c) > 6 for c in kept):
                kept.append((lo + hi) / 2)
                cuts = [(abs(f - lo), f) for f, r in rows.items() if r["boundary"] and abs(f - lo) <= 2]
                want.add((m, min(cuts)[1] if cuts else lo, hi, "kept", -s, ()))
    got = [(r["media_id"], r["lo"], r["hi"], r["status"], r["score"], tuple(r["reasons"])) for r in registry.queries()["clu19_moment_records"](spark, sf_dir).collect()]
    assert set(got) == want and {x[3] for x in got} == {"kept", "eliminated"}


@pytest.mark.parametrize("text", ["(a", "a OR", "NOT a", "a )", "x:(a b)", "*"])
def test_searches_that_make_no_sense_are_refused(text):
    with pytest.raises(ValueError):
        search_operators.parse(text)


def test_search_binds_not_before_and_before_or():
    word = lambda x, prefix=False, column=None: ("words", x, prefix, column)
    assert search_operators.parse("  ") is None
    assert search_operators.parse('a b OR c NOT "d e" AND t:f*') == ("or", ("and", word("a"), word("b")), ("and", ("not", word("c"), word("d e")), word("f", True, "t")))


def test_greedy_selection_sees_all_orders(spark, sf_dir, sql):
    rows = sql.sql("SELECT o_custkey % 50, o_orderkey, o_totalprice / 500000, o_orderkey % 5, o_custkey % 7 FROM orders").fetchall()
    want = set()
    for event in {r[0] for r in rows}:
        free, places, people = sorted(r[1:] for r in rows if r[0] == event), [0] * 5, [0] * 7
        for rank in range(1, 13):
            fits = [(-round(s + 0.5 ** places[p], 9), i, p, c) for i, s, p, c in free if people[c] < 6]
            if not fits:
                break
            gain, best, place, person = min(fits)
            free = [r for r in free if r[0] != best]
            places[place] += 1
            people[person] += 1
            want.add((event, best, rank))
    got = registry.queries()["clu12_greedy_selection"](spark, sf_dir)
    assert {(r["event"], r["media_id"], r["rank"]) for r in got.collect()} == want


def test_listing_pushes_filters_to_the_scan(spark, sf_dir):
    from mediaquarry.sources.tables import table as read

    plan = read(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in text and "o_totalprice" not in text


def test_constrained_clusters_equal_a_plain_version(spark, sf_dir):
    rows, links, must, cannot = (x.collect() for x in planning.faces(spark, sf_dir))
    vector = {r["face_id"]: r["embedding"] for r in rows if r["embedding"] is not None}
    tracks = collections.defaultdict(list)
    for r in rows:
        if r["track"] is not None and r["face_id"] in vector:
            tracks[r["track"]].append(r)
    votes = {t: min(m, key=lambda r: (not r["declared"], -(r["quality"] if r["quality"] is not None else -1), r["face_id"]))["face_id"] for t, m in tracks.items()}
    voters = sorted([r["face_id"] for r in rows if r["track"] is None and r["face_id"] in vector] + list(votes.values()))
    together = [(r["a"], r["b"]) for r in must if r["a"] in voters and r["b"] in voters]
    apart = {(r["a"], r["b"]) for r in cannot}
    far = {(a, b): round(cosine(vector[a], vector[b]), 9) for a in voters for b in voters if a < b}
    of = plain_components([(r["a"], r["b"]) for r in links if r["a"] in voters and r["b"] in voters] + together)
    seeds = plain_components(together)
    want = {x: x for x in voters}
    for block in set(of.values()):
        clusters = collections.defaultdict(list)
        for x in sorted(x for x in of if of[x] == block):
            clusters[seeds.get(x, x)].append(x)
        while True:
            options = []
            for a in clusters:
                for b in clusters:
                    pairs = [(min(x, y), max(x, y)) for x in clusters[a] for y in clusters[b]]
                    if a < b and not any(p in apart for p in pairs):
                        options.append((max(far[p] for p in pairs), a, b))
            if not options or min(options)[0] > 0.75:
                break
            _, a, b = min(options)
            clusters[a] += clusters.pop(b)
        want |= {x: c for c, members in clusters.items() for x in members}
    for r in rows:
        if r["track"] in votes:
            want[r["face_id"]] = want[votes[r["track"]]]
    got = registry.queries()["clu05_constrained_clusters"](spark, sf_dir).collect()
    assert {r["face_id"]: r["cluster"] for r in got} == want and len(got) == len(want) > len(set(want.values())) > 5
    assert together and any(want[a] == want[b] and far[a, b] > 0.75 for a, b in together if (a, b) in far)


def plain_cuts(sig, p):
    """Frame by frame: every frame is asked in turn whether it starts a shot."""
    far = lambda i, j: sum(math.dist(sig[i][k : k + 3], sig[j][k : k + 3]) for k in range(0, len(sig[i]), 3)) / (len(sig[i]) // 3)
    d = [0.0] + [far(i - 1, i) for i in range(1, len(sig))]
    free, cuts, out = 0, [], []
    for i in range(1, len(sig)):
        others = sorted(d[j] for j in range(1, len(sig)) if 0 < abs(j - i) <= p["radius"])
        half = len(others) // 2
        mid = 0.0 if not others else others[half] if len(others) % 2 else (others[half - 1] + others[half]) / 2
        close = [(j, d[j]) for j in range(1, len(sig)) if 0 < abs(j - i) <= p["near"]]
        if i < free or d[i] < p["high"] or d[i] < p["ratio"] * max(mid, p["floor"]) or any(x >= d[i] if j < i else x > d[i] for j, x in close):
            continue
        # the transient may begin at the peak, or the peak may be its end
        spans = [(j, i) for j in range(i + 1, len(sig)) if j <= i + p["flash"] and far(i - 1, j) <= p["back"]]
        for start in range(i - 1, 0, -1):
            if start >= i - p["flash"]:
                spans += [(j, start) for j in range(i, len(sig)) if j <= start + p["flash"] and far(start - 1, j) <= p["back"]]
        if spans:
            out.append((spans[0][1], "flash"))
            free = spans[0][0] + 1
        elif not cuts or i - cuts[-1] >= p["least"]:
            cuts.append(i)
            out.append((i, "cut"))
            free = max([i + 1] + [j + 1 for j in range(i + 1, len(sig)) if j <= i + p["merge"] and d[j] >= p["low"]])
    return out


@pytest.mark.parametrize("change", [{}, {"near": 3, "merge": 4, "least": 6, "flash": 4}, {"ratio": 1.0, "near": 2, "radius": 2, "back": 2.0}])
def test_detected_cuts_equal_a_plain_version(spark, sf_dir, change):
    clips = collections.defaultdict(dict)
    rows = planning.signatures(spark, sf_dir)
    for r in rows.collect():
        clips[r["media_id"]][r["frame"]] = r["signature"]
    p = planning.CUTS | change
    want = {(m, i, kind) for m, f in clips.items() for i, kind in plain_cuts([f[k] for k in sorted(f)], p)}
    got = [tuple(r) for r in planning_operators.detect_cuts(rows, **p).collect()]
    assert set(got) == want and len(got) == len(want) and {k for _, _, k in want} == {"cut", "flash"}


@pytest.mark.parametrize("side", [3, 16, 4096])
def test_close_pairs_are_whole_in_any_parts(spark, side):
    rng = random.Random(5)
    rows = [(i, i % 3 if i % 10 else None, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    rows += [(200 + i, 1, rows[4][2]) for i in range(8)] + [(300, 1, [2 * x for x in rows[4][2]]), (4, 1, [-x for x in rows[4][2]]), (301, 1, None), (302, 7, [0.0] * 4)]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = sorted((g, i, j, round(cosine(v, w), 6)) for i, g, v in rows for j, h, w in rows if i < j and g == h is not None and v and w and round(cosine(v, w), 6) <= 0.75)
    got = vector_operators.close_pairs(data, 0.75, "label", 6, side=side)
    assert [c for c, _ in got.dtypes] == ["block", "a", "b", "distance"] and want == sorted(tuple(r) for r in got.collect()) and len(want) > 300
    for bad, says in (([0.0] * 4, "zero vector"), ([1.0], "unequal size")):
        with pytest.raises(Exception, match=says):
            vector_operators.close_pairs(data.union(spark.createDataFrame([(400, 1, bad)], data.schema)), 0.75, "label", 6, side=side).collect()


def test_vector_pairs_are_met_as_matrix_products(spark, sf_dir):
    text = registry.queries()["jn09_vector_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "zip_with" not in text and text.count("Scan parquet") == 2


def test_distances_at_a_border_are_those_of_the_expression(spark):
    rng = random.Random(8)
    rows = [(i, 0, [rng.random() for _ in range(64)]) for i in range(60)]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    a, b = data.toDF("a", "g", "va"), data.toDF("b", "h", "vb")
    want = a.join(b).filter("a < b").selectExpr("a", "b").join(a, "a").join(b, "b").select("a", "b", F.round(vector_operators.cosine_distance(F.col("va"), F.col("vb")), 15).alias("d"))
    got = vector_operators.close_pairs(data, 2.0, "label", 9)
    assert {(r["a"], r["b"]): r["distance"] for r in got.collect()} == {(r["a"], r["b"]): round(r["d"], 9) for r in want.collect()}
    v = np.array([[3.0, 4.0], [4.0, 3.0]])
    near = vector_operators.rounded_distances(np.array([0.0400001]), np.array([0]), np.array([1]), v, np.array([5.0, 5.0]), 2)
    assert near.tolist() == [0.04]
    v = np.array([[1.0, 0.0], [0.375, math.sqrt(1 - 0.375**2)]])
    assert vector_operators.rounded_distances(np.array([0.6249999999999]), np.array([0]), np.array([1]), v, np.array([1.0, 1.0]), 2).tolist() == [0.63]


def plain_clusters(ids, far, seeds):
    """Clusters of points by the smallest linkage, then the smallest ids; pairs that are not in ``far`` never meet."""
    clusters = {}
    for x in ids:
        clusters.setdefault(seeds.get(x, x), []).append(x)
    while True:
        options = []
        for a in clusters:
            for b in clusters:
                pairs = [(min(x, y), max(x, y)) for x in clusters[a] for y in clusters[b]] if a < b else []
                if pairs and all(p in far for p in pairs):
                    options.append((max(far[p] for p in pairs), a, b))
        if not options:
            return {x: c for c, members in clusters.items() for x in members}
        _, a, b = min(options)
        clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("local_links", [0, 40, 10**6])
@pytest.mark.parametrize("seeded", [False, True])
def test_clusters_of_links_equal_a_plain_version_with_ties(spark, local_links, seeded):
    rng, ids, far, seeds, want = random.Random(13), [], {}, {}, {}
    for label in range(0, 1000, 500):
        # points of a small grid, so that most distances are tied, in no order of their ids
        mine = rng.sample(range(label, label + 400), 45)
        at = {x: (rng.randrange(8), rng.randrange(8)) for x in mine}
        pairs = [(a, b) for a in mine for b in mine if a < b]
        near = {p: round(math.dist(at[p[0]], at[p[1]]), 9) for p in pairs if math.dist(at[p[0]], at[p[1]]) <= 4.3 and sum(p) % 9}
        groups = [sorted(mine[i : i + 3]) for i in (0, 3, 6)] if seeded else []
        first = {x: g[0] for g in groups for x in g}
        want |= plain_clusters(mine, near, first)
        ids += [(label, x) for x in mine]
        far |= {(label, *p): d for p, d in near.items()}
        seeds |= first
    links = spark.createDataFrame([(*k, d) for k, d in far.items()], "label long, a long, b long, distance double")
    got = linkage.complete_clusters(spark.createDataFrame(ids, "label long, id long"), links, spark.createDataFrame(list(seeds.items()), "id long, label long") if seeded else None, local_links)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.items()) and 5 < len(set(want.values())) < 60


def test_a_large_component_is_clustered_from_its_links():
    n = 60_000
    a = np.arange(n - 1)
    ids, cluster = linkage.chains(a, a + 1, np.linspace(1, 0, n - 1))
    assert ids.tolist() == list(range(n)) and cluster.tolist() == [max(0, x - (x + 1) % 2) if n % 2 else x - x % 2 for x in range(n)]


def test_thinned_links_have_the_same_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    got = linkage.thinned(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert plain_components([(r["a"], r["b"]) for r in got]) == {x: c for x, c in plain_components(links).items() if any(a != b for a, b in links if x in (a, b))}
    x, y = linkage.forest(*np.array([(i, i + 1) for i in range(5000)] + [(7, 7)]).T)
    assert set(x.tolist()) == {0} and sorted(y.tolist()) == list(range(1, 5001))
