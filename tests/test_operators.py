"""Operators against hand-made cases and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from peerscope.functions import expr as E
from peerscope.operators import evaluation as V
from peerscope.operators import labels as L
from peerscope.operators import learning as M
from peerscope.operators import sequence as Q
from peerscope.operators import winprob as W
from peerscope.sources import dimensions as D
from peerscope.sources import matches as X
from peerscope.sources import recordings as R
from peerscope.sources import tables as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_percentile_plateaus_and_ends(spark):
    d = [F.lit(float(x)) for x in (1, 2, 2, 4, 8)]
    p = lambda v: one(spark, p=E.percentile_in(F.lit(float(v)), *d, F.lit(1.0)))["p"]
    assert p(2) == 37.5 and p(1) == 10 and p(3) == 62.5 and p(100) == 99 and p(-100) == 1
    assert p(0.5) == pytest.approx(10 - 15 * 0.5)
    flat = [F.lit(3.0)] * 5
    assert one(spark, p=E.percentile_in(F.lit(3.0), *flat, F.lit(0.0)))["p"] == 50
    assert one(spark, p=E.percentile_in(F.lit(4.0), *flat, F.lit(0.0)))["p"] == 99


def test_map_and_lanes(spark):
    r = one(spark, own=E.own_zone(F.lit(11000), F.lit(8000), F.lit(200)), foe=E.own_zone(F.lit(11000), F.lit(8000), F.lit(100)),
            mid=E.lane_at(F.lit(7400), F.lit(7500)), none=E.lane_at(F.lit(4000), F.lit(9000)), base=E.lane_at(F.lit(500), F.lit(500)))
    assert (r["own"], r["foe"], r["mid"], r["none"], r["base"]) == ("own_jungle", "enemy_jungle", "mid", None, None)


def test_numbers_in_text(spark):
    r = one(spark, n=E.written_numbers(F.lit("E3 says 1,234.50 gold in a 2v2, then 7.")))["n"]
    assert [(x["value"], x["decimals"]) for x in r] == [(1234.5, 2), (7.0, 0)]


def test_skill_orders(spark):
    r = one(spark, a=E.first_maxed(F.lit("QWQWQQWEQ")), b=E.first_maxed(F.lit("QW")), c=E.max_order(F.lit("QWEQQRQWQWRWWEE")))
    assert (r["a"], r["b"], r["c"]) == ("Q", None, "QWE")


def undo_brute(log):
    bought = []
    for kind, item, t in log:
        if kind == "ITEM_PURCHASED":
            bought.append((item, t))
        else:
            for i in reversed(range(len(bought))):
                if bought[i][0] == item:
                    del bought[i]
                    break
    return sorted(bought)


def test_undo_takes_the_latest_matching_purchase(spark):
    rng = random.Random(5)
    logs = {f"M{m}": [(rng.choice(["ITEM_PURCHASED", "ITEM_PURCHASED", "ITEM_UNDO"]), rng.randint(1, 3), 1000 * i) for i in range(25)] for m in range(20)}
    rows = [(m, i, k, 1, item if k == "ITEM_PURCHASED" else None, item if k == "ITEM_UNDO" else None, t) for m, log in logs.items() for i, (k, item, t) in enumerate(log)]
    df = spark.createDataFrame(rows, "match_id string, pos int, type string, participantId int, itemId int, beforeId int, timestamp long")
    got = {}
    for r in X.purchases(df).collect():
        got.setdefault(r["match_id"], []).append((r["item"], r["timestamp"]))
    assert {m: sorted(v) for m, v in got.items()} == {m: undo_brute(log) for m, log in logs.items()}


def test_final_frame_is_not_a_minute_and_gaps_take_the_one_before(spark):
    frames = ",".join('{"timestamp":%d,"participantFrames":{"1":{"totalGold":%d}},"events":[]}' % (t, g) for t, g in ((13, 500), (60013, 600), (180013, 800), (238000, 900)))
    raw = spark.createDataFrame([(1, '{"metadata":{"matchId":"A"},"info":{"frames":[%s]}}' % frames), (2, '{"metadata":{"matchId":"B"},"info"')], "id int, text string")
    good, bad = X.parsed(raw, "text", X.TIMELINE_SCHEMA, "id")
    assert [(r["minute"], r["gold"]) for r in X.minute_frames(good).orderBy("minute").collect()] == [(0, 500), (1, 600), (2, 600), (3, 800)]
    assert [tuple(r) for r in bad.collect()] == [(2, "malformed")]


def test_unreal_wards_and_absent_assists(spark):
    e = spark.createDataFrame([("A", "WARD_PLACED", 5, None, None, 1, None, "UNDEFINED"), ("A", "WARD_PLACED", 6, None, None, 1, None, "SIGHT_WARD"), ("A", "CHAMPION_KILL", 7, 2, 3, None, None, None)],
                              "match_id string, type string, timestamp long, killerId int, victimId int, creatorId int, assistingParticipantIds array<int>, wardType string")
    got = sorted((r["participant_id"], r["counter"]) for r in X.counted_events(e).collect())
    assert got == [(1, "wards_placed"), (2, "kills"), (3, "deaths")]


def state_rows(spark, kinds):
    teams = [(100, 3), (200, 8)]
    events = [("G", i + 1, 30_000 * (i + 1), k, t, ("DRAGON" if k == "monster" else None), "outer" if k == "tower" else None, 6, 300.0, 0.0) for i, (k, t) in enumerate(kinds)]
    e = spark.createDataFrame(events, "match_id string, seq long, t long, kind string, team int, monster string, ring string, victim_level int, bounty double, shutdown double")
    frames = spark.createDataFrame([("G", m, t, 2500 + 400 * m * f, 100 * m, m, 5, 10, 0, 0, 0) for m in range(6) for t, f in teams],
                                   "match_id string, minute int, team int, gold int, xp int, cs int, level int, held int, lvl6 int, lvl11 int, lvl16 int")
    return W.with_respawn(e), frames


def test_shapley_equals_brute_force(spark):
    e, f = state_rows(spark, [("kill", 200), ("tower", 100), ("monster", 100), ("kill", 100)])
    st = W.game_state(W.event_asks(e), f, e).withColumn("moment", F.split("ask", ":")[1].cast("long"))
    before, after = st.where("ask LIKE 'b%'").drop("ask"), st.where("ask LIKE 'a%'").drop("ask")
    got = {(r["moment"], r["change"]): r for r in W.explained_changes(before, after, ["match_id", "moment"]).collect()}
    groups = W.change_groups()
    b = {r["moment"]: r.asDict() for r in before.collect()}
    a = {r["moment"]: r.asDict() for r in after.collect()}

    def chance(s):
        def side(own):
            foe = 300 - own
            z = 0.4 * (s[f"gold_{own}"] - s[f"gold_{foe}"]) / 1000 + 0.3 * (s[f"kills_lost_{foe}"] - s[f"kills_lost_{own}"])
            z += 0.5 * (s[f"towers_lost_{foe}"] - s[f"towers_lost_{own}"] - s["towers_lost_0"])
            return 1 / (1 + math.exp(-z))
        return (side(100) + 1 - side(200)) / 2

    for m in b:
        changed = [g for g, cs in groups.items() if any(b[m][c] != a[m][c] for c in cs)]
        assert changed and {k[1] for k in got if k[0] == m} == set(changed)
        value = {}
        for r in range(len(changed) + 1):
            for pick in itertools.combinations(changed, r):
                mixed = dict(b[m])
                for g in pick:
                    mixed.update({c: a[m][c] for c in groups[g]})
                value[frozenset(pick)] = chance(mixed)
        k = len(changed)
        for g in changed:
            rest = [x for x in changed if x != g]
            want = sum(math.factorial(r) * math.factorial(k - r - 1) / math.factorial(k) * (value[frozenset(p) | {g}] - value[frozenset(p)])
                       for r in range(k) for p in itertools.combinations(rest, r))
            assert got[m, g]["value"] == pytest.approx(want, abs=1e-12)


def test_credit_is_zero_sum_under_every_rule(spark):
    facts = spark.createDataFrame([
        ("G", 1, 30_000, 3, "kills", 100, 0.05, 2, [3, 4], 7, {2: 100.0, 3: 300.0}, [2, 3], [], None),
        ("G", 2, 70_000, 3, "structures", 200, -0.08, 8, [], 1, {}, [8], [1, 2], None), ("G", 3, 110_000, 3, "kills", 200, -0.02, 0, [], 1, {}, [], [], None),
        ("G", 4, 150_000, 3, "items", 100, 0.01, 0, [], 0, {}, [], [], 5)],
        "match_id string, moment long, t long, last int, kind string, side int, d double, killer int, helpers array<int>, victim int, damage map<int,double>, got array<int>, dead array<int>, by int")
    curve = spark.createDataFrame([("G", m, p) for m, p in enumerate((0.52, 0.6, 0.5, 0.55))], "match_id string, minute int, p double")
    earned = spark.createDataFrame([("G", p, m, float(p * m), float((p - 5) * (m + 1))) for p in range(1, 11) for m in range(3)], "match_id string, player int, minute int, got double, gap double")
    results = spark.createDataFrame([("G", 100)], "match_id string, winner int")
    variants = W.rules_table(spark, [("default", {}), ("half", {"kill_split": "half"}), ("earned", {"economy_split": "earned", "team_share": 0.2})])
    ruled = facts.crossJoin(variants)
    all_ = W.event_shares(ruled).unionByName(W.drift_shares(curve, ruled, earned, ["rules", "even_economy", "economy_split"])).unionByName(W.edge_shares(curve, results, variants))
    sums = all_.groupBy("rules", (F.col("player") <= 5).alias("blue")).agg(F.sum("amount").alias("s")).collect()
    assert len(sums) == 6
    for r in sums:
        assert r["s"] == pytest.approx(0.5 if r["blue"] else -0.5, abs=1e-9)


def test_auc_counts_ties_half(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(200)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = V.auc(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()["auc"]
    assert got == pytest.approx(want)


def test_splits_keep_groups_whole(spark):
    d = spark.range(2000).select((F.col("id") % 100).alias("g"))
    s = V.split_by_group(d, "g", {"train": 0.7, "valid": 0.15, "test": 0.15})
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert s.select("split").distinct().count() == 3


def test_permutation_keeps_the_values(spark):
    d = spark.range(500).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    p = M.permuted(d, "id", ["a", "b"], buckets=8)
    assert p.agg(F.sum("a")).first()[0] == d.agg(F.sum("a")).first()[0]
    assert p.where("a * 3 <> b * 2").count() == 0 and p.where("a <> id * 2").count() > 450


def test_features_do_not_read_ahead(spark):
    rng = random.Random(2)
    rows = [(v, t, rng.randrange(100)) for v in (1, 2) for t in range(0, 100, 3)]
    s = spark.createDataFrame(rows, "video long, t long, me long")
    full = {(r["video"], r["t"]): r for r in L.laning_features(s, "video", "t", ["me"]).collect()}
    cut = L.laning_features(s.where("t <= 50"), "video", "t", ["me"]).collect()
    assert cut and all(full[r["video"], r["t"]] == r for r in cut)


def drops_of(t, hp, dead, share, within, quiet):
    """The rule as a loop over one recording."""
    out, i = [], 1
    while i < len(t):
        if dead[i] or hp[i] >= hp[i - 1]:
            i += 1
            continue
        start, last, j = i - 1, t[i], i
        while j < len(t) and not dead[j] and t[j] - t[start] <= within:
            if hp[j] < hp[j - 1]:
                last = t[j]
            elif t[j] - last >= quiet:
                break
            j += 1
        end = min(j, len(t) - 1)
        low = min(hp[start:end + 1])
        if hp[start] - low >= share:
            out.append((t[start], t[end], hp[start] - low, low))
        i = max(end, i) + 1
    return out


def test_health_drops(spark):
    r = random.Random(3)
    rows, want = [], []
    for k in range(30):
        t, hp = [0.0], [50]
        for _ in range(150):
            t.append(t[-1] + r.choice([1, 1, 1, 2, 5, 20]))
            hp.append(max(0, min(100, hp[-1] + r.choice([-30, -10, -1, 0, 0, 1, 10, 20]))))
        dead = [r.random() < 0.04 for _ in t]
        rows += list(zip([k] * len(t), t, map(float, hp), dead))
        want += [(k, *d) for d in drops_of(t, hp, dead, 20, 15, 3)]
    df = spark.createDataFrame(rows, "k int, t double, hp double, dead boolean").repartition(7)
    assert sorted(tuple(x) for x in Q.health_drops(df, "k", "t", "hp", "dead", (), 20, 15, 3).collect()) == sorted(want) and len(want) > 100
    drops = spark.createDataFrame([("A", 10.0), ("A", 40.0), ("A", 200.0)], "k string, start_t double")
    deaths, recalls = spark.createDataFrame([("A", 30.0)], "k string, at double"), spark.createDataFrame([("A", 40.0), ("A", 261.0)], "k string, at double")
    assert {x["start_t"]: x["outcome"] for x in Q.drop_outcomes(drops, deaths, recalls, "k", "at").collect()} == {10.0: "death", 40.0: "recall", 200.0: "stayed"}


def test_item_rules_and_titles(spark):
    items = spark.createDataFrame([(1, "Sword", "Wounds", ["Damage"], [], 3000, True, True), (2, "Boots", "", ["Boots"], [], 1000, True, True), (3, "Part", "", ["Damage"], ["1"], 2500, True, True)], D.ITEM_SCHEMA)
    assert {r["item"]: (r["finished"], r["boots"]) for r in D.item_rules(items).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}
    assert {r["flag"] for r in D.item_flags(items).where("item = 1").collect()} == {"items", "ad", "anti_heal"}
    f = spark.createDataFrame([("/v/IRELIA vs RENEKTON (TOP) NA Grandmaster 26.1_720p.mp4",), ("/v/nothing.mp4",)], "path string")
    a, b = R.with_title(f).collect()
    assert (a["champion"], a["opponent"], a["role"], a["region"], a["tier"], a["patch"]) == ("Irelia", "Renekton", "TOP", "NA", "GRANDMASTER", "26.1")
    assert b["champion"] is None


def test_tables(spark, folder):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, at int")
    assert T.append_new(a, f"{folder}/t", ["k"]).count() == 2
    assert {r["k"]: r["v"] for r in T.append_new(spark.createDataFrame([(2, "z", 9), (3, "w", 9)], a.schema), f"{folder}/t", ["k"]).collect()} == {1: "x", 2: "y", 3: "w"}
    up = T.upsert_latest(spark.createDataFrame([(2, "z", 9), (1, "old", 0)], a.schema), f"{folder}/t", f"{folder}/u", ["k"], "at")
    assert {r["k"]: r["v"] for r in up.collect()} == {1: "x", 2: "z", 3: "w"}
    m = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "m string, x int")
    T.replace_keys(m, f"{folder}/r", "m", 4)
    out = T.replace_keys(spark.createDataFrame([("A", 9)], m.schema), f"{folder}/r", "m", 4)
    assert sorted((r["m"], r["x"]) for r in out.collect()) == [("A", 9), ("B", 1)]
    assert [r["k"] for r in T.work_list(a, a.withColumn("version", F.col("k")), ["k"], "version", 1).collect()] == [2]


def test_recordings_and_files(spark, folder):
    import gzip
    import json
    import os

    os.makedirs(f"{folder}/rec")
    for name, n, mode in (("long", 70, "CLASSIC"), ("short", 5, "CLASSIC"), ("other", 70, "ARAM")):
        lines = [{"kind": "header", "recorded_at": 1.0, "game_mode": mode, "champion": "X"}] + [{"kind": "sample", "t": float(i), "hp": 1.0} for i in range(n)]
        with gzip.open(f"{folder}/rec/{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(json.dumps(x) for x in lines))
    headers, samples, _ = R.split_recordings(R.read_recordings(spark, f"{folder}/rec"))
    assert headers.count() == 1 and samples.count() == 70
    import shutil

    shutil.copy(f"{folder}/rec/long.jsonl.gz", f"{folder}/rec/moved.jsonl.gz")
    files = R.list_files(spark, f"{folder}/rec")
    assert files.count() == 4 and R.distinct_files(files).count() == 3


def test_asof_does_not_depend_on_partitioning(spark):
    """Right rows with equal times: the largest values count (forward: the smallest), however rows are spread."""
    from peerscope.operators import joins as J

    left = spark.createDataFrame([(1, 10), (1, 5), (2, 10)], "k int, t int")
    right = spark.createDataFrame([(1, 10, v, v * 7 % 20) for v in range(20)] + [(1, 7, v, -v) for v in range(5)] + [(2, 12, 3, 1), (2, 12, 4, 0)], "k int, rt int, v int, z int")
    for n in (1, 2, 5, 9):
        r = right.repartition(n)
        back = {(x["k"], x["t"]): x["v"] for x in J.asof(left, r, ["k"], "t", "rt", {"v": "v"}).collect()}
        assert back == {(1, 10): 19, (1, 5): None, (2, 10): None}
        by_z = {(x["k"], x["t"]): x["v"] for x in J.asof(left, r, ["k"], "t", "rt", {"v": "v"}, tie=["z"]).collect()}
        assert by_z[(1, 10)] == max(range(20), key=lambda v: v * 7 % 20)
        ahead = {(x["k"], x["t"]): x["v"] for x in J.asof(left, r, ["k"], "t", "rt", {"v": "v"}, direction="forward", strict=True).collect()}
        assert ahead == {(1, 10): None, (1, 5): 0, (2, 10): 3}


def test_shapley_has_no_cap(spark):
    """Nine groups change at once: all are there, and together they explain the whole change."""
    groups = {f"g{i}": [f"c{i}"] for i in range(9)}
    names = [f"c{i}" for i in range(9)]
    before = spark.createDataFrame([(1, 0, *[0.0] * 9)], "moment int, t int, " + ", ".join(f"{n} double" for n in names))
    after = spark.createDataFrame([(1, 0, *[1.0 + i for i in range(9)])], before.schema)
    chance = lambda df, p: df.withColumn(p, sum((i + 1) * F.col(n) for i, n in enumerate(names)) + F.col("c7") * F.col("c8"))
    rows = {r["change"]: r for r in W.explained_changes(before, after, ["moment"], chance, groups).collect()}
    assert set(rows) == set(groups)
    assert sum(r["value"] for r in rows.values()) == pytest.approx(rows["g0"]["d"]) == pytest.approx(sum((i + 1) ** 2 for i in range(9)) + 72)
    assert rows["g3"]["value"] == pytest.approx(16) and rows["g7"]["value"] == pytest.approx(64 + 36)


def test_shared_folder(spark):
    """A folder of the application's own inside the shared one, cleared as a whole."""
    from peerscope.operators import scale

    base = scale.scratch_dir(spark)
    assert base.endswith(spark.sparkContext.applicationId)
    assert scale.written(spark.range(3)).count() == 3


def test_player_names_and_titles(spark):
    from peerscope.sources import dimensions as D

    text = "Abc #EU1 has joined\nxy#K,ABC#eu1; Some Body#NA12 left the room."
    df = spark.createDataFrame([(1, text), (2, None), (3, "".join(f"p{i}#T{i:02d}\n" for i in range(30)))], "k int, t string")
    got = [(r["k"], r["place"], r["name"], r["tag"]) for r in D.player_ids(df, "k", "t").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 1, "Abc", "EU1"), (1, 2, "Some Body", "NA12")] and sum(g[0] == 3 for g in got) == 30
    names = spark.createDataFrame([("/a/Lee Sin vs. Kha Zix (Jungle) EUW Diamond 26.3_1080p.mp4",), ("(Best) Ahri MID vs Zed (x y) - KR Challenger Patch 16.10.mkv",), ("holiday.mp4",)], "p string")
    cols = D.title_columns(F.col("p"))
    rows = [tuple(r) for r in names.select(*[cols[c] for c in ("champion", "opponent", "role", "region", "tier", "patch")]).collect()]
    assert rows == [("Lee Sin", "Kha Zix", "JUNGLE", "EUW", "DIAMOND", "26.3"), ("Ahri", "Zed", "MIDDLE", "KR", "CHALLENGER", "16.10"), (None,) * 6]


def test_readings_of_one_time(spark):
    """Readings of the same second are ordered by the tie columns, however they are spread."""
    rows = [(1, t // 4, t, (t * 7) % 5 > 1, float((t * 13) % 11) if t % 3 else None) for t in range(60)]
    seen = set()
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows, "k int, t int, i int, flag boolean, v double").repartition(n)
        runs = Q.run_length(df, ["k"], "t", F.col("flag"), 100, "held", ["i"]).select("i", "held")
        kept = Q.keep_long_runs(df, ["k"], "t", "flag", 1, "long", ["i"]).select("i", "long")
        full = Q.filled(df, ["k"], "t", ["v"], 100, ["i"]).select("i", "v_filled")
        seen.add(str(sorted(tuple(r) for r in runs.join(kept, "i").join(full, "i").collect())))
    assert len(seen) == 1
