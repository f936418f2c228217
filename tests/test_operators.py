"""Operators against hand-made rows and plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfold.functions import geometry as G
from stepfold.functions import text as T
from stepfold.operators import aggregates, grouped, joins, questions, state, tasks, view, windows


@given(st.lists(st.integers(0, 100_000), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_counts_round_trip(counts):
    assert G.decode_counts(G.encode_counts(counts)) == counts


@pytest.mark.parametrize("text", ["o", "P", "\x10", "ooo"])
def test_malformed_counts(text):
    with pytest.raises(ValueError):
        G.decode_counts(text)


def test_masks_and_runs(spark):
    rng = np.random.default_rng(1)
    masks = [np.zeros((7, 5), bool), np.ones((7, 5), bool), rng.random((7, 5)) < 0.4, np.eye(7, 5, dtype=bool)]
    rows = [(i, [int(x) for x in G.to_counts(m)]) for i, m in enumerate(masks)]
    for _, c in rows:
        assert (G.to_mask(c, 7, 5) == masks[_]).all()
    df = spark.createDataFrame(rows, "i long, c array<bigint>").select("i", G.rle_decode(G.rle_encode(F.col("c"))).alias("c"))
    df = df.select("i", G.foreground(F.col("c")).alias("r"))
    got = df.select("i", G.rle_area(F.col("r")).alias("area"), G.rle_bbox(F.col("r"), F.lit(7)).alias("b"), G.rle_contains(F.col("r"), F.lit(2), F.lit(3), F.lit(7)).alias("has")).collect()
    for g in got:
        m = masks[g.i]
        assert g.area == m.sum() and g.has == bool(m[3, 2])
        if m.any():
            ys, xs = np.nonzero(m)
            assert (g.b.x0, g.b.x1) == (xs.min(), xs.max() + 1)
            flat = m.T.ravel()
            wraps = any(flat[k * 7 - 1] and flat[k * 7] for k in range(1, 5))
            assert (g.b.y0, g.b.y1) == ((0, 7) if wraps else (ys.min(), ys.max() + 1))
        else:
            assert g.b is None


def test_tolerant_difference_spares_the_band():
    old = np.zeros((20, 20), bool)
    old[5:15, 5:15] = True
    moved = np.zeros_like(old)
    moved[6:16, 5:15] = True
    far = old.copy()
    far[0:3, 0:3] = True
    assert G.tolerant_sym_diff(old, moved, 2) == 0
    assert G.tolerant_sym_diff(old, far, 2) == 9


def test_asof_ties_and_no_version(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (1, 20), (2, 1)], "k int, at int")
    versions = spark.createDataFrame([(1, 9, 1, 10), (1, 9, 2, 11), (1, 9, 2, 12), (1, 12, 1, 13)], "k int, anchor int, version int, id int")
    got = joins.forward_asof(left, versions, ["k"], "at", "anchor", [F.col("version").desc(), F.col("id").desc()])
    assert {(r.k, r["at"]): r.version and r.version.id for r in got.collect()} == {(1, 5): 12, (1, 9): 12, (1, 20): None, (2, 1): None}


def test_segments_and_unchanged_recut(spark):
    marks = spark.createDataFrame([(1, 10, b) for b in (1, 4, 4, 11, 7)], "k int, last long, b long")
    seg = windows.segments(marks, ["k"], "b", "last")
    assert sorted((r.seg, r.start, r.end) for r in seg.collect()) == [(1, 1, 3), (2, 4, 6), (3, 7, 10)]
    assert windows.affected_steps(seg, seg, ["k"]).count() == 0


def test_gates_fail_loud(spark):
    rows = spark.createDataFrame([("fastened_by", None), ("blocked_by", "cable_tension"), ("blocked_by", None), ("new", "x")], "t string, m string")
    got = [sorted(r[0]) for r in rows.select(state.gated_verbs(F.col("t"), F.col("m"))).collect()]
    assert got == [["displace", "open", "remove"], ["remove"], sorted(state.GATED_VERBS), sorted(state.GATED_VERBS)]


def test_cascade_spares_what_left_before(spark):
    inst = spark.createDataFrame([("p", None, False), ("c", "p", True), ("g", "c", True), ("early", "p", True), ("loose", "p", False)], "k string, parent string, attached boolean")
    removed = spark.createDataFrame([("p", 9), ("early", 5)], "k string, step long")
    got = {r.k: (r.gone_at, r.left_with) for r in state.removal_cascade(inst, removed, "k", "parent", F.col("attached"), F.lit(True)).collect()}
    assert got == {"p": (9, None), "c": (9, "p"), "g": (9, "p"), "early": (5, None)}


def test_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "p int, c int")
    assert sorted(r.node for r in state.cycles(links, "p", "c").collect()) == [1, 2, 3]


def test_deadlocks_and_plans(spark):
    needs = spark.createDataFrame(
        [(1, "a", "e1", "b"), (1, "b", "e1", "a"), (1, "c", "e1", "a"), (1, "c", "e1", "d"), (1, "d", None, None), (1, "x", "e1", None), (1, "y", "e1", "x"), (1, "z", "e1", "c"), (1, "z", "e2", "d")],
        "m int, action string, edge string, alternative string",
    )
    got = {r.action: r.cycle for r in grouped.deadlocks(needs, ["m"]).collect()}
    assert got == {"a": "a,b", "b": "a,b", "x": "dead end", "y": "dead end"}
    goals = spark.createDataFrame([("z",), ("y",)], "goal string")
    plan = grouped.removal_plans(needs.crossJoin(goals), ["m"], "goal").orderBy("step").collect()
    assert [(r.goal, r.action) for r in plan] == [("z", "d"), ("z", "c"), ("z", "z")]


def test_nms_against_loop(spark):
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 60, (80, 2))
    wh = rng.integers(5, 40, (80, 2))
    rows = [(i % 3, i, i % 2, float(rng.integers(0, 20)), *map(int, (*xy[i], *(xy[i] + wh[i])))) for i in range(80)]
    df = spark.createDataFrame(rows, "frame long, id long, cls long, score double, x0 long, y0 long, x1 long, y1 long")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        clash = False
        for k in kept:
            if k[0] == r[0] and k[2] == r[2]:
                clash |= grouped.pair_iou(np.array([k[4:]], float), np.array([r[4:]], float))[0, 0] >= 0.3
        if not clash:
            kept.append(r)
    got = {r.id for r in grouped.nms(df, ["frame"], "cls", "score", "id", 0.3).collect()}
    assert got == {r[1] for r in kept}


def test_sides_without_rows(spark):
    box = spark.createDataFrame([(1, 7, 0.5, 0, 0, 4, 4), (2, 8, 0.5, 0, 0, 4, 4)], "f long, id long, s double, x0 int, y0 int, x1 int, y1 int")
    got = grouped.greedy_match(box, box.where("f = 1"), ["f"], "s", "id", "id")
    assert [(r.pred, r.truth) for r in got.collect()] == [(7, 7)]
    assert grouped.greedy_match(box.where("f = 2"), box.where("f = 1"), ["f"], "s", "id", "id").count() == 0
    alone = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "f int, k string, i int")
    above = spark.createDataFrame([(2, "a", "b")], "f int, below string, above string")
    assert [r.k for r in grouped.layer_order(alone, above, ["f"], "k", "i").orderBy("position").collect()] == ["a", "b"]


def test_layer_order_falls_back_on_a_cycle(spark):
    layers = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 0), (2, "a", 1), (2, "b", 0)], "f int, k string, i int")
    above = spark.createDataFrame([(1, "a", "c"), (2, "a", "b"), (2, "b", "a")], "f int, below string, above string")
    got = grouped.layer_order(layers, above, ["f"], "k", "i").orderBy("f", "position").collect()
    assert [(r.f, r.k, r.cyclic) for r in got] == [(1, "b", False), (1, "a", False), (1, "c", False), (2, "b", True), (2, "a", True)]


def test_water_fill(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 50), ("c", 9)], "s string, n long")
    got = {r.s: r.quota for r in aggregates.water_fill(counts, [], "s", 30).collect()}
    assert got == {"a": 2, "b": 19, "c": 9}


def test_bootstrap_is_repeatable_and_covers(spark):
    rows = spark.range(2000).select(F.lit(1).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    a, b = (grouped.bootstrap_ci(rows, ["g"], "id", "v", 100, 7).first() for _ in range(2))
    assert a == b and a.low < rows.agg(F.avg("v")).first()[0] < a.high and a.high - a.low < 0.1


def test_refresh_never_writes_verified(spark):
    stored = spark.createDataFrame([(1, 1.0, "verified"), (2, 1.0, "verified"), (3, 1.0, "auto"), (4, 1.0, "auto"), (6, 1.0, "verified")], "k int, value double, status string")
    fresh = spark.createDataFrame([(1, 1.5), (2, 9.0), (3, 2.0), (5, 3.0)], "k int, value double")
    acts = view.refresh_actions(stored, fresh, ["k"], F.abs(F.col("stored_value") - F.col("fresh_value")), F.lit(1.0))
    assert {r.k: r.action for r in acts.collect()} == {1: "keep", 2: "queue", 3: "update", 4: "delete", 5: "insert", 6: "queue"}
    assert {r.k: r.value for r in view.applied(acts, ["k"]).collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 5: 3.0, 6: 1.0}


def test_balance_and_ids(spark):
    rows = spark.createDataFrame([(1, s, "a" if s % 3 else "b") for s in range(20)], "e long, s long, l string")
    got = tasks.balanced_changes(rows, "e", "s", "l").groupBy("answer").count().collect()
    assert len({r["count"] for r in got}) == 1
    ids = [r.id for r in tasks.annotation_ids(spark.range(1000).withColumnRenamed("id", "x"), ["x"]).orderBy("x").collect()]
    assert ids == list(range(1, 1001))


def test_notes_and_ranges(spark):
    row = spark.createDataFrame([("a\nLS: old", "x\n y"), (None, None)], "n string, l string")
    assert [r[0] for r in row.select(T.merge_notes(F.col("n"), F.col("l"), "LS:")).collect()] == ["a\nLS: x; y", None]
    assert T.desktops("1-3, 7") == [1, 2, 3, 7]


def test_edges_of_every_status(spark):
    statuses = ["proposed", "accepted", "manual", "rejected", "accepted_orphan", "rejected_orphan"]
    edges = spark.createDataFrame([(f"t{i}", "fastened_by", None, "screw", s) for i, s in enumerate(statuses)], "target string, type string, mode string, blocker string, status string")
    now = spark.createDataFrame([("screw", "tight"), *[(f"t{i}", "closed") for i in range(6)]], "key string, state string")
    assert sorted(r.target for r in state.unmet(edges, now).collect()) == ["t0", "t1", "t2"]
    log = spark.createDataFrame([("screw", 0, 0, "tight")], "key string, step long, seq long, state string")
    acts = spark.createDataFrame([(i, f"t{i}", "remove", 5, i) for i in range(6)], "action_id long, key string, verb string, step long, seq long")
    assert sorted(r.action_id for r in state.replay_violations(log, acts, edges).collect()) == [0, 1, 2]


def test_nms_suppresses_at_the_threshold(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 0, 0, 10, 5)], "frame long, id long, cls long, score double, x0 long, y0 long, x1 long, y1 long")
    assert [r.id for r in grouped.nms(rows, ["frame"], "cls", "score", "id", 0.5).collect()] == [1]


def test_average_precision_without_predictions(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, True)], "c string, id long, s double, hit boolean")
    truths = spark.createDataFrame([("a", 2), ("b", 3)], "c string, n_truth long")
    got = {r.c: (r.ap, r.hits) for r in grouped.average_precision(rows, ["c"], "s", "id", F.col("hit"), truths).collect()}
    assert got == {"a": (0.5, 1), "b": (0.0, 0)}


def test_cascade_down_a_long_chain(spark):
    inst = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "k long, parent long")
    removed = spark.createDataFrame([(0, 9), (20, 4), (30, 12)], "k long, step long")
    got = {r.k: (r.gone_at, r.left_with) for r in state.removal_cascade(inst, removed, "k", "parent", F.lit(True), F.lit(True)).collect()}
    assert got == {0: (9, None), 20: (4, None)} | {i: (9, 0) for i in range(1, 20)} | {i: (4, 20) for i in range(21, 40)}


def test_corruptions_swap_neighbours(spark):
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate("abcdefg")] + [(2, 0, "x"), (2, 1, "x"), (3, 0, "y")], "d long, p long, a string")
    got = {r.d: (r.logged, r.corrupted) for r in questions.corruptions(rows, ["d"], "p", "a", 5).collect()}
    assert set(got) == {1} and got[1][0] == list("cdefg")
    wrong = [i for i, (a, b) in enumerate(zip(*got[1])) if a != b]
    assert sorted(got[1][1]) == list("cdefg") and len(wrong) == 2 and wrong[1] == wrong[0] + 1


def test_pick_is_stable(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("r"))
    got = rows.select("r", questions.pick(["a", "b", "c"], F.col("r")).alias("t")).collect()
    import zlib

    assert all(r.t == "abc"[zlib.crc32(r.r.encode()) % 3] for r in got)


def test_equal_keys_on_two_machines(spark):
    """The screw is tight on machine 1 and gone on machine 2: each machine answers for itself."""
    now = spark.createDataFrame([(m, "psu.01", "psu", "installed") for m in (1, 2)] + [(1, "screw.01", "screw", "tight"), (2, "screw.01", "screw", "removed")], "machine int, key string, cls string, state string")
    edges = spark.createDataFrame([(m, "psu.01", "fastened_by", "screw.01", None, "accepted") for m in (1, 2)], "machine int, target string, type string, blocker string, mode string, status string")
    verbs = spark.createDataFrame([("remove", "psu", "removed"), ("unscrew", "screw", "removed")], "verb string, cls string, to_state string")
    assert [r.machine for r in state.unmet(edges, now, ["machine"]).collect()] == [1]
    assert sorted(tuple(r) for r in state.legal_actions(now, edges, verbs, ["machine"]).collect()) == [(1, "screw.01", "unscrew"), (2, "psu.01", "remove")]
    assert sorted(tuple(r) for r in questions.certain_noes(now, edges, verbs, ["machine"]).collect()) == [(1, "psu.01", "remove", "blocked_by_graph"), (2, "screw.01", "unscrew", "inapplicable")]
    log = spark.createDataFrame([(1, "screw.01", 0, 0, "tight"), (2, "screw.01", 0, 0, "tight"), (2, "screw.01", 1, 0, "removed")], "machine int, key string, step int, seq int, state string")
    done = spark.createDataFrame([("a", 1, "psu.01", "remove", 2, 0), ("b", 2, "psu.01", "remove", 2, 0)], "action_id string, machine int, key string, verb string, step int, seq int")
    assert [r.action_id for r in state.replay_violations(log, done, edges, ["machine"]).collect()] == ["a"]


def test_query_names_are_unique():
    from stepfold.plans import registry

    with pytest.raises(ValueError):
        registry.query("legal_actions")(lambda spark, sf_dir: None)


def test_draft_ids_are_stable(spark):
    import zlib

    from stepfold.functions import parts

    rows = spark.createDataFrame([("r1",), ("é",), ("",), (None,)], "id string").select("id", parts.draft_id(F.col("id")).alias("n")).collect()
    assert {r.id: r.n for r in rows} == {"r1": zlib.crc32(b"r1") & 0x7FFFFFFF, "é": zlib.crc32("é".encode()) & 0x7FFFFFFF, "": None, None: None}


def test_closest_no_by_brute_force(spark):
    import random
    import zlib

    from stepfold.operators import questions as Q

    rnd = random.Random(4)
    verbs, classes = ["open", "remove", "unscrew"], ["fan", "ram", None]
    shown = [(m, rnd.choice(verbs), rnd.choice(classes)) for m in range(30) for _ in range(3)]
    noes = [(m, rnd.choice(verbs), rnd.choice(classes), f"k{i}", rnd.choice([Q.GRAPH, Q.STATE])) for m in range(28) for i in range(rnd.randint(0, 5))]
    spoken = [("open",), ("remove",), ("open",)]
    got = Q.matched_noes(
        spark.createDataFrame(shown, "m long, verb string, cls string"), spark.createDataFrame(noes, "m long, verb string, cls string, key string, cause string"), ["m"], spark.createDataFrame(spoken, "verb string"))

    def rank(m, verb, cls, n):
        same_cls = cls is not None and n[2] == cls
        tier = 0 if n[1] == verb and same_cls else 1 if n[1] == verb else 2 if same_cls else 3
        return tier, (n[1],) not in spoken, n[4] != Q.GRAPH, zlib.crc32(f"{m}|{n[1]}|{n[3]}".encode()), n[1], n[3], n[4]

    want = set()
    for m, verb, cls in set(shown):
        own = [rank(m, verb, cls, n) for n in noes if n[0] == m]
        if own:
            best = min(own)
            want.add((m, cls, verb, best[4], best[5], best[6], best[0]))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr((m, *rest)) for m, cls, *rest in want)


def test_tasks_follow_the_rows(spark, sf, monkeypatch):
    from stepfold import session
    from stepfold.plans import frames, truths

    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    steps = spark.read.parquet(f"{sf}/orders.parquet").count()
    needs = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert frames.frame_index(spark, sf).rdd.getNumPartitions() == -(-2 * steps // 100)
    assert frames.index_round_trip(spark, sf).rdd.getNumPartitions() == -(-2 * steps // 100)
    assert truths.chosen_keyframes(spark, sf).rdd.getNumPartitions() == -(-needs // 100)
