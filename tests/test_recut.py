"""The pose re-cut against a step-by-step brute force, and run twice."""

import random

import pytest

from stepfold.functions import geometry as G
from stepfold.operators import joins as J
from stepfold.operators import recut as R
from stepfold.plans import recuts

BY = ["m"]
SEGMENTS = "m long, seg long, start long, end long, ref long, corners string, homography string, roi string, bench_roi string"
KEYFRAMES = "m long, id string, instance string, placement int, seg long, anchor long, source string, version long, edits long, draft string"


def made(views, seed):
    rnd = random.Random(seed)
    t = {k: [] for k in ("segments", "keyframes", "parts", "orders", "pairs", "frames", "frozen", "carry", "bounds")}
    maybe = lambda v: v if rnd.random() < 0.5 else None
    for m in range(views):
        n = rnd.randint(1, 24)
        cuts = lambda: sorted(rnd.sample(range(2, n + 1), min(n - 1, rnd.randint(0, 4))))  # noqa: B023, E731
        old = [1, *cuts()]
        new = old[1:] if rnd.random() < 0.25 else cuts()
        ends = [b - 1 for b in old[1:]] + [n]
        for s, (a, b) in enumerate(zip(old, ends), 1):
            ref = rnd.choice([a, b, b, None, b + 2]) if rnd.random() < 0.3 else rnd.randint(a, b)
            t["segments"].append((m, s, a, b, ref, maybe(f"c{s}"), maybe(f"h{s}"), maybe(f"r{s}"), maybe(f"b{rnd.randint(0, 1)}")))
        t["bounds"] += [(m, b, rnd.random() < 0.5) for b in new]
        t["carry"] += [(m, b) for b in new if rnd.random() < 0.6]
        for i in range(rnd.randint(0, 12)):
            copy = rnd.random() < 0.3
            anchor = rnd.choice(old) - 1 if copy else rnd.randint(1, n + 2)
            seg = rnd.randint(0, len(old) + 1)
            t["keyframes"].append((m, f"{m}-{i}", rnd.choice("xy"), rnd.randint(0, 1), seg, anchor, "carried" if copy else "human", rnd.choice([1, 1, 2]), rnd.choice([0, 0, 3]), maybe("d")))
            t["parts"] += [(f"{m}-{i}", j, f"p{j}") for j in range(rnd.randint(0, 2))]
        for s in range(0, len(old) + 3):
            if rnd.random() < 0.7:
                t["orders"].append((m, s, rnd.sample("abcdef", rnd.randint(0, 5)), rnd.randint(1, 4)))
            t["pairs"] += [(m, s, "a", x) for x in rnd.sample("bcd", rnd.randint(0, 2))]
        t["frames"] += [(m, s, rnd.choice([None, rnd.randint(0, len(old) + 1)])) for s in range(1, n + 2)]
        t["frozen"] += [(m, s) for s in range(1, n + 1) if rnd.random() < 0.5]
    return t


def tables(spark, t):
    kinds = {"segments": SEGMENTS, "keyframes": KEYFRAMES, "parts": "id string, idx int, name string", "orders": "m long, seg long, layers array<string>, version long", "pairs": "m long, seg long, above string, below string", "frames": "m long, step long, seg long", "frozen": "m long, step long", "carry": "m long, step long", "bounds": "m long, step long, small boolean"}
    return {k: spark.createDataFrame(t[k], kinds[k]) for k in kinds}


def brute(t):
    """Each view by itself, by looking up every step."""
    out = {k: set() for k in ("changed", "segments", "keyframes", "parts", "orders", "pairs", "frames", "rechecks", "moves", "discarded", "turned_pairs", "orphans", "kept_copies")}
    parts = {}
    for i, idx, name in t["parts"]:
        parts.setdefault(i, []).append((idx, name))
    for m in {r[0] for r in t["segments"]}:
        mine = lambda k: [r for r in t[k] if r[0] == m]  # noqa: B023, E731
        seg = {r[1]: r for r in mine("segments")}
        n = max(r[3] for r in seg.values())
        small = {b: s for _, b, s in mine("bounds") if 1 < b <= n}
        number, at, new = 0, {}, {}
        for step in range(1, n + 1):
            number += step == 1 or step in small
            at[step] = number
            new.setdefault(number, []).append(step)
        was = {step: s for s, r in seg.items() for step in range(r[2], r[3] + 1)}
        whole = all(at[k] == was[k] for k in at) and len(new) == len(seg)
        if whole and all(r[4] is not None and r[2] <= r[4] <= r[3] for r in seg.values()):
            for k in ("segments", "keyframes", "pairs", "frames"):
                out[k] |= set(mine(k))
            out["orders"] |= {(m, s, tuple(o), v) for _, s, o, v in mine("orders")}
            out["parts"] |= {(r[1], *p) for r in mine("keyframes") for p in parts.get(r[1], [])}
            continue
        out["changed"].add((m,))
        pieces = {s: sorted({at[k] for k in range(r[2], r[3] + 1)}) for s, r in seg.items()}
        home = {s: p[0] for s, p in pieces.items()}
        drop_steps, picks = set(), {}
        for g, steps in new.items():
            of = sorted({was[k] for k in steps}, key=lambda s: seg[s][2])
            inside = [s for s in of if seg[s][4] in steps]
            drawn = [s for s in inside if seg[s][5] or seg[s][6]]
            k = of[0] if len(of) == 1 else max(drawn, key=lambda s: seg[s][4]) if drawn else max(inside, key=lambda s: seg[s][4]) if inside else of[-1]
            picks[g] = (k, of)
            row, holds = seg[k], seg[k][4] in steps
            homes = [p for p in pieces[k] if seg[k][4] in new[p]] or pieces[k][-1:]
            between = range(min(g, homes[0]) + 1, max(g, homes[0]) + 1)
            boxes = [None, None]
            if all(small[new[p][0]] for p in between):
                for i in (7, 8):
                    having = [s for s in of if seg[s][i]]
                    boxes[i - 7] = row[i] or (seg[max(having, key=lambda s: (seg[s][4] or 0, s))][i] if having else None)
            made = (m, g, steps[0], steps[-1], row[4] if holds else steps[-1], row[5] if holds else None, row[6] if holds else None, *boxes)
            out["segments"].add(made)
            if not holds:
                lost = bool(row[5] or row[6])
                out["moves"].add((m, g, k, steps[-1], lost))
                drop_steps |= set(steps) if lost else set()
            for s in of:
                if s != k:
                    now = (row[5], row[6], *boxes)
                    out["discarded"] |= {(m, s, g, f, seg[s][5 + i]) for i, f in enumerate(("corners", "homography", "roi", "bench_roi")) if seg[s][5 + i] and seg[s][5 + i] != now[i]}
        order, pair = {s: (o, v) for _, s, o, v in mine("orders")}, mine("pairs")
        for g, (k, of) in picks.items():
            having = [s for s in of if s in order]
            if having:
                line = list(order[k][0]) if k in order else []
                for s in [s for s in having if s != k]:
                    line += [e for e in order[s][0] if e not in line]
                    theirs = order[s][0]
                    out["turned_pairs"] |= {(m, s, g, a, b) for i, a in enumerate(theirs) for b in theirs[i + 1:] if line.index(a) > line.index(b)}
                out["orders"].add((m, g, tuple(line), order[k][1] if k in order else 1))
                if g in order and g not in seg:
                    out["orphans"].add((m, "orders", g, True))
            elif g in order and g not in seg:
                out["orders"].add((m, g, tuple(order[g][0]), order[g][1]))
        for s, (o, v) in order.items():
            if s not in seg and s not in new:
                out["orders"].add((m, s, tuple(o), v))
                out["orphans"].add((m, "orders", s, False))
        for _, s, a, b in pair:
            if s in seg:
                out["pairs"] |= {(m, g, a, b) for g in pieces[s]}
            else:
                out["orphans"].add((m, "pairs", s, s in new))
                if s not in new:
                    out["pairs"].add((m, s, a, b))
        old_starts, new_starts = {r[2] for r in seg.values()}, {p[0] for p in new.values()}
        for r in mine("keyframes"):
            _, i, inst, place, s, anchor, source, version, edits, draft = r
            if source == "carried" and anchor + 1 in old_starts - new_starts - {1}:
                if version <= 1 and edits <= 0:
                    continue_copy = True
                else:
                    out["kept_copies"].add((m, i))
                    continue_copy = False
            else:
                continue_copy = False
            if not continue_copy:
                out["keyframes"].add((m, i, inst, place, at.get(anchor, home[s]) if s in seg else s, anchor, source, version, edits, draft))
                out["parts"] |= {(i, *p) for p in parts.get(i, [])}
            if s not in seg:
                continue
            chain = {x[5] for x in mine("keyframes") if x[2:5] == r[2:5]}
            for b in {b for _, b in mine("carry")} & (new_starts - old_starts):
                earlier = [a for a in chain if a < anchor]
                low = max(earlier) + 1 if earlier else seg[s][2]
                if low < b <= anchor:
                    out["keyframes"].add((m, f"{i}@{b - 1}", inst, place, at[b - 1], b - 1, "carried", 1, 0, draft))
                    out["parts"] |= {(f"{i}@{b - 1}", *p) for p in parts.get(i, [])}
        for _, step, s in mine("frames"):
            to = s if s not in seg else at[step] if was.get(step) == s else home[s]
            out["frames"].add((m, step, to))
        for s, r in seg.items():
            steps = new[home[s]]
            if (steps[0], steps[-1]) != (r[2], r[3]):
                drop_steps |= set(range(r[2], r[3] + 1))
        out["rechecks"] |= {(m, s) for _, s in mine("frozen") if s in drop_steps}
    return out


def plain(df):
    rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()]
    assert len(rows) == len(set(rows)), "repeated rows"
    return set(rows)


@pytest.mark.parametrize("seed", [1])
def test_recut(spark, seed):
    t = made(200, seed)
    d = tables(spark, t)
    got = R.recut(d.pop("segments"), d.pop("bounds"), BY, **d)
    want = brute(t)
    for name, rows in want.items():
        assert plain(got[name]) == rows, name
        assert rows, name


def test_recut_again_changes_nothing(spark):
    t = made(40, 3)
    d = tables(spark, t)
    bounds = d.pop("bounds")
    once = R.recut(d.pop("segments"), bounds, BY, **d)
    again = {**d, **{k: once[k] for k in ("keyframes", "parts", "orders", "pairs", "frames")}}
    twice = R.recut(once["segments"], bounds, BY, **again)
    assert twice["changed"].count() == 0 and twice["rechecks"].count() == 0
    for k in ("segments", "keyframes", "parts", "orders", "pairs", "frames"):
        assert plain(twice[k]) == plain(once[k]), k


def test_empty_and_rangeless(spark):
    empty = {k: [] for k in ("segments", "keyframes", "parts", "orders", "pairs", "frames", "frozen", "carry", "bounds")}
    d = tables(spark, empty)
    assert all(df.count() == 0 for df in R.recut(d.pop("segments"), d.pop("bounds"), BY, **d).values())
    d = tables(spark, empty | {"segments": [(1, 1, None, None, None, "c", None, None, None)], "bounds": [(1, 4, True)]})
    got = R.recut(d.pop("segments"), d.pop("bounds"), BY, **d)
    assert got["segments"].count() == 1 and got["changed"].count() == 0


def test_boundaries(spark):
    t = tables(spark, {k: [] for k in ("keyframes", "parts", "orders", "pairs", "frames", "frozen", "carry", "bounds")} | {"segments": [(1, 1, 1, 20, 20, None, None, None, None)]})
    segments = t["segments"].selectExpr("m", "'scan' as view", *[c for c in t["segments"].columns if c != "m"])
    turns = spark.createDataFrame([(1, 1), (1, 9), (1, 21), (2, 4)], "m long, step long")
    breaks = spark.createDataFrame([(1, "scan", 9, "accepted", 3.0), (1, "scan", 12, "accepted", None), (1, "scan", 14, "rejected", 3.0), (1, "oak", 15, "accepted", 3.0), (1, "scan", 16, "accepted", 25.0)], "m long, view string, step long, status string, px double")
    got = {(r.m, r.view, r.step, r.small) for r in R.boundaries(segments, turns, breaks, ["m", "view"]).collect()}
    assert got == {(1, "scan", 9, True), (1, "scan", 12, False), (1, "scan", 16, False)}


def test_explained_is_null_safe_and_exact(spark):
    rnd = random.Random(5)
    box = lambda: (x := rnd.randint(-40, 90), y := rnd.randint(-40, 90), x + rnd.randint(0, 50), y + rnd.randint(0, 50))
    blobs = [(f, i, *box()) for f in range(3) for i in range(25)] + [(0, None, None, None, None, None), (None, 99, 0, 0, 5, 5)]
    boxes = [(f, *box()) for f in range(3) for _ in range(4)] + [(1, None, None, None, None)]
    at = lambda p: ", ".join(f"{p}{c} double" for c in ("x0", "y0", "x1", "y1"))
    known = spark.createDataFrame([(r[0], *[None if v is None else float(v) for v in r[1:]]) for r in boxes], f"frame long, {at('b_')}")
    asked = spark.createDataFrame([(r[0], r[1], *[None if v is None else float(v) for v in r[2:]]) for r in blobs], f"frame long, id long, {at('a_')}")
    got = J.explained(asked, known, ["frame"], G.iou(G.box("a_"), G.box("b_")), G.containment(G.box("a_"), G.box("b_")), cell=20)

    def hit(a, b):
        i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return i > 0 and (i / (size(a) + size(b) - i) >= 0.1 or i / size(a) >= 0.7)

    want = {(r[0], r[1]): any(r[0] == b[0] and None not in (*r[2:], *b[1:]) and hit(r[2:], b[1:]) for b in boxes) for r in blobs}
    assert {(r.frame, r.id): r.explained for r in got.collect()} == want and True in want.values()


def test_no_side_is_sent_to_the_driver(spark, sf):
    """Exploded rows look small to Spark, so a re-cut of many views would collect them for broadcasts."""
    plans = {name: df._jdf.queryExecution().sparkPlan().toString() for name, df in recuts._done(spark, sf).items()}
    assert [name for name, plan in plans.items() if "BroadcastHashJoin" in plan] == []
