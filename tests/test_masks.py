"""Runs against painted bitmaps."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepfold.functions import runs as R
from stepfold.operators import masks as M
from stepfold.plans import masks as P


def painted(runs, h, w):
    m = np.zeros((h, w), dtype=bool)
    for x, y0, y1 in runs or []:
        m[y0:y1, x] = True
    return m


def runs_of(m):
    out = []
    for x in range(m.shape[1]):
        step = np.diff(np.concatenate([[0], m[:, x].astype(int), [0]]))
        out += [(x, int(a), int(b)) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
    return out


def some_masks():
    rng = np.random.default_rng(1)
    out = [np.zeros((9, 7), bool), np.ones((9, 7), bool), np.ones((1, 1), bool), np.zeros((1, 5), bool)]
    ring = np.zeros((20, 30), bool)
    ring[0, :] = ring[-1, :] = ring[:, 0] = ring[:, -1] = True
    out += [ring, np.pad(ring, 3), ring[:, ::-1] | np.eye(20, 30, dtype=bool)]
    for share in (0.05, 0.3, 0.5, 0.7, 0.95):
        out += [rng.random((int(rng.integers(3, 30)), int(rng.integers(3, 30)))) < share for _ in range(4)]
    blob = np.zeros((40, 50), bool)
    blob[5:30, 8:40] = True
    blob[10:20, 15:30] = False
    blob[13:16, 18:22] = True
    return [*out, blob]


def neighbours(m, diagonal):
    """Label of each pixel's component, by flood fill; 0 outside."""
    label, n = np.zeros(m.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(m)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for da, db in steps:
                c, d = a + da, b + db
                if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not label[c, d]:
                    label[c, d] = n
                    todo.append((c, d))
    return label, n


def grown(m, brush):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        for dx, r in brush:
            if 0 <= x + dx < m.shape[1]:
                out[max(y - r, 0) : y + r + 1, x + dx] = True
    return out


def edge(m, outside):
    p = np.pad(m, 1, constant_values=False) if outside else np.pad(m, 1, mode="edge")
    inner = np.ones_like(m)
    for a in range(3):
        for b in range(3):
            inner &= p[a : a + m.shape[0], b : b + m.shape[1]]
    return m & ~inner


@pytest.fixture(scope="module")
def table(spark):
    masks = some_masks()
    rng = np.random.default_rng(7)
    others = [m ^ (rng.random(m.shape) < 0.1) if i % 3 else np.roll(m, 1, axis=1) for i, m in enumerate(masks)]
    rows = [(i, runs_of(a), runs_of(b), *a.shape) for i, (a, b) in enumerate(zip(masks, others))] + [(-1, None, None, 5, 5), (-2, [], None, 4, 4), (-3, [(9, 0, 2), (1, -3, 2), (1, 1, 9), (0, 3, 3)], [], 4, 4)]
    return masks, others, spark.createDataFrame(rows, f"i long, a {R.RUNS}, b {R.RUNS}, h int, w int").repartition(3)


def got(df, column):
    return {r.i: r.v for r in df.select("i", column.alias("v")).collect()}


def test_cleanup_against_flood_fill(table):
    masks, _, df = table
    h, w = F.col("h"), F.col("w")
    parts, filled, kept = got(df, R.n_components(F.col("a"), h, w)), got(df, R.filled(F.col("a"), h, w)), got(df, R.without_specks(F.col("a"), h, w, 4))
    for i, m in enumerate(masks):
        label, n = neighbours(m, True)
        assert parts[i] == n
        size = np.bincount(label.ravel())
        assert kept[i] == runs_of(m & (size[label] >= 4))
        ground, _ = neighbours(~m, False)
        out = set(np.concatenate([ground[0], ground[-1], ground[:, 0], ground[:, -1]]).tolist())
        assert filled[i] == runs_of(m | ((ground > 0) & ~np.isin(ground, list(out))))
    assert filled[-1] is None and parts[-1] is None and filled[-2] == [] and parts[-2] == 0
    assert filled[-3] == [(1, 0, 4)]  # clipped, and what overlaps is one


def test_comparison_against_painting(table):
    masks, others, df = table
    h, w = F.col("h"), F.col("w")
    for tolerance in (0, 1, 2):
        far, score = got(df, R.beyond(F.col("a"), F.col("b"), h, w, tolerance)), got(df, R.boundary_score(F.col("a"), F.col("b"), h, w, tolerance))
        for i, (a, b) in enumerate(zip(masks, others)):
            assert far[i] == ((a ^ b) & ~grown(edge(a, True), R.square(tolerance))).sum()
            ea, eb, disc = edge(a, False), edge(b, False), R.disc(tolerance)
            p, r = (ea & grown(eb, disc)).sum() / max(ea.sum(), 1), (eb & grown(ea, disc)).sum() / max(eb.sum(), 1)
            want = 1.0 if not ea.any() and not eb.any() else 2 * p * r / (p + r) if p + r else 0.0
            assert abs(score[i] - want) < 1e-12
        assert far[-1] is None and far[-2] is None


def test_round_brush():
    assert R.disc(2) == [(-2, 1), (-1, 1), (0, 2), (1, 1), (2, 1)]  # its rows are 1, 5, 5, 5 and 1 wide


@pytest.mark.parametrize("scale, theta, tx, ty", [(1.0, 0.0, 0.0, 0.0), (1.0, np.pi / 2, 30.0, -2.0), (2.5, 0.3, -4.0, 3.5), (0.4, -2.0, 11.0, 9.0), (1.0, 0.0, 3.0, -2.0), (0.0, 0.0, 0.0, 0.0)])
def test_warp_against_a_pixel_loop(table, scale, theta, tx, ty, monkeypatch):
    masks, _, df = table
    monkeypatch.setattr(R, "BLOCK", 50)
    height, width = 33, 41
    moved = got(df, R.warped(F.col("a"), F.col("h"), F.col("w"), *[F.lit(float(v)) for v in (scale, theta, tx, ty)], F.lit(height), F.lit(width)))
    for i, m in enumerate(masks):
        want = np.zeros((height, width), bool)
        for y in range(height if scale else 0):
            for x in range(width):
                u = int(np.floor((np.cos(theta) * (x - tx) + np.sin(theta) * (y - ty)) / scale + 0.5))
                v = int(np.floor((np.cos(theta) * (y - ty) - np.sin(theta) * (x - tx)) / scale + 0.5))
                want[y, x] = 0 <= u < m.shape[1] and 0 <= v < m.shape[0] and m[v, u]
        assert moved[i] == runs_of(want)
    if (scale, theta, tx, ty) == (1.0, 0.0, 0.0, 0.0):
        assert moved[len(masks) - 2] == runs_of(np.pad(masks[-2], ((0, height - masks[-2].shape[0]), (0, width - masks[-2].shape[1]))))
    assert moved[-1] is None


def test_counts_and_flat_runs(table):
    masks, _, df = table
    counts = got(df, R.counts(F.col("a"), F.col("h"), F.col("w")))
    for i, m in enumerate(masks):
        flat = np.repeat(np.arange(len(counts[i])) % 2 == 1, counts[i])
        assert (flat.reshape(m.shape[1], m.shape[0]).T == m).all()
    flat = df.sparkSession.createDataFrame([(1, [(2, 11), (13, 14), (5, 5)])], "i int, f array<struct<start:long,end:long>>")
    assert got(flat, R.from_flat(F.col("f"), F.lit(4))) == {1: [(0, 2, 4), (1, 0, 4), (2, 0, 3), (3, 1, 2)]}


def drawn(ring, h, w):
    """Even-odd with edges, and the outline, pixel by pixel."""
    m = np.zeros((h, w), bool)
    if len(ring) < 3:
        return m
    edges = [sorted((a, b), key=lambda p: p[0]) if a[0] != b[0] else (a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    for x in range(w):
        for y in range(h):
            across = [(a, b) for a, b in edges if a[0] <= x < b[0]]
            side = [(y - a[1]) * (b[0] - a[0]) - (x - a[0]) * (b[1] - a[1]) for a, b in across]
            m[y, x] = sum(s > 0 for s in side) % 2 == 1 or 0 in side
    for (ax, ay), (bx, by) in edges:
        steep = abs(by - ay) > abs(bx - ax)
        n = max(abs(by - ay), abs(bx - ax))
        for k in range(n + 1):
            if steep:
                y = min(ay, by) + k
                x = ax + int(np.floor((y - ay) * (bx - ax) / (by - ay) + 0.5))
            else:
                x = min(ax, bx) + k
                y = ay if ax == bx else ay + int(np.floor((x - ax) * (by - ay) / (bx - ax) + 0.5))
            if 0 <= x < w and 0 <= y < h:
                m[y, x] = True
    return m


def test_polygons_against_pixels(spark):
    rng = np.random.default_rng(3)
    h, w = 18, 21
    rings = [(k, j, [(int(x), int(y)) for x, y in rng.integers(-4, 25, (int(rng.integers(1, 9)), 2))]) for k in range(60) for j in range(1 + k % 3)]
    rings += [(100, 0, [(2, 2), (12, 2), (12, 12), (2, 12)]), (101, 0, [(5, 5)] * 4), (102, 0, [(3, 3), (3, 9), (3, 6)]), (103, 0, [(0, 0), (10, 10), (10, 0), (0, 10)]), (104, 0, [(1, 1), (15, 1), (15, 15), (1, 15), (1, 1), (5, 5), (5, 10), (10, 10), (10, 5), (5, 5)]), (105, 0, []), (106, 0, None)]
    df = spark.createDataFrame(rings, "k int, ring int, points array<struct<x:int,y:int>>").withColumn("x", F.lit("clash"))
    found = {r.k: [tuple(x) for x in r.runs] for r in M.gathered(M.polygon_runs(df, ["k"], "ring", "points", F.lit(h), F.lit(w)), ["k"]).collect()}
    want = {}
    for k, _, ring in rings:
        want[k] = want.get(k, np.zeros((h, w), bool)) | drawn(ring or [], h, w)
    assert found == {k: runs_of(m) for k, m in want.items() if m.any()}
    assert (2, 2, 13) in found[100] and {(7, 1, 6), (7, 10, 16)} <= set(found[104])  # a hole stays open


def test_label_tool_shapes(spark):
    value = "struct<x:double,y:double,width:double,height:double,radiusX:double,radiusY:double,rotation:double,points:array<array<double>>>"
    rows = [
        (1, "rectangle", (10.0, 20.0, 30.0, 20.0, None, None, None, None), 40, 30),
        (2, "rectangle", (50.0, 50.0, 25.0, 20.0, None, None, 90.0, None), 40, 30),
        (3, "ellipse", (50.0, 50.0, None, None, 25.0, 20.0, 0.0, None), 40, 30),
        (4, "ellipse", (50.0, 50.0, None, None, 25.0, 10.0, 30.0, None), 40, 30),
        (5, "polygon", (None, None, None, None, None, None, None, [[0.0, 0.0], [50.0, 0.0], [50.0, 50.0]]), 40, 30),
        (6, "choices", (None,) * 8, 40, 30),
        (7, "rectangle", (None, 20.0, 30.0, 20.0, None, None, None, None), 40, 30),
        (8, "ellipse", (0.0, 0.0, None, None, 0.0, 0.0, None, None), 40, 30),
    ]
    df = spark.createDataFrame(rows, f"i int, type string, value {value}, width int, height int")
    found = {r.i: painted([tuple(x) for x in r.runs], 30, 40) for r in M.gathered(M.label_tool_runs(df, ["i"]), ["i"]).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 8]
    assert found[1].sum() == 13 * 7 and found[1][6:13, 4:17].all() and found[2].sum() == 11 * 7 and found[2][15:26, 14:21].all()
    y, x = np.mgrid[:30, :40]
    for i, (rx, ry, t) in {3: (10, 6, 0.0), 4: (10, 3, np.pi / 6)}.items():
        u, v = (x - 20) * np.cos(t) + (y - 15) * np.sin(t), (y - 15) * np.cos(t) - (x - 20) * np.sin(t)
        assert (found[i] == ((u / rx) ** 2 + (v / ry) ** 2 <= 1 + 1e-9)).all()
    assert (found[5] == drawn([(0, 0), (20, 0), (20, 15)], 30, 40)).all()
    assert runs_of(found[8]) == [(0, 0, 2), (1, 0, 1)]


def test_compiled_runs_against_painting(spark):
    rng = np.random.default_rng(9)
    h, w, layers, occluders = 25, 30, [], []
    for frame in range(5):
        for k in range(12):
            for _ in range(int(rng.integers(1, 3))):
                x0, y0 = int(rng.integers(0, w - 2)), int(rng.integers(0, h - 2))
                m = np.zeros((h, w), bool)
                m[y0 : y0 + int(rng.integers(1, 14)), x0 : x0 + int(rng.integers(1, 14))] = True
                m &= rng.random((h, w)) < 0.8
                layers.append((frame, "ab"[k % 2], f"p{k:02}", int(rng.integers(0, 8)), m))
        if frame % 2:
            m = np.zeros((h, w), bool)
            m[:, 5:9] = True
            occluders += [(frame, m), (frame, m)]
    layers += [(9, "a", "low", 0, np.ones((h, w), bool)), (9, "a", "high", 1, np.ones((h, w), bool)), (9, "b", "alone", 0, np.ones((h, w), bool))]
    df = spark.createDataFrame([(f, p, i, z, *r) for f, p, i, z, m in layers for r in runs_of(m)], "frame int, placement string, instance string, layer int, x int, y0 int, y1 int")
    over = spark.createDataFrame([(f, *r) for f, m in occluders for r in runs_of(m)], "frame int, x int, y0 int, y1 int")
    out = {(r.frame, r.instance): r for r in M.compiled_runs(df, ["frame"], over).collect()}
    assert len(out) == len({(f, i) for f, _, i, _, m in layers if m.any()})
    for frame, instance in out:
        same = [x for x in layers if x[0] == frame and x[1] == next(y[1] for y in layers if y[0] == frame and y[2] == instance)]
        top = np.full((h, w), "", dtype=object)
        for _, _, i, _, m in sorted(same, key=lambda x: (x[3], x[2])):
            top[m] = i
        seen = top == instance
        for f, m in occluders:
            if f == frame:
                seen &= ~m
        amodal = np.logical_or.reduce([m for f, _, i, _, m in same if i == instance])
        r = out[frame, instance]
        assert [tuple(x) for x in r.runs] == runs_of(seen)
        assert (r.amodal_px, r.visible_px) == (amodal.sum(), seen.sum()) and abs(r.occlusion - (1 - seen.sum() / amodal.sum())) < 1e-12
    assert out[9, "low"].runs == [] and out[9, "low"].visibility == "occluded_full" and out[9, "alone"].visibility == "visible"
    assert M.compiled_runs(df, ["frame"]).where("frame = 1 and occlusion > 0").count() > 0
    assert M.compiled_runs(df.limit(0), ["frame"], over).count() == 0


def test_queries_without_sql(spark, sf):
    """Clean-up and boundary scores of the registered queries against painting."""
    masks = {r.k: painted([tuple(x) for x in r.runs], 20, 24) for r in M.gathered(P._order_masks(spark, sf), ["k"]).collect()}
    for r in P.mask_cleanup(spark, sf).collect():
        m = masks[r.k]
        label, n = neighbours(m, True)
        size = np.bincount(label.ravel())
        ground, _ = neighbours(~m, False)
        out = set(np.concatenate([ground[0], ground[-1], ground[:, 0], ground[:, -1]]).tolist())
        kept = m & (size[label] >= 12)
        want = (m.sum(), n, (m | ((ground > 0) & ~np.isin(ground, list(out)))).sum(), kept.sum(), len(runs_of(kept)))
        assert (r.area, r.n_components, r.filled_area, r.kept_area, r.kept_runs) == want
    assert P.boundary_scores(spark, sf).where("instance % 6 in (0, 5) and f1 <> 1").count() == 0


def test_cropped_masks_and_overlap(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((20, 30)) < 0.5, rng.random((20, 30)) < 0.5
    df = spark.createDataFrame([(1, runs_of(a), runs_of(b), (4, 3, 20, 15)), (2, runs_of(a), runs_of(b), None), (3, None, runs_of(b), (0, 0, 2, 2))], f"i int, a {R.RUNS}, b {R.RUNS}, box struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>")
    cut, both = got(df, R.cropped(F.col("a"), F.col("box"))), got(df, R.overlap(F.col("a"), F.col("b"), F.lit(20), F.lit(30)))
    assert cut[1] == runs_of(a[3:15, 4:20]) and cut[2] == runs_of(a) and cut[3] is None
    assert both == {1: (a & b).sum(), 2: (a & b).sum(), 3: None}


def test_kernels_hold_a_piece_of_a_batch_at_a_time(monkeypatch):
    held = []

    def score(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        held.append(len(a))
        return pa.array(R.read(a, h, w).boundary_score(R.read(b, h, w), 2), pa.float64(), mask=~R.there(a, b, h, w))

    masks = [runs_of(m) for m in some_masks()] * 20
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("x", "y0", "y1")]))
    rows = lambda ms: pa.array([m and [dict(zip(("x", "y0", "y1"), r)) for r in m] for m in ms], kind)
    a, b, side = rows(masks), rows([None, *masks[1:]]), pa.array([60] * len(masks))
    whole = score(a, b, side, side).to_pylist()
    held.clear()
    monkeypatch.setattr(R, "PIECE", 500)
    assert R.in_pieces(score, 3)(a, b, side, side).to_pylist() == whole
    assert sum(held) == len(masks) and max(held) <= 9  # 61 and more for the columns of each
    held.clear()
    assert R.in_pieces(score, 3)(a[:0], b[:0], side[:0], side[:0]).to_pylist() == []


def test_polygons_are_worked_on_ring_by_ring(spark, sf):
    for make in (P.polygon_runs, P.mask_cleanup, P.warped_masks):
        plan = make(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("filled_in(") == 1 and plan.count("collect_list(") == 1, make.__name__


def test_polygons_of_odd_rings(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 7)  # several slices a batch
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, 0, square(0, 6), 9, 9), (1, 0, square(2, 4), 9, 9), (2, 0, square(0, 6), 9, 9), (2, 1, square(2, 4), 9, 9), (3, 0, [(0, 0), (None, 1), (5, 5)], 9, 9)]
    rows += [(4, 0, square(-(10**9), 10**9), 3, 2), (5, 0, square(1, 3), None, None), (6, 0, square(4, 5), 9, 4), (7, 0, square(0, 6), 3, 9), (7, 1, square(0, 6), 9, 2)]
    df = spark.createDataFrame(rows, "k int, ring int, points array<struct<x:int,y:int>>, h int, w int")
    found = {r.k: [tuple(x) for x in r.runs] for r in M.gathered(M.polygon_runs(df, ["k"], "ring", "points", F.col("h"), F.col("w")), ["k"]).collect()}
    whole = [(x, 0, 7) for x in range(7)]
    assert found[1] == whole[:3] + [(3, 0, 3), (3, 4, 7)] + whole[4:] and found[2] == whole  # rows with one number are one ring
    assert found[4] == [(0, 0, 3), (1, 0, 3)] and found[5] == [(x, 1, 4) for x in (1, 2, 3)]
    assert found[7] == whole[:2] + [(x, 0, 3) for x in range(2, 7)] and sorted(found) == [1, 2, 4, 5, 7]


def test_layers_are_drawn_ring_by_ring(spark, sf):
    plan = P._layers(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("filled_in(") == 1
    assert P.mask_annotations(spark, sf).count() > 0


def test_stacking_is_one_pass_over_the_rows_whatever_the_batches(spark, sf):
    layers, over = P._layers(spark, sf), P._occluders(spark, sf)
    out = M.compiled_runs(layers, ["frame"], over)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("filled_in(") == 1
    want = sorted(out.collect())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        some = M.compiled_runs(layers.where("frame < 2"), ["frame"], over)
        assert sorted(some.collect()) == [r for r in want if r.frame < 2]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_stacks_of_columns_against_painting():
    rng = np.random.default_rng(31)
    for n in (0, 1, 40, 300):
        group, front = np.sort(rng.integers(0, 6, n)), rng.random(n) < 0.15
        order = np.lexsort((front, group))
        group, front = group[order], front[order]
        stack, item = rng.integers(0, 2, n), np.where(front, -1, rng.integers(-1, 8, n))
        y0 = rng.integers(0, 50, n)
        y1 = y0 + rng.integers(1, 30, n)
        top, own = {}, {}
        for g, s, f, i, a, b in zip(group.tolist(), stack.tolist(), front.tolist(), item.tolist(), y0.tolist(), y1.tolist()):
            for y in range(a, b):
                for at in (0, 1) if f else (s,):
                    top[g, at, y] = i
                if i >= 0:
                    own.setdefault((g, s, i), set()).add(y)
        row, a, b, seen = R.stacked(group, stack, front, item, y0, y1)
        got = {}
        for r, lo, hi, ok in zip(row.tolist(), a.tolist(), b.tolist(), seen.tolist()):
            for y in range(lo, hi):
                key = int(group[r]), int(stack[r]), int(item[r])
                assert (*key, y) not in got  # no pixel twice
                got[*key, y] = ok
        assert got == {(*k, y): top[k[0], k[1], y] == k[2] for k, ys in own.items() for y in ys}
