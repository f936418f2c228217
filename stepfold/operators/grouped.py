"""Kernels that need a group's rows together: NMS, greedy matching, topological order, AND/OR planning, deadlocks.

Groups are one frame or one machine, small by nature; a group's rows reach one task, never the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    i = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return i / np.maximum(size(a)[:, None] + size(b)[None, :] - i, 1e-9)


EDGES = ["x0", "y0", "x1", "y1"]


def nms(rows: DataFrame, by: list[str], cls: str, score: str, key: str, threshold: float = 0.5, contained: float = 0.6, cut: str | None = None) -> DataFrame:
    """Boxes that survive in each frame.

    First a box cut by a tile edge (`cut`) goes if enough of it lies in an uncut box of its class; then the best score
    of a class suppresses the rest at the IoU threshold and beyond. Ties go to the smaller key.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        b, c = pdf[EDGES].to_numpy(float), pdf[cls].to_numpy()
        keep = np.ones(len(pdf), dtype=bool)
        if cut is not None:
            edge = pdf[cut].to_numpy(bool)
            w = np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0])
            h = np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1])
            inside = np.clip(w, 0, None) * np.clip(h, 0, None) / np.maximum((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), 1e-9)[:, None]
            keep &= ~(edge & ((inside >= contained) & (c[:, None] == c[None, :]) & ~edge[None, :]).any(axis=1))
        over = (pair_iou(b, b) >= threshold) & (c[:, None] == c[None, :])
        for i in range(len(pdf)):
            if keep[i]:
                later = np.arange(len(pdf)) > i
                keep &= ~(over[i] & later)
        return pdf[keep]

    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def greedy_match(preds: DataFrame, truths: DataFrame, by: list[str], score: str, pred_id: str, truth_id: str, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches (pred, truth, iou): predictions by score, each takes the free truth of largest IoU."""

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(t):  # a side without rows has no columns either
            p = p.sort_values([score, pred_id], ascending=[False, True])
            t = t.sort_values(truth_id)
            m = pair_iou(p[EDGES].to_numpy(float), t[EDGES].to_numpy(float))
            for i in range(len(p)):
                j = int(np.argmax(m[i]))
                if m[i, j] >= threshold:
                    out.append((p[pred_id].iloc[i], t[truth_id].iloc[j], m[i, j]))
                    m[:, j] = -1
        return pd.DataFrame(out, columns=["pred", "truth", "iou"]).astype({"pred": "int64", "truth": "int64", "iou": "float64"})

    # columns of its own: both sides may come from one table, and a cogroup confuses columns that they share
    truths = truths.select(*[F.col(c).alias(c) for c in truths.columns])
    return preds.groupBy(*by).cogroup(truths.groupBy(*by)).applyInPandas(run, "pred long, truth long, iou double")


def average_precision(rows: DataFrame, by: list[str], score: str, key: str, hit: Column, truths: DataFrame) -> DataFrame:
    """All-point AP: cumulative precision and recall by score, monotone envelope, summed over recall steps.

    A group with truths and no prediction has an AP of 0; one without truths has no row.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_hit", hit.cast("long")).withColumn("_tp", F.sum("_hit").over(run)).withColumn("_n", F.row_number().over(w))
    r = r.join(truths.select(*by, "n_truth"), by).withColumn("_p", F.col("_tp") / F.col("_n"))
    env = r.withColumn("_env", F.max("_p").over(w.rowsBetween(0, Window.unboundedFollowing)))
    found = env.groupBy(*by).agg((F.sum(F.when(F.col("_hit") == 1, F.col("_env")).otherwise(0.0)) / F.first("n_truth")).alias("ap"), F.sum("_hit").alias("hits"))
    return truths.select(*by).join(found, by, "left").fillna({"ap": 0.0, "hits": 0})


def bootstrap_ci(rows: DataFrame, by: list[str], key: str, value: str, resamples: int, seed: int, q: float = 0.025) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling, drawn by hashes so that reruns agree.

    Each row gets a weight per resample from a hash of (row, resample); sums combine map-side, so no resample is ever
    gathered.
    """
    u = F.pmod(F.xxhash64(key, "resample", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cdf, p, cuts = 0.0, float(np.exp(-1)), []
    for k in range(8):
        cdf += p
        cuts.append(cdf)
        p /= k + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = rows.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_w", weight)
    means = drawn.groupBy(*by, "resample").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", q).alias("low"), F.percentile("m", 1 - q).alias("high"), F.avg("m").alias("mean"))


def layer_order(layers: DataFrame, above: DataFrame, by: list[str], key: str, index: str) -> DataFrame:
    """A stable topological order of each group: lower layers first, free choices by `index`, a cycle's rest by `index`."""

    def run(l: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*by, key, "position", "cyclic"]})
        order = l.sort_values([index, key])
        rank = {k: i for i, k in enumerate(order[key])}
        waits = {k: set() for k in rank}
        for lo, hi in zip(e["below"], e["above"]) if len(e) else ():
            if lo in rank and hi in rank and lo != hi:
                waits[hi].add(lo)
        free = [rank[k] for k, w in waits.items() if not w]
        heapq.heapify(free)
        names, out, cyclic = list(order[key]), [], False
        while len(out) < len(names):
            if not free:
                cyclic = True
                nxt = min(rank[k] for k in waits)
            else:
                nxt = heapq.heappop(free)
            k = names[nxt]
            waits.pop(k)
            out.append((k, len(out), cyclic))
            for other, w in waits.items():
                if k in w:
                    w.discard(k)
                    if not w and not cyclic:
                        heapq.heappush(free, rank[other])
        done = pd.DataFrame(out, columns=[key, "position", "cyclic"])
        for c in by:
            done[c] = l[c].iloc[0]
        return done[[*by, key, "position", "cyclic"]]

    above = above.select(*[F.col(c).alias(c) for c in above.columns])
    kinds = ", ".join(f"{c} {layers.schema[c].dataType.simpleString()}" for c in [*by, key])
    return layers.groupBy(*by).cogroup(above.groupBy(*by)).applyInPandas(run, f"{kinds}, position long, cyclic boolean")


def mutual(graph: dict) -> dict:
    """For each node on a cycle, the nodes that it reaches and that reach it, itself included."""
    reach = {}
    for a in graph:
        seen, ahead = set(), list(graph[a])
        while ahead:
            b = ahead.pop()
            if b not in seen:
                seen.add(b)
                ahead += graph.get(b, ())
        reach[a] = seen
    return {a: sorted(b for b in seen if a in reach.get(b, ())) for a, seen in reach.items() if a in seen}


def deadlocks(needs: DataFrame, by: list[str]) -> DataFrame:
    """Actions that can never be done: needs (action, edge, alternative): an action is doable once each of its edges has
    a doable alternative; an edge without alternatives (null) never is. Stuck actions come with their cycle, or with
    `dead end` where they only wait for others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict = {}
        for a, e, alt in zip(pdf["action"], pdf["edge"], pdf["alternative"]):
            mine = edges.setdefault(a, {})
            if e is not None and e == e:
                mine.setdefault(e, set())
                if alt is not None and alt == alt:
                    mine[e].add(alt)
        alts = {x for m in edges.values() for s in m.values() for x in s}
        actions = sorted(set(edges) | alts)
        doable: set = set()
        while True:
            more = {a for a in actions if a not in doable and all(s & doable for s in edges.get(a, {}).values())}
            if not more:
                break
            doable |= more
        stuck = [a for a in actions if a not in doable]
        graph = {a: sorted(x for s in edges[a].values() if not s & doable for x in s) for a in stuck if a in edges}
        label = {a: ",".join(map(str, c)) for a, c in mutual(graph).items()}
        out = pd.DataFrame({"action": pd.Series(stuck, dtype=pdf["action"].dtype), "cycle": pd.Series([label.get(a, "dead end") for a in stuck], dtype=object)})
        for k in by:
            out[k] = pd.Series([pdf[k].iloc[0]] * len(out), dtype=pdf[k].dtype)
        return out[[*by, "action", "cycle"]]

    kinds = ", ".join(f"{c} {needs.schema[c].dataType.simpleString()}" for c in [*by, "action"])
    return needs.groupBy(*by).applyInPandas(run, f"{kinds}, cycle string")


def removal_plans(needs: DataFrame, by: list[str], goal: str) -> DataFrame:
    """The actions to a goal in order (step from 0), depth first, each edge by the alternative that is
    soonest doable; a goal
    that cannot be reached has no rows. needs: (goal, action, edge, alternative) rows of the group; null edge: free."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict = {}
        for a, e, alt in zip(pdf["action"], pdf["edge"], pdf["alternative"]):
            mine = edges.setdefault(a, {})
            if e is not None and e == e:
                mine.setdefault(e, []).append(alt)

        # the round in which an action becomes doable; alternatives of an earlier round cannot lead back to it
        ready: dict = {}
        actions = set(edges) | {x for m in edges.values() for c in m.values() for x in c if x is not None and x == x}
        while True:
            more = {a for a in actions if a not in ready and all(any(x in ready for x in c) for c in edges.get(a, {}).values())}
            if not more:
                break
            ready |= dict.fromkeys(more, len(set(ready.values())))
        g, found, done, todo = pdf[goal].iloc[0], [], set(), []
        if g in ready:
            todo.append((g, False))
        while todo:
            a, opened = todo.pop()
            if a in done:
                continue
            if opened:
                done.add(a)
                found.append(a)
                continue
            todo.append((a, True))
            for _, c in sorted(edges.get(a, {}).items(), reverse=True):
                if not any(x in done for x in c):
                    todo.append((min((x for x in c if x in ready), key=lambda x: (ready[x], x)), False))
        out = pd.DataFrame({"step": pd.Series(range(len(found)), dtype="int64"), "action": pd.Series(found, dtype=pdf["action"].dtype)})
        for k in [*by, goal]:
            out[k] = pd.Series([pdf[k].iloc[0]] * len(out), dtype=pdf[k].dtype)
        return out[[*by, goal, "step", "action"]]

    kinds = ", ".join(f"{c} {needs.schema[c].dataType.simpleString()}" for c in [*by, goal])
    return needs.groupBy(*by, goal).applyInPandas(run, f"{kinds}, step long, action {needs.schema['action'].dataType.simpleString()}")
