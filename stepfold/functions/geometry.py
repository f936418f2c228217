"""Boxes as columns (x0, y0, x1, y1, ends exclusive) and run-length masks (column-major, COCO counts)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: dict[str, Column]) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def box(prefix: str = "") -> dict[str, Column]:
    return {e: F.col(prefix + e) for e in ("x0", "y0", "x1", "y1")}


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def containment(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of a that lies in b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def sym_diff(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return area(a) + area(b) - 2 * intersection(a, b)


def clip(b: dict[str, Column], width: int, height: int) -> dict[str, Column]:
    return {e: F.least(F.greatest(b[e], F.lit(0)), F.lit(width if e[0] == "x" else height)) for e in b}


def xywh(b: dict[str, Column]) -> Column:
    """[x, y, w, h], null for an empty box."""
    return F.when(area(b) > 0, F.array(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]))


def pad(b: dict[str, Column], share: float, width: int, height: int) -> dict[str, Column]:
    dx, dy = F.round((b["x1"] - b["x0"]) * share).cast("long"), F.round((b["y1"] - b["y0"]) * share).cast("long")
    return clip({"x0": b["x0"] - dx, "y0": b["y0"] - dy, "x1": b["x1"] + dx, "y1": b["y1"] + dy}, width, height)


def similarity(b: dict[str, Column], scale: Column, angle: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """Envelope of a box under a similarity transform."""
    c, s = scale * F.cos(angle), scale * F.sin(angle)
    xs = [c * b[x] - s * b[y] + dx for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [s * b[x] + c * b[y] + dy for x in ("x0", "x1") for y in ("y0", "y1")]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def tiles(width: Column, height: Column, tile: int, stride: int) -> Column:
    """array<struct<x, y>>: tile origins at every stride, the last flush with the edge."""

    def starts(n: Column) -> Column:
        last = F.greatest(n - tile, F.lit(0)).cast("int")
        return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(last / stride).cast("int")), lambda i: i * stride), F.array(last)))

    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


# --- run-length masks -------------------------------------------------------------------------------------------


def encode_counts(counts: list[int]) -> str:
    """Runs (background first) as COCO text: from the fourth on as differences to two before, five bits a character."""
    out = []
    for i, n in enumerate(counts):
        x = int(n) - (int(counts[i - 2]) if i > 2 else 0)
        more = True
        while more:
            c = x & 0x1F
            x >>= 5
            more = x != -1 if c & 0x10 else x != 0
            out.append(chr((c | 0x20 if more else c) + 48))
    return "".join(out)


def decode_counts(text: str) -> list[int]:
    """The runs of COCO text; raises ValueError for text that ends inside a number or gives a negative run."""
    counts, x, shift = [], 0, 0
    for ch in text:
        c = ord(ch) - 48
        if not 0 <= c < 64:
            raise ValueError(f"not a run-length character: {ch!r}")
        x |= (c & 0x1F) << shift
        shift += 5
        if not c & 0x20:
            if c & 0x10:
                x |= -1 << shift
            counts.append(x + (counts[-2] if len(counts) > 2 else 0))
            x, shift = 0, 0
    if shift or any(n < 0 for n in counts):
        raise ValueError("malformed run lengths")
    return counts


def to_mask(counts: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    if len(flat) != height * width:
        raise ValueError(f"runs cover {len(flat)} of {height * width} pixels")
    return flat.reshape(width, height).T


def to_counts(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, dtype=bool).T.ravel()
    change = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], change, [len(flat)]])).tolist()
    return [0, *runs] if len(flat) and flat[0] else runs


def rle_encode(counts: Column) -> Column:
    def encoded(c: pd.Series) -> pd.Series:
        return c.map(lambda x: encode_counts(list(x)), na_action="ignore")

    return F.pandas_udf(encoded, "string")(counts)


def rle_decode(text: Column) -> Column:
    """The runs, null for null or malformed text."""

    def one(t):
        try:
            return decode_counts(t)
        except (ValueError, TypeError):
            return None

    def decoded(t: pd.Series) -> pd.Series:
        return t.map(one, na_action="ignore")

    return F.pandas_udf(decoded, "array<bigint>")(text)


def foreground(counts: Column) -> Column:
    """array<struct<start, end>> of the foreground runs, native on decoded counts."""
    ends = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all")))["all"]
    spans = F.transform(ends, lambda e, i: F.struct((e - F.get(counts, i)).alias("start"), e.alias("end"), (i % 2 == 1).alias("on")))
    return F.transform(F.filter(spans, lambda s: s["on"] & (s["end"] > s["start"])), lambda s: F.struct(s["start"], s["end"]))


def rle_area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def rle_bbox(runs: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1> off the runs, null for none; a run over a column's end spans the whole height."""
    wraps = F.exists(runs, lambda r: F.floor(r["start"] / height) != F.floor((r["end"] - 1) / height))
    top, bottom = F.array_min(F.transform(runs, lambda r: r["start"] % height)), F.array_max(F.transform(runs, lambda r: (r["end"] - 1) % height)) + 1
    x0, x1 = F.array_min(F.transform(runs, lambda r: F.floor(r["start"] / height))), F.array_max(F.transform(runs, lambda r: F.floor((r["end"] - 1) / height))) + 1
    return F.when(F.size(runs) > 0, F.struct(x0.alias("x0"), F.when(wraps, 0).otherwise(top).alias("y0"), x1.alias("x1"), F.when(wraps, height).otherwise(bottom).alias("y1")))


def rle_contains(runs: Column, x: Column, y: Column, height: Column) -> Column:
    return F.exists(runs, lambda r: (r["start"] <= x * height + y) & (x * height + y < r["end"]))


def _grown(m: np.ndarray, r: int) -> np.ndarray:
    out = m.copy()
    for _ in range(r):
        g = out.copy()
        g[1:] |= out[:-1]
        g[:-1] |= out[1:]
        g[:, 1:] |= out[:, :-1]
        g[:, :-1] |= out[:, 1:]
        out = g
    return out


def tolerant_sym_diff(old: np.ndarray, new: np.ndarray, tolerance: int) -> int:
    """Differing pixels outside a band of `tolerance` around the old mask's boundary, on either side of it."""
    band = _grown(old, tolerance) & _grown(~old, tolerance)
    return int(((old ^ new) & ~band).sum())
