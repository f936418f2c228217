"""Masks as runs: in each column of pixels sorted, disjoint intervals of rows. No canvas is painted.

As a column a mask is array<struct<x, y0, y1>>, ends exclusive. The functions at the end are columns; their kernels work
on many masks of an Arrow batch at once (`in_pieces`): columns of pixels are laid out on one line, with gaps between them, so that an
operation on masks is one on sorted intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<x:bigint,y0:bigint,y1:bigint>>"
BLOCK = 1 << 20  #: pixels that a turned mask looks up at a time
PIECE = 1 << 17  #: runs and columns of pixels that a kernel holds at a time, at most about

# A confirmed mask disagrees beyond this band, and this share of its area or number of pixels.
TOLERANCE_PX, CONFLICT_SHARE, CONFLICT_PX = 2, 0.02, 20
BOUNDARY_TOLERANCE = 2  # of the boundary score, in pixels

Set = tuple[np.ndarray, np.ndarray]


def merged(start: np.ndarray, end: np.ndarray) -> Set:
    """The union of intervals in any order: sorted, disjoint and not touching."""
    full = end > start
    order = np.argsort(start[full], kind="stable")
    start, end = start[full][order], end[full][order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], reach[last]


def combined(rule: Callable[..., np.ndarray], *sets: Set) -> Set:
    """Where `rule` of the memberships holds: one sweep over all ends. The rule must not hold outside every set."""
    at = np.unique(np.concatenate([side for s in sets for side in s]))
    if not len(at):
        return at, at
    inside = []
    for start, end in sets:
        step = np.bincount(np.searchsorted(at, start), minlength=len(at)) - np.bincount(np.searchsorted(at, end), minlength=len(at))
        inside.append(np.cumsum(step) > 0)
    step = np.diff(np.concatenate([[0], rule(*inside).astype(np.int8), [0]]))
    return at[step[:-1] == 1], at[np.flatnonzero(step == -1)]


def topmost(start: np.ndarray, end: np.ndarray) -> Set:
    """The sorted ends of intervals, and the last interval that covers the piece after each end, -1 where none does.

    An interval marks two stretches of a power of two pieces that cover it; marks are handed down from long stretches to
    short ones, so that the work does not grow with the pieces that intervals share.
    """
    at = np.unique(np.concatenate([start, end]))
    low, high = np.searchsorted(at, start), np.searchsorted(at, end)
    level, top = np.frexp(high - low)[1] - 1, np.full(len(at), -1)
    for k in range(level.max(initial=0), -1, -1):
        own = np.flatnonzero(level == k)
        np.maximum.at(top, np.concatenate([low[own], high[own] - (1 << k)]), np.concatenate([own, own]))
        if k:
            half, above = 1 << k - 1, top.copy()
            np.maximum(top[half:], above[:-half], out=top[half:])
    return at, top


def stacked(group: np.ndarray, stack: np.ndarray, front: np.ndarray, item: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, y0, y1, seen): where each item of a stack is seen, and where it is but hidden; `row` is one of its rows.

    Rows (not empty) are sorted by group, then from the lowest to the highest. Rows in `front` lie on all stacks of their
    group; those with a negative item hide and are not told of.
    """
    own, n_stacks, n_items = np.flatnonzero(~front), stack.max(initial=0) + 1, item.max(initial=0) + 1
    stacks, of = np.unique(group[own] * n_stacks + stack[own], return_inverse=True)
    low, high = (np.searchsorted(stacks // n_stacks, group[front], side) for side in ("left", "right"))
    over, at = spread(low, high - 1)
    row, at = np.concatenate([own, np.flatnonzero(front)[over]]), np.concatenate([of, at])
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    least = y0.min(initial=0)
    pitch = y1.max(initial=0) - least + 1
    line = at * pitch - least
    ends, top = topmost(line + y0[row], line + y1[row])
    code = np.where(item[row] >= 0, at * n_items + item[row], -1)
    who = np.where(top >= 0, code[top], -1)
    new = np.concatenate([who[:1] >= 0, who[1:] != who[:-1]])
    begin = np.flatnonzero(new & (who >= 0))
    stop = ends[np.flatnonzero(np.concatenate([new, [True]]))[np.cumsum(new)[begin]]] if len(begin) else ends[:0]
    told = np.flatnonzero(code >= 0)
    codes, first, number = np.unique(code[told], return_index=True, return_inverse=True)
    base = number * pitch - least
    whole = merged(base + y0[row[told]], base + y1[row[told]])
    shift = (np.searchsorted(codes, who[begin]) - at[top[begin]]) * pitch
    seen = ends[begin] + shift, stop + shift
    hidden = combined(lambda a, b: a & ~b, whole, seen)
    start, end = (np.concatenate(x) for x in zip(seen, hidden))
    base = start // pitch * pitch
    return row[told[first]][start // pitch], start - base + least, end - base + least, np.arange(len(start)) < len(begin)


def square(reach: int) -> list[tuple[int, int]]:
    """How far up and down a square brush reaches, by column."""
    return [(dx, reach) for dx in range(-reach, reach + 1)]


def disc(reach: int) -> list[tuple[int, int]]:
    """The same of a round brush, whose half chord in each row is rounded."""
    chord = np.rint(np.sqrt(reach**2 - np.arange(reach + 1.0) ** 2))
    return [(dx, int(np.flatnonzero(chord >= abs(dx)).max())) for dx in range(-reach, reach + 1)]


@dataclass
class Runs:
    """Runs of several masks; mask, x, y0 and y1 have one entry a run, h and w one a mask."""

    mask: np.ndarray
    x: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    h: np.ndarray
    w: np.ndarray

    # --- the line on which all columns of all masks are laid, a gap after each column and each mask

    def _bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.w + 2)])

    def _pitch(self) -> int:
        return int(self.h.max(initial=0)) + 2

    def laid(self) -> Set:
        line = (self._bases()[self.mask] + self.x + 1) * self._pitch() + 1
        return line + self.y0, line + self.y1

    def of(self, found: Set) -> Runs:
        """Masks of the same sizes with other runs."""
        bases, pitch = self._bases(), self._pitch()
        line = found[0] // pitch
        mask = np.searchsorted(bases, line, "right") - 1
        return Runs(mask, line - bases[mask] - 1, found[0] - line * pitch - 1, found[1] - line * pitch - 1, self.h, self.w)

    def whole(self, margin: int = 0) -> Runs:
        """All pixels of each canvas, but `margin` at each edge."""
        wide = np.where(self.h > 2 * margin, np.maximum(self.w - 2 * margin, 0), 0)
        mask = np.repeat(np.arange(len(self.h)), wide)
        x = np.arange(len(mask)) - np.repeat(np.cumsum(wide) - wide, wide) + margin
        return Runs(mask, x, np.full(len(mask), margin), self.h[mask] - margin, self.h, self.w)

    # --- algebra

    def union(self, other: Runs) -> Runs:
        return self.of(combined(lambda a, b: a | b, self.laid(), other.laid()))

    def minus(self, other: Runs) -> Runs:
        return self.of(combined(lambda a, b: a & ~b, self.laid(), other.laid()))

    def both(self, other: Runs) -> Runs:
        return self.of(combined(lambda a, b: a & b, self.laid(), other.laid()))

    def differ(self, other: Runs) -> Runs:
        return self.of(combined(lambda a, b: a ^ b, self.laid(), other.laid()))

    def area(self) -> np.ndarray:
        return np.bincount(self.mask, self.y1 - self.y0, len(self.h)).astype(np.int64)

    def dilated(self, brush: Iterable[tuple[int, int]]) -> Runs:
        """Each pixel grown to the brush: pairs of a column's distance and how far it reaches up and down there."""
        x, y0, y1, mask = [], [], [], []
        for dx, reach in brush:
            near = self.x + dx
            ok = (near >= 0) & (near < self.w[self.mask])
            x.append(near[ok])
            mask.append(self.mask[ok])
            y0.append(np.maximum(self.y0[ok] - reach, 0))
            y1.append(np.minimum(self.y1[ok] + reach, self.h[mask[-1]]))
        grown = Runs(*(np.concatenate(c) for c in (mask, x, y0, y1)), self.h, self.w)
        return self.of(merged(*grown.laid()))

    def boundary(self, edges_count: bool) -> Runs:
        """Pixels of the mask with a neighbour, of eight, outside it; `edges_count`: beyond the canvas is outside."""
        outside = self.whole().minus(self).dilated(square(1))
        return self.minus(self.whole(1 if edges_count else 0).minus(outside))

    # --- components

    def components(self, diagonal: bool) -> np.ndarray:
        """A label for each run: that of the first run of its component. Runs of neighbouring columns are joined where
        they share a row, or with `diagonal` where they touch at a corner."""
        start, end = self.laid()
        more, pitch = int(diagonal), self._pitch()
        low = np.searchsorted(end, start + pitch - more, "right")
        high = np.maximum(np.searchsorted(start, end + pitch + more, "left"), low)
        n = high - low
        a = np.repeat(np.arange(len(start)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        label = np.arange(len(start))
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != (up := label[label])).any():
                label = up
        return label

    def picked(self, keep: np.ndarray) -> Runs:
        return Runs(self.mask[keep], self.x[keep], self.y0[keep], self.y1[keep], self.h, self.w)

    def filled(self) -> Runs:
        """With every hole, a part of the background that no path of shared sides leads out of."""
        ground = self.whole().minus(self)
        label = ground.components(False)
        open_ = (ground.x == 0) | (ground.x == self.w[ground.mask] - 1) | (ground.y0 == 0) | (ground.y1 == self.h[ground.mask])
        out = np.zeros(len(label), dtype=bool)
        out[label[open_]] = True
        return self.union(ground.picked(~out[label]))

    def without_specks(self, least: int) -> Runs:
        """Without components, joined at sides or corners, of fewer than `least` pixels."""
        label = self.components(True)
        size = np.bincount(label, self.y1 - self.y0, len(label))
        return self.picked(size[label] >= least)

    # --- similarity

    def warped(self, scale: np.ndarray, theta: np.ndarray, tx: np.ndarray, ty: np.ndarray, h: np.ndarray, w: np.ndarray) -> Runs:
        """Moved by x' = scale * turn(theta) * x + t to canvases of h by w: every target pixel looks up the source pixel
        nearest to where it came from, halves upwards, by binary search in the source's runs."""
        start, end = self.laid()
        bases, pitch, found = self._bases(), self._pitch(), [[], [], [], []]
        first = np.searchsorted(self.mask, np.arange(len(self.h) + 1))
        for m in range(len(self.h)):
            own = slice(first[m], first[m + 1])
            if own.start == own.stop or not scale[m] > 0:
                continue
            cos, sin = np.cos(theta[m]), np.sin(theta[m])
            cx, cy = np.meshgrid([self.x[own].min() - 1, self.x[own].max() + 1], [self.y0[own].min() - 1, self.y1[own].max()])
            px, py = scale[m] * (cos * cx - sin * cy) + tx[m], scale[m] * (sin * cx + cos * cy) + ty[m]
            x0, x1 = max(int(np.floor(px.min())), 0), min(int(np.ceil(px.max())) + 1, int(w[m]))
            y0, y1 = max(int(np.floor(py.min())), 0), min(int(np.ceil(py.max())) + 1, int(h[m]))
            if x1 <= x0 or y1 <= y0:
                continue
            y = np.arange(y0, y1) - ty[m]
            for at in range(x0, x1, max(BLOCK // (y1 - y0), 1)):
                xs = np.arange(at, min(at + max(BLOCK // (y1 - y0), 1), x1))
                x = xs[:, None] - tx[m]
                u = np.floor((cos * x + sin * y) / scale[m] + 0.5).astype(np.int64)
                v = np.floor((cos * y - sin * x) / scale[m] + 0.5).astype(np.int64)
                pos = (bases[m] + u + 1) * pitch + 1 + v
                k = np.searchsorted(start[own], pos, "right") - 1
                hit = (k >= 0) & (pos < end[own][k]) & (u >= 0) & (u < self.w[m]) & (v >= 0) & (v < self.h[m])
                step = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (col, begin), (_, stop) = np.nonzero(step == 1), np.nonzero(step == -1)
                for c, values in zip(found, (np.full(len(col), m), xs[col], begin + y0, stop + y0)):
                    c.append(values)
        mask, x, lo, hi = (np.concatenate(c) if c else np.empty(0, np.int64) for c in found)
        return Runs(mask, x, lo, hi, np.asarray(h), np.asarray(w))

    # --- comparison

    def beyond(self, other: Runs, tolerance: int) -> np.ndarray:
        """Pixels a mask in which `other` differs, outside the band around this mask's boundary."""
        band = self.boundary(True).dilated(square(tolerance))
        return self.differ(other).minus(band).area()

    def boundary_score(self, other: Runs, tolerance: int) -> np.ndarray:
        """F1 of boundary pixels that the other boundary's round neighbourhood holds; 1 where neither mask has any."""
        mine, its = self.boundary(False), other.boundary(False)
        n, m = mine.area(), its.area()
        precision = mine.both(its.dilated(disc(tolerance))).area() / np.maximum(n, 1)
        recall = its.both(mine.dilated(disc(tolerance))).area() / np.maximum(m, 1)
        score = 2 * precision * recall / np.maximum(precision + recall, 1e-300)
        return np.where((n == 0) & (m == 0), 1.0, score)


def whole_numbers(column: pa.Array) -> np.ndarray:
    return np.maximum(np.nan_to_num(column.cast(pa.float64()).to_numpy(zero_copy_only=False)), 0).astype(np.int64)


def read(runs: pa.Array, h: pa.Array, w: pa.Array) -> Runs:
    """From a column: clipped to the canvas, sorted, and runs of a column that meet are one. Null masks are empty."""
    flat, counts = runs.flatten(), np.nan_to_num(pc.list_value_length(runs).to_numpy(zero_copy_only=False)).astype(np.int64)
    mask, (x, y0, y1) = np.repeat(np.arange(len(runs)), counts), (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten())
    h, w = whole_numbers(h), whole_numbers(w)
    y0, y1 = np.maximum(y0, 0), np.minimum(y1, h[mask])
    ok = (x >= 0) & (x < w[mask]) & (y1 > y0)
    raw = Runs(mask[ok], x[ok], y0[ok], y1[ok], h, w)
    return raw.of(merged(*raw.laid()))


def written(found: Runs, valid: np.ndarray) -> pa.Array:
    """As a column, null where not valid."""
    offsets = np.searchsorted(found.mask, np.arange(len(found.h) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (found.x, found.y0, found.y1)], ["x", "y0", "y1"])
    return pa.ListArray.from_arrays(pa.array(offsets), runs, mask=pa.array(~valid))


def there(*columns: pa.Array) -> np.ndarray:
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def in_pieces(kernel: Callable[..., pa.Array], width: int) -> Callable[..., pa.Array]:
    """`kernel` over a batch in slices of PIECE runs and columns, one mask at least, so that what it holds depends neither
    on the batch nor on the table. `width` is the place of the canvas width among the arguments."""

    def pieces(*columns: pa.Array) -> pa.Array:
        load = whole_numbers(columns[width]) + 1
        for c in columns:
            if pa.types.is_list(c.type):
                load += np.nan_to_num(pc.list_value_length(c).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.flatnonzero(np.diff(np.cumsum(load) // PIECE)) + 1
        at = [0, *ends.tolist(), len(load)]
        return pa.concat_arrays([kernel(*[c.slice(a, b - a) for c in columns]) for a, b in zip(at, at[1:])])

    return pieces


def once(kernel: Callable[..., pa.Array]) -> Callable[..., Column]:
    """A kernel that gives masks, marked so that Spark does not run it again for each filter on what it gives."""
    return F.arrow_udf(kernel, RUNS).asNondeterministic()


# --- polygons: edges of rings from left to right, one entry an edge


def numbers(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, value): the whole numbers from low to high of each entry, both ends included."""
    n = np.maximum(high - low + 1, 0)
    entry = np.repeat(np.arange(len(n)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + low[entry]


@dataclass
class Edges:
    """mask, ring and the ends a and b, ax <= bx, have one entry an edge, sorted by mask; so have h and w, the canvas as far
    as the mask reaches."""

    mask: np.ndarray
    ring: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    h: np.ndarray
    w: np.ndarray

    @staticmethod
    def of(masks: pa.Array) -> Edges:
        """Of a column of lists of `ring`s; rows of one mask with the same number are one ring. One of fewer than three
        points, or with a missing number, has no edges."""
        n = np.nan_to_num(pc.list_value_length(masks).to_numpy(zero_copy_only=False)).astype(np.int64)
        number, points, h, w = masks.flatten().flatten()
        mask = np.repeat(np.arange(len(masks)), n)
        _, ring = np.unique(np.stack([mask, numbers(number)], axis=1), axis=0, return_inverse=True)
        n = np.nan_to_num(pc.list_value_length(points).to_numpy(zero_copy_only=False)).astype(np.int64)
        px, py = points.flatten().flatten()
        row = np.repeat(np.arange(len(n)), n)
        ok = n >= 3
        ok[row[~there(px, py)]] = False
        x, y, some = numbers(px), numbers(py), n > 0
        first = np.cumsum(n) - n
        after = np.arange(1, len(x) + 1)
        after[(first + n - 1)[some]] = first[some]
        most = np.iinfo(np.int64).max
        sizes = []
        for c, size in ((y, numbers(h, most)), (x, numbers(w, most))):
            reach = np.zeros(len(masks), np.int64)
            np.maximum.at(reach, mask[row], c + 1)
            sizes.append(np.minimum(reach[mask], np.maximum(size, 0)))
        keep = np.flatnonzero(ok[row])
        a, b = keep, after[keep]
        a, b = np.where(x[a] <= x[b], a, b), np.where(x[a] <= x[b], b, a)
        row = row[keep]
        return Edges(mask[row], ring.reshape(-1)[row], x[a], y[a], x[b], y[b], sizes[0][row], sizes[1][row])

    def picked(self, at: slice | np.ndarray) -> Edges:
        return Edges(*(c[at] for c in (self.mask, self.ring, self.ax, self.ay, self.bx, self.by, self.h, self.w)))

    def flat(self) -> np.ndarray:
        return np.abs(self.by - self.ay) <= self.bx - self.ax

    def load(self) -> np.ndarray:
        """Crossings and drawn pixels of each edge, about."""
        across = np.maximum(np.minimum(self.bx, self.w - 1) - np.maximum(self.ax, 0) + 1, 0)
        down = np.maximum(np.minimum(np.maximum(self.ay, self.by), self.h - 1) - np.maximum(np.minimum(self.ay, self.by), 0) + 1, 0)
        return 1 + across + np.where(self.flat(), across, down)

    def spans(self) -> tuple[np.ndarray, ...]:
        """(edge, x, y0, y1) between the crossings of each column, paired in their order; the pixels on both count."""
        e, x = spread(np.maximum(self.ax, 0), np.where(self.bx > self.ax, np.minimum(self.bx, self.w) - 1, -1))
        rise, dx, ay = (x - self.ax[e]) * (self.by - self.ay)[e], (self.bx - self.ax)[e], self.ay[e]
        order = np.lexsort((ay + rise / dx, x, self.ring[e]))
        low, high = order[0::2], order[1::2]
        return e[low], x[low], (ay - -rise // dx)[low], (ay + rise // dx)[high] + 1

    def along(self) -> tuple[np.ndarray, ...]:
        """(edge, x, y0, y1): the drawn pixels of flat edges, one a column."""
        e, x = spread(np.maximum(self.ax, 0), np.where(self.flat(), np.minimum(self.bx, self.w - 1), -1))
        dx = (self.bx - self.ax)[e]
        y = self.ay[e] + (2 * (x - self.ax[e]) * (self.by - self.ay)[e] + dx) // np.maximum(2 * dx, 1)
        return e, x, y, y + 1

    def upward(self) -> tuple[np.ndarray, ...]:
        """(edge, x, y0, y1): the drawn pixels of steep edges, one a row."""
        e, y = spread(np.maximum(np.minimum(self.ay, self.by), 0), np.where(self.flat(), -1, np.minimum(np.maximum(self.ay, self.by), self.h - 1)))
        dx, dy = (self.bx - self.ax)[e], (self.by - self.ay)[e]
        x = self.ax[e] + (2 * np.where(dy >= 0, y - self.ay[e], self.ay[e] - y) * dx + np.abs(dy)) // (2 * np.abs(dy))
        ok = (x >= 0) & (x < self.w[e])
        return e[ok], x[ok], y[ok], y[ok] + 1

    def runs(self, n: int) -> Runs:
        """The pixels of n masks, numbered from 0."""
        e, x, y0, y1 = (np.concatenate(c) for c in zip(self.spans(), self.along(), self.upward()))
        h, w = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(h, self.mask, self.h)
        np.maximum.at(w, self.mask, self.w)
        raw = Runs(self.mask[e], x, np.maximum(y0, 0), np.minimum(y1, self.h[e]), h, w)
        return raw.of(merged(*raw.laid()))


# --- columns ----------------------------------------------------------------------------------------------------


def ring(number: Column, points: Column, height: Column, width: Column) -> Column:
    """A ring (array of struct<x, y>, whole numbers) of a mask on its canvas; a null size is no limit. `number` tells the
    rings of a mask apart."""
    whole = F.transform(points, lambda p: F.struct(p["x"].cast("bigint").alias("x"), p["y"].cast("bigint").alias("y")))
    return F.struct(F.xxhash64(number).alias("ring"), whole.alias("points"), height.cast("bigint").alias("h"), width.cast("bigint").alias("w"))


def polygons(rings: Column) -> Column:
    """Pixels of the polygons of a mask, an array of `ring`s, which are united and clipped to the canvas.

    A ring holds the pixels whose centre is inside by the even-odd rule or on an edge, so one that crosses itself has
    holes, and those of its drawn outline: one pixel for each step along the longer side of an edge, halves upwards.
    Crossings are exact: every edge is laid over the columns that it spans, and the crossings of a column are paired in
    their order. Masks are worked on in slices of PIECE crossings and drawn pixels, one mask at least.
    """

    def filled_in(masks: pa.Array) -> pa.Array:
        edges, out = Edges.of(masks), []
        load = np.bincount(edges.mask, edges.load(), len(masks)) + 1
        ends = np.flatnonzero(np.diff(np.cumsum(load) // PIECE)) + 1
        at = [0, *ends.tolist(), len(masks)]
        for a, b in zip(at, at[1:]):
            own = edges.picked(slice(*np.searchsorted(edges.mask, [a, b])))
            own.mask = own.mask - a
            out.append(written(own.runs(b - a), there(masks.slice(a, b - a))))
        return pa.concat_arrays(out)

    return once(filled_in)(rings)


def area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["y1"] - r["y0"])


def bbox(runs: Column) -> Column:
    """struct<x0, y0, x1, y1>, null for an empty mask."""
    at = lambda f, c: f(F.transform(runs, lambda r: r[c]))
    found = F.struct(at(F.array_min, "x").alias("x0"), at(F.array_min, "y0").alias("y0"), (at(F.array_max, "x") + 1).alias("x1"), at(F.array_max, "y1").alias("y1"))
    return F.when(F.size(runs) > 0, found)


def cropped(runs: Column, box: Column) -> Column:
    """What lies in a box (x0, y0, x1, y1), in its coordinates; a null box is the whole canvas."""
    moved = F.transform(runs, lambda r: F.struct((r["x"] - box["x0"]).cast("bigint").alias("x"), (F.greatest(r["y0"], box["y0"]) - box["y0"]).cast("bigint").alias("y0"), (F.least(r["y1"], box["y1"]) - box["y0"]).cast("bigint").alias("y1")))
    return F.when(box.isNull(), runs).otherwise(F.filter(moved, lambda r: (r["x"] >= 0) & (r["x"] < box["x1"] - box["x0"]) & (r["y1"] > r["y0"])))


def from_flat(flat: Column, height: Column) -> Column:
    """Runs of column-major intervals of pixel numbers (start, end): a run over a column's end is one in each column."""
    h = height.cast("bigint")
    columns = lambda r: F.sequence(F.floor(r["start"] / h), F.floor((r["end"] - 1) / h))
    piece = lambda r, c: F.struct(c.alias("x"), F.greatest(r["start"] - c * h, F.lit(0)).alias("y0"), F.least(r["end"] - c * h, h).alias("y1"))
    return F.flatten(F.transform(F.filter(flat, lambda r: r["end"] > r["start"]), lambda r: F.transform(columns(r), lambda c: piece(r, c))))


def counts(runs: Column, height: Column, width: Column) -> Column:
    """Column-major run lengths, background first, that cover the canvas."""

    def counted(r: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        m = read(r, h, w)
        first, out = np.searchsorted(m.mask, np.arange(len(r) + 1)), []
        for i, ok in enumerate(there(r, h, w)):
            s = slice(first[i], first[i + 1])
            start, end = merged(m.x[s] * m.h[i] + m.y0[s], m.x[s] * m.h[i] + m.y1[s])
            edges = np.concatenate([[0], np.column_stack([start, end]).ravel(), [m.h[i] * m.w[i]]])
            n = np.diff(edges)
            out.append((n[:-1] if len(n) > 1 and n[-1] == 0 else n).tolist() if ok else None)
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(in_pieces(counted, 2), "array<bigint>")(runs, height, width)


def overlap(a: Column, b: Column, height: Column, width: Column) -> Column:
    """Pixels that both masks have."""

    def shared(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(read(a, h, w).both(read(b, h, w)).area(), pa.int64(), mask=~there(a, b, h, w))

    return F.arrow_udf(in_pieces(shared, 3), "bigint")(a, b, height, width)


def filled(runs: Column, height: Column, width: Column) -> Column:
    """With holes filled; background that reaches the canvas edge stays open."""

    def fill(r: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return written(read(r, h, w).filled(), there(r, h, w))

    return F.arrow_udf(in_pieces(fill, 2), RUNS)(runs, height, width)


def without_specks(runs: Column, height: Column, width: Column, least: int) -> Column:
    """Without components of fewer than `least` pixels, which touch at sides or corners."""

    def kept(r: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return written(read(r, h, w).without_specks(least), there(r, h, w))

    return F.arrow_udf(in_pieces(kept, 2), RUNS)(runs, height, width)


def n_components(runs: Column, height: Column, width: Column) -> Column:
    """How many parts, joined at sides or corners, a mask has."""

    def number(r: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        m = read(r, h, w)
        heads = np.flatnonzero(m.components(True) == np.arange(len(m.mask)))
        return pa.array(np.bincount(m.mask[heads], minlength=len(r)), pa.int64(), mask=~there(r, h, w))

    return F.arrow_udf(in_pieces(number, 2), "bigint")(runs, height, width)


def warped(runs: Column, height: Column, width: Column, scale: Column, theta: Column, tx: Column, ty: Column, to_height: Column, to_width: Column) -> Column:
    """Moved by a similarity to a canvas of another size; a scale that is not positive leaves nothing."""

    def warp(r: pa.Array, h: pa.Array, w: pa.Array, s: pa.Array, t: pa.Array, x: pa.Array, y: pa.Array, to_h: pa.Array, to_w: pa.Array) -> pa.Array:
        real = lambda c: np.nan_to_num(c.cast(pa.float64()).to_numpy(zero_copy_only=False))
        moved = read(r, h, w).warped(real(s), real(t), real(x), real(y), whole_numbers(to_h), whole_numbers(to_w))
        return written(moved, there(r, h, w, s, t, x, y, to_h, to_w))

    return once(in_pieces(warp, 2))(runs, height, width, scale, theta, tx, ty, to_height, to_width)


def beyond(old: Column, new: Column, height: Column, width: Column, tolerance: int = TOLERANCE_PX) -> Column:
    """Pixels in which the masks differ outside a band of `tolerance` around the old one's boundary; not symmetric."""

    def differing(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(read(a, h, w).beyond(read(b, h, w), tolerance), pa.int64(), mask=~there(a, b, h, w))

    return F.arrow_udf(in_pieces(differing, 3), "bigint")(old, new, height, width)


def conflict_bound(old: Column) -> Column:
    """Differing pixels that a confirmed mask bears."""
    return F.greatest(CONFLICT_SHARE * area(old), F.lit(float(CONFLICT_PX)))


def boundary_score(a: Column, b: Column, height: Column, width: Column, tolerance: int = BOUNDARY_TOLERANCE) -> Column:
    """F1 of the boundary pixels of one mask near the other's."""

    def scored(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(read(a, h, w).boundary_score(read(b, h, w), tolerance), pa.float64(), mask=~there(a, b, h, w))

    return F.arrow_udf(in_pieces(scored, 3), "double")(a, b, height, width)
