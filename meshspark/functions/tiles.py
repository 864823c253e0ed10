"""Pairs of faces with overlapping boxes, found with numpy for ``mapInArrow``.

Rows come sorted by group: those of a grid cell, or of two parts of a crowded one. A group is cut into tiles of neighbours, and
only tiles whose boxes overlap are compared row by row. Pairs are never held for long: a ``Visit`` takes some at a time, and
gives rows at once or sums at the end of the groups at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CELL = ("level", "cell_x", "cell_y", "cell_z")
#: What a row of a group has: its group, ``side`` (of two parts), ``bits`` (8: its own level, 1, 2, 4: its lowest cell on an
#: axis), face, corners and box.
GROUP = (*CELL, "part_a", "part_b")
BASE = ("side", "bits", "fid", "i0", "i1", "i2", *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"])
#: Rows of a tile, rows read together at least, and pairs handed over together at least.
TILE, ROWS, PAIRS = 128, 1 << 15, 1 << 16


class Rows:
    """Columns of some groups as arrays; nulls are NaN there, and ``null`` tells the rows that have one in ``columns``."""

    def __init__(self, table: pa.Table, columns: tuple[str, ...]):
        self.n = len(table)
        get = lambda c: table.column(c).to_numpy()
        self.side, self.bits, self.fid, self.crossing = get("side"), get("bits"), get("fid"), get("part_a") != get("part_b")
        self.corners = np.stack([get(c) for c in ("i0", "i1", "i2")])
        self.least, self.most = self.corners.min(axis=0), self.corners.max(axis=0)
        self.lo, self.hi = (np.stack([get(f"{e}{c}") for c in "xyz"]) for e in ("lo", "hi"))
        for ends in (self.lo, self.hi):
            ends[np.isnan(ends)] = np.inf  # as in comparisons of columns
        self.extra = np.stack([get(c) for c in columns]) if columns else np.zeros((0, self.n))
        self.null = np.zeros(self.n, bool)
        for c in columns:
            if table.column(c).null_count:
                self.null |= table.column(c).is_null().to_numpy()


class Visit:
    """What becomes of pairs: ``columns`` that it reads, the ``schema`` of its rows. Pairs are rows i, j with fid[i] < fid[j] and no common corner."""

    columns: tuple[str, ...] = ()
    schema = ""
    #: Squared distance of ``columns`` (three) beyond which pairs are of no use; falls as they are found.
    bound: float | None = None

    def batch(self, arrays) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], [c.split()[0] for c in self.schema.split(", ")])

    def begin(self, rows: Rows) -> None:
        self.rows = rows

    def take(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        raise NotImplementedError

    def end(self) -> pa.RecordBatch | None:
        """After the groups at hand."""

    def finish(self) -> pa.RecordBatch | None:
        """After all groups of the task."""


class Ids(Visit):
    """``fa, fb`` of every pair."""

    schema = "fa long, fb long"

    def take(self, i, j):
        return self.batch([self.rows.fid[i], self.rows.fid[j]])


class Axes(Visit):
    """``fa, fb`` and the unit vector between centroids; with a ``cosine`` only of faces whose normals have a smaller one."""

    schema = "fa long, fb long, ux double, uy double, uz double"

    def __init__(self, cosine: float | None = None):
        self.cosine = cosine
        self.columns = ("mx", "my", "mz") if cosine is None else ("mx", "my", "mz", "nx", "ny", "nz")

    def take(self, i, j):
        of, null = self.rows.extra, self.rows.null
        if self.cosine is not None:
            keep = sum(of[k][i] * of[k][j] for k in (3, 4, 5)) < self.cosine
            i, j = i[keep], j[keep]
        d = [of[k][j] - of[k][i] for k in range(3)]
        length = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-20
        none = null[i] | null[j]
        return self.batch([self.rows.fid[i], self.rows.fid[j], *[pa.array(x / length, mask=none) for x in d]])


class Nearest(Visit):
    """``fa, fb, d``: of each task the ``most`` pairs of least squared distance between centroids, ties to the smaller ids; pairs
    without a distance come last (infinite)."""

    columns = ("mx", "my", "mz")
    schema = "fa long, fb long, d double"

    def __init__(self, most: int):
        self.most, self.held, self.new = most, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], []

    def take(self, i, j):
        of = self.rows.extra
        d = [of[k][i] - of[k][j] for k in range(3)]
        d = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        d[np.isnan(d)] = np.inf
        keep = slice(None) if self.bound is None else d <= self.bound
        self.new.append([self.rows.fid[i][keep], self.rows.fid[j][keep], d[keep]])
        self._settle()

    def _settle(self) -> None:
        self.held = [np.concatenate(x) for x in zip(self.held, *self.new, strict=True)]
        self.new = []
        if len(self.held[2]) > self.most:
            fa, fb, d = self.held
            if self.most < len(d) // 2:
                near = d <= np.partition(d, self.most)[self.most]
                fa, fb, d = fa[near], fb[near], d[near]
            first = np.lexsort((fb, fa, d))[: self.most]
            self.held = [x[first] for x in (fa, fb, d)]
        if len(self.held[2]) == self.most and self.most:
            self.bound = float(self.held[2].max())

    def finish(self):
        return self.batch(self.held)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, some at a time, and where they start."""
    held, n = [], 0
    key = lambda b, at: [b.column(c)[at].as_py() for c in GROUP]

    def cut(whole: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in GROUP]
        new = np.zeros(len(table), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        end = len(table) if whole else starts[-1]
        return table, starts[starts < end], end

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n >= ROWS and key(b, b.num_rows - 1) != key(held[0], 0):
                table, starts, end = cut(False)
                yield table.slice(0, end), np.append(starts, end)
                held = table.slice(end).to_batches()
                n = len(table) - end
    if held:
        table, starts, end = cut(True)
        yield table, np.append(starts, end)


def _tiled(rows: Rows, of: np.ndarray) -> list[np.ndarray]:
    """Rows in tiles, halved along the axis on which they lie farthest apart beside their size."""
    todo, out = [of], []
    while todo:
        r = todo.pop()
        if len(r) <= TILE:
            out.append(r)
            continue
        with np.errstate(all="ignore"):
            middle = np.nan_to_num(rows.lo[:, r] + rows.hi[:, r])
            size = np.nan_to_num(rows.hi[:, r] - rows.lo[:, r]).mean(axis=1)
            axis = int(np.argmax((middle.max(axis=1) - middle.min(axis=1)) / np.maximum(size, 1e-300)))
        half = len(r) // 2
        order = np.argpartition(middle[axis], half)
        todo += [r[order[:half]], r[order[half:]]]
    return out


def _points_apart(rows: Rows, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = [rows.extra[k][p][:, None] - rows.extra[k][q] for k in range(3)]
    d = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    d[np.isnan(d)] = np.inf
    return d


def _met(rows: Rows, of: np.ndarray, visit: Visit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a group whose boxes overlap and whose cell is this one, tile by tile; with a bound the closest tiles first."""
    within = not rows.crossing[of[0]]
    sides = [of] if within else [of[rows.side[of] == k] for k in (0, 1)]
    if not all(map(len, sides)):
        return
    one, two = (_tiled(rows, sides[k]) for k in (0, -1)) if not within else (_tiled(rows, of),) * 2
    ends = lambda ts: (np.stack([rows.lo[:, t].min(axis=1) for t in ts]), np.stack([rows.hi[:, t].max(axis=1) for t in ts]))
    (lo1, hi1), (lo2, hi2) = ends(one), ends(two)
    near = ((lo1[:, None] <= hi2[None]) & (lo2[None] <= hi1[:, None])).all(axis=2)
    a, b = np.nonzero(np.triu(near) if within else near)
    off = None
    if isinstance(visit, Nearest):
        with np.errstate(all="ignore"):
            spot = lambda ts, f: np.stack([f(np.nan_to_num(rows.extra[:3, t], nan=s), axis=1) for t in ts for s in [np.inf if f is np.min else -np.inf]])
            (s1, e1), (s2, e2) = ((spot(ts, np.min), spot(ts, np.max)) for ts in (one, two))
            off = np.maximum(np.maximum(s2[b] - e1[a], s1[a] - e2[b]), 0.0)
            off = np.nan_to_num((off * off).sum(axis=1) * (1 - 1e-9), nan=np.inf)
        first = np.argsort(off, kind="stable")
        a, b, off = a[first], b[first], off[first]
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if off is not None and visit.bound is not None and off[k] > visit.bound:
            break
        p, q = one[x], two[y]
        m = (rows.bits[p][:, None] | rows.bits[q]) == 15
        for c in range(3):
            m &= rows.lo[c][p][:, None] <= rows.hi[c][q]
            m &= rows.lo[c][q] <= rows.hi[c][p][:, None]
        if within and x == y:
            m = np.triu(m, 1)
        if off is not None and visit.bound is not None:
            m &= _points_apart(rows, p, q) <= visit.bound
        at = np.flatnonzero(m)
        if len(at):
            i = at // len(q)
            yield p[i], q[at - i * len(q)]


def _apart(rows: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in the order of their ids, without those of one face or of a common corner."""
    fi, fj = rows.fid[i], rows.fid[j]
    keep, less = fi != fj, fi < fj
    i, j = np.where(less, i, j), np.where(less, j, i)
    near = np.flatnonzero((rows.least[i] <= rows.most[j]) & (rows.least[j] <= rows.most[i]))
    shared, ni, nj = np.zeros(len(near), bool), i[near], j[near]
    for one in rows.corners:
        for two in rows.corners:
            shared |= one[ni] == two[nj]
    keep[near[shared]] = False
    return i[keep], j[keep]


def visited(visit: Visit):
    """Hands the pairs of all groups to ``visit``."""

    def run(batches):
        for table, starts in _tables(batches):
            rows = Rows(table, visit.columns)
            visit.begin(rows)
            held, n = [], 0
            out = lambda: visit.take(*_apart(rows, *[np.concatenate(x) for x in zip(*held, strict=True)]))  # noqa: B023, E731
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                for i, j in _met(rows, np.arange(s, e), visit):
                    held.append((i, j))
                    n += len(i)
                    if n >= PAIRS or visit.bound is None and isinstance(visit, Nearest):
                        if (given := out()) is not None:
                            yield given
                        held, n = [], 0
            if held and (given := out()) is not None:
                yield given
            if (given := visit.end()) is not None:
                yield given
        if (given := visit.finish()) is not None:
            yield given

    return run
