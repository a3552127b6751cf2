"""Segments of whole paths against the boxes of one place, inside a task.

The boxes are dealt by size into classes, those of a class by their lower left corner into the
cells of a grid. A segment is listed in the cells that hold such corners of boxes it may reach, so
a (path, box) pair has one cell, and is counted there without a table of all pairs. The exact
test is that of ``functions.geo.segment_meets_box`` together with the overlap of extents, in the
same double arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Boxes of one class differ by this factor in size; a class has so many boxes at least, a cell about so many.
SPREAD, LEAST, PER_CELL = 4.0, 64, 32
#: Cells of a class at most, so that they sort as 16 bits; tests in one step; segments listed in one step; rows given at a time.
CELLS, STEP, PIECE, GIVEN = 1 << 15, 1 << 16, 1 << 15, 1 << 16

Met = tuple[np.ndarray, np.ndarray, np.ndarray]


class Grid(NamedTuple):
    """Boxes of one class in the order of their cells; cell ``i`` has those from ``starts[i]``."""

    box: np.ndarray
    starts: np.ndarray
    sides: tuple[np.ndarray, ...]
    origin: tuple[float, float]
    width: float
    reach: float
    shape: tuple[int, int]


def _places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``count[i]`` rows of each i: i, and the number of the row within it."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - (np.cumsum(count) - count)[of]


def _grid(box: np.ndarray, sides: tuple[np.ndarray, ...], bounded: bool) -> Grid:
    if not bounded:
        starts = np.array([0, len(box)])
        return Grid(box, starts, tuple(s[box] for s in sides), (0.0, 0.0), np.inf, np.inf, (1, 1))
    x0, y0, x1, y1 = (s[box] for s in sides)
    x, y = np.minimum(x0, x1), np.minimum(y0, y1)
    size = max(np.abs(x1 - x0).max(), np.abs(y1 - y0).max())
    wide, high = np.ptp(x), np.ptp(y)
    width = max(size / 2, np.sqrt(wide * high * PER_CELL / len(box))) or max(wide, high) or 1.0
    while (wide // width + 1) * (high // width + 1) > CELLS:
        width *= 1.5
    nx, ny = int(wide // width) + 1, int(high // width) + 1
    origin = x.min(), y.min()
    cx = np.clip(np.floor((x - origin[0]) / width), 0, nx - 1).astype(np.int64)
    cy = np.clip(np.floor((y - origin[1]) / width), 0, ny - 1).astype(np.int64)
    order = np.argsort(cx * ny + cy, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(cx * ny + cy, minlength=nx * ny))))
    far = max(np.abs(s).max() for s in (x0, y0, x1, y1))
    reach = size + 1e-9 * (size + width) + 1e-12 * far
    return Grid(box[order], starts, tuple(s[order] for s in (x0, y0, x1, y1)), origin, width, reach, (nx, ny))


def box_grids(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[Grid]:
    """Grids of all boxes; those without bounds, or with corners in the wrong order, are compared with every segment."""
    sides = x0, y0, x1, y1
    plain = np.isfinite(x0) & np.isfinite(y0) & np.isfinite(x1) & np.isfinite(y1) & (x0 <= x1) & (y0 <= y1)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        size = np.maximum(x1 - x0, y1 - y0)
        plain &= size < 1e300
        step = np.where(size > 0, np.ceil(np.log(size) / np.log(SPREAD)), -1e9)
    out = [] if plain.all() else [_grid(np.flatnonzero(~plain), sides, False)]
    some = np.flatnonzero(plain)
    some = some[np.argsort(step[some], kind="stable")]
    ends = np.flatnonzero(np.diff(step[some])) + 1
    start = 0
    for end in (*ends, len(some)):
        if end - start >= LEAST or end == len(some) > start:
            out.append(_grid(some[start:end], sides, True))
            start = end
    return out


def _listed(grid: Grid, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, segment) where a box of the cell may be met; segments in order in each cell."""
    (nx, ny), (ox, oy), width = grid.shape, grid.origin, grid.width
    if nx * ny == 1:
        return np.zeros(len(x1), np.int64), np.arange(len(x1))
    low, high = np.minimum(x1, x2), np.maximum(x1, x2)
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    far = 1e-12 * np.maximum(np.maximum(np.abs(x1), np.abs(x2)), np.maximum(np.abs(y1), np.abs(y2)))
    reach = grid.reach + np.where(np.isfinite(far), far, 0.0)
    first = np.clip(np.floor((low - reach - ox) / width), 0, nx)
    last = np.clip(np.floor((high + reach - grid.reach - ox) / width), -1, nx - 1)
    known = ~(np.isnan(first) | np.isnan(last))
    first, last = np.where(known, first, 0).astype(np.int64), np.where(known, last, -1).astype(np.int64)
    segment, column = _places(np.maximum(last - first + 1, 0))
    column += first[segment]
    # The part of the segment beside the column, and its extent along y.
    slope = np.where((x2 != x1) & np.isfinite(low) & np.isfinite(high), (y2 - y1) / (x2 - x1), np.nan)[segment]
    a, b, near = x1[segment], y1[segment], reach[segment]
    left = ox + column * width
    slack = near - grid.reach + 1e-9 * width
    beside = left - slack, left + width + near
    ends = [b + (np.clip(at, low[segment], high[segment]) - a) * slope for at in beside]
    down = np.fmax(bottom[segment], np.minimum(*ends) - slack)
    up = np.fmin(top[segment], np.maximum(*ends) + slack)
    first = np.clip(np.floor((down - near - oy) / width), 0, ny)
    last = np.clip(np.floor((up + slack - oy) / width), -1, ny - 1)
    known = ~(np.isnan(first) | np.isnan(last))
    first, last = np.where(known, first, 0).astype(np.int64), np.where(known, last, -1).astype(np.int64)
    of, row = _places(np.maximum(last - first + 1, 0))
    cell = column[of] * ny + first[of] + row
    order = np.argsort(cell.astype(np.uint16), kind="stable")
    return cell[order], segment[of[order]]


def _slab(low: np.ndarray, high: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of its way at which each segment (column) enters and leaves each slab (row); -inf and inf for always."""
    a, b = low[:, None] - at, high[:, None] - at
    a /= step
    b /= step
    enter, leave = np.fmin(a, b), np.maximum(a, b, out=b)
    still = np.flatnonzero(step == 0)
    if len(still):
        place = at[still]
        inside = (low[:, None] <= place) & ((place <= high[:, None]) | np.isnan(high[:, None]))
        enter[:, still] = np.where(inside, -np.inf, np.inf)
        leave[:, still] = np.where(inside, np.inf, -np.inf)
    return enter, leave


def _hits(sides, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    """Box and segment of the contacts, in order."""
    bx0, by0, bx1, by1 = sides
    enter, leave = _slab(bx0, bx1, x1, x2 - x1)
    enter_y, leave_y = _slab(by0, by1, y1, y2 - y1)
    np.maximum(enter, enter_y, out=enter)
    np.maximum(enter, 0.0, out=enter)
    # A bound that is no number sets none: NaN counts as the greatest value.
    np.fmin(leave, leave_y, out=leave)
    np.fmin(leave, 1.0, out=leave)
    flat = np.flatnonzero(enter <= leave)
    col = flat // len(x1)
    row = flat - col * len(x1)
    # Extents that miss each other by less than the shares can show: only at an end of the segment, or at
    # boxes without bounds or with corners in the wrong order.
    odd = np.flatnonzero((enter.ravel()[flat] >= 1.0) | (leave.ravel()[flat] <= 0.0))
    if not all(np.all((d >= 0) & np.isfinite(d)) for d in (bx1 - bx0, by1 - by0)):
        odd = np.arange(len(flat))
    if len(odd):
        r, c = row[odd], col[odd]
        apart = np.zeros(len(odd), bool)
        for p, q, low, high in ((x1, x2, bx0, bx1), (y1, y2, by0, by1)):
            apart |= np.minimum(p, q)[r] > np.where(np.isnan(high), np.inf, high)[c]
            apart |= ~(np.maximum(p, q)[r] >= low[c])
        if apart.any():
            col, row = np.delete(col, odd[apart]), np.delete(row, odd[apart])
    return col, row


def _in_cell(sides, box: np.ndarray, row: np.ndarray, path: np.ndarray, ends) -> Iterator[Met]:
    """Contacts of the segments ``row`` with the boxes of one cell: box, number of segments and first segment of each pair."""
    n, x1, y1, x2, y2 = len(box), *(e[row] for e in ends)
    at_most = max(1, STEP // n)
    new = np.flatnonzero(np.diff(path[row])) + 1
    heads = np.concatenate(([0], new, [len(row)]))
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(heads, heads[i] + at_most, "right")) - 1)
        start, end, paths = heads[i], heads[j], j - i
        rank = np.repeat(np.arange(paths), np.diff(heads[i : j + 1]))
        count, first = None, np.full(paths * n, end, np.int32)
        # A path of many segments goes in steps, from the last to the first.
        for high in range(end, start, -at_most):
            low = max(start, high - at_most)
            col, seen = _hits(sides, x1[low:high], y1[low:high], x2[low:high], y2[low:high])
            seen += low - start
            if paths == end - start:
                found = np.ones(len(col), np.int64)
                break
            key = rank[seen] * n + col
            found = np.bincount(key, minlength=paths * n)
            count = found if count is None else count + found
            first[key[::-1]] = seen[::-1]
        else:
            key = np.flatnonzero(count)
            found, seen, col = count[key], first[key], key % n
        # Those of one segment and number together.
        if (end - start) << 4 < 1 << 16:
            order = np.argsort((seen * 16 + np.minimum(found, 15)).astype(np.uint16), kind="stable")
        else:
            order = np.lexsort((found, seen))
        if len(col):
            yield box[col[order]], found[order], row[seen[order] + start]
        i = j


def _piece(grids: list[Grid], path: np.ndarray, ends: tuple[np.ndarray, ...]) -> Iterator[Met]:
    for grid in grids:
        cell, row = _listed(grid, *ends)
        if not len(cell):
            continue
        heads = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
        for start, end, c in zip(heads, heads[1:], cell[heads[:-1]]):
            lo, hi = grid.starts[c], grid.starts[c + 1]
            if hi > lo:
                yield from _in_cell(tuple(s[lo:hi] for s in grid.sides), grid.box[lo:hi], row[start:end], path, ends)


def contacts(grids: list[Grid], path: np.ndarray, *ends: np.ndarray) -> Iterator[Met]:
    """Box, number of segments in contact and first of these for each (path, box) that meet; each pair once.

    ``path`` grows along the segments, which stand in the order of time within a path.
    """
    with np.errstate(all="ignore"):
        heads = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
        i = 0
        while i < len(heads) - 1:
            j = max(i + 1, int(np.searchsorted(heads, heads[i] + PIECE, "right")) - 1)
            start, end = heads[i], heads[j]
            if end - start <= PIECE:
                for box, n, row in _piece(grids, path[start:end], tuple(e[start:end] for e in ends)):
                    yield box, n, row + start
            else:  # one path of many segments
                boxes = 1 + max(int(g.box.max()) for g in grids)
                count, first = np.zeros(boxes, np.int64), np.full(boxes, end)
                for low in range(start, end, PIECE):
                    high = min(end, low + PIECE)
                    for box, n, row in _piece(grids, path[low:high], tuple(e[low:high] for e in ends)):
                        count[box] += n
                        first[box] = np.minimum(first[box], row + low)
                box = np.flatnonzero(count)
                yield box, count[box], first[box]
            i = j


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before; NULL equals NULL."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for column in columns:
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        same = pc.fill_null(pc.equal(a, b), False)
        unknown = pc.and_(a.is_null(nan_is_null=True), b.is_null(nan_is_null=True))
        new |= ~pc.or_(same, unknown).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def packed(group: list[str]) -> Callable[[pa.Table], pa.Table]:
    """``group`` and ``boxes``: the boxes of a group (``xmin, ymin, xmax, ymax, ids``) as one value."""

    def run(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        boxes = rows.select(["xmin", "ymin", "xmax", "ymax", "ids"]).combine_chunks()
        with pa.ipc.new_stream(sink, boxes.schema) as writer:
            writer.write_table(boxes)
        return rows.select(group).slice(0, 1).append_column("boxes", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    return run


class Boxes:
    """The boxes of one group, from what ``packed`` gave."""

    def __init__(self, packs: list[pa.Buffer]):
        boxes = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks()
        sides = [boxes.column(c).to_numpy() for c in ("xmin", "ymin", "xmax", "ymax")]
        ids = pa.concat_arrays(boxes.column("ids").chunks)
        self.grids = box_grids(*sides)
        self.number = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.number) - self.number
        self.ids = ids.flatten()
        self.single = len(self.ids) == len(self.number)

    def visits(self, rows: pa.RecordBatch, path: list[str], ends: list[str]) -> Iterator[pa.RecordBatch]:
        """Visits of whole paths, in order of path and time; regions with the same first contact and number share a row."""
        heads = _changes([rows.column(c) for c in path])
        of = np.zeros(len(rows), np.int64)
        of[heads] = 1
        np.cumsum(of, out=of)
        shown = [rows.column(c) for c in path]
        times = rows.column("t")

        def given(parts: list[Met]) -> pa.RecordBatch:
            box, n, row = (np.concatenate(p) for p in zip(*parts))
            heads = np.concatenate(([0], np.flatnonzero((np.diff(row) != 0) | (np.diff(n) != 0)) + 1))
            ends = np.append(heads[1:], len(box))
            if self.single:
                ids = self.ids.take(pa.array(box))
            else:
                one, within = _places(self.number[box])
                ids = self.ids.take(pa.array(self.start[box][one] + within))
                ends = np.cumsum(self.number[box])[ends - 1]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), ids)
            at = pa.array(row[heads])
            columns = [*[c.take(at) for c in shown], lists, pa.array(n[heads]), times.take(at)]
            return pa.RecordBatch.from_arrays(columns, [*path, "ids", "n_segments", "first_contact"])

        parts, size = [], 0
        for met in contacts(self.grids, of, *[rows.column(c).to_numpy(zero_copy_only=False) for c in ends]):
            many = 1 if self.single else max(1, int(self.number[met[0]].max()))
            for low in range(0, len(met[0]), max(1, GIVEN // many)):
                some = tuple(m[low : low + max(1, GIVEN // many)] for m in met)
                parts.append(some)
                size += len(some[0]) if self.single else int(self.number[some[0]].sum())
                if size >= GIVEN:
                    yield given(parts)
                    parts, size = [], 0
        if parts:
            yield given(parts)


def visits(group: list[str], path: list[str], ends: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows in order of group, boxes before segments, path and time: ``path``, ids of regions, n_segments, first_contact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, boxes, held = None, [], None, []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """The segments held so far, but for the last path unless its group is at an end."""
            nonlocal held
            some = pa.concat_batches(held) if held else None
            held = []
            if some is None:
                return
            if not last:
                heads = _changes([some.column(c) for c in path])
                cut = int(heads[-1]) if len(heads) else 0
                held, some = [some.slice(cut)], some.slice(0, cut)
            if len(some):
                yield from boxes.visits(some, path, ends)

        for batch in batches:
            listed = batch.column("boxes")
            heads = [0, *_changes([*[batch.column(c) for c in group], listed.is_null()]), len(batch)]
            for start, end in zip(heads, heads[1:]):
                place = tuple(batch.column(c)[start] for c in group)
                if place != here:
                    yield from whole(True)
                    here, rows, boxes = place, [], None
                if listed[start].is_valid:
                    rows += [pack.as_buffer() for pack in listed.slice(start, end - start)]
                elif rows:
                    boxes = boxes or Boxes(rows)
                    held.append(batch.slice(start, end - start).select([*path, "t", *ends]))
                    if sum(map(len, held)) >= PIECE:
                        yield from whole(False)
        yield from whole(True)

    return run
