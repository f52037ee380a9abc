"""Planar arrangements in NumPy, for the rows of one Arrow batch together: each row has an arrangement of its own.

A row's edges meet each other in pairs; pairs are listed in blocks of bounded size, so that memory doesn't grow with them. Rows that differ
by their place alone, such as the storeys of a tower, are worked out once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # pairs looked at together
OPS = {"intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "symmetric": lambda a, b: a != b}
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(v * 10.0**digits + 0.5) / 10.0**digits


class Rings:
    """Closed rings or lines of many rows: of each point its row, ring, x and y; of each ring its row."""

    def __init__(self, shapes: pa.Array):
        size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rings = shapes.flatten()
        points = rings.flatten()
        self.rows = len(shapes)
        self.row_of_ring = np.repeat(np.arange(self.rows), size(shapes))
        self.size = size(rings)
        self.ring = np.repeat(np.arange(len(rings)), self.size)
        self.x, self.y = (c.to_numpy(zero_copy_only=False).astype(float) for c in points.flatten())

    @property
    def row(self) -> np.ndarray:
        return self.row_of_ring[self.ring]

    def snapped(self, digits: int) -> Rings:
        self.x, self.y = rounded(self.x, digits), rounded(self.y, digits)
        return self

    def steps(self) -> np.ndarray:
        """The points that another one of their ring follows."""
        return np.flatnonzero(self.ring[1:] == self.ring[:-1])

    def _of(self, rings: np.ndarray, rows: int, row_of_ring: np.ndarray) -> Rings:
        out = Rings.__new__(Rings)
        out.rows, out.row_of_ring, out.size = rows, row_of_ring, self.size[rings]
        out.ring = np.repeat(np.arange(rings.size), out.size)
        at = each((np.cumsum(self.size) - self.size)[rings], out.size)
        out.x, out.y = self.x[at], self.y[at]
        return out

    def take(self, rows: np.ndarray) -> Rings:
        n = np.bincount(self.row_of_ring, minlength=self.rows)
        return self._of(each((np.cumsum(n) - n)[rows], n[rows]), rows.size, np.repeat(np.arange(rows.size), n[rows]))

    def over(self, rows: int) -> Rings:
        """Itself with further rows, which are empty."""
        self.rows = rows
        return self

    def single(self) -> Rings:
        """Each ring as a row of its own."""
        every = np.arange(self.size.size)
        return self._of(every, every.size, every)


def each(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from ``first`` on, for all of them one after another."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if total.size else 0)


def mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def alike(rows: int, columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a row of each kind, and each row's kind. Rows of a kind have the same values in all columns (values of 64 bits, their rows in
    order). Kinds are found by hash and compared in full; a row that only its hash joins to others is a kind of its own."""
    columns = [(v.view(np.uint64), row) for v, row in columns]
    total, laid = np.zeros(rows, np.uint64), []
    for v, row in columns:
        n = np.bincount(row, minlength=rows)
        start = np.cumsum(n) - n
        place = np.arange(row.size) - start[row]
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(v + mixed(place.astype(np.uint64))))]
        total = mixed(total + mixed(sums[start + n] - sums[start] + n.astype(np.uint64)))
        laid.append((n, start, place))
    _, first, which = np.unique(total, return_index=True, return_inverse=True)
    model, odd = first[which], np.zeros(rows, bool)
    for n, _, _ in laid:
        odd |= n != n[model]
    for (v, row), (_, start, place) in zip(columns, laid):
        i = np.flatnonzero(~odd[row])
        odd[row[i[v[i] != v[start[model[row[i]]] + place[i]]]]] = True
    return np.unique(np.where(odd, np.arange(rows), model), return_inverse=True)


def moved(a: pa.Array, row: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> pa.Array:
    """a with its points, at whatever depth, moved by their row's offsets; row has that of each element."""
    if pa.types.is_list(a.type):
        size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        values = moved(a.flatten(), np.repeat(row, size), ox, oy)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), values, mask=a.is_null() if a.null_count else None)
    if a.type == POINT:
        x, y = (c.to_numpy(zero_copy_only=False) for c in a.flatten())
        return pa.StructArray.from_arrays([pa.array(x + ox[row]), pa.array(y + oy[row])], fields=list(POINT))
    if pa.types.is_struct(a.type):
        return pa.StructArray.from_arrays([moved(c, row, ox, oy) for c in a.flatten()], names=[f.name for f in a.type], mask=a.is_null() if a.null_count else None)
    return a


def once(kernel: Callable[..., pa.Array], sides: list[Rings], *args) -> pa.Array:
    """The kernel's result for each row of the sides: computed beside the origin, for one row of a kind."""
    n, rows = sides[0].rows, [r.row for r in sides]
    ox, oy = corner(n, rows, [r.x for r in sides]), corner(n, rows, [r.y for r in sides])
    columns = []
    for r, row in zip(sides, rows):
        r.x, r.y = r.x - ox[row], r.y - oy[row]
        columns += [(r.size, r.row_of_ring), (r.x, row), (r.y, row)]
    first, which = alike(n, columns)
    out = kernel(*(r.take(first) for r in sides), *args).take(pa.array(which))
    return moved(out, np.arange(n), ox, oy)


def corner(n: int, rows, values) -> np.ndarray:
    """The least value of each row, rounded down; 0 without any."""
    out = np.full(n, np.inf)
    for r, v in zip(rows, values):
        np.minimum.at(out, r, np.where(np.isfinite(v), v, np.inf))
    return np.floor(np.where(np.isfinite(out), out, 0.0))


def listed(own: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in blocks: each i of own with ``count`` numbers from ``first`` on."""
    total = np.r_[0, np.cumsum(count)]
    at = 0
    while at < own.size:
        end = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK, "right")) - 1)
        c = count[at:end]
        i = np.repeat(own[at:end], c)
        yield i, np.repeat(first[at:end] - (total[at:end] - total[at]), c) + np.arange(i.size)
        at = end


def spans(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n keys begins and ends in a sorted array."""
    return np.searchsorted(key, np.arange(n)), np.searchsorted(key, np.arange(n), "right")


class Arrangement:
    """The pieces of two sides' edges: k (row), u -> v with u before v, a and b (how many edges of either side run here), ox and oy of each row."""

    def __init__(self, a: Rings, b: Rings, digits: int = 6):
        n = self.rows = a.rows
        self.ox, self.oy = corner(n, (a.row, b.row), (a.x, b.x)), corner(n, (a.row, b.row), (a.y, b.y))
        cols = []
        for side, r in enumerate((a, b)):
            i = r.steps()
            k = r.row[i]
            ox, oy = self.ox[k], self.oy[k]
            cols.append((k, np.full(i.size, side), *(rounded(v, digits) for v in (r.x[i] - ox, r.y[i] - oy, r.x[i + 1] - ox, r.y[i + 1] - oy))))
        k, side, *ends = (np.concatenate(c) for c in zip(*cols))
        good = np.isfinite(np.stack(ends)).all(0) & ((ends[0] != ends[2]) | (ends[1] != ends[3]))
        order = np.flatnonzero(good)[np.argsort(k[good], kind="stable")]
        self._cut(k[order], side[order], np.stack(ends)[:, order], digits)

    def _cut(self, k: np.ndarray, side: np.ndarray, e: np.ndarray, digits: int) -> None:
        tol = 0.5 * 10.0**-digits
        low, high = np.minimum(e[:2], e[2:]) - tol, np.maximum(e[:2], e[2:])
        every = np.arange(k.size)
        last = spans(k, self.rows)[1][k]
        seg, px, py = [every, every], [e[0], e[2]], [e[1], e[3]]
        for p, q in listed(every, every + 1, last - every - 1):
            near = (low[0][p] <= high[0][q]) & (low[0][q] <= high[0][p]) & (low[1][p] <= high[1][q]) & (low[1][q] <= high[1][p])
            p, q = p[near], q[near]
            free = np.ones(p.size, bool)
            for s, t in ((p, q), (q, p)):  # ends of s on t, its ends included
                (x0, y0, x1, y1) = e[:, t]
                dx, dy = x1 - x0, y1 - y0
                size = dx * dx + dy * dy
                for x, y in ((e[0][s], e[1][s]), (e[2][s], e[3][s])):
                    rx, ry = x - x0, y - y0
                    dot = dx * rx + dy * ry
                    on = (np.abs(dx * ry - dy * rx) <= tol * np.sqrt(size)) & (dot >= 0) & (dot <= size)
                    free &= ~on
                    seg.append(t[on]), px.append(x[on]), py.append(y[on])
            p, q = p[free], q[free]
            px0, py0, px1, py1 = e[:, p]
            qx0, qy0, qx1, qy1 = e[:, q]
            den = (px1 - px0) * (qy1 - qy0) - (py1 - py0) * (qx1 - qx0)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((qx0 - px0) * (qy1 - qy0) - (qy0 - py0) * (qx1 - qx0)) / den
                u = ((qx0 - px0) * (py1 - py0) - (qy0 - py0) * (px1 - px0)) / den
                hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            x, y = (rounded((c0 + t * (c1 - c0))[hit], digits) for c0, c1 in ((px0, px1), (py0, py1)))
            for s in (p[hit], q[hit]):
                seg.append(s), px.append(x), py.append(y)
        seg, px, py = np.concatenate(seg), np.concatenate(px), np.concatenate(py)
        x0, y0, x1, y1 = e[:, seg]
        order = np.lexsort((py, px, (px - x0) * (x1 - x0) + (py - y0) * (y1 - y0), seg))
        seg, px, py = seg[order], px[order], py[order]
        i = np.flatnonzero((seg[1:] == seg[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1])))
        u, v = px[i] + 1j * py[i], px[i + 1] + 1j * py[i + 1]
        back = (v.real < u.real) | ((v.real == u.real) & (v.imag < u.imag))
        u, v = np.where(back, v, u), np.where(back, u, v)
        k, side = k[seg[i]], side[seg[i]]
        # equal pieces fold into one
        order = np.lexsort((v.imag, v.real, u.imag, u.real, k))
        k, u, v, side = k[order], u[order], v[order], side[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if k.size else np.zeros(0, np.int64)
        self.k, self.u, self.v = k[first], u[first], v[first]
        n = np.diff(np.r_[first, k.size])
        self.b = np.add.reduceat(side, first) if first.size else np.zeros(0, np.int64)
        self.a = n - self.b

    def sided(self, sides: str = "ab") -> dict[str, np.ndarray]:
        """la, ra, lb, rb: whether a piece's left (seen from u to v) and right lie in shape a and in shape b, by the pieces that a ray crosses."""
        counts = {"a": self.a, "b": self.b}
        odd = np.flatnonzero(np.any([counts[c] % 2 == 1 for c in sides], axis=0))  # a piece of an even count parts nothing
        first, last = spans(self.k[odd], self.rows)
        ux, uy, vx, vy = self.u.real, self.u.imag, self.v.real, self.v.imag
        mx, my, up = (ux + vx) / 2, (uy + vy) / 2, ux == vx
        low, high = np.minimum(uy, vy), np.maximum(uy, vy)
        n = {c: np.zeros(self.k.size, np.int64) for c in sides}
        for e, j in listed(np.arange(self.k.size), first[self.k], (last - first)[self.k]):
            f = odd[j]
            across = np.where(up[e], (low[f] <= my[e]) & (high[f] > my[e]), (ux[f] <= mx[e]) & (vx[f] > mx[e])) & (e != f)
            e, f = e[across], f[across]
            with np.errstate(divide="ignore", invalid="ignore"):
                before = np.where(up[e], ux[f] + (vx[f] - ux[f]) * (my[e] - uy[f]) / (vy[f] - uy[f]) < mx[e], uy[f] + (vy[f] - uy[f]) * (mx[e] - ux[f]) / (vx[f] - ux[f]) < my[e])
            e, f = e[before], f[before]
            for c in sides:
                n[c] += np.bincount(e, counts[c][f], self.k.size).astype(np.int64)
        out = {}
        for c in sides:
            near, far = n[c] % 2 == 1, (n[c] + counts[c]) % 2 == 1
            out[f"l{c}"], out[f"r{c}"] = np.where(up, near, far), np.where(up, far, near)
        return out


def _sign(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """1 where something lies on the left only, -1 on the right only, else 0."""
    return left.astype(np.int8) - right.astype(np.int8)


def cycles(key: np.ndarray, f: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cycle, place in it) of directed edges f -> t (points, as complex numbers) of many keys: at its end an edge goes on
    with the next one clockwise from where it came."""
    n = key.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate([f, t])
    keys = np.concatenate([key, key])
    order = np.lexsort((points.imag, points.real, keys))
    new = np.r_[True, (points[order][1:] != points[order][:-1]) | (keys[order][1:] != keys[order][:-1])]
    node = np.empty(2 * n, np.int64)
    node[order] = np.cumsum(new) - 1
    ask = np.repeat([1, 0], n)  # outgoing edges stand at their start, the asking ones at their end; of equal angles the asking one is first
    angle = np.angle(np.concatenate([t - f, f - t]))
    order = np.lexsort((ask, angle, node))
    out = ask[order] == 1
    place = np.where(out, np.arange(2 * n), -1)
    before = np.maximum.accumulate(place)
    group = node[order]
    change = np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(change)
    last = np.maximum.reduceat(place, first)[np.cumsum(change) - 1]
    before = np.where(before >= np.repeat(first, np.diff(np.r_[first, 2 * n])), before, last)
    after = np.empty(n, np.int64)
    after[order[~out] - n] = order[before[~out]]
    # the least edge names the cycle; then its places, counted back from the edge before it
    rounds = max(1, int(np.bincount(key).max() - 1).bit_length())
    name, jump = np.arange(n), after.copy()
    for _ in range(rounds):
        name, jump = np.minimum(name, name[jump]), jump[jump]
    end = after == name
    jump, dist = np.where(end, np.arange(n), after), (~end).astype(np.int64)
    for _ in range(rounds):
        dist, jump = dist + dist[jump], jump[jump]
    return name, np.bincount(name, minlength=n)[name] - 1 - dist


class Traced:
    """Rings of directed edges: of each ring its row k, signed area, leftmost point (lowest of those), bounds, and its edges in order."""

    def __init__(self, k: np.ndarray, f: np.ndarray, t: np.ndarray, cycle: np.ndarray, place: np.ndarray, inside: np.ndarray):
        order = np.lexsort((place, cycle))
        self.f, self.t, cycle, k = f[order], t[order], cycle[order], k[order]
        self.first = np.flatnonzero(np.r_[True, cycle[1:] != cycle[:-1]]) if k.size else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, k.size])
        self.k, self.ring = k[self.first], np.repeat(np.arange(self.first.size), self.size)
        over = lambda g, v: g.reduceat(v, self.first) if self.first.size else v[:0]
        self.area = over(np.add, self.f.real * self.t.imag - self.t.real * self.f.imag) / 2
        self.x0, self.y0, self.x1, self.y1 = over(np.minimum, self.f.real), over(np.minimum, self.f.imag), over(np.maximum, self.f.real), over(np.maximum, self.f.imag)
        self.py = over(np.minimum, np.where(self.f.real == self.x0[self.ring], self.f.imag, np.inf))
        self.inside = over(np.logical_and, inside[order])

    def closed(self, rings: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> pa.ListArray:
        """The rings, in the rows' own coordinates."""
        size = self.size[rings] + 1
        ends = np.cumsum(size)
        i = np.arange(int(ends[-1]) if size.size else 0) - np.repeat(ends - size, size)
        own = np.repeat(rings, size)
        at = self.first[own] + np.where(i == self.size[own], 0, i)
        k = self.k[own]
        points = pa.StructArray.from_arrays([pa.array(self.f.real[at] + ox[k]), pa.array(self.f.imag[at] + oy[k])], fields=list(POINT))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), points)


def _nested(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """values, sorted by owner, as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)), values)


def areas(a: pa.Array, b: pa.Array, digits: int) -> pa.StructArray:
    """area_a, area_b and the area of each of ``OPS``; null for rows without an edge."""
    return once(_areas, [Rings(a), Rings(b)], digits)


def _areas(a: Rings, b: Rings, digits: int) -> pa.StructArray:
    m = Arrangement(a, b, digits)
    s = m.sided()
    cross = (m.u.real * m.v.imag - m.v.real * m.u.imag) / 2
    total = lambda left, right: np.bincount(m.k, _sign(left, right) * cross, m.rows)
    out = {f"area_{c}": total(s[f"l{c}"], s[f"r{c}"]) for c in "ab"} | {op: total(f(s["la"], s["lb"]), f(s["ra"], s["rb"])) for op, f in OPS.items()}
    none = np.bincount(m.k, minlength=m.rows) == 0
    return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], names=list(out), mask=pa.array(none))


def results(a: pa.Array, b: pa.Array, op: str, digits: int) -> pa.StructArray:
    """shape (outer rings counter-clockwise, holes clockwise, largest first) and area of an operation; null where it is empty."""
    return once(_results, [Rings(a), Rings(b)], op, digits)


def _results(a: Rings, b: Rings, op: str, digits: int) -> pa.StructArray:
    m = Arrangement(a, b, digits)
    s = m.sided()
    way = _sign(OPS[op](s["la"], s["lb"]), OPS[op](s["ra"], s["rb"]))
    on = way != 0
    k, u, v, way = m.k[on], m.u[on], m.v[on], way[on]
    f, t = np.where(way > 0, u, v), np.where(way > 0, v, u)
    r = Traced(k, f, t, *cycles(k, f, t), np.ones(k.size, bool))
    order = np.lexsort((r.py, r.x0, -r.area, r.k))
    shape = _nested(r.closed(order, m.ox, m.oy), r.k[order], m.rows)
    none = np.bincount(r.k, minlength=m.rows) == 0
    return pa.StructArray.from_arrays([shape, pa.array(np.bincount(r.k, r.area, m.rows))], names=["shape", "area"], mask=pa.array(none))


def clipped(rings: pa.Array, shape: pa.Array, digits: int) -> pa.ListArray:
    """Of each row's rings the own area, and shape and area of what lies in the row's shape (null if nothing does)."""
    return once(_clipped, [Rings(rings), Rings(shape)], digits)


def _clipped(own: Rings, shape: Rings, digits: int) -> pa.ListArray:
    one, other = own.single(), shape.take(own.row_of_ring)
    got = _results(one, other, "intersection", digits)
    whole = _areas(one, other, digits).flatten()[0]
    return _nested(pa.StructArray.from_arrays([whole, *got.flatten()], names=["own", "shape", "area"]), own.row_of_ring, own.rows)


def drawn(plate: Rings, walls: Rings, tolerance: float) -> Rings:
    """Walls that reach the outer ring at both ends are drawn out along their direction, well beyond the plate: what lies within it
    are chords that meet the ring exactly. Others stay as they are."""
    i = plate.steps()
    outer = np.full(plate.rows, -1)
    outer[plate.row_of_ring[::-1]] = np.arange(plate.row_of_ring.size)[::-1]
    i = i[plate.ring[i] == outer[plate.row[i]]]
    k = plate.row[i]
    ax, ay, dx, dy = plate.x[i], plate.y[i], plate.x[i + 1] - plate.x[i], plate.y[i + 1] - plate.y[i]
    size = dx * dx + dy * dy
    far = 2 * np.bincount(k, np.sqrt(size), plate.rows) + 1
    first, last = spans(k, plate.rows)
    w = np.flatnonzero(walls.size > 1)
    start = np.cumsum(walls.size) - walls.size
    p, q, own = start[w], start[w] + walls.size[w] - 1, walls.row_of_ring[w]
    reach = []
    for end in (p, q):
        got = np.zeros(w.size, bool)
        for n, e in listed(np.arange(w.size), first[own], (last - first)[own]):
            rx, ry = walls.x[end[n]] - ax[e], walls.y[end[n]] - ay[e]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(size[e] > 0, np.clip((rx * dx[e] + ry * dy[e]) / size[e], 0.0, 1.0), 0.0)
            got[n[np.hypot(rx - t * dx[e], ry - t * dy[e]) <= tolerance]] = True
        reach.append(got)
    wx, wy = walls.x[q] - walls.x[p], walls.y[q] - walls.y[p]
    size = np.hypot(wx, wy)
    chord = reach[0] & reach[1] & (size > 0)
    # a chord is its ring's first two points; what else its wall has goes
    out, c = Rings.__new__(Rings), w[chord]
    number = walls.size.copy()
    number[walls.size < 2] = 0
    number[c] = 2
    out.rows, out.row_of_ring, out.size = walls.rows, walls.row_of_ring, number
    out.ring = np.repeat(np.arange(number.size), number)
    at = np.repeat(start, number) + np.arange(out.ring.size) - np.repeat(np.cumsum(number) - number, number)
    out.x, out.y = walls.x[at], walls.y[at]
    s = (np.cumsum(number) - number)[c]
    x, y, k = walls.x[p[chord]], walls.y[p[chord]], far[own[chord]]
    ux, uy = wx[chord] / size[chord], wy[chord] / size[chord]
    out.x[s], out.y[s], out.x[s + 1], out.y[s + 1] = x - k * ux, y - k * uy, x + k * ux, y + k * uy
    return out


def divided(plate: pa.Array, walls: pa.Array, grid: int, tolerance: float, digits: int, shapes: bool = True) -> pa.ListArray:
    """Of each row the faces of its plate between its walls, as (shape, area), by decreasing area, then bounds; as (area) if shapes aren't wanted."""
    return once(_divided, [Rings(plate).snapped(grid), Rings(walls).snapped(grid)], grid, tolerance, digits, shapes)


def _divided(a: Rings, walls: Rings, grid: int, tolerance: float, digits: int, shapes: bool = True) -> pa.ListArray:
    a = a.snapped(grid)
    m = Arrangement(a, drawn(a, walls.snapped(grid), tolerance), digits)
    s = m.sided("a")
    on = s["la"] | s["ra"]
    k, u, v, left, right = m.k[on], m.u[on], m.v[on], s["la"][on], s["ra"][on]
    while True:  # pieces with one cycle on both sides (stubs, bridges) part nothing
        n = k.size
        f, t, kk = np.r_[u, v], np.r_[v, u], np.r_[k, k]
        order = np.argsort(kk, kind="stable")
        cycle, place = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
        cycle[order], place[order] = cycles(kk[order], f[order], t[order])
        idle = cycle[:n] == cycle[n:]
        if not idle.any():
            break
        k, u, v, left, right = (x[~idle] for x in (k, u, v, left, right))
    r = Traced(kk, f, t, cycle, place, np.r_[left, right])
    # a cycle that turns clockwise bounds the plate from outside, or is a hole of the least face around it
    holes = np.flatnonzero(r.area < 0)
    edge = np.flatnonzero(r.area[r.ring] > 0)
    edge = edge[np.argsort(r.k[r.ring[edge]], kind="stable")]
    first, last = spans(r.k[r.ring[edge]], m.rows)
    ray, around = [], []
    for h, j in listed(holes, first[r.k[holes]], (last - first)[r.k[holes]]):
        e = edge[j]
        ey, ty, hy = r.f.imag[e], r.t.imag[e], r.py[h]
        across = (np.minimum(ey, ty) <= hy) & (np.maximum(ey, ty) > hy)
        h, e = h[across], e[across]
        x_at = r.f.real[e] + (r.t.real[e] - r.f.real[e]) * (r.py[h] - r.f.imag[e]) / (r.t.imag[e] - r.f.imag[e])
        met = x_at < r.x0[h]
        ray.append(h[met]), around.append(r.ring[e[met]])
    pair, n = np.unique(np.stack([np.concatenate(ray or [holes[:0]]), np.concatenate(around or [holes[:0]])]), axis=1, return_counts=True)
    hole, face = pair[:, n % 2 == 1]
    order = np.lexsort((r.area[face], hole))
    hole, face = hole[order], face[order]
    least = np.r_[True, hole[1:] != hole[:-1]][: hole.size]
    hole, face = hole[least], face[least]
    area = r.area + np.bincount(face, r.area[hole], r.area.size)
    full = np.flatnonzero((r.area > 0) & r.inside)  # faces within a hole of the plate lie outside it
    order = full[np.lexsort((r.y1[full], r.x1[full], r.y0[full], r.x0[full], -np.round(area[full], 6), r.k[full]))]
    rank = np.full(r.area.size, -1)
    rank[order] = np.arange(order.size)
    kept = rank[face] >= 0
    own, rings = np.r_[np.arange(order.size), rank[face[kept]]], np.r_[order, hole[kept]]
    by = np.argsort(own, kind="stable")
    shape = {"shape": _nested(r.closed(rings[by], m.ox, m.oy), own[by], order.size)} if shapes else {}
    out = shape | {"area": pa.array(area[order])}
    return _nested(pa.StructArray.from_arrays(list(out.values()), names=list(out)), r.k[order], m.rows)


def units(plate: pa.Array, walls: pa.Array, outlines: pa.Array, least: float, grid: int, tolerance: float, digits: int, shapes: bool = True) -> pa.StructArray:
    """Of each storey plate_area; clips, its outlines as by ``clipped``; and faces as by ``divided``, of those with walls and no clip of the least area."""
    return once(_units, [Rings(plate), Rings(walls), Rings(outlines)], least, grid, tolerance, digits, shapes)


def _units(plate: Rings, walls: Rings, outlines: Rings, least: float, grid: int, tolerance: float, digits: int, shapes: bool) -> pa.StructArray:
    n = plate.rows
    clips = _clipped(outlines, plate, digits)
    own, shape, area = clips.flatten().flatten()
    good = pc.fill_null(pc.greater_equal(area, least), False).to_numpy(zero_copy_only=False)
    walled = (np.bincount(outlines.row_of_ring[good], minlength=n) == 0) & (np.bincount(walls.row_of_ring, minlength=n) > 0)
    rows = np.flatnonzero(walled)
    faces = _divided(plate.take(rows), walls.take(rows), grid, tolerance, digits, shapes)
    size = np.zeros(n, np.int64)
    size[rows] = pc.list_value_length(faces).to_numpy(zero_copy_only=False)
    if not shapes:
        clips = _nested(pa.StructArray.from_arrays([own, area], names=["own", "area"]), outlines.row_of_ring, n)
    faces = _nested(faces.flatten(), np.repeat(np.arange(n), size), n)
    return pa.StructArray.from_arrays([_areas(plate, plate.take(np.arange(0)).over(n), digits).flatten()[0], clips, faces], names=["plate_area", "clips", "faces"])


def crossed(rings: pa.Array) -> pa.Array:
    """Of each closed ring whether two of its edges cross or overlap other than at a shared end."""
    r = Rings(pa.ListArray.from_arrays(pa.array(np.arange(len(rings) + 1, dtype=np.int32)), rings))
    i = r.steps()
    k = r.row[i]
    first, last = spans(k, r.rows)
    px, py, qx, qy = r.x[i], r.y[i], r.x[i + 1], r.y[i + 1]
    dx, dy, every, hit = qx - px, qy - py, np.arange(i.size), np.zeros(r.rows, bool)
    for f, g in listed(every, every + 1, last[k] - every - 1):
        side = lambda e, x, y: dx[e] * (y - py[e]) - dy[e] * (x - px[e])
        t0, t1, t2, t3 = side(f, px[g], py[g]), side(f, qx[g], qy[g]), side(g, px[f], py[f]), side(g, qx[f], qy[f])
        own = k[f]
        near = (g == f + 1) | ((f == first[own]) & (g == last[own] - 1))
        long = dx[f] * dx[f] + dy[f] * dy[f]
        d0, d1 = (dx[f] * (x[g] - px[f]) + dy[f] * (y[g] - py[f]) for x, y in ((px, py), (qx, qy)))
        shared = np.minimum(long, np.maximum(d0, d1)) - np.maximum(0.0, np.minimum(d0, d1))  # of two on one line
        line = (t0 == 0) & (t1 == 0) & (long > 0)
        meet = np.where(line, np.where(near, shared > 1e-12 * long, shared >= 0), ~near & (t0 * t1 <= 0) & (t2 * t3 <= 0))
        hit[own[meet]] = True
    return pa.array(hit)
