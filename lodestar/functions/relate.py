"""Topological relations of two geometries of any kind, with holes, concave rings and several parts.

The edges of each are cut wherever they meet the other; every piece then lies inside, outside or on the boundary of the other, and
these, with the side on which the interiors lie along shared pieces, decide all relations. No sampling of corners or middles alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.geometry import parts_of

NAMES = ["contains", "within", "touches", "crosses", "overlaps", "disjoint", "equals"]
FACTS = "struct<" + ",".join(f"{n}:boolean" for n in NAMES) + ">"
#: Positions nearer than this, in the unit of the coordinates, are the same; sides are looked at SIDE away.
EPS, SIDE = 1e-9, 1e-7
_CHUNK = 1 << 20


class Shape:
    """Points, or the edges (n, 4) of lines or rings, and the box around them."""

    def __init__(self, kind: str, parts: list[list[np.ndarray]]):
        rings = [r for p in parts for r in p]
        self.dim = 0 if kind.endswith("POINT") else 1 if kind.endswith("LINESTRING") else 2
        self.points = np.concatenate([*rings, np.zeros((0, 2))])
        edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings] + [np.zeros((0, 4))]) if self.dim else np.zeros((0, 4))
        self.edges = edges[np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]) > EPS]
        self.empty = not len(self.points)
        if self.dim == 1:  # the boundary of lines: ends that an odd number of parts have
            ends = np.concatenate([r[[0, -1]] for r in rings if len(r)] + [np.zeros((0, 2))])
            near = np.abs(ends[:, None] - ends[None]).max(axis=2) <= EPS if len(ends) < 2000 else np.eye(len(ends), dtype=bool)
            self.ends = ends[near.sum(axis=1) % 2 == 1]
        if not self.empty:
            self.low, self.high = self.points.min(axis=0), self.points.max(axis=0)


def _chunks(n: int, m: int):
    step = max(1, _CHUNK // max(1, m))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def on_edges(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether each point lies on some edge."""
    out = np.zeros(len(points), bool)
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    square = (d * d).sum(axis=1)
    for s in _chunks(len(points), len(edges)):
        p = points[s, None] - a[None]
        t = np.clip((p * d).sum(axis=2) / square, 0, 1)
        out[s] = (np.hypot(*np.moveaxis(p - t[..., None] * d, 2, 0)) <= EPS).any(axis=1)
    return out


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings."""
    out = np.zeros(len(points), bool)
    x0, y0, x1, y1 = edges.T
    slope = (x1 - x0) / np.where(y1 == y0, 1, y1 - y0)
    for s in _chunks(len(points), len(edges)):
        x, y = points[s, :1], points[s, 1:]
        hit = ((y0 > y) != (y1 > y)) & (x < x0 + slope * (y - y0))
        out[s] = hit.sum(axis=1) % 2 == 1
    return out


def place(points: np.ndarray, shape: Shape) -> np.ndarray:
    """1 in the interior, 0 on the boundary, -1 outside; a line's boundary are its ends, a point has none."""
    if shape.dim == 2:
        return np.where(on_edges(points, shape.edges), 0, np.where(inside(points, shape.edges), 1, -1))
    if shape.dim == 1:
        at_end = same_place(points, shape.ends)
        return np.where(at_end, 0, np.where(on_edges(points, shape.edges), 1, -1))
    return np.where(same_place(points, shape.points), 1, -1)


def same_place(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for s in _chunks(len(points), len(others)):
        out[s] = (np.abs(points[s, None] - others[None]).max(axis=2) <= EPS).any(axis=1)
    return out


def meetings(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge of one, place on it from 0 to 1) of every point at which the two sets of edges meet."""
    found = [(np.zeros(0, int), np.zeros(0))]
    for s in _chunks(len(one), len(two)):
        e = one[s]
        low, high = np.minimum(e[:, :2], e[:, 2:]) - EPS, np.maximum(e[:, :2], e[:, 2:]) + EPS
        near = ((low[:, None] <= np.maximum(two[:, :2], two[:, 2:])) & (high[:, None] >= np.minimum(two[:, :2], two[:, 2:]))).all(axis=2)
        i, j = np.nonzero(near)
        found.append(_meet(i + s.start, e[i], two[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([t for _, t in found])


def _meet(i: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place on the edge from 0 to 1) of every point at which row k of one meets row k of two; i numbers the edges of one."""
    found_i, found_t = [], []
    a, d, c, f = one[:, :2], one[:, 2:] - one[:, :2], two[:, :2], two[:, 2:] - two[:, :2]
    size, other = np.hypot(*d.T), np.hypot(*f.T)
    cross, gap = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0], c - a
    along = np.abs(cross) <= 1e-12 * size * other
    safe = np.where(along, 1, cross)
    t, u = (gap[:, 0] * f[:, 1] - gap[:, 1] * f[:, 0]) / safe, (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / safe
    hit = ~along & (t >= -EPS / size) & (t <= 1 + EPS / size) & (u >= -EPS / other) & (u <= 1 + EPS / other)
    found_i.append(i[hit])
    found_t.append(t[hit])
    # edges on one line: the ends of each that lie on the other
    level = along & (np.abs(gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) <= EPS * size)
    for end in (c, c + f):
        t = ((end - a) * d).sum(axis=1) / (size * size)
        hit = level & (t >= -EPS / size) & (t <= 1 + EPS / size)
        found_i.append(i[hit])
        found_t.append(t[hit])
    back = np.where(level[:, None], a - c, 0)
    for k in (0.0, 1.0):
        u = ((back + k * d) * f).sum(axis=1) / (other * other)
        hit = level & (u >= -EPS / other) & (u <= 1 + EPS / other)
        found_i.append(i[hit])
        found_t.append(np.full(hit.sum(), k))
    return np.concatenate(found_i), np.clip(np.concatenate(found_t), 0, 1)


def pieces(edges: np.ndarray, i: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middles and unit normals of the pieces into which the edges are cut, and the edge of each."""
    n = len(edges)
    at = np.concatenate([np.arange(n), np.arange(n), i])
    by = np.concatenate([np.zeros(n), np.ones(n), t])
    order = np.lexsort((by, at))
    at, by = at[order], by[order]
    d = edges[:, 2:] - edges[:, :2]
    size = np.hypot(*d.T)
    real = (at[1:] == at[:-1]) & ((by[1:] - by[:-1]) * size[at[1:]] > 2 * EPS)
    own, middle = at[1:][real], (by[1:][real] + by[:-1][real]) / 2
    unit = d[own] / size[own, None]
    return edges[own, :2] + middle[:, None] * d[own], np.stack([-unit[:, 1], unit[:, 0]], axis=1), own


def relate(one: Shape, two: Shape) -> dict[str, bool]:
    """All relations of two shapes, by the customary definitions of simple features."""
    out = dict.fromkeys(NAMES, False)
    if one.empty or two.empty or (one.low > two.high + EPS).any() or (two.low > one.high + EPS).any():
        return out | {"disjoint": True}
    if one.dim > two.dim:
        turned = relate(two, one)
        return turned | {"contains": turned["within"], "within": turned["contains"]}

    if one.dim == 0:
        at = place(one.points, two)
        out["within"] = bool((at >= 0).all() and (at == 1).any())
        if two.dim == 0:
            out["contains"] = bool(same_place(two.points, one.points).all())
            out["overlaps"] = bool((at == 1).any() and not out["within"] and not out["contains"])
        else:
            out["touches"] = bool((at >= 0).any() and not (at == 1).any())
            out["crosses"] = bool((at == 1).any() and (at == -1).any())
        out["disjoint"] = bool((at == -1).all())
        out["equals"] = out["within"] and out["contains"]
        return out

    i, t = meetings(one.edges, two.edges)
    middles, normals, _ = pieces(one.edges, i, t)
    at = place(middles, two)
    if one.dim == 1 and two.dim == 2:
        within, outside = bool((at == 1).any()), bool((at == -1).any())
        out["within"] = within and not outside
        out["crosses"] = within and outside
        out["touches"] = not within and bool(len(i) or (at == 0).any())
        out["disjoint"] = not within and not out["touches"]
        return out

    j, u = meetings(two.edges, one.edges)
    middles_two, _, _ = pieces(two.edges, j, u)
    back = place(middles_two, one)
    if one.dim == 1:
        shared = bool((at >= 0).any())
        meet = one.edges[i, :2] + t[:, None] * (one.edges[i, 2:] - one.edges[i, :2])
        inner = bool((~same_place(meet, one.ends) & ~same_place(meet, two.ends)).any()) or shared
        out["within"] = shared and not (at == -1).any()
        out["contains"] = shared and not (back == -1).any()
        out["overlaps"] = shared and not out["within"] and not out["contains"]
        out["crosses"] = inner and not shared
        out["touches"] = not inner and bool(len(i))
        out["disjoint"] = not len(i)
        out["equals"] = out["within"] and out["contains"]
        return {k: bool(v) for k, v in out.items()}

    # areas: where boundaries run together, do the interiors lie on the same side?
    run = at == 0
    left_one, left_two = (inside(middles[run] + SIDE * normals[run], s.edges) for s in (one, two))
    same, opposite = bool((left_one == left_two).any()), bool((left_one != left_two).any())
    interiors = bool((at == 1).any() or (back == 1).any() or same)
    # a part of two lies outside one if two's boundary runs outside one, one's inside two, or they run together from opposite sides
    out["contains"] = interiors and not ((back == -1).any() or (at == 1).any() or opposite)
    out["within"] = interiors and not ((at == -1).any() or (back == 1).any() or opposite)
    out["overlaps"] = interiors and not out["contains"] and not out["within"]
    out["touches"] = not interiors and bool(len(i))
    out["disjoint"] = not interiors and not len(i)
    out["equals"] = out["contains"] and out["within"]
    return {k: bool(v) for k, v in out.items()}


class Edges:
    """The edges of many geometries of one array, one after the other: those of geometry g are rows start[g] to start[g] + count[g]."""

    def __init__(self, geometries: pa.Array):
        n = len(geometries)
        parts = geometries.field("parts")
        sizes = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rings = parts.flatten()
        points = rings.flatten()
        of_part = np.repeat(np.arange(n), sizes(parts))
        of_ring = np.repeat(of_part, sizes(rings))
        ring = np.repeat(np.arange(len(points)), sizes(points))
        xy = points.flatten()
        xy = np.stack([xy.field("x").to_numpy(zero_copy_only=False), xy.field("y").to_numpy(zero_copy_only=False)], axis=1).reshape(-1, 2)
        own = of_ring[ring]
        follows = ring[1:] == ring[:-1]
        made = np.hstack([xy[:-1][follows], xy[1:][follows]]).reshape(-1, 4)
        real = np.hypot(made[:, 2] - made[:, 0], made[:, 3] - made[:, 1]) > EPS
        self.edges, self.of = made[real], own[:-1][follows][real]
        self.count = np.bincount(self.of, minlength=n)
        self.start = np.cumsum(self.count) - self.count
        kinds = np.array(geometries.field("kind").to_pylist(), dtype=object)
        known = geometries.is_valid().to_numpy(zero_copy_only=False) & parts.is_valid().to_numpy(zero_copy_only=False)
        self.dim = np.array([-1 if not ok or k is None else 0 if k.endswith("POINT") else 1 if k.endswith("LINESTRING") else 2 for k, ok in zip(kinds, known, strict=True)])
        self.low, self.high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)  # of one without points, apart from all
        held, first = np.unique(own, return_index=True)
        if len(held):
            self.low[held], self.high[held] = np.minimum.reduceat(xy, first), np.maximum.reduceat(xy, first)


def _crossed(of: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, other) of each row with all the others of its pair; row k has pair of[k], whose others are start to start + count."""
    n = count[of]
    row = np.repeat(np.arange(len(of)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[of], n)


def _any(row: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[row[flags]] = True
    return out


def _on_many(p: np.ndarray, row: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``on_edges`` for points that each have edges of their own."""
    d = e[:, 2:] - e[:, :2]
    gap = p[row] - e[:, :2]
    t = np.clip((gap * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
    return _any(row, np.hypot(*(gap - t[:, None] * d).T) <= EPS, len(p))


def _inside_many(p: np.ndarray, row: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``inside`` for points that each have edges of their own."""
    x0, y0, x1, y1 = e.T
    x, y = p[row].T
    slope = (x1 - x0) / np.where(y1 == y0, 1, y1 - y0)
    hit = ((y0 > y) != (y1 > y)) & (x < x0 + slope * (y - y0))
    return np.bincount(row[hit], minlength=len(p)) % 2 == 1


def _pieces_of(one: Edges, a: np.ndarray, two: Edges, b: np.ndarray):
    """For pairs (geometry a[k] of one, b[k] of two): (pair, middle, normal) of the pieces of one's edges, their place in the area of two, and
    whether the pair's edges meet."""
    pair, at = _crossed(np.arange(len(a)), one.start[a], one.count[a])
    edges = one.edges[at]
    row, other = _crossed(pair, two.start[b], two.count[b])
    mine, its = edges[row], two.edges[other]
    near = ((np.minimum(mine[:, :2], mine[:, 2:]) - EPS <= np.maximum(its[:, :2], its[:, 2:])) & (np.maximum(mine[:, :2], mine[:, 2:]) + EPS >= np.minimum(its[:, :2], its[:, 2:]))).all(axis=1)
    i, t = _meet(row[near], mine[near], its[near])
    middles, normals, own = pieces(edges, i, t)
    of = pair[own]
    row, other = _crossed(of, two.start[b], two.count[b])
    its = two.edges[other]
    placed = np.where(_on_many(middles, row, its), 0, np.where(_inside_many(middles, row, its), 1, -1))
    return of, middles, normals, placed, _any(pair, np.bincount(i, minlength=len(edges)) > 0, len(a))


def _relate_some(one: Edges, a: np.ndarray, two: Edges, b: np.ndarray, lines: bool) -> np.ndarray:
    """``relate`` for pairs of a line (or, if not `lines`, an area) and an area whose boxes meet; a row of flags, as in NAMES, for each."""
    n = len(a)
    out = dict.fromkeys(NAMES, np.zeros(n, bool))
    of, middles, normals, at, meet = _pieces_of(one, a, two, b)
    has = lambda flags, own: _any(own, flags, n)
    within, outside = has(at == 1, of), has(at == -1, of)
    if lines:
        out |= {"within": within & ~outside, "crosses": within & outside, "touches": ~within & (meet | has(at == 0, of))}
        out["disjoint"] = ~within & ~out["touches"]
    else:
        of_two, _, _, back, _ = _pieces_of(two, b, one, a)
        run = at == 0
        sides = []
        for shapes, g in ((one, a), (two, b)):
            row, other = _crossed(of[run], shapes.start[g], shapes.count[g])
            sides.append(_inside_many(middles[run] + SIDE * normals[run], row, shapes.edges[other]))
        same, opposite = has(sides[0] == sides[1], of[run]), has(sides[0] != sides[1], of[run])
        back_in, back_out = has(back == 1, of_two), has(back == -1, of_two)
        interiors = within | back_in | same
        out |= {"contains": interiors & ~(back_out | within | opposite), "within": interiors & ~(outside | back_in | opposite)}
        out |= {"overlaps": interiors & ~out["contains"] & ~out["within"], "touches": ~interiors & meet, "disjoint": ~interiors & ~meet, "equals": out["contains"] & out["within"]}
    return np.stack([out[k] for k in NAMES], axis=1)


def relate_many(one: pa.Array, two: pa.Array) -> pa.Array:
    """``relate`` for each row of two arrays of geometries, null where either is null. Areas and lines against areas are compared many pairs at a
    time; pairs of other kinds, or with very many edges, one by one."""
    a, b = Edges(one), Edges(two)
    known = (a.dim >= 0) & (b.dim >= 0)
    flags = np.zeros((len(one), len(NAMES)), bool)
    apart = known & ((a.low > b.high + EPS) | (b.low > a.high + EPS)).any(axis=1)
    flags[apart, NAMES.index("disjoint")] = True
    cost = (a.count + b.count) * np.maximum(a.count, b.count)
    near = known & ~apart
    many = near & (np.maximum(a.dim, b.dim) == 2) & (np.minimum(a.dim, b.dim) >= 1) & (cost <= _CHUNK)
    turned = [NAMES.index(k) for k in _TURNED]
    for lines, back, rows in ((False, False, a.dim == b.dim), (True, False, a.dim < b.dim), (True, True, a.dim > b.dim)):
        rows = np.flatnonzero(many & rows)
        for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(cost[rows]) // _CHUNK)) + 1):
            if len(some):
                flags[some] = _relate_some(b, some, a, some, lines)[:, turned] if back else _relate_some(a, some, b, some, lines)
    rest = np.flatnonzero(near & ~many)
    if len(rest):
        shapes = [[Shape(k, p) for k, p in zip(x.field("kind").to_pylist(), parts_of(x), strict=True)] for x in (one.take(pa.array(rest)), two.take(pa.array(rest)))]
        flags[rest] = [[bool(f[k]) for k in NAMES] for f in map(relate, *shapes)]
    return pa.StructArray.from_arrays([pa.array(c) for c in flags.T], names=NAMES, mask=pa.array(~known))


#: The relation of the second geometry to the first, in the order of NAMES.
_TURNED = [{"contains": "within", "within": "contains"}.get(k, k) for k in NAMES]


def turned(facts: Column) -> Column:
    """The facts of the second geometry and the first."""
    return F.struct(*[facts[old].alias(name) for name, old in zip(NAMES, _TURNED, strict=True)])


def relations(one: Column, two: Column) -> Column:
    """A struct of the relations (see NAMES) of two geometries, null if either is null; in Arrow batches."""

    @F.arrow_udf(FACTS)
    def facts(a: pa.Array, b: pa.Array) -> pa.Array:
        return relate_many(a, b)

    return facts(one, two)
