"""Predicates between polygons given as closed rings, array<struct<x, y>>. All are Columns.

Boundaries are compared within a tolerance; touching rings share boundary points but no interior.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.geo import in_ring, rings_cross

EPS = 1e-9


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bounds_meet(one: Column, two: Column, eps: float = EPS) -> Column:
    a, b = bounds(one), bounds(two)
    return (a["x0"] <= b["x1"] + eps) & (b["x0"] <= a["x1"] + eps) & (a["y0"] <= b["y1"] + eps) & (b["y0"] <= a["y1"] + eps)


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))


def on_boundary(p: Column, ring: Column, eps: float = EPS) -> Column:
    """Whether the point lies on an edge of the ring."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        inside = (p["x"] >= F.least(a["x"], b["x"]) - eps) & (p["x"] <= F.greatest(a["x"], b["x"]) + eps) & (p["y"] >= F.least(a["y"], b["y"]) - eps) & (p["y"] <= F.greatest(a["y"], b["y"]) + eps)
        return (F.abs(cross) <= eps) & inside

    return F.exists(_edges(ring), on)


def strictly_in(p: Column, ring: Column) -> Column:
    return in_ring(p["x"], p["y"], ring) & ~on_boundary(p, ring)


def _probes(ring: Column) -> Column:
    """Corners, edge middles and the mean of the corners."""
    corners = F.slice(ring, 1, F.size(ring) - 1)
    middles = F.transform(_edges(ring), lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y")))
    n = F.size(corners)
    centre = F.struct((F.aggregate(corners, F.lit(0.0), lambda s, p: s + p["x"]) / n).alias("x"), (F.aggregate(corners, F.lit(0.0), lambda s, p: s + p["y"]) / n).alias("y"))
    return F.concat(corners, middles, F.array(centre))


def interiors_meet(one: Column, two: Column) -> Column:
    """Edges cross properly, or a probe of one lies strictly inside the other (exact for convex rings)."""
    return rings_cross(one, two) | F.exists(_probes(one), lambda p: strictly_in(p, two)) | F.exists(_probes(two), lambda p: strictly_in(p, one))


def disjoint(one: Column, two: Column) -> Column:
    touching = F.exists(one, lambda p: on_boundary(p, two)) | F.exists(two, lambda p: on_boundary(p, one))
    return ~bounds_meet(one, two) | ~(interiors_meet(one, two) | touching)


def touches(one: Column, two: Column) -> Column:
    return bounds_meet(one, two) & ~interiors_meet(one, two) & ~disjoint(one, two)


def contains(one: Column, two: Column) -> Column:
    """Every part of the boundary of two is in or on one, which may be concave.

    Where no edges cross properly, an edge of two can leave one only at a corner of one that lies on it; the edge is cut
    there, and the middle of every piece is tested.
    """
    inside = lambda p: in_ring(p["x"], p["y"], one) | on_boundary(p, one)

    def whole(e: Column) -> Column:
        a, b = e["a"], e["b"]
        long = F.abs(b["x"] - a["x"]) >= F.abs(b["y"] - a["y"])
        on = F.filter(one, lambda v: on_boundary(v, F.array(a, b)))
        share = F.transform(on, lambda v: F.when(long, (v["x"] - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))).otherwise((v["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(share))))
        middles = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: (F.get(cuts, i - 1) + F.get(cuts, i)) / 2)
        return F.forall(middles, lambda t: inside(F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))))

    return ~rings_cross(one, two) & F.forall(two, inside) & F.forall(_edges(two), whole)


def centroid(ring: Column) -> Column:
    """The centre of the area of a closed ring, struct<x, y>; null if it has no area."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, e: Column) -> Column:
        p, q = e["a"], e["b"]
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (p["x"] + q["x"]) * cross).alias("x"), (s["y"] + (p["y"] + q["y"]) * cross).alias("y"))

    total = F.aggregate(_edges(ring), zero, step)
    area = F.nullif(3 * total["a"], F.lit(0.0))
    return F.when(area.isNotNull(), F.struct((total["x"] / area).alias("x"), (total["y"] / area).alias("y")))


def contains_centroid(one: Column, two: Column) -> Column:
    """The looser containment of the data: the centroid of two lies inside one."""
    return F.coalesce(strictly_in(centroid(two), one), F.lit(False))


def line_crosses(line: Column, ring: Column) -> Column:
    """A line (array of points) has points strictly inside and outside the ring: it crosses an edge properly, or its own
    points lie on both sides."""
    out = lambda p: ~in_ring(p["x"], p["y"], ring) & ~on_boundary(p, ring)
    return rings_cross(line, ring) | (F.exists(line, out) & F.exists(line, lambda p: strictly_in(p, ring)))


def n_points(rings: Column) -> Column:
    """Number of vertices of an array of rings."""
    return F.size(F.flatten(rings))
