"""Geometries with holes and several parts, and their text and binary forms.

A geometry is a struct (kind, parts): kind is the upper-case name of its type, parts an array of parts, each an array of rings, each an
array of points (x, y). A point is a part of one ring of one point, a line a part of one ring, a polygon a part of its outer ring and its holes.
Text is read and written by built-in functions; the binary form by Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.let import let

#: The types, in the order of their codes in the binary form; names as in GeoJSON.
KINDS = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"]
PARTS = "array<array<array<struct<x:double,y:double>>>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_POINT))))])


def _points(a: Column) -> Column:
    return F.transform(a, lambda p: F.struct(F.get(p, 0).cast("double").alias("x"), F.get(p, 1).cast("double").alias("y")))


def _nested(kind: Column, at: Callable[[int], Column]) -> Column:
    """The geometry of a kind from coordinates; at(depth) gives them as arrays nested so deep, coordinates included."""
    rings = lambda a: F.transform(a, _points)
    lone = lambda a: F.filter(F.array(a), lambda x: F.size(x) > 0)
    parts = {
        "Point": F.transform(lone(at(1)), lambda p: F.array(_points(F.array(p)))),
        "LineString": F.transform(lone(at(2)), lambda r: F.array(_points(r))),
        "Polygon": F.transform(lone(at(3)), rings),
        "MultiPoint": F.transform(at(2), lambda p: F.array(_points(F.array(p)))),
        "MultiLineString": F.transform(at(3), lambda r: F.array(_points(r))),
        "MultiPolygon": F.transform(at(4), rings),
    }
    whole = {"Point": at(1), "LineString": at(2), "Polygon": at(3)}  # a lone part that is null leaves an empty array
    made = F.lit(None).cast(PARTS)
    for name in KINDS:
        found = parts[name].cast(PARTS)
        made = F.when(kind == name.upper(), F.when(whole[name].isNotNull(), found) if name in whole else found).otherwise(made)
    return let(made, lambda p: F.when(p.isNotNull(), F.struct(kind.alias("kind"), p.alias("parts"))))


def from_geojson(text: Column) -> Column:
    """A geometry from GeoJSON, or from a bare [lon, lat]; null for other text and for collections."""

    def read(v: Column) -> Column:
        bare = F.try_variant_get(v, "$", "array<double>")
        kind = F.when(bare.isNotNull(), "POINT").otherwise(F.upper(F.try_variant_get(v, "$.type", "string")))

        def at(depth: int) -> Column:
            found = F.try_variant_get(v, "$.coordinates", "array<" * depth + "double" + ">" * depth)
            return F.coalesce(bare, found) if depth == 1 else found

        return let(kind, lambda k: _nested(k, at))

    return let(F.try_parse_json(text), read)


def from_wkt(text: Column) -> Column:
    """A geometry from well-known text, with or without SRID, Z and M (which are dropped); null for other text and for collections."""
    upper = F.upper(F.trim(F.regexp_replace(text, r"^\s*(?i:SRID=\d+;)?", "")))

    def read(t: Column) -> Column:
        kind = F.regexp_extract(t, r"^((?:MULTI)?(?:POINT|LINESTRING|POLYGON))\s*(?:ZM|Z|M)?\s*(?:EMPTY|\()", 1)
        body = F.regexp_extract(t, r"(?s)(\(.*\))\s*$", 1)
        body = F.when(t.startswith("MULTIPOINT"), F.concat(F.lit("("), F.translate(body, "()", ""), F.lit(")"))).otherwise(body)
        listed = F.translate(F.regexp_replace(body, rf"{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})*", r'["$1","$2"]'), "()", "[]")
        listed = F.when(t.endswith("EMPTY"), "[]").otherwise(listed)

        def at(listed: Column) -> Callable[[int], Column]:
            # the parentheses of a point hold its one position
            def kept(depth: int) -> Column:
                found = F.from_json(listed, "array<" * max(depth, 2) + "string" + ">" * max(depth, 2))
                return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.get(found, 0)) if depth == 1 else found

            return kept

        return let(F.struct(kind.alias("kind"), listed.alias("listed")), lambda s: _nested(s["kind"], at(s["listed"])))

    return let(upper, read)


def _number(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def _text(g: Column, between: str, opening: str, closing: str, bracket_points: bool) -> Column:
    """Coordinates with brackets; the numbers of a position are set apart by `between`."""
    wrap = lambda c: F.concat(F.lit(opening), c, F.lit(closing))
    position = lambda p: F.concat(_number(p["x"]), F.lit(between), _number(p["y"]))
    point = (lambda p: wrap(position(p))) if bracket_points else position
    join = lambda a: F.array_join(a, "," if bracket_points else ", ")
    ring = lambda r: wrap(join(F.transform(r, point)))
    part = lambda rs: wrap(join(F.transform(rs, ring)))
    parts, first = g["parts"], F.get(g["parts"], 0)
    single = {"POINT": point(F.get(F.get(first, 0), 0)), "LINESTRING": ring(F.get(first, 0)), "POLYGON": part(first)}
    if not bracket_points:
        single["POINT"] = wrap(single["POINT"])
    several = {
        "MULTIPOINT": wrap(join(F.transform(parts, lambda rs: point(F.get(F.get(rs, 0), 0))))),
        "MULTILINESTRING": wrap(join(F.transform(parts, lambda rs: ring(F.get(rs, 0))))),
        "MULTIPOLYGON": wrap(join(F.transform(parts, part))),
    }
    out = F.lit(None).cast("string")
    for kind, made in (single | several).items():
        out = F.when(g["kind"] == kind, made).otherwise(out)
    return out


def to_wkt(g: Column) -> Column:
    return let(g, lambda g: F.when(F.size(g["parts"]) == 0, F.concat(g["kind"], F.lit(" EMPTY"))).otherwise(F.concat(g["kind"], F.lit(" "), _text(g, " ", "(", ")", False))))


def to_geojson(g: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kind in KINDS for x in (kind.upper(), kind)])

    def write(g: Column) -> Column:
        body = F.when(F.size(g["parts"]) == 0, "[]").otherwise(_text(g, ",", "[", "]", True))
        return F.concat(F.lit('{"type":"'), names[g["kind"]], F.lit('","coordinates":'), body, F.lit("}"))

    return let(g, write)


class _Reader:
    """One geometry of the binary form, of either byte order, with or without SRID, Z and M."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def head(self) -> tuple[str, int, int]:
        order = "<" if self.data[self.at] else ">"
        code = struct.unpack_from(order + "I", self.data, self.at + 1)[0]
        self.at += 5 + 4 * bool(code & 0x20000000)
        iso = (code & 0xFFFF) // 1000
        return order, (code & 0xFFFF) % 1000, 2 + (bool(code & 0x80000000) or iso in (1, 3)) + (bool(code & 0x40000000) or iso in (2, 3))

    def count(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(order + "I", self.data, self.at - 4)[0]

    def points(self, order: str, width: int, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, order + "f8", n * width, self.at).reshape(n, width)[:, :2].astype(float)
        self.at += 8 * n * width
        return out

    def rings(self) -> tuple[int, list]:
        """The code and the parts of a geometry."""
        order, code, width = self.head()
        if code == 1:
            p = self.points(order, width, 1)
            return code, [] if np.isnan(p).any() else [[p]]
        if code == 2:
            line = self.points(order, width, self.count(order))
            return code, [[line]] if len(line) else []
        if code == 3:
            part = [self.points(order, width, self.count(order)) for _ in range(self.count(order))]
            return code, [part] if part else []
        if code in (4, 5, 6):
            return code, [p for _ in range(self.count(order)) for p in self.rings()[1]]
        raise ValueError(f"geometry code {code}")


def nested_arrays(kinds: list[str | None], parts: list[list]) -> pa.Array:
    """Geometries from lists of parts of rings of (n, 2) arrays."""
    rings = [r for g in parts for p in g for r in p]
    ends = lambda xs: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs], dtype=np.int64)]).astype(np.int32))
    flat = np.concatenate([*rings, np.zeros((0, 2))])
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_POINT))
    held = pa.ListArray.from_arrays(ends(rings), points)
    held = pa.ListArray.from_arrays(ends([p for g in parts for p in g]), held)
    held = pa.ListArray.from_arrays(ends(parts), held)
    missing = pa.array([k is None for k in kinds], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), held], fields=list(_ARROW), mask=missing)


def parts_of(geometries: pa.Array) -> list[list[list[np.ndarray]] | None]:
    """For each geometry its parts as lists of rings of (n, 2) arrays; null for null."""
    parts = geometries.field("parts")
    rings = parts.flatten()
    level = lambda a: np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    by_part, points = rings.flatten(), rings.flatten().flatten()
    xy = np.stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)], axis=1)
    ends, ring_ends, point_ends = level(parts), level(rings), level(by_part)
    known = geometries.is_valid().to_numpy(zero_copy_only=False) & parts.is_valid().to_numpy(zero_copy_only=False)
    return [
        [[xy[point_ends[r] : point_ends[r + 1]] for r in range(ring_ends[p], ring_ends[p + 1])] for p in range(ends[i], ends[i + 1])] if known[i] else None
        for i in range(len(geometries))
    ]


def from_wkb(data: Column) -> Column:
    """A geometry from well-known binary (also with SRID, Z, M); null for collections and broken bytes."""

    @F.arrow_udf(GEOMETRY)
    def read(values: pa.Array) -> pa.Array:
        kinds, parts = [], []
        for raw in values.to_pylist():
            try:
                code, found = _Reader(raw).rings()
                kinds.append(KINDS[code - 1].upper())
                parts.append(found)
            except (ValueError, TypeError, IndexError, struct.error):
                kinds.append(None)
                parts.append([])
        return nested_arrays(kinds, parts)

    return read(data)


def wkb_of(kind: str, parts: list[list[np.ndarray]]) -> bytes:
    """Little-endian well-known binary."""
    code = [k.upper() for k in KINDS].index(kind) + 1
    line = lambda r: struct.pack("<I", len(r)) + r.astype("<f8").tobytes()

    def simple(c: int, part: list[np.ndarray]) -> bytes:
        head = struct.pack("<BI", 1, c)
        if c == 1:
            return head + (part[0].astype("<f8").tobytes() if part else struct.pack("<2d", np.nan, np.nan))
        if c == 2:
            return head + (line(part[0]) if part else struct.pack("<I", 0))
        return head + struct.pack("<I", len(part)) + b"".join(map(line, part))

    if code <= 3:
        return simple(code, parts[0] if parts else [])
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(simple(code - 3, p) for p in parts)


def to_wkb(g: Column) -> Column:
    @F.arrow_udf("binary")
    def write(values: pa.Array) -> pa.Array:
        kinds = values.field("kind").to_pylist()
        return pa.array([None if p is None else wkb_of(k, p) for k, p in zip(kinds, parts_of(values), strict=True)], pa.binary())

    return write(g)


def n_points(g: Column) -> Column:
    """The number of positions of all rings."""
    return F.size(F.flatten(F.flatten(g["parts"])))


def bounds(g: Column) -> Column:
    """struct<x0, y0, x1, y1>; null for a geometry without points."""

    def box(axes: Column) -> Column:
        x, y = axes["x"], axes["y"]
        made = F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
        return F.when(F.size(x) > 0, made)

    axes = lambda points: F.struct(F.transform(points, lambda p: p["x"]).alias("x"), F.transform(points, lambda p: p["y"]).alias("y"))
    return let(let(F.flatten(F.flatten(g["parts"])), axes), box)


def centroid(g: Column) -> Column:
    """The centre of the area of a polygon with its holes, or of several; null if it has no area. Rings may run either way."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, t, k: F.struct((s["a"] + k * t["a"]).alias("a"), (s["x"] + k * t["x"]).alias("x"), (s["y"] + k * t["y"]).alias("y"))

    def of_ring(ring: Column, sign: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            p, q = F.get(ring, i - 1), F.get(ring, i)
            cross = p["x"] * q["y"] - q["x"] * p["y"]
            return F.struct((s["a"] + cross).alias("a"), (s["x"] + (p["x"] + q["x"]) * cross).alias("x"), (s["y"] + (p["y"] + q["y"]) * cross).alias("y"))

        total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), zero, step)
        return let(total, lambda t: add(zero, t, F.when(t["a"] < 0, -sign).otherwise(sign)))

    weighed = F.transform(g["parts"], lambda rs: F.transform(rs, lambda r, i: of_ring(r, F.when(i == 0, 1.0).otherwise(-1.0))))
    total = F.aggregate(F.flatten(weighed), zero, lambda s, t: add(s, t, F.lit(1.0)))
    return let(total, lambda t: F.when(t["a"] != 0, F.struct((t["x"] / (3 * t["a"])).alias("x"), (t["y"] / (3 * t["a"])).alias("y"))))


def holds_point(g: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of a polygon or several; a point on an edge may fall on either side."""

    def crossings(ring: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.get(ring, i - 1), F.get(ring, i)
            at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
            return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))

        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), crosses))

    return F.aggregate(F.transform(F.flatten(g["parts"]), crossings), F.lit(0), lambda s, n: s + n) % 2 == 1
