"""Geographic expressions over longitude and latitude in degrees. All are Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V

RADIUS_KM = 6371.0
#: The sphere of the database function that measures on a mean-radius ellipsoid.
SPHERE_KM = 6371.00877


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS_KM, form: str = "atan2") -> Column:
    """Great-circle distance; the two forms differ in the last digits only."""
    p1, p2, dp, dl = F.radians(lat1), F.radians(lat2), F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    half = F.atan2(F.sqrt(a), F.sqrt(1 - a)) if form == "atan2" else F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.lit(2 * radius) * half


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing from the first point to the second, 0 to 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def planar_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Bearing on the plain lon/lat plane; 0 for equal points."""
    return F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360.0, F.lit(360.0))


def _word(index: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int") + 1)


def compass8(degrees: Column, rounding: str = "floor") -> Column:
    """One of eight directions; ties go up ("floor") or to the even sector ("half_even")."""
    sector = F.bround(degrees / 45) if rounding == "half_even" else F.floor((degrees + 22.5) / 45)
    return _word(F.pmod(sector, F.lit(8)), V.COMPASS_8)


def compass16(degrees: Column) -> Column:
    return _word(F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)), V.COMPASS_16)


def sign_direction(lon1: Column, lat1: Column, lon2: Column, lat2: Column, dead: float = 1.0) -> Column:
    """Direction by the signs of the differences, with a dead band; 邻近 if both lie in it."""
    ns = F.when(lat2 - lat1 > dead, "北").when(lat2 - lat1 < -dead, "南").otherwise("")
    ew = F.when(lon2 - lon1 > dead, "东").when(lon2 - lon1 < -dead, "西").otherwise("")
    both = F.concat(ew, ns)
    return F.when(both == "", "邻近").otherwise(both)


def sign_pair(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The direction of the first point from the second by signs alone, north or south first (北东); no difference counts as south or west."""
    return F.concat(F.when(lat1 > lat2, "北").otherwise("南"), F.when(lon1 > lon2, "东").otherwise("西"))


def stored_distance_fits(lon1: Column, lat1: Column, lon2: Column, lat2: Column, stored: Column, tolerance: float = 1.0) -> Column:
    """Whether a stored distance in kilometres is less than the tolerance off that on the sphere of the database."""
    return F.coalesce(F.abs(haversine_km(lon1, lat1, lon2, lat2, SPHERE_KM) - stored) < tolerance, F.lit(False))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float] = V.CHINA_BOX) -> Column:
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def deviation_grade(km: Column) -> Column:
    return F.when(km.isNull(), "not_found").when(km <= 10, "correct").when(km <= 50, "minor").otherwise("incorrect")


def compatible_directions(one: Column, two: Column) -> Column:
    """Whether two direction words go together: equal, in one set of words, or a main direction and one of its words."""
    sets = F.array(*[F.array(*map(F.lit, words)) for words in V.DIRECTION_ALIASES + V.PARTIAL_DIRECTIONS])
    mains = F.create_map(*[x for k, words in V.MAIN_DIRECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    together = F.exists(sets, lambda s: F.array_contains(s, one) & F.array_contains(s, two))
    of = lambda x, y: F.coalesce(F.array_contains(F.try_element_at(mains, x), y), F.lit(False))
    return F.coalesce((one == two) | together | of(one, two) | of(two, one), F.lit(False))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring array<struct<x, y>>; a point on an edge may fall on either side."""
    n = F.size(ring)
    edges = F.when(n >= 4, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        at = (b["x"] - a["x"]) * (lat - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.coalesce(((a["y"] > lat) != (b["y"] > lat)) & (lon < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring of an axis-aligned box."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def segments_cross(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether the open segments pq and rs cross properly."""
    side = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    return (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)


def rings_cross(one: Column, two: Column) -> Column:
    """Whether any two edges of the two vertex arrays cross properly."""
    edges = lambda ring: F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
    return F.exists(edges(one), lambda e: F.exists(edges(two), lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"])))
