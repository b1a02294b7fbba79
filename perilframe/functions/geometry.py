"""Geometry as column expressions.

A ring is an array of struct<x, y>, closed or not. A polygon is an array of rings, those of all its parts and holes
in any order and direction: inside is what an odd number of rings hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def square(cx: Column, cy: Column, half: Column) -> Column:
    corner = lambda a, b: F.struct((cx + a * half).alias("x"), (cy + b * half).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def sides(ring: Column) -> Column:
    """(x1, y1, x2, y2) of each side, the closing one included."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(sides(ring), lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """The centroid by area; the mean of the corners of a ring without area."""
    a = signed_area(ring)
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    x = _sum(F.transform(sides(ring), lambda s: (s["x1"] + s["x2"]) * cross(s))) / (6 * a)
    y = _sum(F.transform(sides(ring), lambda s: (s["y1"] + s["y2"]) * cross(s))) / (6 * a)
    mean = lambda c: _sum(F.transform(ring, lambda p: p[c])) / F.size(ring)
    return F.struct(F.when(a != 0, x).otherwise(mean("x")).alias("x"), F.when(a != 0, y).otherwise(mean("y")).alias("y"))


def odd_crossings(sides: Column, x: Column, y: Column) -> Column:
    """Inside by the even-odd rule."""
    crosses = lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])
    return F.size(F.filter(sides, crosses)) % 2 == 1


def nearest_side(sides: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest of the sides."""

    def one(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(x - (s["x1"] + t * dx), y - (s["y1"] + t * dy))

    return F.array_min(F.transform(sides, one))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    return odd_crossings(sides(ring), x, y)


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest side."""
    return nearest_side(sides(ring), x, y)


def box(ring: Column) -> Column:
    pick = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(pick(F.array_min, "x").alias("x0"), pick(F.array_min, "y").alias("y0"), pick(F.array_max, "x").alias("x1"), pick(F.array_max, "y").alias("y1"))


def rings_of(df: DataFrame) -> Column:
    """The polygon of a table's rows: its ``rings``, or its ``ring`` alone; null without any."""
    return F.col("rings") if "rings" in df.columns else F.when(F.col("ring").isNotNull(), F.array("ring"))


def all_sides(rings: Column) -> Column:
    return F.flatten(F.transform(rings, sides))


def polygon_contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings."""
    return odd_crossings(all_sides(rings), x, y)


def polygon_distance(rings: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest side of any ring."""
    return nearest_side(all_sides(rings), x, y)


def polygon_box(rings: Column) -> Column:
    return box(F.flatten(rings))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measures(rings: Column) -> Column:
    """(area, x, y, sign) of each ring: its centroid, and 1 if it bounds its inside, -1 if it is a hole, by how many others hold the middle of its first side.

    A ring's sides are listed once, and their sums are taken in one pass.
    """

    def sums(s: Column) -> Column:
        def add(m: Column, s: Column) -> Column:
            return _let(s["x1"] * s["y2"] - s["x2"] * s["y1"], lambda c: F.struct((m["c"] + c).alias("c"), (m["x"] + (s["x1"] + s["x2"]) * c).alias("x"), (m["y"] + (s["y1"] + s["y2"]) * c).alias("y")))

        return F.aggregate(s, F.struct(*(F.lit(0.0).alias(n) for n in ("c", "x", "y"))), add)

    def one(all_: Column, own: Column, k: Column) -> Column:
        first, second = F.get(own["ring"], F.lit(0)), F.get(own["ring"], F.lit(1))
        x, y = (first["x"] + second["x"]) / 2, (first["y"] + second["y"]) / 2
        around = F.size(F.filter(all_, lambda q, i: (i != k) & odd_crossings(q["sides"], x, y)))
        mean = lambda c: _sum(F.transform(own["ring"], lambda p: p[c])) / F.size(own["ring"])
        at = lambda m, c: F.when(m["c"] != 0, m[c] / (6 * (m["c"] / 2))).otherwise(mean(c)).alias(c)
        return _let(sums(own["sides"]), lambda m: F.struct((F.abs(m["c"]) / 2).alias("area"), at(m, "x"), at(m, "y"), F.when(around % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))

    return _let(F.transform(rings, lambda r: F.struct(r.alias("ring"), sides(r).alias("sides"))), lambda all_: F.transform(all_, lambda own, k: one(all_, own, k)))


def _total(measures: Column, value: Callable[[Column], Column]) -> Column:
    return _sum(F.transform(measures, lambda m: m["sign"] * m["area"] * value(m)))


def polygon_area(rings: Column) -> Column:
    return _total(_measures(rings), lambda m: F.lit(1.0))


def polygon_centroid(rings: Column) -> Column:
    """The centroid by area, holes counted off; of rings that have none together, the first one's."""

    def whole(m: Column, total: Column) -> Column:
        first = F.get(m, F.lit(0))
        at = lambda c: F.when((F.size(m) == 1) | (total == 0), first[c]).otherwise(_total(m, lambda r: F.when(r["area"] > 0, r[c]).otherwise(0.0)) / total).alias(c)
        return F.struct(at("x"), at("y"))

    return _let(_measures(rings), lambda m: _let(_total(m, lambda r: F.lit(1.0)), lambda total: whole(m, total)))


def outline_distance(a: Column, a_sides: Column, b: Column, b_sides: Column) -> Column:
    """Between two polygons, given as the corners and the sides of all their rings: 0 if they cross or a corner of one is inside the other, else the least corner-to-side distance."""
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    apart = lambda s, t: turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]) * turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]) < 0
    crossing = F.exists(a_sides, lambda s: F.exists(b_sides, lambda t: apart(s, t) & apart(t, s)))
    near = lambda p, q: F.array_min(F.transform(p, lambda c: F.when(odd_crossings(q, c["x"], c["y"]), 0.0).otherwise(nearest_side(q, c["x"], c["y"]))))
    return F.when(crossing, 0.0).otherwise(F.least(near(a, b_sides), near(b, a_sides)))


def ring_distance(a: Column, b: Column) -> Column:
    """Between two rings, as ``outline_distance``."""
    return outline_distance(a, sides(a), b, sides(b))


# --- UTM, by the series of Krueger --------------------------------------------------------------

_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int = 17) -> tuple[Column, Column]:
    """Easting and northing (m), north of the equator."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    e = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)), F.lit(0.0))
    return 500_000 + _K0 * _RECT * east, _K0 * _RECT * north


def from_utm(x: Column, y: Column, zone: int = 17) -> tuple[Column, Column]:
    """Longitude and latitude (degrees)."""
    xi, eta = y / (_K0 * _RECT), (x - 500_000) / (_K0 * _RECT)
    xi2 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA)), F.lit(0.0))
    eta2 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA)), F.lit(0.0))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA)), F.lit(0.0))
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(phi)
