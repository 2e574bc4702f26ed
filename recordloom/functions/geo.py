"""Coordinates as column arithmetic: projection to WGS84, centroids, distances."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.scalars import ColumnLike, _col, let

# Reference system names accepted beside EPSG codes.
SYSTEM_NAMES = {"SWEREF99": 3006, "RT90": 3021, "WGS84": 4326}

# Kilometre to mile factor and radius limits of the distance filter.
MILES_PER_KM = 0.621371
MIN_MILES = 1.0
MAX_KM = 30.0

EARTH_RADIUS_KM = 6371.0088


@dataclass(frozen=True)
class Projection:
    """Transverse Mercator parameters on the GRS80 ellipsoid (published survey values)."""

    meridian: float
    scale: float
    false_northing: float
    false_easting: float


PROJECTIONS = {
    3006: Projection(15.0, 0.9996, 0.0, 500000.0),
    3021: Projection(15.0 + 48 / 60 + 22.624306 / 3600, 1.00000561024, -667.711, 1500064.274),
}

_AXIS = 6378137.0
_FLATTENING = 1 / 298.257222101


def epsg_code(name: str | int | None) -> int:
    """Code of a reference system name, an ``EPSG:n`` text or a code; 3006 when not given."""
    if name is None:
        return 3006
    text = str(name).upper()
    code = SYSTEM_NAMES.get(text) or int(text.removeprefix("EPSG:"))
    if code != 4326 and code not in PROJECTIONS:
        raise ValueError(f"unsupported reference system: {name}")
    return code


def series(code: int) -> dict[str, float]:
    """Coefficients of the inverse Gauss-Kruger series for one projection."""
    p = PROJECTIONS[code]
    e2 = _FLATTENING * (2 - _FLATTENING)
    n = _FLATTENING / (2 - _FLATTENING)
    return {
        "meridian": math.radians(p.meridian),
        "unit": p.scale * _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "northing": p.false_northing,
        "easting": p.false_easting,
        "d1": n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        "d2": n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        "d3": 17 * n**3 / 480 - 37 * n**4 / 840,
        "d4": 4397 * n**4 / 161280,
        "a": e2 + e2**2 + e2**3 + e2**4,
        "b": -(7 * e2**2 + 17 * e2**3 + 30 * e2**4) / 6,
        "c": (224 * e2**3 + 889 * e2**4) / 120,
        "d": -4279 * e2**4 / 1260,
    }


def to_wgs84(x: ColumnLike, y: ColumnLike, epsg: str | int | None = None) -> tuple[Column, Column]:
    """Longitude and latitude of an easting ``x`` and a northing ``y``."""
    code = epsg_code(epsg)
    east, north = _col(x), _col(y)
    if code == 4326:
        return east, north
    k = series(code)
    xi = (north - k["northing"]) / k["unit"]
    eta = (east - k["easting"]) / k["unit"]
    terms = [(2 * i, k[f"d{i}"]) for i in (1, 2, 3, 4)]
    xi_p, eta_p = xi, eta
    for m, coefficient in terms:
        xi_p = xi_p - coefficient * F.sin(m * xi) * F.cosh(m * eta)
        eta_p = eta_p - coefficient * F.cos(m * xi) * F.sinh(m * eta)
    phi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lon = k["meridian"] + F.atan(F.sinh(eta_p) / F.cos(xi_p))
    sine2 = F.pow(F.sin(phi), 2)
    lat = phi + F.sin(phi) * F.cos(phi) * (k["a"] + sine2 * (k["b"] + sine2 * (k["c"] + sine2 * k["d"])))
    return F.degrees(lon), F.degrees(lat)


def to_wgs84_any(x: ColumnLike, y: ColumnLike, epsg: ColumnLike) -> tuple[Column, Column]:
    """As ``to_wgs84`` with the code in a column; null for an unknown code."""
    lon = lat = F.lit(None).cast("double")
    for code in (4326, *PROJECTIONS):
        one_lon, one_lat = to_wgs84(x, y, code)
        lon = F.when(_col(epsg) == code, one_lon).otherwise(lon)
        lat = F.when(_col(epsg) == code, one_lat).otherwise(lat)
    return lon, lat


def kilometres(lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike) -> Column:
    """Great-circle distance."""
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat = F.sin((a2 - a1) / 2)
    half_lon = F.sin((F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2)
    h = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_RING = r"(?s)<(?:\w+:)?(exterior|interior|outerBoundaryIs|innerBoundaryIs)\b[^>]*>(.*?)</(?:\w+:)?\1>"
_MEMBER = r"(?s)<(?:\w+:)?(LinearRing|LineStringSegment|LineString|Point)\b[^>]*>(.*?)</(?:\w+:)?\1>"
_COORDINATES = r"(?s)<(?:\w+:)?(?:coordinates|posList|pos)\b[^>]*>([^<]*)<"


def _numbers(body: Column) -> Column:
    """Numbers of all coordinate elements in a piece of markup, in order."""
    text = F.array_join(F.regexp_extract_all(body, F.lit(_COORDINATES), F.lit(1)), " ")
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda n: n.try_cast("double"))


def geometry_parts(markup: ColumnLike) -> dict[str, Column]:
    """Code, kind and parts (numbers, hole) of a geometry written as markup.

    A part is a ring, a line or a point with all its coordinate elements; markup without such members is one part.
    """
    text = _col(markup)
    code = F.regexp_extract(text, r'srsName="[^"]*?(\d+)"', 1).try_cast("int")
    kind = (
        F.when(text.rlike(r"<(\w+:)?(Polygon|Surface|MultiSurface)"), "polygon")
        .when(text.rlike(r"<(\w+:)?(LineString|Curve)"), "line")
        .otherwise("points")
    )

    def part(body: Column, hole: Column) -> Column:
        return F.struct(_numbers(body).alias("numbers"), hole.alias("hole"))

    rings = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(_RING), F.lit(1)).alias("role"),
            F.regexp_extract_all(text, F.lit(_RING), F.lit(2)).alias("body")),
        lambda r: part(r["body"], r["role"].startswith("i")))
    members = F.transform(F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(2)), lambda body: part(body, F.lit(False)))
    whole = F.array(part(text, F.lit(False)))
    parts = F.when(F.size(rings) > 0, rings).when(F.size(members) > 0, members).otherwise(whole)
    # three numbers a point are not read
    flat = F.when(~text.rlike(r'srsDimension="[^2]"'), parts)
    return {"epsg": code, "kind": kind, "parts": flat}


def centroid(parts: ColumnLike, kind: ColumnLike) -> tuple[Column, Column]:
    """Centroid over all parts: mean of points, length-weighted lines, area-weighted rings less their holes.

    ``parts`` has numbers (``x, y, x, y, ...``) and hole.  Rings without area fall back to their outlines, lines without length to
    their points.
    """
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)

    def cross(s: Column) -> Column:
        return s["x1"] * s["y2"] - s["x2"] * s["y1"]

    def length(s: Column) -> Column:
        return F.sqrt(F.pow(s["x2"] - s["x1"], 2) + F.pow(s["y2"] - s["y1"], 2))

    def split(part: Column) -> Column:
        return F.struct(
            F.filter(part["numbers"], lambda value, place: place % 2 == 0).alias("xs"),
            F.filter(part["numbers"], lambda value, place: place % 2 == 1).alias("ys"),
            part["hole"].alias("hole"),
        )

    def with_segments(axes: Column) -> Column:
        n = F.least(F.size(axes["xs"]), F.size(axes["ys"]))
        segments = F.when(
            n > 1,
            F.transform(
                F.sequence(F.lit(1), n - 1),
                lambda i: F.struct(
                    F.get(axes["xs"], i - 1).alias("x1"), F.get(axes["ys"], i - 1).alias("y1"),
                    F.get(axes["xs"], i).alias("x2"), F.get(axes["ys"], i).alias("y2"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
        return F.struct(axes["xs"].alias("xs"), axes["ys"].alias("ys"), n.alias("n"), axes["hole"].alias("hole"), segments.alias("segments"))

    def with_sizes(shape: Column) -> Column:
        segments, turned = shape["segments"], total(F.transform(shape["segments"], cross)) / 2
        sign = F.signum(turned) * F.when(shape["hole"], -1.0).otherwise(1.0)

        def moment(first: str, second: str) -> Column:
            return sign * total(F.transform(segments, lambda s: (s[first] + s[second]) * cross(s))) / 6

        def along(first: str, second: str) -> Column:
            return total(F.transform(segments, lambda s: (s[first] + s[second]) / 2 * length(s)))

        return F.struct(
            (sign * turned).alias("area"), moment("x1", "x2").alias("area_x"), moment("y1", "y2").alias("area_y"),
            total(F.transform(segments, length)).alias("outline"), along("x1", "x2").alias("line_x"), along("y1", "y2").alias("line_y"),
            shape["n"].cast("double").alias("n"), total(shape["xs"]).alias("n_x"), total(shape["ys"]).alias("n_y"),
        )

    def centre(shapes: Column) -> Column:
        def over(name: str) -> Column:
            return total(F.transform(shapes, lambda s: s[name]))

        def pick(axis: str) -> Column:
            return (
                F.when((_col(kind) == "polygon") & (over("area") != 0), over(f"area_{axis}") / over("area"))
                .when(_col(kind).isin("polygon", "line") & (over("outline") != 0), over(f"line_{axis}") / over("outline"))
                .when(over("n") > 0, over(f"n_{axis}") / over("n"))
            )

        return F.struct(pick("x").alias("x"), pick("y").alias("y"))

    shapes = F.transform(_col(parts), lambda part: let(let(let(part, split), with_segments), with_sizes))
    point = let(shapes, centre)
    return point["x"], point["y"]
