"""Geometry as Column expressions: degrees in, metres or degrees out; nulls give null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres, and the largest snap offset.
RADIUS = 6_371_000.0
OFFSET_MAX = 65_535


def distance(lon1, lat1, lon2, lat2) -> Column:
    """Equirectangular distance in metres."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians(lat1 + lat2) / 2)
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * RADIUS


def offset_x(lon, lat, metres) -> Column:
    """Longitude ``metres`` to the east."""
    return lon + metres / distance(lon, lat, lon + 0.001, lat) * 0.001


def offset_y(lon, lat, metres) -> Column:
    """Latitude ``metres`` to the north."""
    return lat + metres / distance(lon, lat, lon, lat + 0.001) * 0.001


def box_around(lon, lat, metres) -> Column:
    """Box whose sides lie ``metres`` from the centre."""
    dx = metres / distance(lon, lat, lon + 0.1, lat) * 0.1
    dy = metres / distance(lon, lat, lon, lat + 0.1) * 0.1
    return F.struct((lon - dx).alias("left"), (lat - dy).alias("bottom"), (lon + dx).alias("right"), (lat + dy).alias("top"))


def in_box(lon, lat, box) -> Column:
    """Half-open: above the bottom up to the top, right of the left side up to the right one."""
    return (lat > box["bottom"]) & (lat <= box["top"]) & (lon > box["left"]) & (lon <= box["right"])


def center(box) -> Column:
    return F.struct(((box["left"] + box["right"]) / 2).alias("lon"), ((box["bottom"] + box["top"]) / 2).alias("lat"))


def box_union(a, b) -> Column:
    """The smallest box around two; one that is null does not count."""
    side = lambda pick, name: F.coalesce(pick(a[name], b[name]), a[name], b[name]).alias(name)
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(side(F.least, "left"), side(F.least, "bottom"), side(F.greatest, "right"), side(F.greatest, "top")))


def box_of(points: Column) -> Column:
    """The box of an array of points; null if it is empty."""
    every = lambda pick, name: pick(F.transform(points, lambda p: p[name]))
    return F.when(F.size(points) > 0, F.struct(every(F.array_min, "lon").alias("left"), every(F.array_min, "lat").alias("bottom"), every(F.array_max, "lon").alias("right"), every(F.array_max, "lat").alias("top")))


def position_along(lon1, lat1, lon2, lat2, share) -> Column:
    return F.struct((lon1 + (lon2 - lon1) * share).alias("lon"), (lat1 + (lat2 - lat1) * share).alias("lat"))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Angle with the meridian: 0 north, positive to the east, -180 to 180; a degree of longitude is as wide as at the first point."""
    return F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1))


def normalize_degrees(angle) -> Column:
    """[0, 360)."""
    return angle - F.floor(angle / 360) * 360


def normalize_signed(angle) -> Column:
    """(-180, 180], whole degrees, cut towards zero."""
    a = normalize_degrees(angle)
    return F.when(a > 180, a - 360).otherwise(a).cast("int")


def turn_angle(lon1, lat1, lon2, lat2, lon3, lat3) -> Column:
    """Angle at the second point from the first to the third against the clock, [0, 360), in the plane of degrees; null where points coincide."""
    x1, y1, x3, y3 = lon1 - lon2, lat1 - lat2, lon3 - lon2, lat3 - lat2
    apart = ((x1 != 0) | (y1 != 0)) & ((x3 != 0) | (y3 != 0))
    return F.when(apart, normalize_degrees(F.degrees(F.atan2(x1 * y3 - y1 * x3, x1 * x3 + y1 * y3))))


#: Where each kind of turn begins, in degrees as :func:`turn_angle` measures them; straight on is 180.
RELATIVE = ((355, "TurnBack"), (335, "SharpLeft"), (205, "Left"), (190, "SlightlyLeft"), (170, "StraightOn"), (155, "SlightlyRight"), (25, "Right"), (5, "SharpRight"), (0, "TurnBack"))


def relative_direction(angle) -> Column:
    """Name of a turn of ``angle`` degrees, [0, 360)."""
    return F.coalesce(*[F.when(angle >= least, name) for least, name in RELATIVE])


def compass(lon1, lat1, lon2, lat2) -> Column:
    """Nearest of the eight compass points, as degrees 0, 45, ..., 315 from north."""
    return F.pmod(F.round(normalize_degrees(bearing(lon1, lat1, lon2, lat2)) / 45), F.lit(8)).cast("int") * 45


def intersection(ax, ay, bx, by, cx, cy, dx, dy, segments: bool = True) -> Column:
    """Point where the lines a-b and c-d meet; null if parallel or, for ``segments``, outside either."""
    a1, b1 = by - ay, ax - bx
    a2, b2 = dy - cy, cx - dx
    c1, c2 = a1 * ax + b1 * ay, a2 * cx + b2 * cy
    det = a1 * b2 - a2 * b1
    x, y = (b2 * c1 - b1 * c2) / det, (a1 * c2 - a2 * c1) / det
    ok = F.abs(det) > 1e-10
    if segments:
        inside = lambda v, p, q: (v >= F.least(p, q) - 1e-12) & (v <= F.greatest(p, q) + 1e-12)
        ok = ok & inside(x, ax, bx) & inside(y, ay, by) & inside(x, cx, dx) & inside(y, cy, dy)
    return F.when(ok, F.struct(x.alias("lon"), y.alias("lat")))


def project(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Foot of the perpendicular on the segment: lon, lat, share (0 to 1 along it) and metres; null outside the segment."""
    k = F.cos(F.radians((lat1 + lat2) / 2))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    square = dx * dx + dy * dy
    t = ((lon - lon1) * k * dx + (lat - lat1) * dy) / square
    x, y = lon1 + (lon2 - lon1) * t, lat1 + (lat2 - lat1) * t
    return F.when((square > 0) & (t >= 0) & (t <= 1), F.struct(x.alias("lon"), y.alias("lat"), t.alias("share"), distance(lon, lat, x, y).alias("metres")))


def line_length(points: Column) -> Column:
    """Metres along an array of structs with lon and lat; 0 for fewer than two points."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: distance(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and named once in the plan: a transform over a single element."""
    return F.transform(F.array(value), use)[0]


def along(points: Column, share: Column) -> Column:
    """Point at ``share`` (0 to 1) of the length of a line."""

    def step(target: Column, s: Column, p: Column) -> Column:
        def move(m: Column) -> Column:
            here = (m["want"] >= 0) & (m["want"] <= m["d"]) & (m["d"] > 0)
            beyond = m["want"] > m["d"]
            return F.struct(
                (s["done"] + m["d"]).alias("done"),
                F.when(here, s["x"] + (p["lon"] - s["x"]) * m["want"] / m["d"]).when(beyond, p["lon"]).otherwise(s["lon"]).alias("lon"),
                F.when(here, s["y"] + (p["lat"] - s["y"]) * m["want"] / m["d"]).when(beyond, p["lat"]).otherwise(s["lat"]).alias("lat"),
                p["lon"].alias("x"),
                p["lat"].alias("y"),
            )

        return bind(F.struct(distance(s["x"], s["y"], p["lon"], p["lat"]).alias("d"), (target - s["done"]).alias("want")), move)

    def walk(t: Column) -> Column:
        first = t["points"][0]
        start = F.struct(F.lit(0.0).alias("done"), first["lon"].alias("lon"), first["lat"].alias("lat"), first["lon"].alias("x"), first["lat"].alias("y"))
        return F.aggregate(t["points"], start, lambda s, p: step(t["target"], s, p))

    end = bind(F.struct(points.alias("points"), (line_length(points) * share).alias("target")), walk)
    return bind(end, lambda e: F.struct(e["lon"].alias("lon"), e["lat"].alias("lat")))


# Tiles of the Web Mercator grid.


def tile_xy(lon, lat, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    rad = F.radians(lat)
    y = F.floor((1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)
    return x.cast("long"), y.cast("long")


def tile_id(lon, lat, zoom: int = 14) -> Column:
    x, y = tile_xy(lon, lat, zoom)
    return y * (1 << zoom) + x


def tile_range(box, zoom: int = 14) -> Column:
    """Array of the ids of all tiles that a box touches."""
    x1, y2 = tile_xy(box["left"], box["bottom"], zoom)
    x2, y1 = tile_xy(box["right"], box["top"], zoom)
    return F.flatten(F.transform(F.sequence(y1, y2), lambda y: F.transform(F.sequence(x1, x2), lambda x: y * (1 << zoom) + x)))


def tiles_crossed(p, q, zoom: int = 14) -> Column:
    """Array of the ids of all tiles that the line from p to q touches: for each column of tiles, the rows between where the line comes in and where it goes out."""
    n = 1 << zoom
    west, east = F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"])
    column = lambda lon: F.floor((lon + 180.0) / 360.0 * n).cast("long")
    side = lambda x: x / F.lit(float(n)) * 360.0 - 180.0

    def rows(x):
        ends = [F.least(F.greatest(side(c), west), east) for c in (x, x + 1)]
        steep = p["lon"] == q["lon"]
        lats = [F.when(steep, flat["lat"]).otherwise(p["lat"] + (q["lat"] - p["lat"]) * (lon - p["lon"]) / F.nullif(q["lon"] - p["lon"], F.lit(0.0))) for lon, flat in zip(ends, (p, q), strict=True)]
        y1, y2 = (tile_xy(F.lit(0.0), lat, zoom)[1] for lat in lats)
        return F.transform(F.sequence(F.least(y1, y2), F.greatest(y1, y2)), lambda y: y * n + x)

    return F.flatten(F.transform(F.sequence(column(west), column(east)), rows))


def meets_box(p, q, box) -> Column:
    """Whether some point of the line from p to q lies in the half-open box."""
    spans = []
    for c, low, high in (("lon", "left", "right"), ("lat", "bottom", "top")):
        start, step = p[c], F.nullif(q[c] - p[c], F.lit(0.0))
        a, b = (box[low] - start) / step, (box[high] - start) / step
        inside = (start > box[low]) & (start <= box[high])
        level = step.isNull()
        spans.append((F.when(level, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(level, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))))
    begin, end = F.greatest(F.lit(0.0), spans[0][0], spans[1][0]), F.least(F.lit(1.0), spans[0][1], spans[1][1])
    at = [p[c] + (q[c] - p[c]) * begin for c in ("lon", "lat")]
    return (begin < end) | ((begin == end) & in_box(*at, box))


def vertex_id(tile, local) -> Column:
    return F.shiftleft(tile.cast("long"), 32).bitwiseOR(local.cast("long"))


def vertex_parts(vertex) -> tuple[Column, Column]:
    return F.shiftrightunsigned(vertex, 32), vertex.bitwiseAND(F.lit(0xFFFFFFFF))


def local_xy(lon, lat, zoom: int = 14, resolution: int = 4095) -> tuple[Column, Column]:
    """Steps from the top left corner of the tile, cut towards it."""
    n = float(1 << zoom)
    x = (lon + 180.0) / 360.0 * n
    rad = F.radians(lat)
    y = (1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n
    return F.floor((x - F.floor(x)) * resolution).cast("int"), F.floor((y - F.floor(y)) * resolution).cast("int")
