"""Column expressions over boxes, rings and polygons, tile keys and map projections.

A ring is array<struct<x,y>>, closed; a polygon is an array of rings, shell first; geom is an array of polygons. All
expressions stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The radius of spherical Mercator; the ellipsoid of the equal-area grid and its standard parallel.
RADIUS = 6378137.0
WGS84_E2 = 0.0066943799901413165
EASE_PARALLEL = 30.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# boxes ------------------------------------------------------------------------------------------------------------


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(col(c).cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Inclusive: boxes that only touch meet."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def boxes_cross(a: Column, b: Column) -> Column:
    """Exclusive: boxes that only touch don't cross."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def box_within(a: Column, b: Column) -> Column:
    """Half-open: a's lower edges may lie on b's, its upper ones may not."""
    return (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] < b["x2"]) & (a["y2"] < b["y2"])


def shared_area(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x1", "x2") * side("y1", "y2")


def box_iou(a: Column, b: Column) -> Column:
    """0 where the union is empty."""
    both = shared_area(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def scaled_box(b: Column, factor: float) -> Column:
    """Around its centre."""
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    hx, hy = (b["x2"] - b["x1"]) * factor / 2, (b["y2"] - b["y1"]) * factor / 2
    return box(mx - hx, my - hy, mx + hx, my + hy)


def padded_box(b: Column, pad: float) -> Column:
    return box(b["x1"] - pad, b["y1"] - pad, b["x2"] + pad, b["y2"] + pad)


def converted_box(b: Column, old: str, new: str) -> Column:
    """Of XYXY, XYWH and CXCYWH; the fields keep the names x1, y1, x2, y2 in that order."""
    a = [b[n] for n in ("x1", "y1", "x2", "y2")]
    corners = {"XYXY": a, "XYWH": [a[0], a[1], a[0] + a[2], a[1] + a[3]], "CXCYWH": [a[0] - a[2] / 2, a[1] - a[3] / 2, a[0] + a[2] / 2, a[1] + a[3] / 2]}[old]
    x1, y1, x2, y2 = corners
    return box(*{"XYXY": corners, "XYWH": [x1, y1, x2 - x1, y2 - y1], "CXCYWH": [(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1]}[new])


def square_region(x1, x2, y) -> Column:
    """The square over x1..x2 around the height y."""
    half = (col(x2) - col(x1)) / 2
    return box(x1, col(y) - half, x2, col(y) + half)


# rings and polygons -----------------------------------------------------------------------------------------------


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def ring_of_box(b: Column) -> Column:
    """Counter-clockwise and closed."""
    return F.array(point(b["x1"], b["y1"]), point(b["x2"], b["y1"]), point(b["x2"], b["y2"]), point(b["x1"], b["y2"]), point(b["x1"], b["y1"]))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f mentions it, also where Spark moves a filter below the column that it came from."""
    return F.transform(F.array(value), f)[0]


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of a closed ring's points."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Positive where the ring runs counter-clockwise; taken from its first point, for precision far from the origin."""
    o = ring[0]
    cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
    return _sum(F.transform(edges(ring), cross)) / 2


def length(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def polygon_area(rings: Column) -> Column:
    """The shell's less the holes'."""
    return once(F.transform(rings, lambda r: F.abs(signed_area(r))), lambda areas: 2 * areas[0] - _sum(areas))


def polygon_perimeter(rings: Column) -> Column:
    return _sum(F.transform(rings, length))


def oriented(ring: Column, clockwise: bool = False) -> Column:
    wrong = signed_area(ring) > 0 if clockwise else signed_area(ring) < 0
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def bounds(rings: Column) -> Column:
    """The box around a polygon's rings."""
    xs, ys = (lambda shell: F.transform(shell, lambda p: p["x"])), (lambda shell: F.transform(shell, lambda p: p["y"]))
    return once(rings[0], lambda shell: once(F.struct(xs(shell).alias("x"), ys(shell).alias("y")), lambda v: box(F.array_min(v["x"]), F.array_min(v["y"]), F.array_max(v["x"]), F.array_max(v["y"]))))


def moved(rings: Column, a, b, c, d, e, f) -> Column:
    """Every point by x' = a x + b y + c, y' = d x + e y + f; rings of fewer than four points go."""
    step = lambda p: point(col(a) * p["x"] + col(b) * p["y"] + col(c), col(d) * p["x"] + col(e) * p["y"] + col(f))
    return F.filter(F.transform(rings, lambda r: F.transform(r, step)), lambda r: F.size(r) >= 4)


def without_doubles(ring: Column, least: float = 0.0) -> Column:
    """Points that lie nearer than least to the one before (or on it) go; the first stays."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        near = F.hypot(p["x"] - last["x"], p["y"] - last["y"]) <= least
        return F.when(F.size(acc) == 0, F.array(p)).otherwise(F.when(near, acc).otherwise(F.concat(acc, F.array(p))))

    return F.aggregate(ring, F.array().cast("array<struct<x:double,y:double>>"), add)


def opened(ring: Column) -> Column:
    """Without the point that closes it, if one does."""
    same = lambda r: (F.element_at(r, -1)["x"] == r[0]["x"]) & (F.element_at(r, -1)["y"] == r[0]["y"])
    return once(ring, lambda r: F.when((F.size(r) > 1) & same(r), F.slice(r, 1, F.size(r) - 1)).otherwise(r))


def diameter(ring: Column) -> Column:
    """The largest distance of two points."""
    return F.array_max(F.transform(ring, lambda p: F.array_max(F.transform(ring, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))))


def winding_number(ring: Column, x, y) -> Column:
    """Turns of the closed ring around (x, y): 0 outside, else 1 or -1 by its direction."""
    side = lambda e: (e["b"]["x"] - e["a"]["x"]) * (col(y) - e["a"]["y"]) - (col(x) - e["a"]["x"]) * (e["b"]["y"] - e["a"]["y"])
    up = lambda e: (e["a"]["y"] <= col(y)) & (e["b"]["y"] > col(y)) & (side(e) > 0)
    down = lambda e: (e["a"]["y"] > col(y)) & (e["b"]["y"] <= col(y)) & (side(e) < 0)
    return F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + F.when(up(e), 1).when(down(e), -1).otherwise(0))


def covers_point(rings: Column, x, y) -> Column:
    """Whether a point lies inside a polygon and in none of its holes; points on an edge may count either way."""
    turns = F.transform(rings, lambda r: (winding_number(r, x, y) != 0).cast("int"))
    return F.aggregate(turns, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def _all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges))


def edge_nears_box(e: Column, b: Column) -> Column:
    """Whether an edge's own box meets another box; edges that don't can't meet what lies in it."""
    p, q = e["a"], e["b"]
    return (F.least(p["x"], q["x"]) <= b["x2"]) & (F.greatest(p["x"], q["x"]) >= b["x1"]) & (F.least(p["y"], q["y"]) <= b["y2"]) & (F.greatest(p["y"], q["y"]) >= b["y1"])


def polygons_meet(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common, touching included: edges that meet, or one inside the other."""
    inside = lambda p, q: covers_point(p, q[0][0]["x"], q[0][0]["y"])

    def crossing() -> Column:
        near = lambda rings, other: F.filter(_all_edges(rings), lambda e: edge_nears_box(e, other))
        both = F.struct(near(a, bounds(b)).alias("a"), near(b, bounds(a)).alias("b"))
        return F.exists(F.array(both), lambda s: F.exists(s["a"], lambda e: F.exists(s["b"], lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"]))))

    return crossing() | inside(a, b) | inside(b, a)


def polygon_shared_area(a: Column, b: Column) -> Column:
    """The area that two polygons share; holes count against it, whatever way rings run.

    A polygon is the sum of what lies under its edges, those that run to the left counted plus and the others minus; what two edges share
    is what lies under the lower of them, over the part of the axis that both span. The places are taken from a's first point.
    """
    ox, oy = a[0][0]["x"], a[0][0]["y"]

    def spans(rings: Column) -> Column:
        turned = F.transform(rings, lambda r, i: F.when(i == 0, oriented(r)).otherwise(oriented(r, clockwise=True)))
        flat = F.filter(F.flatten(F.transform(turned, edges)), lambda e: e["a"]["x"] != e["b"]["x"])

        def one(e: Column) -> Column:
            left = e["b"]["x"] < e["a"]["x"]
            low, high = F.when(left, e["b"]).otherwise(e["a"]), F.when(left, e["a"]).otherwise(e["b"])
            slope = (high["y"] - low["y"]) / (high["x"] - low["x"])
            return F.struct((low["x"] - ox).alias("from"), (high["x"] - ox).alias("to"), (low["y"] - oy).alias("y"), slope.alias("slope"), F.when(left, 1.0).otherwise(-1.0).alias("sign"))

        return F.transform(flat, one)

    def both(e: Column, f: Column) -> Column:
        low, high = F.greatest(e["from"], f["from"]), F.least(e["to"], f["to"])
        at = lambda s, x: s["y"] + s["slope"] * (x - s["from"])
        d0, d1 = at(e, low) - at(f, low), at(e, high) - at(f, high)
        m0, m1 = F.least(at(e, low), at(f, low)), F.least(at(e, high), at(f, high))
        t = d0 / F.nullif(d0 - d1, F.lit(0.0))
        middle = at(e, low + t * (high - low))
        mean = F.when(d0 * d1 < 0, (m0 + middle) / 2 * t + (middle + m1) / 2 * (1 - t)).otherwise((m0 + m1) / 2)
        return F.when(low < high, e["sign"] * f["sign"] * mean * (high - low)).otherwise(0.0)

    # each side's spans are worked out once, not again for every edge of the other
    sides = F.array(F.struct(spans(a).alias("a"), spans(b).alias("b")))
    inner = lambda s, e: F.aggregate(s["b"], F.lit(0.0), lambda acc, f: acc + both(e, f))
    total = F.transform(sides, lambda s: F.aggregate(s["a"], F.lit(0.0), lambda acc, e: acc + inner(s, e)))[0]
    return F.greatest(F.lit(0.0), total)


def polygon_crosses_box(rings: Column, b: Column) -> Column:
    """Whether a polygon and a box share more than an edge or a point."""

    def through(e: Column) -> Column:
        p, q = e["a"], e["b"]
        wide = (F.least(p["x"], q["x"]) < b["x2"]) & (F.greatest(p["x"], q["x"]) > b["x1"]) & (F.least(p["y"], q["y"]) < b["y2"]) & (F.greatest(p["y"], q["y"]) > b["y1"])
        side = lambda x, y: (q["x"] - p["x"]) * (b[y] - p["y"]) - (q["y"] - p["y"]) * (b[x] - p["x"])
        corners = [side(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
        return wide & (F.least(*corners) < 0) & (F.greatest(*corners) > 0)

    # where no edge runs through the box, it lies wholly inside or wholly outside
    return F.exists(_all_edges(rings), through) | covers_point(rings, (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def any_point_inside(ring: Column, b: Column) -> Column:
    return F.exists(ring, lambda p: p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"]))


def all_points_inside(ring: Column, b: Column) -> Column:
    return F.forall(ring, lambda p: p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"]))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments ab and cd meet, touching included."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    on = lambda p, q, r: (turn(p, q, r) == 0) & r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    apart = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return apart | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def segments_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments ab and cd lie on one line and share more than a point."""
    turn = lambda r: (b["x"] - a["x"]) * (r["y"] - a["y"]) - (b["y"] - a["y"]) * (r["x"] - a["x"])
    along = lambda r: (b["x"] - a["x"]) * (r["x"] - a["x"]) + (b["y"] - a["y"]) * (r["y"] - a["y"])
    return (turn(c) == 0) & (turn(d) == 0) & (F.greatest(F.lit(0.0), F.least(along(c), along(d))) < F.least(along(b), F.greatest(along(c), along(d))))


def line_meeting(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines through ab and cd meet; null if they are parallel."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    cross = rx * sy - ry * sx
    t = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / F.nullif(cross, F.lit(0.0))
    return F.when(cross != 0, point(a["x"] + t * rx, a["y"] + t * ry))


def angle_between(ux, uy, vx, vy) -> Column:
    """From u to v in degrees, counter-clockwise, -180 to 180."""
    u, v, w, z = col(ux), col(uy), col(vx), col(vy)
    return F.degrees(F.atan2(u * z - v * w, u * w + v * z))


def heading(e: Column) -> Column:
    return F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"]))


def normal(e: Column) -> Column:
    """The unit vector to the right of an edge."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    n = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return point(dy / n, -dx / n)


def parts(geom: Column, key: Column) -> Column:
    """array<struct<id, rings>>: a multipolygon's parts get _0, _1, ... after their id; a single one keeps it."""
    named = F.transform(geom, lambda rings, i: F.struct(F.when(F.size(geom) > 1, F.concat_ws("_", key, i.cast("string"))).otherwise(key).alias("id"), rings.alias("rings")))
    return named


# projections ------------------------------------------------------------------------------------------------------


def mercator_x(lon) -> Column:
    return F.radians(col(lon)) * RADIUS


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * RADIUS


def longitude(x) -> Column:
    return F.degrees(col(x) / RADIUS)


def latitude(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(col(y) / RADIUS)) - math.pi / 2)


def mercator_box(b: Column) -> Column:
    return box(mercator_x(b["x1"]), mercator_y(b["y1"]), mercator_x(b["x2"]), mercator_y(b["y2"]))


def equal_area(lon, lat) -> tuple[Column, Column]:
    """Ellipsoidal cylindrical equal-area coordinates with standard parallel 30."""
    e = math.sqrt(WGS84_E2)
    s = math.sin(math.radians(EASE_PARALLEL))
    k0 = math.cos(math.radians(EASE_PARALLEL)) / math.sqrt(1 - WGS84_E2 * s * s)
    sin = F.sin(F.radians(col(lat)))
    q = (1 - WGS84_E2) * (sin / (1 - WGS84_E2 * sin * sin) - F.log((1 - e * sin) / (1 + e * sin)) / (2 * e))
    return F.radians(col(lon)) * RADIUS * k0, q * RADIUS / (2 * k0)


def equal_area_of_box(b: Column) -> Column:
    x1, y1 = equal_area(b["x1"], b["y1"])
    x2, y2 = equal_area(b["x2"], b["y2"])
    return F.abs((x2 - x1) * (y2 - y1))


# tile keys --------------------------------------------------------------------------------------------------------


def tile_name(lon1, lat2, lon2, lat1) -> Column:
    """e005_n50_e010_n45 of the west, north, east and south edges, whole degrees; 0 is e and n."""
    lon = lambda c: F.concat(F.when(col(c) < 0, "w").otherwise("e"), F.lpad(F.abs(col(c)).cast("string"), 3, "0"))
    lat = lambda c: F.concat(F.when(col(c) < 0, "s").otherwise("n"), F.lpad(F.abs(col(c)).cast("string"), 2, "0"))
    return F.concat_ws("_", lon(lon1), lat(lat2), lon(lon2), lat(lat1))


def parsed_tile(name) -> Column:
    """struct<lon_min, lat_max, lon_max, lat_min> of a name, whatever stands around the key; null if there is none."""
    pattern = r"([ew])([0-9]{3})_([ns])([0-9]{2})_([ew])([0-9]{3})_([ns])([0-9]{2})"
    get = lambda i: F.regexp_extract(col(name), pattern, i)
    value = lambda i: F.when(get(i).isin("w", "s"), -get(i + 1).cast("int")).otherwise(get(i + 1).cast("int"))
    return F.when(col(name).rlike(pattern), F.struct(value(1).alias("lon_min"), value(3).alias("lat_max"), value(5).alias("lon_max"), value(7).alias("lat_min")))


def tile_starts(low, high, side: int = 5) -> Column:
    """West or south edges of the tiles from low to high; a high that lies on an edge adds the tile that begins there."""
    at = lambda c: (F.floor(col(c) / side) * side).cast("int")
    return F.sequence(at(low), at(high), F.lit(side))


def slippy_x(lon, zoom: int) -> Column:
    return F.floor((col(lon) + 180) / 360 * 2**zoom).cast("int")


def slippy_y(lat, zoom: int) -> Column:
    r = F.radians(col(lat))
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * 2**zoom).cast("int")


def quadkey(x, y, zoom: int) -> Column:
    """A digit for each level from the coarsest: 1 for the x bit, 2 for the y bit."""
    bit = lambda c, i: F.pmod(F.floor(col(c) / F.pow(F.lit(2.0), i - 1)), F.lit(2)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(zoom), F.lit(1), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string")), "")


def district_id(*gids) -> Column:
    """The levels joined by -, without a trailing -."""
    return F.regexp_replace(F.concat_ws("-", *(F.coalesce(col(g).cast("string"), F.lit("")) for g in gids)), "-+$", "")


def split_at_180(b: Column) -> Column:
    """array of one box, or of the two halves of one that reaches from below -170 to above 170."""
    wraps = (b["x1"] < -170) & (b["x2"] > 170)
    return F.when(wraps, F.array(box(F.lit(-180.0), b["y1"], b["x1"], b["y2"]), box(b["x2"], b["y1"], F.lit(180.0), b["y2"]))).otherwise(F.array(b))


def split_polygon_at_180(ring: Column) -> Column:
    """array of one ring, or of the eastern and the western part of one that reaches from below -170 to above 170.

    The eastern part takes the points of the west to the antimeridian's near side, and the western part those of the east.
    """
    b = bounds(F.array(ring))
    wraps = (b["x1"] < -170) & (b["x2"] > 170)
    east = F.transform(ring, lambda p: point(F.when(p["x"] < 0, F.least(p["x"] + 360, F.lit(180.0))).otherwise(p["x"]), p["y"]))
    west = F.transform(ring, lambda p: point(F.when(p["x"] > 0, F.greatest(p["x"] - 360, F.lit(-180.0))).otherwise(p["x"]), p["y"]))
    return F.when(wraps, F.array(east, west)).otherwise(F.array(ring))


# values -----------------------------------------------------------------------------------------------------------


def bin_of(value, edges: list[float]) -> Column:
    """Upper edges that aren't above the value, at most the last bin's number."""
    upper = [float(e) for e in edges[1:]]
    return F.least(F.lit(len(upper) - 1), F.size(F.filter(F.array(*map(F.lit, upper)), lambda e: e <= col(value))))


def bin_in(value, edges: Column) -> Column:
    """As bin_of, of a column of edges."""
    return F.least(F.size(edges) - 2, F.size(F.filter(F.slice(edges, 2, F.size(edges)), lambda e: e <= col(value))))


def recode(value, table: dict[int, int], default: int | None = None) -> Column:
    """Unmapped values become default, or stay where it is None."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(pairs[col(value)], F.lit(default) if default is not None else col(value))


def reduce_zero_label(value, ignore: int = 255) -> Column:
    """0 is ignored, all else goes one down; what was ignored stays."""
    v = col(value)
    return F.when((v == 0) | (v == ignore), F.lit(ignore)).otherwise(v - 1)


def multi_hot(ids: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(ids, i).cast("int"))


def magnitude(value) -> Column:
    """12,345,678 as 12M, and a thousand times that as 12346M: halves go up, thousands aren't set apart."""
    return F.concat(F.round(col(value) / 1e6).cast("long").cast("string"), F.lit("M"))


def path_parts(path) -> Column:
    """struct<name, stem, suffix, parent> of a path or url path."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.struct(name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), F.get(F.split(col(path), "/"), F.size(F.split(col(path), "/")) - 2).alias("parent"))
