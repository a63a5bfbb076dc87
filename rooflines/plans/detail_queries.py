"""Smaller operators: affine maps, vertices, segments, windows, palettes, lookups, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, nested
from ..operators import evaluation, raster, rings, sampling
from .fixtures import Tables, with_tables
from .footprint_queries import _COVERED, DEGREES, SIDE, degrees, lshaped_houses, shapes
from .registry import query

R6 = lambda c, n=6: F.round(c, n)


@query(with_tables("SELECT source, round(sum((x2 - x1) * (y2 - y1) * 0.75 * 0.25), 6) AS area, round(min(100 + x1 * 0.5), 6) AS left_edge, round(sum(100 + 0.5 * 8 + 900 - 0.5 * 16), 6) AS origins FROM footprints GROUP BY source", "footprints"))
def affine_rings(t: Tables) -> DataFrame:
    """Rings from pixels to the ground, and a window's shifted transform."""
    rows = shapes(t).withColumn("g", geo.moved(F.array("ring"), F.lit(0.5), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(-0.5), F.lit(900.0)))
    base = F.struct(*(F.lit(v).alias(n) for n, v in zip("abcdef", (0.5, 0.0, 100.0, 0.0, -0.5, 900.0), strict=True)))
    s = raster.shifted_transform(base, F.lit(8), F.lit(16))
    rows = rows.withColumn("s", s)
    return rows.groupBy("source").agg(R6(F.sum(geo.polygon_area(F.col("g")))).alias("area"), R6(F.min(geo.bounds(F.col("g"))["x1"])).alias("left_edge"), R6(F.sum(F.col("s.c") + F.col("s.f"))).alias("origins"))


@query(with_tables("SELECT source, CAST(sum(CASE WHEN fid % 3 = 2 THEN 14 ELSE 6 END) AS BIGINT) AS vertices, round(sum(CASE WHEN fid % 3 = 2 THEN 2 * (3 * x1 + 3 * x2 + x1) + 7 * 0.02 ELSE 3 * x1 + 3 * x2 END), 4) AS x FROM footprints GROUP BY source", "footprints"))
def cleaned_rings(t: Tables) -> DataFrame:
    """Rings with every vertex doubled, on the spot, near it or too far to be one; without the doubles and the closing point."""
    doubled = F.flatten(F.transform("ring", lambda p: F.array(p, geo.point(p["x"] + F.col("fid") % 3 * 0.01, p["y"]))))
    rows = shapes(t).withColumn("r", geo.opened(geo.without_doubles(doubled, 0.015)))
    return rows.groupBy("source").agg(F.sum(F.size("r").cast("long")).alias("vertices"), R6(F.sum(F.aggregate("r", F.lit(0.0), lambda acc, p: acc + p["x"])), 4).alias("x"))


_DX, _DY = "(c.ax - a.ax)", "(c.ay - a.ay)"
_EX, _EY = "(d.ax - b.ax)", "(d.ay - b.ay)"
_AT = f"((b.ax - a.ax) * {_EY} - (b.ay - a.ay) * {_EX}) / ({_DX} * {_EY} - {_DY} * {_EX})"


@query(with_tables(f"SELECT a.source, count(*) AS crossing, count(*) FILTER (a.fid % 5 = 4) AS touching, round(sum(a.ax + {_AT} * {_DX}), 4) AS x, round(sum(a.ay + {_AT} * {_DY}), 4) AS y FROM kites a JOIN kites b ON b.fid = a.fid AND b.pos = 1 JOIN kites c ON c.fid = a.fid AND c.pos = 2 JOIN kites d ON d.fid = a.fid AND d.pos = 3 WHERE a.pos = 0 GROUP BY a.source", "footprints", "kites"))
def crossing_diagonals(t: Tables) -> DataFrame:
    """Where the diagonals of irregular rings meet, and which first edges are met by one from below that may end short of them."""
    r = [F.col("ring")[i] for i in range(4)]
    below = geo.point(r[0]["x"], r[0]["y"] - 1), geo.point(r[1]["x"], r[0]["y"] + F.col("fid") % 5 - 2)
    rows = t.kites().withColumn("m", geo.line_meeting(r[0], r[2], r[1], r[3])).withColumn("d", geo.segments_cross(r[0], r[2], r[1], r[3])).withColumn("t", geo.segments_cross(r[0], r[1], *below))
    return rows.groupBy("source").agg(F.count_if("d").alias("crossing"), F.count_if("t").alias("touching"), R6(F.sum("m.x"), 4).alias("x"), R6(F.sum("m.y"), 4).alias("y"))


@query(with_tables("SELECT a.pos, count(*) AS n, round(sum(degrees(atan2(a.cy - a.ay, a.cx - a.ax))), 4) AS headings, round(sum((a.cy - a.ay) / a.len), 5) AS normal_x, round(sum((a.ax - a.cx) / a.len), 5) AS normal_y, round(sum(degrees(atan2((a.cx - a.ax) * (b.cy - b.ay) - (a.cy - a.ay) * (b.cx - b.ax), (a.cx - a.ax) * (b.cx - b.ax) + (a.cy - a.ay) * (b.cy - b.ay)))), 4) AS turns FROM kites a JOIN kites b ON b.fid = a.fid AND b.pos = (a.pos + 1) % 4 GROUP BY a.pos", "footprints", "kites"))
def edge_directions(t: Tables) -> DataFrame:
    """Headings, right-hand normals and turns of irregular rings' edges."""
    e = F.posexplode(F.transform(geo.edges(F.col("ring")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), geo.heading(x).alias("h"), geo.normal(x).alias("n"))))
    v = t.kites().select("fid", e.alias("pos", "e")).select("fid", "pos", "e.h", "e.n", (F.col("e.b.x") - F.col("e.a.x")).alias("dx"), (F.col("e.b.y") - F.col("e.a.y")).alias("dy"))
    v = rings.with_neighbours(v, "fid", "dx", "dy")
    return v.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), R6(F.sum("h"), 4).alias("headings"), R6(F.sum("n.x"), 5).alias("normal_x"), R6(F.sum("n.y"), 5).alias("normal_y"), R6(F.sum(geo.angle_between("dx", "dy", "next_dx", "next_dy")), 4).alias("turns"))


@query(with_tables("SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT fid % 5 AS grp, row, col FROM houses, LATERAL unnest(range(y1, y2)) AS r(row), LATERAL unnest(range(x1, x2)) AS c(col)) GROUP BY 1", "houses"))
def dissolved_houses(t: Tables) -> DataFrame:
    """The area that a group's houses cover together."""
    return raster.dissolved_area(t.houses().withColumn("grp", F.col("fid") % 5), "grp", 1.0)


@query(with_tables("""SELECT i AS row, count(*) AS n, CAST(sum(h) AS BIGINT) AS total FROM (SELECT n, unnest(range(0, greatest(2 * n - 1, 1))) AS i FROM (SELECT max(row) + 1 AS n FROM pixels)) a, range(0, 450) AS b(j), pixels
WHERE row = floor(i * (n - 1) / greatest(2.0 * n - 2, 1) + 0.5) AND col = floor(j * 299 / 449.0 + 0.5) GROUP BY i""", "pixels"))
def whole_upsampled_pixels(t: Tables) -> DataFrame:
    """The raster at twice as many rows less one and half as many columns again."""
    p = t.pixels().select("row", "col", F.col("h").alias("value"))
    n = raster.height_of(p)
    up = raster.upsample(p, n, 300, max(2 * n - 1, 1), 450)
    return up.groupBy(F.col("row").cast("long").alias("row")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(with_tables("SELECT fid, CAST(y1 - (x2 - x1) / 2.0 AS DOUBLE) AS y_low, CAST(y1 + (x2 - x1) / 2.0 AS DOUBLE) AS y_high, CAST(round(x1 / 4.0) AS INT) AS col, CAST(round((6000 - y1 - (x2 - x1) / 2.0) / 4.0) AS INT) AS row FROM footprints", "footprints"))
def square_windows(t: Tables) -> DataFrame:
    """Squares around footprints as windows of a north-up raster of four-metre pixels."""
    s = geo.square_region("x1", "x2", "y1")
    rows = t.footprints().withColumn("s", s).withColumn("w", raster.window_of_bounds(F.col("s"), F.lit(0.0), F.lit(6000.0), F.lit(4.0)))
    return rows.select("fid", F.col("s.y1").alias("y_low"), F.col("s.y2").alias("y_high"), "w.col", "w.row")


@query("SELECT CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 255 END AS class, count(*) AS n FROM lineitem GROUP BY 1")
def palette_classes(t: Tables) -> DataFrame:
    k = F.col("l_partkey") % 4
    rgb = t.lineitem.select((F.when(k == 0, 255).otherwise(0)).alias("r"), (F.when(k == 1, 255).otherwise(0)).alias("g"), (F.when(k == 2, 255).when(k == 3, 77).otherwise(0)).alias("b"))
    return raster.palette_class(rgb, [(255, 0, 0), (0, 255, 0), (0, 0, 255)]).groupBy("class").agg(F.count("*").alias("n"))


_KEY = "CAST(floor((lon1 + 180) / 360 * 64) AS INT) * 1000 + CAST(floor((1 - ln(tan(radians(lat1)) + 1 / cos(radians(lat1))) / pi()) / 2 * 64) AS INT)"


@query(with_tables(f"SELECT source, count(*) AS features FROM ({DEGREES}) WHERE {_KEY} IN (SELECT {_KEY} FROM ({DEGREES}) WHERE source = 'osm' AND fid % 10 = 0) GROUP BY 1", "footprints"))
def quadkey_lookup(t: Tables) -> DataFrame:
    """Features in the quadkeys that an index lists."""
    keyed = degrees(t).withColumn("key", geo.quadkey(geo.slippy_x("lon1", 6), geo.slippy_y("lat1", 6), 6))
    index = keyed.where("source = 'osm' AND fid % 10 = 0").select("key").distinct()
    return keyed.join(index, "key", "left_semi").groupBy("source").agg(F.count("*").alias("features"))


@query("SELECT o_orderstatus AS status, count(*) AS patches FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def patch_parents(t: Tables) -> DataFrame:
    patches = t.lineitem.select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.lit("patch"), F.col("l_linenumber").cast("string")).alias("patch"))
    parents = t.orders.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("status"))
    return sampling.with_parent(patches, parents, "patch", "name").groupBy("status").agg(F.count("*").alias("patches"))


@query("SELECT greatest(c, p) AS n, greatest(c, p) - c AS no_customer, greatest(c, p) - p AS no_part FROM (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM part) AS p)")
def zipped_longest(t: Tables) -> DataFrame:
    z = sampling.zipped(t.customer.select("c_custkey"), t.part.select("p_partkey"), "c_custkey", "p_partkey", longest=True)
    return z.agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("no_customer"), F.count_if(F.col("p_partkey").isNull()).alias("no_part"))


@query(with_tables("SELECT source, round(sum(x1 * 2 + (x2 * 2) + y1 * 2), 6) AS doubled, count(*) AS n FROM footprints GROUP BY source", "footprints"))
def nested_doubling(t: Tables) -> DataFrame:
    """A function applied to every number inside structs, arrays and maps."""
    rows = t.footprints().select("source", F.struct(F.col("x1").cast("double").alias("a"), F.array(F.struct(F.col("x2").cast("double").alias("b"))).alias("c"), F.create_map(F.lit("k"), F.col("y1").cast("double")).alias("m")).alias("v"))
    out = nested.apply_everywhere(rows, T.DoubleType, lambda c: c * 2)
    return out.groupBy("source").agg(R6(F.sum(F.col("v.a") + F.col("v.c")[0]["b"] + F.col("v.m")["k"])).alias("doubled"), F.count("*").alias("n"))


@query(with_tables("SELECT fid, round(degrees(atan(1.0 / (x2 - x1))), 6) AS angle FROM footprints", "footprints"))
def tangent_angles(t: Tables) -> DataFrame:
    """The largest angle between a box's edges and those of the box with one corner lifted."""
    v = t.footprints().select("fid", F.posexplode(F.slice(geo.ring_of_box(F.col("lbox")), 1, 4)).alias("pos", "p"))
    e = v.select("fid", "pos", "p.x", "p.y", F.col("p.x").alias("tx"), (F.col("p.y") + (F.col("pos") == 1).cast("double")).alias("ty"))
    return rings.max_tangent_angle(e, "fid").select("fid", R6(F.col("angle")).alias("angle"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS band, round(min((p - lo) / (hi - lo)), 6) AS low, round(avg((p - lo) / (hi - lo)), 6) AS mean FROM (SELECT l_linenumber, least(greatest(l_extendedprice, 2000), 50000) AS p, min(least(greatest(l_extendedprice, 2000), 50000)) OVER (PARTITION BY l_linenumber) AS lo, max(least(greatest(l_extendedprice, 2000), 50000)) OVER (PARTITION BY l_linenumber) AS hi FROM lineitem) GROUP BY 1")
def clipped_min_max(t: Tables) -> DataFrame:
    """Values cut to a range, then spread from 0 to 1 by band."""
    v = t.lineitem.select(F.col("l_linenumber").cast("long").alias("band"), F.least(F.greatest("l_extendedprice", F.lit(2000.0)), F.lit(50000.0)).alias("p"))
    s = v.groupBy("band").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    x = (F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return v.join(F.broadcast(s), "band").groupBy("band").agg(R6(F.min(x)).alias("low"), R6(F.avg(x)).alias("mean"))


@query(with_tables("SELECT g % 97 AS ring_id, fid AS pos, CAST(g * 10 + fid % 4 AS DOUBLE) AS x, CASE WHEN n >= 3 THEN n ELSE 1 END AS points FROM (SELECT fid, CAST(floor(fid / 4.0) AS BIGINT) AS g, count(*) OVER w AS n, min(fid) OVER w AS first FROM footprints WHERE fid % 16 NOT IN (13, 14) WINDOW w AS (PARTITION BY CAST(floor(fid / 4.0) AS BIGINT))) WHERE n < 3 OR fid = first", "footprints"))
def cluster_end_points(t: Tables) -> DataFrame:
    """Runs of points a metre apart, clustered by their coordinates; runs of fewer than three are noise. Each cluster's first point stays."""
    g = F.floor(F.col("fid") / 4)
    points = t.footprints().where("fid % 16 not in (13, 14)").select((g % 97).alias("ring_id"), F.col("fid").alias("pos"), (g * 10 + F.col("fid") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return rings.end_points(rings.point_clusters(points, 1.5, 3)).select("ring_id", "pos", "x", "points")


_BOXES = "SELECT DISTINCT fid % 50 AS image, r.row, c.col FROM houses, LATERAL unnest(range(CAST(floor(y1 / 10.0) AS BIGINT), CAST(ceil(y2 / 10.0) AS BIGINT))) AS r(row), LATERAL unnest(range(CAST(floor(x1 / 10.0) AS BIGINT), CAST(ceil(x2 / 10.0) AS BIGINT))) AS c(col) WHERE fid % 3 <> 0"


@query(with_tables(f"""SELECT image, round(common / allpx, 9) AS iou, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS n_truth, round(common / allpx * (1 - abs(n - m) / CAST(n + m AS DOUBLE)), 9) AS c_iou
FROM (SELECT image, CAST(count(*) FILTER (k = 2) AS DOUBLE) AS common, count(*) AS allpx FROM (SELECT image, row, col, count(*) AS k FROM (SELECT DISTINCT fid % 50 AS image, row, col FROM ({_COVERED}) UNION ALL ({_BOXES})) GROUP BY ALL) GROUP BY image)
JOIN (SELECT fid % 50 AS image, 6 * count(*) AS n, 4 * count(*) FILTER (fid % 3 <> 0) AS m FROM houses GROUP BY 1) USING (image)""", "houses"))
def image_iou(t: Tables) -> DataFrame:
    """L-shapes against two thirds of their houses: the pixels of both sides by image, and their vertices."""
    image = (F.col("fid") % 50).alias("image")
    truths = t.houses().where("fid % 3 <> 0").select(image, F.array(geo.ring_of_box(F.col("lbox"))).alias("rings"))
    rows = evaluation.image_ious(lshaped_houses(t).select(image, "rings"), truths, 10.0)
    return rows.select("image", R6(F.col("iou"), 9).alias("iou"), F.col("n").cast("long").alias("n"), F.col("n_truth").cast("long").alias("n_truth"), R6(F.col("c_iou"), 9).alias("c_iou"))


@query(with_tables("SELECT fid AS pred, fid AS truth, round(degrees(atan(1 / (4.0 * (x2 - x1) - 6))), 6) AS angle FROM footprints WHERE fid % 4 <> 0", "footprints"))
def contour_angle(t: Tables) -> DataFrame:
    """Four points inside a box, one of them farther from its side: matched, given points, moved to the box and compared edge by edge. A quarter of them match nothing."""
    b, p = F.col("b"), geo.point
    big = t.footprints().select("fid", geo.box(F.col("lbox.x1") * 4, F.col("lbox.y1") * 4, F.col("lbox.x2") * 4, F.col("lbox.y2") * 4).alias("b"))
    dx = F.when(F.col("fid") % 4 == 0, 3 * (b["x2"] - b["x1"])).otherwise(0.0)
    ring = F.array(p(b["x1"] + 3 + dx, b["y1"] + 1), p(b["x2"] - 3 + dx, b["y1"] + 2), p(b["x2"] - 3 + dx, b["y2"] - 1), p(b["x1"] + 3 + dx, b["y2"] - 1), p(b["x1"] + 3 + dx, b["y1"] + 1))
    preds = big.select(F.col("fid").alias("image"), F.col("fid").alias("pred"), F.array(ring).alias("rings")).withColumn("lbox", geo.bounds(F.col("rings")))
    truths = big.select(F.col("fid").alias("image"), F.col("fid").alias("truth"), F.col("fid").alias("order"), b.alias("rbox"), F.array(geo.ring_of_box(b)).alias("rrings"))
    return evaluation.contour_angles(preds, truths, 4 * SIDE, 1000.0).select("pred", "truth", R6(F.col("angle")).alias("angle"))
