"""Fusion, tile keys, heights and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, polygons
from ..operators import blocks, clipping, fusion, lod1, pairs, raster, rings, spatial
from ..sources.shared import through_folder
from .fixtures import Tables, with_tables
from .registry import query

#: Grid cells a little over twice a footprint's side.
SIDE = 64.0
R6 = lambda c, n=6: F.round(c, n)
FUSION = ("footprints", "districts", "cropped", "pairs", "quality", "best")


def cropped(t: Tables) -> DataFrame:
    return fusion.crop(t.footprints(), t.districts(), SIDE)


@query(with_tables("""SELECT region, source, count(*) AS features, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM (
SELECT region, source, x1, y1, x2, y2 FROM cropped WHERE source = 'osm' UNION ALL
SELECT c.region, c.source, x1, y1, x2, y2 FROM cropped c JOIN best b ON c.roi_id = b.roi_id AND c.source = b.best WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.roi_id = c.roi_id AND p.source = c.source AND p.fid = c.fid)) GROUP BY ALL""", *FUSION))
def fuse_districts(t: Tables) -> DataFrame:
    fused = fusion.fuse(cropped(t), "osm", SIDE)
    return fused.groupBy("region", "source").agg(F.count("*").alias("features"), F.sum(geo.box_area(F.col("lbox"))).alias("area"))


@query(with_tables("SELECT roi_id, region, source, count(*) AS features FROM cropped GROUP BY ALL", *FUSION[:3]))
def crop_counts(t: Tables) -> DataFrame:
    return cropped(t).groupBy("roi_id", "region", "source").agg(F.count("*").alias("features"))


@query(with_tables("SELECT * FROM quality WHERE source <> 'osm'", *FUSION[:5]))
def source_quality(t: Tables) -> DataFrame:
    c = raster.checkpointed(cropped(t))
    return fusion.quality_of(c, fusion.met(c, "osm", SIDE)).where("source <> 'osm'")


@query(with_tables("SELECT * FROM best", *FUSION))
def best_source(t: Tables) -> DataFrame:
    c = raster.checkpointed(cropped(t))
    return fusion.best_source(fusion.quality_of(c, fusion.met(c, "osm", SIDE)), "osm")


@query(with_tables("""SELECT roi_id, best, has_main, metric FROM (SELECT roi_id, source AS best, false AS has_main, area AS metric, row_number() OVER (PARTITION BY roi_id ORDER BY area DESC, list_position(['ms', 'ours2', 'google'], source)) AS n FROM quality WHERE source IN ('ms', 'ours2', 'google')) WHERE n = 1""", *FUSION[:5]))
def best_without_main(t: Tables) -> DataFrame:
    """The choice where the main source is missing everywhere: total area decides."""
    c = raster.checkpointed(cropped(t).where("source <> 'osm'"))
    return fusion.best_source(fusion.quality_of(c, fusion.met(c, "osm", SIDE)), "osm")


@query(with_tables("SELECT roi_id, source, count(*) AS features, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM cropped c WHERE source <> 'osm' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.roi_id = c.roi_id AND p.source = c.source AND p.fid = c.fid) GROUP BY ALL", *FUSION[:4]))
def anti_overlap_remainder(t: Tables) -> DataFrame:
    c = raster.checkpointed(cropped(t))
    rest = c.where("source <> 'osm'").join(fusion.met(c, "osm", SIDE), ["roi_id", "source", "fid"], "left_anti")
    return rest.groupBy("roi_id", "source").agg(F.count("*").alias("features"), F.sum(geo.box_area(F.col("lbox"))).alias("area"))


@query(with_tables("SELECT roi_id, source, count(*) AS pairs, count(*) FILTER (shared = 0) AS touching, sum(shared) AS shared, count(DISTINCT fid) AS matched FROM pairs GROUP BY ALL", *FUSION[:4]))
def overlap_pairs(t: Tables) -> DataFrame:
    met = fusion.met(raster.checkpointed(cropped(t)), "osm", SIDE)
    return met.groupBy("roi_id", "source").agg(F.sum("pairs").alias("pairs"), F.sum("touching").alias("touching"), F.sum("overlap").alias("shared"), F.count("*").alias("matched"))


@query(with_tables("""SELECT coalesce(d.roi_id, 'total') AS roi_id, count(*) AS features FROM footprints f LEFT JOIN (SELECT * FROM districts WHERE continent IN ('ASIA', 'EUROPE')) d ON f.x1 <= d.rx2 AND d.rx1 <= f.x2 AND f.y1 <= d.ry2 AND d.ry1 <= f.y2 GROUP BY ALL""", *FUSION[:2]))
def district_fallback(t: Tables) -> DataFrame:
    """Footprints outside all (here: two continents') districts form one region of their own."""
    some = t.districts().where(F.col("continent").isin("ASIA", "EUROPE")).drop("continent")
    return fusion.crop(t.footprints(), some, SIDE, keep_outside=True).groupBy("roi_id").agg(F.count("*").alias("features"))


@query(with_tables("SELECT roi_id, source, count(*) AS features FROM (SELECT source, fid, min(roi_id) AS roi_id FROM cropped GROUP BY ALL) GROUP BY ALL", *FUSION[:3]))
def cross_district_dedupe(t: Tables) -> DataFrame:
    return fusion.without_repeats(cropped(t)).groupBy("roi_id", "source").agg(F.count("*").alias("features"))


@query(with_tables("SELECT CAST(floor(x1 / 20.0) AS BIGINT) AS tile, CASE WHEN bool_or(source = 'google') THEN 'google' ELSE 'osm' END AS main FROM footprints GROUP BY 1", "footprints"))
def main_source_fallback(t: Tables) -> DataFrame:
    return fusion.main_source(t.footprints().withColumn("tile", F.floor(F.col("x1") / 20)), "tile")


@query(with_tables("SELECT f.fid, count(*) AS k FROM footprints f JOIN districts d ON f.x1 <= d.rx2 AND d.rx1 <= f.x2 AND f.y1 <= d.ry2 AND d.ry1 <= f.y2 GROUP BY 1 HAVING count(*) > 1", *FUSION[:2]))
def border_footprints(t: Tables) -> DataFrame:
    """Filter and refine with exact polygons: footprints that meet several districts."""
    left = t.footprints().withColumn("lrings", F.array(geo.ring_of_box(F.col("lbox"))))
    right = t.districts().withColumn("rrings", F.array(geo.ring_of_box(F.col("rbox"))))
    return spatial.refined(spatial.grid_join(left, right, SIDE)).groupBy("fid").agg(F.count("*").alias("k")).where("k > 1")


@query(with_tables("SELECT count(*) AS features, source FROM footprints f WHERE EXISTS (SELECT 1 FROM houses h WHERE f.x1 <= h.x2 AND h.x1 <= f.x2 AND f.y1 <= h.y2 AND h.y1 <= f.y2) GROUP BY source", "footprints", "houses"))
def footprints_near_houses(t: Tables) -> DataFrame:
    houses = t.houses().select(F.col("lbox").alias("rbox"))
    left = t.footprints().withColumn("lid", F.col("fid"))
    return spatial.grid_join(left, houses, SIDE, "left_semi", small_right=False).groupBy("source").agg(F.count("*").alias("features"))


# tile keys: footprints scaled to degrees, longitudes -170 to 180, latitudes -70 to 80
LON1, LON2, LAT1, LAT2 = "x1 * 7 / 100.0 - 170", "x2 * 7 / 100.0 - 170", "y1 * 3 / 100.0 - 70", "y2 * 3 / 100.0 - 70"


def degrees(t: Tables) -> DataFrame:
    return t.footprints().selectExpr("fid", "source", f"CAST({LON1} AS DOUBLE) AS lon1", f"CAST({LAT1} AS DOUBLE) AS lat1", f"CAST({LON2} AS DOUBLE) AS lon2", f"CAST({LAT2} AS DOUBLE) AS lat2")


DEGREES = f"SELECT fid, source, CAST({LON1} AS DOUBLE) AS lon1, CAST({LAT1} AS DOUBLE) AS lat1, CAST({LON2} AS DOUBLE) AS lon2, CAST({LAT2} AS DOUBLE) AS lat2 FROM footprints"
_T = "CASE WHEN {0} < 0 THEN '{1}' ELSE '{2}' END || lpad(CAST(abs({0}) AS VARCHAR), {3}, '0')"
_NAME = " || '_' || ".join([_T.format("lon", "w", "e", 3), _T.format("lat + 5", "s", "n", 2), _T.format("lon + 5", "w", "e", 3), _T.format("lat", "s", "n", 2)])


@query(with_tables(f"""SELECT {_NAME} AS tile, lon AS lon_min, lat + 5 AS lat_max, count(*) AS features FROM (SELECT fid, CAST(a.lon AS INT) AS lon, CAST(b.lat AS INT) AS lat FROM ({DEGREES}),
LATERAL unnest(range(CAST(floor(lon1 / 5) * 5 AS BIGINT), CAST(floor(lon2 / 5) * 5 + 5 AS BIGINT), 5)) AS a(lon), LATERAL unnest(range(CAST(floor(lat1 / 5) * 5 AS BIGINT), CAST(floor(lat2 / 5) * 5 + 5 AS BIGINT), 5)) AS b(lat)) GROUP BY ALL""", "footprints"))
def tile_keys(t: Tables) -> DataFrame:
    """Tiles of each footprint, named, counted and read back from their names."""
    rows = degrees(t).withColumn("lon", F.explode(geo.tile_starts("lon1", "lon2"))).withColumn("lat", F.explode(geo.tile_starts("lat1", "lat2")))
    named = rows.withColumn("tile", geo.tile_name("lon", F.col("lat") + 5, F.col("lon") + 5, "lat"))
    return named.groupBy("tile").agg(F.count("*").alias("features")).withColumn("p", geo.parsed_tile("tile")).select("tile", "p.lon_min", "p.lat_max", "features")


_QX, _QY = "CAST(floor((lon1 + 180) / 360 * 512) AS INT)", "CAST(floor((1 - ln(tan(radians(lat1)) + 1 / cos(radians(lat1))) / pi()) / 2 * 512) AS INT)"


@query(with_tables(f"SELECT quadkey, count(*) AS features FROM (SELECT list_aggregate(list_transform([9,8,7,6,5,4,3,2,1], lambda i: CAST(((x >> (i - 1)) & 1) + 2 * ((y >> (i - 1)) & 1) AS VARCHAR)), 'string_agg', '') AS quadkey FROM (SELECT {_QX} AS x, {_QY} AS y FROM ({DEGREES}))) GROUP BY ALL", "footprints"))
def quadkeys(t: Tables) -> DataFrame:
    key = geo.quadkey(geo.slippy_x("lon1", 9), geo.slippy_y("lat1", 9), 9)
    return degrees(t).groupBy(key.alias("quadkey")).agg(F.count("*").alias("features"))


@query(with_tables(f"""SELECT row, count(*) AS cells, min(cell) AS first, max(cell) AS last FROM (SELECT r AS row, printf('%.1f', (lon * 10 + c * 2) / 10.0) || '_' || printf('%.1f', (lat * 10 + 50 - r * 2) / 10.0) || '_' || printf('%.1f', (lon * 10 + c * 2 + 2) / 10.0) || '_' || printf('%.1f', (lat * 10 + 50 - r * 2 - 2) / 10.0) AS cell
FROM (SELECT DISTINCT CAST(floor(lon1 / 5) * 5 AS INT) AS lon, CAST(floor(lat1 / 5) * 5 AS INT) AS lat FROM ({DEGREES})), unnest(range(0, 25)) AS a(c), unnest(range(0, 25)) AS b(r)) GROUP BY row""", "footprints"))
def subgrid_cells(t: Tables) -> DataFrame:
    tiles = degrees(t).select((F.floor(F.col("lon1") / 5) * 5).cast("int").alias("lon_min"), (F.floor(F.col("lat1") / 5) * 5 + 5).cast("int").alias("lat_max")).distinct()
    return lod1.sub_cells(tiles).groupBy("row").agg(F.count("*").alias("cells"), F.min("cell").alias("first"), F.max("cell").alias("last"))


@query(with_tables(f"""SELECT source, round(sum((x2 - x1) * (y2 - y1)) / 1e12, 6) AS mercator_mkm2, round(sum(abs((ex2 - ex1) * (ey2 - ey1))) / 1e12, 6) AS equal_area_mkm2, round(max(abs(degrees(2 * atan(exp(y1 / 6378137.0)) - pi() / 2) - lat1)), 9) AS back FROM (
SELECT source, lat1, radians(lon1) * 6378137.0 AS x1, ln(tan(pi() / 4 + radians(lat1) / 2)) * 6378137.0 AS y1, radians(lon2) * 6378137.0 AS x2, ln(tan(pi() / 4 + radians(lat2) / 2)) * 6378137.0 AS y2,
radians(lon1) * 6378137.0 * 0.8667002562943853 AS ex1, radians(lon2) * 6378137.0 * 0.8667002562943853 AS ex2,
{"(1 - 0.0066943799901413165) * (sin(radians(lat1)) / (1 - 0.0066943799901413165 * sin(radians(lat1)) * sin(radians(lat1))) - ln((1 - 0.08181919084262149 * sin(radians(lat1))) / (1 + 0.08181919084262149 * sin(radians(lat1)))) / (2 * 0.08181919084262149)) * 6378137.0 / (2 * 0.8667002562943853)"} AS ey1,
{"(1 - 0.0066943799901413165) * (sin(radians(lat2)) / (1 - 0.0066943799901413165 * sin(radians(lat2)) * sin(radians(lat2))) - ln((1 - 0.08181919084262149 * sin(radians(lat2))) / (1 + 0.08181919084262149 * sin(radians(lat2)))) / (2 * 0.08181919084262149)) * 6378137.0 / (2 * 0.8667002562943853)"} AS ey2
FROM ({DEGREES})) GROUP BY source""", "footprints"))
def projected_areas(t: Tables) -> DataFrame:
    """Footprints' areas in the Mercator and in the equal-area plane, and the error of projecting back."""
    b = F.col("b")
    rows = degrees(t).withColumn("b", geo.box("lon1", "lat1", "lon2", "lat2"))
    back = F.abs(geo.latitude(geo.mercator_y("lat1")) - F.col("lat1"))
    return rows.groupBy("source").agg(R6(F.sum(geo.box_area(geo.mercator_box(b))) / 1e12).alias("mercator_mkm2"), R6(F.sum(geo.equal_area_of_box(b)) / 1e12).alias("equal_area_mkm2"), R6(F.max(back), 9).alias("back"))


@query("SELECT regexp_replace(coalesce(r_name, '') || '-' || coalesce(n_name, '') || '-' || coalesce(CASE WHEN c_acctbal > 0 THEN CAST(c_custkey % 3 AS VARCHAR) END, '') || '-', '-+$', '') AS roi_id, r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def district_ids(t: Tables) -> DataFrame:
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    key = geo.district_id("r_name", "n_name", F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 3), F.lit(None))
    return rows.select(key.alias("roi_id")).groupBy("roi_id").agg(F.count("*").alias("n")).withColumn("region", F.split("roi_id", "-")[0])


@query(with_tables(f"""SELECT count(*) AS boxes, CAST(sum(CASE WHEN a < -170 AND b > 170 THEN 2 ELSE 1 END) AS BIGINT) AS parts, round(sum(CASE WHEN a < -170 AND b > 170 THEN (a + 180) + (180 - b) ELSE b - a END), 6) AS width FROM (SELECT -170 - fid % 10 * 1.0 AS a, CASE WHEN fid % 3 = 0 THEN 170 + fid % 9 * 1.0 ELSE lon2 END AS b FROM ({DEGREES}))""", "footprints"))
def antimeridian_split(t: Tables) -> DataFrame:
    west = F.lit(-170.0) - F.col("fid") % 10
    east = F.when(F.col("fid") % 3 == 0, F.lit(170.0) + F.col("fid") % 9).otherwise(F.col("lon2"))
    rows = degrees(t).withColumn("parts", geo.split_at_180(geo.box(west, F.lit(0), east, F.lit(1))))
    width = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["x2"] - p["x1"])
    return rows.agg(F.count("*").alias("boxes"), F.sum(F.size("parts").cast("long")).alias("parts"), R6(F.sum(width)).alias("width"))


# heights ----------------------------------------------------------------------------------------------------------

LOD1 = ("pixels", "houses", "zonal")


@query(with_tables("SELECT fid, max(h) AS height, arg_min(v, (abs(v - top), row, col)) AS var FROM (SELECT *, max(h) OVER (PARTITION BY fid) AS top FROM zonal) GROUP BY fid", *LOD1))
def lod1_height(t: Tables) -> DataFrame:
    """Height and the variance whose value lies nearest to it."""
    return lod1.heights(lod1.zonal_pixels(t.houses().select("fid", "lbox"), t.pixels(), 10.0))


@query(with_tables("SELECT fid, max(h) AS height, arg_min(v, (-h, row, col)) AS var FROM zonal GROUP BY fid", *LOD1))
def lod1_variance_at_max(t: Tables) -> DataFrame:
    return lod1.heights(lod1.zonal_pixels(t.houses().select("fid", "lbox"), t.pixels(), 10.0), "at_max")


@query(with_tables("SELECT h.fid, coalesce(z.height, -999.0::DOUBLE) AS height FROM houses h LEFT JOIN (SELECT fid, max(h) AS height FROM zonal GROUP BY fid HAVING max(h) >= 0) z ON h.fid = z.fid", *LOD1))
def lod1_missing_raster(t: Tables) -> DataFrame:
    """All houses; the sentinel where the raster has no pixel under them."""
    found = lod1.heights(lod1.zonal_pixels(t.houses().select("fid", "lbox"), t.pixels(), 10.0), "at_max").where("height >= 0")
    return lod1.with_missing(t.houses().select("fid"), found).select("fid", "height")


_BLOCKS = 16


@query(with_tables("SELECT fid, max(h) AS height, arg_min(v, (abs(v - top), row, col)) AS var FROM (SELECT *, max(h) OVER (PARTITION BY fid) AS top FROM zonal) GROUP BY fid", *LOD1))
def block_height(t: Tables) -> DataFrame:
    """Heights as by pixel, from blocks of the raster."""
    return blocks.heights(blocks.zonal_blocks(t.houses().select("fid", "lbox"), blocks.blocks(t.pixels(), _BLOCKS), 10.0, _BLOCKS))


@query(with_tables("SELECT fid, max(h) AS height, arg_min(v, (-h, row, col)) AS var FROM zonal GROUP BY fid", *LOD1))
def block_variance_at_max(t: Tables) -> DataFrame:
    return blocks.heights(blocks.zonal_blocks(t.houses().select("fid", "lbox"), blocks.blocks(t.pixels(), _BLOCKS), 10.0, _BLOCKS), "at_max")


@query(with_tables("SELECT fid, max(h) AS height FROM zonal GROUP BY fid HAVING max(h) >= 45", *LOD1))
def tall_houses(t: Tables) -> DataFrame:
    """Blocks in the shared folder, of which only those that reach the height are read."""

    def job(folder: str) -> DataFrame:
        blocks.write_blocks(blocks.blocks(t.pixels(), _BLOCKS), folder)
        return blocks.taller(t.houses().select("fid", "lbox"), t.spark, folder, 45.0, 10.0, _BLOCKS)

    return through_folder(t.spark, job)


@query(with_tables("SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(h AS DOUBLE) AS h, CAST(v AS DOUBLE) AS v FROM pixels WHERE col >= 100 AND col < 171 AND row >= (SELECT CAST(floor(max(row) / 3.0) AS BIGINT) FROM pixels) AND row < (SELECT CAST(floor(max(row) / 3.0) AS BIGINT) + CAST(ceil((max(row) + 1) / 2.0) AS BIGINT) FROM pixels)", "pixels"))
def block_window(t: Tables) -> DataFrame:
    """A window over half of the raster's rows, read from the bands and blocks that it meets."""

    def job(folder: str) -> DataFrame:
        blocks.write_blocks(blocks.blocks(t.pixels(), _BLOCKS), folder, 2)
        n = raster.height_of(t.pixels())
        first, rows = (n - 1) // 3, -(-n // 2)
        met = blocks.read_blocks(t.spark, folder, (first, first + rows), (100, 171), side=_BLOCKS, band=2)
        return blocks.window(met, first, 100, rows, 71, _BLOCKS)

    return through_folder(t.spark, job)


@query(with_tables("SELECT c.cx, c.cy, count(*) AS features FROM houses, LATERAL unnest(range(CAST(floor(x1 / 200.0) AS BIGINT), CAST(floor(x2 / 200.0) AS BIGINT) + 1)) AS a(cx), LATERAL unnest(range(CAST(floor(y1 / 200.0) AS BIGINT), CAST(floor(y2 / 200.0) AS BIGINT) + 1)) AS b(cy), LATERAL (SELECT cx, cy) c GROUP BY ALL", "houses"))
def footprint_cells(t: Tables) -> DataFrame:
    """A footprint on a cell's edge belongs to every cell it touches."""
    rows = spatial.with_cells(t.houses(), "lbox", 200.0)
    return rows.groupBy("cx", "cy").agg(F.count("*").alias("features"))


# geometry ---------------------------------------------------------------------------------------------------------


def shapes(t: Tables) -> DataFrame:
    """Footprints as L-shaped rings: the box without its upper right quarter."""
    b, p = F.col("lbox"), geo.point
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    ring = F.array(p(b["x1"], b["y1"]), p(b["x2"], b["y1"]), p(b["x2"], my), p(mx, my), p(mx, b["y2"]), p(b["x1"], b["y2"]), p(b["x1"], b["y1"]))
    return t.footprints().withColumn("ring", ring).withColumn("ring_id", F.col("fid"))


@query(with_tables("SELECT source, round(sum((x2 - x1) * (y2 - y1) * 0.75), 6) AS area, round(sum(2.0 * (x2 - x1 + y2 - y1)), 6) AS perimeter, CAST(min(x1) AS DOUBLE) AS x_min, CAST(max(y2) AS DOUBLE) AS y_max, count(*) AS clockwise, round(sum(greatest(sqrt((x2 - x1)^2 + ((y2 - y1) / 2.0)^2), sqrt(((x2 - x1) / 2.0)^2 + (y2 - y1)^2), sqrt((x2 - x1)^2 + (y2 - y1)^2))), 4) AS diameters FROM footprints GROUP BY source", "footprints"))
def ring_measures(t: Tables) -> DataFrame:
    """Area, perimeter, bounds, orientation and diameter of L-shapes turned clockwise."""
    rows = shapes(t).withColumn("ring", geo.oriented(F.col("ring"), clockwise=True)).withColumn("b", geo.bounds(F.array("ring")))
    polygon = F.array("ring")
    return rows.groupBy("source").agg(R6(F.sum(geo.polygon_area(polygon))).alias("area"), R6(F.sum(geo.polygon_perimeter(polygon))).alias("perimeter"), F.min("b.x1").alias("x_min"), F.max("b.y2").alias("y_max"), F.count_if(geo.signed_area(F.col("ring")) < 0).alias("clockwise"), R6(F.sum(geo.diameter(F.col("ring"))), 4).alias("diameters"))


@query(with_tables("SELECT a.source, count(*) AS pairs, round(sum(CASE WHEN (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i > 0 THEN i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i) ELSE 0 END), 6) AS iou, round(sum(i / ((a.x2 - a.x1) * (a.y2 - a.y1))), 6) AS half_iou FROM footprints a JOIN houses b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2, LATERAL (SELECT CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS i) GROUP BY a.source", "footprints", "houses"))
def polygon_iou(t: Tables) -> DataFrame:
    """IoU and half IoU of footprints and houses that meet, by the exact polygon function."""
    box = F.array(geo.ring_of_box(F.col("lbox"))).alias("rings")
    left, right = t.footprints().select("fid", "source", "lbox", box), t.houses().select("fid", F.col("lbox").alias("rbox"), box)
    rows = pairs.met_sums(left.withColumn("a", geo.box_area(F.col("lbox"))), right, SIDE, ["source", "a"])
    return rows.groupBy("source").agg(F.sum("pairs").alias("pairs"), R6(F.sum("iou")).alias("iou"), R6(F.sum(F.col("shared") / F.col("a"))).alias("half_iou"))


@query(with_tables("SELECT source, count(*) FILTER (l AND d) AS kept, round(sum(CASE WHEN l AND d THEN w * h - greatest(0, w - (x2 - x1) / 2.0) * greatest(0, h - (y2 - y1) / 2.0) ELSE 0 END), 6) AS area FROM (SELECT *, least(x2, 2500) - x1 AS w, least(y2, 2500) - y1 AS h, x1 < 2500 AS l, y1 < 2500 AS d FROM footprints) GROUP BY source", "footprints"))
def clipped_shapes(t: Tables) -> DataFrame:
    """L-shapes cut by a box."""
    rows = shapes(t).where(geo.boxes_cross(F.col("lbox"), geo.box(F.lit(0), F.lit(0), F.lit(2500), F.lit(2500))))
    cut = rows.withColumn("rings", polygons.clipped(F.array("ring"), F.lit(0.0), F.lit(0.0), F.lit(2500.0), F.lit(2500.0))).where(F.size("rings") > 0)
    return cut.groupBy("source").agg(F.count("*").alias("kept"), R6(F.sum(geo.polygon_area(F.col("rings")))).alias("area"))


_FEET = "footprints2 AS (SELECT fid, x1, y1, x2, y2, (x2 - x1) / 4.0 AS w, (y2 - y1) / 4.0 AS h FROM footprints)"


@query(with_tables(f"""SELECT fid, CAST(part AS INTEGER) AS part, CAST(area AS DOUBLE) AS area, CAST(a AS DOUBLE) AS x_min, CAST(b AS DOUBLE) AS x_max, CAST(c AS DOUBLE) AS y_min FROM (
SELECT fid, 0 AS part, w * 2 * h AS area, x2 - w AS a, x2 AS b, y1 + 2 * h AS c FROM footprints2 WHERE fid % 3 = 0 UNION ALL SELECT fid, 1, w * 2 * h, x1, x1 + w, y1 + 2 * h FROM footprints2 WHERE fid % 3 = 0
UNION ALL SELECT fid, 0, 10 * w * h, x1, x2, y1 FROM footprints2 WHERE fid % 3 = 1 UNION ALL SELECT fid, 0, 6 * w * h, x1 + w, x2, y1 FROM footprints2 WHERE fid % 3 = 2)""", "footprints").replace("\nSELECT", f", {_FEET}\nSELECT", 1))
def clipped_parts(t: Tables) -> DataFrame:
    """U-shapes cut through their arms (two parts), not at all, or along the inner side of one arm."""
    b, p = F.col("lbox"), geo.point
    w, h = (b["x2"] - b["x1"]) / 4, (b["y2"] - b["y1"]) / 4
    ring = F.array(p(b["x1"], b["y1"]), p(b["x2"], b["y1"]), p(b["x2"], b["y2"]), p(b["x2"] - w, b["y2"]), p(b["x2"] - w, b["y1"] + h), p(b["x1"] + w, b["y1"] + h), p(b["x1"] + w, b["y2"]), p(b["x1"], b["y2"]), p(b["x1"], b["y1"]))
    k = F.col("fid") % 3
    frame = geo.box(F.when(k == 2, b["x1"] + w).otherwise(b["x1"] - 1), F.when(k == 0, b["y1"] + 2 * h).otherwise(b["y1"] - 1), b["x2"] + 1, b["y2"] + 1)
    parts = clipping.clip_parts(t.footprints().select(F.col("fid").alias("id"), F.array(ring).alias("rings"), frame.alias("frame"))).withColumn("b", geo.bounds(F.col("rings")))
    return parts.select(F.col("id").alias("fid"), "part", geo.polygon_area(F.col("rings")).alias("area"), F.col("b.x1").alias("x_min"), F.col("b.x2").alias("x_max"), F.col("b.y1").alias("y_min"))


@query(with_tables("SELECT source, count(*) FILTER (x1 >= 1000 AND y1 >= 1000 AND x2 < 2000 AND y2 < 2000) AS within, count(*) FILTER (x1 <= 2000 AND x2 >= 1000 AND y1 <= 2000 AND y2 >= 1000) AS meeting, count(*) FILTER (x1 < 2000 AND x2 > 1000 AND y1 < 2000 AND y2 > 1000) AS crossing, round(sum((x2 - x1) * (y2 - y1) * 2.25), 6) AS scaled, round(sum((x2 - x1 + 4.0) * (y2 - y1 + 4)), 6) AS padded, round(sum((x1 + x2) / 2.0 + (y2 - y1)), 6) AS centred FROM footprints GROUP BY source", "footprints"))
def box_filters(t: Tables) -> DataFrame:
    """Half-open, inclusive and exclusive box tests; scaled, padded and converted boxes."""
    b, w = F.col("lbox"), geo.box(F.lit(1000), F.lit(1000), F.lit(2000), F.lit(2000))
    c = geo.converted_box(b, "XYXY", "CXCYWH")
    return t.footprints().groupBy("source").agg(F.count_if(geo.box_within(b, w)).alias("within"), F.count_if(geo.boxes_meet(b, w)).alias("meeting"), F.count_if(geo.boxes_cross(b, w)).alias("crossing"), R6(F.sum(geo.box_area(geo.scaled_box(b, 1.5)))).alias("scaled"), R6(F.sum(geo.box_area(geo.padded_box(b, 2.0)))).alias("padded"), R6(F.sum(c["x1"] + c["y2"])).alias("centred"))


@query(with_tables("SELECT fid % 3 AS k, count(*) AS inside FROM footprints WHERE (x1 + x2) / 2.0 - x1 > 0 AND NOT (fid % 3 = 0) GROUP BY 1 UNION ALL SELECT 0, 0 WHERE false", "footprints"))
def points_in_shapes(t: Tables) -> DataFrame:
    """Winding numbers: a point in the cut-away quarter is outside, others are inside."""
    b = F.col("lbox")
    x = F.when(F.col("fid") % 3 == 0, b["x2"] - 0.25).otherwise(b["x1"] + 0.25)
    y = F.when(F.col("fid") % 3 == 0, b["y2"] - 0.25).otherwise(b["y1"] + 0.25)
    rows = shapes(t).withColumn("w", geo.winding_number(F.col("ring"), x, y)).where("w <> 0")
    return rows.groupBy((F.col("fid") % 3).alias("k")).agg(F.count("*").alias("inside"))


KITES = ("footprints", "kites")
_CORNER = "FROM kites c JOIN kites p ON p.fid = c.fid AND p.pos = (c.pos + 3) % 4"


@query(with_tables(f"SELECT source, count(*) AS vertices, round(sum(angle), 5) AS angles, round(sum(angle * (pos + 1)), 5) AS weighed, round(sum(len), 5) AS perimeter FROM (SELECT c.source, c.pos, c.len, degrees(acos(((p.ax - p.cx) * (c.cx - c.ax) + (p.ay - p.cy) * (c.cy - c.ay)) / (p.len * c.len))) AS angle {_CORNER}) GROUP BY source", *KITES))
def vertex_angles(t: Tables) -> DataFrame:
    """Angles at the vertices of irregular rings, by place, and lengths along the ring."""
    v = rings.vertex_angles(t.kites(), "ring_id", "source")
    return v.groupBy("source").agg(F.count("*").alias("vertices"), R6(F.sum("angle"), 5).alias("angles"), R6(F.sum(F.col("angle") * (F.col("pos") + 1)), 5).alias("weighed"), R6(F.sum("len"), 5).alias("perimeter"))


_ALONG = "SELECT *, coalesce(sum(len) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY fid) AS per FROM kites"


@query(with_tables(f"SELECT fid AS ring_id, count(*) AS points, round(sum(ax + least(1, (spot - start) / len) * (cx - ax)), 5) AS x, round(sum((i + 1) * (ay + least(1, (spot - start) / len) * (cy - ay))), 5) AS y FROM (SELECT e.*, i, CASE WHEN i = n - 1 THEN 0 ELSE i / (n - 1) * per END AS spot FROM (SELECT *, greatest(8, least(20, CAST(round(per / 4) AS INT))) AS n FROM ({_ALONG})) e, unnest(range(0, n)) AS t(i)) WHERE spot >= start AND (spot < start + len OR pos = 3) GROUP BY fid", *KITES))
def ring_resampling(t: Tables) -> DataFrame:
    """Evenly spaced points of irregular rings: their number, places and order."""
    points = rings.resampled(t.kites().select("ring_id", "ring"), 4.0, 8, 20)
    return points.groupBy("ring_id").agg(F.count("*").alias("points"), R6(F.sum("x"), 5).alias("x"), R6(F.sum((F.col("i") + 1) * F.col("y")), 5).alias("y"))


@query(with_tables("SELECT source, count(*) AS points, round(sum(ax + k / n * (cx - ax)), 4) AS x, round(sum((pos + 1) * (ay + k / n * (cy - ay))), 4) AS y FROM (SELECT *, greatest(1, CAST(ceil(len / 3.0) AS INT)) AS n FROM kites), unnest(range(0, n)) AS t(k) GROUP BY source", *KITES))
def densified_rings(t: Tables) -> DataFrame:
    """Edges of irregular rings cut into equal parts: the points' number and places."""
    # the source comes along: a join back would broadcast all footprints
    return rings.densified(t.kites(), 3.0, "ring_id", "source").groupBy("source").agg(F.count("*").alias("points"), R6(F.sum("x"), 4).alias("x"), R6(F.sum((F.col("pos") + 1) * F.col("y")), 4).alias("y"))


_T = "greatest(0, least(1, ((px - ax) * (cx - ax) + (py - ay) * (cy - ay)) / (len * len)))"


@query(with_tables(f"SELECT fid AS ring_id, round(min(d), 6) AS distance, round(arg_min(x, (d, pos)), 6) AS x, round(arg_min(y, (d, pos)), 6) AS y FROM (SELECT fid, pos, x, y, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM (SELECT *, ax + {_T} * (cx - ax) AS x, ay + {_T} * (cy - ay) AS y FROM (SELECT k.*, x1 + f.fid % 9 - 2 AS px, y1 + f.fid % 11 - 3 AS py FROM kites k JOIN footprints f ON f.fid = k.fid))) GROUP BY fid", *KITES))
def contour_projection(t: Tables) -> DataFrame:
    """Points around and inside irregular rings, moved to the nearest point of the contour."""
    points = t.footprints().select(F.col("fid").alias("ring_id"), F.lit(0).alias("pid"), (F.col("x1") + F.col("fid") % 9 - 2).cast("double").alias("px"), (F.col("y1") + F.col("fid") % 11 - 3).cast("double").alias("py"))
    found = rings.projected(points, rings.edge_table(t.kites().select("ring_id", "ring")), "ring_id")
    return found.select("ring_id", R6(F.col("distance")).alias("distance"), R6(F.col("x")).alias("x"), R6(F.col("y")).alias("y"))


@query(with_tables("SELECT fid AS ring_id, 6 AS places, round(2 * x1 + 2 * x2 + (x1 + x2) / 2.0 * 2, 6) AS sum_x FROM footprints", "footprints"))
def segment_round_trip(t: Tables) -> DataFrame:
    """Rings cut into overlapping runs and put together again."""
    e = rings.edge_table(shapes(t).select("ring_id", "ring"))
    parts = rings.segments(e.select("ring_id", "pos", F.col("ax").alias("x"), F.col("ay").alias("y")), 4, 2)
    return rings.assembled(parts).groupBy("ring_id").agg(F.count("*").cast("int").alias("places"), R6(F.sum("x")).alias("sum_x"))


_D = "CASE fid % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.05 ELSE 0.4 END"
_MX, _MY = "(x1 + x2) / 2.0", "(y1 + y2) / 2.0"


@query(with_tables(f"SELECT source, count(*) AS valid, CAST(sum(CASE WHEN fid % 3 = 2 THEN 13 ELSE 7 END) AS BIGINT) AS points, round(sum(3 * x1 + 2 * x2 + 2 * {_MX} + CASE WHEN fid % 3 = 2 THEN {_MX} + x2 + (x2 + {_MX}) / 2 + {_MX} + (x1 + {_MX}) / 2 + x1 + 6 * {_D} ELSE 0 END), 4) AS x, CAST(sum(CASE WHEN fid % 3 = 2 THEN 13 ELSE 7 END) AS BIGINT) AS cyclic_points, round(sum(2 * y1 + 2 * {_MY} + 2 * y2 + CASE WHEN fid % 3 = 2 THEN y1 + (y1 + {_MY}) / 2 + {_MY} + (y2 + {_MY}) / 2 + y2 + {_MY} + 6 * {_D} ELSE 0 END), 4) AS cyclic_y FROM footprints GROUP BY source", "footprints"))
def simplified_shapes(t: Tables) -> DataFrame:
    """L-shapes with a point beside the middle of every edge, on it, near it or too far to be left out: both simplifications keep what they should, and the results are valid."""
    d = F.expr(_D).cast("double")
    halves = F.flatten(F.transform(geo.edges(F.col("ring")), lambda e: F.array(e["a"], geo.point((e["a"]["x"] + e["b"]["x"]) / 2 + d, (e["a"]["y"] + e["b"]["y"]) / 2 + d))))
    rows = shapes(t).withColumn("dense", F.array(F.concat(halves, F.array(F.col("ring")[0]))))
    done = rows.select("source", polygons.simplified("dense", 0.1).alias("s"), polygons.simplified_cyclic("dense", 0.2).alias("c"))
    total = lambda c, k, open_: F.aggregate(F.slice(F.col(c)[0], 1, F.size(F.col(c)[0]) - open_), F.lit(0.0), lambda acc, p: acc + p[k])
    # the cyclic one may begin anywhere, so its closing point is left out
    return done.where(polygons.valid("s") & polygons.valid("c")).groupBy("source").agg(
        F.count("*").alias("valid"), F.sum(F.size(F.col("s")[0]).cast("long")).alias("points"), R6(F.sum(total("s", "x", 0)), 4).alias("x"), F.sum(F.size(F.col("c")[0]).cast("long")).alias("cyclic_points"), R6(F.sum(total("c", "y", 1)), 4).alias("cyclic_y")
    )


# polygons all the way ---------------------------------------------------------------------------------------------

#: Two rectangles that make an L-shape: the lower half and the upper left quarter.
_RECTS = "rects AS (SELECT fid, source, x1 AS a1, y1 AS b1, x2 AS a2, (y1 + y2) / 2.0 AS b2 FROM footprints UNION ALL SELECT fid, source, x1, (y1 + y2) / 2.0, (x1 + x2) / 2.0, y2 FROM footprints)"
_MEET = "{0}.a1 <= {1}.a2 AND {1}.a1 <= {0}.a2 AND {0}.b1 <= {1}.b2 AND {1}.b1 <= {0}.b2"
_SHARED = "greatest(0, least({0}.a2, {1}.a2) - greatest({0}.a1, {1}.a1)) * greatest(0, least({0}.b2, {1}.b2) - greatest({0}.b1, {1}.b1))"
_SHAPES = f"""{_RECTS},
box AS (SELECT rx1 AS a1, ry1 AS b1, rx2 AS a2, ry2 AS b2, roi_id, region FROM districts),
lcrop AS (SELECT DISTINCT r.fid, r.source, box.roi_id, box.region FROM rects r JOIN box ON {_MEET.format("r", "box")}),
lpairs AS (SELECT c.roi_id, c.source, c.fid, m.fid AS main_fid, CAST(sum({_SHARED.format("p", "q")}) AS DOUBLE) AS shared FROM lcrop c JOIN rects p ON p.fid = c.fid JOIN rects q ON {_MEET.format("p", "q")} JOIN lcrop m ON m.fid = q.fid AND m.roi_id = c.roi_id WHERE c.source <> 'osm' AND m.source = 'osm' GROUP BY ALL),
larea AS (SELECT l.*, (x2 - x1) * (y2 - y1) * 0.75 AS area, o.overlap FROM lcrop l JOIN footprints f ON l.fid = f.fid LEFT JOIN (SELECT roi_id, fid, sum(shared) AS overlap FROM lpairs GROUP BY ALL) o ON o.roi_id = l.roi_id AND o.fid = l.fid),
lquality AS (SELECT roi_id, source, count(*) AS features, CAST(sum(area) AS DOUBLE) AS area, count(overlap) AS matched, coalesce(sum(overlap), 0.0::DOUBLE) AS overlap, CAST(sum(CASE WHEN overlap IS NULL THEN area ELSE 0 END) AS DOUBLE) AS added FROM larea GROUP BY ALL),
lbest AS (SELECT roi_id, source FROM (SELECT *, row_number() OVER (PARTITION BY roi_id ORDER BY overlap + added DESC, list_position(['ms', 'ours2', 'google'], source)) AS n FROM lquality WHERE source IN ('ms', 'ours2', 'google')) WHERE n = 1)"""


def shape_crop(t: Tables) -> DataFrame:
    left = shapes(t).select("fid", "source", "lbox", F.array("ring").alias("rings"))
    return fusion.crop(left, t.districts().withColumn("rrings", F.array(geo.ring_of_box(F.col("rbox")))), SIDE)


#: Half the width of a diamond of 2,560 points a side, so that no coordinate is rounded.
REACH, STEPS = 640, 2560


@query(with_tables(f"SELECT roi_id, region, source, count(*) AS features, CAST(sum(fid) AS BIGINT) AS fids FROM footprints f JOIN districts d ON greatest(0, x1 - rx1 - 500, rx1 + 500 - x2) + greatest(0, y1 - ry1 - 500, ry1 + 500 - y2) <= {REACH} GROUP BY ALL", *FUSION[:2]))
def diamond_districts(t: Tables) -> DataFrame:
    """Footprints cropped to districts of 10,240 points each, as boxes' polygons; touching counts."""
    x, y = F.col("rbox.x1") + 500, F.col("rbox.y1") + 500
    steps = F.sequence(F.lit(0), F.lit(STEPS - 1))
    corners = [(1, 0), (0, 1), (-1, 0), (0, -1)]

    def along(p: tuple[int, int], q: tuple[int, int]) -> Column:
        return F.transform(steps, lambda i: geo.point(x + (p[0] * (STEPS - i) + q[0] * i) * REACH / STEPS, y + (p[1] * (STEPS - i) + q[1] * i) * REACH / STEPS))

    sides = [along(p, q) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)]
    ring = F.concat(*sides, F.array(geo.point(x + REACH, y)))
    districts = t.districts().select("roi_id", "region", F.array(ring).alias("rrings"))
    rows = t.footprints().withColumn("rings", F.array(geo.ring_of_box(F.col("lbox"))))
    return fusion.crop(rows, districts, SIDE).groupBy("roi_id", "region", "source").agg(F.count("*").alias("features"), F.sum("fid").alias("fids"))


def _shapes_sql(sql: str) -> str:
    head, _, tail = with_tables(sql, "footprints", "districts").rpartition("\n" + sql)
    return f"{head},\n{_SHAPES}\n{sql}{tail}"


@query(_shapes_sql("SELECT *, overlap + added AS quality FROM lquality WHERE source <> 'osm'"))
def shape_quality(t: Tables) -> DataFrame:
    """Crop, overlap and area of L-shapes, not of their boxes."""
    c = raster.checkpointed(shape_crop(t))
    return fusion.quality_of(c, fusion.met(c, "osm", SIDE)).where("source <> 'osm'")


@query(_shapes_sql("SELECT region, source, count(*) AS features, CAST(sum(area) AS DOUBLE) AS area FROM (SELECT region, source, area FROM larea WHERE source = 'osm' UNION ALL SELECT region, l.source, area FROM larea l JOIN lbest b ON l.roi_id = b.roi_id AND l.source = b.source WHERE overlap IS NULL) GROUP BY ALL"))
def fuse_shapes(t: Tables) -> DataFrame:
    """The whole fusion by polygons."""
    fused = fusion.fuse(shape_crop(t), "osm", SIDE)
    return fused.groupBy("region", "source").agg(F.count("*").alias("features"), F.sum(geo.polygon_area(F.col("rings"))).alias("area"))


_HOUSE = "house AS (SELECT fid AS hid, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM houses)"


@query(with_tables(f"SELECT source, count(*) AS pairs, round(sum(i), 6) AS shared, round(sum(i / (area + (a2 - a1) * (b2 - b1) - i)), 6) AS iou FROM (SELECT r.source, r.fid, house.*, sum({_SHARED.format('r', 'house')}) AS i, any_value((x2 - x1) * (y2 - y1) * 0.75) AS area FROM rects r JOIN house ON {_MEET.format('r', 'house')} JOIN footprints f ON f.fid = r.fid GROUP BY ALL) GROUP BY source", "footprints", "houses").replace("\nSELECT", f", {_RECTS}, {_HOUSE}\nSELECT", 1))
def shape_iou(t: Tables) -> DataFrame:
    """L-shapes and boxes that meet, touching included, and their IoU."""
    left = shapes(t).select("fid", "source", "lbox", F.array("ring").alias("rings"))
    right = t.houses().select("fid", F.col("lbox").alias("rbox"), F.array(geo.ring_of_box(F.col("lbox"))).alias("rings"))
    rows = pairs.met_sums(left, right, SIDE, ["source"])
    return rows.groupBy("source").agg(F.sum("pairs").alias("pairs"), R6(F.sum("shared")).alias("shared"), R6(F.sum("iou")).alias("iou"))


def lshaped_houses(t: Tables) -> DataFrame:
    b, p = F.col("lbox"), geo.point
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    ring = F.array(p(b["x1"], b["y1"]), p(b["x2"], b["y1"]), p(b["x2"], my), p(mx, my), p(mx, b["y2"]), p(b["x1"], b["y2"]), p(b["x1"], b["y1"]))
    return t.houses().select("fid", "lbox", F.array(ring).alias("rings"))


_COVERED = "SELECT DISTINCT fid, r.row, c.col FROM (SELECT fid, x1 AS a1, y1 AS b1, x2 AS a2, (y1 + y2) / 2.0 AS b2 FROM houses UNION ALL SELECT fid, x1, (y1 + y2) / 2.0, (x1 + x2) / 2.0, y2 FROM houses), LATERAL unnest(range(CAST(floor(b1 / 10.0) AS BIGINT), CAST(ceil(b2 / 10.0) AS BIGINT))) AS r(row), LATERAL unnest(range(CAST(floor(a1 / 10.0) AS BIGINT), CAST(ceil(a2 / 10.0) AS BIGINT))) AS c(col)"


@query(with_tables(f"SELECT fid, max(h) AS height, arg_min(v, (-h, row, col)) AS var, count(*) AS n FROM (SELECT z.*, coalesce(CAST(p.h AS DOUBLE), -1) AS h, coalesce(CAST(p.v AS DOUBLE), -1) AS v FROM ({_COVERED}) z LEFT JOIN pixels p ON z.row = p.row AND z.col = p.col) GROUP BY fid", "pixels", "houses"))
def lod1_shape_height(t: Tables) -> DataFrame:
    """Height of the pixels that an L-shape covers in part or whole, not of its rectangle."""
    zonal = lod1.zonal_pixels(lshaped_houses(t), t.pixels(), 10.0)
    return lod1.heights(zonal, "at_max").join(zonal.groupBy("fid").agg(F.count("*").alias("n")), "fid")


@query(with_tables(f"SELECT fid, max(h) AS height, arg_min(v, (-h, row, col)) AS var, count(*) AS n FROM (SELECT z.*, coalesce(CAST(p.h AS DOUBLE), -1) AS h, coalesce(CAST(p.v AS DOUBLE), -1) AS v FROM ({_COVERED}) z LEFT JOIN pixels p ON z.row = p.row AND z.col = p.col) GROUP BY fid", "pixels", "houses"))
def block_shape_height(t: Tables) -> DataFrame:
    """The same from blocks of the raster."""
    zonal = blocks.zonal_blocks(lshaped_houses(t), blocks.blocks(t.pixels(), _BLOCKS), 10.0, _BLOCKS)
    return blocks.heights(zonal, "at_max").join(zonal.groupBy("fid").agg(F.sum(F.size("px").cast("long")).alias("n")), "fid")


@query(with_tables(f"SELECT row, col, max(fid % 60) AS value FROM ({_COVERED}) GROUP BY ALL", "houses"))
def rasterised_shapes(t: Tables) -> DataFrame:
    from ..operators import raster

    return raster.rasterised(lshaped_houses(t).withColumn("value", F.col("fid") % 60), "value", 10.0)


_WRAP = "[-170 - fid % 9, 170 + fid % 8, 170 + fid % 7, -170 - fid % 10]"


@query(with_tables(f"SELECT fid, CASE WHEN w THEN 2 ELSE 1 END AS parts, round(list_sum(CASE WHEN w THEN list_transform(xs, lambda x: CASE WHEN x < 0 THEN least(x + 360, 180) ELSE x END) ELSE xs END), 6) AS east, round(CASE WHEN w THEN list_sum(list_transform(xs, lambda x: CASE WHEN x > 0 THEN greatest(x - 360, -180) ELSE x END)) END, 6) AS west FROM (SELECT fid, xs, list_min(xs) < -170 AND list_max(xs) > 170 AS w FROM (SELECT fid, CAST(CASE WHEN fid % 3 = 0 THEN {_WRAP} ELSE [x1 / 100.0, x2 / 100.0, x2 / 100.0, x1 / 100.0] END AS DOUBLE[]) AS xs FROM footprints))", "footprints"))
def antimeridian_polygons(t: Tables) -> DataFrame:
    """Rings that reach over the antimeridian in two parts; the sum of the longitudes of each part's corners."""
    corners = [(-170 - F.col("fid") % 9, F.col("x1") / 100), (170 + F.col("fid") % 8, F.col("x2") / 100), (170 + F.col("fid") % 7, F.col("x2") / 100), (-170 - F.col("fid") % 10, F.col("x1") / 100)]
    points = [geo.point(F.when(F.col("fid") % 3 == 0, wrap).otherwise(x), F.col(y) / 100) for (wrap, x), y in zip(corners, ("y1", "y1", "y2", "y2"), strict=True)]
    rows = t.footprints().select("fid", geo.split_polygon_at_180(F.array(*points, points[0])).alias("parts"))
    total = lambda i: F.aggregate(F.slice(F.get("parts", i), 1, 4), F.lit(0.0), lambda acc, p: acc + p["x"])
    return rows.select("fid", F.size("parts").alias("parts"), R6(total(0)).alias("east"), R6(total(1)).alias("west"))


_CX, _CY = "x1 + fid % 41 - 6", "y1 + (fid % 2) * (fid % 3)"


@query(with_tables(f"SELECT source, count(*) FILTER ({_CY} = y1 AND greatest(x1, {_CX}) < least(x2, {_CX} + 4)) AS overlapping, count(*) FILTER ({_CY} = y1 AND greatest(x1, {_CX}) <= least(x2, {_CX} + 4)) AS meeting FROM footprints GROUP BY source", "footprints"))
def overlapping_edges(t: Tables) -> DataFrame:
    """Lower edges of boxes and segments beside, on or partly on them: which share a stretch, and which at least a point."""
    b, x, y = F.col("lbox"), F.expr(_CX), F.expr(_CY)
    ends = geo.point(b["x1"], b["y1"]), geo.point(b["x2"], b["y1"]), geo.point(x + 4, y), geo.point(x, y)
    return t.footprints().groupBy("source").agg(F.count_if(geo.segments_overlap(*ends)).alias("overlapping"), F.count_if(geo.segments_cross(*ends)).alias("meeting"))
