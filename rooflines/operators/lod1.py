"""Heights for footprints: cells, raster pixels under a footprint, the highest one and its uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .raster import spread

MISSING = -999.0
OUTSIDE = -1.0


def sub_cells(tiles: DataFrame, per_side: int = 25, tenths: int = 2) -> DataFrame:
    """tiles (lon_min, lat_max, whole degrees) as their cells: edges in tenths of a degree, a name, Mercator corners."""
    grid = tiles.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1))))
    west, north = F.col("lon_min") * 10 + F.col("col") * tenths, F.col("lat_max") * 10 - F.col("row") * tenths
    edges = {"w10": west, "n10": north, "e10": west + tenths, "s10": north - tenths}
    named = F.concat_ws("_", *(F.format_string("%.1f", e / 10) for e in edges.values()))
    return grid.select(*tiles.columns, "row", "col", *(e.alias(k) for k, e in edges.items()), named.alias("cell"), geo.mercator_box(geo.box(west / 10, (north - tenths) / 10, (west + tenths) / 10, north / 10)).alias("mercator"))


def zonal_pixels(footprints: DataFrame, pixels: DataFrame, size: float) -> DataFrame:
    """footprints (fid, lbox) by the pixels under them, those only partly covered included, with h and v; OUTSIDE where the raster has none.

    A footprint lists its pixels' places, and these join the raster's (row, col) by hash; pixels beyond the raster count as
    OUTSIDE. With the polygon (rings) only the pixels that it covers in part or whole are listed, else those of its rectangle.
    """
    b = F.col("lbox")
    span = lambda lo, hi: F.sequence(F.floor(b[lo] / size), F.greatest(F.floor(b[lo] / size), F.ceil(b[hi] / size) - 1))
    places = spread(footprints).withColumn("col", F.explode(span("x1", "x2"))).withColumn("row", F.explode(span("y1", "y2")))
    if "rings" in footprints.columns:
        x, y = F.col("col") * size, F.col("row") * size
        places = places.where(geo.polygon_crosses_box(F.col("rings"), geo.box(x, y, x + size, y + size))).drop("rings")
    values = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "h", "v")
    out = places.join(values, ["row", "col"], "left")
    return out.withColumn("h", F.coalesce(F.col("h").cast("double"), F.lit(OUTSIDE))).withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(OUTSIDE)))


def heights(zonal: DataFrame, pick: str = "nearest_value") -> DataFrame:
    """By fid: height (the highest pixel) and var: the variance whose value lies nearest to the height, the first by place (nearest_value), or that of the first highest pixel (at_max)."""
    top = zonal.groupBy("fid").agg(F.max("h").alias("height"))
    if pick == "at_max":
        return zonal.groupBy("fid").agg(F.max("h").alias("height"), F.min_by("v", F.struct(-F.col("h"), "row", "col")).alias("var"))
    both = zonal.join(top, "fid")
    return both.groupBy("fid").agg(F.max("height").alias("height"), F.min_by("v", F.struct(F.abs(F.col("v") - F.col("height")), F.col("row"), F.col("col"))).alias("var"))


def with_missing(footprints: DataFrame, found: DataFrame) -> DataFrame:
    """All footprints; MISSING where no raster was read."""
    out = footprints.join(found, "fid", "left")
    return out.withColumn("height", F.coalesce("height", F.lit(MISSING))).withColumn("var", F.coalesce("var", F.lit(MISSING)))
