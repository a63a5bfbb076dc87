"""Rasters as tables of blocks: array slices with their extremes, stored by band so that a read skips what it can't need.

A block is a square of `side` x `side` pixels: brow, bcol, top (its highest h), h and v (row by row; OUTSIDE where the raster has
no pixel). Footprints are joined to blocks, one row for each block under a footprint, and its pixels are cut out of the arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from .lod1 import OUTSIDE

SIDE = 64
#: Rows of blocks that share a folder.
BAND = 8
BLOCK = "brow long, bcol long, top double, h array<double>, v array<double>"


def blocks(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """pixels (row, col, h, v) as blocks; where a place comes twice, the highest counts."""

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        place = (rows["row"] % side * side + rows["col"] % side).to_numpy()
        order = rows["h"].fillna(OUTSIDE).to_numpy().argsort(kind="stable")
        h, v = np.full(side * side, OUTSIDE), np.full(side * side, OUTSIDE)
        for out, name in ((h, "h"), (v, "v")):
            out[place[order]] = rows[name].fillna(OUTSIDE).to_numpy()[order]
        return pd.DataFrame({"brow": rows["row"].iloc[:1] // side, "bcol": rows["col"].iloc[:1] // side, "top": h.max(), "h": [h], "v": [v]})

    at = lambda c: F.floor(F.col(c) / side)
    narrow = pixels.select(*(F.col(c).cast("long").alias(c) for c in ("row", "col")), *(F.col(c).cast("double").alias(c) for c in ("h", "v")))
    return narrow.groupBy(at("row").alias("brow"), at("col").alias("bcol")).applyInPandas(filled, BLOCK)  # side * side pixels a group


def write_blocks(made: DataFrame, folder: str, band: int = BAND) -> None:
    """Parquet, a folder for each band of blocks; sorted, so that the files' statistics tell blocks apart too."""
    banded = made.withColumn("band", F.floor(F.col("brow") / band))
    banded.repartitionByRange("band", "bcol").sortWithinPartitions("band", "bcol", "brow").write.partitionBy("band").parquet(folder)


def read_blocks(spark: SparkSession, folder: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, least: float | None = None, side: int = SIDE, band: int = BAND) -> DataFrame:
    """The blocks that pixels of the half-open rows and cols lie in, and that reach least somewhere: other bands' files aren't listed, other row groups not read."""
    out = spark.read.parquet(folder)
    if rows is not None:
        first, last = rows[0] // side, (rows[1] - 1) // side
        out = out.where(F.col("band").between(first // band, last // band) & F.col("brow").between(first, last))
    if cols is not None:
        out = out.where(F.col("bcol").between(cols[0] // side, (cols[1] - 1) // side))
    if least is not None:
        out = out.where(F.col("top") >= least)
    return out.drop("band")


def _cut_out(first_row: Column, last_row: Column, first_col: Column, last_col: Column, side: int) -> Column:
    """array<struct<row, col, h, v>>: the block's pixels in a window, which lies in the block."""
    wide = (last_col - first_col + 1).cast("int")

    def one(row: Column) -> Column:
        start = ((row - F.col("brow") * side) * side + first_col - F.col("bcol") * side + 1).cast("int")
        both = F.arrays_zip(F.slice("h", start, wide).alias("h"), F.slice("v", start, wide).alias("v"))
        return F.transform(both, lambda p, i: F.struct(row.alias("row"), (first_col + i).alias("col"), p["h"].alias("h"), p["v"].alias("v")))

    return F.flatten(F.transform(F.sequence(first_row, last_row), one))


def window(found: DataFrame, row0: int, col0: int, height: int, width: int, side: int = SIDE) -> DataFrame:
    """The pixels (row, col, h, v) of a window, of the blocks that it meets; places without a pixel don't come."""
    lo_r, hi_r = F.greatest(F.lit(row0), F.col("brow") * side), F.least(F.lit(row0 + height - 1), (F.col("brow") + 1) * side - 1)
    lo_c, hi_c = F.greatest(F.lit(col0), F.col("bcol") * side), F.least(F.lit(col0 + width - 1), (F.col("bcol") + 1) * side - 1)
    met = found.where((lo_r <= hi_r) & (lo_c <= hi_c))
    return met.select(F.explode(_cut_out(lo_r, hi_r, lo_c, hi_c, side)).alias("p")).select("p.*").where((F.col("h") != OUTSIDE) | (F.col("v") != OUTSIDE))


def zonal_blocks(footprints: DataFrame, found: DataFrame, size: float, side: int = SIDE, how: str = "left") -> DataFrame:
    """footprints (fid, lbox, and rings where it goes by polygons) by the blocks under them: fid, px (array of row, col, h, v), those partly covered included.

    Pixels of a block that isn't there count as OUTSIDE, and of those that are all alike the first stands for all. how: inner leaves
    footprints out that have no block in found.
    """
    b = F.col("lbox")
    last = lambda lo, hi: F.greatest(F.floor(b[lo] / size), F.ceil(b[hi] / size) - 1)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.floor(b[lo] / size) / side), F.floor(last(lo, hi) / side)))
    places = footprints.withColumn("brow", spread("y1", "y2")).withColumn("bcol", spread("x1", "x2"))
    rows = places.join(found, ["brow", "bcol"], how)
    lo_r, hi_r = F.greatest(F.floor(b["y1"] / size), F.col("brow") * side), F.least(last("y1", "y2"), (F.col("brow") + 1) * side - 1)
    lo_c, hi_c = F.greatest(F.floor(b["x1"] / size), F.col("bcol") * side), F.least(last("x1", "x2"), (F.col("bcol") + 1) * side - 1)
    missing = F.array(F.struct(lo_r.alias("row"), lo_c.alias("col"), F.lit(OUTSIDE).alias("h"), F.lit(OUTSIDE).alias("v")))
    px = F.when(F.col("h").isNotNull(), _cut_out(lo_r, hi_r, lo_c, hi_c, side))
    if "rings" in footprints.columns:
        square = lambda row, col: geo.box(col * size, row * size, col * size + size, row * size + size)
        covered = lambda p: geo.polygon_crosses_box(F.col("rings"), square(p["row"], p["col"]))
        every = F.flatten(F.transform(F.sequence(lo_r, hi_r), lambda r: F.transform(F.sequence(lo_c, hi_c), lambda c: F.struct(r.alias("row"), c.alias("col"), F.lit(OUTSIDE).alias("h"), F.lit(OUTSIDE).alias("v")))))
        return rows.select("fid", F.filter(F.coalesce(px, every), covered).alias("px")).where(F.size("px") > 0)
    return rows.select("fid", F.coalesce(px, missing).alias("px"))


def heights(zonal: DataFrame, pick: str = "nearest_value") -> DataFrame:
    """As lod1.heights, of zonal_blocks: each row's own best first, so that a footprint's pixels are never brought together."""
    top = F.array_max(F.transform("px", lambda p: p["h"]))
    best = lambda key: F.array_min(F.transform("px", lambda p: F.struct(key(p).alias("key"), p["row"].alias("row"), p["col"].alias("col"), p["v"].alias("v"))))
    if pick == "at_max":
        own = zonal.select("fid", top.alias("height"), best(lambda p: -p["h"]).alias("best"))
    else:
        whole = zonal.withColumn("height", F.max(top).over(Window.partitionBy("fid")))
        own = whole.select("fid", "height", best(lambda p: F.abs(p["v"] - F.col("height"))).alias("best"))
    return own.groupBy("fid").agg(F.max("height").alias("height"), F.min("best").alias("best")).select("fid", "height", F.col("best.v").alias("var"))


def taller(footprints: DataFrame, spark: SparkSession, folder: str, least: float, size: float, side: int = SIDE) -> DataFrame:
    """The footprints of at least such a height, with it; blocks that don't reach it anywhere aren't read."""
    zonal = zonal_blocks(footprints, read_blocks(spark, folder, least=least, side=side), size, side, "inner")
    tops = zonal.select("fid", F.array_max(F.transform("px", lambda p: p["h"])).alias("height"))
    return tops.groupBy("fid").agg(F.max("height").alias("height")).where(F.col("height") >= least)
