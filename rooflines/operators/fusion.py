"""Fusion of footprint sources: crop to districts, score each source against the main one, choose, merge without overlap.

footprints: fid, source, lbox, districts: roi_id, region, rbox. Where both have their polygons too (rings and rrings), boxes
only make the candidates: what meets, what is shared and how large it is are the polygons' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, polygons
from . import pairs
from .raster import checkpointed
from .spatial import cut_polygons, grid_join, polygon_join

#: The candidates in the order that settles ties.
CANDIDATES = ["ms", "osm", "ours2", "google"]
NO_DISTRICT = "total"


def exact(footprints: DataFrame) -> bool:
    return "rings" in footprints.columns


def area(footprints: DataFrame) -> Column:
    return geo.polygon_area(F.col("rings")) if exact(footprints) else geo.box_area(F.col("lbox"))


def crop(footprints: DataFrame, districts: DataFrame, side: float, keep_outside: bool = False) -> DataFrame:
    """A row for each footprint and district that meet, so a footprint on a border comes more than once.

    keep_outside: footprints without a district form the district NO_DISTRICT. Districts' polygons are cut to cells once, and only cells are
    joined; footprints are told apart by source and fid there. A district's other columns are the same in all its rows.
    """
    if exact(footprints) and "rrings" in districts.columns:
        cells = cut_polygons(districts.select(F.col("roi_id").alias("pid"), F.col("rrings").alias("rings")), side)
        met = polygon_join(footprints, cells, side).withColumnRenamed("pid", "roi_id")
        pairs = met.dropDuplicates(["source", "fid", "roi_id"]).join(districts.drop("rbox", "rrings").distinct(), "roi_id")
    else:
        pairs = grid_join(footprints, districts, side).drop("rbox", "rrings")
    if not keep_outside:
        return pairs
    ids = pairs.select("fid").distinct()
    out = footprints.join(ids, "fid", "left_anti").withColumn("roi_id", F.lit(NO_DISTRICT)).withColumn("region", F.lit(NO_DISTRICT))
    return pairs.select(*out.columns).unionByName(out)


def without_repeats(cropped: DataFrame) -> DataFrame:
    """Each feature once over all districts, in the first by id."""
    best = cropped.groupBy("source", "fid").agg(F.min("roi_id").alias("roi_id"))
    return cropped.join(best, ["source", "fid", "roi_id"], "left_semi")


def overlaps(cropped: DataFrame, main: str, side: float) -> DataFrame:
    """Pairs of a district's main and other features that meet: roi_id, source, fid, main_fid, shared (0 where they touch)."""
    shapes, right = (["rings"], [F.col("rings").alias("rrings")]) if exact(cropped) else ([], [])
    others = cropped.where(F.col("source") != main).select("roi_id", "source", "fid", "lbox", *shapes)
    mains = cropped.where(F.col("source") == main).select(F.col("roi_id").alias("main_roi"), F.col("fid").alias("main_fid"), F.col("lbox").alias("rbox"), *right)
    pairs = grid_join(others, mains, side, on=lambda a, b: a["roi_id"] == b["main_roi"], small_right=False)
    if not exact(cropped):
        return pairs.select("roi_id", "source", "fid", "main_fid", geo.shared_area(F.col("lbox"), F.col("rbox")).alias("shared"))
    return pairs.select("roi_id", "source", "fid", "main_fid", polygons.overlap(F.col("rings"), F.col("rrings")).alias("shared")).where("shared is not null")


def met(cropped: DataFrame, main: str, side: float) -> DataFrame:
    """As matched(overlaps(...)), with the number of pairs and of those that only touch, and without a row for each pair."""
    shapes = ["rings"] if exact(cropped) else []
    others = cropped.where(F.col("source") != main).select("roi_id", "source", "fid", "lbox", *shapes)
    mains = cropped.where(F.col("source") == main).select("roi_id", "fid", F.col("lbox").alias("rbox"), *shapes)
    sums = pairs.met_sums(others, mains, side, ["roi_id", "source", "fid"], "roi_id")
    return sums.groupBy("roi_id", "source", "fid").agg(F.sum("shared").alias("overlap"), F.sum("pairs").alias("pairs"), F.sum("touching").alias("touching"))


def matched(pairs: DataFrame) -> DataFrame:
    """A row for each feature of pairs: roi_id, source, fid and what it shares with main features (overlap)."""
    return pairs.groupBy("roi_id", "source", "fid").agg(F.sum("shared").alias("overlap"))


def source_quality(cropped: DataFrame, pairs: DataFrame) -> DataFrame:
    return quality_of(cropped, matched(pairs))


def quality_of(cropped: DataFrame, matched: DataFrame) -> DataFrame:
    """By district and other source: features, area, matched features, overlap (pairs summed), added (area of what meets no main feature), quality."""
    rows = cropped.select("roi_id", "source", "fid", area(cropped).alias("area")).join(matched.select("roi_id", "source", "fid", "overlap"), ["roi_id", "source", "fid"], "left")
    return rows.groupBy("roi_id", "source").agg(
        F.count("*").alias("features"),
        F.sum("area").alias("area"),
        F.count("overlap").alias("matched"),
        F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("overlap"),
        F.sum(F.when(F.col("overlap").isNull(), F.col("area")).otherwise(0.0)).alias("added"),
    ).withColumn("quality", F.col("overlap") + F.col("added"))


def best_source(quality: DataFrame, main: str, candidates: list[str] | None = None) -> DataFrame:
    """roi_id, has_main, best: the candidate of the highest quality, or of the largest area where the main source is absent; ties by the candidates' order."""
    order = [c for c in (candidates or CANDIDATES) if c != main]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    mains = quality.where(F.col("source") == main).select("roi_id").withColumn("has_main", F.lit(True))
    rows = quality.select("roi_id").distinct().join(mains, "roi_id", "left").withColumn("has_main", F.coalesce("has_main", F.lit(False)))
    metric = F.when(F.col("has_main"), F.col("quality")).otherwise(F.col("area"))
    ranked = quality.where(F.col("source").isin(order)).join(rows, "roi_id").withColumn("metric", metric)
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("roi_id").orderBy(F.desc("metric"), rank))).where("n = 1").select("roi_id", F.col("source").alias("best"), "metric")
    return rows.join(first, "roi_id", "left")


def fuse(cropped: DataFrame, main: str, side: float, candidates: list[str] | None = None) -> DataFrame:
    """Main features, and of each district's best other source those that meet no main feature (all where there is none)."""
    # the crop and what its features share feed quality, choice and merge: each is worked out once. Pairs, of which there are many more than features, aren't kept
    cropped = checkpointed(cropped)
    matches = checkpointed(met(cropped, main, side))
    best = best_source(quality_of(cropped, matches), main, candidates)
    chosen = cropped.join(best.select("roi_id", F.col("best").alias("source")), ["roi_id", "source"], "left_semi")
    rest = chosen.join(matches, ["roi_id", "source", "fid"], "left_anti")
    return cropped.where(F.col("source") == main).unionByName(rest.select(*cropped.columns))


def main_source(features: DataFrame, group: str, wanted: str = "google", fallback: str = "osm") -> DataFrame:
    """By group, the wanted main source, or the fallback where it has no features."""
    return features.groupBy(group).agg(F.when(F.max((F.col("source") == wanted).cast("int")) == 1, wanted).otherwise(fallback).alias("main"))
