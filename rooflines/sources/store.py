"""A store of features in files that lie together, with a manifest of each file's box: a lookup opens only the files that it can need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Not seen by readers of the folder.
MANIFEST = "_manifest"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def write_store(features: DataFrame, folder: str, side: float, files: int | None = None, box: str = "lbox") -> None:
    """features by the cells of side x side that their boxes begin in, row of cells after row of cells, and the manifest of the files.

    files: how many at most; None leaves it to the session.
    """
    order = [F.floor(F.col(f"{box}.y1") / side), F.floor(F.col(f"{box}.x1") / side)]
    dealt = features.repartitionByRange(files, *order) if files else features.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(folder)
    manifest(features.sparkSession, folder, box).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")  # a row for each file


def manifest(spark: SparkSession, folder: str, box: str = "lbox") -> DataFrame:
    """name, rows, box of each file; only the boxes are read."""
    b = F.col(box)
    rows = spark.read.parquet(folder).select(box, F.col("_metadata.file_name").alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("rows"), geo.box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"])).alias("box"))


def lookup(spark: SparkSession, folder: str, wanted: list[tuple[float, float, float, float]] | DataFrame, box: str = "lbox") -> DataFrame:
    """The features that meet any of the wanted boxes, touching included, each once; wanted: boxes, or a table of them (wbox) of a few rows.

    The manifest is joined first, and only the names of the files that it leaves go to the driver, which lists files for any read. Then the
    boxes' bounds go to the scan, where row groups beyond them are skipped.
    """
    if not isinstance(wanted, DataFrame):
        wanted = spark.createDataFrame([(w,) for w in wanted], f"wbox {BOX}")
    kept = spark.read.parquet(f"{folder}/{MANIFEST}")
    boxes = wanted.select("wbox")
    names = [r["name"] for r in kept.join(F.broadcast(boxes), geo.boxes_meet(F.col("box"), F.col("wbox")), "left_semi").select("name").collect()]
    schema = spark.read.parquet(folder).schema
    if not names:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in sorted(names)))
    around = boxes.agg(*(f(f"wbox.{c}").alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2")))).first()
    b = F.col(box)
    near = found.where((b["x1"] <= around.x2) & (b["x2"] >= around.x1) & (b["y1"] <= around.y2) & (b["y2"] >= around.y1))
    return near.join(F.broadcast(boxes), geo.boxes_meet(b, F.col("wbox")), "left_semi")
