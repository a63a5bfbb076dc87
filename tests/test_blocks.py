"""Raster blocks against pixels, and what a pruned read leaves out."""

import random

import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.operators import blocks, lod1


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def tables(spark):
    rand = random.Random(8)
    pixels = [(r, c, rand.choice([-1.0, 3.0, 3.0, rand.randint(0, 40) / 2]), float(rand.randint(0, 20))) for r in range(70) for c in range(50) if rand.random() < 0.8]
    rows = []
    for i in range(150):
        x, y = rand.randint(-40, 520), rand.randint(-40, 720)
        rows.append((i, float(x), float(y), float(x + rand.choice([0, 4, 10, 37, 200])), float(y + rand.choice([0, 5, 20, 90]))))
    prints = spark.createDataFrame(rows, "fid long, x1 double, y1 double, x2 double, y2 double").select("fid", geo.box("x1", "y1", "x2", "y2").alias("lbox"))
    return prints.cache(), spark.createDataFrame(pixels, "row int, col int, h double, v double").cache()


@pytest.mark.parametrize("pick", ["nearest_value", "at_max"])
@pytest.mark.parametrize("rings", [False, True])
def test_heights_as_by_pixel(tables, pick, rings, same):
    prints, pixels = tables
    if rings:
        b = F.col("lbox")
        kite = F.array(geo.point(b["x1"], b["y1"]), geo.point(b["x2"], (b["y1"] + b["y2"]) / 2), geo.point((b["x1"] + b["x2"]) / 2, b["y2"]), geo.point(b["x1"], b["y1"]))
        prints = prints.withColumn("rings", F.array(kite)).where("lbox.x2 > lbox.x1 and lbox.y2 > lbox.y1")
    want = lod1.heights(lod1.zonal_pixels(prints, pixels, 10.0), pick).select("fid", "height", "var")
    got = blocks.heights(blocks.zonal_blocks(prints, blocks.blocks(pixels, 8), 10.0, 8), pick)
    assert want.count() > 80
    same(got.toPandas(), want.toPandas())


def test_pruned_reads(spark, tables, tmp_path, same):
    prints, pixels = tables
    folder = f"{tmp_path}/blocks"
    blocks.write_blocks(blocks.blocks(pixels, 8), folder, 2)
    met = blocks.read_blocks(spark, folder, (18, 40), (9, 30), side=8, band=2)
    plan = formatted(met)
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(brow,2)" in plan and "LessThanOrEqual(bcol,3)" in plan
    read = {r[0].split("band=")[1].split("/")[0] for r in met.select(F.input_file_name()).distinct().collect()}
    assert read == {"1", "2"} and len(spark.read.parquet(folder).select("band").distinct().collect()) == 5
    want = pixels.where("row >= 18 and row < 40 and col >= 9 and col < 30 and (h <> -1 or v <> -1)").select(F.col("row").cast("long"), F.col("col").cast("long"), "h", "v")
    same(blocks.window(met, 18, 9, 22, 21, 8).toPandas(), want.toPandas())
    tall = blocks.read_blocks(spark, folder, least=19.5, side=8)
    assert "GreaterThanOrEqual(top,19.5)" in formatted(tall) and 0 < tall.count() < blocks.read_blocks(spark, folder).count()
    heights = lod1.heights(lod1.zonal_pixels(prints, pixels, 10.0), "at_max")
    same(blocks.taller(prints, spark, folder, 19.5, 10.0, 8).toPandas(), heights.where("height >= 19.5").select("fid", "height").toPandas())


def test_a_place_that_comes_twice_and_no_pixels(spark):
    twice = spark.createDataFrame([(0, 0, 1.0, 5.0), (0, 0, 4.0, 6.0), (0, 1, None, 7.0)], "row int, col int, h double, v double")
    made = blocks.blocks(twice, 2).first()
    assert made.h == [4.0, -1.0, -1.0, -1.0] and made.v == [6.0, 7.0, -1.0, -1.0] and made.top == 4.0
    assert blocks.blocks(twice.limit(0), 2).count() == 0
