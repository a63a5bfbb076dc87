"""Joins over the levels of a grid and over cut polygons, against all pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.operators import fusion, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x1, y1, x2, y2):
    return {"x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2)}


def boxes(spark, rows, key, name):
    return spark.createDataFrame([(i, box(*r)) for i, r in enumerate(rows)], f"{key} long, {name} struct<x1:double,y1:double,x2:double,y2:double>").repartition(3)


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def square(x1, y1, x2, y2):
    return ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])


def star(rand, n, x, y, r):
    turns = sorted(rand.random() * 2 * math.pi for _ in range(n))
    points = [(round(x + d * math.cos(t)), round(y + d * math.sin(t))) for t, d in ((t, r * rand.uniform(0.4, 1)) for t in turns)]
    return ring([p for i, p in enumerate(points) if not i or p != points[i - 1]])


@pytest.mark.parametrize("small", [None, False])
def test_boxes_of_all_sizes(spark, small):
    rand = random.Random(4)
    sizes = [0, 1, 3, 8, 40, 500, 9000]
    some = lambda n: [(x, y, x + rand.choice(sizes), y + rand.choice(sizes)) for x, y in ((rand.randint(-400, 400), rand.randint(-400, 400)) for _ in range(n))]
    a, b = [*some(150), (-5_000_000, -4_000_000, 5_000_000, 4_000_000)], [*some(150), (0, 0, 16, 16), (-3_000_000, -10, 7_000_000, 10)]
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    left, right = boxes(spark, a, "lid", "lbox"), boxes(spark, b, "rid", "rbox")
    got = [tuple(r) for r in spatial.grid_join(left, right, 8.0, small_right=small).select("lid", "rid").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.lid for r in spatial.grid_join(left, right.where("rid < 20"), 8.0, "left_anti", small_right=small).collect()} == set(range(len(a))) - {i for i, j in want if j < 20}


def test_a_large_box_is_few_rows(spark):
    one = boxes(spark, [(-5_000_000, -4_000_000, 5_000_000, 4_000_000)], "rid", "rbox")
    keys = F.explode(spatial._keys(spatial.box_level(F.col("rbox"), 8.0), [0, 1, 5], False))
    rows = spatial.with_cells(one.withColumn("k", keys), "rbox", spatial._side(F.col("k.level"), 8.0))
    assert rows.count() <= 4


def test_cut_polygons_meet_as_whole_ones_do(spark):
    rand = random.Random(9)
    polygons = [(i, [star(rand, rand.choice([3, 9, 120]), rand.randint(-90, 90), rand.randint(-90, 90), rand.choice([4, 30, 90]))]) for i in range(14)]
    polygons += [(50, [square(-64, -64, 64, 64), square(-32, -32, 33, 31)]), (51, [square(0, 0, 8, 8)])]
    prints = [(i, [star(rand, rand.randint(3, 7), rand.randint(-120, 120), rand.randint(-120, 120), rand.choice([1, 5, 20, 150]))]) for i in range(120)]
    prints += [(200 + i, [square(x, y, x + 4, y + 4)]) for i, (x, y) in enumerate([(-68, -68), (-4, -4), (64, 64), (65, 65), (33, 31), (-32, -32), (-33, -33), (8, 8), (4, 4)])]
    p = spark.createDataFrame(polygons, f"pid long, rings {RINGS}")
    f = spark.createDataFrame(prints, f"fid long, rings {RINGS}").withColumn("lbox", geo.bounds(F.col("rings")))
    cells = spatial.cut_polygons(p, 8.0, 6)
    got = {(r.fid, r.pid) for r in spatial.polygon_join(f, cells, 8.0).select("fid", "pid").collect()}
    want = {(r.fid, r.pid) for r in f.join(p.withColumnRenamed("rings", "rrings"), geo.polygons_meet(F.col("rings"), F.col("rrings"))).select("fid", "pid").collect()}
    assert got == want and any(r.whole for r in cells.collect())


def test_a_district_of_a_hundred_thousand_points(spark):
    n, r = 100_000, 50_000.0
    turn = F.col("i") * (2 * math.pi / n)
    reach = r * (1 + 0.2 * F.sin(turn * 7)) + F.when(F.col("i") % 2 == 0, 3.0).otherwise(0.0)
    point = F.struct((reach * F.cos(turn)).alias("x"), (reach * F.sin(turn)).alias("y"))
    shell = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i).alias("s")).select(F.posexplode("s").alias("p", "i")).select("i", point.alias("pt"))
    line = shell.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pt"))), lambda x: x["pt"]).alias("pts"))
    district = line.select(F.lit("a").alias("roi_id"), F.lit("wide").alias("region"), F.array(F.concat("pts", F.slice("pts", 1, 1))).alias("rrings"))
    rand = random.Random(2)
    spots = [(rand.uniform(-70_000, 70_000), rand.uniform(-70_000, 70_000)) for _ in range(3000)]
    prints = spark.createDataFrame([(i, "osm", box(x, y, x + 10, y + 10), [square(x, y, x + 10, y + 10)]) for i, (x, y) in enumerate(spots)], f"fid long, source string, lbox struct<x1:double,y1:double,x2:double,y2:double>, rings {RINGS}")
    began = time.time()
    got = {row.fid for row in fusion.crop(prints, district, 64.0).collect()}
    assert time.time() - began < 120
    # the edge is told to within 30 either way
    away = {i: math.hypot(x, y) - r * (1 + 0.2 * math.sin(math.atan2(y, x) * 7)) for i, (x, y) in enumerate(spots)}
    assert {i for i, d in away.items() if d < -30} <= got <= {i for i, d in away.items() if d < 30} and len(got) > 1000
    cells = spatial.cut_polygons(district.select(F.col("roi_id").alias("pid"), F.col("rrings").alias("rings")), 64.0)
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= 200 and cells.where("whole").count() > 100


def test_empty_sides(spark):
    none = boxes(spark, [], "rid", "rbox")
    some = boxes(spark, [(0, 0, 900, 900)], "lid", "lbox")
    assert spatial.grid_join(some, none, 8.0).count() == 0 and spatial.grid_join(some, none, 8.0, "left_anti").count() == 1
    cells = spatial.cut_polygons(spark.createDataFrame([], f"pid string, rings {RINGS}"), 8.0)
    assert cells.count() == 0 and spatial.polygon_join(some.withColumn("rings", F.array(geo.ring_of_box(F.col("lbox")))), cells, 8.0).count() == 0
