"""Clusters of points, contour measures, image IoU, the feature store and a repeatable intake, each against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.operators import evaluation, rings
from rooflines.sources import store
from rooflines.streaming import intake

from .test_spatial import RINGS, box, boxes, ring, square


def dbscan(points, eps, least):
    """{pos: cluster}: the least core pos, or the pos itself for noise."""
    near = {p: [q for q in points if math.dist(points[p], points[q]) <= eps] for p in points}
    core, out = {p for p in points if len(near[p]) >= least}, {}
    for p in sorted(core):
        if p in out:
            continue
        todo = [p]
        while todo:
            for q in near[todo.pop()]:
                if q not in out:
                    out[q] = p
                    if q in core:
                        todo.append(q)
    return {p: out.get(p, p) for p in points}, set(points) - set(out)


@pytest.mark.parametrize("least", [1, 3, 6])
def test_point_clusters(spark, least):
    rand, rows, want, noise, firsts = random.Random(least), [], {}, {}, set()
    for key in range(4):
        points = {i: (rand.randint(0, 25) * 0.5, rand.randint(0, 25) * 0.5) for i in range(90)}
        points |= {i: (40.0, 40.0) for i in range(90, 90 + 3 * key)}
        rows += [(key, i, x, y) for i, (x, y) in points.items()]
        clusters, alone = dbscan(points, 1.0, least)
        want |= {(key, i): c for i, c in clusters.items()}
        noise |= {(key, i): i in alone for i in points}
        firsts |= {(key, min(i for i in points if clusters[i] == c)) for c in set(clusters.values())}
    df = spark.createDataFrame(rows, "ring_id long, pos long, x double, y double").repartition(3)
    got = rings.point_clusters(df, 1.0, least).cache()
    assert {(r.ring_id, r.pos): r.cluster for r in got.collect()} == want and {(r.ring_id, r.pos): r.noise for r in got.collect()} == noise
    assert {(r.ring_id, r.pos) for r in rings.end_points(got).collect()} == firsts


def plain_angle(pred, truth, spacing, stretch):
    def nearest(p):
        best = None
        for k, r in enumerate(truth):
            for i, (a, b) in enumerate(zip(r, r[1:])):
                dx, dy = b["x"] - a["x"], b["y"] - a["y"]
                n = dx * dx + dy * dy
                t = max(0.0, min(1.0, ((p[0] - a["x"]) * dx + (p[1] - a["y"]) * dy) / n)) if n else 0.0
                q = (a["x"] + t * dx, a["y"] + t * dy)
                if best is None or math.dist(p, q) < best[0]:
                    best = (math.dist(p, q), q)
        return best[1]

    least = []
    for r in pred:
        points = []
        for a, b in zip(r, r[1:]):
            n = max(1, math.ceil(math.dist((a["x"], a["y"]), (b["x"], b["y"])) / spacing))
            points += [(a["x"] + k / n * (b["x"] - a["x"]), a["y"] + k / n * (b["y"] - a["y"])) for k in range(n)]
        moved = [nearest(p) for p in points]
        for i in range(len(points)):
            u = [b - a for a, b in zip(points[i], points[(i + 1) % len(points)])]
            v = [b - a for a, b in zip(moved[i], moved[(i + 1) % len(points)])]
            lu, lv = math.hypot(*u), math.hypot(*v)
            if lu > 0 and lv > 0 and 1 / stretch < lu / lv < stretch:
                least.append(abs(u[0] * v[0] + u[1] * v[1]) / (lu * lv))
    return math.degrees(math.acos(min(1.0, min(least)))) if least else None


def test_contour_angles(spark):
    rand = random.Random(6)
    preds, truths, want = [], [], {}
    for i in range(25):
        x, y = rand.uniform(0, 50), rand.uniform(0, 50)
        truth = [ring([(x, y), (x + 20, y + rand.uniform(-2, 2)), (x + 18, y + 15), (x + 9, y + 9 + rand.uniform(-2, 2)), (x, y + 14)])]
        if i % 3 == 0:
            truth.append(ring([(x + 3, y + 5), (x + 3, y + 8), (x + 6, y + 8), (x + 6, y + 5)]))
        pred = [ring([(p["x"] + rand.uniform(-1, 1), p["y"] + rand.uniform(-1, 1)) for p in r[:-1]]) for r in truth]
        far = [square(x + 500, y, x + 520, y + 10)]
        truths += [(i, 3 * i, 0, far), (i, 3 * i + 1, 1, truth), (i, 3 * i + 2, 2, [square(x - 5, y - 5, x + 30, y + 30)])]
        preds += [(i, i, pred), (i, 1000 + i, [square(x - 300, y, x - 290, y + 5)])]
        want[i] = (3 * i + 1, plain_angle(pred, truth, 2.0, 2.0))
    p = spark.createDataFrame(preds, f"image long, pred long, rings {RINGS}").withColumn("lbox", geo.bounds(F.col("rings")))
    t = spark.createDataFrame(truths, f"image long, truth long, order long, rrings {RINGS}").withColumn("rbox", geo.bounds(F.col("rrings")))
    got = {r.pred: (r.truth, r.angle) for r in evaluation.contour_angles(p, t, 32.0, 2.0).collect()}
    assert set(got) == set(want) and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_image_ious(spark):
    preds = [(1, [square(0, 0, 20, 20)]), (1, [square(10, 0, 30, 20)]), (2, [square(0, 0, 10, 10)]), (4, [ring([(0, 0), (30, 0), (0, 30)])])]
    truths = [(1, [square(0, 0, 30, 10)]), (3, [square(0, 0, 10, 10)]), (4, [square(0, 0, 30, 30)])]
    make = lambda rows: spark.createDataFrame(rows, f"image long, rings {RINGS}")
    got = {r.image: (r.iou, r.n, r.n_truth, r.c_iou) for r in evaluation.image_ious(make(preds), make(truths), 10.0).collect()}
    assert got[1] == pytest.approx((0.5, 8, 4, 0.5 * (1 - 4 / 12))) and got[2] == (0.0, 4, 0, 0.0) and got[3] == (0.0, 0, 4, 0.0)
    assert got[4] == pytest.approx((6 / 9, 3, 4, 6 / 9 * (1 - 1 / 7)))


def test_store_opens_only_the_files_that_a_box_meets(spark, tmp_path):
    rand = random.Random(2)
    spots = [(x, y, x + rand.randint(0, 60), y + rand.randint(0, 9)) for x, y in ((rand.randint(-3000, 3000), rand.randint(-3000, 3000)) for _ in range(2000))]
    folder = f"{tmp_path}/store"
    store.write_store(boxes(spark, spots, "fid", "lbox"), folder, 200.0, 20)
    assert spark.read.parquet(folder).count() == 2000 and spark.read.parquet(f"{folder}/{store.MANIFEST}").agg(F.sum("rows")).first()[0] == 2000
    for wanted in ([(0, 0, 300, 100)], [(-3000, -3000, -2900, -2990), (2000, 2900, 2100, 3000)], [(9000, 9000, 9001, 9001)]):
        got = store.lookup(spark, folder, [box(*w) for w in wanted])
        assert {r.fid for r in got.collect()} == {i for i, s in enumerate(spots) if any(s[0] <= w[2] and w[0] <= s[2] and s[1] <= w[3] and w[1] <= s[3] for w in wanted)}
        assert got.count() == got.select("fid").distinct().count()
    few = store.lookup(spark, folder, [box(0, 0, 300, 100)])
    assert 0 < len(few.inputFiles()) <= 4 < len(spark.read.parquet(folder).inputFiles())
    assert "lbox.x1,300.0" in spark._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")


def test_a_batch_that_breaks_off_is_not_there_twice(spark, tmp_path, monkeypatch):
    source, out, status, check = (f"{tmp_path}/{n}" for n in ("source", "out", "status", "check"))
    spark.range(100).coalesce(2).write.parquet(source)
    note, calls = intake._note, []

    def broken(*args):
        calls.append(args)
        if len(calls) <= 2:  # the row of success and the row of failure: as if the driver had gone
            raise OSError("gone")
        note(*args)

    monkeypatch.setattr(intake, "_note", broken)
    double = lambda batch, number: batch.select((F.col("id") * 2).alias("id"))
    with pytest.raises(Exception, match="gone"):
        intake.take_in(spark, source, "id long", check, status, double, output=out)
    assert spark.read.parquet(out).count() == 100
    assert intake.take_in(spark, source, "id long", check, status, double, output=out) == 100
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == list(range(0, 200, 2))
    assert intake.take_in(spark, source, "id long", check, status, double, output=out) == 0
    spark.range(100, 150).write.mode("append").parquet(source)
    assert intake.take_in(spark, source, "id long", check, status, double, output=out) == 50 and spark.read.parquet(out).count() == 150


def test_point_clusters_across_zero_and_corners(spark):
    """Points on both sides of 0, two whose cells only meet beyond a corner, and one without coordinates."""
    rand = random.Random(8)
    points = {i: (rand.randint(-16, 16) * 0.4, rand.randint(-16, 16) * 0.4) for i in range(150)}
    side = 1 / 2**0.5 * (1 - 1e-12)
    points |= {200: (50 * side - 1e-13, 50 * side - 1e-13), 201: (51 * side, 51 * side), 300: (-90 * side - 1e-13, -88 * side), 301: (-89 * side, -89 * side - 1e-13)}
    df = spark.createDataFrame([(key, i, x, y) for key in range(2) for i, (x, y) in points.items()] + [(0, 400, None, 1.0)], "ring_id long, pos long, x double, y double").repartition(3)
    for least in (2, 4):
        want, alone = dbscan(points, 1.0, least)
        got = rings.point_clusters(df, 1.0, least).collect()
        assert {(r.ring_id, r.pos): (r.cluster, r.noise) for r in got} == {(key, i): (want[i], i in alone) for key in range(2) for i in points} | {(0, 400): (400, True)} and len(got) == 2 * len(points) + 1
    assert (want, alone) != dbscan(points, 1.0, 2) and dbscan(points, 1.0, 2)[0][201] == 200
