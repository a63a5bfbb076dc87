"""Cases worked by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rooflines.functions import geo, polygons
from rooflines.operators import evaluation, fusion, lod1, outlines, raster, rings, sampling, spatial, stats


def boxes(spark, rows):
    df = spark.createDataFrame([(i, s, *map(float, b)) for i, s, *b in rows], "fid long, source string, x1 double, y1 double, x2 double, y2 double")
    return df.withColumn("lbox", geo.box("x1", "y1", "x2", "y2"))


def one_district(spark):
    return spark.range(1).select(F.lit("a").alias("roi_id"), F.lit("R").alias("region"), geo.box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)).alias("rbox"))


def test_touching_secondary_is_removed_with_no_area(spark):
    c = fusion.crop(boxes(spark, [(1, "osm", 0, 0, 10, 10), (2, "ms", 10, 0, 20, 10), (3, "ms", 30, 30, 40, 40)]), one_district(spark), 16.0)
    pairs = fusion.overlaps(c, "osm", 16.0).collect()
    assert [(p.fid, p.main_fid, p.shared) for p in pairs] == [(2, 1, 0.0)]
    assert {r.fid for r in fusion.fuse(c, "osm", 16.0).collect()} == {1, 3}


def test_tie_goes_to_the_earlier_candidate(spark):
    c = fusion.crop(boxes(spark, [(1, "osm", 0, 0, 10, 10), (2, "google", 50, 50, 60, 60), (3, "ours2", 70, 70, 80, 80)]), one_district(spark), 16.0)
    best = fusion.best_source(fusion.source_quality(c, fusion.overlaps(c, "osm", 16.0)), "osm").first()
    assert best.best == "ours2"


def test_empty_main_takes_the_largest_area_whole(spark):
    c = fusion.crop(boxes(spark, [(2, "google", 50, 50, 60, 60), (3, "ours2", 70, 70, 85, 85), (4, "ours2", 1, 1, 2, 2)]), one_district(spark), 16.0)
    assert {r.fid for r in fusion.fuse(c, "osm", 16.0).collect()} == {3, 4}


def test_tile_names(spark):
    df = spark.createDataFrame([(-0.1, 0.1)], "a double, b double")
    starts = df.select(geo.tile_starts("a", "b").alias("s")).first().s
    assert starts == [-5, 0]
    assert spark.createDataFrame([(6.0, 10.0)], "a double, b double").select(geo.tile_starts("a", "b").alias("s")).first().s == [5, 10]
    named = spark.createDataFrame([(-5, 5, 0, 0)], "w int, n int, e int, s int").select(geo.tile_name("w", "n", "e", "s").alias("t"))
    assert named.first().t == "w005_n05_e000_n00"
    p = named.select(geo.parsed_tile(F.concat(F.lit("x_"), "t", F.lit(".tif"))).alias("p")).first().p
    assert (p.lon_min, p.lat_max, p.lon_max, p.lat_min) == (-5, 5, 0, 0)


def test_clamped_windows_repeat(spark):
    df = spark.createDataFrame([(300,)], "h int")
    assert df.select(raster.clamped_starts(F.col("h"), 256, 64).alias("s")).first().s == [0, 44, 44, 44, 44]


def test_uncovered_pixel_is_exported_as_minus_one_and_two(spark):
    scores = spark.createDataFrame([(0, 0, 2.0), (0, 0, 4.0)], "row int, col int, score double")
    px = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int")
    out = {r.col: (r.n, r.mean, r["var"]) for r in raster.exported_stats(raster.overlap_stats(scores, px)).collect()}
    assert out == {0: (2, 3.0, 1.0), 1: (0, -1.0, -2.0)}


def test_variance_is_picked_by_value(spark):
    z = spark.createDataFrame([(1, 0, 0, 3.0, 6.5), (1, 0, 1, 7.0, 1.0)], "fid int, row int, col int, h double, v double")
    assert tuple(lod1.heights(z).first()) == (1, 7.0, 6.5)
    assert tuple(lod1.heights(z, "at_max").first()) == (1, 7.0, 1.0)


L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
HOOK = [(0.5, 0.5), (3, 0.5), (3, 3), (2.5, 3), (2.5, 0.75), (0.5, 0.75)]


@pytest.mark.parametrize("shift", [(0, 0), (1.5e7, 4e6)])
def test_l_and_hook(spark, shift):
    ring = lambda pts: [[{"x": float(x + shift[0]), "y": float(y + shift[1])} for x, y in [*pts, pts[0]]]]
    kind = "array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([(ring(L), ring(HOOK))], f"a {kind}, b {kind}")
    got = df.select(geo.polygon_shared_area(F.col("a"), F.col("b")).alias("i"), geo.polygons_meet(F.col("a"), F.col("b")).alias("m"), polygons.valid("a").alias("v")).first()
    assert got.i == pytest.approx(0.75, abs=1e-6) and got.m and got.v


def test_holes_count_against_and_touching_meets():
    outer, hole = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(2, 2), (8, 2), (8, 8), (2, 8)], float)
    box = [np.array([(0, 0), (5, 0), (5, 10), (0, 10)], float)]
    assert polygons.shared_area([outer, hole], box) == pytest.approx(50 - 18)
    assert polygons.meet([outer], [outer + [10, 0]]) and not polygons.meet([outer], [outer + [10.1, 0]])
    assert not polygons.inside([outer, hole], np.array([5.0, 5.0])) and polygons.inside([outer, hole], np.array([2.0, 5.0]))
    assert not polygons.is_valid([np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)])


def test_bins(spark):
    df = spark.createDataFrame([(2.0,), (9.0,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(geo.bin_of("v", [0, 1, 2, 3])).collect()] == [2, 2, 0]


def test_complexity_iou(spark):
    assert spark.range(1).select(evaluation.complexity_iou(F.lit(0.9), F.lit(8), F.lit(4))).first()[0] == pytest.approx(0.6)


def test_missing_metric_counts_as_the_worst(spark):
    df = spark.createDataFrame([("a", "rmse", 1.0), ("b", "rmse", 3.0), ("c", "rmse", None), ("a", "iou", 0.2), ("b", "iou", 0.8), ("c", "iou", None)], "product string, metric string, v double")
    out = {(r.product, r.metric): r.scaled for r in stats.min_max(df, "metric", "v", ["rmse"]).collect()}
    assert out[("c", "rmse")] == pytest.approx(0.2) and out[("c", "iou")] == pytest.approx(0.2) and out[("a", "rmse")] == pytest.approx(1.0)
    flat = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0)], "product string, metric string, v double")
    assert {r.scaled for r in stats.min_max(flat, "metric", "v", []).collect()} == {0.554}


def test_even_groups(spark):
    out = sampling.even_groups(spark.range(10), 4, "id").groupBy("group").count().orderBy("group").collect()
    assert [r["count"] for r in out] == [3, 3, 2, 2]


def test_prefix_join_and_only_one(spark):
    df = spark.createDataFrame([("rome_1_a",), ("oslo_2",), ("rom_3",)], "name string")
    p = spark.createDataFrame([("rome",), ("rome_1",)], "city string")
    assert [r.name for r in sampling.with_prefix(df, "name", p, "city").collect()] == ["rome_1_a"]
    assert sampling.only_one(df.where("name = 'oslo_2'"), "name") == "oslo_2"
    with pytest.raises(ValueError):
        sampling.only_one(df, "name")


def test_greedy_takes_the_best_free_truth_and_crowds_again(spark):
    rows = [(1, 1, 10, 0.9, 100, 0.8, False, False), (1, 1, 11, 0.8, 100, 0.9, False, False), (1, 1, 11, 0.8, 101, 0.6, True, True), (1, 1, 12, 0.7, 101, 0.7, True, True), (1, 1, 13, 0.6, 100, 0.4, False, False)]
    df = spark.createDataFrame(rows, "image long, category long, det long, score double, truth long, iou double, ignored boolean, crowd boolean")
    out = {r.det: (r.truth, r.ignored) for r in evaluation.greedy_matches(df, 0.5).collect()}
    assert out == {10: (100, False), 11: (101, True), 12: (101, True)}


def test_mask_with_a_hole_across_blocks(spark):
    px = [(r, c, 1 if 1 <= r <= 6 and 1 <= c <= 6 and not (3 <= r <= 4 and 3 <= c <= 4) else 0) for r in range(8) for c in range(8)]
    lab = raster.components(spark.createDataFrame(px, "row int, col int, value int"), side=3)
    shapes = outlines.polygons(lab.where("value = 1")).collect()
    assert len(shapes) == 1 and [len(r) for r in shapes[0].rings] == [5, 5]
    area = lambda r: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(r[:-1], r[1:], strict=True)) / 2)
    assert [area(r) for r in shapes[0].rings] == [36, 4]


def test_nearest_and_scaling(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "pid int, px double, py double")
    t = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, -4.0)], "tid int, tx double, ty double")
    assert {r.pid: (r.tid, r.distance) for r in spatial.nearest(p, t, 10.0).collect()} == {1: (7, 5.0), 2: (None, None)}


def test_dbscan(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (6, 7)]
    df = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    pts = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    out = {r.node: r.cluster for r in rings.clusters(df, pts, 3).collect()}
    assert out == {1: 2, 2: 2, 3: 2, 4: 2, 5: None, 6: None, 7: None, 8: None}


def test_max_tangent_angle(spark):
    square, turned = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0.5), (4, 4), (0, 4)]
    df = spark.createDataFrame([(1, i, float(a), float(b), float(c), float(d)) for i, ((a, b), (c, d)) in enumerate(zip(square, turned, strict=True))], "k int, pos int, x double, y double, tx double, ty double")
    assert rings.max_tangent_angle(df, "k").first().angle == pytest.approx(math.degrees(math.atan2(0.5, 4)))


def test_douglas_peucker_and_cyclic_keep_corners():
    p = np.array([(0, 0), (1, 0.01), (2, 0), (2, 2), (1, 2.01), (0, 2)], float)
    assert len(polygons.douglas_peucker(p, 0.1)) == 4
    assert polygons.simplify_cyclic(p[None], 0.5).sum() == 4
    assert polygons.simplify_cyclic(p[None, :3], 100).sum() == 3


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.booleans()), min_size=1, max_size=60))
def test_class_totals_match_a_confusion_matrix(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(255 if skip else g, p) for g, p, skip in rows], "gt long, pred long")
    got = {r["class"]: (r.intersect, r.union, r.pred_n, r.gt_n) for r in evaluation.class_totals(df, 4, 255).collect()}
    m = np.zeros((4, 4), int)
    for g, p, skip in rows:
        if not skip:
            m[g, p] += 1
    for c in range(4):
        want = (m[c, c], m[c].sum() + m[:, c].sum() - m[c, c], m[:, c].sum(), m[c].sum())
        assert got.get(c, (0, 0, 0, 0)) == want


def test_batch_scoring_and_named_steps(spark):
    def double(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": b["id"] * 2.0})

    out = sampling.composed(spark.range(3), ["even", lambda d: raster.scored(d, double, "id long, score double")], {"even": lambda d: d.where("id % 2 = 0")})
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(0, 0.0), (2, 4.0)]


def test_a_large_group_is_dealt_out_and_takes_no_square_time(spark):
    """Slices put together give what one running pass over the group gives; 200,000 rows take seconds."""
    import time

    rows = [(g, i % 7, i, float((i * 37) % 50), int((i * i) % 3 == 0)) for g in (0, 1) for i in range(400 if g else 90)]
    df = spark.createDataFrame(rows, "grp long, image long, det long, score double, tp int")
    got = {(r.grp, r.det): (r.tps, r["rank"], r.recall_before, r.envelope) for r in evaluation.precision_curve(df, F.lit(200), "grp").collect()}
    for g in (0, 1):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2]))
        tps = [sum(r[4] for r in order[: i + 1]) for i in range(len(order))]
        precision = [t / (i + 1) for i, t in enumerate(tps)]
        for i, r in enumerate(order):
            assert got[g, r[2]] == (tps[i], i + 1, -1.0 if i == 0 else tps[i - 1] / 200, max(precision[i:]))
    began = time.time()
    big = spark.range(200_000).select(F.lit(1).alias("grp"), (F.col("id") % 1000).alias("image"), F.col("id").alias("det"), F.rand(1).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("tp"))
    assert evaluation.average_precision(evaluation.precision_curve(big, F.lit(66_667), "grp"), "grp").first().max_recall == 1 and time.time() - began < 60


def test_polygon_expressions_match_the_plain_ones(spark):
    """Star-shaped rings of any turn with holes: shared area and meeting by expressions, against triangles and edges in numpy."""
    r = np.random.default_rng(4)

    def star(cx, cy, size, n):
        at = np.sort(r.uniform(0, 2 * np.pi, n))
        far = r.uniform(0.4, 1, n) * size
        pts = np.stack([cx + far * np.cos(at), cy + far * np.sin(at)], 1)
        return pts if r.random() < 0.5 else pts[::-1]

    def polygon():
        cx, cy, size = *r.uniform(0, 10, 2), r.uniform(1, 5)
        shell = star(cx, cy, size, 9)
        return [shell, star(cx, cy, size * 0.1, 4)] if r.random() < 0.5 and polygons.inside([shell], np.array([cx, cy])) else [shell]

    pairs = [(polygon(), polygon()) for _ in range(150)]
    rows = [(i, polygons.as_value(a), polygons.as_value(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    got = df.select("i", geo.polygon_shared_area(F.col("a"), F.col("b")).alias("s"), geo.polygons_meet(F.col("a"), F.col("b")).alias("m"), geo.polygon_crosses_box(F.col("a"), geo.box(F.lit(3), F.lit(3), F.lit(5), F.lit(5))).alias("c")).collect()
    box = [np.array([(3, 3), (5, 3), (5, 5), (3, 5)], float)]
    for x in got:
        a, b = pairs[x.i]
        if all(len(p) == 1 or polygons.signed_area(p[1]) for p in (a, b)):
            assert x.s == pytest.approx(polygons.shared_area(a, b), abs=1e-6)
        assert x.m == polygons.meet(a, b)
        assert x.c == (polygons.shared_area(a, box) > 1e-12)
    assert 20 < sum(x.m for x in got) < 150


def test_cyclic_simplification_finds_the_best_cycle():
    """Against all sets of vertices through the start that is chosen."""
    from itertools import combinations

    r = np.random.default_rng(6)
    rings_ = np.stack([np.cumsum(r.normal(size=(8, 2)), 0) for _ in range(12)])
    n, cost = 8, 0.8

    def total(p, chosen):
        out = cost * len(chosen)
        for i, j in zip(chosen, [*chosen[1:], chosen[0] + n], strict=True):
            a, d = p[i], p[j % n] - p[i]
            for k in range(i + 1, j):
                v = p[k % n] - a
                m = np.hypot(*d)
                out += abs(d[0] * v[1] - d[1] * v[0]) / m if m else np.hypot(*v)
        return out

    for p, kept in zip(rings_, polygons.simplify_cyclic(rings_, cost), strict=True):
        best = lambda start: min((list(c) for k in range(1, n) for c in combinations(range(n), k + 1) if start in c), key=lambda c: total(p, c))  # noqa: B023, E731
        first = best(0)
        again = best(first[len(first) // 2])
        want = list(range(n)) if len(again) < 3 else again
        assert total(p, np.flatnonzero(kept).tolist()) == pytest.approx(total(p, want))


def test_components_of_a_random_mask_are_those_of_a_flood(spark):
    r = np.random.default_rng(9)
    px = {(i, j): int(r.integers(0, 2)) for i in range(17) for j in range(19) if r.random() < 0.95}
    name = {}
    for start in sorted(px):
        if start not in name:
            stack, name[start] = [start], start
            while stack:
                i, j = stack.pop()
                for at in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if at in px and at not in name and px[at] == px[i, j]:
                        name[at] = start
                        stack.append(at)
    df = spark.createDataFrame([(*k, v) for k, v in px.items()], "row int, col int, value int")
    got = {(x.row, x.col): (x.component >> 32, x.component & 0xFFFFFFFF) for x in raster.components(df, side=5).collect()}
    assert got == name


def test_percentiles_and_ranks_with_ties_and_nulls(spark):
    r = np.random.default_rng(3)
    rows = [(g, None if r.random() < 0.1 else float(r.integers(0, 9) if g == "ties" else r.normal())) for g in ("ties", "all") for _ in range(301)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0.0, 0.005, 0.5, 0.98, 1.0]
    got = {x.g: list(x.p) for x in stats.percentiles(df, "v", at, "g").collect()}
    of = {g: [v for h, v in rows if h == g and v is not None] for g in ("ties", "all", "one")}
    assert set(got) == set(of) and all(got[g] == pytest.approx(np.percentile(v, [100 * q for q in at])) for g, v in of.items())
    assert stats.percentiles(df.where("v is null"), "v", at).count() == 0
    ranked = stats.ranks(df.where("v is not null"), "v", "rk", "g").collect()
    for g, v in of.items():
        assert sorted(x.rk for x in ranked if x.g == g) == pytest.approx(sorted(pd.Series(v).rank()))
