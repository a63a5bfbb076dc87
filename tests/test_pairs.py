"""Sums over pairs against a row for each pair, and polygons as rectangles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo, polygons
from rooflines.operators import fusion, pairs
from rooflines.plans import footprint_queries  # noqa: F401
from rooflines.plans.registry import QUERIES

from .test_larger_tables import plan

RING = "array<array<struct<x:double,y:double>>>"


def square(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


def angle(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)], float)


def polygon(rand, i, reach=60.0):
    """By turns a rectangle, an L, one with a hole, a triangle, a comb of more rectangles than are cut, a very large one."""
    x, y = rand.integers(0, reach, 2).astype(float)
    w, h = rand.integers(2, 12, 2) * 2.0
    kind = i % 6
    if kind == 0:
        rings = [square(x, y, w, h)]
    elif kind == 1:
        rings = [angle(x, y, w, h)]
    elif kind == 2:
        rings = [square(x, y, w, h), square(x + w / 4, y + h / 4, w / 2, h / 2)]
    elif kind == 3:
        rings = [np.array([(x, y), (x + w, y + 1), (x + 2, y + h)])]
    elif kind == 4:
        teeth = [q for k in range(6) for q in ((x + 2 * k, y + h), (x + 2 * k, y + 2 + h), (x + 2 * k + 1, y + 2 + h), (x + 2 * k + 1, y + h))]
        rings = [np.array([(x, y), *teeth, (x + 11, y)])]
    else:
        rings = [angle(x, y, 10 * w, 8 * h)]
    return polygons.as_value([r[::-1] if rand.integers(2) else r for r in rings])


def sides(spark, n, exact, seed=3):
    rand = np.random.default_rng(seed)
    rows = lambda m, shift: [(i, f"d{i % 2}", polygon(rand, i + shift)) for i in range(m)]
    made = [spark.createDataFrame(rows(m, k), f"fid long, roi string, rings {RING}") for k, m in enumerate((n, n // 2))]
    left, right = (d.withColumn(b, geo.bounds(F.col("rings"))) for d, b in zip(made, ("lbox", "rbox"), strict=True))
    far = spark.createDataFrame([(10_000, "d0", polygons.as_value([square(1e6, 1e6, 5, 5)])), (10_001, None, polygons.as_value([square(5, 5, 9, 9)]))], f"fid long, roi string, rings {RING}").withColumn("lbox", geo.bounds(F.col("rings")))
    left = left.union(far)
    return (left, right) if exact else (left.drop("rings"), right.drop("rings"))


def plain(left, right, exact, same):
    """A row for each pair, and their sums by fid."""
    a = left.withColumnRenamed("roi", "l_roi")
    b = right.select(F.col("fid").alias("rid"), F.col("roi").alias("r_roi"), "rbox", *([F.col("rings").alias("rrings")] if exact else []))
    met = a.join(b, geo.boxes_meet(F.col("lbox"), F.col("rbox")) & ((F.col("l_roi") == F.col("r_roi")) if same else F.lit(True)))
    if exact:
        met = met.withColumn("i", polygons.overlap(F.col("rings"), F.col("rrings"))).where("i is not null").withColumn("u", geo.polygon_area(F.col("rings")) + geo.polygon_area(F.col("rrings")) - F.col("i"))
    else:
        met = met.withColumn("i", geo.shared_area(F.col("lbox"), F.col("rbox"))).withColumn("u", geo.box_area(F.col("lbox")) + geo.box_area(F.col("rbox")) - F.col("i"))
    return met.groupBy("fid").agg(F.count("*").alias("pairs"), F.count_if(F.col("i") == 0).alias("touching"), F.sum("i").alias("shared"), F.sum(F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(0.0)).alias("iou"))


def as_rows(df):
    return {r[0]: [round(v, 6) for v in r[1:]] for r in df.collect()}


@pytest.mark.parametrize("exact,same,right_rows,left_rows,step", [(True, False, 20_000, 100_000, 64.0), (True, True, 20_000, 100_000, 16.0), (True, True, 7, 11, 64.0), (False, False, 5, 9, 64.0)])
def test_sums_are_those_of_a_row_for_each_pair(spark, monkeypatch, exact, same, right_rows, left_rows, step):
    monkeypatch.setattr(pairs, "RIGHT_ROWS", right_rows)
    monkeypatch.setattr(pairs, "LEFT_ROWS", left_rows)
    left, right = sides(spark, 180, exact)
    got = pairs.met_sums(left, right, step, ["fid"], "roi" if same else None)
    got = got.groupBy("fid").agg(*(F.sum(c).alias(c) for c in pairs.SUMS.names))
    want = as_rows(plain(left, right, exact, same))
    assert as_rows(got) == want and len(want) > 150 and 10_000 not in want and (10_001 in want) == (not same) and sum(r[1] for r in want.values()) > 3


def test_nothing_meets_nothing(spark):
    left, right = sides(spark, 12, True)
    assert pairs.met_sums(left, right.limit(0), 64.0, ["fid"]).count() == 0 and pairs.met_sums(left.limit(0), right, 64.0, ["fid"]).count() == 0


@pytest.mark.parametrize("batch,held,met", [(1, 1, 1), (13, 40, 7), (10**6, 10**6, 10**6)])
def test_cells_over_batches(monkeypatch, batch, held, met):
    """Sorted rows in batches of any size: a cell goes on over several, cells of only one side, many left rows after the right ones."""
    for name, value in (("HELD", held), ("MET", met), ("SMALL", 30), ("CANDIDATES", 64)):
        monkeypatch.setattr(pairs, name, value)
    rand = np.random.default_rng(6)
    rows = []
    for c in range(12):
        for is_left, n in ((False, [0, 3, 40][c % 3]), (True, [2, 0, 7, 90][c % 4])):
            for _ in range(n):
                x1, y1 = float(rand.integers(c * 64, c * 64 + 64)), float(rand.integers(0, 64))
                x2, y2 = x1 + rand.integers(1, 20), y1 + rand.integers(1, 20)
                rows.append({"fid": len(rows), "__same": None, "__kind": 0, "__level": 0, "__cx": c, "__cy": 0, "__rpart": 0, "__lpart": 0, "__left": is_left, "__wide": 64.0, "__x1": x1, "__y1": y1, "__x2": x2, "__y2": y2, "__parts": [x1, y1, x2, y2]})
    table = pa.Table.from_pylist(rows, pa.schema([("fid", pa.int64()), ("__same", pa.string()), *((k, pa.int64()) for k in pairs.KEYS[1:]), ("__left", pa.bool_()), *((k, pa.float64()) for k in ("__wide", "__x1", "__y1", "__x2", "__y2")), ("__parts", pa.list_(pa.float64()))])).combine_chunks()
    got = {}
    for out in pairs._summed(["fid"], False)(iter(table.to_batches(batch))):
        for r in out.to_pylist():
            assert r["fid"] not in got
            got[r["fid"]] = (r["pairs"], r["touching"], round(r["shared"], 6))
    want = {}
    for a in rows:
        shared = [(min(a["__x2"], b["__x2"]) - max(a["__x1"], b["__x1"]), min(a["__y2"], b["__y2"]) - max(a["__y1"], b["__y1"])) for b in rows if a["__left"] and not b["__left"] and a["__cx"] == b["__cx"] and max(a["__x1"], b["__x1"]) // 64 == a["__cx"] and max(a["__y1"], b["__y1"]) // 64 == 0]
        met_ = [w * h for w, h in shared if w >= 0 and h >= 0]
        if met_:
            want[a["fid"]] = (len(met_), met_.count(0), round(sum(met_), 6))
    assert got == want and len(want) > 50


def test_polygons_as_rectangles():
    x, y = 3.0, 7.0
    u = [(x, y), (x + 9, y), (x + 9, y + 6), (x + 6, y + 6), (x + 6, y + 2), (x + 3, y + 2), (x + 3, y + 6), (x, y + 6)]
    bow = [(0, 0), (4, 0), (4, 4), (2, 4), (2, -2), (0, -2)]  # an upright edge runs through a level one
    touch = [(0, 0), (6, 0), (6, 4), (4, 4), (4, 0), (2, 0), (2, 4), (0, 4)]  # a level edge lies on another
    value = lambda *rings: polygons.as_value([np.array(r, float) for r in rings])
    column = [value(square(x, y, 4, 5)), value(square(x, y, 4, 5)[::-1]), value(angle(x, y, 4, 6)), value(u), None, [], value(bow), value(touch), value(square(x, y, 9, 9), square(x + 1, y + 1, 2, 2)), value([(0, 0), (4, 0), (4, 4)]), value([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 2)]), value([(0, 0), (4, 0), (4, 0), (0, 0)]), value(angle(x + 50, y, 4, 6)[2:].tolist() + angle(x + 50, y, 4, 6)[:2].tolist())]
    number, made = polygons.rectangles_of(polygons.Rings.read(pa.array(column, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))))
    assert number.tolist() == [1, 1, 2, 3, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    area = lambda rects: float(((rects[:, 2] - rects[:, 0]) * (rects[:, 3] - rects[:, 1])).sum())
    at = np.concatenate([[0], np.cumsum(number)])
    assert [area(made[at[i] : at[i + 1]]) for i in (0, 1, 2, 3, 12)] == [20, 20, 18, 42, 18]
    assert made[0].tolist() == [3, 7, 7, 12] and made[-2:].tolist() == [[53, 7, 57, 10], [53, 10, 55, 13]]


def test_fusion_makes_no_row_for_each_pair(spark, small, monkeypatch):
    monkeypatch.setattr(fusion, "overlaps", lambda *a, **k: pytest.fail("a row for each pair"))
    for name in ("fuse_shapes", "shape_quality", "fuse_districts", "source_quality", "best_source", "anti_overlap_remainder", "overlap_pairs"):
        assert QUERIES[name](spark, small).count() > 0, name


def test_pairs_of_houses_have_no_rows(spark, small):
    """Neither a join of the two sides nor a function of each pair."""
    for name in ("shape_iou", "polygon_iou"):
        p = plan(QUERIES[name](spark, small))
        assert "Join" not in p and "MapInArrow" in p, name
