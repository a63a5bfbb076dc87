"""What only shows on tables larger than the tests' own, on hand-made rows or read from the plan."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rooflines.functions import geo, polygons
from rooflines.operators import evaluation, rings
from rooflines.plans import detail_queries, footprint_queries  # noqa: F401
from rooflines.plans.fixtures import Tables
from rooflines.plans.registry import QUERIES
from rooflines.sources import files, geojson


def test_magnitudes_of_a_thousand_millions_and_more(spark):
    values = [0, 499_999, 500_000, 1_500_000, 2_500_000, 12_345_678, 1_140_865_716, 12_345_678_000]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.m for r in rows.orderBy("v").select(geo.magnitude(F.col("v")).alias("m")).collect()] == ["0M", "0M", "1M", "2M", "3M", "12M", "1141M", "12346M"]


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_rings_bring_their_columns_along(spark, small):
    t = Tables(spark, small)
    for name in ("densified_rings", "vertex_angles", "contour_projection"):
        assert "Broadcast" not in plan(QUERIES[name](spark, small)), name
    kites = t.kites()
    dense = rings.densified(kites, 3.0, "ring_id", "source")
    assert dense.columns == ["ring_id", "source", "pos", "k", "x", "y"]
    want = kites.select("ring_id", F.col("source").alias("s"))
    assert dense.count() > kites.count() and dense.join(want, "ring_id").where("source <> s").isEmpty()


def test_batches_of_polygons_are_as_each_by_itself():
    rand = np.random.default_rng(5)
    value = lambda rings: [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    column = [None, []]
    for i in range(400):
        made = []
        for _ in range(1 + i % 3):
            n = int(rand.integers(1, 13))
            r = rand.integers(0, 7, (n, 2)).astype(float) if i % 2 else np.stack([np.cos(np.arange(n) * 6.28 / n), np.sin(np.arange(n) * 6.28 / n)], 1) * rand.uniform(1, 5) + rand.normal(0, 0.1, (n, 2)) + 3
            made.append(np.concatenate([r, r[:1]]) if i % 5 else r)
        column.append(value(made))
    a = pa.array(column, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    each, read = [polygons.as_rings(v) for v in column], polygons.Rings.read(a)
    assert read.value().to_pylist() == [polygons.as_value(r) for r in each]
    assert a.slice(7, 90).to_pylist() == column[7:97] and polygons.Rings.read(a.slice(7, 90)).value().to_pylist() == [polygons.as_value(r) for r in each[7:97]]
    assert polygons.valid_rings(read).tolist() == [polygons.is_valid(r) for r in each]
    boxes = np.array([(b[0], b[1], b[0] + c[0], b[1] + c[1]) for b, c in zip(rand.integers(0, 5, (402, 2)), rand.uniform(0.5, 5, (402, 2)), strict=True)], float)
    assert polygons.clipped_rings(read, boxes).value().to_pylist() == [polygons.as_value(polygons.clip_to_box(r, *b)) for r, b in zip(each, boxes, strict=True)]
    for tolerance in (0.0, 0.3, 2.0):
        lines = [r for v in each for r in v if len(r) > 1]
        keep = polygons.simplified_lines(np.concatenate(lines), np.cumsum([0, *map(len, lines)]), tolerance)
        want = [polygons.douglas_peucker(r, tolerance) for r in lines]
        assert np.array_equal(np.concatenate(lines)[keep], np.concatenate(want))


def test_a_batch_of_polygons_takes_no_longer_than_its_points_ask():
    n = 20_000
    ring = np.array([(0, 0), (1, 0.0), (2, 0), (2, 0.5), (2, 1), (1.5, 1), (1, 1), (1, 1.5), (1, 2), (0.5, 2), (0, 2), (0, 1)], float)
    many = polygons.Rings(np.concatenate([ring] * n), np.arange(n + 1) * 12, np.arange(n + 1))
    before = time.process_time()
    assert polygons.valid_rings(many).all()
    assert (np.diff(polygons.clipped_rings(many, np.tile([0.0, 0, 1, 1], (n, 1))).at) > 3).all()
    assert time.process_time() - before < 10


def test_overlaps_of_a_batch_are_the_expressions_own(spark):
    rand = np.random.default_rng(8)
    flower = lambda x, y, r, n: np.stack([x + np.cos(np.arange(n) * 6.283185 / n) * r * rand.uniform(0.4, 1, n), y + np.sin(np.arange(n) * 6.283185 / n) * r * rand.uniform(0.4, 1, n)], 1)
    square = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)

    def polygon(i: int) -> list:
        x, y = rand.integers(0, 12, 2)
        w, h = rand.integers(2, 7, 2)
        shell = flower(x, y, rand.uniform(1, 6), int(rand.integers(3, 9))) if i % 3 == 0 else square(x, y, w, h)
        out = [shell, square(x + 0.5, y + 0.5, w - 1, h - 1)] if i % 3 == 1 else [shell]
        return polygons.as_value([r[::-1] if rand.integers(2) else r for r in out])

    pairs = [(i, polygon(i), polygon(int(rand.integers(9)))) for i in range(300)]
    rows = spark.createDataFrame(pairs, "i int, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    both = rows.select(polygons.overlap(F.col("a"), F.col("b")).alias("got"), F.when(geo.polygons_meet(F.col("a"), F.col("b")), geo.polygon_shared_area(F.col("a"), F.col("b"))).alias("want")).collect()
    assert sum(r.got is None for r in both) > 30 and sum(r.got == 0 for r in both) > 3
    assert all((r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9) for r in both)


def test_pairs_of_shapes_are_worked_out_once_and_not_kept(spark, small):
    for name in ("shape_iou", "polygon_iou", "shape_quality"):
        p = plan(QUERIES[name](spark, small))
        assert p.count("ArrowEvalPython") == 1, (name, p)


def test_coordinates_are_read_once(spark, tmp_path):
    """A Polygon's text and a MultiPolygon's are one from_json, and mean what they did."""
    ring = "[[[0, 0], [2, 0], [2, 2], [0, 0]]]"
    parts = [("Polygon", ring), ("MultiPolygon", f"[{ring}, {ring}]"), ("Point", "[1, 2]")]
    one = ", ".join(f'{{"type": "Feature", "geometry": {{"type": "{k}", "coordinates": {c}}}, "properties": {{"id": "{k}"}}}}' for k, c in parts)
    (tmp_path / "a.geojson").write_text(f'{{"type": "FeatureCollection", "features": [{one}]}}')
    got = geojson.read_collection(spark, str(tmp_path))
    assert plan(got).count("from_json") == 1
    assert {r.id: r.geom and [len(p) for p in r.geom] for r in got.collect()} == {"Polygon": [1], "MultiPolygon": [1, 1], "Point": None}


def test_annotations_and_images_are_read_in_one_pass(spark, tmp_path):
    """An annotation's image may be in another file, or missing; the categories are a reading of their own."""
    note = lambda i, image: f'{{"id": {i}, "image_id": {image}, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4]], "area": 8, "bbox": [0, 0, 4, 4]}}'
    image = lambda i: f'{{"id": {i}, "width": 9, "height": 9, "file_name": "p{i}"}}'
    (tmp_path / "a.json").write_text(f'{{"images": [{image(1)}, {image(2)}], "annotations": [{note(10, 1)}, {note(11, 3)}, {note(12, 7)}], "categories": [{{"id": 1, "name": "house"}}]}}')
    (tmp_path / "b.json").write_text(f'{{"images": [{image(3)}], "annotations": [{note(13, 2)}]}}')
    got = files.read_coco(spark, str(tmp_path))
    assert plan(got).count("Scan json") == 2
    assert sorted((r.id, r.image_id, r.file_name, r.category, len(r.rings[0])) for r in got.collect()) == [(10, 1, "p1", "house", 3), (11, 3, "p3", "house", 3), (13, 2, "p2", "house", 3)]


def test_contours_are_neither_broadcast_nor_more_to_a_task_on_larger_tables(spark, small, monkeypatch):
    one = plan(QUERIES["contour_angle"](spark, small))
    assert "Broadcast" not in one and "hashpartitioning" in one
    monkeypatch.setattr(evaluation, "PREDICTIONS_A_TASK", 50)
    many = QUERIES["contour_angle"](spark, small)
    n = -(-many.count() // 50)
    assert n > 4 and f", {n})" in plan(many)
