"""That queries' cost grows with their tables: read from plans, or held against brute force on hand-made rows."""

import math
import random

from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.operators import evaluation, raster, spatial
from rooflines.plans import analysis_queries, detail_queries, footprint_queries, source_queries  # noqa: F401
from rooflines.plans.registry import QUERIES


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_greedy_matches_over_many_batches(spark):
    rand = random.Random(4)
    rows = [(i % 3, "ab"[i % 2], t, d, rand.choice((0.5, 0.7, 0.9)), k, rand.choice((0.4, 0.6, 0.8)), k % 4 == 0, k % 10 == 0) for i in range(12) for t in (0.5, 0.75) for d in range(i // 6 * 40, i // 6 * 40 + 30) for k in rand.sample(range(25), 6)]
    score = {(r[0], r[1], r[2], r[3]): r[4] for r in rows}
    rows = [(*r[:4], score[r[:4]], *r[5:]) for r in rows]
    want = set()
    for group in {r[:3] for r in rows}:
        used, done = set(), None
        for r in sorted((r for r in rows if r[:3] == group and r[6] >= r[2]), key=lambda r: (-r[4], r[3], r[7], -r[6], r[5])):
            if r[3] != done and (r[8] or r[5] not in used):
                done = r[3]
                used.add(r[5])
                want.add((*group, r[3], r[5], r[7]))
    df = spark.createDataFrame(rows, "image long, category string, t double, det long, score double, truth long, iou double, ignored boolean, crowd boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = evaluation.greedy_matches(df, F.col("t"), "t")
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # no call of Python for each group
    assert "FlatMapGroups" not in plan(found)


def boxes(rand, n: int, wide: int) -> list:
    return [(i, float(x := rand.randrange(60)), float(y := rand.randrange(60)), float(x + rand.randrange(1, wide)), float(y + rand.randrange(1, wide))) for i in range(n)]


def test_first_fits_by_rounds(spark, monkeypatch):
    rand = random.Random(6)
    a, b = boxes(rand, 150, 9), boxes(rand, 400, 9)
    share = lambda p, q: max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2])) / ((p[3] - p[1]) * (p[4] - p[2]))
    want = {p[0]: fits[-1][0] for p in a if (fits := [q for q in b if share(p, q) > 0.3])}  # the order is against the id
    table = lambda rows: spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    box = geo.box("x1", "y1", "x2", "y2")
    preds, truths = table(a).select(F.col("id").alias("pred"), box.alias("lbox")), table(b).select(F.col("id").alias("truth"), (-F.col("id")).alias("truth_order"), box.alias("rbox"))
    looked = []
    join = evaluation.grid_join
    monkeypatch.setattr(evaluation, "grid_join", lambda left, right, *x, **y: looked.append((left.count(), right.count())) or join(left, right, *x, **y))
    for first in (1_000, 20, 3):
        monkeypatch.setattr(evaluation, "FIRST_TRUTHS", first)
        looked.clear()
        got = evaluation.first_fits(preds, truths, 8.0, 0.3, geo.shared_area(F.col("lbox"), F.col("rbox")), geo.box_area(F.col("lbox"))).collect()
        assert {r.pred: r.truth for r in got} == want and len(got) == len(want)
        assert (len(looked) == 1) == (first == 1_000)
        assert sum(n * m for n, m in looked) < 150 * 400 or first == 1_000


def test_semi_and_anti_joins_by_rounds(spark, monkeypatch):
    rand = random.Random(7)
    a, b = boxes(rand, 200, 6), [r for r in boxes(rand, 120, 9) if r[1] < 35]
    want = {p[0] for p in a if any(p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4] for q in b)}
    assert 20 < len(want) < 180
    table = lambda rows: spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    box = geo.box("x1", "y1", "x2", "y2")
    left, right = table(a).select(F.col("id").alias("lid"), (F.col("id") % 2).alias("k"), box.alias("lbox")), table(b * 3).select((F.col("id") % 2).alias("j"), box.alias("rbox"))
    odd = {p[0] for p in a if any(p[0] % 2 == q[0] % 2 and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4] for q in b)}
    for first in (10_000, 5):
        monkeypatch.setattr(spatial, "FIRST_BOXES", first)
        for how, found, rest in (("left_semi", want, odd), ("left_anti", set(range(200)) - want, set(range(200)) - odd)):
            got = [r.lid for r in spatial.grid_join(left, right.select("rbox"), 8.0, how, small_right=False).collect()]
            assert set(got) == found and len(got) == len(found)
            got = [r.lid for r in spatial.grid_join(left, right, 8.0, how, on=lambda x, y: x["k"] == y["j"], small_right=False).collect()]
            assert set(got) == rest and len(got) == len(rest)


def test_rows_of_small_files_are_spread_before_their_pixels_are_listed(spark, small):
    for name in ("image_iou", "lod1_shape_height", "dissolved_houses", "rasterised_houses"):
        assert "RoundRobinPartitioning" in plan(QUERIES[name](spark, small)), name


def test_dissolved_boxes_are_spans(spark, small):
    rand = random.Random(8)
    a = boxes(rand, 80, 12) + [(90, 3.5, 4.25, 3.5, 9.5), (92, -7.5, -3.0, 2.25, 1.0)]
    want = {}
    for i, x1, y1, x2, y2 in a:
        cells = lambda lo, hi: range(math.floor(lo / 2), max(math.floor(lo / 2), math.ceil(hi / 2) - 1) + 1)
        want.setdefault(i % 2, set()).update((r, c) for r in cells(y1, y2) for c in cells(x1, x2))
    df = spark.createDataFrame(a, "id long, x1 double, y1 double, x2 double, y2 double").select((F.col("id") % 2).alias("g"), geo.box("x1", "y1", "x2", "y2").alias("lbox"))
    assert {r.g: r.area for r in raster.dissolved_area(df, "g", 2.0).collect()} == {g: len(cells) * 4.0 for g, cells in want.items()}
    # a row for each row of a box, not for each pixel
    assert plan(QUERIES["dissolved_houses"](spark, small)).count("Generate explode") == 1


def test_rounds_of_labels_send_no_table_through_the_driver(spark, small, monkeypatch):
    keep, plans = raster.checkpointed, []
    monkeypatch.setattr(raster, "checkpointed", lambda df: plans.append(plan(df)) or keep(df))
    found = QUERIES["size_clusters"](spark, small)
    found.collect()
    assert len(plans) > 5 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def shuffled_rows(spark, run) -> int:
    """How many rows all stages of run send to others."""
    sc = spark.sparkContext
    gate, store = sc._gateway, sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(gate.jvm.java.util.ArrayList(), False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = stages()
    return sum(s.shuffleWriteRecords() for i in range(found.size()) if (s := found.apply(i)).stageId() not in before)


def test_points_go_only_to_cells_that_hold_any(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = QUERIES["cluster_end_points"](spark, small).agg(F.sum("points")).first()[0]
        rows = shuffled_rows(spark, lambda: QUERIES["cluster_end_points"](spark, small).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert points < rows < 20 * points
