"""Polygons cut into parts: hand-worked cases, and areas and validity of random ones; cycles of random permutations."""

import random

import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo, polygons
from rooflines.operators import clipping

from .test_spatial import RINGS, box, ring, square, star

FRAME = "struct<x1:double,y1:double,x2:double,y2:double>"
U = [ring([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)])]
AROUND = box(-10, -10, 10, 10)
CASES = {
    "arms": (U, box(-1, 5, 10, 10), [12.0, 12.0]),
    "whole": (U, box(0, 0, 9, 9), [63.0]),
    "inner": (U, box(1, 1, 8, 8), [34.0]),
    "away": (U, box(20, 20, 30, 30), []),
    "beside": (U, box(9, 0, 12, 9), []),
    "the frame inside, with a hole": ([square(-50, -50, 50, 50), square(-2, -2, 2, 2), square(20, 20, 30, 30)], AROUND, [384.0]),
    "a hole through one side": ([square(-50, -50, 50, 50), square(-2, -2, 20, 2)], AROUND, [352.0]),
    "a hole through the frame": ([square(-50, -50, 50, 50), square(-2, -20, 2, 20)], AROUND, [160.0, 160.0]),
    "the frame wholly inside": ([square(-50, -50, 50, 50)], AROUND, [400.0]),
    "a notch that touches the frame": ([ring([(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)])], box(-5, 0, 15, 4), [40.0]),
    "a notch to the far side": ([ring([(-20, -20), (20, -20), (20, 20), (5, 20), (0, -10), (-5, 20), (-20, 20)])], AROUND, [400 / 2 - 100 / 3, 400 / 2 - 100 / 3]),
    "a corner cut off": ([ring([(-20, -5), (20, -5), (0, 10)])], AROUND, [225.0]),
}


def frames(spark, rows):
    return spark.createDataFrame(rows, f"id string, rings {RINGS}, frame {FRAME}").repartition(3)


def test_hand_worked(spark):
    got = clipping.clip_parts(frames(spark, [(k, r, f) for k, (r, f, _) in CASES.items()])).select("id", "part", geo.polygon_area(F.col("rings")).alias("area"), polygons.valid("rings").alias("ok")).collect()
    assert all(r.ok for r in got)
    for name, (_, _, want) in CASES.items():
        own = sorted((r.part, r.area) for r in got if r.id == name)
        assert [p for p, _ in own] == list(range(len(want))) and sorted(a for _, a in own) == pytest.approx(sorted(want)), name


def test_random_stars(spark):
    rand, rows = random.Random(1), []
    for i in range(120):
        a, b, c, d = (rand.randint(-30, 30) for _ in range(4))
        rows.append((str(i), [star(rand, rand.choice([3, 5, 12, 40]), rand.randint(-20, 20), rand.randint(-20, 20), rand.choice([5, 20, 60]))], box(min(a, b), min(c, d), max(a, b) + 1, max(c, d) + 1)))
    df = frames(spark, rows).where(polygons.valid("rings")).cache()
    parts = clipping.clip_parts(df).cache()
    got = {r.id: r.area for r in parts.groupBy("id").agg(F.sum(geo.polygon_area(F.col("rings"))).alias("area")).collect()}
    want = {r.id: r.area for r in df.select("id", geo.polygon_shared_area(F.col("rings"), F.array(geo.ring_of_box(F.col("frame")))).alias("area")).collect()}
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-6)
    assert parts.where(~polygons.valid("rings")).count() == 0 and parts.where("part > 0").count() >= 2


def test_nothing_to_cut(spark):
    assert clipping.clip_parts(frames(spark, [])).count() == 0


def test_cycles(spark):
    rand, links, want = random.Random(3), [], {}
    names = list(range(1000))
    rand.shuffle(names)
    at = 0
    for n in [1, 1, 2, 3, 64, 65, 600, 264]:
        cycle = names[at : at + n]
        at += n
        least = cycle.index(min(cycle))
        cycle = cycle[least:] + cycle[:least]
        links += [(x, cycle[(i + 1) % n]) for i, x in enumerate(cycle)]
        want |= {x: (cycle[0], i) for i, x in enumerate(cycle)}
    got = clipping.ranked_cycles(spark.createDataFrame(links, "node long, next long").repartition(4)).collect()
    assert {r.node: (r.cycle, r.place) for r in got} == want


def test_chains_that_close_themselves_take_no_rounds(spark, monkeypatch):
    """A part of one chain is a shell already; only parts of several chains are ranked."""
    seen, ranked = [], clipping.ranked_cycles
    monkeypatch.setattr(clipping, "ranked_cycles", lambda links: seen.append(links.count()) or ranked(links))
    assert clipping.clip_parts(frames(spark, [("arms", *CASES["arms"][:2])])).count() == 2
    plus = [ring([(-20, -2), (-2, -2), (-2, -20), (2, -20), (2, -2), (20, -2), (20, 2), (2, 2), (2, 20), (-2, 20), (-2, 2), (-20, 2)])]
    assert [r.area for r in clipping.clip_parts(frames(spark, [("plus", plus, AROUND)])).select(geo.polygon_area(F.col("rings")).alias("area")).collect()] == [144.0]
    assert seen == [0, 4]
