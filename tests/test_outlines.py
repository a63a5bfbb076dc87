"""Outlines by ranking against a walk along each component's sides."""

import random

import pandas as pd
from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.operators import outlines, raster


def sides(pixels):
    """{component: sides, the component on their left} of {(row, col): component}."""
    out = {}
    for (r, c), k in pixels.items():
        for ar, ac, br, bc, nr, nc in ((0, 0, 0, 1, -1, 0), (0, 1, 1, 1, 0, 1), (1, 1, 1, 0, 1, 0), (1, 0, 0, 0, 0, -1)):
            if pixels.get((r + nr, c + nc)) != k:
                out.setdefault(k, []).append((r + ar, c + ac, r + br, c + bc))
    return out


def walked(pdf):
    """Rings of one component's sides, straight runs as one, turned so that what meets in a corner stays apart."""
    follow: dict[tuple, list[tuple]] = {}
    for ar, ac, br, bc in zip(pdf["ar"], pdf["ac"], pdf["br"], pdf["bc"], strict=True):
        follow.setdefault((ar, ac), []).append((br, bc))
    rings = []
    while follow:
        start = min(follow)
        ring, at, came = [start], start, None
        while True:
            options = follow[at]
            if came is not None and len(options) > 1:  # where two corners meet, turn so that the component stays whole
                dr, dc = at[0] - came[0], at[1] - came[1]
                options.sort(key=lambda o: dr * (o[1] - at[1]) - dc * (o[0] - at[0]))
            nxt = options.pop()
            if not options:
                del follow[at]
            came, at = at, nxt
            if at == start:
                break
            ring.append(at)
        pts = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
        rings.append([{"x": float(c), "y": float(r)} for r, c in [*pts, pts[0]]])
    return rings


def turned(rings):
    """Each ring from its least point on."""
    out = []
    for r in rings:
        points = [(p["x"], p["y"]) for p in r[:-1]]
        i = points.index(min(points))
        out.append((*points[i:], *points[:i]))
    return sorted(out)


def test_outlines_are_those_of_a_walk(spark):
    rand = random.Random(1)
    df = spark.createDataFrame([(r, c, rand.randint(0, 1)) for r in range(36) for c in range(30) if rand.random() < 0.95], "row int, col int, value int")
    labelled = raster.components(df, 16).cache()
    found = outlines.polygons(labelled).cache()
    got = {r.component: r for r in found.collect()}
    pixels = {(r.row, r.col): r.component for r in labelled.collect()}
    values = {r.component: r.value for r in labelled.collect()}
    want = {k: turned(walked(pd.DataFrame(s, columns=["ar", "ac", "br", "bc"]))) for k, s in sides(pixels).items()}
    assert {k: turned(r.rings) for k, r in got.items()} == want and {k: r.value for k, r in got.items()} == values
    counts = {k: sum(p == k for p in pixels.values()) for k in values}
    assert {r.component: r.a for r in found.select("component", geo.polygon_area(F.col("rings")).alias("a")).collect()} == counts
    # a shell runs counter-clockwise and its holes the other way
    runs = found.select(F.transform("rings", lambda r, i: (geo.signed_area(r) > 0) == (i == 0)).alias("ok"))
    assert all(all(r.ok) for r in runs.collect())


def test_a_background_with_many_holes(spark):
    n = 160
    hole = "row % 2 = 1 and col % 2 = 1"
    px = spark.range(n * n).selectExpr(f"id div {n} as row", f"id % {n} as col").selectExpr("row", "col", f"cast(case when {hole} then 1 else 0 end as double) as value", f"case when {hole} then row * 4294967296 + col else 0 end as component")
    found = outlines.polygons(px).select("component", F.size("rings").alias("n"), geo.polygon_area(F.col("rings")).alias("a")).collect()
    background = next(r for r in found if r.component == 0)
    # the holes of the last row and column lie open at the side
    assert background.a == n * n * 3 / 4 and background.n == 1 + (n // 2 - 1) ** 2 and len(found) == 1 + n * n // 4


def test_no_pixels(spark):
    assert outlines.polygons(spark.createDataFrame([], "row long, col long, value double, component long")).count() == 0
