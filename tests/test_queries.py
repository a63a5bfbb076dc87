"""Every query against its SQL on the smallest tables."""

import pytest

from rooflines.plans import analysis_queries, detail_queries, footprint_queries, source_queries  # noqa: F401
from rooflines.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck, same):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        same(got, duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["key_join_samples"](spark, small)._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_spatial_join_is_an_equi_join(spark, small):
    plan = QUERIES["overlap_pairs"](spark, small)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_whole_raster_queries(spark, tmp_path):
    """All rows of a raster of more than 50, by brute force."""
    import math

    from rooflines.plans.fixtures import Tables

    sf = str(tmp_path)
    spark.range(1, 21_000).where("id % 11 <> 3").selectExpr("id AS o_orderkey").write.parquet(f"{sf}/orders.parquet")
    h = {(r.row, r.col): r.h for r in Tables(spark, sf).pixels().collect()}
    n = max(r for r, _ in h) + 1
    assert n > 50
    blocks = {}
    for (r, c), v in h.items():
        i = next(i for i in range(7) if i * n // 7 <= r < (i + 1) * n // 7)
        j = next(j for j in range(11) if j * 300 // 11 <= c < (j + 1) * 300 // 11)
        blocks.setdefault((i, j), []).append(v - 20)
    for name, f in {"whole_resample_max": max, "whole_resample_positive_sum": sum, "whole_resample_positive_avg": lambda v: round(sum(v) / len(v), 6)}.items():
        want = {k: f(p) if (p := [x for x in v if x > 0]) else -1 for k, v in blocks.items()}
        assert {(r.row, r.col): r.value for r in QUERIES[name](spark, sf).collect()} == pytest.approx(want)
    near = {}
    for r, c in h:
        if c % 4:
            found = [((r - a) ** 2 + (c - b) ** 2, a, b) for a in range(r - 2, r + 3) for b in range(c - 2, c + 3) if b % 4 == 0 and (a, b) in h]
            near[r, c] = min((x for x in found if x[0] <= 4), default=(0, 0, None))[2]
    assert {(r.row, r.col): r.near for r in QUERIES["whole_label_fill"](spark, sf).collect()} == near
    up = {}
    for i in range(2 * n - 1):
        at = [h[k] for j in range(450) if (k := (math.floor(i / 2 + 0.5), math.floor(j * 299 / 449 + 0.5))) in h]
        if at:
            up[i] = len(at), sum(at)
    assert {r.row: (r.n, r.total) for r in QUERIES["whole_upsampled_pixels"](spark, sf).collect()} == up
