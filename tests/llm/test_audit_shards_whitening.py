"""Filter audit, interleaved shards and whitening: against SQL (test_operators), plain versions and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rooflines.llm import audit, bidiagonal, mixing, queries, sharding, whitening

from .test_operators import docs, odd, rows, with_files

# 11 ----------------------------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int, text string"


def plain_audit(table, labels):
    """By the words of the contract: every order is run over every document."""
    least = {}
    for d, t, _ in table:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[i] == 1} for i in (0, 1))
    by_part = defaultdict(list)
    for d, t, part in table:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and t in least and least[t] < d,
        }
        by_part[part or ""].append((d, {f for f in fails if fails[f]}))
    out = {}
    for part, members in by_part.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in m[1] for m in members) - len(gone), sum(m[1] == {f} for m in members),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return out


def as_audit(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_plain(spark):
    varied = " ".join(f"w{i}" for i in range(120))
    texts = [varied, varied, "A B c # d", "A B c # d", None, "", " ".join(["same"] * 150), varied + " $", "SHOUT " * 130, None, varied.upper(), "x" * 70_000 + " y" * 30_000, "Ä    x"]
    table = [(10 - i if i % 3 else i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)] + [(3, varied, "en"), (3, varied, "de"), (None, varied, "fr"), (None, "only here", "fr"), (None, "only here", "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (8, 1, None), (None, 1, 1), (77, 1, 1), (2, None, 1), (5, 1, 1)]
    df = spark.createDataFrame([(d, t, p, "x", 1) for d, t, p in table], "doc_id long, text string, lang string, part string, mask int").repartition(3)
    got = audit.filter_audit(df, spark.createDataFrame([(*x, "y") for x in labels], LABELS))
    assert as_audit(got) == plain_audit(table, labels) and got.count() == len({p or "" for _, _, p in table}) * 600
    no_labels = spark.createDataFrame([], LABELS)
    assert all(v[4] == v[5] == 0 for v in as_audit(audit.filter_audit(df, no_labels)).values())
    assert audit.filter_audit(df.limit(0), no_labels).count() == 0


def test_audit_query_plain(spark, small, tmp_path):
    table = pd.read_parquet(f"{small}/documents.parquet")
    labels = pd.read_parquet(f"{small}/labels.parquet")
    want = plain_audit(list(table[["doc_id", "text", "lang"]].itertuples(index=False)), list(labels[["doc_id", "quality", "toxic"]].itertuples(index=False)))
    assert as_audit(queries.queries()["op11_filter_audit"](spark, small)) == want


def test_gray_walk_is_inclusion_by_sets():
    counts = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    states = audit.walk(counts, 5)
    for active in range(32):
        assert (states[:, active] == counts[:, [m for m in range(32) if not m & active]].sum(axis=1)).all()


def test_audit_many_parts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a # b").alias("text"), F.concat(F.lit("l"), F.col("id") % 1200).alias("lang"))
    got = audit.filter_audit(df, spark.createDataFrame([], LABELS))
    sums = got.where("filter_order = 'EABCD' and step = 1").agg(F.count("*"), F.sum("removed"), F.sum("kept")).first()
    assert tuple(sums) == (1200, 2999, 1)


# 12 ----------------------------------------------------------------------------------------------------------------


def test_shards_hold_the_mixture(spark):
    sizes = {"big": 5000, "mid": 1000, "low": 37, None: 60}
    df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string").withColumn("doc_id", F.xxhash64("source", "doc_id")).repartition(7)
    got = rows(sharding.interleave(df, 40))
    per = got.groupby("shard").size()
    assert sorted(per.index) == list(range(40)) and per.max() - per.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for s, n in sizes.items():
        own = got[got.source.isna()] if s is None else got[got.source == s]
        each = own.groupby("shard").size().reindex(range(40), fill_value=0)
        assert each.sum() == n and abs(each - n / 40).max() <= 1.5
    again = rows(sharding.interleave(df.repartition(3), 40))
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    other = rows(sharding.interleave(df, 40, seed=1))
    assert sorted(map(str, got.values.tolist())) != sorted(map(str, other.values.tolist()))


def test_shards_by_shuffle_beyond_the_bound(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 50).alias("source"))
    few = rows(sharding.interleave(df, 8))
    monkeypatch.setattr(sharding, "MOST_STARTS", 3)
    assert sorted(map(str, few.values.tolist())) == sorted(map(str, rows(sharding.interleave(df, 8)).values.tolist()))


def test_shards_odd_rows(spark, tmp_path):
    df = odd(spark).withColumn("shard", F.lit("mine")).withColumn("__p", F.lit(1))
    got = sharding.interleave(df, 4)
    assert got.columns == [*df.columns, "_shard", "slot"] and sorted(r._shard for r in got.collect()) == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert sharding.interleave(df.limit(0), 4).count() == 0
    assert sorted((r._shard, r.slot) for r in sharding.interleave(df.limit(2), 40).collect()) == [(0, 0), (20, 0)]
    sharding.write_shards(odd(spark), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, odd(spark).select("doc_id", "text").collect()))
    folder = with_files(tmp_path, documents=odd(spark))
    whole = rows(queries.queries()["op12_interleaved_shards"](spark, folder))
    texts = Counter((None if pd.isna(d) else int(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows(odd(spark))[["doc_id", "text"]].values.tolist())
    assert Counter((None if pd.isna(d) else int(d), s, c) for d, s, c in whole[["doc_id", "size", "text_crc32"]].values.tolist()) == texts


# 13 ----------------------------------------------------------------------------------------------------------------

RANDOM = np.random.default_rng(5)
TURN = np.linalg.qr(RANDOM.standard_normal((24, 24)))[0]


@pytest.mark.parametrize(
    "matrix",
    [
        RANDOM.standard_normal((1, 1)), RANDOM.standard_normal((2, 2)), RANDOM.standard_normal((40, 40)), np.eye(12), np.diag([3.0, 3, 1, 1, 0, 2]), np.zeros((4, 4)), TURN @ np.diag([5.0] * 9 + [2] * 14 + [0]) @ TURN.T,
        np.hstack([RANDOM.standard_normal((20, 10))] * 2), np.diag(np.ones(30)) + np.diag(np.ones(29), 1), np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20) * 1e-7, 1), RANDOM.standard_normal((9, 9)) * 1e-120, RANDOM.standard_normal((9, 9)) * 1e120,
    ],
)
def test_singular_vectors(matrix):
    d = matrix.shape[1]
    squares, z = bidiagonal.right_singular(np.linalg.qr(matrix, "r"), d)
    want = np.linalg.svd(matrix, compute_uv=False)
    top = max(want.max(), 1e-300)
    assert np.abs(np.sqrt(squares) - want).max() <= 3e-8 * top and (np.abs(squares - want**2) <= 1e-13 * top**2).all() and (np.diff(squares) <= 0).all()
    assert np.abs(z.T @ z - np.eye(d)).max() < 1e-13
    small = matrix / top
    assert np.abs(small.T @ (small @ z) - z * (squares / top / top)).max() < 1e-13


def test_small_values_are_found_to_their_own_precision():
    from fractions import Fraction

    a, b = [1.0, 1e-3, 1e-6, 1e-9, 1e-12], [1e-2, 1e-5, 1e-8, 1e-11]
    found = sorted(bidiagonal.squared_values([x * x for x in a], [x * x for x in b]))
    product = 1.0
    for f in found:
        product *= f
    assert abs(product / float(np.prod([Fraction(x) ** 2 for x in a])) - 1) < 1e-14
    least = float(np.linalg.norm(np.linalg.inv(np.diag(a) + np.diag(b, 1)), 2)) ** -2
    assert abs(found[0] / least - 1) < 1e-12


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, z = np.linalg.eigh(c.T @ c / n)
    values, z = values[::-1], z[:, ::-1]
    real = [i for i in range(min(most, len(values))) if values[i] > values.sum() * 1e-12]
    return n, ((n * x - sums) ** 2).sum(axis=1), c @ z[:, real] / np.sqrt(values[real]), values[real] / values.sum()


def check_whitening(got, ids, vectors):
    n, deviation, w, explained = plain_whitening(vectors)
    assert len(got) == len(ids) * w.shape[1] and set(got.n) <= {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((wide * w).sum(axis=0))
    assert np.abs(wide * sign - w).max() < 1e-8
    assert got.drop_duplicates("vec_id").set_index("vec_id").loc[ids].deviation.tolist() == deviation.tolist()
    assert np.abs(got.groupby("component").explained.first().to_numpy() / explained - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_whitening_query_plain(spark, small):
    table = pd.read_parquet(f"{small}/embeddings.parquet")
    check_whitening(rows(queries.queries()["op13_whitening"](spark, small)), table.vec_id.tolist(), np.stack(table.embedding))


def test_whitening_folds_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    vectors = RANDOM.standard_normal((300, 5)) * [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(13)
    check_whitening(rows(whitening.whitening_report(df)), list(range(300)), vectors)


def test_whitening_odd_rows(spark):
    good = RANDOM.standard_normal((40, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0], [1.0, 2.0]]
    schema = "vec_id long, embedding array<double>, x string, slot int"
    make = lambda vs: spark.createDataFrame([(i, v, "t", 1) for i, v in enumerate(vs)], schema)
    check_whitening(rows(whitening.whitening_report(make(good + bad))), list(range(40)), good)
    assert whitening.whitening_report(make(bad[:5])).count() == 0 and whitening.whitening_report(make([])).count() == 0
    assert whitening.whitening_report(make(good[:1])).count() == 0 and whitening.whitening_report(make(good[:1] * 50)).count() == 0
    constant = [[v[0], 7.0, v[1], v[0]] for v in good]
    check_whitening(rows(whitening.whitening_report(make(constant))), list(range(40)), constant)
    twice = rows(whitening.whitening_report(make(good).union(make(good))))
    assert len(twice) == 2 * 40 * 4 and twice.identity_error.iloc[0] < 1e-10
    no_id = whitening.whitening_report(make(good).withColumn("vec_id", F.when(F.col("vec_id") > 5, F.col("vec_id"))))
    assert no_id.count() == 160 and no_id.where("vec_id is null").count() == 24
    huge = rows(whitening.whitening_report(make([*good, [1e300, 1.0, 2.0, 3.0]])))
    assert huge.deviation.isna().all() and len(huge) % 41 == 0


# 4 -----------------------------------------------------------------------------------------------------------------


def test_inverse_of_any_mean(spark):
    import math

    means = {"a": 0.01, "b": 1.0, "c": 37.5, "d": 5_000.0, "e": 1_000_000.0, "none": 0.0}
    table = spark.createDataFrame([*means.items(), (None, 2.0)], "__source string, rate double")
    got = {r["__source"]: r for r in mixing.inverses(table).collect()}
    assert got["none"].cdf == [1.0] and got["none"].low == 0 and got[None].rate == 2.0
    for name, mean in means.items():
        if not mean:
            continue
        low, cdf = got[name].low, got[name].cdf
        assert cdf[-1] == pytest.approx(1, abs=1e-12) and (np.diff(cdf) >= 0).all() and len(cdf) < 26 * math.sqrt(mean) + 100
        p = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(low, low + len(cdf))]
        assert np.abs(np.cumsum(p) - cdf).max() < 1e-7
        assert sum(k * (c - b) for k, b, c in zip(range(low, low + len(cdf)), [0.0, *cdf], cdf)) == pytest.approx(mean, rel=1e-9)


def test_a_tiny_source_is_repeated(spark):
    df = docs(spark, [(1, "x")]).withColumn("source", F.lit("tiny")).union(docs(spark, [(i, "word " * 2000) for i in range(2, 42)]).withColumn("source", F.lit("large")))
    counts = {r.source: (r.n, r.rate) for r in mixing.poisson_mix(df).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()}
    n, rate = counts["tiny"]
    assert rate == pytest.approx(200_000, rel=1e-3) and abs(n - rate) < 6 * rate**0.5
