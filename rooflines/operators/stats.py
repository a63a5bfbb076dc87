"""Roll-ups, regressions, shares, bins and top lists."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import checkpointed


def ratio_rollup(df: DataFrame, group: str, top: str, bottom: str) -> DataFrame:
    """Sums by group and over all (group total) with the ratio of the sums, not the mean of ratios."""
    sums = df.rollup(group).agg(F.sum(top).alias(top), F.sum(bottom).alias(bottom), F.grouping(group).alias("__all"))
    return sums.select(F.when(F.col("__all") == 1, "total").otherwise(F.col(group)).alias(group), top, bottom, (F.col(top) / F.nullif(F.col(bottom), F.lit(0))).alias("ratio"))


def log_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose cols are positive, with log_<col>."""
    for c in cols:
        df = df.where(F.col(c) > 0).withColumn(f"log_{c}", F.log10(c))
    return df


def ols(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """slope, intercept, r (the root of R2) and n, over all or by group."""
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(F.regr_r2(y, x)).alias("r"), F.regr_count(y, x).alias("n")]
    return df.groupBy(*([group] if group else [])).agg(*fit)


def fitted(df: DataFrame, fits: DataFrame, x: str, group: str | None = None) -> DataFrame:
    """df with fitted, from a small table of fits."""
    both = df.join(F.broadcast(fits), group) if group else df.crossJoin(F.broadcast(fits))
    return both.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x))


def _same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in cols], F.lit(True))


def value_places(df: DataFrame, value: str, *partition: str) -> DataFrame:
    """partition, value, __k (rows with it), __first (the first one's place from 0 in the partition's order) and __n (the partition's rows).

    Equal values are counted before they are shuffled, and the values are dealt out by range: a large partition is a slice in each of
    many tasks. Counts run within a slice and are put together by a table of one row for each slice.
    """
    counts = df.groupBy(*partition, value).agg(F.count("*").alias("__k"))
    dealt = checkpointed(counts.repartitionByRange(*partition, value).withColumn("__p", F.spark_partition_id()))
    upto = Window.partitionBy("__p", *partition).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("__upto", F.sum("__k").over(upto))
    slices = dealt.groupBy("__p", *partition).agg(F.sum("__k").alias("__s"))
    before = Window.partitionBy(*partition).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("__p", *partition, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__from"), F.sum("__s").over(Window.partitionBy(*partition)).alias("__n"))
    both = local.join(starts, _same(local, starts, ("__p", *partition))).drop(*(starts[c] for c in ("__p", *partition)))
    return both.select(*partition, value, "__k", (F.col("__from") + F.col("__upto") - F.col("__k")).alias("__first"), "__n")


def ranks(df: DataFrame, value: str, alias: str, *partition: str) -> DataFrame:
    """df with ranks from 1; equal values share the mean of their ranks."""
    ranked = value_places(df, value, *partition).select(*partition, value, (F.col("__first") + (F.col("__k") + 1) / 2).alias(alias))
    return df.join(ranked, _same(df, ranked, (*partition, value))).drop(*(ranked[c] for c in (*partition, value)))


def percentiles(df: DataFrame, value: str, at: list[float], *partition: str) -> DataFrame:
    """partition and p: array<double>, value's percentiles (0 to 1) with linear interpolation, nulls left out; no row where there are none."""
    rows = value_places(df.where(F.col(value).isNotNull()).select(*partition, F.col(value).cast("double").alias(value)), value, *partition)
    place = lambda q: q * (F.col("__n") - 1)
    holds = lambda x: (x >= F.col("__first")) & (x < F.col("__first") + F.col("__k"))
    marks = F.transform(F.array(*map(F.lit, at)), lambda q, i: F.struct(i.alias("i"), (place(q) - F.floor(place(q))).alias("part"), holds(F.floor(place(q))).alias("low"), holds(F.ceil(place(q))).alias("high")))
    # of all values only those at the wanted places go on
    found = rows.withColumn("__m", F.explode(F.filter(marks, lambda m: m["low"] | m["high"])))
    end = lambda side: F.max(F.when(F.col("__m")[side], F.col(value)))
    each = found.groupBy(*partition, F.col("__m.i").alias("__i")).agg((end("low") + (end("high") - end("low")) * F.max("__m.part")).alias("__v"))
    return each.groupBy(*partition).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias("p")).where(F.size("p") > 0)


def spearman(df: DataFrame, x: str, y: str, *partition: str) -> DataFrame:
    both = ranks(ranks(df, x, "__rx", *partition), y, "__ry", *partition)
    return both.groupBy(*partition).agg(F.corr("__rx", "__ry").alias("rho"))


def equalised_edges(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row, edges: percentiles 30 + 70 (1 - (1 - x)^2.5) for n+1 even steps x, each once; [0, 1] where there are no values."""
    at = [min(1.0, (30 + 70 * (1 - (1 - i / n) ** 2.5)) / 100) for i in range(n + 1)]
    # grouped by nothing there is one row at most; the outer aggregate makes it one in any case
    return percentiles(df, value, at).agg(F.coalesce(F.array_distinct(F.first("p")), F.array(F.lit(0.0), F.lit(1.0))).alias("edges"))


def density(df: DataFrame, x: str, y: str, cell: float = 0.05) -> DataFrame:
    """Gaussian density at each distinct point, with Scott's bandwidth and the full covariance.

    Points are weighed by binning to cells of `cell` bandwidths and each point sums over the cells, whose number is bounded by the
    plane they cover, not by the rows; the cells are broadcast.
    """
    s = df.agg(F.count("*").alias("n"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    if not s["n"] or not s["xx"] or not s["yy"] or s["xx"] * s["yy"] == s["xy"] ** 2:
        return df.withColumn("density", F.lit(None).cast("double"))
    h2 = s["n"] ** (-1 / 3)  # Scott's factor n^(-1/(d+4)), squared, for two dimensions
    a, b, c = s["xx"] * h2, s["xy"] * h2, s["yy"] * h2
    det = a * c - b * b
    bin_x, bin_y = cell * math.sqrt(a), cell * math.sqrt(c)
    at = lambda v, m, w: F.round((F.col(v) - m) / w)
    cells = df.groupBy(at(x, s["mx"], bin_x).alias("__i"), at(y, s["my"], bin_y).alias("__j")).agg(F.count("*").alias("__w"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    q = (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det
    points = df.select(x, y).distinct()
    near = 8  # bandwidths, beyond which exp(-32) adds nothing
    wide = lambda v, w: F.floor(F.col(v) / (near * w))
    gx, gy = math.sqrt(a), math.sqrt(c)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = points.withColumn("__o", F.explode(around)).withColumn("__cx", wide(x, gx) + F.col("__o.i")).withColumn("__cy", wide(y, gy) + F.col("__o.j")).drop("__o")
    keyed = cells.withColumn("__cx", wide("__x", gx)).withColumn("__cy", wide("__y", gy))
    summed = spread.join(keyed, ["__cx", "__cy"]).groupBy(x, y).agg((F.sum(F.col("__w") * F.exp(-q / 2)) / F.lit(s["n"] * 2 * math.pi * math.sqrt(det))).alias("density"))
    return df.join(summed, [x, y])


def share_of_total(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("__t"))
    return df.crossJoin(F.broadcast(total)).withColumn(alias, F.col(value) / F.nullif(F.col("__t"), F.lit(0)) * 100).drop("__t")


def cumulative_share(groups: DataFrame, key: str, value: str) -> DataFrame:
    """A table of groups (one row each): running sum and percentage in descending order, and its fifth from 0 to 4."""
    w = Window.orderBy(F.desc(value), key)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pct = F.col("running") / F.sum(value).over(Window.partitionBy()) * 100
    return groups.withColumn("running", running).withColumn("pct", pct).withColumn("fifth", (F.ceil(F.round(F.col("pct"), 9) / 20) - 1).cast("int"))


def top_and_rest(groups: DataFrame, key: str, value: str, n: int, rest: str = "Rest of World") -> DataFrame:
    """The n largest and one row for all others."""
    w = Window.orderBy(F.desc(value), key)
    ranked = groups.withColumn("__n", F.row_number().over(w))
    return ranked.groupBy(F.when(F.col("__n") <= n, F.col(key)).otherwise(rest).alias(key)).agg(F.sum(value).alias(value), F.least(F.min("__n"), F.lit(n + 1)).alias("place"))


def top_and_bottom(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n largest and the n smallest, with a row of dashes between, by place."""
    top = df.select(key, value).orderBy(F.desc(value), key).limit(n).withColumn("part", F.lit(0))
    bottom = df.select(key, value).orderBy(value, F.desc(key)).limit(n).withColumn("part", F.lit(2))
    dashes = df.sparkSession.createDataFrame([("---", None, 1)], f"{key} string, {value} double, part int")
    return top.withColumn(key, F.col(key).cast("string")).unionByName(dashes).unionByName(bottom.withColumn(key, F.col(key).cast("string")))


def min_max(df: DataFrame, metric: str, value: str, inverted: list[str], scope: list[str] = (), low: float = 0.2) -> DataFrame:
    """value scaled to [low, 1] within each metric (and scope); inverted metrics the other way round.

    A missing value counts as the worst: the largest for inverted metrics, else the smallest. Without a range all get 0.5 where there is
    a scope, 0.554 where there is none.
    """
    w = Window.partitionBy(*scope, metric)
    is_inverted = F.col(metric).isin(inverted) if inverted else F.lit(False)
    least, most = F.min(value).over(w), F.max(value).over(w)
    filled = F.coalesce(F.col(value), F.when(is_inverted, most).otherwise(least))
    x = (filled - least) / F.nullif(most - least, F.lit(0.0))
    scaled = low + (1 - low) * F.when(is_inverted, 1 - x).otherwise(x)
    return df.withColumn("scaled", F.coalesce(scaled, F.lit(0.5 if scope else 0.554)))


def error_metrics(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """By group and All: n, rmse, and R2 from sums that can be merged."""
    e = F.col(predicted) - F.col(truth)
    sums = df.rollup(group).agg(F.count("*").alias("n"), F.sum(e * e).alias("e2"), F.sum(F.col(truth) * F.col(truth)).alias("g2"), F.sum(truth).alias("g"), F.grouping(group).alias("__all"))
    r2 = 1 - F.col("e2") / F.nullif(F.col("g2") - F.col("g") * F.col("g") / F.col("n"), F.lit(0.0))
    return sums.select(F.when(F.col("__all") == 1, "All").otherwise(F.col(group)).alias(group), "n", F.sqrt(F.col("e2") / F.col("n")).alias("rmse"), r2.alias("r2"))


def contribution(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Sums of value, rows by columns, 0 where there are none, with the offset of each column's bar on those before."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0, columns)
    out, base = wide, F.lit(0.0)
    for c in columns:
        out = out.withColumn(f"{c}_from", base)
        base = base + F.col(c)
    return out


def histogram(df: DataFrame, value: str, bins: int = 25, upto: float = 0.99) -> DataFrame:
    """Counts in even bins from 0 to the upto-percentile, and one bin for what lies above."""
    top = percentiles(df, value, [upto]).agg(F.first(F.col("p")[0]).alias("__top"))
    at = F.when(F.col(value) > F.col("__top"), bins).otherwise(F.least(F.lit(bins - 1), F.floor(F.col(value) / F.nullif(F.col("__top"), F.lit(0.0)) * bins)))
    return df.crossJoin(F.broadcast(top)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")).drop("__top")


def inverse_frequency(binned: DataFrame) -> DataFrame:
    """binned (bin) with weight: 1 over its bin's count, all summing to 1."""
    counts = binned.groupBy("bin").agg(F.count("*").alias("__n"))
    bins = counts.agg(F.count("*").alias("__k"))
    return binned.join(F.broadcast(counts), "bin").crossJoin(F.broadcast(bins)).withColumn("weight", 1 / (F.col("__n") * F.col("__k"))).drop("__n", "__k")
