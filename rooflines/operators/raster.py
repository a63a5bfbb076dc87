"""Rasters as pixel tables (row, col, value): windows, overlap statistics, resampling, mosaics, masks to polygons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def checkpointed(df: DataFrame) -> DataFrame:
    """Computed once, kept in the shared folder of spark.checkpoint.dir; only a local session may set one of its own."""
    import tempfile

    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt out to all cores: a small file is one task, however much work each of its rows is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


# windows ----------------------------------------------------------------------------------------------------------


def clamped_starts(extent: Column, window: int, step: int) -> Column:
    """0, step, ... below extent; starts whose window would stick out are moved in, and repeat where several are."""
    return F.transform(F.sequence(F.lit(0), extent - 1, F.lit(step)), lambda s: F.least(s, extent - window))


def windows(images: DataFrame, window: int, step: int) -> DataFrame:
    """images (height, width) by sliding window: win, y, x; moved windows are counted as often as they come."""
    ys, xs = clamped_starts(F.col("height"), window, step), clamped_starts(F.col("width"), window, step)
    grid = F.flatten(F.transform(ys, lambda y, i: F.transform(xs, lambda x, j: F.struct((i * F.size(xs) + j).alias("win"), y.alias("y"), x.alias("x")))))
    return images.withColumn("__w", F.explode(grid)).select(*images.columns, "__w.win", "__w.y", "__w.x")


def crop_boxes(images: DataFrame, crop: int, step: int) -> DataFrame:
    """ceil((extent - crop) / step) + 1 boxes along each side, the last one moved in; images smaller than crop have one at 0."""
    n = lambda e: F.greatest(F.lit(0), F.ceil((F.col(e) - crop) / step)).cast("int")
    at = lambda e: F.transform(F.sequence(F.lit(0), n(e)), lambda i: F.greatest(F.lit(0), F.least(i * step, F.col(e) - crop)))
    return images.withColumn("y", F.explode(at("height"))).withColumn("x", F.explode(at("width")))


def patches(images: DataFrame, window: int) -> DataFrame:
    """Near-even patches: ceil(extent / window) along each side, of equal size but for the last, which takes what is left."""

    def cuts(e: str) -> Column:
        n = F.ceil(F.col(e) / window).cast("int")
        size = F.floor(F.col(e) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * size).alias("at"), F.when(i == n - 1, F.col(e) - i * size).otherwise(size).alias("size")))

    grid = images.withColumn("__y", F.explode(cuts("height"))).withColumn("__x", F.explode(cuts("width")))
    return grid.select(*images.columns, F.col("__y.at").alias("y"), F.col("__x.at").alias("x"), F.col("__y.size").alias("h"), F.col("__x.size").alias("w"))


def shifted_transform(t: Column, x, y) -> Column:
    """The affine transform (a, b, c, d, e, f) of a window that begins at pixel (x, y)."""
    x, y = geo.col(x), geo.col(y)
    return F.struct(t["a"], t["b"], (t["c"] + t["a"] * x + t["b"] * y).alias("c"), t["d"], t["e"], (t["f"] + t["d"] * x + t["e"] * y).alias("f"))


def overlap_stats(scores: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """scores (row, col, score) of overlapping windows by pixel: n, mean, var (of the mean of squares less the squared mean).

    With pixels (row, col) uncovered ones come too: mean and var null, which an export writes as -1 and -2.
    """
    stats = scores.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg(F.col("score") * F.col("score")).alias("__q"))
    out = stats.select("row", "col", "n", "mean", (F.col("__q") - F.col("mean") * F.col("mean")).alias("var"))
    return out if pixels is None else pixels.select("row", "col").join(out, ["row", "col"], "left").fillna(0, ["n"])


def exported_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumn("mean", F.coalesce("mean", F.lit(-1.0))).withColumn("var", F.coalesce("var", F.lit(-2.0)))


def patch_weight(y, x, size: int) -> Column:
    """1 at the patch's middle down to 0.5 at its border, by the distance to the nearest edge."""
    y, x = geo.col(y), geo.col(x)
    edge = F.least(y, x, size - 1 - y, size - 1 - x)
    return 0.5 + 0.5 * edge / ((size - 1) // 2)


def blended(scores: DataFrame, size: int) -> DataFrame:
    """scores (row, col, py, px, score): the weighted mean of what overlapping patches say."""
    w = patch_weight("py", "px", size)
    return scores.groupBy("row", "col").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))


# resampling and mosaics -------------------------------------------------------------------------------------------

#: Block aggregates by name; another may be given as a function of the value's column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "max": lambda v: F.max(F.when(v > 0, v)),
    "sum": lambda v: F.sum(F.when(v > 0, v)),
    "mean": lambda v: F.avg(F.when(v > 0, v)),
}


def block_index(at, extent: int, out: int) -> Column:
    """The output block i whose cells int(i * extent / out) to int((i + 1) * extent / out) - 1 hold `at`."""
    at = geo.col(at)
    return F.least(F.lit(out - 1), F.floor(((at + 1) * out - 1) / extent)).cast("int")


def downsample(pixels: DataFrame, height: int, width: int, out_height: int, out_width: int, how: str | Callable[[Column], Column] = "max") -> DataFrame:
    """Blocks of pixels by a positive-value aggregate; -1 where a block has no positive value."""
    agg = AGGREGATES[how] if isinstance(how, str) else how
    i, j = block_index("row", height, out_height), block_index("col", width, out_width)
    return pixels.groupBy(i.alias("row"), j.alias("col")).agg(F.coalesce(agg(F.col("value")).cast("double"), F.lit(-1.0)).alias("value"))


def upsample(pixels: DataFrame, height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Each output pixel takes the nearest input pixel, corners on corners."""
    spread = lambda at, n, m: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(at) - 0.5) * (m - 1) / max(n - 1, 1))).cast("int"), F.least(F.lit(m - 1), F.ceil((F.col(at) + 0.5) * (m - 1) / max(n - 1, 1)) - 1).cast("int"))
    return pixels.withColumn("__r", F.explode(spread("row", height, out_height))).withColumn("__c", F.explode(spread("col", width, out_width))).select(F.col("__r").alias("row"), F.col("__c").alias("col"), "value")


def height_of(pixels: DataFrame) -> int:
    """Rows from 0 to the last one that pixels has."""
    last = pixels.agg(F.max("row")).first()[0]
    return 0 if last is None else last + 1


def mosaic(pixels: DataFrame, nodata: float, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """pixels (file_order, row, col, value) of many rasters: the first file's value that isn't nodata; bounds are half-open rows and columns."""
    seen = pixels.where(F.col("value") != nodata)
    if bounds:
        seen = seen.where((F.col("row") >= bounds[0]) & (F.col("row") < bounds[1]) & (F.col("col") >= bounds[2]) & (F.col("col") < bounds[3]))
    return seen.groupBy("row", "col").agg(F.min_by("value", "file_order").alias("value"))


def reproject_to_mercator(target: DataFrame, pixels: DataFrame, lon0: float, lat0: float, step: float) -> DataFrame:
    """target (tx, ty in Mercator metres) with the value of the geographic pixel under it, null outside. The raster begins at (lon0, lat0), north-west."""
    places = target.withColumn("row", F.floor((F.lit(lat0) - geo.latitude("ty")) / step).cast("int")).withColumn("col", F.floor((geo.longitude("tx") - lon0) / step).cast("int"))
    return places.join(pixels.select("row", "col", "value"), ["row", "col"], "left")


def band_stats(pixels: DataFrame) -> DataFrame:
    """pixels (band, value): n, mean and population deviation of each band."""
    return pixels.groupBy("band").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def normalised(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """pixels (image, band, value): (value - mean) / std; images with a band of zeros only are left out."""
    dead = pixels.groupBy("image", "band").agg(F.max(F.abs("value")).alias("__m")).where("__m = 0").select("image").distinct()
    return pixels.join(dead, "image", "left_anti").join(F.broadcast(stats.select("band", "mean", "std")), "band").withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def stretched(value, mean, std) -> Column:
    """mean - 2 std to mean + 2 std as 0 to 255, cut at both ends."""
    low = geo.col(mean) - 2 * geo.col(std)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (geo.col(value) - low) / (4 * geo.col(std)) * 255))


def read_window(blocks: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """Pixels of a window from blocks (r0, c0, h, w, data: row-major array): only blocks that meet it are read."""
    near = blocks.where((F.col("r0") < row0 + height) & (F.col("c0") < col0 + width) & (F.col("r0") + F.col("h") > row0) & (F.col("c0") + F.col("w") > col0))
    px = near.select("r0", "c0", "w", F.posexplode("data").alias("__i", "value"))
    px = px.select((F.col("r0") + F.floor(F.col("__i") / F.col("w"))).cast("int").alias("row"), (F.col("c0") + F.col("__i") % F.col("w")).cast("int").alias("col"), "value")
    return px.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))


def to_blocks(pixels: DataFrame, side: int, fill: float) -> DataFrame:
    """pixels as blocks of side by side; missing pixels are filled."""
    at = pixels.select((F.floor(F.col("row") / side) * side).cast("int").alias("r0"), (F.floor(F.col("col") / side) * side).cast("int").alias("c0"), ((F.col("row") % side) * side + F.col("col") % side).cast("int").alias("k"), F.col("value").cast("double").alias("value"))
    blocks = at.groupBy("r0", "c0").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    return blocks.select("r0", "c0", F.lit(side).alias("h"), F.lit(side).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(fill))).alias("data"))


def scored(windows_: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Windows through a caller's model, a batch at a time; windows without any signal should be filtered before."""
    return windows_.mapInPandas(score, schema)


# labels, masks and polygons ---------------------------------------------------------------------------------------


def eroded(pixels: DataFrame, k: int) -> DataFrame:
    """Labelled pixels (row, col, label) whose k by k neighbours all have their label; each neighbourhood is counted, not gathered."""
    r = k // 2
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, k - r) for j in range(-r, k - r)))
    votes = pixels.withColumn("__o", F.explode(offsets)).select((F.col("row") + F.col("__o.i")).alias("row"), (F.col("col") + F.col("__o.j")).alias("col"), "label")
    return votes.groupBy("row", "col", "label").agg(F.count("*").alias("__n")).where(F.col("__n") == k * k).drop("__n").join(pixels, ["row", "col", "label"], "left_semi")


def components(pixels: DataFrame, side: int = 256) -> DataFrame:
    """pixels (row, col, value): 4-connected runs of equal values as component, the least (row, col) as row * 2^32 + col.

    Blocks of side by side are labelled by themselves; labels that meet across a seam are merged by passing on the least label, with a
    checkpoint each round, until none changes. Rounds are bounded by the number of blocks that a component crosses.
    """

    def label(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["row", "col"])
        r, c, value = (block[x].to_numpy() for x in ("row", "col", "value"))
        place = np.full((int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1), -1)
        place[r - r.min(), c - c.min()] = np.arange(len(r))
        pairs = np.concatenate([np.stack([x.ravel(), y.ravel()]) for x, y in ((place[1:], place[:-1]), (place[:, 1:], place[:, :-1]))], 1)
        a, b = pairs[:, (pairs >= 0).all(0)]
        a, b = a[value[a] == value[b]], b[value[a] == value[b]]
        root = np.arange(len(r))  # by place, so the least is the first
        while (root[a] != root[b]).any():
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], least)
            np.minimum.at(root, root[b], least)
            while (root[root] != root).any():
                root = root[root]
        return block.assign(component=r[root] * 2**32 + c[root])[["row", "col", "value", "component"]]

    keyed = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    marked = checkpointed(keyed.groupBy(F.floor(F.col("row") / side), F.floor(F.col("col") / side)).applyInPandas(lambda pdf: label(pdf), "row long, col long, value double, component long"))
    seam = lambda c, o: marked.where(F.col(c) % side == o)
    down, right = seam("row", side - 1), seam("col", side - 1)
    pairs = (
        down.select((F.col("row") + 1).alias("row"), "col", "value", F.col("component").alias("a")).join(seam("row", 0), ["row", "col", "value"]).select("a", F.col("component").alias("b"))
        .union(right.select("row", (F.col("col") + 1).alias("col"), "value", F.col("component").alias("a")).join(seam("col", 0), ["row", "col", "value"]).select("a", F.col("component").alias("b")))
        .distinct()
    )
    edges = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    names = least_labels(edges)
    return marked.join(names, F.col("component") == F.col("node"), "left").select("row", "col", "value", F.coalesce("label", "component").alias("component"))


def least_labels(edges: DataFrame, *within: str) -> DataFrame:
    """edges (a, b), both ways: node and the least node of its component, by passing labels on and following them; with the columns within, those of each of their values apart.

    All rounds' joins are by sorting: each side that looks small enough to be broadcast would go through the driver every round.
    """
    labels = checkpointed(edges.groupBy(*within, F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while not labels.isEmpty():
        passed = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), [*within, "b"]).groupBy(*within, F.col("a").alias("node")).agg(F.min("label").alias("via"))
        new = labels.join(passed.hint("merge"), [*within, "node"]).select(*within, "node", F.col("label").alias("old"), F.least("label", "via").alias("label"))
        jump = new.select(*within, F.col("node").alias("label"), F.col("label").alias("__l"))
        jumped = checkpointed(new.join(jump.hint("merge"), [*within, "label"], "left").select(*within, "node", "old", F.least("label", F.coalesce("__l", "label")).alias("label")))
        done = jumped.where("label <> old").isEmpty()
        labels = jumped.drop("old")
        if done:
            break
    return labels


def rasterised(boxes: DataFrame, value: str, size: float) -> DataFrame:
    """Boxes (lbox, value), or polygons where there are rings, burnt onto a grid of the given pixel size: each pixel that is covered in part or whole gets the largest value; others are absent (-1 in an export)."""
    b = F.col("lbox")
    span = lambda lo, hi: F.sequence(F.floor(b[lo] / size), F.greatest(F.floor(b[lo] / size), F.ceil(b[hi] / size) - 1))
    px = spread(boxes).withColumn("row", F.explode(span("y1", "y2"))).withColumn("col", F.explode(span("x1", "x2")))
    if "rings" in boxes.columns:
        x, y = F.col("col") * size, F.col("row") * size
        px = px.where(geo.polygon_crosses_box(F.col("rings"), geo.box(x, y, x + size, y + size)))
    return px.groupBy("row", "col").agg(F.max(value).alias("value"))


def nearest_fill(wanted: DataFrame, labelled: DataFrame, reach: int) -> DataFrame:
    """wanted (row, col) with the label of the nearest labelled pixel within reach, ties by place; null where there is none."""
    from .spatial import nearest

    points = wanted.select(F.struct("row", "col").alias("pid"), F.col("row").cast("double").alias("py"), F.col("col").cast("double").alias("px"))
    targets = labelled.select(F.struct("row", "col", "label").alias("tid"), F.col("row").cast("double").alias("ty"), F.col("col").cast("double").alias("tx"))
    return nearest(points, targets, float(reach)).select("pid.row", "pid.col", "tid.label", "distance")


def value_class(value, edges: list[float], background: str, palette: list[str]) -> Column:
    """The palette's colour of a value's bin; background where the value isn't positive."""
    return F.when(geo.col(value) <= 0, background).otherwise(F.element_at(F.array(*map(F.lit, palette)), geo.bin_of(value, edges) + 1))


def scaled_values(value, factor: float, floor: float) -> Column:
    """Positive values times factor, at least floor."""
    v = geo.col(value)
    return F.when(v > 0, F.greatest(v * factor, F.lit(floor))).otherwise(v)


def palette_class(pixels: DataFrame, palette: list[tuple[int, int, int]], unknown: int = 255) -> DataFrame:
    """pixels (r, g, b) with class, the colour's place in the palette; colours are told apart by 2r + 3g + 4b."""
    code = lambda r, g, b: 2 * r + 3 * g + 4 * b
    table = pixels.sparkSession.createDataFrame([(code(*c), i) for i, c in enumerate(palette)], "__code int, class int")
    out = pixels.withColumn("__code", code(F.col("r"), F.col("g"), F.col("b")).cast("int")).join(F.broadcast(table), "__code", "left")
    return out.drop("__code").withColumn("class", F.coalesce("class", F.lit(unknown)))


def window_of_bounds(b: Column, origin_x, origin_y, pixel) -> Column:
    """struct<row, col, height, width> in whole pixels of bounds on a north-up raster that begins at (origin_x, origin_y)."""
    at = lambda v: F.round(v / geo.col(pixel)).cast("int")
    col, row = at(b["x1"] - geo.col(origin_x)), at(geo.col(origin_y) - b["y2"])
    return F.struct(row.alias("row"), col.alias("col"), at(b["y2"] - b["y1"]).alias("height"), at(b["x2"] - b["x1"]).alias("width"))


def dissolved_area(boxes: DataFrame, group: str, size: float) -> DataFrame:
    """The area that a group's boxes cover together, on a grid of the given pixel size; exact where edges lie on the grid.

    A box is a span in each of its rows, not all of its pixels. Of spans with the same begin the longest stays, and each adds
    what lies beyond those before it, so a row of a group has no more of them than the grid has columns.
    """
    b = F.col("lbox")
    first = lambda lo: F.floor(b[lo] / size)
    last = lambda lo, hi: F.greatest(first(lo), F.ceil(b[hi] / size) - 1)
    rows = spread(boxes.select(group, "lbox")).select(group, first("x1").alias("lo"), last("x1", "x2").alias("hi"), F.explode(F.sequence(first("y1"), last("y1", "y2"))).alias("row"))
    spans = rows.where("lo is not null and hi is not null").groupBy(group, "row", "lo").agg(F.max("hi").alias("hi"))
    before = F.max("hi").over(Window.partitionBy(group, "row").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, before))
    return spans.select(group, new.alias("n")).groupBy(group).agg((F.sum("n") * F.lit(size * size)).alias("area"))
