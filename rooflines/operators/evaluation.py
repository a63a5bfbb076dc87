"""Scores of predictions against truth: class histograms, confusion, average precision, complexity-aware IoU."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, polygons
from .raster import checkpointed, spread
from .rings import densified, max_tangent_angle, projected
from .spatial import grid_join

#: Recall levels of the average.
RECALLS = [i / 100 for i in range(101)]
#: The first round of first_fits looks at this many truths and fewer; it bounds the work of a round, not what is found.
FIRST_TRUTHS = 100_000
#: So many predictions' points and edges are sorted in one task; it bounds a task, not what is done.
PREDICTIONS_A_TASK = 50_000


def class_totals(pixels: DataFrame, classes: int, ignore: int, *groups: str, all_name: str | None = None) -> DataFrame:
    """pixels (gt, pred): by class (and groups): intersect, union, pred_n, gt_n. With all_name a row set over all groups is added."""
    rows = pixels.where(F.col("gt") != ignore).select(*groups, F.explode(F.array_distinct(F.array("gt", "pred"))).alias("class"), "gt", "pred").where(F.col("class").between(0, classes - 1))
    hit = lambda c: F.sum(c.cast("long"))
    aggs = [hit((F.col("gt") == F.col("class")) & (F.col("pred") == F.col("class"))).alias("intersect"), hit(F.col("pred") == F.col("class")).alias("pred_n"), hit(F.col("gt") == F.col("class")).alias("gt_n")]
    out = rows.groupBy(*groups, "class").agg(*aggs)
    if all_name is not None:
        total = out.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("intersect", "pred_n", "gt_n")))
        out = out.unionByName(total.select(*(F.lit(all_name).alias(g) for g in groups), "class", "intersect", "pred_n", "gt_n"))
    return out.withColumn("union", F.col("pred_n") + F.col("gt_n") - F.col("intersect"))


def class_metrics(totals: DataFrame, beta: float = 1.0, fill: float | None = None) -> DataFrame:
    """iou, acc, dice, precision, recall, fscore of class totals; null (or fill) where the denominator is 0."""
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    i, u, p, g = (F.col(c) for c in ("intersect", "union", "pred_n", "gt_n"))
    precision, recall = ratio(i, p), ratio(i, g)
    cols = {"iou": ratio(i, u), "acc": recall, "dice": ratio(2 * i, p + g), "precision": precision, "recall": recall, "fscore": (1 + beta * beta) * precision * recall / F.nullif(beta * beta * precision + recall, F.lit(0.0))}
    return totals.select("*", *((c if fill is None else F.coalesce(c, F.lit(fill))).alias(n) for n, c in cols.items()))


def mean_metrics(metrics: DataFrame, *groups: str) -> DataFrame:
    """Means over classes, those without a value left out, and the share of pixels that are right; in percent with two places."""
    pct = lambda c: F.round(c * 100, 2)
    return metrics.groupBy(*groups).agg(pct(F.sum("intersect") / F.sum("gt_n")).alias("a_acc"), *(pct(F.avg(c)).alias(f"m_{c}") for c in ("iou", "acc", "dice", "fscore")))


def confusion(pixels: DataFrame, ignore: int | None = None) -> DataFrame:
    """gt, pred, n and the percentage of gt's pixels."""
    counts = (pixels if ignore is None else pixels.where(F.col("gt") != ignore)).groupBy("gt", "pred").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy("gt")) * 100)


def top_detections(detections: DataFrame, most: int) -> DataFrame:
    """The most detections of each image and category by score; ties by det."""
    w = Window.partitionBy("image", "category").orderBy(F.desc("score"), "det")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def pair_ious(detections: DataFrame, truths: DataFrame, side: float) -> DataFrame:
    """Pairs of an image and category whose boxes meet, with iou (of a crowd: the part of the detection that it covers).

    detections: image, category, det, score, lbox; truths: image, category, truth, crowd, ignored, rbox. Pairs that don't meet have an
    IoU of 0 and match nothing, so the grid join makes no others.
    """
    right = truths.select(F.col("image").alias("__image"), F.col("category").alias("__category"), "truth", "crowd", "ignored", "rbox")
    pairs = grid_join(detections, right, side, on=lambda a, b: (a["image"] == b["__image"]) & (a["category"] == b["__category"]), small_right=False)
    b, c = F.col("lbox"), F.col("rbox")
    iou = F.when(F.col("crowd"), geo.shared_area(b, c) / F.nullif(geo.box_area(b), F.lit(0.0))).otherwise(geo.box_iou(b, c))
    return pairs.select(*detections.columns, "truth", "crowd", "ignored", "rbox", F.coalesce(iou, F.lit(0.0)).alias("iou"))


def greedy_matches(candidates: DataFrame, threshold: float | Column, *keys: str) -> DataFrame:
    """candidates (image, category, det, score, truth, iou, ignored, crowd): det and the truth it takes.

    In the order of score each detection takes the best free truth of its image and category (and keys) with an IoU of threshold and more;
    counted truths go before ignored ones, and crowds may be taken again. The order matters, so rows are sorted by image, category and keys
    and a task goes through its own once; of an image's category it keeps the truths that are taken.
    """
    names = ["image", "category", *keys]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = done = used = None
        for batch in batches:
            taken = []
            for i, (own, det, truth, crowd) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), *(batch.column(c).to_pylist() for c in ("det", "truth", "crowd")), strict=True)):
                if own != group:
                    group, done, used = own, None, set()
                if (det,) != done and (crowd or truth not in used):
                    done = (det,)
                    used.add(truth)
                    taken.append(i)
            yield batch.select([*names, "det", "truth", "ignored"]).take(pa.array(taken, pa.int64()))

    fair = candidates.where(F.col("iou") >= F.least(F.lit(threshold) if isinstance(threshold, float) else threshold, F.lit(1 - 1e-10)))
    schema = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in (*names, "det", "truth"))
    rows = fair.select(*names, "det", "score", "truth", "iou", F.coalesce("ignored", F.lit(False)).alias("ignored"), "crowd")
    dealt = rows.repartition(*names).sortWithinPartitions(*names, F.desc("score"), "det", "ignored", F.desc("iou"), "truth")
    return dealt.select(*names, "det", "truth", "crowd", "ignored").mapInArrow(match, f"{schema}, ignored boolean")


def matched_detections(detections: DataFrame, truths: DataFrame, side: float, thresholds: list[float], areas: dict[str, tuple[float, float]], most: int) -> tuple[DataFrame, DataFrame]:
    """Detections as the precision curve wants them, and the counted truths: for each category, area range and IoU threshold.

    Of each image and category the most detections by score count. Truths that are ignored, crowds, or outside the area range [low, high]
    aren't counted, nor are detections that take one of them, nor unmatched ones outside the range.
    """
    ranges = F.array(*(F.struct(F.lit(n).alias("area_range"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, (a, b) in areas.items()))
    steps = F.array(*(F.lit(float(x)).alias("t") for x in thresholds))
    outside = lambda b: ~geo.box_area(F.col(b)).between(F.col("low"), F.col("high"))
    ranged = lambda df: df.withColumn("__a", F.explode(ranges)).select("*", "__a.*").drop("__a")
    top = top_detections(detections, most).drop("rank")
    pairs = ranged(pair_ious(top, truths, side)).withColumn("ignored", F.col("ignored") | F.col("crowd") | outside("rbox"))
    found = greedy_matches(pairs.withColumn("threshold", F.explode(steps)), F.col("threshold"), "area_range", "threshold")
    keys = ["image", "category", "det", "area_range", "threshold"]
    rows = ranged(top).withColumn("threshold", F.explode(steps)).join(found.select(*keys, F.col("truth").isNotNull().alias("hit"), F.col("ignored").alias("on_ignored")), keys, "left")
    left_out = F.when(F.col("hit"), F.col("on_ignored")).otherwise(outside("lbox"))
    counted = rows.where(~left_out).select(*keys, "score", F.coalesce("hit", F.lit(False)).cast("int").alias("tp"))
    fair = ranged(truths).where(~(F.col("ignored") | F.col("crowd") | outside("rbox"))).groupBy("category", "area_range").agg(F.count("*").alias("positives"))
    return counted, fair


def mean_average_precision(detections: DataFrame, truths: DataFrame, side: float, thresholds: list[float], areas: dict[str, tuple[float, float]], most: int) -> DataFrame:
    """category, area_range, threshold, ap, max_recall from boxes: pairs, greedy matches, curve, average. Without counted truths there's no row."""
    counted, fair = matched_detections(detections, truths, side, thresholds, areas, most)
    keys = ["category", "area_range", "threshold"]
    # a row for each category and area range
    curve = precision_curve(counted.join(fair, ["category", "area_range"]), F.col("positives"), *keys)
    every = fair.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return every.join(average_precision(curve, *keys), keys, "left").select(*keys, zero("ap"), zero("max_recall"))


def precision_curve(detections: DataFrame, positives: Column, *groups: str) -> DataFrame:
    """detections (score, image, det, tp) of groups: running tp, fp, recall (and the one before), precision and its envelope from the right.

    Rows are dealt out by ranges of group and score, so a large group is a slice in each of many partitions. Sums and maxima run within
    a slice and are put together by a table of one row for each slice, of which there are no more than partitions and groups.
    """
    order = [F.desc("score"), F.col("image"), F.col("det")]
    ranged = detections.withColumn("__pos", positives).repartitionByRange(*groups, *order)
    dealt = checkpointed(ranged.withColumn("__p", F.spark_partition_id()))
    within = Window.partitionBy("__p", *groups)
    upto = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("tps", F.sum("tp").over(upto)).withColumn("rank", F.count("*").over(upto))
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("__p", *groups).agg(F.sum("tp").alias("__tp"), F.count("*").alias("__n"))
    starts = slices.select("__p", *groups, F.coalesce(F.sum("__tp").over(before), F.lit(0)).alias("__tps"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rank"))
    same = lambda a, b: reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in ("__p", *groups)])

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, same(a, b)).drop(*(b[c] for c in ("__p", *groups)))

    out = joined(local, starts).withColumn("tps", F.col("tps") + F.col("__tps")).withColumn("rank", F.col("rank") + F.col("__rank")).withColumn("fps", F.col("rank") - F.col("tps"))
    out = out.withColumn("recall", F.col("tps") / F.col("__pos")).withColumn("recall_before", F.when(F.col("rank") == 1, -1.0).otherwise((F.col("tps") - F.col("tp")) / F.col("__pos")))
    out = out.withColumn("precision", F.col("tps") / F.col("rank")).drop("__tps", "__rank", "__pos")
    behind = of_group.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    later = out.groupBy("__p", *groups).agg(F.max("precision").alias("__m")).select("__p", *groups, F.max("__m").over(behind).alias("__m"))
    onward = within.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined(out, later).withColumn("envelope", F.greatest(F.max("precision").over(onward), F.col("__m"))).drop("__m", "__p")


def average_precision(curve: DataFrame, *groups: str) -> DataFrame:
    """The mean over RECALLS of the envelope where each recall is first reached, 0 where it never is.

    Each row serves the levels that it is the first to reach: those above the recall before it.
    """
    levels = F.array(*map(F.lit, RECALLS))
    served = F.size(F.filter(levels, lambda r: (r > F.col("recall_before")) & (r <= F.col("recall"))))
    return curve.groupBy(*groups).agg((F.sum(served * F.col("envelope")) / len(RECALLS)).alias("ap"), F.max("recall").alias("max_recall"))


def complexity_iou(iou, n, n_truth) -> Column:
    """IoU less the relative difference in vertices."""
    a, b, c = (F.col(x) if isinstance(x, str) else x for x in (iou, n, n_truth))
    return a * (1 - F.abs(b - c) / (b + c))


def first_fit(pairs: DataFrame, least: float) -> DataFrame:
    """pairs (pred, truth, truth_order, shared, pred_area): each prediction's first truth whose part of it is above least."""
    fair = pairs.where(F.col("shared") / F.col("pred_area") > least)
    return fair.groupBy("pred").agg(F.min_by("truth", "truth_order").alias("truth"))


def first_fits(predictions: DataFrame, truths: DataFrame, side: float, least: float, shared: Column, pred_area: Column, on: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """first_fit of the predictions (pred, lbox) and truths (truth, truth_order, rbox) whose boxes meet: pred, truth; shared and pred_area are of a pair's columns.

    Truths come in the order that decides, few first and then four times as many each round, and a prediction that has found
    its truth stays out of later rounds. Where boxes lie densely, most find theirs among the first, so the pairs that are
    looked at don't grow with the square of the tables. A truth without an order comes last.
    """
    rounds = max(0, math.ceil(math.log(max(1, truths.count()) / FIRST_TRUTHS, 4)))
    shares = [4.0 ** (i - rounds) for i in range(rounds)]
    bounds = truths.agg(F.percentile_approx("truth_order", shares, 1_000_000).alias("b")).first()["b"] or [] if rounds else []
    order, found, rest, low = F.col("truth_order"), None, predictions, None
    for high in [*sorted(set(bounds)), None]:
        part = truths if low is None else truths.where(F.coalesce(order > low, F.lit(True)))
        part = part if high is None else part.where(order <= high)
        pairs = grid_join(rest, part, side, on=on, small_right=False)
        here = first_fit(pairs.select("pred", "truth", "truth_order", shared.alias("shared"), pred_area.alias("pred_area")), least)
        if high is not None:
            here = checkpointed(here)
            rest = checkpointed(rest.join(here.select("pred"), "pred", "left_anti"))
        found, low = here if found is None else found.union(here), high
        if high is not None and rest.isEmpty():
            break
    return found


def angle_error(ux, uy, vx, vy) -> Column:
    """The angle between two directions, 0 to 180 degrees."""
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (ux, uy, vx, vy))
    return F.degrees(F.atan2(F.abs(a * d - b * c), a * c + b * d))


def contour_angles(predictions: DataFrame, truths: DataFrame, side: float, spacing: float, least_precision: float = 0.5, max_stretch: float = 2.0) -> DataFrame:
    """predictions (image, pred, lbox, rings) by the first truth (image, truth, order, rbox, rrings) that covers more than least_precision of them: pred, truth, angle.

    The prediction's contours get points no farther apart than spacing, which are moved to the nearest point of the truth's
    contours; angle is the largest between an edge and the moved one, in degrees, over all of its contours (null if none can be
    told). Predictions without such a truth have no row.
    """
    right = truths.select(F.col("image").alias("__image"), "truth", F.col("order").alias("truth_order"), "rbox", "rrings")
    met = grid_join(predictions.select("image", "pred", "lbox", "rings"), right.hint("merge"), side, on=lambda a, b: a["image"] == b["__image"], small_right=False)
    shares = met.select("pred", "truth", "truth_order", polygons.overlap(F.col("rings"), F.col("rrings")).alias("shared"), (geo.polygon_area(F.col("rings")) + 1e-8).alias("pred_area"))
    matched = checkpointed(first_fit(shares, least_precision))
    # as many partitions as the predictions ask, so that what one task sorts doesn't grow with the tables
    n = max(int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(matched.count() / PREDICTIONS_A_TASK))
    dealt = lambda df, *keys: df.repartition(n, *keys)
    contour = F.struct(F.col("pred").alias("pred"), F.col("ring").alias("ring"))
    own = dealt(predictions.select("pred", "rings"), "pred").join(dealt(matched.select("pred"), "pred").hint("merge"), "pred").select("pred", F.posexplode("rings").alias("ring", "points")).select(contour.alias("contour"), F.col("points").alias("ring"))
    walk = densified(dealt(own, "contour"), spacing, "contour").select("contour", F.struct("pos", "k").alias("place"), "x", "y")
    theirs = dealt(truths.select("truth", "rrings"), "truth").join(dealt(matched, "truth").hint("merge"), "truth").select("pred", F.posexplode("rrings").alias("k", "points")).select("pred", F.posexplode(geo.edges(F.col("points"))).alias("i", "e"), "k")
    theirs = theirs.select("pred", F.struct("k", "i").alias("pos"), F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    # a contour's points by the edges of the one truth that it is held against; a point's own place comes along in its key
    moved = projected(walk.select(F.col("contour.pred").alias("pred"), F.struct("contour", "place", "x", "y").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")).repartition(n, "pred"), dealt(theirs, "pred"), "pred")
    errors = moved.select("pid.contour", "pid.place", F.col("pid.x").alias("__x"), F.col("pid.y").alias("__y"), F.col("x").alias("tx"), F.col("y").alias("ty")).withColumnsRenamed({"__x": "x", "__y": "y"})
    angles = max_tangent_angle(dealt(errors.withColumnRenamed("place", "pos"), "contour"), "contour", max_stretch).groupBy(F.col("contour.pred").alias("pred")).agg(F.max("angle").alias("angle"))
    return matched.select("pred", "truth").join(angles.hint("merge"), "pred", "left")


def image_ious(predictions: DataFrame, truths: DataFrame, size: float) -> DataFrame:
    """By image: iou of the pixels (of size) that its predictions and its truths cover together, in part or whole, the vertices of both, and c_iou.

    predictions and truths: image, rings. Two empty sides have an IoU of 1. An image that only one side has counts the other as empty.
    """

    def covered(df: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
        b = geo.bounds(F.col("rings"))
        last = lambda lo, hi: F.greatest(F.floor(b[lo] / size), F.ceil(b[hi] / size) - 1)
        listed = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] / size), last(lo, hi)))
        px = spread(df).select("image", "rings", listed("x1", "x2").alias("col"), b.alias("b")).select("image", "rings", "col", F.explode(F.sequence(F.floor(F.col("b.y1") / size), F.greatest(F.floor(F.col("b.y1") / size), F.ceil(F.col("b.y2") / size) - 1))).alias("row"))
        x, y = F.col("col") * size, F.col("row") * size
        hit = px.where(geo.polygon_crosses_box(F.col("rings"), geo.box(x, y, x + size, y + size))).select("image", "row", "col", F.lit(side).alias("side"))
        points = df.groupBy("image").agg(F.sum(F.size(F.col("rings")[0]) - 1).alias("n")).select("image", F.lit(side).alias("side"), "n")
        return hit, points

    (p, n), (q, m) = covered(predictions, 1), covered(truths, 2)
    # a pixel's sides as bits: 3 where both cover it
    pixels = p.union(q).groupBy("image", "row", "col").agg(F.bit_or("side").alias("sides")).groupBy("image").agg(F.count_if(F.col("sides") == 3).alias("both"), F.count("*").alias("any"))
    vertices = n.union(m).groupBy("image").agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("n_truth"))
    rows = vertices.join(pixels, "image", "left").withColumn("iou", F.coalesce(F.col("both") / F.col("any"), F.lit(1.0)))
    return rows.select("image", "iou", "n", "n_truth", complexity_iou("iou", "n", "n_truth").alias("c_iou"))
