"""Rings as tables of their vertices or edges: neighbours, lengths, resampling, projection, segments, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def edge_table(rings: DataFrame, key: str = "ring_id", *keep: str) -> DataFrame:
    """rings (key, ring: closed): a row for each edge with pos, ax, ay, bx, by, len, the length before it, and the ring's columns to keep."""
    e = rings.select(key, *keep, F.posexplode(geo.edges(F.col("ring"))).alias("pos", "e"))
    flat = e.select(key, *keep, "pos", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    along = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).withColumn("before", F.coalesce(F.sum("len").over(along), F.lit(0.0)))


def with_neighbours(vertices: DataFrame, key: str, *cols: str) -> DataFrame:
    """vertices (key, pos, cols): prev_ and next_ of each col, around the closed ring."""
    w = Window.partitionBy(key).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in cols:
        vertices = vertices.withColumn(f"prev_{c}", F.coalesce(F.lag(c).over(w), F.last(c).over(whole))).withColumn(f"next_{c}", F.coalesce(F.lead(c).over(w), F.first(c).over(whole)))
    return vertices


def vertex_angles(rings: DataFrame, key: str = "ring_id", *keep: str) -> DataFrame:
    """The angle at each vertex between the edges to its neighbours, 0 to 180 degrees; the ring's columns to keep, and len and before of the edge from it, come along."""
    v = with_neighbours(edge_table(rings, key, *keep).select(key, *keep, "pos", "len", "before", F.col("ax").alias("x"), F.col("ay").alias("y")), key, "x", "y")
    ux, uy, vx, vy = (F.col(f"{n}_{c}") - F.col(c) for n in ("prev", "next") for c in ("x", "y"))
    cosine = (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy))
    return v.withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def resampled(rings: DataFrame, interval: float, least: int, most: int, key: str = "ring_id") -> DataFrame:
    """Points at even lengths around each ring: clamp(round(perimeter / interval), least, most) of them, the last at the ring's begin again."""
    e = edge_table(rings, key)
    per = e.groupBy(key).agg(F.sum("len").alias("perimeter"))
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.round(F.col("perimeter") / interval).cast("int")))
    wanted = per.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    wanted = wanted.withColumn("at", F.when(F.col("i") == F.col("n") - 1, 0.0).otherwise(F.col("i") / (F.col("n") - 1) * F.col("perimeter"))).where("perimeter > 0")
    return _points_at(wanted, e, key).select(key, "i", "x", "y")


def _points_at(wanted: DataFrame, e: DataFrame, key: str) -> DataFrame:
    """An as-of join: places and edges' begins are sorted together and each place takes the last edge that began."""
    marks = e.where("len > 0").select(key, F.col("before").alias("at"), F.lit(0).alias("kind"), F.struct("ax", "ay", "bx", "by", "len", "before").alias("edge"), F.lit(None).cast("int").alias("i"))
    both = marks.unionByName(wanted.select(key, "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<ax:double,ay:double,bx:double,by:double,len:double,before:double>").alias("edge"), "i"))
    last = F.last("edge", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = F.least(F.lit(1.0), (F.col("at") - F.col("edge.before")) / F.col("edge.len"))
    placed = both.withColumn("edge", last).where("kind = 1").withColumn("t", t)
    return placed.withColumn("x", F.col("edge.ax") + F.col("t") * (F.col("edge.bx") - F.col("edge.ax"))).withColumn("y", F.col("edge.ay") + F.col("t") * (F.col("edge.by") - F.col("edge.ay")))


def densified(rings: DataFrame, density: float, key: str = "ring_id", *keep: str) -> DataFrame:
    """Each edge cut into equal parts no longer than density; the ring's columns to keep come along."""
    e = edge_table(rings, key, *keep).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / density)).cast("int"))
    out = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    return out.select(key, *keep, "pos", "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """struct<x, y, d>: the nearest point of the segment ab."""
    p, q, a, b, c, d = (F.col(v) if isinstance(v, str) else v for v in (px, py, ax, ay, bx, by))
    n = (c - a) * (c - a) + (d - b) * (d - b)
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p - a) * (c - a) + (q - b) * (d - b)) / n))).otherwise(0.0)
    x, y = a + t * (c - a), b + t * (d - b)
    return F.struct(x.alias("x"), y.alias("y"), F.hypot(p - x, q - y).alias("d"))


def projected(points: DataFrame, e: DataFrame, key: str) -> DataFrame:
    """points (key, pid, px, py) moved to the nearest point of the edges of the same key; ties by pos. Points far from each other never meet."""
    # both sides grow with the rings, whatever their files' sizes let Spark expect: neither is broadcast
    both = points.join(e.hint("merge"), key).withColumn("s", on_segment("px", "py", "ax", "ay", "bx", "by"))
    best = both.groupBy(key, "pid").agg(F.min_by(F.struct("s.x", "s.y", "s.d", "pos"), F.struct("s.d", "pos")).alias("b"))
    return best.select(key, "pid", "b.x", "b.y", F.col("b.d").alias("distance"), "b.pos")


def segments(vertices: DataFrame, size: int, step: int, key: str = "ring_id") -> DataFrame:
    """vertices (key, pos, x, y) as overlapping runs of size points around the ring: seg, k, and the point. Shorter rings are one run."""
    counts = vertices.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    runs = counts.withColumn("seg", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - 1) / step).cast("int") - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("n")) - 1)))
    return runs.withColumn("pos", ((F.col("seg") * step + F.col("k")) % F.col("n")).cast("int")).join(vertices, [key, "pos"])


def assembled(parts: DataFrame, key: str = "ring_id") -> DataFrame:
    """Overlapping runs (key, pos, x, y) put together: each place is the mean of what its runs say."""
    return parts.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("runs"))


def max_tangent_angle(errors: DataFrame, key: str, max_stretch: float = 2.0) -> DataFrame:
    """errors (key, pos, x, y on the prediction; tx, ty on the truth): the largest angle between matching edges, in degrees.

    Edges without length, and those that the projection stretches or shrinks by max_stretch or more, don't count; null where none do.
    """
    v = with_neighbours(errors, key, "x", "y", "tx", "ty")
    ux, uy, vx, vy = (F.col(f"next_{c}") - F.col(c) for c in ("x", "y", "tx", "ty"))
    lu, lv = F.hypot(ux, uy), F.hypot(vx, vy)
    fair = (lu > 0) & (lv > 0) & (lv < lu * max_stretch) & (lu < lv * max_stretch)
    cosine = F.least(F.lit(1.0), F.abs(ux * vx + uy * vy) / (lu * lv))
    return v.groupBy(key).agg(F.degrees(F.acos(F.min(F.when(fair, cosine)))).alias("angle"))


def clusters(pairs: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """DBSCAN from neighbour pairs (a, b, both ways, each with itself left out) of points (node): core points have least neighbours and more, themselves counted; node and cluster, null for noise."""
    from .raster import checkpointed, least_labels

    core = checkpointed(pairs.groupBy(F.col("a").alias("node")).agg((F.count("*") + 1).alias("__n")).where(F.col("__n") >= least).select("node"))
    of_core = pairs.join(core.hint("merge"), F.col("a") == F.col("node"), "left_semi")
    both = checkpointed(of_core.join(core.hint("merge"), F.col("b") == F.col("node"), "left_semi"))
    alone = core.select("node", F.col("node").alias("label"))
    names = alone.union(least_labels(both)).groupBy("node").agg(F.min("label").alias("cluster"))
    border = of_core.join(names.hint("merge"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("cluster").alias("cluster"))
    found = names.union(border.join(core.hint("merge"), "node", "left_anti"))
    return points.join(found.hint("merge"), "node", "left")


#: Blocks of 4 by 6 cells, with the cells that lie up to two beside them 6 by 10: no more than a long has bits. The block of 0 has 0 in its middle.
BLOCK = (4, 6)
#: From a cell to those up to two away, each two cells once.
LATER = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]


def with_cells_ahead(places: DataFrame, key: str) -> DataFrame:
    """places (key, x, y, n, cx, cy) with in_cell, the sum of n in its cell, and ahead, whose bits say which steps of LATER (_bit) lead to cells with places.

    Each place goes to its block and, near the edge, to those that look over it; a block marks its cells in the bits of one number.
    """
    start = lambda c, size: c - F.pmod(c + size // 2, F.lit(size))
    bx, by = (F.explode(F.array_distinct(F.array(*(start(F.col(c) + d, size) for d in steps)))) for c, size, steps in (("cx", BLOCK[0], (-2, 0)), ("cy", BLOCK[1], (-2, 0, 2))))
    bit = _bit(F.col("cx") - F.col("bx"), F.col("cy") - F.col("by") + 2)
    # dealt out once for both windows
    spread = places.withColumn("bx", bx).withColumn("by", by).withColumn("bit", bit.cast("int")).repartition(key, "bx", "by")
    seen = spread.withColumn("in_cell", F.sum("n").over(Window.partitionBy(key, "bx", "by", "cx", "cy"))).withColumn("mask", F.bit_or(F.expr("shiftleft(1L, bit)")).over(Window.partitionBy(key, "bx", "by")))
    own = seen.where((F.col("bx") == start(F.col("cx"), BLOCK[0])) & (F.col("by") == start(F.col("cy"), BLOCK[1])))
    return own.select(*places.columns, "in_cell", F.expr("shiftrightunsigned(mask, bit)").alias("ahead"))


def _bit(dx, dy):
    return dx * (BLOCK[1] + 4) + dy


def point_clusters(points: DataFrame, eps: float, least: int, key: str = "ring_id") -> DataFrame:
    """DBSCAN of each ring's points (key, pos, x, y) by their distance, at most eps: cluster, the pos of its first point; noise is a cluster of its own.

    Points in one place are one node with its count. Cells have a diagonal of eps, so all nodes of a cell are neighbours and its core nodes are one cluster,
    which goes by the first of them. Nodes of other cells are compared with those of the cells around that hold any, each two once. A point without coordinates is noise.
    """
    from .raster import checkpointed, least_labels

    side = eps / 2**0.5 * (1 - 1e-12)
    cell = [F.floor(F.col(c) / side).alias(f"c{c}") for c in "xy"]
    places = points.groupBy(key, "x", "y").agg(F.count("*").alias("n"), F.min("pos").alias("at")).select("*", *cell)
    nodes = checkpointed(with_cells_ahead(places, key).drop("cx", "cy"))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in LATER))
    left = nodes.select(key, "x", "y", "n", *cell, F.explode(F.filter(steps, lambda s: F.getbit("ahead", _bit(s["dx"], s["dy"])) == 1)).alias("s"))
    left = left.select(key, "x", "y", "n", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    right = nodes.select(key, *cell, *(F.col(c).alias(f"{c}2") for c in "xyn"))
    near = left.join(right.hint("merge"), [key, "cx", "cy"]).where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= eps)
    pairs = checkpointed(near.select(key, "x", "y", "n", "x2", "y2", "n2"))
    sides = F.inline(F.array(F.struct("x", "y", F.col("n2").alias("m")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("n").alias("m"))))
    counts = nodes.select(key, "x", "y", F.col("in_cell").alias("m"), "at").unionByName(pairs.select(key, sides), allowMissingColumns=True)
    in_order = Window.partitionBy(key, "cx", "cy").orderBy("at", "x", "y")
    core = counts.groupBy(key, "x", "y").agg(F.sum("m").alias("m"), F.max("at").alias("at")).where(F.col("m") >= least).select(key, "x", "y", "at", *cell)
    core = checkpointed(core.select(key, "x", "y", "cx", "cy", F.first("at").over(in_order).alias("to"), F.row_number().over(in_order).alias("nth")))
    of = core.select(key, "x", "y", "to")
    to = pairs.drop("n", "n2").join(of.hint("merge"), [key, "x", "y"], "left").join(of.toDF(key, "x2", "y2", "to2").hint("merge"), [key, "x2", "y2"], "left")
    to = checkpointed(to.where("to is not null or to2 is not null"))
    links = to.where("to is not null and to2 is not null").select(key, F.col("to").alias("a"), F.col("to2").alias("b")).distinct()
    named = least_labels(checkpointed(links.unionByName(links.select(key, F.col("b").alias("a"), F.col("a").alias("b")))), key).withColumnRenamed("node", "to")
    name = F.coalesce("label", "to")
    # what is no core node belongs to the first cluster that has a core node near it, in its own cell or around
    in_cell = core.where("nth = 1").join(named.hint("merge"), [key, "to"], "left").select(key, "cx", "cy", name.alias("in_cell"))
    border = to.where("to2 is null").select(key, F.col("x2").alias("x"), F.col("y2").alias("y"), "to").union(to.where("to is null").select(key, "x", "y", "to2"))
    border = border.join(named.hint("merge"), [key, "to"], "left").groupBy(key, "x", "y").agg(F.min(name).alias("beside"))
    found = points.select("*", *cell).join(in_cell.hint("merge"), [key, "cx", "cy"], "left").join(border.hint("merge"), [key, "x", "y"], "left").withColumn("found", F.least("in_cell", "beside"))
    return found.select(*points.columns, F.coalesce("found", "pos").alias("cluster"), F.col("found").isNull().alias("noise"))


def end_points(clustered: DataFrame, key: str = "ring_id") -> DataFrame:
    """Of each cluster of a ring its first point around the ring: key, pos, x, y, and how many points it stands for."""
    return clustered.groupBy(key, "cluster").agg(F.min(F.struct("pos", "x", "y")).alias("p"), F.count("*").alias("points")).select(key, "p.pos", "p.x", "p.y", "points")
