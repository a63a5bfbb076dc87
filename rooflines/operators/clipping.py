"""Polygons cut by boxes into their parts, and the ranking of closed chains that this takes.

A polygon's edges are rows. What lies inside the frame are chains that enter and leave through it; where one leaves, the frame is followed
counter-clockwise, which keeps the polygon on the left, to where the next one enters. Chains linked so in a circle are a part's shell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from .raster import checkpointed

ENDS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("sx", "sy", "ex", "ey")])


def ranked_cycles(links: DataFrame) -> DataFrame:
    """links (node, next), each node once on either side. Gives node, cycle (its least node) and place in it, from 0 at that node.

    Pointer jumping: each round doubles how far a node sees, so a cycle of n takes about log2(n) joins, whatever cycles there are beside it.
    """
    now = checkpointed(links.select("node", F.col("next").alias("ptr"), F.col("node").alias("least"), F.lit(0).cast("long").alias("off")))
    reach = 1
    while True:
        far = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("__ptr"), F.col("least").alias("__least"), F.col("off").alias("__off"))
        nearer = F.col("__least") < F.col("least")
        step = now.join(far, "ptr").select("node", F.col("__ptr").alias("ptr"), F.when(nearer, F.col("__least")).otherwise(F.col("least")).alias("least"), F.when(nearer, F.col("__off") + reach).otherwise(F.col("off")).alias("off"), nearer.alias("moved"))
        now = checkpointed(step)
        if now.where("moved").isEmpty():
            break
        now, reach = now.drop("moved"), 2 * reach
    sizes = now.groupBy("least").agg(F.count("*").alias("n"))
    return now.join(sizes, "least").select("node", F.col("least").alias("cycle"), ((F.col("n") - F.col("off")) % F.col("n")).alias("place"))


@F.arrow_udf(ENDS)
def _part_within(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """The part of each edge ab that lies inside its box and not along it; null where there is none. As an expression, the JVM won't compile it: it's too long."""
    ax, ay, bx, by, x1, y1, x2, y2 = (c.to_numpy(zero_copy_only=False).astype(float) for c in (ax, ay, bx, by, x1, y1, x2, y2))
    axes, t0, t1 = [], np.zeros(len(ax)), np.ones(len(ax))
    with np.errstate(all="ignore"):
        for a, b, low, high in ((ax, bx, x1, x2), (ay, by, y1, y2)):
            d, level = b - a, (a > low) & (a < high)
            first = np.where(d == 0, np.where(level, -1.0, 2.0), np.minimum((low - a) / d, (high - a) / d))
            last = np.where(d == 0, np.where(level, 2.0, -1.0), np.maximum((low - a) / d, (high - a) / d))
            t0, t1 = np.maximum(t0, first), np.minimum(t1, last)
            axes.append((a, b, d, low, high, first, last))
        at = []
        for t, entering in ((t0, True), (t1, False)):
            for a, b, d, low, high, first, last in axes:
                side = np.where((d > 0) == entering, low, high)
                free = np.maximum(low, np.minimum(high, a + t * d))
                at.append(np.where(t == (0.0 if entering else 1.0), a if entering else b, np.where(t == (first if entering else last), side, free)))
    return pa.StructArray.from_arrays([pa.array(v) for v in at], ["sx", "sy", "ex", "ey"], mask=pa.array(~(t0 < t1)))


def _clipped_edges(rows: DataFrame) -> DataFrame:
    """id, ring, pos, a, b, frame: the part of each edge that lies inside the frame and not along it: s, e (its ends), whether they lie on the frame."""
    a, b, f = F.col("a"), F.col("b"), F.col("frame")
    part = _part_within.asNondeterministic()(a["x"], a["y"], b["x"], b["y"], f["x1"], f["y1"], f["x2"], f["y2"])
    out = rows.withColumn("v", part).where("v is not null").withColumn("s", geo.point(F.col("v.sx"), F.col("v.sy"))).withColumn("e", geo.point(F.col("v.ex"), F.col("v.ey")))
    on = lambda p: (p["x"] == f["x1"]) | (p["x"] == f["x2"]) | (p["y"] == f["y1"]) | (p["y"] == f["y2"])
    return out.select("id", "frame", "ring", "pos", "s", "e", on(F.col("s")).alias("enters"), on(F.col("e")).alias("leaves"))


def _around(p: Column, f: Column) -> Column:
    """How far along the frame a point on it lies, counter-clockwise from the lower left corner."""
    w, h = f["x2"] - f["x1"], f["y2"] - f["y1"]
    return F.when(p["y"] == f["y1"], p["x"] - f["x1"]).when(p["x"] == f["x2"], w + p["y"] - f["y1"]).when(p["y"] == f["y2"], w + h + f["x2"] - p["x"]).otherwise(2 * w + h + f["y2"] - p["y"])


def _chains(rows: DataFrame) -> DataFrame:
    """Runs of clipped edges from where they enter to where they leave; a ring that never touches the frame is one closed run (chain 0)."""
    ring = Window.partitionBy("id", "ring")
    counted = rows.withColumn("chain", F.sum(F.col("enters").cast("int")).over(ring.orderBy("pos"))).withColumn("last", F.max("chain").over(ring))
    # what comes before a ring's first entry goes on from its last one
    placed = counted.withColumn("turn", (F.col("chain") == 0).cast("int")).withColumn("chain", F.when(F.col("chain") == 0, F.col("last")).otherwise(F.col("chain")))
    made = placed.groupBy("id", "ring", "chain").agg(F.first("frame").alias("frame"), F.array_sort(F.collect_list(F.struct("turn", "pos", "s", "e"))).alias("edges"))
    return made.select("id", "frame", "ring", "chain", F.concat(F.array(F.col("edges")[0]["s"]), F.col("edges.e")).alias("points"))


def _linked(chains: DataFrame) -> DataFrame:
    """Open chains with the one that each goes on to (next), and the frame's corners on the way; closed ones come along as they are."""
    p, f, of = F.col("points"), F.col("frame"), Window.partitionBy("id", "ring").orderBy("chain")
    n = F.size(p)
    rows = chains.withColumn("first", p[0]).withColumn("last", F.element_at(p, -1)).withColumn("out", F.struct((p[n - 1]["x"] - p[n - 2]["x"]).alias("x"), (p[n - 1]["y"] - p[n - 2]["y"]).alias("y"))).withColumn("into", F.struct((p[1]["x"] - p[0]["x"]).alias("x"), (p[1]["y"] - p[0]["y"]).alias("y")))
    after = lambda c: F.coalesce(F.lead(c).over(of), F.first(c).over(of))
    rows = rows.withColumn("then", after(F.struct("first", "into")))
    # a ring that touches the frame from inside goes straight on where it turns left, and comes round from the other side where it turns right
    straight = (F.col("then.first") == F.col("last")) & (F.col("out.x") * F.col("then.into.y") - F.col("out.y") * F.col("then.into.x") > 0)
    rows = rows.select("id", "frame", "ring", "chain", "points", _around(F.col("first"), f).alias("from"), _around(F.col("last"), f).alias("to"), F.when(straight, 0).otherwise(2).alias("rank"))
    leaves = F.struct(F.col("to").alias("u"), F.col("rank").alias("rank"), F.lit(False).alias("entry"))
    ends = F.explode(F.when(F.col("chain") > 0, F.array(F.struct(F.col("from").alias("u"), F.lit(1).alias("rank"), F.lit(True).alias("entry")), leaves)).otherwise(F.array(leaves)))
    # the end where a chain leaves carries its points, so that nothing is joined to find what it goes on to
    events = rows.select("id", "frame", "ring", "chain", "points", ends.alias("v")).select("id", "frame", "ring", "chain", F.when(~F.col("v.entry"), p).alias("points"), "v.*")
    back = Window.partitionBy("id").orderBy(*map(F.desc, ("u", "rank", "ring", "chain")))
    entry = F.when(F.col("entry"), F.struct("ring", "chain", "u"))
    onward = F.coalesce(F.last(entry, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.last(entry, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = events.withColumn("onward", F.when(F.col("chain") > 0, onward)).where("not entry").withColumnRenamed("u", "to")
    w, h = f["x2"] - f["x1"], f["y2"] - f["y1"]
    round_ = 2 * (w + h)
    gap = lambda u: (u - F.col("to") + round_) % round_
    whole = F.when((gap(F.col("onward.u")) == 0) & (F.col("rank") == 2), round_).otherwise(gap(F.col("onward.u")))
    corners = F.array(*(F.struct(u.alias("u"), geo.point(x, y).alias("p")) for u, x, y in ((F.lit(0.0), f["x1"], f["y1"]), (w, f["x2"], f["y1"]), (w + h, f["x2"], f["y2"]), (2 * w + h, f["x1"], f["y2"]))))
    rows = rows.withColumn("whole", whole)
    passed = F.array_sort(F.filter(F.transform(corners, lambda c: F.struct(gap(c["u"]).alias("g"), c["p"].alias("p"))), lambda c: (c["g"] > 0) & (c["g"] < F.col("whole"))))
    key = lambda ring, chain: F.struct(F.col("id").alias("id"), ring.alias("ring"), chain.alias("chain"))
    is_open = F.col("chain") > 0
    return rows.select(key(F.col("ring"), F.col("chain")).alias("node"), F.when(is_open, key(F.col("onward.ring"), F.col("onward.chain"))).alias("next"), F.when(is_open, F.concat("points", F.transform(passed, lambda c: c["p"]))).otherwise(p).alias("points"))


def clip_parts(polygons: DataFrame) -> DataFrame:
    """polygons (id, rings, frame: a box) as id, part (from 0), rings: what lies inside the frame, a row for each separate part, with its holes.

    Polygons that lie inside are passed on; those that only touch the frame from outside, or not at all, have no rows. The order of
    parts is that of their first edges along the polygon's rings.
    """
    f = F.col("frame")
    inside = lambda b: (b["x1"] >= f["x1"]) & (b["y1"] >= f["y1"]) & (b["x2"] <= f["x2"]) & (b["y2"] <= f["y2"])
    outside = lambda b: (b["x1"] <= f["x1"]) & (b["y1"] <= f["y1"]) & (b["x2"] >= f["x2"]) & (b["y2"] >= f["y2"])
    boxed = polygons.select("id", "rings", "frame")
    which = lambda test: boxed.where(geo.once(geo.bounds(F.col("rings")), lambda b: geo.boxes_cross(b, f) & test(b)))
    turned = F.transform("rings", lambda r, i: F.when(i == 0, geo.oriented(r)).otherwise(geo.oriented(r, clockwise=True)))
    cut = which(lambda b: ~inside(b))
    # dealt out by polygon once: all windows and groups up to the chains' links stay within it
    rows = cut.select("id", "frame", "rings").repartition("id").select("id", "frame", F.posexplode(turned).alias("ring", "r")).select("id", "frame", "ring", F.posexplode(geo.edges(F.col("r"))).alias("pos", "e")).select("id", "frame", "ring", "pos", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    chains = checkpointed(_linked(_chains(_clipped_edges(rows))))
    linked = chains.where("next is not null")
    key = F.struct(F.col("node.ring").cast("int").alias("ring"), F.col("node.chain").cast("int").alias("chain"))
    closed = lambda points: geo.once(points, lambda r: F.concat(r, F.slice(r, 1, 1)))
    clean = lambda points: geo.opened(geo.without_doubles(points))
    # a chain that goes on to itself is a part's shell already
    own = linked.where("node = next").select("node", clean(F.col("points")).alias("whole"))
    others = linked.where("node <> next")
    circles = ranked_cycles(others.select("node", "next")).join(others.select("node", "points"), "node")
    several = circles.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("place", "points"))).alias("all")).select(F.col("cycle").alias("node"), clean(F.flatten(F.col("all.points"))).alias("whole"))
    shells = own.union(several).select(F.col("node.id").alias("id"), key.alias("key"), closed(F.col("whole")).alias("shell"))
    rings_inside = chains.where("next is null")
    lone = rings_inside.where("node.ring = 0").select(F.col("node.id").alias("id"), key.alias("key"), F.col("points").alias("shell"))
    # no ring of it crosses the frame, and it isn't inside: it covers the frame whole, or nothing of it
    found = chains.where("next is not null or node.ring = 0").select(F.col("node.id").alias("id"))
    around = checkpointed(which(lambda b: outside(b) & ~inside(b)).join(found, "id", "left_anti"))
    around = around.where(geo.polygon_shared_area(F.col("rings"), F.array(geo.ring_of_box(f))) > 0)
    around = around.select("id", F.struct(F.lit(-1).alias("ring"), F.lit(-1).alias("chain")).alias("key"), geo.ring_of_box(f).alias("shell"))
    outer = shells.union(lone).union(around)
    holes = rings_inside.where("node.ring > 0").groupBy(F.col("node.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("node.ring").alias("hole"), "points"))).alias("holes"))
    in_shell = F.filter("holes", lambda h: geo.covers_point(F.array("shell"), h["points"][0]["x"], h["points"][0]["y"]))
    parts = outer.join(holes, "id", "left").withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy("key")) - 1)
    rings = F.concat(F.array("shell"), F.when(F.col("holes").isNotNull(), F.transform(in_shell, lambda h: h["points"])).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")))
    return parts.select("id", "part", rings.alias("rings")).union(which(inside).select("id", F.lit(0), "rings"))
