"""Spatial joins through the cells of a grid in levels, so that they shuffle like any other equi-join.

A cell of level k is 2^k times as wide as one of level 0, and lies in one cell of each level above. A box belongs to the
lowest level whose cells are no narrower than it, so it touches four cells there at most, however large it is. Two boxes
are brought together in the cells of the higher of their two levels. Polygons of many vertices are cut to such cells
once, and what is joined are the cells with the few edges that run through each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .raster import checkpointed

#: What is broadcast is measured first, as exploded to cells; beyond so many bytes both sides are shuffled.
MOST_BYTES = 16 << 20
#: The first round of a semi or anti join looks at this many of the right side's boxes and fewer; it bounds the work of a round, not what is found.
FIRST_BOXES = 50_000
#: A cell of a polygon is cut further while more edges than this run through it.
MOST_EDGES = 32
#: Where in a cell it is known whether the polygon covers it; fixed values, of no round places that vertices may have.
REF_X, REF_Y = 0.38196601125, 0.61803398875


def box_level(b: Column, side: float) -> Column:
    wide = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(wide / side)), F.lit(0))).cast("int")


def _side(level: Column, side: float) -> Column:
    return F.pow(F.lit(2.0), level) * side


def with_cells(df: DataFrame, box: str, side: float | Column, x: str = "cx", y: str = "cy") -> DataFrame:
    """A row for each cell of one level that a box touches, its edges included; column by column, then cell by cell, so that no row holds all of a box's cells."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(box)[lo] / side), F.floor(F.col(box)[hi] / side)))
    return df.withColumn(x, span("x1", "x2")).withColumn(y, span("y1", "y2"))


def levels(**sides: DataFrame) -> dict[str, list[int]]:
    """The levels that each side's rows have; at most some sixty numbers."""
    tagged = [df.select(F.lit(name).alias("side"), "__level") for name, df in sides.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.union(t)
    found = rows.distinct().collect()
    return {name: sorted(r["__level"] for r in found if r["side"] == name) for name in sides}


def _keys(level: Column, others: list[int], first: bool) -> Column:
    """array<struct<kind, level>>: where rows of a level meet those of the other side.

    Kind 0: pairs in which the left box's level is not above the right one's, kind 1: the others. In each, one side lists the
    other's levels and the other side stays at its own.
    """
    key = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("level"))
    if not others:
        return F.array().cast("array<struct<kind:int,level:int>>")
    all_others = F.array(*map(F.lit, others))
    if first:
        up, own, kinds = (lambda o: o >= level), F.exists(all_others, lambda o: o < level), (0, 1)
    else:
        up, own, kinds = (lambda o: o > level), F.exists(all_others, lambda o: o <= level), (1, 0)
    listed = F.transform(F.filter(all_others, up), lambda o: key(kinds[0], o))
    return F.concat(listed, F.when(own, F.array(key(kinds[1], level))).otherwise(F.array().cast("array<struct<kind:int,level:int>>")))


def bytes_of(df: DataFrame) -> int:
    """How large df's rows are when written out."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("n")).first()["n"]


def grid_join(left: DataFrame, right: DataFrame, side: float, how: str = "inner", on: Callable[[DataFrame, DataFrame], Column] | None = None, small_right: bool | None = None) -> DataFrame:
    """Rows whose boxes (columns lbox and rbox) meet, touching included; columns of both sides must differ in name.

    Both sides are exploded to cells and joined by cell, at the higher of a pair's levels. A pair that shares several
    cells is kept only in the one that holds the lower corner of its common box, so no distinct is needed. how: inner,
    left_semi or left_anti; the latter two take the pairs' left rows, so left must have the column lid, unique. on adds a
    condition. small_right: whether the right side is broadcast; None measures it. Where all boxes are of one level, the
    cells alone are the key.

    left_semi and left_anti look at a small part of a large right side first and at four times as much each round; left rows
    that have met something, or have nothing in their cells, stay out of later rounds, so that dense boxes don't make all
    their pairs.
    """
    lb, rb = F.col("lbox"), F.col("rbox")
    found = levels(left=left.select(box_level(lb, side).alias("__level")), right=right.select(box_level(rb, side).alias("__level")))
    if max([0, *found["left"], *found["right"]]) == 0:
        a, b, s, same = with_cells(left, "lbox", side, "__lx", "__ly"), with_cells(right, "rbox", side, "__rx", "__ry"), F.lit(side), F.lit(True)
    else:
        a = left.withColumn("__lk", F.explode(_keys(box_level(lb, side), found["right"], True)))
        b = right.withColumn("__rk", F.explode(_keys(box_level(rb, side), found["left"], False)))
        a, b = with_cells(a, "lbox", _side(F.col("__lk.level"), side), "__lx", "__ly"), with_cells(b, "rbox", _side(F.col("__rk.level"), side), "__rx", "__ry")
        s, same = _side(F.col("__lk.level"), side), (F.col("__lk.kind") == F.col("__rk.kind")) & (F.col("__lk.level") == F.col("__rk.level"))
    home = (F.floor(F.greatest(lb["x1"], rb["x1"]) / s) == F.col("__lx")) & (F.floor(F.greatest(lb["y1"], rb["y1"]) / s) == F.col("__ly"))
    one_cell = same & (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry"))
    if small_right is None:
        small_right = bytes_of(b) <= MOST_BYTES

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        meets = one_cell & geo.boxes_meet(lb, rb) & home
        return a.join(F.broadcast(b) if small_right else b, meets if on is None else meets & on(a, b))

    if how == "inner":
        return pairs(a, b).drop("__lk", "__rk", "__lx", "__ly", "__rx", "__ry")
    rounds = max(0, math.ceil(math.log(max(1, right.count()) / FIRST_BOXES, 4)))
    if not rounds:
        return left.join(pairs(a, b).select("lid").distinct(), "lid", how)
    part = F.pmod(F.xxhash64(*(c for c, kind in right.dtypes if "map<" not in kind)), F.lit(4**rounds))
    b = checkpointed((b.distinct() if on is None and right.columns == ["rbox"] else b).withColumn("__part", part))
    rest = checkpointed(a.join(b.select(*(c for c in b.columns if c in ("__rk", "__rx", "__ry"))).distinct(), one_cell, "left_semi"))
    found = None
    for i in range(rounds + 1):
        here = pairs(rest, b.where(F.col("__part").between(4 ** (i - 1) if i else 0, 4**i - 1))).select("lid").distinct()
        if i < rounds:
            here = checkpointed(here)
            rest = checkpointed(rest.join(here, "lid", "left_anti"))
        found = here if found is None else found.union(here)
    return left.join(found, "lid", how)


# polygons cut to cells --------------------------------------------------------------------------------------------

CELL = ("pid", "level", "cx", "cy")


def _spans(a: Column, b: Column, at: Column, axis: str) -> Column:
    return (a[axis] <= at) != (b[axis] <= at)


def _crossing(a: Column, b: Column, at: Column, along: str, across: str) -> Column:
    """Where the edge ab crosses the line along = at, on the other axis; null if it doesn't."""
    return F.when(_spans(a, b, at, along), a[across] + (at - a[along]) * (b[across] - a[across]) / F.nullif(b[along] - a[along], F.lit(0.0)))


def _between(v: Column, p: Column, q: Column) -> Column:
    return F.coalesce((v > F.least(p, q)) & (v <= F.greatest(p, q)), F.lit(False))


def _touches(a: Column, b: Column, box: Column) -> Column:
    """Whether the edge ab may touch a box: not if it lies beyond one side of it, or all of the box on one side of the edge."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    half_x, half_y = (box["x2"] - box["x1"]) / 2, (box["y2"] - box["y1"]) / 2
    x, y = box["x1"] + half_x - a["x"], box["y1"] + half_y - a["y"]
    near = (F.abs(2 * x - dx) <= F.abs(dx) + 2 * half_x) & (F.abs(2 * y - dy) <= F.abs(dy) + 2 * half_y)
    return near & (F.abs(dx * y - dy * x) <= (F.abs(dx) * half_y + F.abs(dy) * half_x) * (1 + 1e-12))


def _ref(cx: Column, cy: Column, s: Column) -> tuple[Column, Column]:
    return (cx + REF_X) * s, (cy + REF_Y) * s


def _cell_box(cx: Column, cy: Column, s: Column) -> Column:
    return geo.box(cx * s, cy * s, (cx + 1) * s, (cy + 1) * s)


def cut_polygons(polygons: DataFrame, side: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """polygons (pid, rings) as cells: pid, level, cx, cy, whole (the polygon covers all of it; no edge runs through it), and for the others ref (whether
    the cell's reference point is covered), edges and anchors (the shell's first vertex, if it lies there). Cells without a part of the polygon don't come.

    Edges are rows all the way, so a polygon of any number of vertices is no row of its own. A round cuts the cells with too
    many edges to 4 x 4, hands the edges down to those they run through, and counts on the way from one reference point to
    the next how many are crossed. A cell of level 0 keeps all its edges.
    """
    flat = polygons.select("pid", geo.bounds(F.col("rings")).alias("b"), F.flatten(F.transform("rings", geo.edges)).alias("edges")).withColumn("level", box_level(F.col("b"), side))
    spread = checkpointed(flat.select("pid", "level", "b", F.posexplode("edges").alias("place", "e")).repartition("pid", "place"))
    rows = with_cells(spread, "b", _side(F.col("level"), side)).select(*CELL, F.col("e.a").alias("a"), F.col("e.b").alias("b"), (F.col("place") == 0).alias("first"))
    a, b, s, cx, cy = F.col("a"), F.col("b"), _side(F.col("level"), side), F.col("cx"), F.col("cy")
    rx, ry = _ref(cx, cy, s)
    refs = rows.groupBy(*CELL).agg((F.count_if(_crossing(a, b, ry, "y", "x") <= rx) % 2 == 1).alias("ref"))
    hits = rows.where(_touches(a, b, _cell_box(cx, cy, s)))
    none = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")
    here = F.col("first") & (F.floor(a["x"] / s) == cx) & (F.floor(a["y"] / s) == cy)
    done: list[DataFrame] = []
    while True:
        hits = checkpointed(hits)
        cells = checkpointed(refs.join(hits.groupBy(*CELL).agg(F.count("*").alias("n")), [*CELL], "left"))
        done.append(cells.where("n is null and ref").select(*CELL, F.lit(True).alias("whole"), "ref", none.alias("edges"), F.array().cast("array<struct<x:double,y:double>>").alias("anchors")))
        live = hits.join(cells.where("n > 0"), [*CELL])
        more = (F.col("n") > most_edges) & (F.col("level") > 0)
        ended = live.where(~more).groupBy(*CELL, "ref").agg(F.collect_list(F.struct("a", "b")).alias("edges"), F.collect_list(F.when(here, a)).alias("anchors"))
        done.append(ended.select(*CELL, F.lit(False).alias("whole"), "ref", "edges", "anchors"))
        if cells.where(more).isEmpty():
            break
        rest = live.where(more)
        refs, hits = _refs_below(rest, side), _hits_below(rest, side)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return checkpointed(out)


def _below(side: float) -> tuple[Column, Column, Column]:
    """Of a cell: the level of those that it is cut to (two levels down, or one), how many of them lie along a side, and their width."""
    level = F.greatest(F.col("level") - 2, F.lit(0))
    return level, F.expr("shiftleft(1L, cast(level - greatest(level - 2, 0) as int))"), _side(level, side)


def _refs_below(rest: DataFrame, side: float) -> DataFrame:
    """The cells that the cells of rest are cut to, and whether each one's reference point is covered: edges are counted, not copied."""
    a, b = F.col("a"), F.col("b")
    level, times, width = _below(side)
    px, py = _ref(F.col("cx"), F.col("cy"), _side(F.col("level"), side))
    places = [_ref(F.col("cx") * times + i, F.col("cy") * times + i, width) for i in range(4)]
    crossed = rest.select(*CELL, "ref", _crossing(a, b, py, "y", "x").alias("level_at"), *(_crossing(a, b, x, "x", "y").alias(f"upright_at{i}") for i, (x, _) in enumerate(places)))
    along = [F.count_if(_between(F.col("level_at"), px, x)) for x, _ in places]
    upright = [[F.count_if(_between(F.col(f"upright_at{i}"), py, y)) for _, y in places] for i in range(4)]
    made = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((along[i] + upright[i][j]) % 2 == 1).alias("odd")) for i in range(4) for j in range(4)))
    counted = crossed.groupBy(*CELL, "ref").agg(made.alias("made")).withColumn("m", F.explode("made")).where((F.col("m.i") < times) & (F.col("m.j") < times))
    return counted.select("pid", level.alias("level"), (F.col("cx") * times + F.col("m.i")).alias("cx"), (F.col("cy") * times + F.col("m.j")).alias("cy"), (F.col("ref") != F.col("m.odd")).alias("ref"))


def _hits_below(rest: DataFrame, side: float) -> DataFrame:
    """The edges by the smaller cells that they run through."""
    a, b = F.col("a"), F.col("b")
    level, times, width = _below(side)
    span = lambda c, axis: F.explode(F.sequence(F.greatest(F.col(c) * times, F.floor(F.least(a[axis], b[axis]) / width)), F.least((F.col(c) + 1) * times - 1, F.floor(F.greatest(a[axis], b[axis]) / width)), F.lit(1).cast("long")))
    listed = lambda c, axis: (F.floor(F.least(a[axis], b[axis]) / width) < (F.col(c) + 1) * times) & (F.floor(F.greatest(a[axis], b[axis]) / width) >= F.col(c) * times)
    rows = rest.where(listed("cx", "x") & listed("cy", "y")).withColumn("x", span("cx", "x")).withColumn("y", span("cy", "y"))
    rows = rows.select("pid", level.alias("level"), F.col("x").alias("cx"), F.col("y").alias("cy"), "a", "b", "first")
    return rows.where(_touches(a, b, _cell_box(F.col("cx"), F.col("cy"), _side(F.col("level"), side))))


def polygon_join(left: DataFrame, cells: DataFrame, side: float) -> DataFrame:
    """left (lbox, rings, and others) with the pid of each polygon that it meets, touching included; a pair may come more than once.

    cells: of cut_polygons with the same side. Where a footprint's edge and a polygon's meet, both run through the cell of that
    point; else one holds the other's first vertex, which is looked at in the cell where it lies.
    """
    found = levels(left=left.select(box_level(F.col("lbox"), side).alias("__level")), right=cells.select(F.col("level").alias("__level")))
    own = F.col("level")
    b = cells.withColumn("__rk", F.explode(_keys(own, found["left"], False)))
    b = b.withColumn("__rx", F.expr("shiftright(cx, __rk.level - level)")).withColumn("__ry", F.expr("shiftright(cy, __rk.level - level)"))
    a = with_cells(left.withColumn("__lk", F.explode(_keys(box_level(F.col("lbox"), side), found["right"], True))), "lbox", _side(F.col("__lk.level"), side), "__lx", "__ly")
    small = b.agg(F.coalesce(F.sum(120 + 40 * F.size("edges")), F.lit(0)).alias("n")).first()["n"] <= MOST_BYTES
    s = _side(own, side)
    lbox = F.col("lbox")
    near = (F.col("__lk.kind") == F.col("__rk.kind")) & (F.col("__lk.level") == F.col("__rk.level")) & (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry")) & geo.boxes_meet(lbox, _cell_box(F.col("cx"), F.col("cy"), s))
    pairs = a.join(F.broadcast(b) if small else b, near)
    p = F.col("rings")[0][0]
    holds_first = (F.floor(p["x"] / s) == F.col("cx")) & (F.floor(p["y"] / s) == F.col("cy"))
    rx, ry = _ref(F.col("cx"), F.col("cy"), s)
    turn = lambda e: _between(_crossing(e["a"], e["b"], ry, "y", "x"), rx, p["x"]).cast("int") + _between(_crossing(e["a"], e["b"], p["x"], "x", "y"), ry, p["y"]).cast("int")
    turns = F.aggregate("edges", F.lit(0), lambda acc, e: acc + turn(e))
    close = F.filter("edges", lambda e: _touches(e["a"], e["b"], lbox))
    own_edges = F.flatten(F.transform("rings", geo.edges))
    meet = F.exists(close, lambda e: F.exists(own_edges, lambda f: geo.segments_cross(e["a"], e["b"], f["a"], f["b"])))
    covers = F.exists("anchors", lambda q: geo.covers_point(F.col("rings"), q["x"], q["y"]))
    inside = holds_first & (F.col("ref") != (turns % 2 == 1))
    hit = F.when(F.col("whole"), holds_first).otherwise(inside | meet | covers)
    return pairs.where(hit).select(*left.columns, "pid")


def refined(pairs: DataFrame, left_rings: str = "lrings", right_rings: str = "rrings") -> DataFrame:
    """Pairs of boxes whose polygons meet, touching included."""
    return pairs.where(geo.polygons_meet(F.col(left_rings), F.col(right_rings)))


def nearest(points: DataFrame, targets: DataFrame, side: float, rings: int = 1) -> DataFrame:
    """points (pid, px, py) with the nearest of targets (tid, tx, ty) no more than `rings` cells away: tid and distance; ties by tid.

    Exact for distances up to rings * side; farther targets count as none.
    """
    offsets = F.flatten(F.transform(F.sequence(F.lit(-rings), F.lit(rings)), lambda i: F.transform(F.sequence(F.lit(-rings), F.lit(rings)), lambda j: F.struct((F.floor(F.col("px") / side) + i).alias("cx"), (F.floor(F.col("py") / side) + j).alias("cy")))))
    near = points.withColumn("__c", F.explode(offsets)).select("*", "__c.cx", "__c.cy").drop("__c")
    cell = targets.select("*", F.floor(F.col("tx") / side).alias("cx"), F.floor(F.col("ty") / side).alias("cy"))
    d = F.hypot(F.col("px") - F.col("tx"), F.col("py") - F.col("ty"))
    found = near.join(cell, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= side * rings)
    best = found.groupBy("pid").agg(F.min_by(F.struct("tid", "distance"), F.struct("distance", "tid")).alias("b")).select("pid", "b.tid", "b.distance")
    return points.join(best, "pid", "left")
