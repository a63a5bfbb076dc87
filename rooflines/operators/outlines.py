"""Outlines of labelled pixels as polygons, without a walk along them.

What lies around a pixel corner says whether a component's outline turns there, and how. Turns are sorted along their lines of pixels, so each finds
the one that its run ends at, and the runs' circles are ranked by pointer jumping. No task follows an outline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .clipping import ranked_cycles

EAST, NORTH, WEST, SOUTH = range(4)
#: The pixels around a corner as bits.
BELOW_LEFT, BELOW_RIGHT, ABOVE_RIGHT, ABOVE_LEFT = 1, 2, 4, 8
#: Turns (from one direction to another) by which of the pixels belong to the component, which stays on the left; rows go up. Where two meet only there, the
#: outline goes on from one to the other: being joined elsewhere too, they enclose a hole, and it gets a ring of its own.
TURNS = {
    ABOVE_RIGHT: [(SOUTH, EAST)],
    ABOVE_LEFT: [(EAST, NORTH)],
    BELOW_LEFT: [(NORTH, WEST)],
    BELOW_RIGHT: [(WEST, SOUTH)],
    BELOW_LEFT | ABOVE_RIGHT: [(NORTH, EAST), (SOUTH, WEST)],
    BELOW_RIGHT | ABOVE_LEFT: [(WEST, NORTH), (EAST, SOUTH)],
    15 - ABOVE_RIGHT: [(WEST, NORTH)],
    15 - ABOVE_LEFT: [(SOUTH, WEST)],
    15 - BELOW_LEFT: [(EAST, SOUTH)],
    15 - BELOW_RIGHT: [(NORTH, EAST)],
}


def turns(labelled: DataFrame) -> DataFrame:
    """labelled (row, col, value, component): component, value, r, c (of the corner), into, out: a row for each turn of an outline."""
    around = [(0, 0, ABOVE_RIGHT), (0, 1, ABOVE_LEFT), (1, 0, BELOW_RIGHT), (1, 1, BELOW_LEFT)]
    corners = F.explode(F.array(*(F.struct((F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"), F.lit(bit).alias("bit")) for dr, dc, bit in around)))
    met = labelled.select("component", "value", corners.alias("k")).groupBy("component", F.col("k.r").alias("r"), F.col("k.c").alias("c")).agg(F.bit_or("k.bit").alias("mask"), F.max("value").alias("value"))
    pair = lambda a, b: F.struct(F.lit(a).alias("into"), F.lit(b).alias("out"))
    found: Column | None = None
    for mask, listed in TURNS.items():
        each = F.array(*(pair(*x) for x in listed))
        found = F.when(F.col("mask") == mask, each) if found is None else found.when(F.col("mask") == mask, each)
    return met.select("component", "value", "r", "c", F.explode(found).alias("t")).select("component", "value", "r", "c", "t.into", "t.out")


def _runs(found: DataFrame) -> DataFrame:
    """Each turn with the turn that its way out leads to: along a line the next thing after a begin is its end."""
    node = F.struct("component", "r", "c", "out")

    def marks(way: str, begin: bool) -> DataFrame:
        d = F.col(way)
        flat = (d == EAST) | (d == WEST)
        along = F.when(flat, F.col("c")).otherwise(F.col("r"))
        return found.select("component", d.alias("way"), F.when(flat, F.col("r")).otherwise(F.col("c")).alias("line"), F.when((d == WEST) | (d == SOUTH), -along).otherwise(along).alias("at"), F.lit(begin).alias("begin"), node.alias("node"))

    line = Window.partitionBy("component", "way", "line").orderBy("at")
    both = marks("out", True).union(marks("into", False)).withColumn("next", F.lead("node").over(line))
    return both.where("begin").select("node", "next")


def polygons(labelled: DataFrame) -> DataFrame:
    """component, value, rings: each component's outline as closed rings of its corners, the shell first, then holes from the largest."""
    found = turns(labelled)
    values = labelled.groupBy("component").agg(F.max("value").alias("value"))
    ranked = ranked_cycles(_runs(found))
    points = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("node.c").alias("x"), F.col("node.r").alias("y")))), lambda p: geo.point(p["x"], p["y"]))
    ring = ranked.groupBy("cycle").agg(points.alias("p")).select(F.col("cycle.component").alias("component"), F.concat("p", F.slice("p", 1, 1)).alias("ring"))
    sized = ring.withColumn("area", geo.signed_area(F.col("ring")))
    # the shell runs counter-clockwise, holes the other way
    order = F.struct((F.col("area") < 0).alias("hole"), (-F.abs("area")).alias("size"), "ring")
    shapes = sized.groupBy("component").agg(F.array_sort(F.collect_list(order)).alias("all")).select("component", F.col("all.ring").alias("rings"))
    return shapes.join(values, "component").select("component", "value", "rings")
