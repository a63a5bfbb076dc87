"""Shuffles, shards, caps, splits, key joins and work lists of sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(*keys, seed: int = 0) -> Column:
    """A uniform number in [0, 1) by MD5, the same on any cluster."""
    joined = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """A global order that changes with seed and epoch."""
    return df.orderBy(hashed(key, F.lit(epoch), seed=seed), key)


def numbered(df: DataFrame, alias: str, *order) -> DataFrame:
    """Rows numbered from 0 in a global order, without gathering them in one task: partitions are sorted, counted and offset."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ids = ranged.withColumn("__i", F.monotonically_increasing_id())
    ids = ids.withColumn("__i", F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33))
    from .raster import checkpointed

    ids = checkpointed(ids)
    counts = ids.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    both = ids.join(F.broadcast(starts), "__p")
    return both.select(*df.columns, (F.col("__from") + F.col("__i")).alias(alias))


def shards(df: DataFrame, world: int, *order) -> DataFrame:
    """Row i of the order goes to shard i mod world; the first rows come again at the end, so that all shards are equal."""
    rows = numbered(df, "__i", *order)
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    pad = -n % world
    again = rows.where(F.col("__i") < pad).withColumn("__i", F.col("__i") + n)
    return rows.unionByName(again).withColumn("shard", (F.col("__i") % world).cast("int")).withColumnRenamed("__i", "place")


def capped(df: DataFrame, stratum: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each stratum, drawn by hash."""
    w = Window.partitionBy(stratum).orderBy(hashed(key, seed=seed), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, each the likelier the larger its weight."""
    return df.orderBy(-F.log(1 - hashed(key, seed=seed)) / F.col(weight), key).limit(n)


def demultiplexed(df: DataFrame, classes: dict[str, Column]) -> dict[str, DataFrame]:
    """A branch for each class, the first whose condition holds; what fits none is dropped."""
    which = F.lit(None).cast("string")
    for name, condition in reversed(classes.items()):
        which = F.when(condition, name).otherwise(which)
    marked = df.withColumn("__class", which)
    return {name: marked.where(F.col("__class") == name).drop("__class") for name in classes}


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str, longest: bool = False) -> DataFrame:
    """Rows side by side by their place in each order; longest pads the shorter side with nulls."""
    return numbered(left, "place", left_order).join(numbered(right, "place", right_order), "place", "full_outer" if longest else "inner")


def in_every(sources: list[DataFrame], key: str) -> DataFrame:
    """Keys that every source has."""
    out = sources[0].select(key).distinct()
    for s in sources[1:]:
        out = out.join(s.select(key), key, "left_semi")
    return out


def with_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str, separator: str = "_") -> DataFrame:
    """Rows whose column begins with one of the prefixes and the separator: an equi-join on all heads of the value."""
    parts = F.split(column, separator)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    keys = df.select(column).distinct().withColumn("__h", F.explode(heads)).join(prefixes.select(F.col(prefix).alias("__h")), "__h", "left_semi").select(column).distinct()
    return df.join(keys, column, "left_semi")


def open_work(listing: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """What the latest status row doesn't call finished, started or failed. status: key, state, at; rows are only appended."""
    latest = status.groupBy(key).agg(F.max_by("state", "at").alias("state"))
    return listing.join(latest.where(F.col("state").isin("finished", "started", "failed")), key, "left_anti")


def even_groups(df: DataFrame, n: int, *order) -> DataFrame:
    """Contiguous groups 1 to n of nearly equal size; the first ones get one more."""
    rows = numbered(df, "__i", *order)
    total = rows.agg(F.count("*").alias("n")).first()["n"]
    small, more = divmod(total, n)
    cut = more * (small + 1)
    group = F.when(F.col("__i") < cut, F.floor(F.col("__i") / (small + 1))).otherwise(more + F.floor((F.col("__i") - cut) / max(small, 1)))
    return rows.withColumn("group", (group + 1).cast("int")).drop("__i")


def composed(df: DataFrame, steps: list[str | Callable[[DataFrame], DataFrame]], registry: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df through a chain of functions, each given itself or by name."""
    for step in steps:
        df = df.transform(registry[step] if isinstance(step, str) else step)
    return df


def only_one(df: DataFrame, column: str):
    """The one distinct value of a column; an error if there are none or several."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} has {'no value' if not found else 'more than one value'}")
    return found[0]


def parent_name(name, separator: str = "_patch") -> Column:
    """What stands before the separator: the picture that a patch was cut from."""
    return F.split(F.col(name) if isinstance(name, str) else name, separator)[0]


def with_parent(patches: DataFrame, parents: DataFrame, name: str, key: str) -> DataFrame:
    """Patches with the columns of their parent, whose key is a text."""
    return patches.withColumn("__parent", parent_name(name)).join(parents, F.col("__parent") == F.col(key)).drop("__parent")
