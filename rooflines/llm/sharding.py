"""Sharding by proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked from 0; row r of n stands at the fraction (r + 1/2) / n of
its source. All rows sorted by that fraction are the sources interleaved in proportion, so any stretch of that order
holds each source as often as the mixture asks, to within a row or so. The order is cut into equal stretches, the
shards: their counts differ by one at most.

Neither ranking gathers a source or a shard: rows are dealt out by range of (source, hash), then of fraction, each
partition numbers its rows in its own order, and a table with one row for each partition (and source in it) says where
each begins. A source with a third of all rows is a third of the ranges. Both rankings are checkpointed once, since the
numbers hang on how the ranges fell. Which rows travel is the caller's choice: the query sends sizes and checksums, not
texts; write_shards takes whole rows.

Defined cases: a null source is a source of its own; a null id is hashed as the word null; rows with equal ids go by
their other columns and rows that are the same stand side by side; with fewer rows than shards some shards are empty;
an empty table gives no rows; extra columns are kept, and where one is called shard or slot the operator's own has _
before its name. Null text has size 16 and checksum 0, as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, read, small_enough

SHARDS = 40
SEED = 29
#: The table of where sources begin is broadcast up to so many rows (of about 40 bytes), and joined by shuffle beyond.
MOST_STARTS = 100_000


def seeded(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __p, their partition in the global order, and __i, their place in it from 0; computed once."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    return cut(made.withColumn("__i", F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)))


def _starts(placed: DataFrame, *by: str) -> DataFrame:
    """For each partition (and each value of by in it): its first place there and how many rows (of that value) come before it and in all; a row for each."""
    counts = placed.groupBy("__p", *by).agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("__p", *by, "__first", before.alias("__before"), F.sum("__n").over(w).alias("__all"))


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (from 0 within its shard)."""
    shard, slot = free("shard", rows), free("slot", rows)
    named = rows.columns
    inner = rows.toDF(*(f"c{i}" for i in range(len(named))))  # free of clashes with the columns below
    col = {n.lower(): f"c{i}" for i, n in enumerate(named)}
    k, s = col[key.lower()], col[source.lower()]
    ties = [f"c{i}" for i, t in enumerate(f.dataType.typeName() for f in rows.schema) if t not in ("map", "variant")]
    shuffled = _places(inner.withColumn("__h", seeded(F.col(k), seed)), [s, "__h", k, *(c for c in ties if c not in (s, k))])
    of_source = cut(_starts(shuffled, s).withColumnsRenamed({s: "__s", "__p": "__q"}))
    if small_enough(of_source, MOST_STARTS):
        of_source = F.broadcast(of_source)
    ranked = shuffled.join(of_source, (F.col("__p") == F.col("__q")) & F.col(s).eqNullSafe(F.col("__s")))
    rank = F.col("__before") + F.col("__i") - F.col("__first")
    mixed = ranked.withColumn("__f", (rank + F.lit(0.5)) / F.col("__all")).select(*inner.columns, "__h", "__f")
    placed = _places(mixed, ["__f", s, "__h", k, *(c for c in ties if c not in (s, k))])
    begins = _starts(placed)  # a row for each partition
    whole = placed.join(F.broadcast(begins.select("__p", "__before", "__all")), "__p").withColumn("__at", F.col("__before") + F.col("__i"))
    out = whole.withColumn("__shard", F.expr(f"(__at * {shards}) div __all"))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(named)), F.col("__shard").cast("int").alias(shard), (F.col("__at") - F.expr(f"(__shard * __all + {shards - 1}) div {shards}")).alias(slot))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows of documents as Parquet folders shard=0, shard=1 and so on, each in the order of its slots."""
    placed = interleave(docs, shards, seed)
    shard, slot = placed.columns[-2:]
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)


def op12_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_TABLE = ", ".join(f"{_nibble(n)}::BIGINT" for n in range(16))
_HEX = "CAST(('0x' || lower({x})) AS BIGINT)"

ORACLES = {
    "op12_interleaved_shards": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h FROM documents),
b AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: [{_HEX.format(x="substr(x, 2, 1)")}, {_HEX.format(x="substr(x, 1, 1)")}]))) AS nibbles FROM d),
c AS (SELECT doc_id, source, h, strlen(t) + 16 AS size, xor(list_reduce(nibbles, lambda c, n: xor(c >> 4, list_extract([{_TABLE}], (xor(c, n) & 15) + 1))), 4294967295::BIGINT) AS text_crc32 FROM b),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM r),
s AS (SELECT *, (place * {SHARDS}) // n AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
