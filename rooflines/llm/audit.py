"""Filter interaction audit: what each filter does in every order of the filters, from one pass over the documents.

A document's failures are the bits of a mask. Documents are counted by part and mask, so a part is at most 32 cells,
whatever its size. A Gray code then walks all 32 sets of active filters, one filter switched at a time: each cell keeps
a counter of its active failures, and where a counter leaves or reaches 0 the cell's counts leave or join the running
survivors. The survivors of the 32 sets are stored, and a step of an order is the difference of two of them.

The last filter fails copies: texts that a row with a smaller id has too, in any part, removed or not. Texts are told
apart by SHA-256. Rows are brought together by id for the labels and counted by (text, part) there; of a text only those
counts meet, so a group of copies of any size is at most one row for each task and part.

Defined cases: null text is empty; a null part is the part named by the empty string; a null id is not larger than any
id, so it is no copy, and it has no labels; rows that are the same (id and text) are no copies of each other; a document
is good or toxic if any of its label rows says so; null labels say nothing; an empty table has no parts and gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, tidy

BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Names of the filters, by bit; the last fails copies.
NAMES = "ABCDE"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Too short, too many repeated words, too many capitals, odd signs; of a text that isn't null."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.length(text)
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    return [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * length.cast("long"), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", failures=text_failures) -> DataFrame:
    """part, mask, rows, good, toxic: how many documents of a part fail just the filters of the mask; at most 32 rows a part."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures(text))]
    of_text = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))))
    counted = of_text.join(says, "id", "left").groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("rows"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # of each text and part: its rows, those without an id, and those of its smallest id
    fields = ("rows", "good", "toxic")
    first = F.struct("id", *fields)
    by_text = counted.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in fields), *(F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"free_{c}") for c in fields), F.min(F.when(F.col("id").isNotNull(), first)).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    whole = by_text.withColumn("least", least)
    keeps = {c: F.col(f"free_{c}") + F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) for c in fields}
    copy = 1 << len(bits)
    both = whole.select("part", F.explode(F.array(F.struct(F.col("mask"), *(keeps[c].alias(c) for c in fields)), F.struct((F.col("mask") + copy).alias("mask"), *((F.col(c) - keeps[c]).alias(c) for c in fields)))).alias("cell")).select("part", "cell.*")
    return both.where("rows > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in fields))


def walk(counts: np.ndarray, filters: int) -> np.ndarray:
    """counts: [part, mask, kind]. Gives the survivors [part, set of active filters, kind] by a Gray code over the sets."""
    masks = np.arange(1 << filters)
    active = np.zeros(1 << filters, dtype=int)
    alive = counts.sum(axis=1)
    states = np.zeros_like(counts)
    states[:, 0] = alive
    now = 0
    for i in range(1, 1 << filters):
        bit = i & -i
        fails = (masks & bit) > 0
        now ^= bit
        if now & bit:
            alive = alive - counts[:, fails & (active == 0)].sum(axis=1)
            active[fails] += 1
        else:
            active[fails] -= 1
            alive = alive + counts[:, fails & (active == 0)].sum(axis=1)
        states[:, now] = alive
    return states


def steps(parts: list[str], counts: np.ndarray, names: str = NAMES) -> pa.RecordBatch:
    """The rows of all orders of the filters: differences between the stored states."""
    k = len(names)
    states = walk(counts, k)
    orders = list(permutations(range(k)))
    masks = np.arange(1 << k)
    fails = np.stack([counts[:, (masks >> f & 1) == 1, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = counts[:, [1 << f for f in range(k)], 0]
    which = np.array(orders)  # [order, step]
    after = np.cumsum(1 << which, axis=1)
    before = after - (1 << which)
    gone = states[:, before] - states[:, after]  # [part, order, step, kind]
    total = np.zeros((len(parts), k), dtype=np.int64)
    for f in range(k):
        total[:, f] = gone[:, which == f, 0].sum(axis=1)
    each = len(orders) * k
    columns = [
        pa.array(np.repeat(np.array(parts, dtype=object), each), pa.string()),
        pa.array([n for n in ("".join(names[f] for f in o) for o in orders) for _ in range(k)] * len(parts), pa.string()),
        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * len(parts))),
        *(pa.array(np.ascontiguousarray(a).reshape(-1).astype(np.int64)) for a in (states[:, after, 0], gone[..., 0], fails[:, which] - gone[..., 0], alone[:, which], gone[..., 1], gone[..., 2], total[:, which])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


@tidy
def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            counts = np.zeros((some.num_rows, 1 << len(NAMES), 3), dtype=np.int64)
            of = some["cells"]
            cell, row = of.flatten(), np.repeat(np.arange(some.num_rows), np.diff(of.offsets.to_numpy()))
            for kind, name in enumerate(("rows", "good", "toxic")):
                counts[row, cell.field("mask").to_numpy(), kind] = cell.field(name).to_numpy()
            yield steps(some["part"].to_pylist(), counts)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step."""
    table = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))  # at most 32 a part
    return table.mapInArrow(_walked, OUT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_BIT = "CASE {x} " + " ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(NAMES)) + " END"
_FAILS = "(m.mask & w.bit) > 0"

ORACLES = {
    "op11_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(string_split('{",".join(NAMES)}', ',')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS name, {_BIT.format(x="substr(filter_order, step, 1)")} AS bit FROM o, unnest(range(1, 6)) AS t(step)),
w AS (SELECT *, sum(bit) OVER (PARTITION BY filter_order ORDER BY step) - bit AS earlier FROM s),
r AS (SELECT m.part, w.filter_order, w.step, w.name, sum(CASE WHEN (m.mask & (w.earlier + w.bit)::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN {_FAILS} AND (m.mask & w.earlier::BIGINT) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN {_FAILS} AND (m.mask & w.earlier::BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN m.mask = w.bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN {_FAILS} AND (m.mask & w.earlier::BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN {_FAILS} AND (m.mask & w.earlier::BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, w GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r""",
}
