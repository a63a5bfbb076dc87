"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the output over its share of the input, both in code points.
A document's count is drawn by inverting the Poisson distribution of that mean at a uniform number hashed from the
seed and the document, so a draw needs no state and comes out the same on any cluster. Documents are exploded by their
counts and dealt out by a hash of document, copy and seed, sorted by it within each partition.

The inverse is a list of cumulative probabilities for each source, from where they leave 0 to where they reach 1 in
doubles; it is as long as some 24 roots of the rate. The table of sources is broadcast when its lists hold at most
MOST_NUMBERS numbers; beyond that it is joined with salted keys, so that a source with a third of all rows is spread
over SALTS tasks. A source that is tiny beside its target is repeated as often as that asks: its documents are exploded
by their counts, and copies are dealt out by hash.

Defined cases: null text counts as no code points, and a source without any has rate 0; a null source is a source of
its own; a source without a target weight has weight 0; a null doc_id draws like any other value; rows that are the same draw the
same count; an empty table gives no rows; extra columns are kept. Where docs has a column named rate, copies, copy or
mix_key, it stays and the operator's own has _ before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, read

SEED = 17
#: The table of inverses is broadcast up to so many numbers of eight bytes.
MOST_NUMBERS = 1_000_000
SALTS = 64


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), of 52 bits of the MD5 of the parts joined by a colon; null is the word null."""
    joined = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """__source, rate, low, cdf for each source; weights default to one each, total (code points of the output) to that of docs."""
    mass = docs.groupBy(F.col("source").alias("__source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        mass = mass.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        mass = mass.join(given, F.col("__source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["weight"])
    sums = mass.agg(F.sum(F.when(F.col("mass") > 0, F.col("weight"))).alias("all_weight"), F.sum("mass").alias("all_mass"))
    share = mass.crossJoin(F.broadcast(sums))  # one row
    goal = F.col("all_mass") if total is None else F.lit(float(total))
    rate = F.when((F.col("mass") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * goal / F.col("mass")).otherwise(0.0)
    return inverses(share.select("__source", rate.alias("rate")))


def inverses(rates_: DataFrame) -> DataFrame:
    """__source, rate with low and cdf: the probabilities of at most low, low + 1 and so on copies.

    Only counts within twelve standard deviations and thirty of the rate are listed, all others together being less likely than a double
    can tell. Neighbours differ by the factor rate / k, so a running sum of its logarithm gives them up to a factor, which their sum takes out.
    """
    reach = 12 * F.sqrt("rate") + 30
    low, high = F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long"), F.when(F.col("rate") > 0, F.ceil(F.col("rate") + reach)).otherwise(0).cast("long")
    listed = rates_.withColumn("low", F.when(F.col("rate") > 0, low).otherwise(0)).withColumn("k", F.explode(F.sequence(F.col("low"), high)))
    by = Window.partitionBy("__source")
    upto = by.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.when(F.col("k") > F.col("low"), F.log(F.col("rate")) - F.log(F.col("k").cast("double"))).otherwise(0.0)
    p = listed.withColumn("p", F.exp(F.sum(factor).over(upto)))
    cdf = p.withColumn("cdf", F.sum("p").over(upto) / F.sum("p").over(by))
    out = cdf.groupBy("__source").agg(F.first("rate").alias("rate"), F.first("low").alias("low"), F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("all"))
    return out.select("__source", "rate", "low", F.col("all.cdf").alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as drawn, with rate, copies, copy (from 1) and mix_key, in the order of mix_key within each partition."""
    rate, copies, copy, mix_key, source, low, cdf, salt, other = (free(c, docs) for c in ("rate", "copies", "copy", "mix_key", "__source", "__low", "__cdf", "__salt", "__other_salt"))
    table = cut(rates(docs, weights, total)).select(F.col("__source").alias(source), F.col("rate").alias(rate), F.col("low").alias(low), F.col("cdf").alias(cdf))
    if (table.agg(F.sum(F.size(cdf) + 16)).first()[0] or 0) <= MOST_NUMBERS:
        both = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col(source)))
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of_row = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        both = docs.withColumn(other, of_row).join(salted, F.col("source").eqNullSafe(F.col(source)) & (F.col(other) == F.col(salt))).drop(salt, other)
    u = uniform(F.lit(seed), "doc_id")
    drawn = both.withColumn(copies, F.col(low) + F.size(F.filter(cdf, lambda c: c <= u))).drop(source, low, cdf)
    repeated = drawn.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), copy)), 1, 15), 16, 10).cast("long")
    return repeated.withColumn(mix_key, key).repartition(mix_key).sortWithinPartitions(mix_key)


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")).withColumn("rate", F.round("rate", 9))


ORACLES = {
    "op4_poisson_mix": f"""
WITH mass AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS mass FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN mass > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM mass WHERE mass > 0) * (SELECT sum(mass) FROM mass) / mass ELSE 0 END AS rate FROM mass),
p AS (SELECT source, rate, k, CASE WHEN k = 0 THEN -rate ELSE -rate + k * ln(rate) - lgamma(k + 1) END AS log_p
      FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS t(k) WHERE rate > 0),
c AS (SELECT source, rate, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
lists AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY source),
d AS (SELECT d.*, l.rate, CAST(len(list_filter(l.cdfs, lambda c: c <= CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)) AS BIGINT) AS copies
      FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies, CAST(copy AS BIGINT) AS copy,
       CAST(('0x' || substr(md5('{SEED} mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15)) AS BIGINT) AS mix_key
FROM d, unnest(range(1, copies + 1)) AS t(copy)""",
}
