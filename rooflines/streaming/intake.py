"""Incremental intake of tiles: new files only, status rows instead of flags, removal of regions that are gone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take_in(spark: SparkSession, source: str, schema: str, checkpoint: str, status: str, process: Callable[[DataFrame, int], DataFrame | None], files_per_batch: int = 100, file_format: str = "parquet", output: str | None = None) -> int:
    """Runs process(batch, number) over the files that came since the last call, in batches; the rows taken in.

    The checkpoint knows which files are done. Each batch appends a row to the status table (finished, or failed with its reason); a batch that
    fails is tried again by the next call, with the same files and number. With output, what process returns is written to the folder
    batch=number there, in place of what an earlier try of that batch left: a batch that broke off after its work, before its status or
    the checkpoint, isn't there twice. Without, process does its own writing and has to bear being run again.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()  # the files are read once for the work and the count
        try:
            made = process(batch, number)
            if output is not None:
                (batch if made is None else made).write.mode("overwrite").parquet(f"{output}/batch={number}")
            rows = batch.count()
            _note(spark, status, number, "finished", rows, None)
        except Exception as e:
            _note(spark, status, number, "failed", 0, str(e)[:300])
            raise
        finally:
            batch.unpersist()
        taken.append(rows)

    taken: list[int] = []

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(taken)


def _note(spark: SparkSession, status: str, number: int, state: str, rows: int, reason: str | None) -> None:
    row = spark.createDataFrame([(number, state, rows, reason)], "batch long, state string, rows long, reason string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(status)


def latest_status(status: DataFrame, key: str = "batch") -> DataFrame:
    """Of the appended rows the latest by key."""
    rest = [c for c in status.columns if c not in (key, "at")]
    return status.groupBy(key).agg(F.max("at").alias("at"), *(F.max_by(c, "at").alias(c) for c in rest))


def work_list(listing: DataFrame, processed: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Every listed tile with whether it was processed and predicted."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    return listing.join(mark(processed, "processed"), key, "left").join(mark(predicted, "predicted"), key, "left").fillna(False, ["processed", "predicted"])


def inventory(work: DataFrame) -> DataFrame:
    return work.agg(F.count("*").alias("tiles"), F.count_if("processed").alias("processed"), F.count_if("predicted").alias("predicted"), F.count_if(F.col("processed") & ~F.col("predicted")).alias("waiting"))


def gone_regions(stored: DataFrame, districts: DataFrame, key: str = "region") -> DataFrame:
    """Regions that are stored but no longer districts."""
    return stored.select(key).distinct().join(districts.select(key), key, "left_anti")


def without_regions(stored: DataFrame, districts: DataFrame, key: str = "region") -> DataFrame:
    """What stays when regions that are gone are removed."""
    return stored.join(districts.select(key).distinct(), key, "left_semi")
