"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and every byte that can't be part of a word to a space; bytes of 128 and more are parts of UTF-8 letters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f, which gives back at its end what Arrow's pool holds unused: a worker lives on for other tasks."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def give_back() -> None:
    """Returns to the system what C's heap holds unused after large arrays; without glibc nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It's the cluster's spark.checkpoint.dir; only a local session may go without."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found or sc.getCheckpointDir()


def free(name: str, df: DataFrame) -> str:
    """name, with signs _ before it until df has no column so called: its own columns stay."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark removes the shuffle files of a query when it is through with it, and not when the driver next collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; a lost executor doesn't lose them. What was shuffled for them is removed."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint()  # a query goes by the settings that it was made under
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; reads no further than needed."""
    return df.limit(most_rows + 1).count() <= most_rows


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a url: what lies between :// and the next of / ? # (A-Z lower-cased), then what lies before ? or #; both empty without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path
