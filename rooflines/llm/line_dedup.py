"""Line deduplication over the whole corpus.

Each document becomes one row per distinct long line: a 128-bit hash, the document and the line's places. A task keeps
the smallest document of every hash it has met and decides all later ones itself, so a line that a third of the corpus
holds leaves each task once. The rest is range-partitioned by hash and sorted by hash and document within the
partition; a stream over it passes each hash's first document and marks the lines of the others. Rows that are decided
already travel under a hash of their document, so they spread evenly. Per document the marks are packed into a
zlib-compressed bitmap of the lines to keep. Texts are not shuffled for this; `apply_keep` joins the bitmaps to them.

Defined cases: null or empty text is one empty line; a null doc_id ranks after all others and stands for one document
(2^63-1, the largest id there is, isn't told from it);
rows with the same doc_id count as one document, each gets the bitmap of its own text; an empty table gives no rows;
extra columns are ignored (`apply_keep` hands them on).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tidy

#: What is stripped from a line's ends; the least length of a key in code points.
BLANKS = b"\x20\t\n\x0b\x0c\r"
LEAST = 10
#: A task's table of first documents is written out and begun anew at so many hashes; what it held is decided later.
MOST_HELD = 400_000
LAST = 2**63 - 1
MARKS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary()), ("state", pa.int8())])
#: state: a document's own row; lines to be decided; lines to drop.
HEAD, OPEN, DROP = 0, 1, 2


def line_keys(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Places and keys of the lines that are long enough."""
    for place, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= LEAST and (len(key) >= 4 * LEAST or len(key.decode("utf-8", "replace")) >= LEAST):
            yield place, key.lower()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(MARKS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MARKS, strict=True)], schema=MARKS)


@tidy
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts: dict[bytes, tuple] = {}

    def spread(row: tuple, state: int) -> tuple:
        doc, text_hash, n, places = row
        h = xxhash.xxh3_64_intdigest(b"%d %d" % (doc, text_hash)) - 2**63
        return (h, 0, doc, text_hash, n, places, state)

    def candidates() -> list[tuple]:
        return [(int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), *row, OPEN) for h, row in firsts.items()]

    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py() or b""
            doc = LAST if doc is None else doc
            text_hash = xxhash.xxh3_64_intdigest(raw) - 2**63
            own: dict[bytes, list[int]] = {}
            for place, key in line_keys(raw):
                own.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
            n = raw.count(b"\n") + 1
            out.append(spread((doc, text_hash, n, b""), HEAD))
            drop: list[int] = []
            for h, places in own.items():
                held = firsts.get(h)
                if held is None or doc < held[0]:
                    if held is not None:
                        out.append(spread(held, DROP))
                    firsts[h] = (doc, text_hash, n, np.array(places, "<i4").tobytes())
                elif doc > held[0]:
                    drop += places
                else:  # a second row of the same document
                    out.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), doc, text_hash, n, np.array(places, "<i4").tobytes(), OPEN))
            if drop:
                out.append(spread((doc, text_hash, n, np.array(drop, "<i4").tobytes()), DROP))
            if len(firsts) >= MOST_HELD:
                out += candidates()
                firsts.clear()
            if len(out) >= 50_000:
                yield _rows(out)
                out = []
        yield _rows(out)
    rest = candidates()
    for at in range(0, len(rest), 50_000):
        yield _rows(rest[at : at + 50_000])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes rows sorted by hash and document; of each hash, lines of all but the first document are marked to drop."""
    h1 = h2 = first = None
    for batch in batches:
        state = batch.column("state").to_numpy()
        is_open = np.flatnonzero(state == OPEN)
        keep = state != OPEN
        if len(is_open):
            a, b, doc = (batch.column(c).to_numpy()[is_open] for c in ("h1", "h2", "doc_id"))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if h1 is not None and a[0] == h1 and b[0] == h2:
                new[0] = False
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - (1 if new[0] else 0)  # 0 stands for the run that goes on from the batch before, if any
            heads = np.concatenate([[first], doc[starts]]) if not new[0] else doc[starts]
            of = heads[run].astype("int64")
            keep[is_open] = doc > of
            h1, h2, first = a[-1], b[-1], int(of[-1])
        yield batch.filter(pa.array(keep)).drop_columns(["h1", "h2"])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, lists = batch.column("n_lines").to_pylist(), batch.column("lists").to_pylist()
        dropped, maps = [], []
        for n, places in zip(n_lines, lists, strict=True):
            bits = np.ones(n, bool)
            for p in places:
                bits[np.frombuffer(p, "<i4")] = False
            dropped.append(n - int(bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        ids = pa.array([None if d == LAST else d for d in batch.column("doc_id").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def line_keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: for each document (and text), the compressed bitmap of the lines to keep."""
    schema = "doc_id long, text_hash long, n_lines int, places binary, state byte"
    marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_lines, "h1 long, h2 long, " + schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ranges of a uniform hash: no sampling pass, which would read and split every text twice
    ranged = marks.repartitionById(parts, F.expr(f"cast(((shiftright(h1, 40) + 8388608) * {parts}) div 16777216 as int)"))
    decided = ranged.sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_stream, schema)
    lists = decided.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list(F.when(F.col("state") != HEAD, F.col("places"))).alias("lists"))
    return lists.mapInArrow(_bitmap, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


@tidy
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [xxhash.xxh3_64_intdigest(t.as_py() or b"") - 2**63 for t in batch.column("text").cast(pa.binary())]
        yield batch.append_column("__text_hash", pa.array(keys, pa.int64()))


@tidy
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, dropped, keep in zip(batch.column("text").cast(pa.binary()), batch.column("__n_dropped").to_pylist(), batch.column("__keep").to_pylist(), strict=True):
            raw = text.as_py() or b""
            if dropped:
                lines = raw.split(b"\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), "u1"), count=len(lines))
                raw = b"\n".join(x for x, b in zip(lines, bits, strict=True) if b)
            texts.append(raw)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string())).drop_columns(["__keep"])


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the kept lines as text (null became empty), and __n_lines, __n_dropped. Only the narrow side is built into hash tables."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*docs.schema.fields]).add("__text_hash", LongType())
    keyed = docs.mapInArrow(_hashes, schema)
    maps = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep"))
    both = keyed.join(maps.hint("shuffle_hash"), keyed["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")), "left").drop("__doc", "__hash", "__text_hash")
    return both.mapInArrow(_kept, StructType([f for f in both.schema.fields if f.name != "__keep"]))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text; n_chars, where there is one, is the new length. A document stays, if without lines."""
    out = apply_keep(docs, line_keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_keep(docs, line_keep_bitmaps(docs)).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


#: Blanks by number, so that the pattern is plain in any dialect.
_BLANKS = " || ".join(f"chr({b})" for b in BLANKS)
ORACLES = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(lines) + 1)) AS t(i)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
k AS (SELECT l.*, f.key IS NULL OR l.doc_id = f.first AS keep FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM k GROUP BY doc_id""",
}
