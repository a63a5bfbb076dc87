"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

An item's windows (WINDOW words, or the whole of a shorter item) are sequences of word numbers in one automaton.
Texts are normalised byte for byte (A-Z lower-cased, all that isn't part of a word a space), so places in the
normalised text are places in the original; each text is walked once. Hit words come back as spans of the original.

The automaton is shared with all tasks when the items' texts have at most MOST_BYTES in all; nothing is shuffled then.
A larger benchmark never passes through the driver: its windows and those of the texts, told by 128-bit hashes, are
joined. Texts are scanned once there too, and of their windows only those are sent that a bitmap of bounded size (one
bit for each of the items' windows, so it may let others pass) doesn't rule out. Both ways give the same rows.

Defined cases: null or empty text has no words and no hits; null or empty items have no windows; an item whose id is
null marks words but isn't listed; items that are the same are each listed; rows that are the same give the same
values; empty tables on either side give no rows or no hits; extra columns are ignored, whatever their names. Each row
is judged by its own text, whether its id is null or others have it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, automaton
from .common import WORD_BYTES, cut, free, read, tidy

WINDOW = 10
MOST_BYTES = 8 << 20
#: Words of texts that take their steps together.
GROUP = 1 << 17
#: The bitmap of a large benchmark's windows has 2 ** BITS bits, made in parts of 2 ** PART.
BITS, PART = 26, 19
OUT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
HIT = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Places in bytes as places in code points."""
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)])
    return begins[places]


def _runs(inside: np.ndarray) -> np.ndarray:
    """First and last+1 of each run of true."""
    return np.flatnonzero(np.diff(np.concatenate([[0], inside.astype("i1"), [0]]))).reshape(-1, 2)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pairs]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def _spans(found) -> list[dict]:
    return [{"start": int(a), "end": int(b)} for a, b in found]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[list[bytes]]]]:
    """A batch's texts and their words, in groups of some GROUP words, each with its first row's place."""
    begin, raws, found, n = 0, [], [], 0
    for text in batch.column("text").cast(pa.binary()):
        raws.append(text.as_py() or b"")
        found.append(words(raws[-1]))
        n += len(found[-1])
        if n >= GROUP:
            yield begin, raws, found
            begin, raws, found, n = begin + len(raws), [], [], 0
    if raws:
        yield begin, raws, found


def _scanner(shared):
    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Automaton = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for begin, raws, found in _groups(batch):
                state = made.states(found)
                ends = np.flatnonzero(made.last[state])
                n = made.lengths(made.last[state[ends]])
                change = np.zeros(len(state) + 1, "i4")  # the longest window that ends at a word covers the others that do
                np.add.at(change, ends + 1 - n, 1)
                np.add.at(change, ends + 1, -1)
                covered = np.cumsum(change)[:-1] > 0
                rows, at = [], 0
                for doc_id, raw, here in zip(ids[begin : begin + len(raws)], raws, found, strict=True):
                    runs, items, spans = _runs(covered[at : at + len(here)]), [], []
                    if len(runs):
                        mine = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(here))]
                        items = made.items(made.sequences(np.unique(state[mine]))[1])
                        letters = _runs(np.frombuffer(raw.translate(WORD_BYTES), "u1") != 32)
                        spans = code_points(raw, np.stack([letters[runs[:, 0], 0], letters[runs[:, 1] - 1, 1]], axis=1))
                    rows.append((doc_id, len(here), int((runs[:, 1] - runs[:, 0]).sum()), items, _spans(spans)))
                    at += len(here) + 1
                yield _batch(rows)

    return scan


# large benchmarks -------------------------------------------------------------------------------------------------


def window_hashes(digests: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit hashes of each n words in a row; digests: two of each word."""
    out = np.full((len(digests) - n + 1, 2), n, "u8")
    for j in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + digests[j : j + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(31))).view("i8")


def word_digests(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "u8").reshape(-1, 2)


def _item_windows(window: int):
    @tidy
    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = words(text.as_py() or b"")
                if found:
                    n = min(window, len(found))
                    h = np.unique(window_hashes(word_digests(found), n), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["item", "n", "h1", "h2"])

    return show


def _bits(bits_of_part: int):
    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; a bitmap for each."""
        part, bits = None, np.zeros(1 << bits_of_part, bool)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            parts, at = batch.column("part").to_numpy(), batch.column("bit").to_numpy()
            for p in np.unique(parts):
                if part is not None and p != part:
                    yield made()
                    bits[:] = False
                part = int(p)
                bits[at[parts == p]] = True
        if part is not None:
            yield made()

    return show


def window_bitmap(windows: DataFrame) -> np.ndarray:
    """2 ** BITS bits as bytes, one set for each window's h1; Spark makes the parts."""
    at = windows.select(F.expr(f"cast(shiftright(h1, {PART}) & {2 ** (BITS - PART) - 1} as int)").alias("part"), F.expr(f"cast(h1 & {2**PART - 1} as int)").alias("bit"))
    parts = at.distinct().repartition(2 ** min(5, BITS - PART), "part").sortWithinPartitions("part").mapInArrow(_bits(PART), "part int, bits binary")
    out = np.zeros((1 << (BITS - PART), 1 << (PART - 3)), "u1")
    for part, bits in parts.toLocalIterator():
        out[part] = np.frombuffer(bits, "u1")
    return out.reshape(-1)


MARKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _marks(shared, lengths: list[int], bits: int):
    """A row for each text (first is null), and one for each window that the bitmap lets pass."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            own: list[tuple] = []
            for doc_id, text, key in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("text_hash").to_pylist(), strict=True):
                raw = text.as_py() or b""
                found = words(raw)
                own.append((doc_id, key, len(found)))
                at = digests = None
                for n in lengths:
                    if len(found) < n:
                        continue
                    digests = word_digests(found) if digests is None else digests
                    h = window_hashes(digests, n)
                    bit = h[:, 0] & (2**bits - 1)
                    first = np.flatnonzero(bitmap[bit >> 3] >> (7 - (bit & 7)).astype("u1") & 1)
                    if not len(first):
                        continue
                    if at is None:
                        letters = np.frombuffer(raw.translate(WORD_BYTES), "u1") != 32
                        at = code_points(raw, _runs(letters))
                    cols = [np.full(len(first), doc_id if doc_id is not None else 0, "i8"), np.full(len(first), key, "i8"), np.full(len(first), len(found), "i8"), h[first, 0], h[first, 1], first.astype("i4"), (first + n).astype("i4"), at[first, 0].astype("i4"), at[first + n - 1, 1].astype("i4")]
                    made = [pa.array(c, f.type) for c, f in zip(cols, MARKS, strict=True)]
                    if doc_id is None:
                        made[0] = pa.nulls(len(first), pa.int64())
                    yield pa.RecordBatch.from_arrays(made, schema=MARKS)
            cols = list(zip(*own, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *(pa.nulls(len(own), f.type) for f in list(MARKS)[3:])], schema=MARKS)

    return scan


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts a text's windows together to runs of hit words."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            runs: list[dict] = []
            for x in sorted(r["hits"], key=lambda x: (x["first"], x["last"])):
                if runs and x["first"] <= runs[-1]["last"]:
                    if x["last"] > runs[-1]["last"]:
                        runs[-1] |= {"last": x["last"], "end": x["end"]}
                else:
                    runs.append(x)
            rows.append((r["doc_id"], r["n_words"], sum(x["last"] - x["first"] for x in runs), sorted(set(r["items"])), _spans((x["start"], x["end"]) for x in runs)))
        yield _batch(rows)


def _joined(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Marks of docs (kept by a checkpoint), those of them that are windows of items, and the items' windows."""
    wins = cut(benchmark.where("length(text) > 0").select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_windows(window), "item string, n int, h1 long, h2 long"))
    lengths = [r.n for r in wins.select("n").distinct().collect()]  # WINDOW numbers at most
    bitmap = docs.sparkSession.sparkContext.broadcast(window_bitmap(wins))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    marks = cut(plain.mapInArrow(_marks(bitmap, lengths, BITS), "doc_id long, text_hash long, n_words long, h1 long, h2 long, first int, last int, start int, end int"))
    return marks, wins


def _contamination_by_join(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    marks, wins = _joined(docs, benchmark, window)
    hit = marks.where("first is not null").join(wins.select("h1", "h2").distinct(), ["h1", "h2"])
    owned = hit.select("doc_id", "text_hash", "h1", "h2").distinct().join(wins.where("item is not null"), ["h1", "h2"]).select("doc_id", "text_hash", "item").distinct()
    none, no_items = F.array().cast(HIT), F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    both = marks.where("first is null").select("doc_id", "text_hash", "n_words", F.lit(1).alias("own"), none.alias("hits"), no_items.alias("items"))
    both = both.union(hit.select("doc_id", "text_hash", zero, F.lit(0), F.array(F.struct("first", "last", "start", "end")), no_items))
    both = both.union(owned.select("doc_id", "text_hash", zero, F.lit(0), none, F.array("item")))
    grouped = both.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.sum("own").alias("own"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items")))
    spread = grouped.withColumn("own", F.explode(F.sequence(F.lit(1), F.col("own").cast("int")))).drop("own", "text_hash")
    return spread.mapInArrow(_merge, OUT)


def _items(benchmark: DataFrame, most_bytes: int) -> list[tuple[str | None, bytes]] | None:
    """The items that have a text, in the order of their ids; None if they have more than most_bytes."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        return None
    rows = benchmark.where("length(text) > 0").select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("raw"))
    return [(item, bytes(raw)) for item, raw in rows.orderBy("item", "raw").collect()]


def _made(items: list[tuple[str | None, bytes]], window: int) -> Automaton:
    """The automaton of items; where they have no window, that of a word that no text has."""
    return automaton([(item, words(text)) for item, text in items], window) or automaton([(None, [b" "])], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each row of docs: words, hit words, the items found (sorted as strings) and the hit spans in code points."""
    items = _items(benchmark, most_bytes)
    if items is None:
        return _contamination_by_join(docs, benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(_made(items, window))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(shared), OUT)


def _cleaner(shared):
    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Automaton = shared.value
        for batch in batches:
            for begin, raws, found in _groups(batch):
                hit = np.append(np.cumsum(made.last[made.states(found)] > 0), 0)  # the last is 0: what comes before the first text
                to = np.cumsum([len(t) + 1 for t in found]) - 1
                yield batch.slice(begin, len(raws)).filter(pa.array(np.diff(hit[np.append(-1, to)]) == 0))

    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs without the rows that hold a window of an item, with all their columns."""
    items = _items(benchmark, most_bytes)
    if items is not None:
        return docs.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(_made(items, window))), docs.schema)
    marks, wins = _joined(docs, benchmark, window)
    names = free("__id", docs), free("__text", docs)
    found = marks.where("first is not null").join(wins.select("h1", "h2"), ["h1", "h2"], "left_semi").select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


ORACLES = {
    "op7_decontaminate": f"""
WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS t(i) WHERE len(w) > 0),
found AS (SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i)) s JOIN win ON s.n = win.n AND s.win = win.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
}
