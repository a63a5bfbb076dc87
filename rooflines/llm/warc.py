"""WARC archives with an index made first and byte ranges read through it.

Each task writes its records to an archive of its own in the shared folder, every record a gzip member, and returns an
index row for each: archive, offset, length, url and digest. The index is kept by a checkpoint; a task that is run
again writes another archive, and the index only names the archives of tasks that ended well. Reading deals the index
rows wanted into as many tasks as their bytes ask for, sorts them by archive and offset, joins neighbouring ranges
into one read of bounded size and parses the records.

A target header holds the url as it is, but for control signs, blanks and what isn't ASCII, which are escaped; a % stays
one. A url that had to be escaped is kept in a header of its own too, so that it comes back exactly.

A payload's first page (the smallest page_id) is the response; pages with an equal payload become revisit records
without payload that refer to it. The join on the payload's digest is a sort-merge join, which Spark splits where one
payload has very many pages.

Defined cases: null html counts as empty; a null page_id ranks after all others; rows that repeat the smallest
page_id of a payload are all responses; a null url leaves the target header out; an empty table gives an empty index; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, remove, shared_dir

#: Payloads of at least so many bytes are replaced by revisits; ranges this near are read at once, up to so many bytes.
LEAST, GAP, MOST = 0, 65536, 8 << 20
#: Bytes of archives that a reading task gets, more where there would be over so many tasks.
PER_TASK, MOST_TASKS = 4 << 20, 20_000
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
#: Fixed values of the records; the signs that a target header holds as they are: all of ASCII that can be seen.
SEEN = "".join(map(chr, range(0x21, 0x7F)))
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, kind: str) -> bytes:
    """One record, uncompressed. For revisits payload only counts by its length."""
    block = (HTTP % len(payload)) + payload if kind == "response" else HTTP % len(payload)
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE]
    if url is not None:
        escaped = quote(url, safe=SEEN)
        lines.append(b"WARC-Target-URI: " + escaped.encode())
        if escaped != url:
            lines.append(b"X-Source-URL: " + base64.b64encode(url.encode()))
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % str(first).encode()]
    lines += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers by lower-cased name, its http headers under http, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    out = {k.lower().decode(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower().decode(): v.decode() for k, _, v in (x.partition(b": ") for x in http.split(b"\r\n")[1:])}
    return out | {"payload": payload}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "None") else int(name)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        store, path = fs.FileSystem.from_uri(folder)
        at = 0
        for batch in batches:
            rows = []
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html or "").encode()
                kind = "response" if page_id == first or len(payload) < LEAST else "revisit"
                digest = base32_sha1(payload)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = squeeze.compress(record(page_id, url, payload, digest, first, kind)) + squeeze.flush()
                out.write(packed)
                rows.append((f"{folder}/{name}", at, len(packed), url, digest, page_id, kind))
                at += len(packed)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives under folder (a URI) and returns their index, computed once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("d"))
    firsts = rows.groupBy(F.col("d").alias("first_d")).agg(F.min("page_id").alias("first"))
    return cut(rows.join(firsts, F.col("d") == F.col("first_d")).select("page_id", "url", "html", "first").mapInArrow(_writer(folder), INDEX))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    opened: tuple[str, pa.NativeFile] | None = None

    def taken(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        """Reads a run of ranges of one archive at once."""
        nonlocal opened
        archive, first, last = run[0][0], run[0][1], run[-1][1] + run[-1][2]
        if opened is None or opened[0] != archive:
            if opened is not None:
                opened[1].close()
            store, path = fs.FileSystem.from_uri(archive)
            opened = archive, store.open_input_file(path)
        data = opened[1].read_at(last - first, first)
        rows = []
        for _, at, n in run:
            r = parse(zlib.decompress(data[at - first : at - first + n], 31))
            full = int(r["http"]["content-length"])
            url = base64.b64decode(r["x-source-url"]).decode() if "x-source-url" in r else r.get("warc-target-uri")
            digest = base32_sha1(r["payload"]) if r["warc-type"] == "response" else r["warc-payload-digest"].removeprefix("sha1:")
            if digest != r["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"{archive}: the record at {at} doesn't have the payload that it names")
            rows.append((_number(r["warc-record-id"]), url, r["payload"] if r["warc-type"] == "response" else None, full, digest, r["warc-type"], _number(r.get("warc-refers-to"))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    run: list[tuple[str, int, int]] = []
    for batch in batches:
        for archive, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if run and (archive != run[-1][0] or at - run[-1][1] - run[-1][2] > GAP or at + n - run[0][1] > MOST):
                yield taken(run)
                run = []
            run.append((archive, at, n))
    if run:
        yield taken(run)
    if opened is not None:
        opened[1].close()


def read_records(index: DataFrame) -> DataFrame:
    """The records that these index rows name. A task gets neighbouring ranges; a long archive is split over tasks."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-total // PER_TASK)))
    # a number of partitions that is asked for isn't merged again by the few bytes of the index rows themselves
    spread = index.select("archive", "offset", "length").repartition(tasks, "archive", F.expr(f"offset div {max(PER_TASK, total // tasks)}")).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(_reader, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    folder = f"{folder if ':/' in folder else 'file://' + folder}/warc-{uuid.uuid4().hex}"
    try:
        index = write_archives(read(spark, sf_dir, "pages"), folder)
        # what was read back is kept, the archives of this query aren't
        return cut(read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"))
    finally:
        remove(spark, folder)


ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST((j // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url
FROM d""",
}
