"""Secret scan with multipart credential linking.

A part is an access identifier, a secret or an endpoint. Strong parts (the base kinds assign, access and hex) are
reported as they stand. Weak ones (bare tokens that may be secrets, login names, endpoints) are reported only when a
complementary part lies within `reach` code points in the same scope, a block of text between blank lines.

The link is an interval join of each weak part's reach with the complementary parts of its scope. It is done as two
sorted sweeps, onward with a running latest end and backward with a running earliest start, so no pairs are made and a
scope with very many parts costs no more than its two sorts. Only the parts are shuffled, never texts.

Defined cases: null text counts as empty; an empty text has no spans; null doc_id is a value like any other; rows that
are the same are each returned; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: The kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ["assign", "access", "hex", "secret", "login", "endpoint"]
#: The base patterns, on UTF-8 bytes.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: The weak parts: bare tokens of 16 and more, names after a login word, urls and host:port.
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
LOGIN = re.compile(rb"""(?i:username|user|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
ENDPOINT = re.compile(rb"(?:https?|jdbc:[a-z]+|s3|postgres|mysql|mongodb)://[A-Za-z0-9._-]+(?::\d+)?|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b")
DIGIT, LETTER, BLANK = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]"), re.compile(rb"\n[\x20\t\r]*\n")
REACH = 200


def parts(text: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, scope, start, end) in code points, by start and kind. Weak parts that overlap strong ones are left out."""
    strong = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    strong += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    strong += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    strong.sort()
    weak = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]
    weak += [(m.start(), 4, m.end()) for m in LOGIN.finditer(text)]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if not strong and not weak:
        return []
    begins, until = [s for s, _, _ in strong], [0, *accumulate((e for _, _, e in strong), max)]
    # the latest end of the strong ones that begin before this one's end
    found = sorted(strong + [(s, k, e) for s, k, e in weak if s >= until[bisect_left(begins, e)]])
    places = {0: 0}  # bytes to code points, walked once
    seen = points = 0
    plain = text.isascii()
    for at in sorted({x for s, _, e in found for x in (s, e)}):
        points += at - seen if plain else len(text[seen:at].decode("utf-8", "replace"))
        places[at], seen = points, at
    blanks, scope, out = iter([m.start() for m in BLANK.finditer(text)] + [len(text) + 1]), 0, []
    nearest = next(blanks)
    for start, kind, end in found:
        while start > nearest:
            scope, nearest = scope + 1, next(blanks)
        out.append((kind, scope, places[start], places[end]))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("kind", pa.int32()), ("scope", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py() or b""
            key = xxhash.xxh3_64_intdigest(raw) - 2**63
            rows.append((doc_id, key, -1, 0, 0, 0))
            rows += [(doc_id, key, *p) for p in parts(raw)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def linked_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row for each row of docs: doc_id and spans, array<struct<start, kind, end>> by start and kind (a place in KINDS)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, text_hash long, kind int, scope int, start int, end int").repartition("doc_id", "text_hash")
    scope = Window.partitionBy("doc_id", "text_hash", "scope")
    # what lies behind is what lies before in the reversed order: a frame that ends with the partition is recomputed for each row
    before, behind = (scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("start", "kind", "end"), (F.desc("start"), F.desc("kind"), F.desc("end"))))
    roles = {"id": (1, 4), "secret": (0, 2, 3), "endpoint": (5,)}

    def near(*names: str):
        """Whether a part of these roles ends or begins within reach."""
        of = F.col("kind").isin([k for n in names for k in roles[n]])
        return (F.max(F.when(of, F.col("end"))).over(before) >= F.col("start") - reach) | (F.min(F.when(of, F.col("start"))).over(behind) <= F.col("end") + reach)

    tagged = found.select(
        "*",
        F.coalesce(near("id", "endpoint"), F.lit(False)).alias("by_other"),
        F.coalesce(near("secret"), F.lit(False)).alias("by_secret"),
    )
    keep = (F.col("kind") < 3) | ((F.col("kind") == 3) & F.col("by_other")) | ((F.col("kind") > 3) & F.col("by_secret"))
    return (
        tagged.groupBy("doc_id", "text_hash")
        .agg(F.sum((F.col("kind") == -1).cast("int")).alias("copies"), F.array_sort(F.collect_set(F.when(keep & (F.col("kind") >= 0), F.struct("start", "kind", "end")))).alias("spans"))
        .select("doc_id", "spans", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy")
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return linked_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] > 2)).cast("long").alias("n_linked"),
    )


def _at(name: str, pattern: str, group: int, where: str = "true") -> str:
    """Rows doc_id, kind, s, e of a pattern's matches: the pieces between them, added up, tell where they are."""
    kind, quoted = KINDS.index(name), pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, pos AS s, pos + length(m) AS e FROM (SELECT doc_id, m, g, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
FROM (SELECT doc_id, i, p, ms, ms[i] AS m, gs[i] AS g FROM (SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}', 0) AS ms, regexp_extract_all(text, '{quoted}', {group}) AS gs FROM d), unnest(range(1, len(ms) + 1)) AS t(i))) WHERE {where}"""


def _sql() -> str:
    of = lambda p: p.pattern.decode()
    parts = [_at("assign", of(ASSIGN), 2, "length(g) >= 6"), _at("access", of(ACCESS), 0), _at("hex", of(HEX), 0)]
    weak = [_at("secret", of(TOKEN), 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"), _at("login", of(LOGIN), 0), _at("endpoint", of(ENDPOINT), 0)]
    near = "b.doc_id = a.doc_id AND b.scope = a.scope AND (((b.s, b.kind, b.e) < (a.s, a.kind, a.e) AND b.e >= a.s - {0}) OR ((b.s, b.kind, b.e) > (a.s, a.kind, a.e) AND b.s <= a.e + {0}))".format(REACH)
    names = f"{KINDS!r}[kind + 1]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
strong AS ({" UNION ALL ".join(parts)}), weak AS ({" UNION ALL ".join(weak)}), blank AS ({_at("assign", of(BLANK), 0)}),
f AS (SELECT * FROM strong UNION ALL SELECT * FROM weak w WHERE NOT EXISTS (SELECT 1 FROM strong x WHERE x.doc_id = w.doc_id AND x.s < w.e AND x.e > w.s)),
a AS (SELECT f.*, (SELECT count(*) FROM blank WHERE blank.doc_id = f.doc_id AND blank.s < f.s) AS scope FROM f),
k AS (SELECT * FROM a WHERE kind < 3 OR (kind = 3 AND EXISTS (SELECT 1 FROM a b WHERE b.kind IN (1, 4, 5) AND {near})) OR (kind > 3 AND EXISTS (SELECT 1 FROM a b WHERE b.kind IN (0, 2, 3) AND {near}))),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked,
  string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLES = {"op1_secret_scan": _sql()}
