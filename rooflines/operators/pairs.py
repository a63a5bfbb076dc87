"""Sums over all pairs of polygons that meet, without a row for each pair.

Both sides are brought together in the cells of `spatial`'s grid and sorted there, the right side's rows before the left's. A
task holds one cell's right rows and goes through the left ones in batches: boxes are compared as flat arrays, and only of
those that meet are the polygons' own areas worked out. Polygons with upright and level edges only are cut to rectangles
before (`polygons.rectangles`); others go by their edges (`polygons.overlaps`). Cells with many rows are dealt out as blocks
of rows, so that no task holds or compares a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, polygons
from .spatial import _keys, _side, box_level, levels, with_cells

#: A block of a cell has about so many right and left rows; a task about so many rows, and pairs to look at.
RIGHT_ROWS, LEFT_ROWS, TASK_ROWS, TASK_PAIRS = 20_000, 100_000, 100_000, 400_000_000
#: So many rows are read before they are worked on; so many candidates and pairs are looked at at once; cells with fewer candidates than SMALL are worked on together.
HELD, CANDIDATES, MET, SMALL = 60_000, 40_000, 10_000, 4000

CELL = ("__same", "__kind", "__level", "__cx", "__cy")
KEYS = (*CELL, "__rpart", "__lpart")
CORNERS = ("x1", "y1", "x2", "y2")
SUMS = T.StructType().add("pairs", T.LongType()).add("touching", T.LongType()).add("shared", T.DoubleType()).add("iou", T.DoubleType())


def met_sums(left: DataFrame, right: DataFrame, side: float, by: list[str], same: str | None = None) -> DataFrame:
    """left (lbox, and the columns by) and right (rbox): by, and over the right rows that a left one meets, touching included: pairs, touching (pairs that share no area), shared (area), iou.

    Both may have rings, then the boxes only make the candidates. same: a column that must be equal. A left row comes once for each cell where it meets
    something, so the caller adds them up. Left rows beyond all of the right side are left out before anything else.
    """
    exact = "rings" in left.columns
    ends = right.agg(F.min("rbox.x1"), F.min("rbox.y1"), F.max("rbox.x2"), F.max("rbox.y2")).first()
    left = left.where(geo.boxes_meet(F.col("lbox"), geo.box(*(F.lit(v) for v in ends))))

    def shaped(df: DataFrame, is_left: bool, box: str, *more: str) -> DataFrame:
        mix = F.xxhash64(*(c for c, kind in df.dtypes if c != "rings" and "map<" not in kind))
        key = (F.lit(None) if same is None else F.col(same)).cast("string")
        return df.select(*more, F.lit(is_left).alias("__left"), key.alias("__same"), mix.alias("__mix"), F.col(box).alias("__box"), *([F.col("rings").alias("__rings")] if exact else []))

    a, b = shaped(left, True, "lbox", *by), shaped(right, False, "rbox")
    level, box = box_level(F.col("__box"), side), F.col("__box")
    found = levels(left=a.select(level.alias("__level")), right=b.select(level.alias("__level")))
    rows = a.unionByName(b, allowMissingColumns=True)
    if exact:
        rows = rows.withColumn("__parts", polygons.rectangles(F.col("__rings")))
        rows = rows.withColumn("__rings", F.when(F.col("__parts").isNull(), F.col("__rings")))
    else:
        rows = rows.withColumn("__parts", F.array(*(box[c] for c in CORNERS)))
    if max([0, *found["left"], *found["right"]]) == 0:
        rows = rows.withColumn("__kind", F.lit(0)).withColumn("__level", F.lit(0))
    else:
        rows = rows.withColumn("__k", F.explode(F.when(F.col("__left"), _keys(level, found["right"], True)).otherwise(_keys(level, found["left"], False))))
        rows = rows.withColumn("__kind", F.col("__k.kind")).withColumn("__level", F.col("__k.level")).drop("__k")
    rows, tasks = _blocks(with_cells(rows, "__box", _side(F.col("__level"), side), "__cx", "__cy"))
    rows = rows.select(*by, *KEYS, "__left", _side(F.col("__level"), side).alias("__wide"), *(box[c].alias(f"__{c}") for c in CORNERS), "__parts", *(["__rings"] if exact else []))
    schema = T.StructType(left.select(*by).schema.fields + SUMS.fields)
    return rows.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "__left").mapInArrow(_summed(by, exact), schema)


def _blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with __rpart and __lpart: where a cell has many rows, each block of right ones meets each block of left ones; and how many tasks the whole takes."""
    is_left = F.col("__left")
    counted = rows.groupBy(*CELL).agg(F.count_if(is_left).alias("__l"), F.count_if(~is_left).alias("__r")).where("__l > 0 and __r > 0")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    counted = counted.withColumn("__lp", parts("__l", LEFT_ROWS)).withColumn("__rp", parts("__r", RIGHT_ROWS))
    told = counted.agg(F.sum(F.col("__l") * F.col("__rp") + F.col("__r") * F.col("__lp")), F.sum(F.col("__l").cast("double") * F.col("__r")), F.max(F.greatest("__lp", "__rp"))).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(told[0] or 0) // TASK_ROWS), int((told[1] or 0) // TASK_PAIRS))
    if (told[2] or 0) <= 1:
        return rows.withColumn("__rpart", F.lit(0)).withColumn("__lpart", F.lit(0)), tasks
    large = counted.where("__lp > 1 or __rp > 1").select(*(F.col(c).alias(f"_{c}") for c in CELL), "__lp", "__rp")
    here = F.col("__same").eqNullSafe(F.col("___same"))
    for c in CELL[1:]:
        here &= F.col(c) == F.col(f"_{c}")
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    dealt = rows.join(large, here, "left").withColumn("__own", F.pmod("__mix", F.when(is_left, n("__lp")).otherwise(n("__rp")).cast("long")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.when(is_left, n("__rp")).otherwise(n("__lp")) - 1)))
    return dealt.withColumn("__rpart", F.when(is_left, F.col("__other")).otherwise(F.col("__own"))).withColumn("__lpart", F.when(is_left, F.col("__own")).otherwise(F.col("__other"))), tasks


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class Rows:
    """Some cells' rows as flat arrays, and the sums of the left ones so far."""

    def __init__(self, batch: pa.RecordBatch, exact: bool):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.left = get("__left").astype(bool)
        self.x1, self.y1, self.x2, self.y2, self.wide = (get(c) for c in ("__x1", "__y1", "__x2", "__y2", "__wide"))
        self.cx, self.cy = get("__cx"), get("__cy")
        n = batch.num_rows
        change = np.zeros(max(0, n - 1), bool)
        for c in KEYS:
            v = batch.column(c)
            v = pc.fill_null(v.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) if c == "__same" else v.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        self.at = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, int)
        # a rectangle of each polygon after another; beyond the last one of a polygon there are some that meet nothing
        parts = batch.column("__parts")
        self.k = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        values, start = pc.list_flatten(parts).to_numpy(zero_copy_only=False).reshape(-1, 4), np.cumsum(self.k) - self.k
        self.rects = []
        for i in range(int(self.k.max(initial=0))):
            r, has = np.full((4, n), np.inf), self.k > i
            r[2:] = -np.inf
            r[:, has] = values[start[has] + i].T
            self.rects.append(r)
        self.values, self.start = values, start
        self.rings = polygons.Rings.read(batch.column("__rings")) if exact else None
        self.area = np.bincount(np.repeat(np.arange(n), self.k), (values[:, 2] - values[:, 0]) * (values[:, 3] - values[:, 1]), n)
        if exact:
            self.area += polygons.areas(self.rings)
        self.pieces = None
        self.sums = np.zeros((4, n))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.found = 0

    def work(self, last: int) -> None:
        """All pairs of the cells that begin before row last."""
        cells = int(np.searchsorted(self.at, last, "left"))
        begin, end = self.at[:cells], self.at[1 : cells + 1]
        lefts = np.concatenate([[0], np.cumsum(self.left)])
        middle = end - (lefts[end] - lefts[begin])
        candidates = (end - middle) * (middle - begin)
        small = np.flatnonzero((candidates > 0) & (candidates < SMALL))
        upto = np.cumsum(candidates[small])
        for some in np.split(small, np.searchsorted(upto, np.arange(MET, int(upto[-1]), MET))) if len(small) else []:
            n = candidates[some]
            row, col = np.divmod(_runs(np.zeros(len(some), np.int64), n), np.repeat(middle[some] - begin[some], n))
            self.meet(np.repeat(middle[some], n) + row, np.repeat(begin[some], n) + col)
        for c in np.flatnonzero(candidates >= SMALL):
            self.large(np.arange(begin[c], middle[c]), np.arange(middle[c], end[c]))
        self.flush()

    def large(self, right: np.ndarray, left: np.ndarray) -> None:
        """One cell's pairs, some left rows after another with the right ones that can reach them along the axis."""
        right, left = right[np.argsort(self.x1[right], kind="stable")], left[np.argsort(self.x1[left], kind="stable")]
        x1, y1, x2, y2 = (v[right] for v in (self.x1, self.y1, self.x2, self.y2))
        widest, step = np.nextafter((x2 - x1).max(), np.inf), int(np.clip(CANDIDATES // len(right), 1, 256))
        for i in range(0, len(left), step):
            some = left[i : i + step]
            low, high = np.searchsorted(x1, np.nextafter(self.x1[some[0]] - widest, -np.inf), "left"), np.searchsorted(x1, self.x2[some].max(), "right")
            for j in range(low, high, CANDIDATES):
                k = slice(j, min(high, j + CANDIDATES))
                met = x1[k] <= self.x2[some][:, None]
                met &= x2[k] >= self.x1[some][:, None]
                met &= y1[k] <= self.y2[some][:, None]
                met &= y2[k] >= self.y1[some][:, None]
                at = np.flatnonzero(met)
                if len(at):
                    row, col = np.divmod(at, k.stop - j)
                    self.meet(some[row], right[j + col], True)

    def meet(self, left: np.ndarray, right: np.ndarray, known: bool = False) -> None:
        """Of candidates, those whose boxes meet and which belong to this cell: the lower corner of what they share lies in it."""
        x, y = np.maximum(self.x1[left], self.x1[right]), np.maximum(self.y1[left], self.y1[right])
        wide = self.wide[left]
        keep = (np.floor(x / wide) == self.cx[left]) & (np.floor(y / wide) == self.cy[left])
        if not known:
            keep &= (x <= np.minimum(self.x2[left], self.x2[right])) & (y <= np.minimum(self.y2[left], self.y2[right]))
        self.waiting.append((left[keep], right[keep]))
        self.found += int(keep.sum())
        if self.found >= MET:
            self.flush()

    def flush(self) -> None:
        """Works out what the pairs that wait share."""
        if not self.found:
            self.waiting = []
            return
        left, right = (np.concatenate(v) for v in zip(*self.waiting, strict=True))
        self.waiting, self.found = [], 0
        met, shared = np.zeros(len(left), bool), np.zeros(len(left))
        rights = [r.take(right, 1) for r in self.rects[: int(self.k[right].max())]]
        for r in self.rects[: int(self.k[left].max())]:
            a = r.take(left, 1)
            for b in rights:
                w, h = np.minimum(a[2], b[2]), np.minimum(a[3], b[3])
                w -= np.maximum(a[0], b[0])
                h -= np.maximum(a[1], b[1])
                met |= np.minimum(w, h) >= 0
                shared += np.maximum(w, 0.0, out=w) * np.maximum(h, 0.0, out=h)
        if self.rings is not None:
            other = np.flatnonzero((self.k[left] == 0) | (self.k[right] == 0))
            if len(other):
                met[other], shared[other] = self.by_edges(left[other], right[other])
        left, right, shared = left[met], right[met], shared[met]
        union = self.area[left] + self.area[right] - shared
        iou = np.where(union > 0, shared / np.where(union > 0, union, 1.0), 0.0)
        low = int(left.min(initial=0))
        for row, weights in enumerate((None, (shared == 0).astype(float), shared, iou)):
            add = np.bincount(left - low, weights)
            self.sums[row, low : low + len(add)] += add

    def by_edges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in which a polygon is no rectangles: its edges with those of the other one, or of each of its rectangles."""
        n = len(self.k)
        if self.pieces is None:
            x1, y1, x2, y2 = self.values.T
            corners = np.stack([np.stack(c, 1) for c in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))], 1).reshape(-1, 2)
            m, r = len(self.values), self.rings
            self.pieces = polygons.Rings(np.concatenate([r.p, corners]), np.concatenate([r.at, r.at[-1] + 4 * np.arange(1, m + 1)]), np.concatenate([r.of, r.of[-1] + np.arange(1, m + 1)]))
        many, first = np.maximum(self.k, 1), np.where(self.k > 0, n + self.start, np.arange(n))
        number = many[left] * many[right]
        pair, place = np.repeat(np.arange(len(left)), number), _runs(np.zeros(len(left), np.int64), number)
        met, shared = np.zeros(len(left), bool), np.zeros(len(left))
        for i in range(0, len(pair), 20_000):
            p, at = pair[i : i + 20_000], place[i : i + 20_000]
            a, b = first[left[p]] + at // many[right[p]], first[right[p]] + at % many[right[p]]
            found = polygons.overlaps(self.pieces.take(a), self.pieces.take(b))
            touch = ~np.isnan(found)
            met[p[touch]] = True
            shared += np.bincount(p[touch], found[touch], len(left))
        return met, shared


def _summed(by: list[str], exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: Rows, batch: pa.RecordBatch) -> pa.RecordBatch:
            some = np.flatnonzero(rows.sums[0] > 0)
            taken = batch.select(by).take(pa.array(some))
            sums = [pa.array(rows.sums[i, some].astype(np.int64) if i < 2 else rows.sums[i, some]) for i in range(4)]
            return pa.RecordBatch.from_arrays([*taken.columns, *sums], names=[*by, *SUMS.names])

        held, fresh = [], 0  # rows of a cell that isn't over yet, and those that came since
        for batch in batches:
            held.append(batch)
            fresh += batch.num_rows
            if fresh < HELD:
                continue
            batch = pa.concat_batches(held)
            rows = Rows(batch, exact)
            last, rest = int(rows.at[-2]), batch.slice(int(rows.at[-2]))
            if rows.left[-1]:  # all right rows of the last cell are here; its left ones go by as they come
                rest, last = rest.slice(0, int((~rows.left[last:]).sum())), batch.num_rows
            rows.work(last)
            yield result(rows, batch)
            held, fresh = [pa.concat_batches([rest])], 0
        if fresh:
            batch = pa.concat_batches(held)
            rows = Rows(batch, exact)
            rows.work(batch.num_rows)
            yield result(rows, batch)

    return run
