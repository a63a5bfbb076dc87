"""The domain's tables, derived from the given ones by integer arithmetic: once as DataFrames, once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

SOURCE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'osm' WHEN '2' THEN 'ms' WHEN '3' THEN 'google' WHEN '4' THEN 'ours2' ELSE '3dglobfp' END"
X1, Y1 = "(o_orderkey * 7919) % 4999", "(o_orderkey * 104729 + o_custkey * 31) % 4997"
FOOTPRINTS = ["o_orderkey AS fid", f"{SOURCE} AS source", f"{X1} AS x1", f"{Y1} AS y1", f"{X1} + 5 + o_orderkey % 23 AS x2", f"{Y1} + 5 + o_orderkey % 17 AS y2"]
#: The raster is 300 pixels wide and as high as the orders make it.
PIXELS = ["CAST(floor(o_orderkey / 300.0) AS BIGINT) AS row", "CAST(o_orderkey % 300 AS BIGINT) AS col", "(CAST(floor(o_orderkey / 300.0) AS BIGINT) * 31 + o_orderkey % 300 * 17) % 60 AS h", "(CAST(floor(o_orderkey / 300.0) AS BIGINT) * 13 + o_orderkey % 300 * 7) % 40 AS v"]
HOUSES = ["c_custkey AS fid", "(c_custkey * 7919) % 2950 AS x1", "(c_custkey * 104729) % 700 AS y1", "(c_custkey * 7919) % 2950 + 4 + c_custkey % 29 AS x2", "(c_custkey * 104729) % 700 + 4 + c_custkey % 31 AS y2"]
#: An order as a four-cornered ring that is no rectangle, and its edges.
KITE = [("x1", "y1"), ("x2", "y1 + fid % 5 / 2.0"), ("x2 - fid % 4", "y2 + fid % 3"), ("x1 + fid % 2", "y2")]
_KX, _KY = (", ".join(f"CAST({p[i]} AS DOUBLE)" for p in KITE) for i in (0, 1))
LABELS = ["CAST(vec_id AS BIGINT) AS id", "CAST(label AS BIGINT) AS gt", "CAST((label + vec_id % 3) % 10 AS BIGINT) AS pred"]
DETECTIONS = ["CAST(event_id AS BIGINT) AS det", "CAST(user_id AS BIGINT) AS image", "CAST(value AS DOUBLE) AS score", "CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS tp", "event_type AS category"]

SQL = {
    "footprints": f"SELECT {', '.join(FOOTPRINTS)} FROM orders",
    "kites": f"SELECT fid, source, pos, ax, ay, cx, cy, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS len FROM (SELECT fid, source, CAST(i AS BIGINT) AS pos, xs[i + 1] AS ax, ys[i + 1] AS ay, xs[(i + 1) % 4 + 1] AS cx, ys[(i + 1) % 4 + 1] AS cy FROM (SELECT fid, source, [{_KX}] AS xs, [{_KY}] AS ys FROM footprints), range(0, 4) AS t(i))",
    "districts": "SELECT CAST(n_nationkey AS VARCHAR) AS roi_id, n_name AS region, r_name AS continent, n_nationkey % 5 * 1000 AS rx1, CAST(floor(n_nationkey / 5.0) AS INT) * 1000 AS ry1, n_nationkey % 5 * 1000 + 1000 AS rx2, CAST(floor(n_nationkey / 5.0) AS INT) * 1000 + 1000 AS ry2 FROM nation JOIN region ON n_regionkey = r_regionkey",
    "cropped": "SELECT f.*, d.roi_id, d.region, d.continent FROM footprints f JOIN districts d ON f.x1 <= d.rx2 AND d.rx1 <= f.x2 AND f.y1 <= d.ry2 AND d.ry1 <= f.y2",
    "pairs": "SELECT a.roi_id, a.source, a.fid, b.fid AS main_fid, CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS shared FROM cropped a JOIN cropped b ON a.roi_id = b.roi_id AND a.source <> 'osm' AND b.source = 'osm' AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2",
    "quality": "SELECT c.roi_id, c.source, count(*) AS features, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area, count(m.overlap) AS matched, coalesce(sum(m.overlap), 0.0::DOUBLE) AS overlap, CAST(sum(CASE WHEN m.overlap IS NULL THEN (x2 - x1) * (y2 - y1) ELSE 0 END) AS DOUBLE) AS added, coalesce(sum(m.overlap), 0.0::DOUBLE) + CAST(sum(CASE WHEN m.overlap IS NULL THEN (x2 - x1) * (y2 - y1) ELSE 0 END) AS DOUBLE) AS quality FROM cropped c LEFT JOIN (SELECT roi_id, source, fid, sum(shared) AS overlap FROM pairs GROUP BY ALL) m ON c.roi_id = m.roi_id AND c.source = m.source AND c.fid = m.fid GROUP BY c.roi_id, c.source",
    "best": "SELECT roi_id, has_main, source AS best, metric FROM (SELECT q.roi_id, h.has_main, source, CASE WHEN h.has_main THEN quality ELSE area END AS metric, row_number() OVER (PARTITION BY q.roi_id ORDER BY CASE WHEN h.has_main THEN quality ELSE area END DESC, list_position(['ms', 'ours2', 'google'], source)) AS n FROM quality q JOIN (SELECT roi_id, bool_or(source = 'osm') AS has_main FROM quality GROUP BY 1) h USING (roi_id) WHERE source IN ('ms', 'ours2', 'google')) WHERE n = 1",
    "pixels": f"SELECT {', '.join(PIXELS)} FROM orders",
    "houses": f"SELECT {', '.join(HOUSES)} FROM customer",
    "zonal": "SELECT z.fid, z.row, z.col, coalesce(CAST(p.h AS DOUBLE), -1) AS h, coalesce(CAST(p.v AS DOUBLE), -1) AS v FROM (SELECT fid, r.row, c.col FROM houses, LATERAL unnest(range(CAST(floor(y1 / 10.0) AS BIGINT), CAST(ceil(y2 / 10.0) AS BIGINT))) AS r(row), LATERAL unnest(range(CAST(floor(x1 / 10.0) AS BIGINT), CAST(ceil(x2 / 10.0) AS BIGINT))) AS c(col)) z LEFT JOIN pixels p ON z.row = p.row AND z.col = p.col",
    "labels_px": f"SELECT {', '.join(LABELS)} FROM embeddings",
    "detections": f"SELECT {', '.join(DETECTIONS)} FROM events",
    "countries": "SELECT n_name AS country, r_name AS continent, count(DISTINCT c_custkey) AS pop, CAST(sum((5 + o_orderkey % 23) * (5 + o_orderkey % 17) * (1 + o_orderkey % 30)) AS BIGINT) AS vol, CAST(sum((5 + o_orderkey % 23) * (5 + o_orderkey % 17)) AS BIGINT) AS area, avg(o_totalprice) AS gdp FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}


def with_tables(sql: str, *names: str) -> str:
    """sql with the named derived tables before it, in the order of SQL."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in names) + "\n" + sql


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def footprints(self) -> DataFrame:
        """fid, source, x1, y1, x2, y2, lbox."""
        return self.orders.selectExpr(*FOOTPRINTS).withColumn("lbox", geo.box("x1", "y1", "x2", "y2"))

    def kites(self) -> DataFrame:
        """fid, source, ring_id, ring."""
        corners = [geo.point(F.expr(x), F.expr(y)) for x, y in KITE]
        return self.footprints().select("fid", "source", F.col("fid").alias("ring_id"), F.array(*corners, corners[0]).alias("ring"))

    def districts(self) -> DataFrame:
        rows = self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        x, y = F.col("n_nationkey") % 5 * 1000, F.floor(F.col("n_nationkey") / 5) * 1000
        return rows.select(F.col("n_nationkey").cast("string").alias("roi_id"), F.col("n_name").alias("region"), F.col("r_name").alias("continent"), geo.box(x, y, x + 1000, y + 1000).alias("rbox"))

    def pixels(self) -> DataFrame:
        return self.orders.selectExpr(*PIXELS)

    def houses(self) -> DataFrame:
        return self.customer.selectExpr(*HOUSES).withColumn("lbox", geo.box("x1", "y1", "x2", "y2"))

    def label_pixels(self) -> DataFrame:
        return self.embeddings.selectExpr(*LABELS)

    def detections(self) -> DataFrame:
        return self.events.selectExpr(*DETECTIONS)

    def countries(self) -> DataFrame:
        rows = self.customer.join(self.orders, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        area = (5 + F.col("o_orderkey") % 23) * (5 + F.col("o_orderkey") % 17)
        return rows.groupBy(F.col("n_name").alias("country"), F.col("r_name").alias("continent")).agg(F.countDistinct("c_custkey").alias("pop"), F.sum(area * (1 + F.col("o_orderkey") % 30)).alias("vol"), F.sum(area).alias("area"), F.avg("o_totalprice").alias("gdp"))
