"""Statistics, evaluation, rasters and sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import evaluation, outlines, raster, rings, sampling, stats
from ..streaming import intake
from .fixtures import Tables, with_tables
from .registry import query

R6 = lambda c, n=6: F.round(c, n)
COUNTRY = ("countries",)

# statistics -------------------------------------------------------------------------------------------------------


@query(with_tables("SELECT coalesce(continent, 'total') AS continent, CAST(sum(vol) AS BIGINT) AS vol, CAST(sum(pop) AS BIGINT) AS pop, round(sum(vol) / sum(pop), 6) AS ratio FROM countries GROUP BY ROLLUP (continent)", *COUNTRY))
def country_vpc_rollup(t: Tables) -> DataFrame:
    return stats.ratio_rollup(t.countries(), "continent", "vol", "pop").withColumn("ratio", R6(F.col("ratio")))


@query(with_tables("SELECT country, round(vol / area * (area + pop), 6) AS projected, CAST(round(vol / 1e6) AS BIGINT) || 'M' AS label FROM countries", *COUNTRY))
def projected_volume(t: Tables) -> DataFrame:
    """Volume carried over from the valid area to all of it, and a short label."""
    return t.countries().select("country", R6(F.col("vol") / F.col("area") * (F.col("area") + F.col("pop"))).alias("projected"), geo.magnitude("vol").alias("label"))


@query(with_tables("SELECT round(regr_slope(log10(vol), log10(gdp)), 6) AS slope, round(regr_intercept(log10(vol), log10(gdp)), 5) AS intercept, round(sqrt(regr_r2(log10(vol), log10(gdp))), 6) AS r, regr_count(vol, gdp)::BIGINT AS n FROM countries WHERE vol > 0 AND gdp > 0", *COUNTRY))
def loglog_ols(t: Tables) -> DataFrame:
    return stats.ols(stats.log_rows(t.countries(), "vol", "gdp"), "log_gdp", "log_vol").select(R6(F.col("slope")).alias("slope"), R6(F.col("intercept"), 5).alias("intercept"), R6(F.col("r")).alias("r"), "n")


@query("SELECT p.n_name AS country, round(sum(abs(f.a + f.b * log10(c_acctbal) - log10(o_totalprice))) / count(*), 6) AS error FROM (SELECT * FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND o_totalprice > 0) p JOIN (SELECT n_name, regr_slope(log10(o_totalprice), log10(c_acctbal)) AS b, regr_intercept(log10(o_totalprice), log10(c_acctbal)) AS a FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND o_totalprice > 0 GROUP BY 1) f ON p.n_name = f.n_name GROUP BY 1")
def grouped_ols_error(t: Tables) -> DataFrame:
    """A fit for each country, joined back: the mean error of its fitted values."""
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "country")
    logs = stats.log_rows(rows, "c_acctbal", "o_totalprice")
    fits = stats.ols(logs, "log_c_acctbal", "log_o_totalprice", "country")
    return stats.fitted(logs, fits, "log_c_acctbal", "country").groupBy("country").agg(R6(F.avg(F.abs(F.col("fitted") - F.col("log_o_totalprice")))).alias("error"))


@query("WITH r AS (SELECT l_returnflag AS flag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT flag, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_rho(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_discount")
    return stats.spearman(rows, "l_quantity", "l_discount", "flag").withColumn("rho", R6(F.col("rho")))


@query("WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 7) - 1) / 2.0 AS b, c_acctbal AS x, c_custkey % 7 AS y FROM customer) SELECT CAST(c_nationkey AS BIGINT) AS nation, round((corr(a, b) + corr(x, y)) / 2, 6) AS combined FROM r GROUP BY 1")
def combined_correlation(t: Tables) -> DataFrame:
    """The mean of Pearson's and Spearman's coefficient."""
    rows = t.customer.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 7).alias("y"))
    ranked = stats.ranks(stats.ranks(rows, "x", "a", "nation"), "y", "b", "nation")
    return ranked.groupBy("nation").agg(R6((F.corr("a", "b") + F.corr("x", "y")) / 2).alias("combined"))


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.005), 6) AS p005, round(quantile_cont(l_extendedprice, 0.98), 6) AS p98, round(quantile_cont(l_extendedprice, 0.995), 6) AS p995 FROM lineitem GROUP BY 1")
def price_percentiles(t: Tables) -> DataFrame:
    p = stats.percentiles(t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), "l_extendedprice", [0.005, 0.98, 0.995], "flag")
    return p.select("flag", *(R6(F.col("p")[i]).alias(n) for i, n in enumerate(("p005", "p98", "p995"))))


_AT = [min(1.0, (30 + 70 * (1 - (1 - i / 8) ** 2.5)) / 100) for i in range(9)]


@query(f"WITH e AS (SELECT list_distinct(quantile_cont(o_totalprice, {_AT})) AS raw FROM orders), s AS (SELECT list_sort(raw) AS edges FROM e) SELECT bin, count(*) AS n FROM (SELECT CAST(least(len(edges) - 2, len(list_filter(edges[2:], lambda x: x <= o_totalprice))) AS BIGINT) AS bin FROM orders, s) GROUP BY 1")
def quantile_bins(t: Tables) -> DataFrame:
    """Skew-equalised edges and the counts between them."""
    edges = stats.equalised_edges(t.orders, "o_totalprice", 8)
    return t.orders.select("o_totalprice").crossJoin(F.broadcast(edges)).groupBy(geo.bin_in("o_totalprice", F.col("edges")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT colour, count(*) AS n FROM (SELECT CASE WHEN v <= 0 THEN 'none' WHEN v < 2000 THEN 'low' WHEN v < 5000 THEN 'mid' ELSE 'high' END AS colour FROM (SELECT CASE WHEN c_acctbal > 0 THEN greatest(c_acctbal * 0.9, 50) ELSE c_acctbal END AS v FROM customer)) GROUP BY 1")
def value_colours(t: Tables) -> DataFrame:
    v = t.customer.select(raster.scaled_values("c_acctbal", 0.9, 50.0).alias("v"))
    return v.groupBy(raster.value_class("v", [0.0, 2000.0, 5000.0, 20000.0], "none", ["low", "mid", "high"]).alias("colour")).agg(F.count("*").alias("n"))


@query(with_tables("WITH p AS (SELECT country, log10(pop) AS x, log10(vol) AS y FROM countries), s AS (SELECT count(*)::DOUBLE AS n, var_samp(x) * pow(count(*), -1.0 / 3) AS a, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS b, var_samp(y) * pow(count(*), -1.0 / 3) AS c FROM p) SELECT p.country, round(sum(exp(-(c * (p.x - q.x)^2 - 2 * b * (p.x - q.x) * (p.y - q.y) + a * (p.y - q.y)^2) / (a * c - b * b) / 2)) / any_value(n * 2 * pi() * sqrt(a * c - b * b)), 2) AS density FROM p, p q, s GROUP BY 1", *COUNTRY).replace("\nWITH p AS", ", p AS"))
def point_density(t: Tables) -> DataFrame:
    p = t.countries().select("country", F.log10("pop").alias("x"), F.log10("vol").alias("y"))
    return stats.density(p, "x", "y", 0.0005).select("country", F.round("density", 2).alias("density"))


@query(with_tables("SELECT country, round(vol * 100.0 / (SELECT sum(vol) FROM countries), 6) AS share FROM countries", *COUNTRY))
def share_of_total(t: Tables) -> DataFrame:
    return stats.share_of_total(t.countries(), "vol").select("country", R6(F.col("share")).alias("share"))


@query("SELECT r_name AS continent, count(*) AS count, CAST(sum(5 + o_orderkey % 23) AS BIGINT) AS sum_area, CAST(sum((5 + o_orderkey % 23) * (1 + o_orderkey % 30)) AS BIGINT) AS sum_volume FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def continent_totals(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("continent")).agg(F.count("*").alias("count"), F.sum(5 + F.col("o_orderkey") % 23).alias("sum_area"), F.sum((5 + F.col("o_orderkey") % 23) * (1 + F.col("o_orderkey") % 30)).alias("sum_volume"))


SOURCES = ["osm", "ms", "google", "ours2", "3dglobfp"]


@query(with_tables("WITH s AS (SELECT CAST(floor(x1 / 500.0) AS BIGINT) AS strip, source, count(*) AS n FROM footprints WHERE NOT (source = 'ms' AND x1 < 1000) GROUP BY ALL), w AS (SELECT strip, " + ", ".join(f"coalesce(sum(n) FILTER (source = '{s}'), 0) AS \"{s}\"" for s in SOURCES) + " FROM s GROUP BY 1) SELECT strip, " + ", ".join(f'CAST("{s}" AS BIGINT) AS "{s}"' for s in SOURCES) + ", 0.0::DOUBLE AS osm_from, CAST(osm AS DOUBLE) AS ms_from, CAST(osm + ms AS DOUBLE) AS google_from, CAST(osm + ms + google AS DOUBLE) AS ours2_from, CAST(osm + ms + google + ours2 AS DOUBLE) AS \"3dglobfp_from\" FROM w", "footprints").replace("\nWITH s AS", ", s AS"))
def contribution_pivot(t: Tables) -> DataFrame:
    rows = t.footprints().where("NOT (source = 'ms' AND x1 < 1000)").select(F.floor(F.col("x1") / 500).alias("strip"), "source", F.lit(1).alias("one"))
    return stats.contribution(rows, "strip", "source", "one", SOURCES)


@query("WITH m AS (SELECT n_name AS product, r_name AS continent, CASE WHEN n_nationkey % 2 = 0 THEN 'rmse' ELSE 'iou' END AS metric, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = n_nationkey) END AS v FROM nation JOIN region ON n_regionkey = r_regionkey), b AS (SELECT *, min(v) OVER (PARTITION BY continent, metric) AS lo, max(v) OVER (PARTITION BY continent, metric) AS hi FROM m) SELECT product, metric, round(CASE WHEN hi > lo THEN 0.2 + 0.8 * CASE WHEN metric = 'rmse' THEN 1 - (coalesce(v, hi) - lo) / (hi - lo) ELSE (coalesce(v, lo) - lo) / (hi - lo) END ELSE 0.5 END, 6) AS scaled FROM b")
def minmax_radar(t: Tables) -> DataFrame:
    sums = t.customer.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    m = rows.select(F.col("n_name").alias("product"), F.col("r_name").alias("continent"), F.when(F.col("n_nationkey") % 2 == 0, "rmse").otherwise("iou").alias("metric"), F.when(F.col("n_nationkey") % 7 != 3, F.col("v")).alias("v"))
    return stats.min_max(m, "metric", "v", ["rmse"], ["continent"]).select("product", "metric", R6(F.col("scaled")).alias("scaled"))


@query("WITH e AS (SELECT r_name AS continent, CAST(l_quantity AS DOUBLE) AS g, CAST(l_quantity + l_linenumber - 4 AS DOUBLE) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT coalesce(continent, 'All') AS continent, count(*) AS n, round(sqrt(avg((p - g)^2)), 6) AS rmse, round(1 - sum((p - g)^2) / (sum(g * g) - sum(g) * sum(g) / count(*)), 6) AS r2 FROM e GROUP BY ROLLUP (continent)")
def error_metrics(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    e = rows.select(F.col("r_name").alias("continent"), F.col("l_quantity").cast("double").alias("g"), (F.col("l_quantity") + F.col("l_linenumber") - 4).cast("double").alias("p"))
    return stats.error_metrics(e, "continent", "g", "p").withColumn("rmse", R6(F.col("rmse"))).withColumn("r2", R6(F.col("r2")))


@query("SELECT CAST(l_linenumber AS BIGINT) AS line, round(avg(degrees(atan2(abs(x * v - y * u), x * u + y * v))), 6) AS error FROM (SELECT l_linenumber, l_partkey % 17 + 1.0 AS x, l_suppkey % 13 - 6.0 AS y, l_orderkey % 11 + 1.0 AS u, l_orderkey % 7 - 3.0 AS v FROM lineitem) GROUP BY 1")
def direction_error(t: Tables) -> DataFrame:
    u = [F.col("l_partkey") % 17 + 1.0, F.col("l_suppkey") % 13 - 6.0, F.col("l_orderkey") % 11 + 1.0, F.col("l_orderkey") % 7 - 3.0]
    return t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(R6(F.avg(evaluation.angle_error(*u))).alias("error"))


@query(with_tables("SELECT country, CAST(sum(vol) OVER w AS BIGINT) AS running, round(sum(vol) OVER w * 100.0 / sum(vol) OVER (), 6) AS pct, CAST(ceil(round(sum(vol) OVER w * 100.0 / sum(vol) OVER (), 9) / 20) - 1 AS BIGINT) AS fifth FROM countries WINDOW w AS (ORDER BY vol DESC, country ROWS UNBOUNDED PRECEDING)", *COUNTRY))
def cumulative_share_bins(t: Tables) -> DataFrame:
    out = stats.cumulative_share(t.countries(), "country", "vol")
    return out.select("country", "running", R6(F.col("pct")).alias("pct"), F.col("fifth").cast("long").alias("fifth"))


@query(with_tables("SELECT CASE WHEN n <= 20 THEN country ELSE 'Rest of World' END AS country, CAST(sum(vol) AS BIGINT) AS vol, least(min(n), 21) AS place FROM (SELECT *, row_number() OVER (ORDER BY vol DESC, country) AS n FROM countries) GROUP BY 1", *COUNTRY))
def volume_top20_rest(t: Tables) -> DataFrame:
    return stats.top_and_rest(t.countries(), "country", "vol", 20).withColumn("place", F.col("place").cast("long"))


@query(with_tables("(SELECT country, CAST(vol AS DOUBLE) AS vol, 0 AS part FROM countries ORDER BY vol DESC, country LIMIT 10) UNION ALL SELECT '---', NULL, 1 UNION ALL (SELECT country, CAST(vol AS DOUBLE), 2 FROM countries ORDER BY vol, country DESC LIMIT 10)", *COUNTRY))
def top_bottom10(t: Tables) -> DataFrame:
    return stats.top_and_bottom(t.countries().withColumn("vol", F.col("vol").cast("double")), "country", "vol", 10)


@query(with_tables("WITH p AS (SELECT fid, 2.0 * (x2 - x1 + y2 - y1) AS v FROM footprints), q AS (SELECT quantile_cont(v, 0.99) AS top FROM p), b AS (SELECT CAST(CASE WHEN v > top THEN 25 ELSE least(24, floor(v / top * 25)) END AS BIGINT) AS bin FROM p, q) SELECT bin, count(*) AS n, round(1.0 / (count(*) * (SELECT count(DISTINCT bin) FROM b)), 12) AS weight FROM b GROUP BY 1", "footprints").replace("\nWITH p AS", ", p AS"))
def perimeter_weights(t: Tables) -> DataFrame:
    """Histogram of perimeters and the inverse-frequency weight of each bin's members."""
    p = t.footprints().select("fid", (2.0 * (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1"))).alias("v"))
    w = stats.inverse_frequency(stats.histogram(p, "v"))
    return w.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.max("weight"), 12).alias("weight"))


# evaluation -------------------------------------------------------------------------------------------------------

_TOTALS = "SELECT region, class, sum(CAST(gt = class AND pred = class AS BIGINT)) AS i, sum(CAST(pred = class AS BIGINT)) AS p, sum(CAST(gt = class AS BIGINT)) AS g FROM (SELECT *, 'r' || (id % 3) AS region FROM labels_px WHERE id % 50 <> 0), unnest(range(0, 10)) AS c(class) GROUP BY ALL HAVING sum(CAST(pred = class OR gt = class AS BIGINT)) > 0"


def region_pixels(t: Tables) -> DataFrame:
    """Label pairs of three regions; every 50th is to be ignored."""
    return t.label_pixels().withColumn("gt", F.when(F.col("id") % 50 == 0, 255).otherwise(F.col("gt"))).withColumn("region", F.concat(F.lit("r"), F.col("id") % 3))


@query(with_tables(f"WITH t AS ({_TOTALS}), a AS (SELECT * FROM t UNION ALL SELECT 'all', class, sum(i), sum(p), sum(g) FROM t GROUP BY class) SELECT region, CAST(class AS BIGINT) AS class, CAST(i AS BIGINT) AS intersect, CAST(p AS BIGINT) AS pred_n, CAST(g AS BIGINT) AS gt_n, CAST(p + g - i AS BIGINT) AS \"union\", i / nullif(p + g - i, 0) AS iou, i / nullif(g, 0) AS acc, 2 * i / nullif(p + g, 0) AS dice, i / nullif(p, 0) AS precision, i / nullif(g, 0) AS recall, CASE WHEN i > 0 THEN 2 * (i / p) * (i / g) / (i / p + i / g) END AS fscore FROM a", "labels_px").replace("\nWITH t AS", ", t AS"))
def seg_class_metrics(t: Tables) -> DataFrame:
    m = evaluation.class_metrics(evaluation.class_totals(region_pixels(t), 10, 255, "region", all_name="all"))
    return m.withColumn("class", F.col("class").cast("long"))


@query(with_tables(f"WITH t AS ({_TOTALS}), a AS (SELECT * FROM t UNION ALL SELECT 'all', class, sum(i), sum(p), sum(g) FROM t GROUP BY class) SELECT region, round(sum(i) / sum(g) * 100, 2) AS a_acc, round(avg(i / nullif(p + g - i, 0)) * 100, 2) AS m_iou, round(avg(i / nullif(g, 0)) * 100, 2) AS m_acc, round(avg(2 * i / nullif(p + g, 0)) * 100, 2) AS m_dice, round(avg(CASE WHEN i > 0 THEN 2 * (i / p) * (i / g) / (i / p + i / g) END) * 100, 2) AS m_fscore FROM a GROUP BY region", "labels_px").replace("\nWITH t AS", ", t AS"))
def seg_metrics_by_region(t: Tables) -> DataFrame:
    m = evaluation.class_metrics(evaluation.class_totals(region_pixels(t), 10, 255, "region", all_name="all"))
    return evaluation.mean_metrics(m, "region")


@query(with_tables("SELECT gt, pred, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY gt), 6) AS pct FROM labels_px GROUP BY gt, pred", "labels_px"))
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluation.confusion(t.label_pixels()).withColumn("pct", R6(F.col("pct")))


@query(with_tables("SELECT CASE gt WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE 0 END AS mapped, CASE WHEN gt = 0 THEN 255 ELSE gt - 1 END AS shifted, count(*) AS n FROM labels_px GROUP BY ALL", "labels_px"))
def label_recoding(t: Tables) -> DataFrame:
    return t.label_pixels().groupBy(geo.recode("gt", {1: 7, 2: 7}, 0).cast("long").alias("mapped"), geo.reduce_zero_label("gt").alias("shifted")).agg(F.count("*").alias("n"))


@query(with_tables("SELECT id, CAST(list_sum(list_transform(range(0, 10), lambda i: CASE WHEN i = gt OR i = pred THEN 1 ELSE 0 END)) AS BIGINT) AS ones, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = gt OR i = pred THEN '1' ELSE '0' END), '') AS hot FROM labels_px", "labels_px"))
def multi_hot_labels(t: Tables) -> DataFrame:
    hot = geo.multi_hot(F.array("gt", "pred"), 10)
    return t.label_pixels().select("id", F.aggregate(hot, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


_CURVE = "WITH d AS (SELECT *, sum(tp) OVER w AS tps, row_number() OVER w AS n FROM detections WINDOW w AS (PARTITION BY image % 5 ORDER BY score DESC, image, det ROWS UNBOUNDED PRECEDING)), p AS (SELECT image % 5 AS grp, n, tps / (SELECT count(*) FROM detections x WHERE x.tp = 1 AND x.image % 5 = d.image % 5) AS recall, tps / n AS precision FROM d), e AS (SELECT *, max(precision) OVER (PARTITION BY grp ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM p)"


@query(with_tables(_CURVE + " SELECT grp, round(sum(coalesce((SELECT arg_min(envelope, n) FROM e WHERE e.grp = g.grp AND e.recall >= r / 100.0), 0)) / 101, 6) AS ap, round(max((SELECT max(recall) FROM e WHERE e.grp = g.grp)), 6) AS max_recall FROM (SELECT DISTINCT grp FROM e) g, unnest(range(0, 101)) AS t(r) GROUP BY grp", "detections").replace("\nWITH d AS", ", d AS"))
def average_precision(t: Tables) -> DataFrame:
    d = t.detections().withColumn("grp", F.col("image") % 5)
    positives = d.groupBy("grp").agg(F.sum("tp").alias("positives"))
    curve = evaluation.precision_curve(d.join(F.broadcast(positives), "grp"), F.col("positives"), "grp")
    return evaluation.average_precision(curve, "grp").select("grp", R6(F.col("ap")).alias("ap"), R6(F.col("max_recall")).alias("max_recall"))


@query(with_tables("SELECT image, category, det, score FROM (SELECT *, row_number() OVER (PARTITION BY image, category ORDER BY score DESC, det) AS n FROM detections) WHERE n <= 3", "detections"))
def top_detections(t: Tables) -> DataFrame:
    return evaluation.top_detections(t.detections(), 3).select("image", "category", "det", "score")


def _greedy(keys: str) -> str:
    """m (keys, det, pick): of g (keys, det, k: its place by score, c: its candidates, the best first) what each det takes, one after the other."""
    return f"""m AS (SELECT {keys}, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS det, NULL::STRUCT(truth BIGINT, crowd BOOLEAN, ignored BOOLEAN) AS pick, []::BIGINT[] AS used FROM (SELECT DISTINCT {keys} FROM g)
  UNION ALL SELECT {keys}, k, det, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.truth) END FROM (SELECT g.*, used, list_filter(c, lambda x: x.crowd OR NOT list_contains(used, x.truth))[1] AS pick FROM g JOIN (SELECT {keys}, k + 1 AS k, used FROM m) USING ({keys}, k)))"""


def _candidates(keys: str, pairs: str) -> str:
    return f"""g AS (SELECT {keys}, det, row_number() OVER (PARTITION BY {keys} ORDER BY max(score) DESC, det) AS k, list({{'truth': truth, 'crowd': crowd, 'ignored': ignored}} ORDER BY ignored, iou DESC, truth) AS c FROM ({pairs}) GROUP BY {keys}, det)"""


_IC = "image, category"


@query(with_tables(f"""SELECT image, category, det, pick.truth AS truth, pick.ignored AS ignored FROM m WHERE pick IS NOT NULL""", "detections").replace("WITH detections", "WITH RECURSIVE detections", 1).replace("\nSELECT", ", " + _candidates(_IC, "SELECT d.image, d.category, d.det, d.score, t.det AS truth, 1 / (1 + abs(d.score - t.score)) AS iou, t.det % 4 = 0 AS ignored, t.det % 10 = 0 AS crowd FROM detections d JOIN detections t ON d.image = t.image AND d.category = t.category WHERE d.det % 3 <> 0 AND t.det % 3 = 0 AND 1 / (1 + abs(d.score - t.score)) >= 0.5") + ", " + _greedy(_IC) + "\nSELECT", 1))
def greedy_matching(t: Tables) -> DataFrame:
    """Detections of each image and category matched to the next days' ones as truths."""
    d = t.detections()
    truths = d.where(F.col("det") % 3 == 0).select("image", "category", F.col("det").alias("truth"), F.col("score").alias("t_score"))
    pairs = d.where(F.col("det") % 3 != 0).join(truths, ["image", "category"]).withColumn("iou", 1 / (1 + F.abs(F.col("score") - F.col("t_score"))))
    return evaluation.greedy_matches(pairs.withColumn("ignored", F.col("truth") % 4 == 0).withColumn("crowd", F.col("truth") % 10 == 0), 0.5)


#: Boxes by picture: an order is a truth, and, moved a little, a detection.
_BOXED = ["CAST(floor(o_orderkey / 500.0) AS BIGINT) AS image", "o_orderkey AS id", "o_orderkey * 7919 % 200 AS x", "o_orderkey * 104729 % 200 AS y", "5 + o_orderkey % 23 AS w", "5 + o_orderkey % 17 AS h"]
_AREAS, _STEPS, _MOST_DETS = {"all": (0, 1e10), "large": (150, 1e10), "small": (0, 149)}, [0.5, 0.75], 20


def boxed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Detections and truths with boxes."""
    rows = t.orders.selectExpr(*_BOXED, "substr(o_orderpriority, 1, 1) AS category")
    at = lambda x, y: geo.box(x, y, x + F.col("w"), y + F.col("h"))
    dets = rows.where("id % 7 <> 0").select("image", "category", F.col("id").alias("det"), (F.col("id") * 37 % 100 / 100).alias("score"), at(F.col("x") + F.col("id") % 4, F.col("y") + F.col("id") % 3).alias("lbox"))
    truths = rows.where("id % 5 <> 0").select("image", "category", F.col("id").alias("truth"), (F.col("id") % 31 == 0).alias("crowd"), (F.col("id") % 29 == 0).alias("ignored"), at(F.col("x"), F.col("y")).alias("rbox"))
    return dets, truths


_K4 = "image, category, area_range, threshold"
_COCO = f"""WITH RECURSIVE o AS (SELECT {", ".join(_BOXED)}, substr(o_orderpriority, 1, 1) AS category FROM orders),
d AS (SELECT * FROM (SELECT image, category, id AS det, id * 37 % 100 / 100.0 AS score, x + id % 4 AS x1, y + id % 3 AS y1, w, h, row_number() OVER (PARTITION BY image, category ORDER BY id * 37 % 100 DESC, id) AS place FROM o WHERE id % 7 <> 0) WHERE place <= {_MOST_DETS}),
t AS (SELECT image, category, id AS truth, x AS x1, y AS y1, w, h, id % 31 = 0 AS crowd, id % 29 = 0 AS ignored FROM o WHERE id % 5 <> 0),
a AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {x}, {y})" for n, (x, y) in _AREAS.items())}) AS v(area_range, low, high)), s AS (SELECT unnest({_STEPS}::DOUBLE[]) AS threshold),
p AS (SELECT d.image, d.category, det, score, truth, crowd, ignored, t.w * t.h AS t_area, greatest(0, least(d.x1 + d.w, t.x1 + t.w) - greatest(d.x1, t.x1)) * greatest(0, least(d.y1 + d.h, t.y1 + t.h) - greatest(d.y1, t.y1)) AS i, d.w * d.h AS d_area FROM d JOIN t ON d.image = t.image AND d.category = t.category),
q AS (SELECT image, category, area_range, threshold, det, score, truth, crowd, ignored OR crowd OR t_area NOT BETWEEN low AND high AS ignored, CASE WHEN crowd THEN i / d_area ELSE i / (d_area + t_area - i) END AS iou FROM p, a, s),
{_candidates(_K4, "SELECT * FROM q WHERE iou >= threshold")}, {_greedy(_K4)},
r AS (SELECT d.image, d.category, d.det, d.score, area_range, threshold, coalesce(CAST(pick IS NOT NULL AS INT), 0) AS tp, CASE WHEN pick IS NOT NULL THEN pick.ignored ELSE w * h NOT BETWEEN low AND high END AS out FROM d CROSS JOIN a CROSS JOIN s LEFT JOIN m USING (image, category, det, area_range, threshold)),
f AS (SELECT category, area_range, count(*) AS positives FROM t, a WHERE NOT (ignored OR crowd OR w * h NOT BETWEEN low AND high) GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER v / positives AS recall, row_number() OVER v AS n, sum(tp) OVER v / row_number() OVER v AS prec FROM r JOIN f USING (category, area_range) WHERE NOT out WINDOW v AS (PARTITION BY category, area_range, threshold ORDER BY score DESC, image, det ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(prec) OVER (PARTITION BY category, area_range, threshold ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM c),
l AS (SELECT category, area_range, threshold, r, arg_min(envelope, n) AS y FROM e, unnest(range(0, 101)) AS x(r) WHERE recall >= r / 100.0 GROUP BY ALL)
SELECT category, area_range, threshold, round(coalesce((SELECT sum(y) FROM l WHERE l.category = f.category AND l.area_range = f.area_range AND l.threshold = s.threshold), 0) / 101, 6) AS ap, round(coalesce((SELECT max(recall) FROM e WHERE e.category = f.category AND e.area_range = f.area_range AND e.threshold = s.threshold), 0), 6) AS max_recall FROM f, s"""


@query(_COCO)
def coco_average_precision(t: Tables) -> DataFrame:
    """From boxes to average precision: pairs, greedy matches, curve; by category, area range and IoU threshold, at most 20 detections a picture."""
    out = evaluation.mean_average_precision(*boxed(t), 32.0, _STEPS, _AREAS, _MOST_DETS)
    return out.select("category", "area_range", "threshold", R6(F.col("ap")).alias("ap"), R6(F.col("max_recall")).alias("max_recall"))


@query(with_tables("SELECT h.fid AS pred, arg_min(f.fid, f.fid) AS truth FROM houses h JOIN footprints f ON f.x1 <= h.x2 AND h.x1 <= f.x2 AND f.y1 <= h.y2 AND h.y1 <= f.y2 WHERE (least(f.x2, h.x2) - greatest(f.x1, h.x1)) * (least(f.y2, h.y2) - greatest(f.y1, h.y1)) / ((h.x2 - h.x1) * (h.y2 - h.y1)) > 0.3 GROUP BY 1", "footprints", "houses"))
def first_fitting_truth(t: Tables) -> DataFrame:
    right = t.footprints().select(F.col("fid").alias("truth"), F.col("fid").alias("truth_order"), F.col("lbox").alias("rbox"))
    preds = t.houses().select(F.col("fid").alias("pred"), "lbox")
    return evaluation.first_fits(preds, right, 64.0, 0.3, geo.shared_area(F.col("lbox"), F.col("rbox")), geo.box_area(F.col("lbox")))


@query("SELECT l_returnflag AS flag, round(avg(q / 51 * (1 - abs(l - m) / (l + m))), 6) AS c_iou FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, l_linenumber + 3 AS l, l_partkey % 9 + 3.0 AS m FROM lineitem) GROUP BY 1")
def complexity_iou(t: Tables) -> DataFrame:
    c = evaluation.complexity_iou(F.col("l_quantity").cast("double") / 51, F.col("l_linenumber") + 3, F.col("l_partkey") % 9 + 3.0)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(R6(F.avg(c)).alias("c_iou"))


# rasters ----------------------------------------------------------------------------------------------------------


def images(t: Tables) -> DataFrame:
    """A part as an image: 100 to 349 pixels high, 120 to 319 wide."""
    return t.part.select(F.col("p_partkey").alias("image"), (100 + F.col("p_partkey") % 250).cast("int").alias("height"), (120 + F.col("p_partkey") % 200).cast("int").alias("width"))


_IMAGES = "SELECT p_partkey AS image, 100 + p_partkey % 250 AS height, 120 + p_partkey % 200 AS width FROM part"


@query(f"SELECT image, count(*) AS wins, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM (SELECT image, least(a.s, height - 96) AS y, least(b.s, width - 96) AS x FROM ({_IMAGES}), LATERAL unnest(range(0, height, 32)) AS a(s), LATERAL unnest(range(0, width, 32)) AS b(s)) GROUP BY 1")
def sliding_windows(t: Tables) -> DataFrame:
    return raster.windows(images(t), 96, 32).groupBy("image").agg(F.count("*").alias("wins"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query(f"SELECT image, count(*) AS boxes, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM (SELECT image, greatest(0, least(i * 48, height - 64)) AS y, greatest(0, least(j * 48, width - 64)) AS x FROM ({_IMAGES}), LATERAL unnest(range(0, CAST(greatest(0, ceil((height - 64) / 48.0)) AS BIGINT) + 1)) AS a(i), LATERAL unnest(range(0, CAST(greatest(0, ceil((width - 64) / 48.0)) AS BIGINT) + 1)) AS b(j)) GROUP BY 1")
def crop_boxes(t: Tables) -> DataFrame:
    return raster.crop_boxes(images(t), 64, 48).groupBy("image").agg(F.count("*").alias("boxes"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query(f"SELECT image, CAST(ceil(height / 90.0) * ceil(width / 90.0) AS BIGINT) AS patches, CAST(height * width AS BIGINT) AS pixels FROM ({_IMAGES})")
def even_patches(t: Tables) -> DataFrame:
    return raster.patches(images(t), 90).groupBy("image").agg(F.count("*").alias("patches"), F.sum(F.col("h").cast("long") * F.col("w")).alias("pixels"))


_SCORES = "SELECT a.w * 1 AS win, b.r AS row, p.col, (p.h * 7 + a.w * 3) % 23 AS score FROM pixels p, LATERAL unnest(range(greatest(0, CAST(ceil((p.col - 63) / 32.0) AS BIGINT)), CAST(floor(p.col / 32.0) AS BIGINT) + 1)) AS a(w), LATERAL (SELECT p.row AS r) b"


@query(with_tables(f"SELECT row, col, count(*) AS n, round(avg(score), 6) AS mean, round(avg(score * score) - avg(score) * avg(score), 6) AS var FROM ({_SCORES}) GROUP BY row, col", "pixels"))
def window_mean_var(t: Tables) -> DataFrame:
    """Scores of windows of 64 columns, 32 apart, put together pixel by pixel."""
    p = t.pixels()
    wins = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("col") - 63) / 32)), F.floor(F.col("col") / 32))
    scores = p.withColumn("win", F.explode(wins)).select("win", "row", "col", ((F.col("h") * 7 + F.col("win") * 3) % 23).alias("score"))
    return raster.overlap_stats(scores).select("row", "col", "n", R6(F.col("mean")).alias("mean"), R6(F.col("var")).alias("var"))


@query(with_tables("SELECT row, col, n, mean, var FROM (SELECT row, col, CASE WHEN col % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN col % 3 = 0 THEN -1.0 ELSE h END AS mean, CASE WHEN col % 3 = 0 THEN -2.0 ELSE 0.0 END AS var FROM pixels)", "pixels"))
def uncovered_pixels(t: Tables) -> DataFrame:
    scores = t.pixels().where("col % 3 <> 0").select("row", "col", F.col("h").alias("score"))
    return raster.exported_stats(raster.overlap_stats(scores, t.pixels()))


@query(with_tables("SELECT row, col, round(sum(w * v) / sum(w), 6) AS score FROM (SELECT row, col, h + win AS v, 0.5 + 0.5 * least(row % 16, 15 - row % 16, col - win * 16, 31 - (col - win * 16)) / 7 AS w FROM (SELECT *, unnest([CAST(floor(col / 16.0) AS BIGINT) - 1, CAST(floor(col / 16.0) AS BIGINT)]) AS win FROM pixels) WHERE win >= 0) GROUP BY ALL", "pixels"))
def blended_patches(t: Tables) -> DataFrame:
    """Two overlapping patches for each pixel, weighted from middle to border."""
    at = F.floor(F.col("col") / 16)
    rows = t.pixels().withColumn("win", F.explode(F.array(at - 1, at))).where("win >= 0").withColumn("px", F.col("col") - F.col("win") * 16).withColumn("py", F.col("row") % 16).withColumn("score", F.col("h") + F.col("win"))
    w = 0.5 + 0.5 * F.least(F.col("py"), 15 - F.col("py"), F.col("px"), 31 - F.col("px")) / 7
    return rows.groupBy("row", "col").agg(R6(F.sum(w * F.col("score")) / F.sum(w)).alias("score"))


def _blocks(value: str) -> str:
    edge = lambda at, extent, out: f"CAST(floor({at} * {extent} / {out}.0) AS BIGINT)"
    return with_tables(f"""SELECT CAST(i AS BIGINT) AS row, CAST(j AS BIGINT) AS col, coalesce(CAST({value} AS DOUBLE), -1) AS value FROM (SELECT row, col, h - 20 AS v FROM pixels),
(SELECT i, {edge("i", "n", 7)} AS r0, {edge("(i + 1)", "n", 7)} AS r1 FROM range(0, 7) AS r(i), (SELECT max(row) + 1 AS n FROM pixels)) a, (SELECT j, {edge("j", 300, 11)} AS c0, {edge("(j + 1)", 300, 11)} AS c1 FROM range(0, 11) AS c(j)) b
WHERE row >= r0 AND row < r1 AND col >= c0 AND col < c1 GROUP BY i, j""", "pixels")


def _whole_blocks(t: Tables, how: str) -> DataFrame:
    p = t.pixels().select("row", "col", (F.col("h") - 20).alias("value"))
    return raster.downsample(p, max(raster.height_of(p), 1), 300, 7, 11, how)


@query(_blocks("max(v) FILTER (v > 0)"))
def whole_resample_max(t: Tables) -> DataFrame:
    """Seven by eleven blocks of the raster, as high as it is."""
    return _whole_blocks(t, "max")


@query(_blocks("sum(v) FILTER (v > 0)"))
def whole_resample_positive_sum(t: Tables) -> DataFrame:
    return _whole_blocks(t, "sum")


@query(_blocks("round(avg(v) FILTER (v > 0), 6)"))
def whole_resample_positive_avg(t: Tables) -> DataFrame:
    return _whole_blocks(t, "mean").withColumn("value", R6(F.col("value")))


@query(with_tables("SELECT row, col, arg_min(value, k) AS value FROM (SELECT row, col, k, CASE WHEN (row + col * k) % 3 = 0 THEN -1 ELSE h + k END AS value FROM pixels, range(1, 4) AS f(k)) WHERE value <> -1 AND row >= 5 AND row < 40 AND col >= 10 AND col < 250 GROUP BY ALL", "pixels"))
def mosaic(t: Tables) -> DataFrame:
    files = t.pixels().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = files.select("row", "col", F.col("k").alias("file_order"), F.when((F.col("row") + F.col("col") * F.col("k")) % 3 == 0, -1).otherwise(F.col("h") + F.col("k")).alias("value"))
    return raster.mosaic(rows, -1, (5, 40, 10, 250))


@query(with_tables("SELECT band, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(['h', 'v']) AS band, unnest([h, v]) AS v FROM pixels) GROUP BY 1", "pixels"))
def band_stats(t: Tables) -> DataFrame:
    bands = t.pixels().select(F.explode(F.create_map(F.lit("h"), "h", F.lit("v"), "v")).alias("band", "value"))
    return raster.band_stats(bands).select("band", "n", R6(F.col("mean")).alias("mean"), R6(F.col("std")).alias("std"))


@query(with_tables("WITH b AS (SELECT row AS image, unnest(['h', 'v']) AS band, unnest([CASE WHEN row % 10 = 4 THEN 0 ELSE h END, v]) AS v FROM pixels), s AS (SELECT band, avg(v) AS m, stddev_pop(v) AS sd FROM b GROUP BY 1) SELECT image, b.band, round(avg((v - m) / sd), 6) AS mean, round(avg(greatest(0, least(255, (v - (m - 2 * sd)) / (4 * sd) * 255))), 6) AS stretched FROM b JOIN s ON b.band = s.band WHERE image % 10 <> 4 GROUP BY ALL", "pixels").replace("\nWITH b AS", ", b AS"))
def normalised_bands(t: Tables) -> DataFrame:
    p = t.pixels().withColumn("h", F.when(F.col("row") % 10 == 4, 0).otherwise(F.col("h")))
    bands = p.select(F.col("row").alias("image"), F.explode(F.create_map(F.lit("h"), "h", F.lit("v"), "v")).alias("band", "value"))
    s = raster.band_stats(bands)
    scaled = bands.join(F.broadcast(s), "band").groupBy("image", "band").agg(R6(F.avg(raster.stretched("value", "mean", "std"))).alias("stretched"))
    return raster.normalised(bands, s).groupBy("image", "band").agg(R6(F.avg("value")).alias("mean")).join(scaled, ["image", "band"])


@query(with_tables("SELECT row, col, CAST(h AS DOUBLE) AS value FROM pixels WHERE row BETWEEN 7 AND 27 AND col BETWEEN 30 AND 92", "pixels"))
def window_read(t: Tables) -> DataFrame:
    """Pixels as blocks of 16 by 16, of which a window's are read."""
    blocks = raster.to_blocks(t.pixels().select("row", "col", F.col("h").alias("value")), 16, -1.0)
    return raster.read_window(blocks, 7, 30, 21, 63).where("value <> -1").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


@query(with_tables("SELECT row, col, max(fid % 60) AS value FROM houses, LATERAL unnest(range(CAST(floor(y1 / 10.0) AS BIGINT), CAST(ceil(y2 / 10.0) AS BIGINT))) AS r(row), LATERAL unnest(range(CAST(floor(x1 / 10.0) AS BIGINT), CAST(ceil(x2 / 10.0) AS BIGINT))) AS c(col) GROUP BY ALL", "houses"))
def rasterised_houses(t: Tables) -> DataFrame:
    return raster.rasterised(t.houses().withColumn("value", F.col("fid") % 60), "value", 10.0)


@query(with_tables("WITH l AS (SELECT row, col, CAST(floor(row / 7.0) AS BIGINT) * 100 + CAST(floor(col / 9.0) AS BIGINT) AS label FROM pixels) SELECT a.row, a.col, a.label FROM l a JOIN l b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.label = b.label GROUP BY ALL HAVING count(*) = 9", "pixels").replace("\nWITH l AS", ", l AS"))
def eroded_labels(t: Tables) -> DataFrame:
    l = t.pixels().select("row", "col", (F.floor(F.col("row") / 7) * 100 + F.floor(F.col("col") / 9)).alias("label"))
    return raster.eroded(l, 3)


@query(with_tables("SELECT CAST(min(col) AS DOUBLE) AS x1, CAST(min(row) AS DOUBLE) AS y1, CAST(max(col) + 1 AS DOUBLE) AS x2, CAST(max(row) + 1 AS DOUBLE) AS y2, CAST(count(*) AS DOUBLE) AS area, CAST(any_value((CAST(floor(row / 7.0) AS BIGINT) + CAST(floor(col / 9.0) AS BIGINT)) % 2) AS DOUBLE) AS value FROM pixels GROUP BY CAST(floor(row / 7.0) AS BIGINT), CAST(floor(col / 9.0) AS BIGINT)", "pixels"))
def mask_polygons(t: Tables) -> DataFrame:
    """A chequered mask as components (across blocks) and polygons: each one's box, area and value."""
    mask = t.pixels().select("row", "col", ((F.floor(F.col("row") / 7) + F.floor(F.col("col") / 9)) % 2).alias("value"))
    shapes = outlines.polygons(raster.components(mask, 64))
    b = geo.bounds(F.col("rings"))
    return shapes.select(*(b[c].alias(c) for c in ("x1", "y1", "x2", "y2")), geo.polygon_area(F.col("rings")).alias("area"), "value")


@query(with_tables("""SELECT row, col, arg_min(near, (d, r, near)) FILTER (near IS NOT NULL) AS near FROM (SELECT p.row, p.col, a * a + b * b AS d, q.row AS r, q.col AS near
FROM pixels p JOIN (SELECT a, b FROM range(-2, 3) AS x(a), range(-2, 3) AS y(b) WHERE a * a + b * b <= 4) ON p.col % 4 <> 0 LEFT JOIN pixels q ON q.row = p.row + a AND q.col = p.col + b AND q.col % 4 = 0) GROUP BY row, col""", "pixels"))
def whole_label_fill(t: Tables) -> DataFrame:
    """Unlabelled pixels take the nearest labelled one no more than two away, the first by place of those as near."""
    p = t.pixels()
    near = raster.nearest_fill(p.where("col % 4 <> 0"), p.where("col % 4 = 0").select("row", "col", F.col("col").alias("label")), 2)
    return near.select("row", "col", F.col("label").alias("near"))


@query("SELECT c_custkey AS id, g.row * 1000 + g.col AS value FROM (SELECT c_custkey, 8.03 + c_custkey % 240 / 10.0 AS lon, 28.03 + c_custkey % 230 / 10.0 AS lat FROM customer) p LEFT JOIN (SELECT DISTINCT o_orderkey % 40 AS row, CAST(floor(o_orderkey / 40.0) AS BIGINT) % 40 AS col FROM orders) g ON g.row = CAST(floor((50 - lat) / 0.5) AS BIGINT) AND g.col = CAST(floor((lon - 10) / 0.5) AS BIGINT)")
def mercator_reprojection(t: Tables) -> DataFrame:
    """Points of the Mercator plane with the pixel that they find in a geographic raster, 40 by 40 half degrees, told by its value."""
    grid = t.orders.select((F.col("o_orderkey") % 40).alias("row"), (F.floor(F.col("o_orderkey") / 40) % 40).alias("col")).distinct().withColumn("value", F.col("row") * 1000 + F.col("col"))
    points = t.customer.select(F.col("c_custkey").alias("id"), (F.lit(8.03) + F.col("c_custkey") % 240 / 10).alias("lon"), (F.lit(28.03) + F.col("c_custkey") % 230 / 10).alias("lat")).select("id", geo.mercator_x("lon").alias("tx"), geo.mercator_y("lat").alias("ty"))
    return raster.reproject_to_mercator(points, grid, 10.0, 50.0, 0.5).select("id", "value")


@query("SELECT min(p_partkey) AS cluster, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY p_size")
def size_clusters(t: Tables) -> DataFrame:
    """Parts clustered by equal size (a chain of the next keys of the same size): each size is one cluster."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    p = t.part.select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b")).where("b is not null")
    both = p.union(p.select("b", "a"))
    out = rings.clusters(both, t.part.select(F.col("p_partkey").alias("node")), 2)
    return out.groupBy(F.coalesce("cluster", "node").alias("cluster")).agg(F.count("*").alias("n"), F.sum("node").alias("keys"))


# sample tables ----------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, l.quality, d.source FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def key_join_samples(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").join(t.labels, "doc_id").select("doc_id", "quality", "source")


@query("SELECT branch, count(*) AS n FROM (SELECT CASE WHEN contains(url, '/en/') THEN 'train' WHEN contains(url, '/fr/') THEN 'val' WHEN contains(url, '/de/') THEN 'test' END AS branch FROM pages) WHERE branch IS NOT NULL GROUP BY 1")
def demultiplexed_pages(t: Tables) -> DataFrame:
    parts = sampling.demultiplexed(t.pages, {"train": F.col("url").contains("/en/"), "val": F.col("url").contains("/fr/"), "test": F.col("url").contains("/de/")})
    out = [df.select(F.lit(k).alias("branch")) for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2]).groupBy("branch").agg(F.count("*").alias("n"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem, regexp_extract(string_split(url, '/')[-1], '(\\.[^.]*)$', 1) AS suffix, string_split(url, '/')[-2] AS parent FROM pages")
def path_columns(t: Tables) -> DataFrame:
    p = geo.path_parts("url")
    return t.pages.select("page_id", p["name"].alias("name"), p["stem"].alias("stem"), p["suffix"].alias("suffix"), p["parent"].alias("parent"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def split_filter(t: Tables) -> DataFrame:
    """Documents on the split's list that aren't on the ignore list."""
    keep = t.labels.where("toxic = 0").select("doc_id")
    return t.documents.select("doc_id", "source").join(keep, "doc_id", "left_semi").join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT source FROM documents GROUP BY source HAVING bool_or(lang = 'de') AND bool_or(lang = 'fr') AND bool_or(lang = 'es')")
def in_every_source(t: Tables) -> DataFrame:
    return sampling.in_every([t.documents.where(F.col("lang") == c) for c in ("de", "fr", "es")], "source")


@query("SELECT count(*) AS n, CAST(sum(c_custkey - p_partkey) AS BIGINT) AS diff FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS k FROM part) USING (k)")
def zipped_rows(t: Tables) -> DataFrame:
    left, right = t.customer.select("c_custkey"), t.part.select("p_partkey", (-F.col("p_partkey")).alias("o"))
    return sampling.zipped(left, right, "c_custkey", "o").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey") - F.col("p_partkey")).alias("diff"))


@query("SELECT l_partkey AS img, l_suppkey AS seg, round(sum(l_extendedprice), 2) AS loss FROM lineitem GROUP BY ALL ORDER BY loss DESC, img, seg LIMIT 100")
def worst_n(t: Tables) -> DataFrame:
    losses = t.lineitem.groupBy(F.col("l_partkey").alias("img"), F.col("l_suppkey").alias("seg")).agg(F.round(F.sum("l_extendedprice"), 2).alias("loss"))
    return losses.orderBy(F.desc("loss"), "img", "seg").limit(100)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
def first_n(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id").orderBy("event_id").limit(1000)


_U = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_U.format(seed=3, key='doc_id')}, doc_id) AS n FROM documents) WHERE n <= 20")
def stratified_cap(t: Tables) -> DataFrame:
    return sampling.capped(t.documents.select("doc_id", "source"), "source", "doc_id", 20, seed=3)


@query(f"WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY {_U.format(seed=5, key="c_custkey || ':' || 2")}, c_custkey) - 1 AS i FROM customer), n AS (SELECT count(*) AS n FROM s), p AS (SELECT c_custkey, i FROM s UNION ALL SELECT c_custkey, i + n FROM s, n WHERE i < (-n % 7 + 7) % 7) SELECT c_custkey, i AS place, i % 7 AS shard FROM p")
def shuffled_shards(t: Tables) -> DataFrame:
    """A seeded epoch's order dealt to seven equal shards."""
    rows = t.customer.select("c_custkey", sampling.hashed("c_custkey", F.lit(2), seed=5).alias("u"))
    return sampling.shards(rows, 7, "u", "c_custkey").select("c_custkey", "place", F.col("shard").cast("long").alias("shard"))


@query(f"SELECT p_partkey FROM part ORDER BY -ln(1 - {_U.format(seed=9, key='p_partkey')}) / p_size, p_partkey LIMIT 50")
def weighted_draw(t: Tables) -> DataFrame:
    return sampling.weighted_sample(t.part, "p_size", "p_partkey", 50, seed=9).select("p_partkey")


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS \"group\" FROM orders")
def ntile_split(t: Tables) -> DataFrame:
    return sampling.even_groups(t.orders.select("o_orderkey"), 7, "o_orderkey").select("o_orderkey", F.col("group").cast("long").alias("group"))


_STATUS = "SELECT user_id AS tile, arg_max(event_type, event_id) AS state FROM events GROUP BY 1"


@query(f"SELECT c_custkey AS tile FROM customer WHERE c_custkey NOT IN (SELECT tile FROM ({_STATUS}) WHERE state IN ('purchase', 'click', 'view'))")
def status_antijoin(t: Tables) -> DataFrame:
    """Tiles whose latest row in an append-only status table isn't finished, started or failed."""
    state = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "failed").otherwise("open")
    status = t.events.select(F.col("user_id").alias("tile"), state.alias("state"), F.col("event_id").alias("at"))
    return sampling.open_work(t.customer.select(F.col("c_custkey").alias("tile")), status, "tile")


@query("SELECT count(*) AS tiles, count(*) FILTER (p) AS processed, count(*) FILTER (q) AS predicted, count(*) FILTER (p AND NOT q) AS waiting FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS p, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS q FROM customer)")
def work_inventory(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_custkey").alias("tile"), "o_orderstatus")
    return intake.inventory(intake.work_list(t.customer.select(F.col("c_custkey").alias("tile")), done, done.where("o_orderstatus = 'F'"), "tile"))


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND doc_id % 40 = 0) GROUP BY 1")
def regions_removed(t: Tables) -> DataFrame:
    gone = t.documents.where("lang = 'es' AND doc_id % 40 = 0").select("source").distinct()
    kept = t.documents.select("source").distinct().join(gone, "source", "left_anti")
    return intake.without_regions(t.documents, kept, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def counts_by_level(t: Tables) -> DataFrame:
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("n")).fillna("all", ["lang", "source"])


@query("SELECT dataset, count(*) AS n, count(DISTINCT k) AS kinds FROM (SELECT 'a' AS dataset, c_custkey AS k FROM customer UNION ALL SELECT 'b', p_partkey FROM part) GROUP BY 1")
def concatenated_sets(t: Tables) -> DataFrame:
    both = t.customer.select(F.lit("a").alias("dataset"), F.col("c_custkey").alias("k")).unionByName(t.part.select(F.lit("b").alias("dataset"), F.col("p_partkey").alias("k")))
    return both.groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT user_id FROM events")
def id_sets(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_custkey")).subtract(t.events.select("user_id"))


@query("SELECT n_name AS country, coalesce(sum(s_acctbal), 0) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def joined_with_default(t: Tables) -> DataFrame:
    sums = t.supplier.where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("balance"))
    return t.nation.join(sums, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("country"), F.coalesce("balance", F.lit(0.0)).alias("balance"))
