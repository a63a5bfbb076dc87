"""Every form that is read or written: a derived table is written in it to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster, sampling
from ..sources import files, geojson, store
from ..sources.catalog import Catalog
from ..sources.shared import through_folder
from ..streaming import intake
from .fixtures import Tables, with_tables
from .registry import query

R6 = lambda c: F.round(c, 6)

#: An order's L-shape has the box without its upper right quarter; every third has a second part, a square to its right.
_L = "(x2 - x1) * (y2 - y1) * 0.75"


def multi(t: Tables) -> DataFrame:
    """id, source, region, height (null for some), geom of one or two parts."""
    b, p = F.col("lbox"), geo.point
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    shape = F.array(p(b["x1"], b["y1"]), p(b["x2"], b["y1"]), p(b["x2"], my), p(mx, my), p(mx, b["y2"]), p(b["x1"], b["y2"]), p(b["x1"], b["y1"]))
    second = geo.ring_of_box(geo.box(b["x2"] + 1, b["y1"], b["x2"] + 3, b["y1"] + 2))
    geom = F.when(F.col("fid") % 3 == 0, F.array(F.array(shape), F.array(second))).otherwise(F.array(F.array(shape)))
    return t.footprints().select(F.col("fid").cast("string").alias("id"), "source", F.concat(F.lit("r"), F.col("fid") % 4).alias("region"), F.when(F.col("fid") % 5 != 0, (F.col("fid") % 40).cast("double")).alias("height"), geom.alias("geom"), F.floor(F.col("fid") / 1000).alias("tile"))


def geom_area() -> F.Column:
    return F.aggregate(F.transform("geom", geo.polygon_area), F.lit(0.0), lambda a, x: a + x)


_MULTI = f"SELECT source, count(*) AS features, round(sum({_L} + CASE WHEN fid % 3 = 0 THEN 4 ELSE 0 END), 6) AS area, CAST(sum(CASE WHEN fid % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS parts FROM footprints"


@query(with_tables(_MULTI + " GROUP BY source", "footprints"))
def geojson_collections(t: Tables) -> DataFrame:
    """FeatureCollections, one file for each thousand keys."""

    def job(folder: str) -> DataFrame:
        tiled = geojson.to_features(multi(t), "id", "source", "region", "height", keep=("tile",))
        whole = tiled.groupBy("tile").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": [\n'), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]}")).alias("value"))
        files.write_files(whole.select(F.concat("tile", F.lit(".geojson")).alias("name"), F.encode("value", "UTF-8").alias("data")), folder)
        got = geojson.read_collection(t.spark, folder)
        return got.groupBy("source").agg(F.count("*").alias("features"), R6(F.sum(geom_area())).alias("area"), F.sum(F.size("geom").cast("long")).alias("parts"))

    return through_folder(t.spark, job)


@query(with_tables(_MULTI + " WHERE source <> 'ms' GROUP BY source", "footprints"))
def geojson_lines(t: Tables) -> DataFrame:
    """One feature a line, with header lines and trailing commas; one source's lines are left out."""

    def job(folder: str) -> DataFrame:
        lines = geojson.to_features(multi(t), "id", "source", "region", "height").select(F.concat("value", F.lit(",")).alias("value"))
        lines.union(t.spark.createDataFrame([('{"type": "FeatureCollection", "features": [',), ("]}",), ("",)], "value string")).write.text(folder)
        got = geojson.read_lines(t.spark, folder, without='"source":"ms"')
        return got.groupBy("source").agg(F.count("*").alias("features"), R6(F.sum(geom_area())).alias("area"), F.sum(F.size("geom").cast("long")).alias("parts"))

    return through_folder(t.spark, job)


@query(with_tables("SELECT source, 'r' || (fid % 4) AS region, count(*) AS features, CAST(sum(CASE WHEN fid % 5 <> 0 THEN fid % 40 ELSE -999 END) AS DOUBLE) AS heights, count(*) FILTER (fid % 3 = 0) AS multi FROM footprints GROUP BY ALL", "footprints"))
def geojson_sink(t: Tables) -> DataFrame:
    """Written with a fixed schema and a sentinel for what is missing; a part alone is a Polygon, several are a MultiPolygon."""

    def job(folder: str) -> DataFrame:
        geojson.write_lines(multi(t), folder, "id", "source", "region", "height", missing=-999.0)
        got = geojson.read_lines(t.spark, folder)
        return got.groupBy("source", "region").agg(F.count("*").alias("features"), F.sum("height").alias("heights"), F.count_if(F.col("kind") == "MultiPolygon").alias("multi"))

    return through_folder(t.spark, job)


@query(with_tables(f"SELECT CASE WHEN fid % 3 = 0 THEN fid || '_' || i ELSE CAST(fid AS VARCHAR) END AS id, CASE WHEN i = 0 THEN {_L} ELSE 4 END AS area, CAST(CASE WHEN i = 0 THEN x1 ELSE x2 + 1 END AS DOUBLE) AS x FROM footprints, unnest(CASE WHEN fid % 3 = 0 THEN [0, 1] ELSE [0] END) AS p(i)", "footprints"))
def polygon_parts(t: Tables) -> DataFrame:
    """Multipolygons taken apart; parts get a number after their id."""
    rows = multi(t).select(F.explode(geo.parts(F.col("geom"), F.col("id"))).alias("p"))
    return rows.select("p.id", geo.polygon_area(F.col("p.rings")).alias("area"), geo.bounds(F.col("p.rings"))["x1"].alias("x"))


@query(with_tables("SELECT quadkey, source, count(*) AS n FROM (SELECT lpad(CAST(fid % 64 AS VARCHAR), 4, '0') AS quadkey, source FROM footprints) GROUP BY ALL", "footprints"))
def quadkey_index_scan(t: Tables) -> DataFrame:
    """A CSV index whose keys keep their leading zeros."""

    def job(folder: str) -> DataFrame:
        t.footprints().select(F.col("source").alias("Location"), F.lpad((F.col("fid") % 64).cast("string"), 4, "0").alias("QuadKey")).write.option("header", True).csv(folder)
        return geojson.read_quadkey_index(t.spark, folder).groupBy(F.col("QuadKey").alias("quadkey"), F.col("Location").alias("source")).agg(F.count("*").alias("n"))

    return through_folder(t.spark, job)


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE) END AS volume FROM part")
def keyed_json_scan(t: Tables) -> DataFrame:
    """JSON objects of structs, one file for each thousand keys: the keys become a column."""

    def job(folder: str) -> DataFrame:
        entry = F.struct(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size").cast("double")).alias("volume")))
        docs = t.part.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        docs.repartition("k").write.partitionBy("k").text(folder)
        return geojson.read_keyed(t.spark, folder, "struct<name:string,volume:double>").select("code", "name", "volume")

    return through_folder(t.spark, job)


@query("SELECT CAST(event_id // 100 AS BIGINT) AS epoch, count(*) AS n, round(arg_min(value, event_id), 6) AS first_loss, round(arg_max(value, event_id), 6) AS last_loss, string_agg(event_type, ',' ORDER BY event_id) AS modes FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def log_scan(t: Tables) -> DataFrame:
    """JSON-lines logs by epoch in the order of iterations; lines without an epoch are skipped."""

    def job(folder: str) -> DataFrame:
        e = t.events.select(F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 100)).alias("epoch"), F.col("event_id").alias("iter"), F.col("event_type").alias("mode"), F.col("value").cast("double").alias("loss"))
        e.repartition(4, "iter").write.json(folder)
        logs = geojson.read_logs(t.spark, folder, "epoch long, iter long, mode string, loss double")
        return logs.select("epoch", F.size("loss").cast("long").alias("n"), R6(F.col("loss")[0]).alias("first_loss"), R6(F.element_at("loss", -1)).alias("last_loss"), F.array_join("mode", ",").alias("modes"))

    return through_folder(t.spark, job)


@query("SELECT p_brand AS entry, count(*) AS n FROM part GROUP BY 1")
def list_scan(t: Tables) -> DataFrame:
    """Lists of one entry a line, with blanks around them and between."""

    def job(folder: str) -> DataFrame:
        t.part.select(F.explode(F.array(F.concat(F.lit("  "), "p_brand", F.lit(" ")), F.lit(" "))).alias("value")).write.text(folder)
        return geojson.read_list(t.spark, folder).groupBy("entry").agg(F.count("*").alias("n"))

    return through_folder(t.spark, job)


@query("SELECT 'seg' || (l_orderkey % 20) AS seg, count(*) AS n, round(sum(l_discount), 6) AS loss, max('img' || l_orderkey) AS last FROM lineitem GROUP BY 1")
def triple_scan(t: Tables) -> DataFrame:
    """Lines of img, seg and loss."""

    def job(folder: str) -> DataFrame:
        t.lineitem.select(F.concat(F.lit("img"), "l_orderkey", F.lit(" seg"), F.col("l_orderkey") % 20, F.lit(" "), F.col("l_discount").cast("double"))).write.text(folder)
        return geojson.read_triples(t.spark, folder).groupBy("seg").agg(F.count("*").alias("n"), R6(F.sum("loss")).alias("loss"), F.max("img").alias("last"))

    return through_folder(t.spark, job)


# files ------------------------------------------------------------------------------------------------------------

#: A file for each hundred parts, a line for each part; its folder is the first of three categories.
_FILES = "SELECT k, 'c' || (k % 3) AS category, 'f' || k || CASE WHEN k % 2 = 0 THEN '.txt' ELSE '.md' END AS name, string_agg(p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) AS data FROM (SELECT *, CAST(p_partkey // 100 AS BIGINT) AS k FROM part) GROUP BY 1"


def texts(t: Tables) -> DataFrame:
    """k, category, name, data of each file."""
    k = F.floor(F.col("p_partkey") / 100)
    lines = t.part.groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("line")))).alias("l"))
    data = F.encode(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), "UTF-8")
    return lines.select("k", F.concat(F.lit("c"), F.col("k") % 3).alias("category"), F.concat(F.lit("f"), "k", F.when(F.col("k") % 2 == 0, ".txt").otherwise(".md")).alias("name"), data.alias("data"))


def with_files(t: Tables, folder: str) -> DataFrame:
    files.write_files(texts(t).withColumn("name", F.concat_ws("/", "category", "name")), folder)
    return files.listing(t.spark, folder)


@query(f"SELECT name, category AS folder, CAST(octet_length(encode(data)) AS BIGINT) AS length FROM ({_FILES}) WHERE name LIKE '%.txt'")
def file_listing(t: Tables) -> DataFrame:
    """All files below a folder whose names fit a mask."""

    def job(folder: str) -> DataFrame:
        with_files(t, folder)
        p = geo.path_parts("path")
        return files.listing(t.spark, folder, "*.txt").select(p["name"].alias("name"), p["parent"].alias("folder"), "length")

    return through_folder(t.spark, job)


@query(f"SELECT name, CASE WHEN k % 5 = 0 THEN '00' ELSE 'none' END AS sha256, CASE WHEN k % 5 = 0 THEN sha256(data) END AS found FROM ({_FILES}) WHERE k % 5 IN (0, 1)".replace("name, CASE", "CASE WHEN k % 5 = 1 THEN 'x' || name ELSE name END AS name, CASE", 1))
def checksum_mismatches(t: Tables) -> DataFrame:
    """Expected hashes against those of the files: a fifth are wrong, a fifth are of files that aren't there."""

    def job(folder: str) -> DataFrame:
        listed = with_files(t, folder)
        fifth = F.col("k") % 5
        expected = texts(t).select(F.when(fifth == 1, F.concat(F.lit("x"), "name")).otherwise(F.col("name")).alias("name"), F.when(fifth == 0, "00").when(fifth == 1, "none").otherwise(F.upper(F.sha2("data", 256))).alias("sha256"))
        return files.checksum_mismatches(listed, expected)

    return through_folder(t.spark, job)


@query(f"SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS BIGINT) AS label, count(*) AS files, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM ({_FILES}) WHERE name LIKE '%.md' GROUP BY category")
def labelled_files(t: Tables) -> DataFrame:
    """The first folder below the root is the label; files at the top and other suffixes are left out."""

    def job(folder: str) -> DataFrame:
        files.write_files(texts(t).where("k % 2 = 1").withColumn("name", F.concat(F.lit("top"), "name")), folder)
        rows = files.labelled_folder(with_files(t, folder), folder, [".MD"])
        return rows.groupBy("category", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    return through_folder(t.spark, job)


@query(f"SELECT category || '.' || kind AS archive, name AS member, CAST(octet_length(encode(data)) AS BIGINT) AS length, sha256(data) AS sha256 FROM ({_FILES.replace('k % 3', '(k // 10)')}), unnest(['zip', 'tar']) AS x(kind)")
def archive_members(t: Tables) -> DataFrame:
    """Zip and tar archives of ten files each, expanded to their members."""

    def job(folder: str) -> DataFrame:
        rows = texts(t).select(F.concat(F.lit("c"), F.floor(F.col("k") / 10)).alias("archive"), F.col("name").alias("member"), "data")
        for kind in ("zip", "tar"):
            files.write_files(files.packed(rows, "archive", kind), folder)
        found = files.members(files.listing(t.spark, folder))
        return found.select(geo.path_parts("path")["name"].alias("archive"), "member", F.length("data").cast("long").alias("length"), F.sha2("data", 256).alias("sha256"))

    return through_folder(t.spark, job)


_STEM, _SUFFIX = "CAST(p_partkey // 4 AS VARCHAR)", "CASE p_partkey % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.tar' WHEN 2 THEN '' ELSE '.zip' END"


@query(f"SELECT stem, arg_min(path, (NOT is_dir, len(string_split(path, '.')), path)) AS path FROM (SELECT {_STEM} AS stem, 'd' || (p_partkey % 7) || '/' || {_STEM} || {_SUFFIX} AS path, p_partkey % 4 = 2 AS is_dir FROM part WHERE p_partkey % 9 <> 2) GROUP BY 1")
def preferred_files(t: Tables) -> DataFrame:
    """Of the files of a stem a folder, else that with the fewest suffixes."""
    stem, k = F.floor(F.col("p_partkey") / 4).cast("string"), F.col("p_partkey") % 4
    suffix = F.when(k == 0, ".tar.gz").when(k == 1, ".tar").when(k == 2, "").otherwise(".zip")
    rows = t.part.where("p_partkey % 9 <> 2").select(stem.alias("stem"), F.concat(F.lit("d"), F.col("p_partkey") % 7, F.lit("/"), stem, suffix).alias("path"), (k == 2).alias("is_dir"))
    return files.preferred(rows).select("stem", "path")


#: A picture for each 500 keys with a box for each order.
_BOXES = "SELECT CAST(o_orderkey // 500 AS BIGINT) AS image, o_orderkey AS id, o_orderkey * 7919 % 200 AS x, o_orderkey * 104729 % 200 AS y, 5 + o_orderkey % 23 AS w, 5 + o_orderkey % 17 AS h, substr(o_orderpriority, 3) AS name FROM orders"


def pictures(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.floor(k / 500).alias("image"), k.alias("id"), (k * 7919 % 200).alias("x"), (k * 104729 % 200).alias("y"), (5 + k % 23).alias("w"), (5 + k % 17).alias("h"), F.substring("o_orderpriority", 3, 99).alias("name"))


@query(f"SELECT 'p' || image AS stem, name, count(*) AS n, CAST(sum(x) AS DOUBLE) AS x1, CAST(sum(y + h) AS DOUBLE) AS y2 FROM ({_BOXES}) GROUP BY ALL")
def voc_scan(t: Tables) -> DataFrame:
    """XML annotations, a file for each picture."""

    def job(folder: str) -> DataFrame:
        number = lambda c, v: F.concat(F.lit(f"<{c}>"), v.cast("string"), F.lit(f"</{c}>"))
        corners = F.concat(number("xmin", F.col("x")), number("ymin", F.col("y")), number("xmax", F.col("x") + F.col("w")), number("ymax", F.col("y") + F.col("h")))
        one = F.concat(F.lit("<object>"), number("name", F.col("name")), F.lit("<bndbox>"), corners, F.lit("</bndbox></object>"))
        docs = pictures(t).groupBy("image").agg(F.concat(F.lit("<annotation><filename>p"), F.col("image"), F.lit(".jpg</filename>"), F.array_join(F.collect_list(one), ""), F.lit("</annotation>")).alias("xml"))
        files.write_files(docs.select(F.concat(F.lit("p"), "image", F.lit(".xml")).alias("name"), F.encode("xml", "UTF-8").alias("data")), folder)
        found = files.voc_boxes(files.listing(t.spark, folder, "*.xml"))
        return found.groupBy("stem", "name").agg(F.count("*").alias("n"), F.sum("box.x1").alias("x1"), F.sum("box.y2").alias("y2"))

    return through_folder(t.spark, job)


_FAIR = "id % 13 <> 0 AND least(x + w, 190) - x <> 0 AND least(y + h, 190) - y <> 0 AND name <> 'LOW'"


@query(f"SELECT image AS image_id, name AS category, count(*) AS n, count(*) FILTER (id % 11 = 0) AS crowds, CAST(sum(w * h) AS DOUBLE) AS area, CAST(sum(x + w) AS DOUBLE) AS x2 FROM ({_BOXES}) WHERE {_FAIR} GROUP BY ALL")
def coco_scan(t: Tables) -> DataFrame:
    """COCO annotations, a file for each picture of 190 by 190: ignored ones, boxes beside it and one category are left out, rings rebuilt."""

    def job(folder: str) -> DataFrame:
        names = [r.name for r in pictures(t).select("name").distinct().orderBy("name").collect()]  # five priorities
        x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "w", "h"))
        a = F.struct(F.col("id").cast("long").alias("id"), F.col("image").alias("image_id"), F.array_position(F.array(*map(F.lit, names)), F.col("name")).alias("category_id"), F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h, x, y)).alias("segmentation"), (w * h).alias("area"), F.array(x, y, w, h).alias("bbox"), (F.col("id") % 11 == 0).cast("int").alias("iscrowd"), (F.col("id") % 13 == 0).cast("int").alias("ignore"))
        docs = pictures(t).groupBy("image").agg(F.collect_list(a).alias("annotations"))
        image = F.array(F.struct(F.col("image").alias("id"), F.lit(190).alias("width"), F.lit(190).alias("height"), F.concat(F.lit("p"), "image").alias("file_name")))
        kinds = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names, 1)))
        whole = docs.select("image", F.to_json(F.struct(image.alias("images"), "annotations", F.when(F.col("image") == 0, kinds).alias("categories"))).alias("value"))
        files.write_files(whole.select(F.concat("image", F.lit(".json")).alias("name"), F.encode("value", "UTF-8").alias("data")), folder)
        found = files.read_coco(t.spark, folder, [i for i, n in enumerate(names, 1) if n != "LOW"])
        return found.groupBy("image_id", "category").agg(F.count("*").alias("n"), F.count_if("crowd").alias("crowds"), F.sum(geo.polygon_area(F.col("rings"))).alias("area"), F.sum("box.x2").alias("x2"))

    return through_folder(t.spark, job)


@query(f"SELECT row_number() OVER (ORDER BY image, id % 10 DESC, x, y, id) AS id, image AS image_id, CAST(100 AS BIGINT) AS category_id, CAST(w * h AS DOUBLE) AS area, x + w / 2.0 AS cx, y + h / 2.0 AS cy, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM ({_BOXES})")
def coco_export(t: Tables) -> DataFrame:
    """Polygons as annotations numbered by picture and score."""
    b = geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    # scores tell all of a picture's apart: by the last digit, then place
    rows = pictures(t).select(F.col("image").alias("image_id"), F.array(geo.ring_of_box(b)).alias("rings"), (F.col("id") % 10 - F.col("x") / 1e3 - F.col("y") / 1e6 - F.col("id") / 1e15).alias("score"))
    out = files.to_coco(rows)
    return out.select(F.col("id").cast("long").alias("id"), "image_id", F.col("category_id").cast("long").alias("category_id"), "area", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))))


# tables -----------------------------------------------------------------------------------------------------------


@query(with_tables("SELECT continent, tile, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT 'k' || (fid % 3) AS continent, 't' || (fid % 12) AS tile, CASE WHEN fid % 12 = 4 THEN 2 ELSE 1 END AS v FROM footprints WHERE NOT (fid % 12 = 4 AND fid % 5 = 0)) GROUP BY ALL", "footprints"))
def tile_partitions(t: Tables) -> DataFrame:
    """A table by continent and tile, of which one tile is written anew; the others stay."""

    def job(folder: str) -> DataFrame:
        rows = t.footprints().select("fid", F.concat(F.lit("k"), F.col("fid") % 3).alias("continent"), F.concat(F.lit("t"), F.col("fid") % 12).alias("tile"), F.lit(1).alias("v"))
        geojson.write_tiles(rows, folder)
        geojson.write_tiles(rows.where("tile = 't4' and fid % 5 <> 0").withColumn("v", F.lit(2)), folder)
        return t.spark.read.parquet(folder).groupBy("continent", "tile").agg(F.count("*").alias("n"), F.sum("v").alias("v"))

    return through_folder(t.spark, job)


@query("SELECT l_linenumber % 3 AS part, count(*) AS n, round(sum(l_tax), 6) AS loss FROM lineitem GROUP BY 1")
def appended_metrics(t: Tables) -> DataFrame:
    """A row for each sample, appended by three runs."""

    def job(folder: str) -> DataFrame:
        for k in range(3):
            geojson.append_rows(t.lineitem.where(F.col("l_linenumber") % 3 == k).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("file"), F.lit(k).alias("part"), F.col("l_tax").alias("loss")), folder)
        return t.spark.read.parquet(folder).groupBy("part").agg(F.count("file").alias("n"), R6(F.sum("loss")).alias("loss"))

    return through_folder(t.spark, job)


@query("SELECT p_brand AS category, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS label, CAST(n AS BIGINT) AS n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def category_inventory(t: Tables) -> DataFrame:
    """The list of categories written as a file, read back and joined to count each label."""

    def job(folder: str) -> DataFrame:
        rows = t.part.select(F.col("p_brand").alias("category"))
        files.write_categories(rows, folder)
        known = t.spark.read.schema("category string, label long").csv(folder)
        return rows.join(F.broadcast(known), "category").groupBy("category", "label").agg(F.count("*").alias("n"))

    return through_folder(t.spark, job)


CATALOG = Catalog()


@CATALOG.register("footprints", splits=("train", "val", "test"), categories=("osm", "ms", "google", "ours2", "3dglobfp"), about="footprints by source")
def _footprints(spark, split: str, tables: Tables) -> DataFrame:
    """Every tenth is for validation, every tenth for tests."""
    return tables.footprints().where({"train": "fid % 10 < 8", "val": "fid % 10 = 8", "test": "fid % 10 = 9"}[split])


@CATALOG.register("districts", about="the districts that footprints are cropped to")
def _districts(spark, tables: Tables) -> DataFrame:
    return tables.districts()


@CATALOG.register("houses", about="boxes under which the height raster is read")
def _houses(spark, tables: Tables) -> DataFrame:
    return tables.houses()


@CATALOG.register("pixels", about="the height raster")
def _pixels(spark, tables: Tables) -> DataFrame:
    return tables.pixels()


@query(with_tables("SELECT 'footprints' AS dataset, CASE fid % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM footprints GROUP BY ALL UNION ALL SELECT 'districts', '', count(*) FROM districts UNION ALL SELECT 'houses', '', count(*) FROM houses UNION ALL SELECT 'pixels', '', count(*) FROM pixels", "footprints", "districts", "houses", "pixels"))
def dataset_catalog(t: Tables) -> DataFrame:
    """Every registered dataset and split by its name."""
    out = None
    for name in CATALOG.names():
        for split in CATALOG.info(name).splits or ("",):
            found = CATALOG.load(t.spark, name, split or None, tables=t).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), "n")
            out = found if out is None else out.union(found)
    return out


# intake and plugged-in steps --------------------------------------------------------------------------------------


@query("SELECT substr(o_orderpriority, 1, 1) AS priority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(2 AS BIGINT) AS batches FROM orders GROUP BY 1")
def incremental_intake(t: Tables) -> DataFrame:
    """Files taken in as they come, in two calls and a third that finds none; each file once, each call with its status rows."""

    def job(folder: str) -> DataFrame:
        source, done, status, check = (f"{folder}/{n}" for n in ("source", "done", "status", "check"))
        keep = lambda batch, number: None  # noqa: E731  as they are
        for k in (0, 1, None):
            if k is not None:
                t.orders.select("o_orderkey", "o_orderpriority").where(F.col("o_orderkey") % 2 == k).coalesce(4).write.mode("append").parquet(source)
            intake.take_in(t.spark, source, "o_orderkey long, o_orderpriority string", check, status, keep, output=done)
        finished = intake.latest_status(t.spark.read.parquet(status)).where("state = 'finished'").agg(F.count("*").alias("batches"))
        rows = t.spark.read.parquet(done).groupBy(F.substring("o_orderpriority", 1, 1).alias("priority")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        return rows.crossJoin(F.broadcast(finished))  # one row

    return through_folder(t.spark, job)


@query("SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def transform_chain(t: Tables) -> DataFrame:
    """Steps chosen by name from a registry, and one given as it is."""
    steps = {
        "large": lambda df: df.where("l_quantity >= 10"),
        "net": lambda df: df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        "gross": lambda df: df.withColumn("gross", F.col("net") * (1 + F.col("l_tax"))),
    }
    by_flag = lambda df: df.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("gross"), 2).alias("gross"))
    return sampling.composed(t.lineitem, ["large", "net", "gross", by_flag], steps)


@query(with_tables("SELECT CAST(row // 16 * 16 AS BIGINT) AS r0, CAST(col // 16 * 16 AS BIGINT) AS c0, CAST(count(*) FILTER (h >= 30) AS DOUBLE) AS score, CAST(max(h) AS DOUBLE) AS top FROM pixels GROUP BY 1, 2 HAVING max(h) > 0", "pixels"))
def scored_windows(t: Tables) -> DataFrame:
    """Windows of 16 by 16 through a caller's model, a batch at a time; windows without any signal are left out before."""
    import numpy as np
    import pandas as pd

    def model(batches):
        for b in batches:
            data = np.stack(b["data"].to_numpy()) if len(b) else np.zeros((0, 256))
            yield pd.DataFrame({"r0": b["r0"], "c0": b["c0"], "score": (data >= 30).sum(1).astype(float), "top": data.max(1, initial=-1.0)})

    blocks = raster.to_blocks(t.pixels().select("row", "col", F.col("h").alias("value")), 16, -1.0).where(F.array_max("data") > 0)
    return raster.scored(blocks.select(F.col("r0").cast("long").alias("r0"), F.col("c0").cast("long").alias("c0"), "data"), model, "r0 long, c0 long, score double, top double")


# orders, keys and merges ------------------------------------------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY v DESC, brand) AS BIGINT) AS place, brand, v FROM (SELECT p_brand AS brand, round(sum(p_retailprice) / count(DISTINCT p_size), 6) AS v FROM part GROUP BY 1)")
def groups_by_metric(t: Tables) -> DataFrame:
    """Groups in the order of a metric that is worked out from their sums."""
    rows = t.part.groupBy(F.col("p_brand").alias("brand")).agg(R6(F.sum("p_retailprice") / F.countDistinct("p_size")).alias("v"))
    return sampling.numbered(rows, "place", F.desc("v"), F.col("brand")).select((F.col("place") + 1).alias("place"), "brand", "v")


@query("SELECT e.city, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN (SELECT n_name AS city, 'supplier_' || s_suppkey AS folder FROM supplier JOIN nation ON s_nationkey = n_nationkey) e ON 'supplier_' || l_suppkey = e.folder WHERE l_quantity > 5 GROUP BY 1")
def derived_key_join(t: Tables) -> DataFrame:
    """Files named by folder joined to a table of folders: the key is cut out of the path."""
    named = t.lineitem.where("l_quantity > 5").select(F.concat(F.lit("root/supplier_"), "l_suppkey", F.lit("/"), "l_orderkey", F.lit(".png")).alias("path"), "l_quantity")
    mapping = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier_"), "s_suppkey").alias("folder"), F.col("n_name").alias("city"))
    keyed = named.withColumn("folder", geo.path_parts("path")["parent"]).join(mapping, "folder")
    return keyed.groupBy("city").agg(F.count("*").alias("n"), R6(F.sum("l_quantity")).alias("quantity"))


@query(with_tables("SELECT 't' || (fid % 8) AS tile, count(*) AS n, count(DISTINCT 's' || (fid % 24)) AS sub_tiles, count(*) FILTER (fid % 2 = 0) AS in_a FROM footprints GROUP BY 1", "footprints"))
def merged_sub_tiles(t: Tables) -> DataFrame:
    """The records of all sub-tiles of a tile, from two roots, put together."""

    def job(folder: str) -> DataFrame:
        rows = t.footprints().select("fid", F.concat(F.lit("t"), F.col("fid") % 8).alias("tile"), F.concat(F.lit("s"), F.col("fid") % 24).alias("sub"))
        for root, k in (("a", 0), ("b", 1)):
            rows.where(F.col("fid") % 2 == k).write.partitionBy("tile", "sub").parquet(f"{folder}/{root}")
        roots = [t.spark.read.parquet(f"{folder}/{root}").withColumn("root", F.lit(root)) for root in ("a", "b")]
        return roots[0].unionByName(roots[1]).groupBy("tile").agg(F.count("*").alias("n"), F.countDistinct("sub").alias("sub_tiles"), F.count_if(F.col("root") == "a").alias("in_a"))

    return through_folder(t.spark, job)


@query(with_tables("SELECT source, count(*) FILTER (l AND r) AS whole, count(*) FILTER (m) AS some, round(sum(CASE WHEN l AND r THEN x1 - 1000 ELSE 0 END), 6) AS x FROM (SELECT *, x1 >= 1000 AND y1 >= 1000 AS l, x2 <= 3000 AND y2 <= 3000 AS r, (x1 BETWEEN 1000 AND 3000 OR x2 BETWEEN 1000 AND 3000) AND (y1 BETWEEN 1000 AND 3000 OR y2 BETWEEN 1000 AND 3000) AND NOT (x1 < 1000 AND x2 >= 1000 AND y1 < 1000 AND y2 >= 1000 AND (x1 + x2) / 2.0 < 1000 AND (y1 + y2) / 2.0 < 1000) AS m FROM footprints) GROUP BY source", "footprints"))
def rings_in_a_window(t: Tables) -> DataFrame:
    """L-shapes wholly in a window, moved to its corner, and those with any vertex in it."""
    w = geo.box(F.lit(1000), F.lit(1000), F.lit(3000), F.lit(3000))
    ring = F.col("geom")[0][0]
    rows = multi(t).select("source", geo.all_points_inside(ring, w).alias("whole"), geo.any_point_inside(ring, w).alias("some"), geo.moved(F.array(ring), F.lit(1), F.lit(0), F.lit(-1000), F.lit(0), F.lit(1), F.lit(-1000))[0][0]["x"].alias("x"))
    return rows.groupBy("source").agg(F.count_if("whole").alias("whole"), F.count_if("some").alias("some"), R6(F.sum(F.when(F.col("whole"), F.col("x")).otherwise(0.0))).alias("x"))


@query(with_tables("SELECT source, count(*) AS n, CAST(sum(fid) AS BIGINT) AS keys FROM footprints WHERE x1 <= 2300 AND x2 >= 1200 AND y1 <= 1700 AND y2 >= 900 GROUP BY source", "footprints"))
def source_lookup(t: Tables) -> DataFrame:
    """Of a store by cells only the files are read whose boxes in the manifest meet the wanted one; then what meets it counts."""

    def job(folder: str) -> DataFrame:
        store.write_store(t.footprints().select("fid", "source", "lbox"), folder, 500.0, 16)
        return store.lookup(t.spark, folder, [(1200.0, 900.0, 2300.0, 1700.0)]).groupBy("source").agg(F.count("*").alias("n"), F.sum("fid").alias("keys"))

    return through_folder(t.spark, job)
