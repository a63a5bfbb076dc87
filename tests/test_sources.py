import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rooflines.functions import geo
from rooflines.sources import files, geojson
from rooflines.sources.catalog import Catalog
from rooflines.streaming import intake

SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]


def feature(i, kind="Polygon", coords=SQUARE):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": {"id": str(i), "source": "osm"}}


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [feature(1), feature(2, "MultiPolygon", [SQUARE, SQUARE]), feature(3, "Point", [1, 2])]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    df = geojson.read_collection(spark, str(tmp_path / "a.geojson")).cache()
    assert {r.id: len(r.geom or []) for r in df.collect()} == {"1": 1, "2": 2, "3": 0}
    parts = df.where("geom is not null").select(F.explode(geo.parts(F.col("geom"), F.col("id"))).alias("p")).select("p.id", geo.polygon_area(F.col("p.rings")).alias("a"))
    assert {r.id: r.a for r in parts.collect()} == {"1": 4.0, "2_0": 4.0, "2_1": 4.0}
    geojson.write_lines(df.where("geom is not null").withColumn("height", F.lit(None).cast("double")), str(tmp_path / "out"), "id", "source", "height", missing=-999.0)
    back = geojson.read_lines(spark, str(tmp_path / "out"))
    assert {(r.id, len(r.geom), r.height) for r in back.collect()} == {("1", 1, -999.0), ("2", 2, -999.0)}


def test_lines_with_commas_and_left_out_country(spark, tmp_path):
    rows = ['{"type": "FeatureCollection",', json.dumps(feature(1)) + ",", json.dumps(feature("Antarctica")) + ",", json.dumps(feature(2)), "]}"]
    (tmp_path / "x.json").write_text("\n".join(rows))
    assert {r.id for r in geojson.read_lines(spark, str(tmp_path / "x.json"), without="Antarctica").collect()} == {"1", "2"}


def test_small_forms(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"AT": {"name": "A", "volume": 2.5}, "BE": {"name": "B", "volume": None}}))
    assert {(r.code, r.volume) for r in geojson.read_keyed(spark, str(tmp_path / "k.json"), "struct<name:string,volume:double>").collect()} == {("AT", 2.5), ("BE", None)}
    (tmp_path / "q.csv").write_text("Location,QuadKey\nX,0012\n")
    assert geojson.read_quadkey_index(spark, str(tmp_path / "q.csv")).first().QuadKey == "0012"
    (tmp_path / "log.json").write_text('{"env": "x"}\n{"epoch": 1, "iter": 2, "mode": "train", "loss": 0.5}\n{"epoch": 1, "iter": 1, "mode": "train", "loss": 0.7}\n')
    row = geojson.read_logs(spark, str(tmp_path / "log.json")).first()
    assert row.epoch == 1 and row.loss == [0.7, 0.5]
    (tmp_path / "t.txt").write_text("a.png b.png 0.25\n")
    assert tuple(geojson.read_triples(spark, str(tmp_path / "t.txt")).first()) == ("a.png", "b.png", 0.25)
    (tmp_path / "l.txt").write_text("one\n\n two \n")
    assert [r.entry for r in geojson.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]


def test_tiles_are_overwritten_one_by_one(spark, tmp_path):
    out = str(tmp_path / "tiles")
    geojson.write_tiles(spark.createDataFrame([("EU", "t1", 1), ("EU", "t2", 2)], "continent string, tile string, v int"), out)
    geojson.write_tiles(spark.createDataFrame([("EU", "t2", 3)], "continent string, tile string, v int"), out)
    assert {(r.tile, r.v) for r in spark.read.parquet(out).collect()} == {("t1", 1), ("t2", 3)}
    geojson.append_rows(spark.range(2), str(tmp_path / "rows"))
    geojson.append_rows(spark.range(1), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 3


def test_files_archives_and_checksums(spark, tmp_path):
    root = tmp_path / "data"
    (root / "cat").mkdir(parents=True)
    (root / "ant").mkdir()
    (root / "top.txt").write_text("t")
    (root / "cat" / "a.txt").write_text("hello")
    with zipfile.ZipFile(root / "cat" / "z.zip", "w") as z:
        z.writestr("in/x.txt", "zip")
    with tarfile.open(root / "ant" / "y.tar", "w") as t:
        info = tarfile.TarInfo("q.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    listed = files.listing(spark, str(root))
    assert listed.count() == 4
    got = {(r.member, bytes(r.data)) for r in files.members(listed).collect()}
    assert got == {("top.txt", b"t"), ("a.txt", b"hello"), ("in/x.txt", b"zip"), ("q.txt", b"tar")}
    lab = files.labelled_folder(listed, str(root))
    assert {(r.category, r.label) for r in lab.collect()} == {("ant", 0), ("cat", 1)}
    assert files.labelled_folder(listed, str(root), [".txt"]).count() == 1
    want = spark.createDataFrame([("a.txt", hashlib.sha256(b"hello").hexdigest()), ("top.txt", "00"), ("none", "11")], "name string, sha256 string")
    assert {r.name for r in files.checksum_mismatches(listed, want).collect()} == {"top.txt", "none"}
    c = spark.createDataFrame([("s", "s.tar.gz", False), ("s", "s.tar", False), ("t", "t", True), ("t", "t.zip", False)], "stem string, path string, is_dir boolean")
    assert {r.path for r in files.preferred(c).collect()} == {"s.tar", "t"}
    files.write_categories(lab, str(tmp_path / "cats"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "cats")).orderBy("_c1").collect()] == [("ant", "0"), ("cat", "1")]


def test_voc(spark, tmp_path):
    (tmp_path / "img7.xml").write_text("<annotation><filename>img7.jpg</filename><object><name>roof</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    row = files.voc_boxes(files.listing(spark, str(tmp_path), "*.xml")).first()
    assert (row.stem, row.name, row.box.x2) == ("img7", "roof", 3.0)


def test_coco_in_and_out(spark, tmp_path):
    a = lambda i, **k: {"id": i, "image_id": 1, "category_id": 100, "segmentation": [[0, 0, 4, 0, 4, 4, 0, 4, 0, 0]], "area": 16.0, "bbox": [0, 0, 4, 4], "iscrowd": 0} | k
    doc = {"images": [{"id": 1, "width": 10, "height": 10, "file_name": "a.png"}], "annotations": [a(1), a(2, ignore=1), a(3, bbox=[20, 0, 4, 10]), a(4, category_id=7), a(5, iscrowd=1)], "categories": [{"id": 100, "name": "building"}, {"id": 7, "name": "tree"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = files.read_coco(spark, str(tmp_path / "c.json"), [100])
    assert {r.id: r.crowd for r in got.where("id <> 3").collect()} == {1: False, 5: True}
    out = files.to_coco(got.where("id = 1").select("image_id", "rings", F.lit(0.5).alias("score"))).first()
    assert (out.id, out.area, list(out.bbox)) == (1, 16.0, [2.0, 2.0, 4.0, 4.0])


def test_catalog(spark):
    c = Catalog()

    @c.register("numbers", splits=("train", "val"))
    def load(s, split):
        return s.range(3 if split == "train" else 1)

    assert c.names() == ["numbers"] and c.load(spark, "numbers").count() == 3
    assert spark.table("numbers").count() == 3
    with pytest.raises(ValueError):
        c.load(spark, "numbers", "test")
    with pytest.raises(ValueError):
        c.info("letters")
    with pytest.raises(ValueError):
        c.register("numbers")(load)


def test_intake_takes_new_files_only_and_notes_failures(spark, tmp_path, small):
    src, check, status, out = (str(tmp_path / n) for n in ("src", "check", "status", "out"))
    schema = "event_id long, user_id long"
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("event_id").cast("long"), F.col("user_id").cast("long"))
    events.where("event_id < 100").write.mode("append").parquet(src)
    keep = lambda b, n: b.write.mode("append").parquet(out)
    n = spark.read.parquet(src).count()
    assert intake.take_in(spark, src, schema, check, status, keep) == n
    assert intake.take_in(spark, src, schema, check, status, keep) == 0
    assert spark.read.parquet(out).count() == n
    events.where("event_id between 100 and 149").write.mode("append").parquet(src)

    def fail(b, n):
        raise RuntimeError("no disk")

    with pytest.raises(Exception, match="no disk"):
        intake.take_in(spark, src, schema, check, status, fail)
    assert intake.take_in(spark, src, schema, check, status, keep) > 0
    assert spark.read.parquet(out).count() == spark.read.parquet(src).count()
    states = {r.state for r in spark.read.parquet(status).collect()}
    assert states == {"finished", "failed"}
    assert {r.state for r in intake.latest_status(spark.read.parquet(status)).collect()} == {"finished"}
