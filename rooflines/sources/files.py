"""Files as rows: listings, archive members, checksums, labelled folders, annotations."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.sampling import numbered


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of all files below path; what isn't selected isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def members(files: DataFrame) -> DataFrame:
    """Members of tar and zip archives, path, member and data; other files are one member of their own name."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    try:
                        with tarfile.open(fileobj=io.BytesIO(content)) as t:
                            rows = [(path, m.name, t.extractfile(m).read()) for m in t if m.isfile()]
                    except tarfile.ReadError:
                        rows = [(path, path.rsplit("/", 1)[-1], content)]
                yield pd.DataFrame(rows, columns=["path", "member", "data"])

    return files.select("path", "content").mapInPandas(expand, "path string, member string, data binary")


def preferred(candidates: DataFrame) -> DataFrame:
    """candidates (stem, path, is_dir): of each stem a folder, else the file with the fewest suffixes; ties by path."""
    name = F.element_at(F.split("path", "/"), -1)
    ranked = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("is_dir"), F.size(F.split(name, r"\.")), "path")))
    return ranked.where("__n = 1").drop("__n")


def checksum_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, expected and found hash (null: no such file) where they differ. expected: name, sha256."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "name", "left").where(~F.lower("sha256").eqNullSafe(F.col("found"))).select("name", "sha256", "found")


def labelled_folder(files: DataFrame, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Files below root with category, the first folder under it, and label, its place among the sorted names; files at the top are dropped."""
    tail = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/")  # file:/a and file:///a are the same folder
    below = F.substring_index(F.col("path"), tail + "/", -1)
    rows = files.withColumn("__parts", F.split(below, "/")).where(F.size("__parts") > 1)
    if extensions:
        rows = rows.where(F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin([e.lower() for e in extensions]))
    rows = rows.withColumn("category", F.col("__parts")[0]).drop("__parts")
    return rows.join(F.broadcast(categories(rows)), "category")


def categories(df: DataFrame, column: str = "category") -> DataFrame:
    """The distinct names in order, with label from 0. A list of names is small by nature."""
    return df.select(column).distinct().withColumn("label", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def write_categories(df: DataFrame, path: str, column: str = "category") -> None:
    categories(df, column).orderBy("label").coalesce(1).write.mode("overwrite").csv(path)


VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def voc_boxes(files: DataFrame) -> DataFrame:
    """Rows of VOC annotations: stem, name and box of each object."""
    a = F.from_xml(F.decode("content", "UTF-8"), VOC)
    rows = files.select(geo.path_parts("path")["stem"].alias("stem"), a.alias("a")).select("stem", F.explode("a.object").alias("o"))
    return rows.select("stem", F.col("o.name").alias("name"), geo.box("o.bndbox.xmin", "o.bndbox.ymin", "o.bndbox.xmax", "o.bndbox.ymax").alias("box"))


COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:array<array<double>>,area:double,bbox:array<double>,iscrowd:int,ignore:int>>,"
    "categories array<struct<id:bigint,name:string>>"
)


def read_coco(spark: SparkSession, path: str, keep: list[int] | None = None) -> DataFrame:
    """Annotations by image: box, crowd, and rings rebuilt from flat coordinates.

    Ignored ones, boxes that don't overlap their image or are smaller than a pixel, and categories not in keep are left out.
    """
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    kinds = {c: doc.schema[c].dataType for c in ("images", "annotations")}
    # images and annotations come from one reading of the files and meet by image: an annotation's image may be in another file
    listed = lambda c: F.coalesce(c, F.array().cast(kinds[c]))
    entry = lambda key, i, a: F.struct(key.alias("image_id"), i.cast(kinds["images"].elementType).alias("i"), a.cast(kinds["annotations"].elementType).alias("a"))
    entries = F.concat(F.transform(listed("images"), lambda v: entry(v["id"], v, F.lit(None))), F.transform(listed("annotations"), lambda v: entry(v["image_id"], F.lit(None), v)))
    rows = doc.select(F.explode(entries).alias("v")).select("v.*").where("image_id is not null")
    met = rows.withColumn("i", F.collect_list("i").over(Window.partitionBy("image_id"))).where("a is not null")
    a = met.select(F.explode("i").alias("i"), "a").select("a.*", "i.width", "i.height", "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    both = a.join(F.broadcast(names), "category_id", "left")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    inside = (F.least(x + w, F.col("width")) - F.greatest(x, F.lit(0))) * (F.least(y + h, F.col("height")) - F.greatest(y, F.lit(0)))
    fair = both.where((F.coalesce("ignore", F.lit(0)) == 0) & (inside != 0) & (F.coalesce("area", w * h) > 0) & (w >= 1) & (h >= 1))
    if keep is not None:
        fair = fair.where(F.col("category_id").isin(keep))
    ring = lambda flat: F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y")))
    return fair.select("id", "image_id", "file_name", "category_id", "category", geo.box(x, y, x + w, y + h).alias("box"), (F.coalesce("iscrowd", F.lit(0)) == 1).alias("crowd"), F.transform("segmentation", ring).alias("rings"))


def to_coco(polygons: DataFrame, category: int = 100) -> DataFrame:
    """polygons (image_id, rings, score) as annotations with running ids. bbox is centre and size, which readers of this export expect."""
    b = geo.bounds(F.col("rings"))
    rows = polygons.withColumn("__b", b).withColumn("area", geo.polygon_area(F.col("rings")))
    ranked = numbered(rows.withColumn("__json", F.to_json("rings")), "__n", "image_id", F.desc("score"), "__json")
    flat = F.transform("rings", lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    w, h = F.col("__b.x2") - F.col("__b.x1"), F.col("__b.y2") - F.col("__b.y1")
    return ranked.select((F.col("__n") + 1).alias("id"), "image_id", F.lit(category).alias("category_id"), flat.alias("segmentation"), "area", F.array(F.col("__b.x1") + w / 2, F.col("__b.y1") + h / 2, w, h).alias("bbox"), F.lit(0).alias("iscrowd"), "score")


def write_files(rows: DataFrame, folder: str) -> int:
    """rows (name, data) as files of those names below folder, written by the tasks that hold them; their number. A name may have folders."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "data").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def packed(rows: DataFrame, archive: str, kind: str = "zip") -> DataFrame:
    """rows (archive's column, member, data) as one zip or tar for each archive: name, data. An archive is made in one task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pdf = io.BytesIO(), pdf.sort_values("member")
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for member, data in zip(pdf["member"], pdf["data"], strict=True):
                    z.writestr(member, data)
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for member, data in zip(pdf["member"], pdf["data"], strict=True):
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"name": [f"{pdf[archive].iat[0]}.{kind}"], "data": [out.getvalue()]})

    return rows.groupBy(archive).applyInPandas(lambda pdf: pack(pdf), "name string, data binary")
