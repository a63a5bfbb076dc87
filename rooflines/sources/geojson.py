"""GeoJSON in and out, and the small JSON, CSV and text forms around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coordinates as GeoJSON has them: polygon rings, or one level more.
RING = "array<array<array<double>>>"
PROPERTIES = "struct<id:string,source:string,region:string,height:double,var:double>"


def feature_schema(properties: str = PROPERTIES) -> str:
    """Coordinates stay text until the geometry's type is known."""
    return f"struct<type:string,geometry:struct<type:string,coordinates:string>,properties:{properties}>"


def geometry(feature: Column) -> Column:
    """array<array<array<struct<x,y>>>> of a Polygon or MultiPolygon; null for other types."""
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = lambda polygon: F.transform(polygon, points)
    text, kind = feature["geometry"]["coordinates"], feature["geometry"]["type"]
    # a Polygon is read as a MultiPolygon of one, and the text only once, however often the result is mentioned
    many = F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).when(kind == "MultiPolygon", text)
    return F.transform(F.from_json(many, f"array<{RING}>"), rings)


def _flat(features: DataFrame) -> DataFrame:
    f = F.col("f")
    return features.select(f["geometry"]["type"].alias("kind"), geometry(f).alias("geom"), "f.properties.*")


def read_collection(spark: SparkSession, path: str, properties: str = PROPERTIES) -> DataFrame:
    """FeatureCollections, one per file: kind, geom and the properties."""
    schema = T._parse_datatype_string(f"type string, features array<{feature_schema(properties)}>")
    return _flat(spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")))


def read_lines(spark: SparkSession, path: str, properties: str = PROPERTIES, without: str | None = None) -> DataFrame:
    """One feature a line: lines without coordinates (and those that contain `without`) go, a trailing comma too."""
    lines = spark.read.text(path).where(F.col("value").contains("coordinates"))
    if without:
        lines = lines.where(~F.col("value").contains(without))
    return _flat(lines.select(F.from_json(F.regexp_replace(F.rtrim("value"), ",$", ""), feature_schema(properties)).alias("f")))


def to_features(df: DataFrame, *properties: str, missing: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """value: one GeoJSON feature a row, from geom and the named properties; with missing, null numbers become that sentinel. Columns to keep come along."""
    numbers = ("double", "float", "int", "bigint")
    kinds = dict(df.dtypes)
    props = [F.coalesce(F.col(p), F.lit(missing).cast(kinds[p])).alias(p) if missing is not None and kinds[p] in numbers else F.col(p) for p in properties]
    pair = lambda p: F.array(p["x"], p["y"])
    polygons = F.transform("geom", lambda rings: F.transform(rings, lambda r: F.transform(r, pair)))
    single = F.struct(F.lit("Polygon").alias("type"), polygons[0].alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))
    wrap = lambda g: F.to_json(F.struct(F.lit("Feature").alias("type"), g.alias("geometry"), F.struct(*props).alias("properties")))
    return df.select(*keep, F.when(F.size("geom") == 1, wrap(single)).otherwise(wrap(multi)).alias("value"))


def write_lines(df: DataFrame, path: str, *properties: str, mode: str = "errorifexists", missing: float | None = None) -> None:
    to_features(df, *properties, missing=missing).write.mode(mode).text(path)


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "code") -> DataFrame:
    """A JSON object of structs as rows: its keys become a column."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{value}>"))).alias("e"))
    return entries.select(F.col("e.key").alias(key), "e.value.*")


def read_quadkey_index(spark: SparkSession, path: str) -> DataFrame:
    """Location and QuadKey, which stays text: leading zeros count."""
    return spark.read.schema("Location string, QuadKey string").option("header", True).csv(path)


def read_logs(spark: SparkSession, path: str, schema: str = "epoch int, iter int, mode string, loss double") -> DataFrame:
    """JSON-lines logs by epoch, lines without one skipped: each column's values in the order of iterations."""
    rows = spark.read.schema(schema).json(path).where(F.col("epoch").isNotNull())
    names = [c for c in rows.columns if c != "epoch"]
    listed = rows.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("iter", *[c for c in names if c != "iter"]))).alias("rows"))
    return listed.select("epoch", *(F.col("rows")[c].alias(c) for c in names))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry a line, blank ones skipped."""
    return spark.read.text(path).select(F.trim("value").alias("entry")).where("entry <> ''")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """img, seg and loss, set apart by a space."""
    return spark.read.schema("img string, seg string, loss double").option("sep", " ").csv(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """Parquet by continent and tile; only the partitions that df has are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("continent", "tile").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
