"""Scans of saved feature pages, GeoJSON layers, map elements and CSV (SRC1-SRC6). No schema is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINES = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


# Texts that open every feature in a document without spaces: pages of a feature service, GeoJSON, map elements.
PAGED, GEOJSON = '{"attributes"', '{"type":"Feature"'


def _pages(spark: SparkSession, path: str, attributes: T.StructType, geometry: T.DataType | None, box: str, opens: str | None = None) -> DataFrame:
    fields = [T.StructField(box, attributes)] + ([T.StructField("geometry", geometry)] if geometry else [])
    if opens:
        return cut_documents(spark, path, T.StructType(fields), opens).withColumnRenamed("item", "f")
    page = T.StructType([T.StructField("features", T.ArrayType(T.StructType(fields)))])
    # one small document per file: files, not lines, are the unit of work
    return spark.read.schema(page).json(path, multiLine=True).select(F.explode("features").alias("f"))


def cut_documents(spark: SparkSession, path: str, item: T.StructType, opens: str) -> DataFrame:
    """Items of large JSON documents as rows ``item``, one document read by many tasks.

    ``opens``: the text every item starts with, which occurs nowhere else. Spark cuts the file there wherever its byte
    ranges fall, so a single document of any length is split like a file of lines; only one item at a time is parsed. What
    follows an item's closing brace is left out, what stands before the first item dropped. An item that cannot be parsed
    raises an error, so a text that also occurs inside an item cannot pass unseen.
    """
    rows = spark.read.text(path, lineSep=opens).select(F.trim("value").alias("_v"))
    goes_on = F.substring("_v", 1, 1).isin(":", ",")  # the head of a document does not
    parsed = F.from_json(F.concat(F.lit(opens), "_v"), T.StructType([*item.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    held = rows.where(goes_on).select(goes_on.alias("_goes_on"), parsed.alias("_i"))
    # filters may move before one another: the head must not be reported, whichever is first
    sound = F.when(F.col("_goes_on") & (F.col("_i").isNull() | F.col("_i._bad").isNotNull()), F.raise_error(F.concat(F.lit("not a whole item: "), F.coalesce(F.substring("_i._bad", 1, 200), F.lit("null")))).cast(item))
    return held.select(sound.otherwise(F.struct(*[F.col("_i")[f.name].alias(f.name) for f in item.fields])).alias("item"))


def scan_feature_pages(spark: SparkSession, path: str, attributes: T.StructType, *, opens: str | None = None) -> DataFrame:
    """Folder of paged JSON to one row per feature (SRC1). ``opens``, here and below: see ``cut_documents``."""
    return _pages(spark, path, attributes, None, "attributes", opens).select("f.attributes.*")


def lines_to_pieces(lines: DataFrame, paths: Column) -> DataFrame:
    """Arrays of vertex lists to straight pieces with part and index; the vertex list is paired with itself shifted by one."""
    spread = lines.select("*", F.posexplode(paths).alias("part", "_v")).where(F.size("_v") >= 2)
    pairs = F.zip_with(
        F.slice("_v", F.lit(1), F.size("_v") - 1), F.slice("_v", F.lit(2), F.size("_v") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    out = spread.select("*", F.posexplode(pairs).alias("idx", "_p"))
    ends = {"x1": ("a", 0), "y1": ("a", 1), "x2": ("b", 0), "y2": ("b", 1)}
    out = out.withColumns({c: F.get(F.col(f"_p.{side}"), F.lit(i)) for c, (side, i) in ends.items()})
    return out.drop("_v", "_p")


def scan_line_features(spark: SparkSession, path: str, attributes: T.StructType, *, geojson: bool = False, opens: str | None = None) -> DataFrame:
    """Line layers to pieces, features without geometry skipped (SRC2).

    Paged form: ``geometry.paths``. GeoJSON: LineString or MultiLineString, whose coordinates are
    read as text once, because their nesting depends on the type.
    """
    if geojson:
        shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
        rows = _pages(spark, path, attributes, shape, "properties", opens).select("f.properties.*", F.col("f.geometry").alias("_g"))
        text = F.when(F.col("_g.type") == "LineString", F.concat(F.lit("["), F.col("_g.coordinates"), F.lit("]"))).otherwise(F.col("_g.coordinates"))
        rows = rows.where(F.col("_g.type").isin("LineString", "MultiLineString")).withColumn("_paths", F.from_json(text, LINES)).drop("_g")
    else:
        shape = T.StructType([T.StructField("paths", LINES)])
        rows = _pages(spark, path, attributes, shape, "attributes", opens).select("f.attributes.*", F.col("f.geometry.paths").alias("_paths"))
    return lines_to_pieces(rows.where(F.size("_paths") > 0), F.col("_paths")).drop("_paths")


def scan_polygon(spark: SparkSession, path: str, *, polygon: str = "polygon_id", opens: str | None = None) -> DataFrame:
    """Boundary features to edges (SRC3): one polygon id per feature, all its rings together.

    Ring parity makes holes; ``points_in_polygon`` unions the features.
    """
    shape = T.StructType([T.StructField("rings", LINES)])
    empty = T.StructType([])
    rows = _pages(spark, path, empty, shape, "attributes", opens).select(F.xxhash64(F.to_json("f.geometry")).alias(polygon), F.col("f.geometry.rings").alias("_r"))
    # the same feature on two pages must not cancel itself in the parity
    rows = rows.where(F.size("_r") > 0).dropDuplicates([polygon])
    return lines_to_pieces(rows, F.col("_r")).select(polygon, "x1", "y1", "x2", "y2")


def scan_points(spark: SparkSession, path: str, attributes: T.StructType, *, lon: str, lat: str, opens: str | None = None) -> DataFrame:
    """Point features: geometry first, attribute coordinates second, neither drops the row (SRC4)."""
    rows = _pages(spark, path, attributes, POINT, "attributes", opens).select("f.attributes.*", F.col("f.geometry").alias("_g"))
    out = rows.withColumns({"x": F.coalesce(F.col("_g.x"), F.col(lon)), "y": F.coalesce(F.col("_g.y"), F.col(lat))}).drop("_g")
    return out.where(F.col("x").isNotNull() & F.col("y").isNotNull())


TAGS = ("highway", "crossing", "crossing:markings", "crossing:signals", "footway")


def _elements(spark: SparkSession, path: str, opens: str | None = None) -> DataFrame:
    place = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    element = T.StructType(
        [
            T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
            T.StructField("center", place), T.StructField("geometry", T.ArrayType(place)), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    page = T.StructType([T.StructField("elements", T.ArrayType(element))])
    whole = cut_documents(spark, path, element, opens).select(F.col("item").alias("e")) if opens else spark.read.schema(page).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    rows = whole.select("e.*")
    tags = {t.split(":")[-1]: F.coalesce(F.try_element_at("tags", F.lit(t)), F.lit("")) for t in TAGS}
    return rows.withColumns(tags).drop("tags")


def scan_tagged(spark: SparkSession, path: str, *, opens: str | None = None) -> DataFrame:
    """Map elements as points (SRC5): nodes where they are, ways at their centre."""
    rows = _elements(spark, path, opens)
    node = F.col("type") == "node"
    out = rows.withColumns({"y": F.when(node, F.col("lat")).otherwise(F.col("center.lat")), "x": F.when(node, F.col("lon")).otherwise(F.col("center.lon"))})
    return out.where("x is not null and y is not null").drop("lat", "lon", "center", "geometry")


def scan_tagged_lines(spark: SparkSession, path: str, *, opens: str | None = None) -> DataFrame:
    """Ways with at least two vertices as pieces (SRC5)."""
    rows = _elements(spark, path, opens).where((F.col("type") == "way") & (F.size("geometry") >= 2))
    path_of = F.array(F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])))
    return lines_to_pieces(rows.withColumn("_paths", path_of).drop("lat", "lon", "center", "geometry"), F.col("_paths")).drop("_paths")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Incident CSV with a header (SRC6)."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def scan_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a Parquet table (SRC7)."""
    return spark.read.parquet(path).select(*columns)
