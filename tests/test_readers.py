"""Large documents cut at their features, against the readers of whole documents."""

import json
import random

import pytest
from pyspark.sql import types as T

from curbline.sources import readers

SEG = T.StructType([T.StructField("seg_id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _names(rng):
    return rng.choice(['plain', 'says "Feature" and {"attributes"', "é漢字 \\ end", "", None])


def _write(path, document):
    path.write_text(json.dumps(document, separators=(",", ":"), ensure_ascii=False), encoding="utf-8")


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_one_collection_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    shape = lambda i: {"type": "LineString", "coordinates": [[i, 0.5], [i + 1, rng.random()]]} if i % 7 else None
    features = [{"type": "Feature", "properties": {"seg_id": i, "name": _names(rng)}, "geometry": shape(i)} for i in range(6000)]
    _write(tmp_path / "roads.json", {"type": "FeatureCollection", "features": features})
    cut = readers.scan_line_features(spark, str(tmp_path), SEG, geojson=True, opens=readers.GEOJSON)
    assert cut.rdd.getNumPartitions() > 4 and cut.count() == sum(1 for i in range(6000) if i % 7)
    assert _same(cut, readers.scan_line_features(spark, str(tmp_path), SEG, geojson=True))


def test_pages_points_rings_and_elements(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for k in range(2):
        (tmp_path / "pages").mkdir(exist_ok=True)
        _write(tmp_path / f"pages/{k}.json", {"name": "layer", "features": [{"attributes": {"seg_id": i, "name": _names(rng)}, "geometry": {"x": i, "y": 2.0} if i % 3 else None} for i in range(k * 2000, k * 2000 + 2000)], "more": False})
    pages = str(tmp_path / "pages")
    assert _same(readers.scan_feature_pages(spark, pages, SEG, opens=readers.PAGED), readers.scan_feature_pages(spark, pages, SEG))
    fields = T.StructType([*SEG.fields, T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
    assert _same(readers.scan_points(spark, pages, fields, lon="lon", lat="lat", opens=readers.PAGED), readers.scan_points(spark, pages, fields, lon="lon", lat="lat"))
    (tmp_path / "rings").mkdir()
    _write(tmp_path / "rings/1.json", {"features": [{"attributes": {}, "geometry": {"rings": [[[i, 0], [i + 1, 0], [i, 1], [i, 0]]]}} for i in range(30)]})
    assert _same(readers.scan_polygon(spark, str(tmp_path / "rings"), opens=readers.PAGED), readers.scan_polygon(spark, str(tmp_path / "rings")))
    (tmp_path / "map").mkdir()
    elements = [{"type": "node", "id": i, "lat": 1.5, "lon": i / 2, "tags": {"highway": "crossing"}} if i % 2 else {"type": "way", "id": i, "center": {"lat": 1, "lon": 2}, "geometry": [{"lat": 0, "lon": 0}, {"lat": 1, "lon": i}]} for i in range(800)]
    _write(tmp_path / "map/1.json", {"version": 1, "elements": elements})
    assert _same(readers.scan_tagged(spark, str(tmp_path / "map"), opens='{"type"'), readers.scan_tagged(spark, str(tmp_path / "map")))
    assert _same(readers.scan_tagged_lines(spark, str(tmp_path / "map"), opens='{"type"'), readers.scan_tagged_lines(spark, str(tmp_path / "map")))


def test_a_text_that_also_occurs_inside_an_item_is_reported(spark, tmp_path):
    _write(tmp_path / "bad.json", {"features": [{"attributes": {"seg_id": 1, "name": "a"}, "geometry": {"attributes": 5}}]})
    with pytest.raises(Exception, match="not a whole item"):
        readers.scan_feature_pages(spark, str(tmp_path), SEG, opens=readers.PAGED).collect()


def test_pages_lie_in_one_folder(spark, tmp_path):
    from pyspark.sql import functions as F

    from curbline.plans.road_queries import _PERSON, _write_pages
    from curbline.sources import readers

    rows = spark.range(5000).select(F.struct(F.col("id").alias("incident_id"), (F.col("id") * 3).alias("person_seq"), F.lit("Fatal").alias("injury"), (F.col("id") / 7).alias("lat")).alias("attributes"))
    path = tmp_path / "pages"
    _write_pages(rows, str(path))
    files = list(path.glob("*.json"))
    assert len(files) == 10 and not [p for p in path.iterdir() if p.is_dir()]
    assert all(f.read_text().count('"attributes"') < 1000 for f in files)
    back = readers.scan_feature_pages(spark, str(path), _PERSON).collect()
    assert sorted((r["incident_id"], r["person_seq"]) for r in back) == [(i, 3 * i) for i in range(5000)]
