"""Zone layers in every layout: features across lines and splits, well-known text, coordinate systems, broken files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from popspark.operators import spatial
from popspark.sources import layers

SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]
HOLED = [*SQUARE, [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]


def features(rng, n):
    out = []
    for k in range(n):
        many = k % 3 == 0
        shape = [[[[x + 20 * k, y] for x, y in ring] for ring in HOLED]]
        geometry = {"type": "MultiPolygon" if many else "Polygon", "coordinates": shape * 2 if many else shape[0]}
        name = rng.choice(['plain', 'with } brace', 'with { and "quotes"', "back\\slash\\", 'é日 "features": [', "a: b, {}"])
        parts = [("type", "Feature"), ("properties", {"code": k, "name": name, "more": {"list": [{"a": 1}, {}]}}), ("geometry", geometry)]
        rng.shuffle(parts)
        out.append(dict(parts))
    return out


def layouts(found):
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2056"}}, "bbox": [0, 0, 9, 9], "features": found, "tail": [{"x": 1}]}
    yield json.dumps(whole)
    yield json.dumps(whole, indent=3, ensure_ascii=False)
    yield json.dumps(whole, separators=(",", ":")) + "\n\n"
    yield "\n".join(json.dumps(f) for f in found)
    yield "\r\n".join(json.dumps(f, indent=1) for f in found) + "\r\n"
    turned = dict(reversed(whole.items()))
    turned["features"] = turned.pop("features")
    yield json.dumps({"features": found, "type": "FeatureCollection"})


@pytest.mark.parametrize("split", [None, 700])
def test_any_layout_in_any_split(spark, tmp_path, split):
    found = features(random.Random(3), 12)
    for k, text in enumerate(layouts(found)):  # a folder of files of several layouts is one layer
        (tmp_path / f"{k}.json").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        out = layers.read_geojson(spark, str(tmp_path), "code", "name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(str(f["properties"]["code"]), f["properties"]["name"], 2 if f["geometry"]["type"] == "MultiPolygon" else 1) for f in found]
    assert sorted((r.zone_id, r.name, r.parts) for r in out) == sorted(want * 6)
    assert all(len(r.rings) == 2 * r.parts and r.max_x - r.min_x == 10 for r in out)


@pytest.mark.parametrize("change", [lambda t: t[: len(t) // 2], lambda t: t[:-2], lambda t: t + "}", lambda t: t.replace("[10.0, 0.0]", "[10.0, ]", 1), lambda t: t.replace("[10.0, 0.0]", "[10.0]", 1), lambda t: t.replace('"Polygon"', '"Point"', 1), lambda t: t.replace('"Feature"', '"Feature', 1), lambda t: t.replace(json.dumps(SQUARE[0]), "[]", 1)])
def test_broken_files_are_refused(spark, tmp_path, change):
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"code": "a", "name": "b"}, "geometry": {"type": "Polygon", "coordinates": HOLED}}]})
    assert change(text) != text
    (tmp_path / "x.json").write_text(change(text))
    with pytest.raises(Exception):  # noqa: B017, PT011
        layers.read_geojson(spark, str(tmp_path / "x.json"), "code", "name").collect()


def test_features_without_geometry_and_empty_collections(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "b.json").write_text(json.dumps({"type": "Feature", "properties": None, "geometry": None}))
    for name in "ab":
        assert layers.read_geojson(spark, str(tmp_path / f"{name}.json"), "code", "name").collect() == []


def test_coordinate_systems(spark, tmp_path):
    def written(crs, points):
        whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"code": 1, "name": "n"}, "geometry": {"type": "Polygon", "coordinates": [points]}}]}
        if crs:
            whole["crs"] = {"type": "name", "properties": {"name": crs}}
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(whole))
        return str(path)

    ball = [[7.438637, 46.951082], [7.45, 46.951082], [7.45, 46.96]]
    (row,) = layers.read_geojson(spark, written("urn:ogc:def:crs:OGC:1.3:CRS84", ball), "code", "name").collect()
    assert abs(row.min_x - 2600000) < 60 and abs(row.min_y - 1200000) < 60
    (row,) = layers.read_geojson(spark, written(None, ball), "code", "name", crs="wgs84").collect()
    assert abs(row.min_x - 2600000) < 60
    (row,) = layers.read_geojson(spark, written("EPSG:21781", [[600000, 200000], [600010, 200000], [600010, 200010]]), "code", "name").collect()
    assert (row.min_x, row.max_y) == (2600010 - 10, 1200010)
    with pytest.raises(Exception, match="unknown coordinate system"):
        layers.read_geojson(spark, written("EPSG:3857", ball), "code", "name").collect()
    with pytest.raises(ValueError, match="unknown"):
        layers.read_geojson(spark, written(None, ball), "code", "name", crs="mars")


def test_well_known_text(spark, tmp_path):
    rows = [
        ("1", "a", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"),
        ("2", "b", "SRID=21781;multipolygon(((0 0 5,1e1 0. 5,10 .5 5)),((+20 -0,30 0,30 10)))"),
        ("3", "c", "POLYGON Z ((0 0 1, 10 0 1, 10 10 1))"),
    ]
    (tmp_path / "z.csv").write_text("id|label|shape\n" + "".join(f"{a}|{b}|{c}\n" for a, b, c in rows))
    out = {r.zone_id: r for r in layers.read_wkt(spark, str(tmp_path / "z.csv"), "id", "label", "shape", "|").collect()}
    assert (out["1"].parts, len(out["1"].rings), out["1"].max_x) == (1, 2, 10)
    assert (out["2"].parts, out["2"].min_x, out["2"].max_x) == (2, 2000000, 2000030)
    assert (out["3"].parts, len(out["3"].ring)) == (1, 3)
    for text in ("POLYGON ((0 0, 10 0, 10 10)", "POLYGON EMPTY", "POINT (1 2)", "POLYGON ((0 0, 1 1, 2))", "POLYGON ((0 0, x y, 2 2))", "MULTIPOLYGON ((0 0, 1 1, 2 3))"):
        (tmp_path / "bad.csv").write_text(f"id;label;shape\n1;a;{text}\n")
        with pytest.raises(Exception):  # noqa: B017, PT011
            layers.read_wkt(spark, str(tmp_path / "bad.csv"), "id", "label", "shape").collect()


def test_rings_are_a_layer(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in SQUARE[0]))
    out = layers.from_rings(spark.range(1).select(F.col("id").alias("zone_id"), F.lit("n").alias("name"), F.array(ring).alias("rings")))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 5.0)], "point_id long, x double, y double")
    assert {r.point_id: r.zone_id for r in spatial.point_in_zone(points, out).collect()} == {1: "0", 2: None}
