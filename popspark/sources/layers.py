"""Zone layers: GeoJSON in any layout, well-known text, and rings, all as one table of polygons.

A GeoJSON file is read in splits by Spark's text reader, cut at closing braces.  A first pass counts
quotes and braces of each split, so that sums over the splits before tell where it begins: within a
string or not, and how deep.  A second pass cuts out the features; only those that cross a split meet
by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import lv03_to_lv95, wgs84_to_lv95
from ..session import saved

SYSTEMS = {"lv95": ("2056",), "lv03": ("21781",), "wgs84": ("4326", "CRS84")}  # fixed values: codes of the coordinate systems

_TOKEN = re.compile(r'\\.|"features"\s*:\s*\[|["{}]', re.DOTALL)  # the second is a list of features, if it isn't within a string
_KEY = re.compile(r'"([^"\\]*)"\s*:\s*\Z')


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, Iterator[str]]]:
    """The rows of each split in turn: (first row's columns, whether the split begins, texts)."""
    last = None
    for batch in batches:
        rows = batch.to_pylist()
        start = 0
        while start < len(rows):
            key = rows[start]["file"], rows[start]["block"]
            stop = start
            while stop < len(rows) and (rows[stop]["file"], rows[stop]["block"]) == key:
                stop += 1
            yield rows[start], key != last, (r["value"] for r in rows[start:stop])
            last, start = key, stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, quotes, and after even and after odd numbers of quotes: braces opened less closed, and the least depth of a list of features."""
    found: dict[tuple, list] = {}
    for row, _, texts in _runs(batches):
        now = found.setdefault((row["file"], row["block"]), [0, 0, 0, None, None])
        for text in texts:
            for m in _TOKEN.finditer(text):
                c, odd = m.group(), now[0] % 2
                if c == '"':
                    now[0] += 1
                elif c in "{}":
                    now[1 + odd] += 1 if c == "{" else -1
                elif c[0] == '"':
                    now[3 + odd] = min(now[1 + odd], now[1 + odd] if now[3 + odd] is None else now[3 + odd])
            now[1 + now[0] % 2] -= 1  # the brace at which the text was cut
    cols = zip(*((*k, *v) for k, v in found.items()), strict=True) if found else [[]] * 7
    names = ["file", "block", "quotes", "even", "odd", "even_list", "odd_list"]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(cols)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, whole, key, text): the objects at the level of features, in parts where they cross splits.

    n is 0 for the part of an object that an earlier split began; a key names a member of the collection.
    """
    names = ["file", "block", "n", "whole", "key", "text"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    out: list[tuple] = []
    at, n, depth, level, odd, part, key = ("", 0), 0, 0, 0, 0, [], None

    def ended(whole: bool) -> None:
        if part:
            out.append((*at, n, whole and n > 0, key, "".join(part)))
            part.clear()

    for row, begins, texts in _runs(batches):
        if begins:
            ended(False)
            at, n, depth, level, odd, key = (row["file"], row["block"]), 0, row["depth"], row["listed"], row["odd"], None
        for value in texts:
            text, start = value + "}", 0
            for m in _TOKEN.finditer(text):
                c = m.group()
                if c == '"':
                    odd ^= 1
                elif odd or len(c) > 1:
                    continue
                elif c == "{":
                    if depth == level:
                        before = _KEY.search(text[start : m.start()]) if level else None
                        n, key, start = n + 1, before and before.group(1), m.start()
                    depth += 1
                else:
                    depth -= 1
                    if depth == level:
                        part.append(text[start : m.end()])
                        ended(True)
                        start = m.end()
            if depth > level:
                part.append(text[start:])
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
    ended(False)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, text): the features of GeoJSON files, whatever their layout, and the members of collections (with their key).

    A file is a collection, or holds features one after the other.  A file that ends within an object or a string is refused.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sizes = raw.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.sum(F.octet_length("value") + 1).alias("cut"))
    # What follows the last brace is no object, and has none.  Of a compressed file only its parts tell.
    more = F.col("cut") - F.col("size")
    sizes = sizes.select("file", F.when(more.isin(0, 1), more).alias("more"))
    counted = saved(rows.mapInArrow(_count, "file string, block long, quotes long, even long, odd long, even_list long, odd_list long"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("start", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    starts = starts.withColumn("change", F.when(F.col("start") == 0, F.col("even")).otherwise(F.col("odd")))
    starts = starts.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    here = F.col("depth") + F.when(F.col("start") == 0, F.col("even_list")).otherwise(F.col("odd_list"))
    starts = starts.withColumn("listed", F.coalesce(F.min(here).over(Window.partitionBy("file")) == 1, F.lit(False))).join(sizes, "file")
    starts = saved(starts.select("file", "block", F.col("start").cast("int").alias("odd"), F.col("depth").cast("int").alias("depth"), F.col("listed").cast("int").alias("listed"), "quotes", "change", "more"))
    ends = starts.groupBy("file").agg(F.sum("change").alias("open"), F.first("more").alias("more"), (F.sum("quotes") % 2).alias("within"))
    bad = ends.filter("within != 0 or open + more != 0 or (more is null and open not in (0, -1))").select("file").first()
    if bad:
        raise ValueError(f"{bad[0]} ends within an object or has a brace too many")
    state = F.broadcast(starts.select("file", "block", "odd", "depth", "listed"))  # a row for each split
    cut = saved(rows.join(state, ["file", "block"]).mapInArrow(_cut, "file string, block long, n long, whole boolean, key string, text string"))
    parts = cut.filter("not whole")
    begun = cut.groupBy("file", "block").agg(F.max("n").alias("begun"))
    base = F.coalesce(F.sum("begun").over(before), F.lit(0))
    numbered = parts.join(begun.select("file", "block", base.alias("base")), ["file", "block"]).withColumn("number", F.col("base") + F.col("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x.text), "")
    joined = numbered.groupBy("file", "number").agg(F.max("key").alias("key"), text.alias("text"))
    # Saved, as a strict parser is not to see parts of objects before they are filtered.
    return saved(cut.filter("whole").select("file", "key", "text").unionByName(joined.select("file", "key", "text")))


def _turned(ring: Column, hole: Column) -> Column:
    """The ring counter-clockwise, a hole clockwise."""
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    cross = F.transform(ring, lambda p, i: p[0] * F.get(ring, (i + 1) % F.size(ring))[1] - F.get(ring, (i + 1) % F.size(ring))[0] * p[1])
    area = F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)
    return F.when((area > 0) != hole, points).otherwise(F.reverse(points))


def _shifted(system: Column) -> Column:
    """The coordinates (an array of parts, rings, points) in LV95."""
    def point(p: Column) -> Column:
        x, y = p[0], p[1]
        old, ball = F.array(*lv03_to_lv95(x, y)), F.array(*wgs84_to_lv95(x, y))
        return F.when(system == "lv03", old).when(system == "wgs84", ball).otherwise(F.array(x, y))

    return F.transform("coordinates", lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def polygons(rows: DataFrame, crs: str | None = None) -> DataFrame:
    """zone_id, name, rings, parts, ring (the first part's outer one) and the box, of (zone_id, name, coordinates, system).

    Coordinates are arrays of parts, rings and points; they come out in LV95 from the system named by
    ``crs``, else by the row (null: as they are).  Points that lack a number, rings of less than three
    points and unknown systems are refused.
    """
    if crs and crs not in SYSTEMS:
        raise ValueError(f"unknown coordinate system {crs}")
    refuse = lambda why: F.raise_error(F.concat(F.lit(f"{why}: zone "), F.coalesce("zone_id", F.lit("without id")))).cast("array<array<array<array<double>>>>")
    broken = F.exists("coordinates", lambda part: (F.size(part) == 0) | F.exists(part, lambda ring: (F.size(ring) < 3) | F.exists(ring, lambda p: F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull())))
    rows = rows.withColumn("coordinates", F.when(F.coalesce(broken, F.lit(True)) | (F.size("coordinates") == 0), refuse("broken rings")).otherwise(F.col("coordinates")))
    system = F.lit(crs) if crs else F.col("system")
    rows = rows.withColumn("coordinates", F.when(system.isNull() | system.isin("lv95"), F.col("coordinates")).when(system.isin("lv03", "wgs84"), _shifted(system)).otherwise(refuse("unknown coordinate system")))
    rings = F.flatten(F.transform("coordinates", lambda part: F.transform(part, lambda r, i: _turned(r, i > 0))))
    out = rows.select("zone_id", "name", rings.alias("rings"), F.size("coordinates").alias("parts")).withColumn("ring", F.col("rings")[0])
    edge = lambda f, k: f(F.transform(F.flatten("rings"), lambda p: p[k]))
    return out.select("*", edge(F.array_min, "x").alias("min_x"), edge(F.array_max, "x").alias("max_x"), edge(F.array_min, "y").alias("min_y"), edge(F.array_max, "y").alias("max_y"))


def _system(name: Column) -> Column:
    """lv95, lv03 or wgs84 by a name that ends with a code; the name itself if it is another; null for null."""
    out = F.when(name.isNull(), F.lit(None))
    for system, codes in SYSTEMS.items():
        for code in codes:
            out = out.when(name.endswith(code), system)
    return out.otherwise(name)


def _parts(kind: Column, text: Column) -> Column:
    """Parts, rings and points of a geometry's coordinates; a polygon may come without its kind, then the depth tells."""
    many = "array<array<array<array<double>>>>"
    strict = {"mode": "FAILFAST"}
    one = F.array(F.from_json(text, "array<array<array<double>>>", strict))
    refused = F.raise_error(F.concat(F.lit("geometry of an unknown kind: "), F.coalesce(kind, F.lit("none")))).cast(many)
    deep = text.rlike(r"^\s*\[\s*\[\s*\[\s*\[")
    return F.when((kind == "MultiPolygon") | (kind.isNull() & deep), F.from_json(text, many, strict)).when((kind == "Polygon") | kind.isNull(), one).otherwise(refused)


def read_geojson(spark: SparkSession, path: str, id_field: str, name_field: str, crs: str | None = None) -> DataFrame:
    """A layer of GeoJSON polygons in any layout (a collection on one or many lines, or features one after the other).

    The coordinate system is ``crs``, else the collection's crs member, else coordinates stay as they are.
    Features with a null geometry are left out; broken ones, other geometries and truncated files are refused.
    """
    objects = read_objects(spark, path)
    named = objects.filter("key = 'crs'").select("file", F.get_json_object("text", "$.properties.name").alias("crs"))
    named = named.groupBy("file").agg(F.max("crs").alias("crs"))
    head = f"struct<type:string,properties:struct<`{id_field}`:string,`{name_field}`:string>,geometry:struct<type:string,coordinates:string>>"
    rows = objects.filter("key is null").withColumn("f", F.from_json("text", head, {"mode": "FAILFAST"}))
    # Objects in other lists of a collection are no features; a feature may lack its type.
    rows = rows.filter("f.geometry is not null and coalesce(f.type, 'Feature') = 'Feature'").join(named, "file", "left")
    properties = lambda field: F.col(f"f.properties.`{field}`")
    rows = rows.select(properties(id_field).alias("zone_id"), properties(name_field).alias("name"), _parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("coordinates"), _system(F.col("crs")).alias("system"))
    return polygons(rows, crs)


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def wkt_parts(text: Column) -> Column:
    """Parts, rings and points of POLYGON and MULTIPOLYGON texts; other kinds, and empty or broken ones, are refused."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^(]*(\(.*\))\s*$", 1), rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", '["$1","$2"]')
    body = F.when(body == "", "broken").otherwise(F.translate(body, "()", "[]"))
    strict = {"mode": "FAILFAST"}
    one, many = F.array(F.from_json(body, "array<array<array<string>>>", strict)), F.from_json(body, "array<array<array<array<string>>>>", strict)
    refused = F.raise_error(F.concat(F.lit("text of an unknown kind: "), kind)).cast("array<array<array<array<string>>>>")
    return F.when(kind == "POLYGON", one).when(kind == "MULTIPOLYGON", many).otherwise(refused).cast("array<array<array<array<double>>>>")


def read_wkt(spark: SparkSession, path: str, id_field: str, name_field: str, wkt_field: str = "wkt", sep: str = ";", crs: str | None = None) -> DataFrame:
    """A layer from a delimited file with a column of well-known text, with or without SRID=code; before it."""
    raw = spark.read.csv(path, header=True, sep=sep)
    text = F.col(f"`{wkt_field}`")
    code = F.nullif(F.regexp_extract(text, r"^\s*SRID=([0-9]+);", 1), F.lit(""))
    rows = raw.filter(text.isNotNull()).select(F.col(f"`{id_field}`").alias("zone_id"), F.col(f"`{name_field}`").alias("name"), wkt_parts(F.regexp_replace(text, r"^\s*SRID=[0-9]+;", "")).alias("coordinates"), _system(code).alias("system"))
    return polygons(rows, crs)


def from_rings(layer: DataFrame, crs: str | None = None) -> DataFrame:
    """A layer from zone_id, name and rings (arrays of struct<x, y>); each ring counts as a part."""
    parts = F.transform("rings", lambda ring: F.array(F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))))
    return polygons(layer.select(F.col("zone_id").cast("string").alias("zone_id"), F.col("name").cast("string").alias("name"), parts.alias("coordinates"), F.lit(None).cast("string").alias("system")), crs)
