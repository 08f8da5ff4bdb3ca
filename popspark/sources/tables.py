"""Readers and writers of the library's tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from .layers import read_geojson as read_zones  # noqa: F401

FEED_REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
FEED_OPTIONAL = ("calendar", "calendar_dates", "fare_attributes", "fare_rules", "shapes", "frequencies", "transfers", "pathways", "levels", "feed_info", "translations", "attributions")


def read_delimited(spark: SparkSession, path: str, fields: dict[str, str], renames: dict[str, str] | None = None, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The named columns of a file with a header, cast to the given types, under their new names."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    return raw.select(*(F.trim(F.col(f"`{c}`")).cast(kind).alias((renames or {}).get(c, c)) for c, kind in fields.items()))


def read_parts(spark: SparkSession, parts: list[tuple[str, str]], fields: dict[str, str], sep: str = ";") -> DataFrame:
    """Several files one below the other; each has its weights in a column of its own name."""
    return reduce(DataFrame.unionByName, [read_delimited(spark, path, {**fields, weight: "double"}, {weight: "weight"}, sep) for path, weight in parts])


def read_survey(spark: SparkSession, path: str, fields: dict[str, str], date: str | None = None) -> DataFrame:
    df = read_delimited(spark, path, fields | ({date: "string"} if date else {}), sep=",")
    return df.withColumn(date, F.to_date(date)) if date else df


ENTERPRISE_FIELDS = {"METER_X": "double", "METER_Y": "double", "NOGA08_CD": "string", "EMPTOT": "double"}  # fixed values: columns of the register
ENTERPRISE_NAMES = {"METER_X": "x", "METER_Y": "y", "NOGA08_CD": "noga", "EMPTOT": "number_employees"}


def read_enterprises(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The enterprise register: x, y, noga, number_employees and enterprise_id from 0 on.

    The id is the rank by all four columns: sorted ranges are numbered by themselves and begin after
    those before, so it doesn't depend on the file's parts, and no task sees the whole table.  Rows
    that are equal in all columns are interchangeable."""
    df = read_delimited(spark, path, ENTERPRISE_FIELDS, ENTERPRISE_NAMES, sep)
    order = [F.col(c).asc_nulls_first() for c in df.columns]
    ranged = saved(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("base"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(base), "part").select(*df.columns, (F.col("base") + F.col("rank")).alias("enterprise_id"))


FREIGHT_FILES = {"transport": "transport.csv", "journey": "journeych.csv", "week": "week.csv"}  # fixed values: files of the survey


def read_freight(spark: SparkSession, folder: str, files: dict[str, str] | None = None, sep: str = ";") -> dict[str, DataFrame]:
    """The freight survey's tables by name, all columns as text; a survey with one file is read alike."""
    return {name: spark.read.csv(f"{folder}/{file}", header=True, sep=sep) for name, file in (files or FREIGHT_FILES).items()}


def read_departure_times(spark: SparkSession, path: str, sep: str = ";", hour: str = "hour", share: str = "share") -> DataFrame:
    """The hourly shares of departures as intervals: hour, cdf_before, cdf (24 rows, so that one window sums them)."""
    rows = spark.read.csv(path, header=True, sep=sep).select(F.col(hour).cast("int").alias("hour"), F.col(share).cast("double").alias("share"))
    upto = F.sum("share").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("share").over(Window.partitionBy())
    return rows.select("hour", ((upto - F.col("share")) / total).alias("cdf_before"), (upto / total).alias("cdf"))


def read_projection(spark: SparkSession, path: str, year: int, year_col: str = "year", sep: str = ",") -> DataFrame:
    """The rows of one year; fails if there are none."""
    df = spark.read.csv(path, header=True, sep=sep).filter(F.col(year_col).cast("int") == year)
    if df.isEmpty():
        raise ValueError(f"{path} has no year {year}")
    return df


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the text files (or folders of parts) below a folder, relative to it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    root, found, todo = system.getFileStatus(hadoop).getPath().toString(), [], [hadoop]
    while todo:
        for status in system.listStatus(todo.pop()):
            path = status.getPath().toString()
            if path.endswith(".txt"):
                found.append(path[len(root) :].lstrip("/"))
            elif status.isDirectory():
                todo.append(status.getPath())
    return found


def feed_slots(names: list[str], where: str) -> dict[str, str]:
    """Which of the names is which slot: those beside agency.txt, in the outermost folder that has one.
    Fails without the required ones or without a calendar."""
    prefixes = sorted((n[: -len("agency.txt")] for n in names if n.endswith("agency.txt")), key=lambda p: (len(p), p))
    if not prefixes:
        raise ValueError(f"{where} has no transit feed")
    slots = {s: f"{prefixes[0]}{s}.txt" for s in (*FEED_REQUIRED, *FEED_OPTIONAL) if f"{prefixes[0]}{s}.txt" in names}
    missing = [s for s in FEED_REQUIRED if s not in slots]
    if missing or not {"calendar", "calendar_dates"} & set(slots):
        raise ValueError(f"{where} lacks {', '.join(missing) or 'a calendar'}")
    return slots


def read_feed(spark: SparkSession, path: str, unpacked: str | None = None) -> dict[str, DataFrame]:
    """A transit feed, from a folder or an archive (.zip): a table for each slot.

    The files may lie in a folder inside.  An archive cannot be read in parts, so it is unpacked in one
    stream, without being held, into the folder ``unpacked`` (shared by driver and executors; beside the
    archive by default), where it is read like any other feed."""
    if path.endswith(".zip"):
        target = unpacked or f"{path[:-4]}-unpacked"
        _unpack(spark, path, target)
        path = target
    slots = feed_slots(_files(spark, path), path)
    return {slot: spark.read.csv(f"{path}/{name}", header=True, ignoreLeadingWhiteSpace=True) for slot, name in slots.items()}


def _unpack(spark: SparkSession, path: str, folder: str) -> None:
    """The archive's feed files into the folder, streamed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    source = hadoop(path)
    stream = spark._jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while (entry := stream.getNextEntry()) is not None:
            name = entry.getName()
            if name.endswith(".txt") and ".." not in name.split("/"):
                target = hadoop(f"{folder}/{name}")
                out = target.getFileSystem(conf).create(target, True)
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                out.close()
    finally:
        stream.close()


def select_inputs(paths: list[str], pattern: str) -> str:
    """The last path (by name, so by date) whose name fits the pattern."""
    hits = sorted(p for p in paths if re.search(pattern, p.rsplit("/", 1)[-1]))
    if not hits:
        raise ValueError(f"nothing fits {pattern}")
    return hits[-1]


def write_population(tables: dict[str, DataFrame], folder: str, partition: str | None = None) -> None:
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("sep", ";").option("header", True)
        (out.partitionBy(partition) if partition and partition in df.columns else out).csv(f"{folder}/{name}")


def with_wkt(lines: DataFrame) -> DataFrame:
    """Adds a line as text."""
    return lines.withColumn("geometry", F.format_string("LINESTRING (%.3f %.3f, %.3f %.3f)", "ox", "oy", "dx", "dy"))


def write_spatial(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        (with_wkt(df) if {"ox", "oy", "dx", "dy"} <= set(df.columns) else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_feed(feed: dict[str, DataFrame], folder: str) -> None:
    """One file for each slot, with a header.  Tasks write parts without one, which are then joined under
    the header by the file system, so that no task holds a slot."""
    spark = next(iter(feed.values())).sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for slot in (*FEED_REQUIRED, *FEED_OPTIONAL):
        if slot not in feed:
            continue
        df, parts = feed[slot], f"{folder}/.{slot}"
        df.write.mode("overwrite").csv(parts)
        target = hadoop(f"{folder}/{slot}.txt")
        system = target.getFileSystem(conf)
        out = system.create(target, True)
        head = ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\n]', c) else c for c in df.columns)
        out.write(bytearray((head + "\n").encode()))
        for status in sorted(system.listStatus(hadoop(parts)), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = system.open(status.getPath())
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
        out.close()
        system.delete(hadoop(parts), True)


def person_plans(acts: DataFrame, trips: DataFrame, vehicles: DataFrame | None = None) -> DataFrame:
    """One row for each person: activities (with coordinates and facility, where ``acts`` has them) and
    legs in order (none: empty), and the person's vehicles by mode, as JSON.  acts: person_id, activity_index, purpose,
    start_time, end_time; trips: person_id, trip_index, mode, departure_time, arrival_time; vehicles:
    owner_id, mode, vehicle_id."""
    places = [c for c in ("x", "y", "facility_id") if c in acts.columns]
    a = acts.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("activity_index", "purpose", "start_time", "end_time", *places))).alias("activities"))
    t = trips.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("trip_index", "mode", "departure_time", "arrival_time"))).alias("legs"))
    out, parts = a.join(t, "person_id", "left").withColumn("legs", F.coalesce("legs", F.array())), ["activities", "legs"]
    if vehicles is not None:
        v = vehicles.groupBy(F.col("owner_id").alias("person_id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("mode", "vehicle_id")))).alias("vehicles"))
        out, parts = out.join(v, "person_id", "left"), [*parts, "vehicles"]
    return out.select("person_id", F.size("activities").alias("n_activities"), F.size("legs").alias("n_legs"), F.to_json(F.struct(*parts)).alias("plan"))


def household_export(persons: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """Households: members in order, income, and the class labels (columns of ``persons``) of the first member."""
    first = [F.min_by(c, "person_id").alias(c) for c in ("income", *labels)]
    return persons.groupBy("household_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("person_id")), lambda p: p.cast("string")), ",").alias("members"), *first)


def facility_export(destinations: DataFrame, homes: DataFrame) -> DataFrame:
    """What each facility offers, and a home facility for each household."""
    names = ("work", "education", "leisure", "shop", "other")
    offered = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"offers_{n}"), n) for n in names))), ",")
    places = destinations.select(F.col("destination_id").cast("string").alias("facility_id"), "x", "y", offered.alias("activities"))
    home = homes.select(F.concat_ws("", F.lit("home"), F.col("household_id").cast("string")).alias("facility_id"), "x", "y", F.lit("home").alias("activities")).dropDuplicates(["facility_id"])
    return places.unionByName(home)


def vehicle_export(types: DataFrame, vehicles: DataFrame) -> DataFrame:
    a = types.select(F.lit("type").alias("kind"), F.col("type_id").alias("id"), F.lit(None).cast("string").alias("type_id"))
    return a.unionByName(vehicles.select(F.lit("vehicle").alias("kind"), F.col("vehicle_id").alias("id"), "type_id"))


def freight_plans(trips: DataFrame) -> DataFrame:
    """Loading until the departure, unloading from an hour later (at most until 30 h)."""
    end = F.least(F.col("departure_time") + 3600, F.lit(108000))
    return trips.select("trip_id", F.to_json(F.array(F.struct(F.lit("loading").alias("type"), F.col("departure_time").alias("end_time")), F.struct(F.lit("unloading").alias("type"), end.alias("end_time")))).alias("plan"))
