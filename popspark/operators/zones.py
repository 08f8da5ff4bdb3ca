"""Zone systems, identifiers, origin-destination tables and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .population import ordered_ranks, ordered_sums

NO_GEOMETRY = 800_000.0  # metres between zones of which one has no shape


def zone_system(levels: dict[str, DataFrame]) -> DataFrame:
    """One table of all levels (each with id and name): zone_level, zone_level_id, zone_name and a dense
    zone_id; the table has a row for each zone, so one window numbers it."""
    parts = [df.select(F.lit(level).alias("zone_level"), F.col("id").cast("string").alias("zone_level_id"), "name") for level, df in levels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.orderBy("zone_level", "zone_level_id")
    return out.select((F.row_number().over(w) - 1).cast("long").alias("zone_id"), "zone_level", "zone_level_id", F.col("name").alias("zone_name"))


def latest_vintage(layers: DataFrame, key: str, year: str = "year") -> DataFrame:
    return layers.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(year).desc()))).filter("__r = 1").drop("__r")


def update_ids(df: DataFrame, mapping: DataFrame, key: str, drop_unknown: bool = False) -> DataFrame:
    """Current ids for deprecated ones (mapping: old_id, new_id); unknown ids stay, or go."""
    out = df.join(mapping, df[key] == mapping["old_id"], "left")
    if drop_unknown:
        out = out.filter(F.col("new_id").isNotNull())
    return out.withColumn(key, F.coalesce("new_id", key)).drop("old_id", "new_id")


def impute_zone(df: DataFrame, zones: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The zone of the first level that has the row's id; keys: (level, column), first come first."""
    names = []
    for level, column in keys:
        own = zones.filter(F.col("zone_level") == level).select(F.col("zone_level_id").alias(f"__{level}"), F.col("zone_id").alias(f"__zone_{level}"))
        df = df.join(own, df[column].cast("string") == own[f"__{level}"], "left").drop(f"__{level}")
        names.append(f"__zone_{level}")
    return df.withColumn("zone_id", F.coalesce(*names)).drop(*names)


def zone_shapes(zones: DataFrame, shapes: dict[str, DataFrame]) -> DataFrame:
    out = None
    for level, df in shapes.items():
        part = zones.filter(F.col("zone_level") == level).join(df.withColumn("zone_level_id", F.col("id").cast("string")).drop("id", "name"), "zone_level_id")
        out = part if out is None else out.unionByName(part)
    return out


def zone_distances(zones: DataFrame, centroids: DataFrame) -> DataFrame:
    """Distances between all zones: a row for each pair, as the result has one, so this is for zones (some
    thousands), not for places; zones without a centroid are far from all others."""
    placed = zones.select("zone_id").join(centroids, "zone_id", "left")
    a = placed.select(F.col("zone_id").alias("origin_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    b = placed.select(F.col("zone_id").alias("destination_id"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    d = F.hypot(F.col("ox") - F.col("dx"), F.col("oy") - F.col("dy"))
    return a.crossJoin(b).select("origin_id", "destination_id", F.coalesce(d, F.lit(NO_GEOMETRY)).alias("distance"))


def od_weights(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(weight).alias("weight"))


def od_pdf(od: DataFrame, origins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Probabilities by origin; an origin without demand stays with itself.  ``origins``: all of them
    (with the columns of ``by``)."""
    by = by or []
    key = [*by, "origin_id"]
    known = od.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy(*key))).filter("weight > 0")
    empty = origins.join(known.select(*key).distinct(), key, "left_anti")
    stay = empty.select(*key, F.col("origin_id").alias("destination_id"), F.lit(0).cast(known.schema["weight"].dataType).alias("weight"), F.lit(1.0).alias("probability"))
    return known.select(*key, "destination_id", "weight", "probability").unionByName(stay)


def origin_pdf(od: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    sums = od.groupBy(*by, "origin_id").agg(F.sum("weight").alias("weight"))
    return sums.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)))


def weighted_cdf(df: DataFrame, by: list[str], order: list[str], weight: str = "weight", ranged: bool = False) -> DataFrame:
    """Cumulative share of the weight in the order within each group: (cdf_before, cdf].

    ``ranged``: a group is summed by many tasks, in ranges of the order, so it may hold most of the rows; else by one."""
    if ranged:
        x = ordered_sums(df, by, order, weight, "__upto", "__total")
        return x.withColumn("cdf", F.col("__upto") / F.col("__total")).withColumn("cdf_before", (F.col("__upto") - F.col(weight)) / F.col("__total")).drop("__upto", "__total")
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cdf", upto / F.sum(weight).over(w)).withColumn("cdf_before", (upto - F.col(weight)) / F.sum(weight).over(w))


def weighted_draw(df: DataFrame, u: Column, cells: DataFrame, keys: list[str], bins: int | Column = 64) -> DataFrame:
    """For each row the entry of its cell whose interval of the CDF holds the row's uniform.

    Rows and entries meet in ``bins`` equal parts of the uniform, so a row meets about a part of its
    cell's entries, and the rows of one large cell are dealt out.  An entry is in each part that its
    interval touches: a cell has at most ``bins`` rows more than entries.  ``bins`` may depend on the keys."""
    bins = bins if isinstance(bins, Column) else F.lit(bins)
    part = lambda x: F.least(F.floor(x * bins), bins - 1)
    spread = cells.withColumn("__bin", F.explode(F.sequence(part(F.col("cdf_before")), part(F.col("cdf")))))
    rows = df.withColumn("__u", u).withColumn("__bin", part(F.col("__u")))
    return rows.join(spread, [*keys, "__bin"]).filter((F.col("__u") >= F.col("cdf_before")) & (F.col("__u") < F.col("cdf"))).drop("__u", "__bin")


def commuters(df: DataFrame) -> DataFrame:
    return df.groupBy("home_zone_id", "mode").agg(F.count("*").alias("commuters"))


def work_demand(df: DataFrame, zones: DataFrame) -> DataFrame:
    return df.groupBy("work_zone_id").agg(F.count("*").alias("demand")).join(zones.select(F.col("zone_id").alias("work_zone_id"), "zone_level"), "work_zone_id")


def apportion(pdf: DataFrame, totals: DataFrame) -> DataFrame:
    """Whole numbers by the largest remainders that sum to each origin's total."""
    x = pdf.join(totals, "origin_id").withColumn("share", F.col("probability") * F.col("total"))
    x = x.withColumn("whole", F.floor(F.round("share", 9))).withColumn("rest", F.round(F.col("share") - F.col("whole"), 9))
    w = Window.partitionBy("origin_id")
    x = x.withColumn("left", F.col("total") - F.sum("whole").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("rest").desc(), "destination_id")))
    return x.select("origin_id", "destination_id", (F.col("whole") + (F.col("rank") <= F.col("left")).cast("long")).alias("count"))


def expand_counts(counts: DataFrame, count: str = "count") -> DataFrame:
    return counts.filter(F.col(count) > 0).withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop(count)


RANKS = 1000  # ranks that meet the destinations together


def order_commuters(df: DataFrame) -> DataFrame:
    """Rank (from 1) of each person by commute distance within its zone and mode; a zone's persons are ranked in ranges."""
    return ordered_ranks(df, ["mode", "home_zone_id"], ["commute_distance", "person_id"], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def pair_by_rank(persons: DataFrame, counts: DataFrame) -> DataFrame:
    """Persons by commute distance meet destinations by zone distance: the ranks fall into the
    destinations' cumulative counts.  They meet by RANKS of them, so a large zone's persons are dealt
    out, and each meets the destinations of its part only."""
    w = Window.partitionBy("mode", "origin_id").orderBy("distance", "destination_id").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.filter("count > 0").withColumn("upto", F.sum("count").over(w)).withColumn("after", F.col("upto") - F.col("count"))
    part = lambda rank: F.floor((rank - 1) / RANKS).cast("long")
    steps = steps.withColumn("part", F.explode(F.sequence(part(F.col("after") + 1), part(F.col("upto")))))
    ranked = order_commuters(persons).withColumnRenamed("home_zone_id", "origin_id").withColumn("part", part(F.col("rank")))
    met = ranked.join(steps.select("mode", "origin_id", "part", "destination_id", "upto", "after"), ["mode", "origin_id", "part"])
    return met.filter("rank > after and rank <= upto").select("person_id", "mode", "origin_id", "destination_id")
