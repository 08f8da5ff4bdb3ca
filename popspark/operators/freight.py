"""Freight legs, demand and trips; transit feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from .population import ordered_ranks, ranks

WEEKDAYS = (1, 2, 3, 4, 5)


def freight_legs(transport: DataFrame, journey: DataFrame, week: DataFrame) -> DataFrame:
    return transport.join(journey, ["agent_id", "journey_id"]).join(week, "agent_id")


def distinct_legs(legs: DataFrame) -> DataFrame:
    """The first leg of each origin and destination within a journey."""
    w = Window.partitionBy("agent_id", "journey_id", "from_id", "to_id").orderBy("leg_order")
    return legs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def loading_legs(legs: DataFrame) -> DataFrame:
    """Tours that load in several places: a leg begins where the one before ended, and is as long as the
    load's way has grown; the first one as it stands."""
    w = Window.partitionBy("agent_id", "journey_id").orderBy("leg_order")
    return legs.select("agent_id", "journey_id", "leg_order", F.coalesce(F.lag("to_id").over(w), "from_id").alias("origin_id"), F.col("to_id").alias("destination_id"), (F.col("km") - F.coalesce(F.lag("km").over(w), F.lit(0))).alias("distance_km"))


def unloading_legs(legs: DataFrame) -> DataFrame:
    """Tours that unload in several places: a leg ends where the next one begins; the last as it stands."""
    w = Window.partitionBy("agent_id", "journey_id").orderBy("leg_order")
    return legs.select("agent_id", "journey_id", "leg_order", F.col("from_id").alias("origin_id"), F.coalesce(F.lead("from_id").over(w), "to_id").alias("destination_id"), (F.col("km") - F.coalesce(F.lead("km").over(w), F.lit(0))).alias("distance_km"))


def freight_demand(legs: DataFrame, growth: float = 1.0) -> DataFrame:
    """Trips on a working day by vehicle type: weights over weeks and weekdays, times the growth."""
    days = legs.filter(F.col("weekday").isin(*WEEKDAYS))
    weeks = days.agg(F.countDistinct("week").alias("weeks"))
    sums = days.groupBy("vehicle_type").agg(F.sum("weight").alias("weight"))
    return sums.join(F.broadcast(weeks)).select("vehicle_type", (F.bround(F.col("weight") / F.col("weeks") / len(WEEKDAYS)) * growth).alias("demand"))


def freight_scaling(observed: list[DataFrame], projected: DataFrame, kind: str = "truck") -> DataFrame:
    """Projected over observed vehicle kilometres, as one row."""
    total = reduce(DataFrame.unionByName, [o.select("distance_km", "weight") for o in observed]).agg(F.sum(F.col("distance_km") * F.col("weight")).alias("km"))
    return projected.filter(F.col("type") == kind).join(F.broadcast(total)).select((F.col("vehicle_km") / F.col("km")).alias("factor"))


def project_linear(df: DataFrame, years: tuple[int, ...], year: int, scale: float = 1e6) -> DataFrame:
    """The trend through the years' columns at another year, in whole units and not below 0."""
    long = df.unpivot("type", [F.col(str(y)) for y in years], "year", "value").select("type", F.col("year").cast("int"), "value")
    fit = long.groupBy("type").agg(F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("base"))
    return fit.select("type", F.greatest(F.lit(0.0), F.bround(F.round(F.col("slope") * year + F.col("base"), 6)) * scale).alias("vehicle_km"))


def freight_departures(trips: DataFrame, hourly: DataFrame, seed: int) -> DataFrame:
    """An hour by the hourly shares and a second within it.  hourly: hour, cdf_before, cdf (24 rows)."""
    u = uniform(seed, "hour", F.col("trip_id"))
    second = F.floor(uniform(seed, "second", F.col("trip_id")) * 3600)
    drawn = trips.withColumn("__u", u).join(F.broadcast(hourly), (F.col("__u") >= F.col("cdf_before")) & (F.col("__u") < F.col("cdf")))
    return drawn.select("trip_id", (F.col("hour") * 3600 + second).alias("departure_time"))


def freight_locations(trips: DataFrame, enterprises: DataFrame, zone_col: str, seed: int, salt: str) -> DataFrame:
    """A place of the zone for each trip, all with the same chance: ranks within zones by id, and a pick by hash."""
    ranked = ordered_ranks(enterprises.select("zone_id", "enterprise_id", "x", "y"), ["zone_id"], ["enterprise_id"], "rank")
    return _picked(trips, enterprises, ranked, zone_col, seed, salt)


def _picked(trips: DataFrame, enterprises: DataFrame, ranked: DataFrame, zone_col: str, seed: int, salt: str) -> DataFrame:
    many = enterprises.groupBy("zone_id").agg(F.count("*").alias("many"))
    picked = trips.join(many, trips[zone_col] == many["zone_id"]).withColumn("rank", F.floor(uniform(seed, salt, F.col("trip_id")) * F.col("many")))
    return picked.join(ranked, ["zone_id", "rank"]).select("trip_id", "zone_id", "enterprise_id", "x", "y")


def freight_places(trips: DataFrame, enterprises: DataFrame, levels: list[str], borders: DataFrame, zone_col: str, country: str, seed: int, salt: str) -> DataFrame:
    """Where each trip (trip_id and a zone id in ``zone_col``) begins or ends: trip_id, zone_id, enterprise_id, x, y.

    A zone of the country, at any level, gets one of its enterprises (``levels``: their columns with
    the zone ids of each level), all with the same chance; a zone abroad the border point that is
    nearest to its centre (borders: zone_id, border_x, border_y, as from ``spatial.border_points``).  A
    trip in a zone without an enterprise, abroad without a border point, or without a zone has null x and y."""
    own = F.contains(F.col(zone_col), F.lit(country))
    # A row for each enterprise and level; ids tell their level by their length.
    at = enterprises.select("enterprise_id", "x", "y", F.explode(F.array(*levels)).alias("zone_id")).filter("zone_id is not null")
    # A level above the zones has all enterprises in few ids; their order here is that of hash parts.
    inside = _picked(trips.filter(own), at, ranks(at.select("zone_id", "enterprise_id", "x", "y"), ["zone_id"], ["enterprise_id"], "rank"), zone_col, seed, salt)
    abroad = trips.filter(~own).join(borders, trips[zone_col] == borders["zone_id"])
    kind = enterprises.schema["enterprise_id"].dataType
    placed = inside.unionByName(abroad.select("trip_id", "zone_id", F.lit(None).cast(kind).alias("enterprise_id"), F.col("border_x").alias("x"), F.col("border_y").alias("y")))
    lost = trips.join(placed.select("trip_id"), "trip_id", "left_anti").select("trip_id", F.col(zone_col).alias("zone_id"))
    return placed.unionByName(lost, allowMissingColumns=True)


# Transit feeds: a dict of slot name to table.

# The identifiers of the public feed format and the columns that refer to them.
REFERENCES = {
    "agency": ("agency_id", (("routes", "agency_id"), ("fare_attributes", "agency_id"), ("attributions", "agency_id"))),
    "levels": ("level_id", (("stops", "level_id"),)),
    "stops": ("stop_id", (("stops", "parent_station"), ("stop_times", "stop_id"), ("transfers", "from_stop_id"), ("transfers", "to_stop_id"), ("pathways", "from_stop_id"), ("pathways", "to_stop_id"))),
    "routes": ("route_id", (("trips", "route_id"), ("fare_rules", "route_id"), ("attributions", "route_id"))),
    "shapes": ("shape_id", (("trips", "shape_id"),)),
    "trips": ("trip_id", (("stop_times", "trip_id"), ("frequencies", "trip_id"), ("attributions", "trip_id"))),
    "calendar": ("service_id", (("calendar_dates", "service_id"), ("trips", "service_id"))),
    "calendar_dates": ("service_id", (("calendar", "service_id"), ("trips", "service_id"))),
    "fare_attributes": ("fare_id", (("fare_rules", "fare_id"),)),
    "pathways": ("pathway_id", ()),
    "attributions": ("attribution_id", ()),
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

Feed = dict[str, DataFrame]


def drop_empty_service(feed: Feed) -> Feed:
    return {k: df.filter(F.length("service_id") > 0) if "service_id" in df.columns else df for k, df in feed.items()}


def feed_defaults(feed: Feed) -> Feed:
    out = dict(feed)
    if "stops" in out:
        stops = out["stops"]
        stops = stops if "parent_station" in stops.columns else stops.withColumn("parent_station", F.lit(None).cast("string"))
        out["stops"] = stops.withColumn("location_type", F.coalesce(F.col("location_type").cast("int"), F.lit(0))).withColumn("parent_station", F.coalesce("parent_station", F.lit("")))
    if "transfers" in out:
        t = out["transfers"]
        t = t if "min_transfer_time" in t.columns else t.withColumn("min_transfer_time", F.lit(0))
        out["transfers"] = t.filter(F.col("min_transfer_time").isNotNull())
    if "agency" in out:
        out["agency"] = out["agency"].withColumn("agency_id", F.coalesce("agency_id", F.lit("generic")))
        if "routes" in out:
            routes = out["routes"] if "agency_id" in out["routes"].columns else out["routes"].withColumn("agency_id", F.lit(None).cast("string"))
            one = out["agency"].agg(F.min("agency_id").alias("__one"))
            out["routes"] = routes.join(F.broadcast(one)).withColumn("agency_id", F.coalesce("agency_id", "__one")).drop("__one")
    out.pop("shapes", None)
    if "trips" in out:
        out["trips"] = out["trips"].withColumn("shape_id", F.lit(None).cast("string"))
    return {k: df.drop(*(c for c in df.columns if c.startswith("ext_"))) for k, df in out.items()}


def clean_references(feed: Feed) -> Feed:
    out, stops = dict(feed), feed["stops"].select("stop_id")
    out["stop_times"] = out["stop_times"].join(stops, "stop_id", "left_semi")
    for slot in ("transfers", "pathways"):
        if slot in out:
            for side in ("from_stop_id", "to_stop_id"):
                out[slot] = out[slot].join(stops.withColumnRenamed("stop_id", side), side, "left_semi")
    return out


def drop_single_stop_trips(feed: Feed) -> Feed:
    out = dict(feed)
    many = feed["stop_times"].groupBy("trip_id").agg(F.count("*").alias("n")).filter("n > 1").select("trip_id")
    kept = feed["trips"].join(many, "trip_id", "left_semi")
    out["trips"] = kept
    for slot in ("stop_times", "frequencies"):
        if slot in out:
            out[slot] = out[slot].join(kept.select("trip_id"), "trip_id", "left_semi")
    return out


def rename_ids(feed: Feed, slot: str, renamed: DataFrame) -> Feed:
    """New ids (old_id, new_id) in the slot and wherever others refer to it."""
    out, (key, references) = dict(feed), REFERENCES[slot]
    for name, column in ((slot, key), *references):
        if name in out and column in out[name].columns:
            df = out[name].join(renamed, out[name][column] == renamed["old_id"], "left")
            out[name] = df.withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")
    return out


def despace_stop_ids(feed: Feed, replacement: str = ":::") -> Feed:
    spaced = feed["stops"].select(F.col("stop_id").alias("old_id")).distinct().filter(F.col("old_id").contains(" "))
    return rename_ids(feed, "stops", spaced.withColumn("new_id", F.replace("old_id", F.lit(" "), F.lit(replacement))))


def merge_feeds(first: Feed, second: Feed, suffix: str = "_merged") -> Feed:
    """Both feeds' rows; an id with several rows among both gets the suffix in the second, and wherever
    that refers to it.  Slots without the identifier are merged as they are."""
    for slot, (key, _) in REFERENCES.items():
        if all(slot in f and key in f[slot].columns for f in (first, second)):
            both = first[slot].unionByName(second[slot], allowMissingColumns=True).distinct()
            twice = both.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("old_id"))
            second = rename_ids(second, slot, twice.withColumn("new_id", F.concat("old_id", F.lit(suffix))))
    out = {}
    for slot in {**first, **second}:
        tables = [f[slot] for f in (first, second) if slot in f]
        out[slot] = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True).distinct()
    return out


def merge_all(feeds: list[Feed]) -> Feed:
    """Any number of feeds, one after the other; colliding ids of the k-th get the suffix _m<k>."""
    out = feeds[0]
    for k, feed in enumerate(feeds[1:], 2):
        out = merge_feeds(out, feed, f"_m{k}")
    return out


def order_days(feed: Feed) -> Feed:
    """The calendar's weekdays as its last columns, from monday on."""
    out = dict(feed)
    if "calendar" in out:
        df = out["calendar"]
        out["calendar"] = df.select(*(c for c in df.columns if c not in DAYS), *(d for d in DAYS if d in df.columns))
    return out
