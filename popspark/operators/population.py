"""Households, survey chains, activities and their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as c
from ..functions.scalar import uniform
from ..session import saved


def build_census(persons: DataFrame, link: DataFrame, households: DataFrame) -> DataFrame:
    return persons.join(link, ["person_id", "municipality_id"]).join(households, "household_id")


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(table, keys, "left")


def household_size(persons: DataFrame) -> DataFrame:
    return persons.withColumn("household_size", F.count("*").over(Window.partitionBy("household_id")))


def drop_minor_households(persons: DataFrame) -> DataFrame:
    oldest = F.max("age").over(Window.partitionBy("household_id"))
    return persons.withColumn("oldest", oldest).filter(F.col("oldest") >= c.MIN_AGE).drop("oldest")


def household_composition(members: DataFrame) -> DataFrame:
    a = F.col("age")
    under = [F.count_if((a >= 0) & (a < n)).alias(f"n_children_under_{n}") for n in (3, 6, 12, 18)]
    return members.groupBy("household_id").agg(*under, F.count_if(a >= 18).alias("n_adults"))


def flag_exists(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def household_flag(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Whether any member meets the condition."""
    return df.withColumn(name, F.max(condition).over(Window.partitionBy("household_id")))


def head_of_household(persons: DataFrame) -> DataFrame:
    """Adds head_id and is_head.

    Of the members of age the active ones before the others, then married ones before the others,
    then the oldest, male first, lowest id; all by one window over the household.
    """
    house = Window.partitionBy("household_id")
    adult = F.col("age") >= c.MIN_AGE
    any_active = F.max(adult & (F.col("age") <= c.ACTIVE_AGE)).over(house)
    df = persons.withColumn("eligible", adult & (~any_active | (F.col("age") <= c.ACTIVE_AGE)))
    married = F.col("marital_status") == c.MARRIED
    any_married = F.max(F.col("eligible") & married).over(house)
    df = df.withColumn("eligible", F.col("eligible") & (~any_married | married))
    order = F.when(F.col("eligible"), F.struct((-F.col("age")).alias("a"), F.col("sex").alias("b"), F.col("person_id").alias("c")))
    df = df.withColumn("head_id", F.min(order).over(house)["c"])
    return df.filter(F.col("head_id").isNotNull()).drop("eligible").withColumn("is_head", F.col("head_id") == F.col("person_id"))


def passenger_trips(stages: DataFrame, code: int = 8) -> DataFrame:
    return stages.groupBy("person_id", "trip_id").agg(F.sum((F.col("mode_code") == code).cast("long")).alias("passenger_stages"))


def parking_cost(stages: DataFrame) -> DataFrame:
    return stages.groupBy("person_id", "trip_id").agg(F.sum(F.greatest(F.lit(0), F.col("parking"))).alias("parking_cost"))


def activity_durations(trips: DataFrame, legacy: bool = False) -> DataFrame:
    """Time between a trip and the next one; ``legacy`` counts both trips in.  Null before a gap or the end."""
    w = Window.partitionBy("person_id").orderBy("trip_id")
    follows = F.lead("trip_id").over(w) == F.col("trip_id") + 1
    value = F.lead("arrival_time").over(w) - F.col("departure_time") if legacy else F.lead("departure_time").over(w) - F.col("arrival_time")
    return trips.withColumn("activity_duration", F.when(follows, value))


def reject_unknown(trips: DataFrame) -> DataFrame:
    return trips.filter((F.col("mode") == "unknown") | (F.col("purpose") == "unknown")).select("person_id").distinct()


def reject_not_ending_home(trips: DataFrame) -> DataFrame:
    last = trips.groupBy("person_id").agg(F.max_by("purpose", "trip_id").alias("purpose"))
    return last.filter(F.col("purpose") != "home").select("person_id")


def reject_not_starting_home(trips: DataFrame) -> DataFrame:
    away = (F.col("origin_x") != F.col("home_x")) | (F.col("origin_y") != F.col("home_y"))
    return trips.filter((F.col("trip_id") == 1) & away).select("person_id").distinct()


def drop_incomplete(trips: DataFrame, rejects: DataFrame) -> DataFrame:
    return trips.join(rejects, "person_id", "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def preceding_purpose(trips: DataFrame) -> DataFrame:
    before = F.lag("purpose").over(Window.partitionBy("person_id").orderBy("trip_id"))
    return trips.withColumn("preceding_purpose", F.coalesce(before, F.lit("home")))


def trip_index(trips: DataFrame) -> DataFrame:
    return trips.withColumn("trip_index", F.row_number().over(Window.partitionBy("person_id").orderBy("trip_id")) - 1)


def stage_index(stages: DataFrame) -> DataFrame:
    trip = Window.partitionBy("person_id", "trip_id")
    out = stages.withColumn("stage_id", F.row_number().over(trip.orderBy("stage_order"))).withColumn("number_of_stages", F.count("*").over(trip))
    return out.withColumn("is_first_stage", F.col("stage_id") == 1).withColumn("is_last_stage", F.col("stage_id") == F.col("number_of_stages"))


def transit_trips(stages: DataFrame) -> DataFrame:
    """Times and distances of a trip's access, transfer and vehicle stages, in one aggregate of
    ``stage_index`` rows; the wait before the first vehicle follows a first stage on foot."""
    vehicle = F.col("mode").isin("rail", "bus", "tram")
    ends = F.col("is_first_stage") | F.col("is_last_stage")
    parts = {"access_egress": ~vehicle & ends, "transfer": ~vehicle & ~ends, "in_vehicle": vehicle}
    sums = [F.sum(F.when(cond, F.col(value)).otherwise(0)).alias(f"{name}_{value}") for name, cond in parts.items() for value in ("travel_time", "routed_distance")]
    walked = F.max(F.when((F.col("stage_id") == 1) & ~vehicle, F.col("arrival_time")))
    boarded = F.max(F.when((F.col("stage_id") == 2) & vehicle, F.col("departure_time")))
    return stages.groupBy("person_id", "trip_id").agg(*sums, F.sum(vehicle.cast("long")).alias("vehicular_stages"), F.coalesce(boarded - walked, F.lit(0)).alias("first_waiting_time"))


def main_commute(trips: DataFrame, purpose: str = "work") -> DataFrame:
    """Each person's trip to the longest activity of the purpose; the first of equals."""
    w = Window.partitionBy("person_id").orderBy(F.col("activity_duration").desc_nulls_last(), "trip_id")
    return trips.filter(F.col("purpose") == purpose).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def chain_ends(trips: DataFrame) -> DataFrame:
    return trips.groupBy("person_id").agg(F.min_by("purpose", "trip_id").alias("first_purpose"), F.max_by("purpose", "trip_id").alias("last_purpose"))


def activities(trips: DataFrame) -> DataFrame:
    """Activities from trips: each begins with a trip's arrival; the first at home begins open.  Where
    trips have origins, x and y come along."""
    w = Window.partitionBy("person_id").orderBy("trip_index")
    place = [F.col("origin_x").alias("x"), F.col("origin_y").alias("y")] if "origin_x" in trips.columns else []
    return trips.select(
        "person_id", F.col("trip_index").alias("activity_index"), F.col("preceding_purpose").alias("purpose"),
        F.lag("arrival_time").over(w).alias("start_time"), F.col("departure_time").alias("end_time"), F.lit(False).alias("is_last"), *place,
    )


def closing_activity(trips: DataFrame) -> DataFrame:
    """The activity after each person's last trip, without an end."""
    w = Window.partitionBy("person_id").orderBy(F.col("trip_index").desc())
    last = trips.withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    place = [F.col("destination_x").alias("x"), F.col("destination_y").alias("y")] if "destination_x" in trips.columns else []
    return last.select("person_id", (F.col("trip_index") + 1).alias("activity_index"), F.col("following_purpose").alias("purpose"), F.col("arrival_time").alias("start_time"), F.lit(None).cast("long").alias("end_time"), F.lit(True).alias("is_last"), *place)


def without_trips(persons: DataFrame, trips: DataFrame) -> DataFrame:
    return persons.join(trips.select("person_id"), "person_id", "left_anti")


def complete_activities(acts: DataFrame, closing: DataFrame, persons: DataFrame) -> DataFrame:
    """All activities, and a day at home for persons without any."""
    home = without_trips(persons, acts).select("person_id", F.lit(0).alias("activity_index"), F.lit("home").alias("purpose"), F.lit(None).cast("long").alias("start_time"), F.lit(None).cast("long").alias("end_time"), F.lit(True).alias("is_last"))
    return acts.unionByName(closing).unionByName(home)


def link_indices(acts: DataFrame) -> DataFrame:
    """The trips before and after each activity."""
    i = F.col("activity_index")
    return acts.withColumn("preceding_trip_index", F.when(i > 0, i - 1)).withColumn("following_trip_index", F.when(~F.col("is_last"), i))


def expand_trips(persons: DataFrame, trips: DataFrame) -> DataFrame:
    """Every person takes over the trips of the survey person it is matched with.  A popular donor is
    a frequent key; adaptive execution broadcasts the survey where it is small, or splits that key."""
    return persons.join(trips, "mz_person_id")


def enrich(persons: DataFrame, households: DataFrame, survey: DataFrame) -> DataFrame:
    return persons.join(households, "mz_head_id").join(survey, "mz_person_id", "left")


def jitter_departures(trips: DataFrame, seed: int) -> DataFrame:
    """Shift each person's times by one uniform within half an hour or what lies before the first trip."""
    reach = F.least(F.lit(1800.0), F.min("departure_time").over(Window.partitionBy("person_id")).cast("double"))
    shift = uniform(seed, "departure", F.col("person_id")) * reach * 2 - reach
    return trips.withColumn("shift", shift).withColumn("departure_time", F.bround(F.col("departure_time") + F.col("shift"))).withColumn("arrival_time", F.bround(F.col("arrival_time") + F.col("shift"))).drop("shift")


def downsample(df: DataFrame, rate: float, seed: int, key: str = "household_id") -> DataFrame:
    """Whole households (or other keys) by a hash uniform; no shuffle."""
    return df.filter(uniform(seed, "sample", F.col(key)) < rate)


RANKED = 100_000  # rows that are ranked together, about


def ordered_ranks(df: DataFrame, by: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """Adds the rank (from 0) of each row in its group, in the order of the columns ``order`` (nulls first), and the group's ``size``.

    Rows are dealt out by ranges of the group and the order, so the rows of one group, be it the whole
    table, are ranked by many tasks; a range's ranks begin after those of the ranges before.  Rows that
    are equal in ``order`` are interchangeable, and one range takes all of them.
    """
    ranged = saved(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = [F.sum("__n").over(Window.partitionBy(*by)).alias(size)] if size else []
    counts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__of"), before.alias("__base"), *sizes)
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = ranged.withColumn(name, inside).join(counts, [*same, F.col("__part") == F.col("__of")])
    return out.withColumn(name, F.col("__base") + F.col(name)).drop("__part", "__of", "__base", *(f"__{c}" for c in by))


def ordered_sums(df: DataFrame, by: list[str], order: list[str], value: str, upto: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row in its group, in the order of the columns ``order``, and the group's ``total``.

    As in ``ordered_ranks`` the rows of one group are summed in ranges, to which the sums of the ranges before are added."""
    ranged = saved(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__of"), before.alias("__base"), F.sum("__sum").over(group).alias(total))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = ranged.withColumn(upto, inside).join(sums, [*same, F.col("__part") == F.col("__of")])
    return out.withColumn(upto, F.col("__base") + F.col(upto)).drop("__part", "__of", "__base", *(f"__{c}" for c in by))


def ranks(df: DataFrame, by: list[str], order: list[str], name: str, together: int = RANKED) -> DataFrame:
    """Adds the rank (from 0) of each row in its group: dense, in the order of a hash part and ``order``.

    A group of any size is ranked in parts, each of which begins after those before it; their number
    follows the table's rows.  Rows that are equal in ``order`` are interchangeable."""
    df = saved(df)
    parts = df.count() // together + 1
    df = df.withColumn("__part", F.floor(uniform(0, "rank", *map(F.col, order)) * parts))
    counts = df.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__of"), before.alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    same = [df[c].eqNullSafe(counts[f"__{c}"]) for c in by]
    out = df.withColumn(name, inside).join(counts, [*same, df["__part"] == counts["__of"]])
    return out.withColumn(name, F.col("__base") + F.col(name)).drop("__part", "__of", "__base", *(f"__{c}" for c in by))


def new_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids from 0, so that no task sorts the whole table."""
    return ranks(df, [], order, "new_id")


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def sorted_output(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted over all partitions: ranges of the keys, as many as the session's shuffle partitions."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
