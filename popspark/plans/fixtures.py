"""Adapter from the given tables onto the library's input shapes.

Each shape is one SQL text over given tables and earlier shapes, in integer arithmetic, that Spark
and DuckDB both run ("//" is integer division, which Spark calls div).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SHAPES = {
    "persons": """
SELECT person_id, household_id, age, sex, marital_code, nationality, household_id * 7919 % 100000 AS home_x, household_id * 104729 % 100000 AS home_y,
  municipality_id, 1 + municipality_id AS canton_id, population_type, type_of_residence
FROM (SELECT c_custkey AS person_id, (c_custkey // 30) * 10 + CASE WHEN c_custkey % 30 < 1 THEN 0 WHEN c_custkey % 30 < 3 THEN 1 WHEN c_custkey % 30 < 6 THEN 2
    WHEN c_custkey % 30 < 10 THEN 3 WHEN c_custkey % 30 < 17 THEN 4 ELSE 5 END AS household_id,
  (c_custkey * 37 + 11) % 91 AS age, 1 + c_custkey % 2 AS sex, 1 + (c_custkey * 5) % 7 AS marital_code, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS nationality,
  c_nationkey AS municipality_id, CASE WHEN c_custkey % 17 = 0 THEN 2 ELSE 1 END AS population_type, CASE WHEN c_custkey % 19 = 0 THEN 2 ELSE 1 END AS type_of_residence
  FROM {customer})""",
    "survey": """
SELECT person_id, age, person_id % 2 AS sex, 1 + person_id % 9 AS income_code, person_id % 6 - 1 AS cars, person_id % 4 AS number_of_bikes, 1 + person_id % 5 AS household_size,
  1 + person_id % 7 AS weekday, person_id % 3 AS license_code, 1 + person_id % 4 AS car_code, CASE WHEN person_id % 6 = 0 THEN -99 ELSE person_id % 7 END AS work_code,
  CASE WHEN person_id % 8 = 0 THEN 32 ELSE 0 END AS job_a, CASE WHEN person_id % 11 = 0 THEN 32 ELSE 0 END AS job_b, CASE WHEN person_id % 5 = 0 THEN 32 ELSE 0 END AS study_a, 0 AS study_b,
  person_id % 21 - 1 AS education_code, person_id % 5 AS parking_code, person_id % 9 - 3 AS parking_fee, person_id % 4 = 0 AS subscriptions_ga, person_id % 9 = 0 AS subscriptions_ga_class,
  person_id % 3 = 0 AS subscriptions_halbtax, person_id % 5 = 0 AS subscriptions_verbund, person_id % 7 = 0 AS subscriptions_verbund_class, 1 + person_id % 5 AS weight, canton_id
FROM {persons} WHERE person_id % 3 = 0""",
    "donors": """
SELECT person_id AS donor_id, person_id % 4 AS number_of_cars_class, age // 15 AS age_class, sex, municipality_id AS region, 1 + person_id % 5 AS weight FROM {persons} WHERE person_id % 10 = 0""",
    "trips": """
SELECT person_id, trip_id, order_id, mode, purpose, mode_code, purpose_code, way_code, (300 + 60 * trip_id) * 60 AS departure_time, (305 + 60 * trip_id + order_id % 50) * 60 AS arrival_time,
  (5 + order_id % 50) * 60 AS travel_time, order_id * 7919 % 100000 AS origin_x, order_id * 104729 % 100000 AS origin_y, order_id * 6007 % 100000 AS destination_x, order_id * 3571 % 100000 AS destination_y,
  order_id * 31 % 40000 AS distance, 1 + order_id % 5 AS weight
FROM (SELECT o_custkey AS person_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS trip_id, o_orderkey AS order_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'car' WHEN '2' THEN 'pt' WHEN '3' THEN 'bike' WHEN '4' THEN 'walk' ELSE 'car_passenger' END AS mode,
  CASE o_orderkey % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'work' WHEN 2 THEN 'education' WHEN 3 THEN 'shop' WHEN 4 THEN 'leisure' ELSE 'other' END AS purpose,
  CASE WHEN o_orderkey % 19 = 0 THEN -99 ELSE 1 + o_orderkey % 17 END AS mode_code, CASE WHEN o_orderkey % 23 = 0 THEN -98 ELSE 1 + o_orderkey % 13 END AS purpose_code, o_orderkey % 3 AS way_code FROM {orders})""",
    "stages": """
SELECT person_id, trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS stage_order, 1 + l_suppkey % 12 AS mode_code,
  CASE 1 + l_suppkey % 12 WHEN 1 THEN 'walk' WHEN 9 THEN 'rail' WHEN 10 THEN 'bus' WHEN 11 THEN 'bus' WHEN 12 THEN 'tram' ELSE 'other' END AS mode,
  l_partkey % 9 - 3 AS parking, (l_partkey % 30) * 60 AS travel_time, 1000 * (l_partkey % 70) AS departure_time, 1000 * (l_partkey % 70) + (l_partkey % 30) * 60 AS arrival_time, l_partkey % 50 * 100 AS routed_distance
FROM {lineitem} JOIN {trips} ON l_orderkey = order_id""",
    "days": """
SELECT user_id * 100 + day_number AS person_id, user_id, day_number, row_number() OVER (PARTITION BY user_id, day_number ORDER BY ts) AS trip_id, purpose, 1 + user_id % 4 AS weight
FROM (SELECT user_id, ts, extract(DAY FROM ts) AS day_number, CASE event_type WHEN 'view' THEN 'shop' WHEN 'click' THEN 'leisure' WHEN 'purchase' THEN 'other' WHEN 'signup' THEN 'work' ELSE 'home' END AS purpose FROM {events})""",
    "enterprises": """
SELECT p_partkey AS enterprise_id, p_partkey * 6007 % 100000 AS x, p_partkey * 3571 % 100000 AS y, p_size AS employees,
  CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN '851010' WHEN 'MEDIUM' THEN '852000' WHEN 'PROMO' THEN '853100' WHEN 'STANDARD' THEN '854200' WHEN 'SMALL' THEN '471100' ELSE '561000' END AS noga,
  (p_partkey * 6007 % 100000) // 20000 + 5 * ((p_partkey * 3571 % 100000) // 20000) AS zone_id FROM {part}""",
    "zones": """
SELECT zone_id, name, canton_id, 20000 * (zone_id % 5) AS min_x, 20000 * (zone_id // 5) AS min_y, 20000 * (zone_id % 5) + 10000 AS x, 20000 * (zone_id // 5) + 10000 AS y
FROM (SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS name, n_regionkey AS canton_id FROM {nation})""",
    "commuters": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, c_custkey AS person_id, c_nationkey AS home_zone_id, CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE s_nationkey END AS work_zone_id, l_orderkey % 29 = 0 AS abroad,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'car' WHEN '2' THEN 'pt' WHEN '3' THEN 'bike' WHEN '4' THEN 'unknown' ELSE 'car_passenger' END AS mode, 1 + l_linenumber AS weight
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "legs": """
SELECT o_custkey AS agent_id, o_orderkey AS journey_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS leg_order, s_nationkey AS from_id, c_nationkey + l_partkey % 3 AS to_id,
  l_partkey % 90 AS km, 1 + l_linenumber AS weight, l_partkey % 20 AS week, 1 + l_suppkey % 7 AS weekday, CASE l_suppkey % 4 WHEN 0 THEN 35 WHEN 1 THEN 37 WHEN 2 THEN 38 ELSE 1 END AS vehicle_code
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {customer} ON o_custkey = c_custkey""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SHAPES[name])


DEALT = 250_000  # rows of a task, about


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """By the keys in parts whose number follows ``rows``: adaptive execution leaves a given number as it
    is, while partitions of its own grow to 64 MB compressed, some millions of rows that one task sorts."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // DEALT + 1), *keys)


def _selected(spark: SparkSession, name: str, joined: DataFrame) -> DataFrame:
    """The columns of a shape from its joined tables."""
    return spark.sql(SHAPES[name].rpartition("FROM ")[0].replace("//", "div") + "FROM {joined}", joined=joined)


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shape(spark, sf_dir, "orders")
    return spark.sql(SHAPES["trips"].replace("//", "div"), orders=dealt(orders, orders.count(), "o_custkey"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, trips = shape(spark, sf_dir, "lineitem"), shape(spark, sf_dir, "trips")
    many = lines.count()
    joined = dealt(lines, many, "l_orderkey").join(dealt(trips, many, "order_id"), F.col("l_orderkey") == F.col("order_id"))
    return dealt(_selected(spark, "stages", joined), many, "person_id", "trip_id")


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, supplier, customer = (shape(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier", "customer"))
    many = lines.count()
    journeys = dealt(orders, orders.count(), "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    loads = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = dealt(loads, many, "l_orderkey").join(dealt(journeys, many, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _selected(spark, "legs", joined)


def _legs_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(shape(spark, sf_dir, "legs"), shape(spark, sf_dir, "lineitem").count(), "agent_id")


# Shapes with a row for each order or item: as their SQL says, dealt out by the keys that they are windowed and grouped by.
LARGE = {"trips": _trips, "stages": _stages, "legs": _legs, "legs_by_agent": _legs_by_agent}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in LARGE:
        return LARGE[name](spark, sf_dir)
    return spark.sql(SHAPES[name].replace("//", "div"), **{n: shape(spark, sf_dir, n) for n in dict.fromkeys(_needs(name))})


def with_shapes(sql: str) -> str:
    """The SQL with the shapes it names in braces before it, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in SHAPES and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    used = re.findall(r"\{(\w+)\}", sql)
    for name in used:
        add(name)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    views = ", ".join(f"{n} AS ({plain(SHAPES[n])})" for n in order)
    body = plain(sql).strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"
