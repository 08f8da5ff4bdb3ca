"""One query for each operator of the inventory, with its SQL.

A query gets a function that returns a shape of the given tables; names in braces in the SQL are
shapes as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as c
from ..functions import scalar as fn
from ..operators import freight, matching, places, population, recode, spatial, validate, zones
from ..session import shared_folder
from ..sources import layers, tables
from .fixtures import shape, with_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda shape_name: shape(spark, sf_dir, shape_name))
        if sql:
            ORACLE[name] = with_shapes(sql)
        return f

    return register


def case(column: str, values: dict, default: str = "NULL") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


def hashed(seed: int, salt: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}:{salt}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def digits(column: str, bounds) -> str:
    return "(" + " + ".join(f"({column} >= {b})::INT" for b in bounds) + ")"


# Recodes

MODE, PURPOSE = case("mode_code", c.TRIP_MODES), f"CASE WHEN way_code > 1 THEN 'home' ELSE {case('purpose_code', c.TRIP_PURPOSES)} END"


@query("p01_recode_mode", f"SELECT order_id, {MODE} AS mode, {case('mode_code', c.DETAILED_MODES, MODE)} AS mode_detailed FROM {{trips}}")
def _(t):
    return recode.recode_mode(t("trips").select("order_id", "mode_code")).drop("mode_code")


@query("p02_recode_purpose", f"SELECT order_id, {PURPOSE} AS purpose FROM {{trips}}")
def _(t):
    return recode.recode_purpose(t("trips").select("order_id", "purpose_code", "way_code")).select("order_id", "purpose")


@query("p03_recode_marital", f"SELECT person_id, {case('marital_code', c.MARITAL_STATUS)} AS marital_status FROM {{persons}}")
def _(t):
    return recode.recode_marital(t("persons")).select("person_id", "marital_status")


@query("p04_fix_marital_status", f"SELECT person_id, CASE WHEN s = 2 AND age < 45 THEN 0 ELSE s END AS marital_status FROM (SELECT person_id, age, {case('marital_code', c.MARITAL_STATUS)} AS s FROM {{persons}})")
def _(t):
    return recode.fix_marital_status(recode.recode_marital(t("persons"))).select("person_id", "marital_status")


@query("p05_recode_commute_mode", f"SELECT order_id, {case('mode_code', c.COMMUTE_MODES)} AS mode FROM {{trips}}")
def _(t):
    return recode.recode_commute_mode(t("trips").drop("mode")).select("order_id", "mode")


@query("p06_digitize", f"SELECT person_id, {digits('age', c.STATPOP.age_bounds)} AS age_class, {digits('age', c.SYNPOP.age_bounds)} AS age_class_synpop FROM {{persons}}")
def _(t):
    return recode.age_class(t("persons")).select("person_id", "age_class", fn.digitize(F.col("age"), c.SYNPOP.age_bounds).alias("age_class_synpop"))


@query("p07_household_size_class", "SELECT person_id, least(5, household_size) - 1 AS household_size_class, CASE household_size WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3-4' WHEN 4 THEN '3-4' ELSE '5+' END AS synpop_class FROM (SELECT person_id, count(*) OVER (PARTITION BY household_id) AS household_size FROM {persons})")
def _(t):
    sized = population.household_size(t("persons"))
    other = recode.household_size_class(sized, c.SYNPOP).select("person_id", F.col("household_size_class").alias("synpop_class"))
    return recode.household_size_class(sized).select("person_id", "household_size_class").join(other, "person_id")


@query("p08_clamp_classes", "SELECT person_id, greatest(0, cars) AS number_of_cars, least(3, greatest(0, cars)) AS number_of_cars_class, greatest(-1, income_code - 1) AS income_class FROM {survey}")
def _(t):
    return recode.clamp_classes(t("survey")).select("person_id", "number_of_cars", "number_of_cars_class", "income_class")


@query("p09_bike_class", "SELECT person_id, CASE WHEN number_of_bikes >= household_size THEN 2 WHEN number_of_bikes > 0 THEN 1 ELSE 0 END AS number_of_bikes_class FROM {survey}")
def _(t):
    return recode.bike_class(t("survey")).select("person_id", "number_of_bikes_class")


@query("p10_subscription_class", "SELECT person_id, CASE WHEN subscriptions_halbtax AND (subscriptions_verbund OR subscriptions_verbund_class) THEN 'HTA+VA' WHEN subscriptions_verbund OR subscriptions_verbund_class THEN 'VA' WHEN subscriptions_halbtax THEN 'HTA' WHEN subscriptions_ga OR subscriptions_ga_class THEN 'GA' ELSE 'null' END AS subscriptions FROM {survey}")
def _(t):
    return recode.subscription_class(t("survey")).select("person_id", "subscriptions")


@query("p11_employment_status", "SELECT person_id, CASE WHEN job_a = 32 OR job_b = 32 THEN 'working student' WHEN study_a = 32 OR study_b = 32 THEN 'student' WHEN age < 15 THEN 'student' WHEN work_code > 0 AND work_code < 5 THEN 'active' WHEN work_code = 5 THEN 'working student' ELSE 'inactive' END AS employment_status FROM {survey}")
def _(t):
    return recode.employment_status(t("survey")).select("person_id", "employment_status")


@query("p12_education_level", "SELECT person_id, CASE WHEN education_code BETWEEN 1 AND 4 THEN 'primary' WHEN education_code BETWEEN 5 AND 12 THEN 'secondary' WHEN education_code BETWEEN 13 AND 16 THEN 'tertiary_professional' WHEN education_code BETWEEN 17 AND 19 THEN 'tertiary_academic' END AS highest_education FROM {survey}")
def _(t):
    return recode.education_level(t("survey")).select("person_id", "highest_education")


@query("p13_survey_flags", "SELECT person_id, license_code = 1 AS driving_license, CASE car_code WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS car_availability, work_code <> -99 AS employed, weekday IN (6, 7) AS weekend, CASE parking_code WHEN 1 THEN 'free' WHEN 2 THEN 'paid' WHEN 3 THEN 'no' ELSE 'unknown' END AS parking_work, greatest(0, parking_fee)::DOUBLE AS parking_cost_work FROM {survey}")
def _(t):
    return recode.survey_flags(t("survey")).select("person_id", "driving_license", "car_availability", "employed", "weekend", "parking_work", "parking_cost_work")


@query("p14_recode_synpop", """SELECT person_id, sex - 1 AS sex, nationality - 1 AS nationality, CASE WHEN age < 18 AND person_id % 2 = 0 THEN 0 WHEN age < 18 THEN 1 WHEN age < 25 THEN 2 WHEN age < 45 THEN 3 WHEN age < 65 THEN 4 WHEN age < 75 THEN 5 ELSE 6 END AS age_class,
  CASE WHEN age < 18 AND person_id % 2 = 0 THEN 'inactive' WHEN person_id % 4 = 1 THEN CASE WHEN person_id % 3 = 0 THEN 'working student' ELSE 'student' END WHEN person_id % 3 = 0 THEN 'active' ELSE 'inactive' END AS employment_status,
  person_id % 4 AS number_of_cars_class, CASE WHEN person_id % 5 = 0 THEN 0 ELSE 2 END AS number_of_bikes_class FROM {persons}""")
def _(t):
    a, k = F.col("age"), F.col("person_id")
    band = F.when(a < 18, "0-17").when(a < 25, "18-24").when(a < 45, "25-44").when(a < 65, "45-64").when(a < 75, "65-74").otherwise("75+")
    child = (a < 18) & (k % 2 == 0)
    raw = t("persons").select(
        "person_id", F.when(F.col("sex") == 1, "M").otherwise("F").alias("sex"), F.when(F.col("nationality") == 1, "swiss").otherwise("non-swiss").alias("nation"), band.alias("age"),
        F.when(child, "primary").otherwise("other").alias("education"), F.when(~child & (k % 4 == 1), "student").alias("position_in_edu"), F.when(~child & (k % 3 == 0), "employee").alias("position_in_bus"),
        F.when(k % 4 == 3, "3+").otherwise((k % 4).cast("string")).alias("cars_in_hh"), F.when(k % 5 == 0, "null").otherwise("bike").alias("bike_ownership"),
    )
    return recode.recode_synpop(raw)


@query("p15_sp_region", f"SELECT DISTINCT canton_id, {case('canton_id', {k: r for r, ids in c.SP_REGIONS.items() for k in ids}, '0')} AS sp_region FROM {{persons}}")
def _(t):
    return recode.sp_region(t("persons").select("canton_id").distinct())


@query("p16_education_type", "SELECT enterprise_id, CASE substr(noga, 1, 3) WHEN '851' THEN 'kindergarten' WHEN '852' THEN 'primary' WHEN '853' THEN 'secondary' WHEN '854' THEN 'tertiary' END AS education_type FROM {enterprises}")
def _(t):
    return recode.education_type(t("enterprises")).select("enterprise_id", "education_type")


@query("p17_offers", "SELECT enterprise_id, true AS offers_work, true AS offers_other, noga LIKE '85%' AS offers_education, noga LIKE '90%' OR noga LIKE '56%' AS offers_leisure, noga LIKE '47%' AS offers_shop FROM {enterprises}")
def _(t):
    return recode.offers(t("enterprises").select("enterprise_id", "noga")).drop("noga")


@query("p18_education_band", "SELECT person_id, CASE WHEN age <= 6 THEN 'kindergarten' WHEN age <= 12 THEN 'primary' WHEN age <= 16 THEN 'secondary' ELSE 'tertiary' END AS education_band FROM {persons}")
def _(t):
    return recode.education_band(t("persons")).select("person_id", "education_band")


RESIDENTS = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY household_id) AS household_size FROM {persons}) WHERE population_type = 1 AND type_of_residence = 1 AND household_size <= 12)"


@query("p19_filter_residents", f"SELECT person_id, household_id, household_size FROM {RESIDENTS}")
def _(t):
    return recode.filter_residents(population.household_size(t("persons"))).select("person_id", "household_id", "household_size")


@query("p20_normalize_names", "SELECT n_name AS name, n_nationkey AS id, n_regionkey AS value FROM nation WHERE n_nationkey <> 0")
def _(t):
    n = t("nation")
    total = n.filter("n_nationkey = 0").first()["n_name"]
    raw = n.select(F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("raw"), F.col("n_regionkey").alias("value"))
    ids = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return recode.normalize_names(raw, "raw", ids, f" {total}  ").select("name", "id", "value")


@query("p21_parse_age", "SELECT person_id, age::INT AS age FROM {persons}")
def _(t):
    return t("persons").select("person_id", F.concat(F.col("age").cast("string"), F.lit(" Jahre")).alias("text")).select("person_id", recode.parse_age(F.col("text")).alias("age"))


@query("p22_municipality_type", f"SELECT person_id, {case('type_code', c.MUNICIPALITY_TYPES)} AS municipality_type FROM (SELECT person_id, municipality_id % 7 AS type_code FROM {{persons}})")
def _(t):
    return recode.municipality_type(t("persons").select("person_id", (F.col("municipality_id") % 7).alias("type_code"))).select("person_id", "municipality_type")


@query("p23_to_lv95", "SELECT person_id, home_x + 2000000.0::DOUBLE AS x, home_y + 1000000.0::DOUBLE AS y FROM {persons}")
def _(t):
    x, y = fn.lv03_to_lv95(F.col("home_x").cast("double"), F.col("home_y").cast("double"))
    return t("persons").select("person_id", x.alias("x"), y.alias("y"))


@query("p23_wgs84_to_lv95", """SELECT person_id, round(2600072.37 + 211455.93 * l - 10938.51 * l * p - 0.36 * l * p * p - 44.54 * l * l * l, 2) AS x, round(1200147.07 + 308807.95 * p + 3745.25 * l * l + 76.63 * p * p - 194.56 * l * l * p + 119.79 * p * p * p, 2) AS y
  FROM (SELECT person_id, ((45.8::DOUBLE + home_y / 50000.0::DOUBLE) * 3600 - 169028.66) / 10000 AS p, ((5.9::DOUBLE + home_x / 25000.0::DOUBLE) * 3600 - 26782.5) / 10000 AS l FROM {persons})""")
def _(t):
    x, y = fn.wgs84_to_lv95(F.lit(5.9) + F.col("home_x") / 25000.0, F.lit(45.8) + F.col("home_y") / 50000.0)
    return t("persons").select("person_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("p24_crowfly", "SELECT order_id, round(sqrt(((origin_x - destination_x) * (origin_x - destination_x) + (origin_y - destination_y) * (origin_y - destination_y))::DOUBLE), 6) AS crowfly_distance FROM {trips}")
def _(t):
    return t("trips").select("order_id", F.round(fn.crowfly(*map(F.col, ("origin_x", "origin_y", "destination_x", "destination_y"))), 6).alias("crowfly_distance"))


@query("p25_units", "SELECT order_id, departure_time / 60.0::DOUBLE AS minutes, distance / 1000.0::DOUBLE AS km, arrival_time - departure_time AS seconds FROM {trips}")
def _(t):
    return t("trips").select("order_id", (F.col("departure_time") / 60.0).alias("minutes"), (F.col("distance") / 1000.0).alias("km"), (F.col("arrival_time") - F.col("departure_time")).alias("seconds"))


@query("p26_hhmmss", "SELECT order_id, lpad((departure_time // 3600)::VARCHAR, greatest(2, length((departure_time // 3600)::VARCHAR))::INT, '0') || ':' || lpad((departure_time // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((departure_time % 60)::VARCHAR, 2, '0') AS departure FROM {trips}")
def _(t):
    return t("trips").select("order_id", fn.hhmmss(F.col("departure_time")).alias("departure"))


@query("p27_fill_defaults", "SELECT person_id, CASE WHEN age < 6 THEN -1 ELSE person_id END AS mz_person_id, CASE WHEN person_id % 3 = 0 THEN 'None' ELSE 'A' END AS ovgk, CASE WHEN person_id % 4 = 0 THEN 0 ELSE person_id % 9 END AS income_class, CASE WHEN person_id % 7 = 0 THEN 30 ELSE age END AS age FROM {persons}")
def _(t):
    k = F.col("person_id")
    raw = t("persons").select("person_id", F.when(F.col("age") >= 6, k).alias("mz_person_id"), F.when(k % 3 != 0, "A").alias("ovgk"), F.when(k % 4 != 0, k % 9).alias("income_class"), F.when(k % 7 != 0, F.col("age")).alias("age"))
    return recode.fill_defaults(raw)


@query("p28_reset_children", "SELECT person_id, CASE WHEN age < 18 THEN false ELSE person_id % 2 = 0 END AS driving_license, CASE WHEN age < 6 THEN false ELSE person_id % 3 = 0 END AS employed, CASE WHEN age < 6 THEN 0 ELSE person_id % 3 END AS marital_status, CASE WHEN age < 6 THEN 2 ELSE person_id % 3 END AS car_availability FROM {persons}")
def _(t):
    k = F.col("person_id")
    raw = t("persons").select("person_id", "age", (k % 2 == 0).alias("driving_license"), (k % 3 == 0).alias("employed"), (k % 3).alias("marital_status"), (k % 3).alias("car_availability"))
    return recode.reset_children(raw).drop("age")


@query("p29_vehicles", "SELECT person_id::VARCHAR || ':car' AS vehicle_id, 'default_car' AS type_id, person_id AS owner_id, 'car' AS mode FROM {persons} UNION ALL SELECT c_custkey::VARCHAR || ':truck', 'default_truck', c_custkey, 'truck' FROM customer WHERE c_custkey % 50 = 0")
def _(t):
    trucks = t("customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("agent_id"))
    return recode.vehicles(t("persons"), "car", "person_id").unionByName(recode.vehicles(trucks, "truck", "agent_id"))


@query("p30_select_population", "SELECT person_id FROM {persons} WHERE age BETWEEN 18 AND 65 AND sex = 1 AND canton_id IN (1, 2, 3, 4, 5, 6, 7)")
def _(t):
    return recode.select_population(t("persons"), (18, 65), 1, [1, 2, 3, 4, 5, 6, 7]).select("person_id")


@query("p31_scenario_filter", "SELECT person_id FROM {survey} WHERE weekday NOT IN (6, 7)")
def _(t):
    return recode.scenario_filter(recode.survey_flags(t("survey"))).select("person_id")


@query("p32_distance_window", "SELECT order_id, distance FROM {trips} WHERE distance > 0 AND distance < 25000")
def _(t):
    return recode.distance_window(t("trips"), 25.0, "distance").select("order_id", "distance")


VALID = "home_zone_id IS NOT NULL AND work_zone_id IS NOT NULL AND NOT abroad AND mode IN ('car', 'pt', 'bike', 'walk', 'car_passenger')"


@query("p33_valid_od", f"SELECT mode, count(*) AS n, sum(weight)::BIGINT AS weight FROM {{commuters}} WHERE {VALID} GROUP BY mode")
def _(t):
    return recode.valid_od(t("commuters")).groupBy("mode").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("p34_freight_types", "SELECT vehicle_type, count(*) AS n FROM (SELECT CASE WHEN vehicle_code IN (1, 2, 3, 35, 37, 38) THEN 'truck' ELSE vehicle_code::VARCHAR END AS vehicle_type FROM {legs}) GROUP BY vehicle_type")
def _(t):
    return recode.freight_types(t("legs")).groupBy("vehicle_type").agg(F.count("*").alias("n"))


@query("p35_household_labels", "SELECT person_id, [1000, 3000, 5000, 7000, 9000, 11000, 13000, 15000, 17000][income_code] AS income, CASE WHEN cars >= 3 THEN '3+' ELSE greatest(0, cars)::VARCHAR END AS car_label, CASE WHEN number_of_bikes >= household_size THEN 'FOR_ALL' WHEN number_of_bikes > 0 THEN 'FOR_SOME' ELSE 'FOR_NONE' END AS bike_label FROM {survey}")
def _(t):
    rows = recode.bike_class(recode.clamp_classes(t("survey")))
    return recode.household_labels(rows, tuple(range(1000, 18000, 2000))).select("person_id", "income", "car_label", "bike_label")


@query("p36_normalize_mode", "SELECT mode, count(*) AS n FROM (SELECT CASE WHEN mode = 'car_passenger' THEN 'car' ELSE mode END AS mode FROM {trips}) GROUP BY mode")
def _(t):
    return recode.normalize_mode(t("trips")).groupBy("mode").agg(F.count("*").alias("n"))


@query("p37_zones_at_level", "SELECT nuts_id, length(nuts_id) - 2 AS level FROM (SELECT 'CH' || (n_nationkey % 7)::VARCHAR || CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '' END AS nuts_id FROM nation WHERE n_nationkey % 5 <> 0)")
def _(t):
    k = F.col("n_nationkey")
    raw = t("nation").select(F.concat(F.when(k % 5 == 0, "DE").otherwise("CH"), (k % 7).cast("string"), F.when(k % 2 == 0, "0").otherwise("")).alias("nuts_id"))
    return recode.zones_at_level(raw, "CH")


# Joins

@query("j01_build_census", "SELECT person_id, household_id, age FROM {persons}")
def _(t):
    p = t("persons")
    return population.build_census(p.select("person_id", "municipality_id", "age"), p.select("person_id", "municipality_id", "household_id"), p.select("household_id").distinct()).select("person_id", "household_id", "age")


@query("j02_attach", "SELECT t.person_id, t.trip_id, s.passenger_stages FROM {trips} t LEFT JOIN (SELECT person_id, trip_id, sum((mode_code = 8)::INT)::BIGINT AS passenger_stages FROM {stages} GROUP BY 1, 2) s USING (person_id, trip_id)")
def _(t):
    return population.attach(t("trips").select("person_id", "trip_id"), population.passenger_trips(t("stages")), ["person_id", "trip_id"])


@query("j03_survey_persons", "SELECT person_id, age, household_id FROM {survey} JOIN (SELECT person_id, household_id FROM {persons}) USING (person_id)")
def _(t):
    return t("survey").select("person_id", "age").join(t("persons").select("person_id", "household_id"), "person_id")


@query("j04_activity_durations", "SELECT person_id, trip_id, lead(departure_time) OVER w - arrival_time AS activity_duration, lead(arrival_time) OVER w - departure_time AS legacy_duration FROM {trips} WINDOW w AS (PARTITION BY person_id ORDER BY trip_id)")
def _(t):
    trips = t("trips").select("person_id", "trip_id", "departure_time", "arrival_time")
    old = population.activity_durations(trips, legacy=True).select("person_id", "trip_id", F.col("activity_duration").alias("legacy_duration"))
    return population.activity_durations(trips).select("person_id", "trip_id", "activity_duration").join(old, ["person_id", "trip_id"])


def _indexed(t):
    trips = population.trip_index(population.preceding_purpose(t("trips")))
    return trips.select("person_id", "trip_index", "preceding_purpose", F.col("purpose").alias("following_purpose"), "departure_time", "arrival_time", "mode", "travel_time")


INDEXED = "(SELECT person_id, trip_id - 1 AS trip_index, coalesce(lag(purpose) OVER w, 'home') AS preceding_purpose, purpose AS following_purpose, departure_time, arrival_time, mode, travel_time, lag(arrival_time) OVER w AS last_arrival, row_number() OVER (PARTITION BY person_id ORDER BY trip_id DESC) AS from_end FROM {trips} WINDOW w AS (PARTITION BY person_id ORDER BY trip_id))"
ACTS = f"SELECT person_id, trip_index AS activity_index, preceding_purpose AS purpose, last_arrival AS start_time, departure_time AS end_time, false AS is_last FROM {INDEXED}"
CLOSING = f"SELECT person_id, trip_index + 1 AS activity_index, following_purpose AS purpose, arrival_time AS start_time, NULL::BIGINT AS end_time, true AS is_last FROM {INDEXED} WHERE from_end = 1"
HOME = "SELECT person_id, 0 AS activity_index, 'home' AS purpose, NULL::BIGINT AS start_time, NULL::BIGINT AS end_time, true AS is_last FROM {persons} WHERE person_id NOT IN (SELECT person_id FROM {trips})"


@query("j05_activities", ACTS)
def _(t):
    return population.activities(_indexed(t))


@query("j06_keep_ids", "SELECT person_id, trip_id FROM {trips} WHERE person_id IN (SELECT person_id FROM {survey})")
def _(t):
    return population.keep_ids(t("trips").select("person_id", "trip_id"), t("survey").select("person_id"), "person_id")


def _recoded(t):
    trips = recode.recode_purpose(recode.recode_mode(t("trips").drop("mode", "purpose")))
    homes = trips.groupBy("person_id").agg(F.min_by("origin_x", "trip_id").alias("home_x"), F.min_by("origin_y", "trip_id").alias("home_y"))
    return trips.join(homes.withColumn("home_x", F.when(F.col("person_id") % 7 == 0, F.col("home_x") + 1).otherwise(F.col("home_x"))), "person_id")


RECODED = f"(SELECT *, {MODE} AS m, {PURPOSE} AS p FROM {{trips}})"
REJECTS = {
    "unknown": f"SELECT DISTINCT person_id FROM {RECODED} WHERE m = 'unknown' OR p = 'unknown'",
    "end": f"SELECT person_id FROM (SELECT person_id, p, row_number() OVER (PARTITION BY person_id ORDER BY trip_id DESC) AS r FROM {RECODED}) WHERE r = 1 AND p <> 'home'",
    "start": "SELECT DISTINCT person_id FROM {trips} WHERE person_id % 7 = 0",
}


def _rejects(t):
    trips = _recoded(t)
    return trips, {"unknown": population.reject_unknown(trips), "end": population.reject_not_ending_home(trips), "start": population.reject_not_starting_home(trips)}


def _all(tables):
    out = None
    for df in tables:
        out = df if out is None else out.unionByName(df)
    return out.distinct()


UNION = " UNION ".join(REJECTS.values())


@query("j07_drop_incomplete", f"SELECT person_id, trip_id FROM {{trips}} WHERE person_id NOT IN ({UNION})")
def _(t):
    trips, rules = _rejects(t)
    return population.drop_incomplete(trips, _all(rules.values())).select("person_id", "trip_id")


@query("j08_flag_exists", "SELECT person_id, bool_or(age < 12) OVER (PARTITION BY household_id) AS has_children, person_id IN (SELECT person_id FROM {trips} WHERE mode = 'car_passenger') AS is_car_passenger FROM {persons}")
def _(t):
    flagged = population.household_flag(t("persons"), F.col("age") < 12, "has_children")
    return population.flag_exists(flagged, t("trips").filter("mode = 'car_passenger'"), "person_id", "is_car_passenger").select("person_id", "has_children", "is_car_passenger")


MATCHED = "(SELECT person_id, 1 + person_id * 7 % 300 AS mz_person_id FROM {persons} WHERE age >= 6)"


def _matched(t):
    return t("persons").filter("age >= 6").select("person_id", (1 + F.col("person_id") * 7 % 300).alias("mz_person_id"))


@query("j09_expand_trips", f"SELECT p.person_id, t.trip_id, t.mode FROM {MATCHED} p JOIN {{trips}} t ON t.person_id = p.mz_person_id")
def _(t):
    donor = t("trips").select(F.col("person_id").alias("mz_person_id"), "trip_id", "mode")
    return population.expand_trips(_matched(t), donor).select("person_id", "trip_id", "mode")


@query("j10_enrich", "SELECT p.person_id, h.cars, s.age AS mz_age FROM (SELECT person_id, 3 * (1 + person_id % 20) AS mz_head_id, person_id % 60 AS mz_person_id FROM {persons}) p JOIN {survey} h ON h.person_id = mz_head_id LEFT JOIN {survey} s ON s.person_id = mz_person_id")
def _(t):
    k = F.col("person_id")
    persons = t("persons").select("person_id", (3 * (1 + k % 20)).alias("mz_head_id"), (k % 60).alias("mz_person_id"))
    heads = t("survey").select(k.alias("mz_head_id"), "cars")
    own = t("survey").select(k.alias("mz_person_id"), F.col("age").alias("mz_age"))
    return population.enrich(persons, heads, own).select("person_id", "cars", "mz_age")


@query("j11_update_ids", "SELECT person_id, CASE WHEN municipality_id < 5 THEN municipality_id + 20 ELSE municipality_id END AS municipality_id FROM {persons}")
def _(t):
    mapping = t("zones").filter("zone_id < 5").select(F.col("zone_id").alias("old_id"), (F.col("zone_id") + 20).alias("new_id"))
    return zones.update_ids(t("persons").select("person_id", "municipality_id"), mapping, "municipality_id")


def _zone_system(t):
    n, r = t("nation"), t("region")
    return zones.zone_system({
        "country": r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "municipality": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "quarter": n.filter("n_nationkey % 3 = 0").select((F.col("n_nationkey") * 10).alias("id"), F.concat(F.col("n_name"), F.lit(" 1")).alias("name")),
    })


ZONES = "(SELECT row_number() OVER (ORDER BY zone_level, zone_level_id) - 1 AS zone_id, zone_level, zone_level_id, zone_name FROM (SELECT 'country' AS zone_level, r_regionkey::VARCHAR AS zone_level_id, r_name AS zone_name FROM region UNION ALL SELECT 'municipality', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'quarter', (n_nationkey * 10)::VARCHAR, n_name || ' 1' FROM nation WHERE n_nationkey % 3 = 0))"


@query("j12_impute_zone", f"SELECT person_id, coalesce(q.zone_id, m.zone_id) AS zone_id FROM {{persons}} p LEFT JOIN {ZONES} q ON q.zone_level = 'quarter' AND q.zone_level_id = (municipality_id * 10)::VARCHAR LEFT JOIN {ZONES} m ON m.zone_level = 'municipality' AND m.zone_level_id = municipality_id::VARCHAR")
def _(t):
    rows = t("persons").select("person_id", "municipality_id", (F.col("municipality_id") * 10).alias("quarter_id"))
    return zones.impute_zone(rows, _zone_system(t), [("quarter", "quarter_id"), ("municipality", "municipality_id")]).select("person_id", "zone_id")


def _polygons(t):
    x, y = F.col("min_x"), F.col("min_y")
    corner = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    return t("zones").select("zone_id", F.array(corner(0, 0), corner(20000, 0), corner(20000, 20000), corner(0, 20000)).alias("ring"))


def _points(t):
    return t("persons").select(F.col("person_id").alias("point_id"), (F.col("home_x") + 0.5).alias("x"), (F.col("home_y") + 0.5).alias("y"))


@query("j13_point_in_zone", "SELECT person_id AS point_id, home_x // 20000 + 5 * (home_y // 20000) AS zone_id FROM {persons}")
def _(t):
    return spatial.point_in_zone(_points(t), _polygons(t)).select("point_id", "zone_id")


@query("j14_impute_quality_class", "SELECT person_id AS point_id, CASE WHEN (home_x // 20000 + 5 * (home_y // 20000)) % 3 = 0 THEN 'A' ELSE 'None' END AS ovgk FROM {persons}")
def _(t):
    layer = _polygons(t).filter("zone_id % 3 = 0").select(F.lit("A").alias("quality"), "ring")
    return spatial.impute_quality_class(_points(t), layer).select("point_id", "ovgk")


@query("j15_nearest_centroid", "SELECT person_id AS point_id, arg_min(zone_id, (home_x + 0.5 - x) * (home_x + 0.5 - x) + (home_y + 0.5 - y) * (home_y + 0.5 - y)) AS zone_id FROM {persons}, (SELECT zone_id, x, y FROM {zones}) GROUP BY person_id")
def _(t):
    return spatial.nearest_centroid(_points(t), t("zones").select("zone_id", "x", "y")).select("point_id", "zone_id")


@query("j16_map_deprecated_zones", "SELECT zone_id AS old_id, zone_id AS new_id FROM {zones}")
def _(t):
    centres = spatial.centroids(_polygons(t)).withColumnRenamed("zone_id", "point_id")
    return spatial.point_in_zone(centres, _polygons(t)).select(F.col("point_id").alias("old_id"), F.col("zone_id").alias("new_id"))


KNN = "(SELECT point_id, enterprise_id AS facility_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY point_id ORDER BY d, enterprise_id) AS rank FROM (SELECT person_id AS point_id, enterprise_id, sqrt((home_x + 0.5 - x)::DOUBLE * (home_x + 0.5 - x) + (home_y + 0.5 - y)::DOUBLE * (home_y + 0.5 - y)) AS d FROM {persons}, {enterprises}))"


def _knn_sides(t):
    return _points(t), t("enterprises").select(F.col("enterprise_id").alias("facility_id"), "x", "y")


@query("j17_knn", f"SELECT * FROM {KNN} WHERE rank <= 5")
def _(t):
    return spatial.knn(*_knn_sides(t), 5).withColumn("distance", F.round("distance", 6))


@query("j18_snap", f"SELECT point_id, facility_id FROM {KNN} WHERE rank = 1")
def _(t):
    return spatial.knn(*_knn_sides(t), 1).select("point_id", "facility_id")


@query("j19_density", "SELECT e.enterprise_id AS point_id, coalesce(sum(n), 0)::BIGINT AS density FROM {enterprises} e LEFT JOIN (SELECT home_x, home_y, count(*) AS n FROM {persons} GROUP BY 1, 2) p ON (x - home_x) * (x - home_x) + (y - home_y) * (y - home_y) <= 6250000 GROUP BY 1")
def _(t):
    points = t("enterprises").select(F.col("enterprise_id").alias("point_id"), "x", "y")
    return spatial.density(points, t("persons").select(F.col("home_x").alias("x"), F.col("home_y").alias("y")), c.DENSITY_RADIUS).select("point_id", "density")


CORNERS = "(SELECT DISTINCT min_x + a AS bx, min_y + b AS \"by\" FROM {zones}, (SELECT unnest([0, 20000]) AS a), (SELECT unnest([0, 20000]) AS b) WHERE canton_id = 1)"


@query("j20_border_point", f"SELECT z.zone_id, arg_min(bx, d)::DOUBLE AS border_x, arg_min(\"by\", d)::DOUBLE AS border_y FROM (SELECT z.zone_id, bx, \"by\", (z.x - 37 - bx) * (z.x - 37 - bx) + (z.y - 91 - \"by\") * (z.y - 91 - \"by\") AS d FROM {{zones}} z, {CORNERS}) z GROUP BY 1")
def _(t):
    z = t("zones")
    return spatial.border_points(z.select("zone_id", (F.col("x") - 37).alias("x"), (F.col("y") - 91).alias("y")), _polygons(t).join(z.filter("canton_id = 1").select("zone_id"), "zone_id"))


def _located(t):
    acts = population.complete_activities(population.activities(_indexed(t)), population.closing_activity(_indexed(t)), t("persons"))
    acts = acts.join(t("persons").select("person_id", "household_id"), "person_id")
    k = F.col("person_id")
    home = t("persons").groupBy("household_id").agg(F.min("home_x").alias("x"), F.min("home_y").alias("y"))
    work = t("persons").select("person_id", (k * 31 % 100000).alias("x"), (k * 37 % 100000).alias("y"))
    edu = t("persons").select("person_id", (k * 41 % 100000).alias("x"), (k * 43 % 100000).alias("y"))
    secondary = acts.filter(~F.col("purpose").isin(*c.FIXED_PURPOSES)).select("person_id", "activity_index", (k * 47 % 100000).alias("x"), (F.col("activity_index") * 53 % 100000).alias("y"))
    return places.assemble_locations(acts, home, work, edu, secondary)


FULL = f"({ACTS} UNION ALL {CLOSING} UNION ALL {HOME})"
LOCATED = f"(SELECT a.person_id, activity_index, purpose, CASE purpose WHEN 'home' THEN home_x WHEN 'work' THEN a.person_id * 31 % 100000 WHEN 'education' THEN a.person_id * 41 % 100000 ELSE a.person_id * 47 % 100000 END AS x, CASE purpose WHEN 'home' THEN home_y WHEN 'work' THEN a.person_id * 37 % 100000 WHEN 'education' THEN a.person_id * 43 % 100000 ELSE activity_index * 53 % 100000 END AS y FROM {FULL} a JOIN {{persons}} p ON p.person_id = a.person_id)"


@query("j21_assemble_locations", f"SELECT * FROM {LOCATED}")
def _(t):
    return _located(t)


@query("j22_trip_lines", f"SELECT person_id, activity_index AS trip_index, round(sqrt(((x - dx) * (x - dx) + (y - dy) * (y - dy))::DOUBLE), 6) AS length FROM (SELECT *, lead(x) OVER w AS dx, lead(y) OVER w AS dy FROM {LOCATED} WINDOW w AS (PARTITION BY person_id ORDER BY activity_index)) WHERE dx IS NOT NULL")
def _(t):
    return places.trip_lines(_located(t)).select("person_id", "trip_index", F.round("length", 6).alias("length"))


@query("j23_commute_lines", f"SELECT h.person_id, h.x AS ox, h.y AS oy, w.x AS dx, w.y AS dy FROM (SELECT person_id, arg_min(x, activity_index) AS x, arg_min(y, activity_index) AS y FROM {LOCATED} WHERE purpose = 'home' GROUP BY 1) h JOIN (SELECT person_id, arg_min(x, activity_index) AS x, arg_min(y, activity_index) AS y FROM {LOCATED} WHERE purpose = 'work' GROUP BY 1) w USING (person_id)")
def _(t):
    return places.commute_lines(_located(t))


@query("j24_freight_legs", "SELECT agent_id, journey_id, leg_order, vehicle_code, week FROM {legs} JOIN (SELECT agent_id, max(week) AS w FROM {legs} GROUP BY 1) USING (agent_id)")
def _(t):
    legs = t("legs_by_agent")  # all joins are within agents
    journey = legs.select("agent_id", "journey_id").distinct()
    week = legs.groupBy("agent_id").agg(F.max("week").alias("last_week"))
    return freight.freight_legs(legs, journey, week).select("agent_id", "journey_id", "leg_order", "vehicle_code", "week")


@query("j25_zone_shapes", f"SELECT zone_id, zone_level, zone_level_id FROM {ZONES} WHERE zone_level <> 'country'")
def _(t):
    n = t("nation")
    shapes = {"municipality": n.select(F.col("n_nationkey").alias("id")), "quarter": n.filter("n_nationkey % 3 = 0").select((F.col("n_nationkey") * 10).alias("id"))}
    return zones.zone_shapes(_zone_system(t), shapes).select("zone_id", "zone_level", "zone_level_id")


@query("j26_zone_distances", "SELECT a.zone_id AS origin_id, b.zone_id AS destination_id, CASE WHEN a.zone_id = 3 OR b.zone_id = 3 THEN 800000.0 ELSE round(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE), 6) END AS distance FROM {zones} a, {zones} b")
def _(t):
    z = t("zones")
    return zones.zone_distances(z, z.filter("zone_id <> 3").select("zone_id", "x", "y")).withColumn("distance", F.round("distance", 6))


@query("j27_compare", "SELECT chain, coalesce(a.n, 0) AS synthetic, coalesce(b.n, 0) AS actual FROM (SELECT mode AS chain, count(*) AS n FROM {trips} WHERE mode <> 'walk' GROUP BY 1) a FULL JOIN (SELECT mode AS chain, count(*) AS n FROM {trips} WHERE mode <> 'pt' AND trip_id = 1 GROUP BY 1) b USING (chain)")
def _(t):
    counts = lambda df: df.groupBy(F.col("mode").alias("chain")).agg(F.count("*").alias("n"))
    return validate.compare(counts(t("trips").filter("mode <> 'walk'")), counts(t("trips").filter("mode <> 'pt' and trip_id = 1")), "chain")


@query("j28_cutout", "SELECT person_id FROM {persons} WHERE home_x + home_y < 80000")
def _(t):
    rows = t("persons").select("person_id", (F.col("home_x") + 0.25).alias("x"), (F.col("home_y") + 0.25).alias("y"))
    return spatial.cutout(rows, [(0.0, 0.0), (80000.0, 0.0), (0.0, 80000.0)]).select("person_id")


@query("j29_weighted_trips", "SELECT t.person_id, trip_id, s.weight, age FROM {trips} t JOIN {survey} s ON s.person_id = t.person_id")
def _(t):
    return t("trips").select("person_id", "trip_id").join(t("survey").select("person_id", "weight", "age"), "person_id")


# Aggregates

@query("a01_household_size", "SELECT person_id, count(*) OVER (PARTITION BY household_id) AS household_size FROM {persons}")
def _(t):
    return population.household_size(t("persons")).select("person_id", "household_size")


@query("a02_drop_minor_households", "SELECT person_id FROM (SELECT person_id, max(age) OVER (PARTITION BY household_id) AS oldest FROM {persons}) WHERE oldest >= 16")
def _(t):
    return population.drop_minor_households(t("persons")).select("person_id")


@query("a03_household_composition", "SELECT household_id, " + ", ".join(f"count(*) FILTER (age < {n}) AS n_children_under_{n}" for n in (3, 6, 12, 18)) + ", count(*) FILTER (age >= 18) AS n_adults FROM {persons} GROUP BY 1")
def _(t):
    return population.household_composition(t("persons"))


@query("a04_passenger_trips", "SELECT person_id, trip_id, sum((mode_code = 8)::INT)::BIGINT AS passenger_stages FROM {stages} GROUP BY 1, 2")
def _(t):
    return population.passenger_trips(t("stages"))


@query("a05_parking_cost", "SELECT person_id, trip_id, sum(greatest(0, parking))::BIGINT AS parking_cost FROM {stages} GROUP BY 1, 2")
def _(t):
    return population.parking_cost(t("stages"))


STAGED = "(SELECT *, stage_order AS stage_id, count(*) OVER (PARTITION BY person_id, trip_id) AS number_of_stages, mode IN ('rail', 'bus', 'tram') AS v FROM {stages})"


@query("a06_transit_trips", f"""SELECT person_id, trip_id, {", ".join(f"sum(CASE WHEN {cond} THEN {v} ELSE 0 END)::BIGINT AS {name}_{v}" for name, cond in (("access_egress", "NOT v AND (stage_id = 1 OR stage_id = number_of_stages)"), ("transfer", "NOT v AND stage_id <> 1 AND stage_id <> number_of_stages"), ("in_vehicle", "v")) for v in ("travel_time", "routed_distance"))},
  sum(v::INT)::BIGINT AS vehicular_stages, coalesce(max(CASE WHEN stage_id = 2 AND v THEN departure_time END) - max(CASE WHEN stage_id = 1 AND NOT v THEN arrival_time END), 0) AS first_waiting_time FROM {STAGED} GROUP BY 1, 2""")
def _(t):
    return population.transit_trips(population.stage_index(t("stages")))


def _od(t, by=("home_zone_id", "work_zone_id")):
    rows = recode.valid_od(t("commuters")).select("mode", F.col("home_zone_id").alias("origin_id"), F.col("work_zone_id").alias("destination_id"), "weight")
    return zones.od_weights(rows, ["mode", "origin_id", "destination_id"])


OD = f"(SELECT mode, home_zone_id AS origin_id, work_zone_id AS destination_id, sum(weight)::BIGINT AS weight FROM {{commuters}} WHERE {VALID} GROUP BY 1, 2, 3)"


@query("a07_od_weights", f"SELECT * FROM {OD}")
def _(t):
    return _od(t)


@query("a08_od_pdf", f"SELECT mode, origin_id, destination_id, weight, round(weight / sum(weight) OVER (PARTITION BY mode, origin_id), 9) AS probability FROM {OD} UNION ALL SELECT 'walk', zone_id, zone_id, 0, 1.0 FROM {{zones}}")
def _(t):
    origins = t("zones").select(F.col("zone_id").alias("origin_id"), F.explode(F.array(*map(F.lit, ("car", "pt", "bike", "walk", "car_passenger")))).alias("mode"))
    return zones.od_pdf(_od(t), origins, ["mode"]).withColumn("probability", F.round("probability", 9))


@query("a09_origin_pdf", f"SELECT mode, origin_id, weight, round(weight / sum(weight) OVER (PARTITION BY mode), 9) AS probability FROM (SELECT mode, origin_id, sum(weight)::BIGINT AS weight FROM {OD} GROUP BY 1, 2)")
def _(t):
    return zones.origin_pdf(_od(t), ["mode"]).withColumn("probability", F.round("probability", 9))


@query("a10_freight_demand", "SELECT 'truck' AS vehicle_type, round_even(sum(weight) / count(DISTINCT week) / 5, 0) * 1.5 AS demand FROM {legs} WHERE weekday <= 5")
def _(t):
    return freight.freight_demand(recode.freight_types(t("legs")), 1.5)


@query("a11_freight_scaling", "SELECT round(1000000.0::DOUBLE / (sum(km * weight) + sum(CASE WHEN week = 3 THEN km * weight ELSE 0 END)), 12) AS factor FROM {legs}")
def _(t):
    legs = t("legs").withColumnRenamed("km", "distance_km")
    projected = t("zones").limit(1).select(F.lit("truck").alias("type"), F.lit(1000000.0).alias("vehicle_km"))
    return freight.freight_scaling([legs, legs.filter("week = 3")], projected).select(F.round("factor", 12).alias("factor"))


@query("a12_project_linear", "SELECT name AS type, greatest(0, round_even(round(regr_slope(v, y) * 2035 + regr_intercept(v, y), 6), 0) * 1e6) AS vehicle_km FROM (SELECT name, unnest([2010, 2020, 2030, 2040]) AS y, unnest([zone_id * 3, zone_id * 5 + 7, zone_id * 4, zone_id * 9 - 11]) AS v FROM {zones}) GROUP BY 1")
def _(t):
    k = F.col("zone_id")
    wide = t("zones").select(F.col("name").alias("type"), (k * 3).cast("double").alias("2010"), (k * 5 + 7).cast("double").alias("2020"), (k * 4).cast("double").alias("2030"), (k * 9 - 11).cast("double").alias("2040"))
    return freight.project_linear(wide, (2010, 2020, 2030, 2040), 2035)


@query("a13_population_controls", f"SELECT canton_id, sex, nationality, {digits('age', c.STATPOP.age_bounds)} AS age_class, round_even(count(*) * 1.1, 0)::BIGINT AS target FROM {{persons}} GROUP BY ALL")
def _(t):
    return matching.population_controls(recode.age_class(t("persons")), ["canton_id", "sex", "nationality", "age_class"], "1.1")


CHAINS = "(SELECT person_id, weight, 'home-' || string_agg(purpose, '-' ORDER BY trip_id) AS chain FROM {days} GROUP BY 1, 2)"
COUNTS = f"(SELECT chain, count(*) AS n FROM {CHAINS} GROUP BY 1)"


def _chains(t):
    return validate.activity_chains(t("days"), ["person_id", "weight"])


@query("a14_activity_chains", f"SELECT * FROM {CHAINS}")
def _(t):
    return _chains(t)


@query("a15_chain_counts", f"SELECT chain, count(*) AS n, sum(weight)::BIGINT AS weighted FROM {CHAINS} GROUP BY 1")
def _(t):
    chains = _chains(t)
    return validate.chain_counts(chains).join(validate.chain_counts(chains, "weight").withColumnRenamed("n", "weighted"), "chain")


@query("a16_shares", f"SELECT chain, n, round(n * 100.0 / sum(n) OVER (), 9) AS share FROM {COUNTS}")
def _(t):
    return validate.shares(validate.chain_counts(_chains(t))).withColumn("share", F.round("share", 9))


@query("a17_activity_count_hist", f"SELECT least(len(string_split(chain, '-')) - 2, 7) AS activities, sum(n)::BIGINT AS n FROM {COUNTS} GROUP BY 1")
def _(t):
    return validate.activity_count_hist(validate.chain_counts(_chains(t)))


@query("a18_purpose_multiplicity", f"SELECT purpose || ' - ' || k::VARCHAR || ' times' AS label, sum(n)::BIGINT AS n FROM (SELECT chain, n, purpose, count(*) AS k FROM (SELECT chain, n, unnest(string_split(chain, '-')) AS purpose FROM {COUNTS}) WHERE purpose <> 'home' GROUP BY 1, 2, 3) GROUP BY 1")
def _(t):
    return validate.purpose_multiplicity(validate.chain_counts(_chains(t)))


@query("a19_mean_distance", "SELECT purpose, round(avg(distance), 6) AS mean, round(sum(distance * weight) / sum(weight), 6) AS weighted_mean FROM {trips} GROUP BY 1")
def _(t):
    return validate.mean_distance(t("trips"), "purpose").select("purpose", F.round("mean", 6).alias("mean"), F.round("weighted_mean", 6).alias("weighted_mean"))


@query("a20_mode_purpose_share", "SELECT mode, purpose, round(n / sum(n) OVER (), 9) AS share, round(w / sum(w) OVER (), 9) AS weighted_share FROM (SELECT mode, purpose, count(*) AS n, sum(weight) AS w FROM {trips} GROUP BY 1, 2)")
def _(t):
    return validate.mode_purpose_share(t("trips")).select("mode", "purpose", F.round("share", 9).alias("share"), F.round("weighted_share", 9).alias("weighted_share"))


@query("a21_distance_hist", "SELECT mode, bin, round(w / sum(w) OVER (PARTITION BY mode) / (25.0::DOUBLE / 119), 9) AS density FROM (SELECT mode, least(floor(distance / 1000.0::DOUBLE / (25.0::DOUBLE / 119)), 118)::BIGINT AS bin, sum(weight) AS w FROM {trips} WHERE distance <= 25000 GROUP BY 1, 2)")
def _(t):
    rows = t("trips").withColumn("km", F.col("distance") / 1000.0)
    return validate.distance_hist(rows, "mode").withColumn("density", F.round("density", 9))


@query("a22_mobility_tools", "SELECT tool, value, coalesce(s, 0) AS synthetic, coalesce(w, 0)::BIGINT AS actual FROM (SELECT tool, value, count(*) AS s FROM (SELECT 'cars' AS tool, cars::VARCHAR AS value FROM {survey} UNION ALL SELECT 'number_of_bikes', number_of_bikes::VARCHAR FROM {survey}) GROUP BY 1, 2) FULL JOIN (SELECT tool, value, sum(weight) AS w FROM (SELECT weight, 'cars' AS tool, cars::VARCHAR AS value FROM {survey} WHERE age >= 6 UNION ALL SELECT weight, 'number_of_bikes', number_of_bikes::VARCHAR FROM {survey} WHERE age >= 6) GROUP BY 1, 2) USING (tool, value)")
def _(t):
    return validate.mobility_tools(t("survey"), t("survey").filter("age >= 6"), ["cars", "number_of_bikes"])


@query("a24_quality_report", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(DISTINCT person_id) AS rejected FROM ({s})" for k, s in REJECTS.items()))
def _(t):
    return validate.quality_report(_rejects(t)[1])


@query("a25_commuters", f"SELECT home_zone_id, mode, count(*) AS commuters FROM {{commuters}} WHERE {VALID} GROUP BY 1, 2")
def _(t):
    return zones.commuters(recode.valid_od(t("commuters")))


@query("a26_work_demand", f"SELECT work_zone_id, count(*) AS demand, 'municipality' AS zone_level FROM {{commuters}} WHERE {VALID} GROUP BY 1")
def _(t):
    levels = t("zones").select("zone_id", F.lit("municipality").alias("zone_level"))
    return zones.work_demand(recode.valid_od(t("commuters")), levels)


FIRST_WORK = "(SELECT person_id, arg_min(distance, trip_id) AS distance FROM (SELECT person_id, trip_id, distance, purpose, coalesce(lag(purpose) OVER (PARTITION BY person_id ORDER BY trip_id), 'home') AS before FROM {trips}) WHERE before = 'home' AND purpose = 'work' GROUP BY 1)"


@query("a27_home_primary_distance", f"SELECT * FROM {FIRST_WORK}")
def _(t):
    return validate.home_primary_distance(population.preceding_purpose(t("trips")), "work")


@query("a28_success_rate", "SELECT round(avg((distance < 20000)::INT), 9) AS rate FROM {trips}")
def _(t):
    return validate.success_rate(t("trips").select((F.col("distance") < 20000).alias("valid"))).select(F.round("rate", 9).alias("rate"))


# Windows

@query("w01_preceding_purpose", "SELECT person_id, trip_id, coalesce(lag(purpose) OVER (PARTITION BY person_id ORDER BY trip_id), 'home') AS preceding_purpose FROM {trips}")
def _(t):
    return population.preceding_purpose(t("trips")).select("person_id", "trip_id", "preceding_purpose")


@query("w02_trip_index", "SELECT person_id, trip_id, trip_id - 1 AS trip_index FROM {trips}")
def _(t):
    return population.trip_index(t("trips")).select("person_id", "trip_id", "trip_index")


@query("w03_stage_index", f"SELECT person_id, trip_id, stage_id, number_of_stages, stage_id = 1 AS is_first_stage, stage_id = number_of_stages AS is_last_stage FROM {STAGED}")
def _(t):
    return population.stage_index(t("stages")).select("person_id", "trip_id", "stage_id", "number_of_stages", "is_first_stage", "is_last_stage")


@query("w04_first_waiting", f"SELECT person_id, trip_id, coalesce(max(CASE WHEN stage_id = 2 AND v THEN departure_time END) - max(CASE WHEN stage_id = 1 AND NOT v THEN arrival_time END), 0) AS first_waiting_time FROM {STAGED} GROUP BY 1, 2")
def _(t):
    return population.transit_trips(population.stage_index(t("stages"))).select("person_id", "trip_id", "first_waiting_time")


HEADS = f"""(SELECT household_id, person_id AS head_id FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY age DESC, sex, person_id) AS r FROM (
  SELECT *, bool_or(married) OVER (PARTITION BY household_id) AS any_married FROM (SELECT *, {case('marital_code', c.MARITAL_STATUS)} = 1 AS married, bool_or(age <= 60) OVER (PARTITION BY household_id) AS any_active FROM {{persons}} WHERE age >= 16) WHERE NOT any_active OR age <= 60) WHERE NOT any_married OR married) WHERE r = 1)"""


@query("w05_head_of_household", f"SELECT person_id, head_id, person_id = head_id AS is_head FROM {{persons}} JOIN {HEADS} USING (household_id)")
def _(t):
    return population.head_of_household(recode.recode_marital(t("persons"))).select("person_id", "head_id", "is_head")


@query("w06_main_commute", "SELECT person_id, trip_id FROM (SELECT person_id, trip_id, row_number() OVER (PARTITION BY person_id ORDER BY d DESC NULLS LAST, trip_id) AS r FROM (SELECT person_id, trip_id, purpose, lead(departure_time) OVER (PARTITION BY person_id ORDER BY trip_id) - arrival_time AS d FROM {trips}) WHERE purpose = 'work') WHERE r = 1")
def _(t):
    return population.main_commute(population.activity_durations(t("trips"))).select("person_id", "trip_id")


@query("w07_chain_ends", "SELECT person_id, arg_min(purpose, trip_id) AS first_purpose, arg_max(purpose, trip_id) AS last_purpose FROM {trips} GROUP BY 1")
def _(t):
    return population.chain_ends(t("trips"))


@query("w08_weighted_cdf", "SELECT order_id, round(sum(weight) OVER (PARTITION BY mode ORDER BY distance, order_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY mode), 9) AS cdf FROM {trips}")
def _(t):
    return zones.weighted_cdf(t("trips"), ["mode"], ["distance", "order_id"], ranged=True).select("order_id", F.round("cdf", 9).alias("cdf"))


@query("w09_closing_activity", CLOSING)
def _(t):
    return population.closing_activity(_indexed(t))


@query("w10_loading_legs", "SELECT agent_id, journey_id, leg_order, coalesce(lag(to_id) OVER w, from_id) AS origin_id, to_id AS destination_id, km - coalesce(lag(km) OVER w, 0) AS distance_km FROM {legs} WINDOW w AS (PARTITION BY agent_id, journey_id ORDER BY leg_order)")
def _(t):
    return freight.loading_legs(t("legs"))


@query("w11_unloading_legs", "SELECT agent_id, journey_id, leg_order, from_id AS origin_id, coalesce(lead(from_id) OVER w, to_id) AS destination_id, km - coalesce(lead(km) OVER w, 0) AS distance_km FROM {legs} WINDOW w AS (PARTITION BY agent_id, journey_id ORDER BY leg_order)")
def _(t):
    return freight.unloading_legs(t("legs"))


@query("w12_jitter_departures", f"SELECT person_id, trip_id, round_even(departure_time + s, 0)::DOUBLE AS departure_time, round_even(arrival_time + s, 0)::DOUBLE AS arrival_time FROM (SELECT *, {hashed(1, 'departure', 'person_id')} * r * 2 - r AS s FROM (SELECT *, least(1800.0::DOUBLE, min(departure_time) OVER (PARTITION BY person_id)) AS r FROM {{trips}}))")
def _(t):
    return population.jitter_departures(t("trips"), 1).select("person_id", "trip_id", "departure_time", "arrival_time")


@query("w13_time_bins", """WITH c AS (SELECT mode, travel_time, count(*) AS c FROM {trips} GROUP BY 1, 2), u AS (SELECT *, sum(c) OVER (PARTITION BY mode ORDER BY travel_time) AS upto FROM c),
h AS (SELECT mode, travel_time, row_number() OVER (PARTITION BY mode ORDER BY travel_time) - 1 AS bin, count(*) OVER (PARTITION BY mode) AS many FROM u WHERE upto // 201 > (upto - c) // 201)
SELECT mode, bin, CASE WHEN bin = many - 1 THEN 2147483648 ELSE travel_time END AS upper FROM h""")
def _(t):
    return places.time_bins(t("trips"), 200)


PDF = "(SELECT origin_id, destination_id, weight / sum(weight) OVER (PARTITION BY origin_id) AS probability FROM (SELECT home_zone_id AS origin_id, work_zone_id AS destination_id, sum(weight) AS weight FROM {commuters} WHERE work_zone_id IS NOT NULL GROUP BY 1, 2))"


def _pdf(t):
    od = zones.od_weights(t("commuters").filter("work_zone_id is not null").select(F.col("home_zone_id").alias("origin_id"), F.col("work_zone_id").alias("destination_id"), "weight"), ["origin_id", "destination_id"])
    return zones.od_pdf(od, od.select("origin_id").distinct())


@query("w14_apportion", f"SELECT origin_id, destination_id, (whole + (rank <= left_over)::INT)::BIGINT AS count FROM (SELECT *, total - sum(whole) OVER (PARTITION BY origin_id) AS left_over, row_number() OVER (PARTITION BY origin_id ORDER BY rest DESC, destination_id) AS rank FROM (SELECT *, floor(round(p, 9)) AS whole, round(p - floor(round(p, 9)), 9) AS rest FROM (SELECT origin_id, destination_id, 100 + origin_id AS total, probability * (100 + origin_id) AS p FROM {PDF})))")
def _(t):
    totals = t("zones").select(F.col("zone_id").alias("origin_id"), (F.col("zone_id") + 100).alias("total"))
    return zones.apportion(_pdf(t), totals)


@query("w15_pair_by_rank", """WITH p AS (SELECT person_id, mode, home_zone_id AS origin_id, row_number() OVER (PARTITION BY mode, home_zone_id ORDER BY d, person_id) AS rank FROM (SELECT person_id, 'car' AS mode, municipality_id AS home_zone_id, person_id * 31 % 5000 AS d FROM {persons})),
n AS (SELECT origin_id, count(*) AS n FROM p GROUP BY 1), s AS (SELECT origin_id, k AS destination_id, abs(origin_id - k) AS distance, CASE WHEN k = (origin_id + 3) % 25 THEN n // 2 WHEN k = (origin_id + 7) % 25 THEN n - n // 2 ELSE 0 END AS count FROM n, (SELECT unnest(range(25)) AS k)),
u AS (SELECT *, sum(count) OVER (PARTITION BY origin_id ORDER BY distance, destination_id ROWS UNBOUNDED PRECEDING) AS upto FROM s WHERE count > 0)
SELECT person_id, mode, p.origin_id, destination_id FROM p JOIN u ON u.origin_id = p.origin_id AND rank > upto - count AND rank <= upto""")
def _(t):
    persons = t("persons").select("person_id", F.lit("car").alias("mode"), F.col("municipality_id").alias("home_zone_id"), (F.col("person_id") * 31 % 5000).alias("commute_distance"))
    n = persons.groupBy(F.col("home_zone_id").alias("origin_id")).agg(F.count("*").alias("n"))
    o = F.col("origin_id")
    two = F.explode(F.array(F.struct(((o + 3) % 25).alias("destination_id"), F.expr("n div 2").alias("count")), F.struct(((o + 7) % 25).alias("destination_id"), F.expr("n - n div 2").alias("count"))))
    counts = n.select("origin_id", two.alias("c")).select(F.lit("car").alias("mode"), "origin_id", "c.destination_id", "c.count").withColumn("distance", F.abs(o - F.col("destination_id")))
    return zones.pair_by_rank(persons, counts)


@query("w16_new_ids", f"SELECT order_id, row_number() OVER (ORDER BY floor({hashed(0, 'rank', 'order_id')} * ((SELECT count(*) FROM {{trips}}) // {population.RANKED} + 1)), order_id) - 1 AS new_id FROM {{trips}}")
def _(t):
    return population.new_ids(t("trips").select("order_id"), ["order_id"])


@query("w17_link_indices", f"SELECT person_id, activity_index, CASE WHEN activity_index > 0 THEN activity_index - 1 END AS preceding_trip_index, CASE WHEN NOT is_last THEN activity_index END AS following_trip_index FROM {FULL}")
def _(t):
    acts = population.complete_activities(population.activities(_indexed(t)), population.closing_activity(_indexed(t)), t("persons"))
    return population.link_indices(acts).select("person_id", "activity_index", "preceding_trip_index", "following_trip_index")


# Sorts, first rows, sets

@query("t01_sorted_output", "SELECT person_id, trip_id FROM {trips}")
def _(t):
    return population.sorted_output(t("trips").select("person_id", "trip_id"), ["person_id", "trip_id"])


@query("t02_top_chains", f"SELECT chain, n FROM {COUNTS} ORDER BY n DESC, chain LIMIT 10")
def _(t):
    return validate.top_chains(validate.chain_counts(_chains(t)), 10)


@query("t03_first_per", "SELECT household_id, min(person_id) AS person_id FROM {persons} GROUP BY 1")
def _(t):
    return population.first_per(t("persons").select("household_id", "person_id"), "household_id", ["person_id"])


@query("t04_distinct_legs", "SELECT agent_id, journey_id, from_id, to_id, min(leg_order) AS leg_order FROM {legs} GROUP BY 1, 2, 3, 4")
def _(t):
    return freight.distinct_legs(t("legs")).select("agent_id", "journey_id", "from_id", "to_id", "leg_order")


@query("t05_order_commuters", "SELECT person_id, row_number() OVER (PARTITION BY municipality_id ORDER BY person_id * 31 % 5000, person_id) AS rank FROM {persons}")
def _(t):
    rows = t("persons").select("person_id", F.lit("car").alias("mode"), F.col("municipality_id").alias("home_zone_id"), (F.col("person_id") * 31 % 5000).alias("commute_distance"))
    return zones.order_commuters(rows).select("person_id", "rank")


@query("u01_zone_system", f"SELECT * FROM {ZONES}")
def _(t):
    return _zone_system(t)


@query("u02_latest_vintage", "SELECT p_size AS id, max(p_partkey) AS year FROM part GROUP BY 1")
def _(t):
    return zones.latest_vintage(t("part").select(F.col("p_size").alias("id"), F.col("p_partkey").alias("year")), "id")


@query("u03_complete_activities", f"SELECT * FROM {FULL}")
def _(t):
    return population.complete_activities(population.activities(_indexed(t)), population.closing_activity(_indexed(t)), t("persons"))


@query("u04_without_trips", "SELECT person_id FROM {persons} WHERE person_id NOT IN (SELECT person_id FROM {trips} WHERE mode = 'car')")
def _(t):
    return population.without_trips(t("persons").select("person_id"), t("trips").filter("mode = 'car'"))


@query("u05_freight_union", "SELECT agent_id, journey_id, leg_order FROM {legs} WHERE week < 5 UNION ALL SELECT agent_id, journey_id, leg_order FROM {legs} WHERE week > 15")
def _(t):
    legs = t("legs").select("agent_id", "journey_id", "leg_order", "week")
    return legs.filter("week < 5").unionByName(legs.filter("week > 15")).drop("week")


@query("u06_rejects", UNION)
def _(t):
    return _all(_rejects(t)[1].values())


# Transit feeds

def _feed(t):
    n = F.col("n_nationkey")
    return {
        "agency": t("region").select(F.when(F.col("r_regionkey") > 0, F.col("r_regionkey").cast("string")).alias("agency_id")),
        "stops": t("part").filter("p_partkey % 5 <> 0").select(F.concat_ws(" ", F.lit("stop"), F.col("p_partkey").cast("string")).alias("stop_id"), F.when(F.col("p_partkey") % 2 == 0, 1).alias("location_type"), F.lit("x").alias("ext_note")),
        "routes": t("nation").select(n.cast("string").alias("route_id"), F.when(n % 2 == 0, F.col("n_regionkey").cast("string")).alias("agency_id")),
        "trips": t("orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderstatus")).alias("service_id")),
        "stop_times": t("lineitem").select(F.col("l_orderkey").cast("string").alias("trip_id"), F.concat_ws(" ", F.lit("stop"), F.col("l_partkey").cast("string")).alias("stop_id")),
        "transfers": t("lineitem").filter("l_linenumber = 1").select(F.concat_ws(" ", F.lit("stop"), F.col("l_partkey").cast("string")).alias("from_stop_id"), F.concat_ws(" ", F.lit("stop"), F.col("l_suppkey").cast("string")).alias("to_stop_id"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("min_transfer_time")),
    }


STOPS = "(SELECT 'stop ' || p_partkey::VARCHAR AS stop_id FROM part WHERE p_partkey % 5 <> 0)"
TIMES = f"(SELECT l_orderkey AS trip_id, 'stop ' || l_partkey::VARCHAR AS stop_id FROM lineitem WHERE l_partkey % 5 <> 0)"


@query("g01_drop_empty_service", "SELECT o_orderkey::VARCHAR AS trip_id, o_orderstatus AS service_id FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    return freight.drop_empty_service(_feed(t))["trips"]


@query("g02_feed_defaults", "SELECT n_nationkey::VARCHAR AS route_id, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE '1' END AS agency_id FROM nation UNION ALL SELECT 'stop ' || p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'transfers', count(*)::VARCHAR FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 3 <> 0")
def _(t):
    feed = freight.feed_defaults(_feed(t))
    stops = feed["stops"].select(F.col("stop_id").alias("route_id"), F.col("location_type").cast("string").alias("agency_id"))
    many = feed["transfers"].agg(F.count("*").cast("string").alias("agency_id")).select(F.lit("transfers").alias("route_id"), "agency_id")
    return feed["routes"].select("route_id", "agency_id").unionByName(stops).unionByName(many)


@query("g03_clean_references", f"SELECT 'stop_times' AS slot, count(*) AS n FROM {TIMES} UNION ALL SELECT 'transfers', count(*) FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 5 <> 0 AND l_suppkey % 5 <> 0")
def _(t):
    feed = freight.clean_references(_feed(t))
    count = lambda slot: feed[slot].agg(F.count("*").alias("n")).select(F.lit(slot).alias("slot"), "n")
    return count("stop_times").unionByName(count("transfers"))


@query("g04_drop_single_stop_trips", f"SELECT trip_id::VARCHAR AS trip_id, count(*) AS stop_times FROM {TIMES} GROUP BY 1 HAVING count(*) > 1")
def _(t):
    feed = freight.drop_single_stop_trips(freight.clean_references(_feed(t)))
    return feed["stop_times"].groupBy("trip_id").agg(F.count("*").alias("stop_times")).join(feed["trips"].select("trip_id"), "trip_id", "left_semi")


@query("g05_rename_collisions", "SELECT 'a' AS feed, o_orderkey::VARCHAR AS trip_id FROM orders UNION ALL SELECT 'b', o_orderkey::VARCHAR || '_m' FROM orders WHERE o_orderkey % 2 = 0")
def _(t):
    a = {"trips": t("orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.lit("a").alias("feed"))}
    b = {"trips": t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.lit("b").alias("feed"))}
    return freight.merge_feeds(a, b, "_m")["trips"].select("feed", "trip_id")


@query("g06_merge_feeds", "SELECT n_nationkey::VARCHAR AS route_id, n_regionkey::VARCHAR AS agency_id FROM nation")
def _(t):
    routes = {"routes": t("nation").select(F.col("n_nationkey").cast("string").alias("route_id"), F.col("n_regionkey").cast("string").alias("agency_id"))}
    return freight.merge_feeds(routes, {"routes": routes["routes"].filter("route_id < '3'")})["routes"]


@query("g07_despace_stop_ids", f"SELECT replace(stop_id, ' ', ':::') AS stop_id, count(*) AS n FROM {TIMES} GROUP BY 1")
def _(t):
    feed = freight.despace_stop_ids(freight.clean_references(_feed(t)))
    return feed["stop_times"].groupBy("stop_id").agg(F.count("*").alias("n"))


@query("g05_merge_all", """SELECT 'fare_rules' AS slot, 'f' || n_nationkey::VARCHAR || CASE WHEN k > 1 AND n_nationkey % 2 = 0 THEN '_m' || k::VARCHAR ELSE '' END AS a, 'r' || n_nationkey::VARCHAR || CASE WHEN k > 1 THEN '_m' || k::VARCHAR ELSE '' END AS b FROM nation, (SELECT unnest([1, 2, 3]) AS k)
UNION ALL SELECT 'stops', 's' || n_nationkey::VARCHAR || CASE WHEN k > 1 THEN '_m' || k::VARCHAR ELSE '' END, 'l' || n_regionkey::VARCHAR || CASE WHEN k > 1 THEN '_m' || k::VARCHAR ELSE '' END FROM nation, (SELECT unnest([1, 2, 3]) AS k)""")
def _(t):
    n, r = t("nation"), t("region")
    name = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))

    def feed(k):
        return {
            "levels": r.select(name("l", "r_regionkey").alias("level_id"), F.lit(k).alias("level_index")),
            "stops": n.select(name("s", "n_nationkey").alias("stop_id"), name("l", "n_regionkey").alias("level_id"), F.lit(k).alias("stop_code")),
            "routes": n.select(name("r", "n_nationkey").alias("route_id"), F.lit(k).alias("route_type")),
            "fare_attributes": n.select(name("f", "n_nationkey").alias("fare_id"), F.when(F.col("n_nationkey") % 2 == 0, k).otherwise(0).alias("price")),
            "fare_rules": n.select(name("f", "n_nationkey").alias("fare_id"), name("r", "n_nationkey").alias("route_id")),
        }

    out = freight.merge_all([feed(1), feed(2), feed(3)])
    rules = out["fare_rules"].select(F.lit("fare_rules").alias("slot"), F.col("fare_id").alias("a"), F.col("route_id").alias("b"))
    return rules.unionByName(out["stops"].select(F.lit("stops").alias("slot"), F.col("stop_id").alias("a"), F.col("level_id").alias("b")))


@query("g07_order_days", "SELECT o_orderstatus AS service_id, position - 1 AS place, day FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT unnest(range(1, 10)) AS position, unnest(['service_id', 'start_date', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']) AS day)")
def _(t):
    one = lambda c: F.lit(1).alias(c)
    calendar = t("orders").select(F.col("o_orderstatus").alias("service_id")).distinct().select(*map(one, ("friday", "monday")), "service_id", *map(one, ("sunday", "saturday", "tuesday", "thursday")), one("start_date"), one("wednesday"))
    ordered = freight.order_days({"calendar": calendar})["calendar"]
    return ordered.select("service_id", F.posexplode(F.array(*map(F.lit, ordered.columns))).alias("place", "day"))


# Sampling, matching, fitting

@query("m01_downsample", f"SELECT person_id FROM {{persons}} WHERE {hashed(3, 'sample', 'household_id')} < 0.4")
def _(t):
    return population.downsample(t("persons"), 0.4, 3).select("person_id")


COLUMNS = ["sex", "age_class", "number_of_cars_class", "region"]
TARGETS = "(SELECT person_id AS target_id, sex, age // 15 AS age_class, person_id % 4 AS number_of_cars_class, municipality_id AS region FROM {persons} WHERE person_id % 10 <> 0)"


def _hot_deck_steps(name: str, targets: str, columns: list[str], mandatory: int, min_obs: int, seed: int, steps: str | None = None) -> str:
    """CTEs that end in <name>_drawn (target_id, level, donor_id).  ``steps``: the declining requirements, if they don't decline by one."""
    k = len(columns)
    cell = lambda n, a: " || '|' || ".join([f"'{n}'", *(f"{a}.{x}::VARCHAR" for x in columns[:n])])
    counts = ", ".join(f"(SELECT count(*) FROM {{donors}} d WHERE {' AND '.join(f'd.{x} = t.{x}' for x in columns[:n])}) AS n{n}" for n in range(1, k + 1))
    need = f"list_max(list_filter([0, {steps}], lambda m: m <= n{mandatory}))" if steps else f"least({min_obs}, n{mandatory})"
    fine = "CASE " + " ".join(f"WHEN n{n} >= {need} THEN {n}" for n in range(k, mandatory - 1, -1)) + " END"
    coarse = " ".join(f"WHEN n{n} >= 1 THEN {n}" for n in range(mandatory - 1, 0, -1))
    level = f"CASE WHEN {need} >= 1 THEN {fine} {coarse} ELSE 0 END"
    own = "CASE level " + " ".join(f"WHEN {n} THEN {cell(n, 'p')}" for n in range(k + 1)) + " END"
    cells = " UNION ALL ".join(f"SELECT donor_id, weight, {cell(n, 'd')} AS cell FROM {{donors}} d" for n in range(k + 1))
    return f"""{name}_p AS (SELECT *, {level} AS level FROM (SELECT t.*, {counts} FROM {targets} t)), {name}_q AS (SELECT target_id, level, {own} AS cell, {hashed(seed, 'match', 'target_id')} AS u FROM {name}_p p),
{name}_c AS (SELECT cell, donor_id, sum(weight) OVER (PARTITION BY cell ORDER BY donor_id) / sum(weight) OVER (PARTITION BY cell) AS cdf, (sum(weight) OVER (PARTITION BY cell ORDER BY donor_id) - weight) / sum(weight) OVER (PARTITION BY cell) AS before FROM ({cells})),
{name}_drawn AS (SELECT target_id, level, donor_id FROM {name}_q q JOIN {name}_c c ON c.cell = q.cell AND u >= before AND u < cdf)"""


def _hot_deck_sql(select: str) -> str:
    return f"WITH {_hot_deck_steps('m', TARGETS, COLUMNS, 2, 5, 5)} {select}"


def _targets(t):
    k = F.col("person_id")
    return t("persons").filter("person_id % 10 <> 0").select(k.alias("target_id"), "sex", F.expr("age div 15").alias("age_class"), (k % 4).alias("number_of_cars_class"), F.col("municipality_id").alias("region"))


@query("m02_hot_deck", _hot_deck_sql("SELECT * FROM m_drawn"))
def _(t):
    return matching.hot_deck(t("donors"), _targets(t), COLUMNS, 2, 5, 5)


@query("m02_halving_schedule", f"WITH {_hot_deck_steps('m', TARGETS, COLUMNS, 2, 40, 5, '40, 20, 10, 5, 2, 1')} SELECT * FROM m_drawn")
def _(t):
    return matching.hot_deck(t("donors"), _targets(t), COLUMNS, 2, 40, 5, lambda m: m // 2)


@query("a23_match_levels", _hot_deck_sql("SELECT level, n, sum(n) OVER (ORDER BY level DESC)::BIGINT AS at_least FROM (SELECT level, count(*) AS n FROM m_q GROUP BY 1)"))
def _(t):
    return matching.match_levels(matching.hot_deck(t("donors"), _targets(t), COLUMNS, 2, 5, 5), len(COLUMNS))


CENSUS = f"(SELECT person_id, household_id, head_id, sex, age // 15 AS age_class, municipality_id AS region FROM {{persons}} JOIN {HEADS} USING (household_id))"
MATCHED_HEADS = "(SELECT household_id, h.donor_id AS mz_head_id, d.number_of_cars_class FROM h_drawn h JOIN census c ON c.person_id = h.target_id JOIN {donors} d ON d.donor_id = h.donor_id)"


@query("m03_match_population", f"""WITH census AS MATERIALIZED {CENSUS}, heads AS (SELECT person_id AS target_id, sex, region FROM census WHERE person_id = head_id),
{_hot_deck_steps("h", "heads", ["sex", "region"], 1, 3, 9)}, own AS MATERIALIZED (SELECT person_id AS target_id, c.household_id, mz_head_id, number_of_cars_class, sex, age_class FROM census c JOIN {MATCHED_HEADS} m USING (household_id)),
{_hot_deck_steps("o", "own", ["number_of_cars_class", "sex", "age_class"], 2, 3, 10)}
SELECT target_id AS person_id, household_id, mz_head_id, donor_id AS mz_person_id FROM own JOIN o_drawn USING (target_id)""")
def _(t):
    census = population.head_of_household(recode.recode_marital(t("persons"))).withColumn("age_class", F.expr("age div 15")).withColumn("region", F.col("municipality_id"))
    return matching.match_population(census, t("donors"), ["sex", "region"], ["sex", "age_class"], 3, 9)


ZONE_CDF = "(SELECT zone_id, enterprise_id, x, y, sum(employees) OVER w / sum(employees) OVER (PARTITION BY zone_id) AS cdf, (sum(employees) OVER w - employees) / sum(employees) OVER (PARTITION BY zone_id) AS before FROM {enterprises} WINDOW w AS (PARTITION BY zone_id ORDER BY enterprise_id))"


@query("m04_weighted_draw", f"SELECT person_id, enterprise_id FROM (SELECT person_id, municipality_id AS zone_id, {hashed(2, 'draw', 'person_id')} AS u FROM {{persons}}) p JOIN {ZONE_CDF} c ON c.zone_id = p.zone_id AND u >= before AND u < cdf")
def _(t):
    cells = zones.weighted_cdf(t("enterprises"), ["zone_id"], ["enterprise_id"], "employees").select("zone_id", "enterprise_id", "cdf_before", "cdf")
    rows = t("persons").select("person_id", F.col("municipality_id").alias("zone_id"))
    return zones.weighted_draw(rows, fn.uniform(2, "draw", F.col("person_id")), cells, ["zone_id"]).select("person_id", "enterprise_id")


def _types(t):
    p = t("persons")
    houses = p.groupBy("household_id").agg(F.min("municipality_id").alias("canton_id"), F.count("*").alias("size"), F.count_if(F.col("sex") == 1).alias("n_men"), F.count_if(F.col("age") < 18).alias("n_young"))
    types = houses.groupBy("canton_id", "size", "n_men", "n_young").agg(F.count("*").alias("households")).withColumn("n_all", F.lit(1)).withColumn("type_id", F.col("size") * 10000 + F.col("n_men") * 100 + F.col("n_young"))
    target = lambda n: F.sum(F.col("households") * F.col(n)) * 1.2
    goals = types.groupBy("canton_id").agg(target("n_all").alias("t_all"), target("n_men").alias("t_men"), target("n_young").alias("t_young"))
    return types.join(goals, "canton_id")


def _ipu_sql(sweeps: int) -> str:
    """Controls one after the other; after all of one kind a canton whose errors are within the limits stops."""
    kinds = (("all",), ("men", "young"))
    steps = ["w0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS weight, false AS done FROM types)"]
    k = 0
    for _ in range(sweeps):
        for kind in kinds:
            for name in kind:
                now = f"sum(weight * households * n_{name}) OVER (PARTITION BY canton_id)"
                steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN NOT done AND n_{name} > 0 AND {now} > 0 AND t_{name} > 0 THEN weight * (t_{name} / {now}) ELSE weight END AS weight) FROM w{k})")
                k += 1
            within = []
            for own, (relative, absolute) in zip(kinds, matching.LIMITS, strict=True):
                error = lambda name: f"abs(sum(weight * households * n_{name}) OVER (PARTITION BY canton_id) - t_{name})"
                total = " + ".join(f"abs(t_{n})" for n in own)
                within += [f"({' + '.join(error(n) for n in own)}) / ({total}) <= {relative}", f"({' + '.join(f'{error(n)} * abs(t_{n})' for n in own)}) / ({total}) <= {absolute}"]
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (done OR ({' AND '.join(within)}) AS done) FROM w{k})")
            k += 1
    return f"""WITH h AS (SELECT household_id, min(municipality_id) AS canton_id, count(*) AS size, count(*) FILTER (sex = 1) AS n_men, count(*) FILTER (age < 18) AS n_young FROM {{persons}} GROUP BY 1),
g AS (SELECT canton_id, size, n_men, n_young, count(*) AS households, 1 AS n_all, size * 10000 + n_men * 100 + n_young AS type_id FROM h GROUP BY 1, 2, 3, 4),
types AS (SELECT *, sum(households * n_all) OVER c * 1.2::DOUBLE AS t_all, sum(households * n_men) OVER c * 1.2::DOUBLE AS t_men, sum(households * n_young) OVER c * 1.2::DOUBLE AS t_young FROM g WINDOW c AS (PARTITION BY canton_id)),
{", ".join(steps)} SELECT canton_id, type_id, round(weight, 6) AS weight FROM w{k}"""


@query("m05_ipu", _ipu_sql(6))
def _(t):
    return matching.ipu(_types(t), "canton_id", ["all", "men", "young"], 6, households=("all",), limits=matching.LIMITS).withColumn("weight", F.round("weight", 6))


@query("m06_replicate", f"SELECT person_id, household_id, unnest(range(1, copies + 1)) AS copy FROM {{persons}} JOIN (SELECT household_id, (floor(w) + ({hashed(4, 'replicate', 'household_id')} < w - floor(w))::INT)::BIGINT AS copies FROM (SELECT DISTINCT household_id, 0.3::DOUBLE + household_id % 7 / 4.0::DOUBLE AS w FROM {{persons}})) USING (household_id)")
def _(t):
    houses = t("persons").select("household_id").distinct().withColumn("weight", F.lit(0.3) + F.col("household_id") % 7 / F.lit(4.0))
    return matching.replicate(houses, t("persons").select("person_id", "household_id"), 4)[1].select("person_id", "household_id", "copy")


@query("m07_scale_to_counts", f"WITH r AS (SELECT person_id, canton_id, sex, count(*) OVER (PARTITION BY canton_id, sex) AS n, row_number() OVER (PARTITION BY canton_id, sex ORDER BY {hashed(6, 'scale', 'person_id')}, person_id) AS rank FROM {{persons}}) SELECT person_id, canton_id, sex, unnest(range(1, target // n + (rank <= target % n)::INT + 1)) AS copy FROM (SELECT *, n * 5 // 4 AS target FROM r)")
def _(t):
    persons = t("persons").select("person_id", "canton_id", "sex")
    controls = persons.groupBy("canton_id", "sex").agg(F.expr("count(*) * 5 div 4").alias("target"))
    return matching.scale_to_counts(persons, controls, ["canton_id", "sex"], 6)


@query("m08_impute_income")
def _(t):
    rows = t("persons").select("person_id", F.col("age").cast("double").alias("age"), F.col("sex").cast("double").alias("sex"), (1 + F.col("person_id") % 5).cast("double").alias("weight"), F.when(F.col("person_id") % 7 == 0, -1).otherwise(F.expr("age div 11")).cast("int").alias("income_class"))
    return matching.impute_income(rows, ["age", "sex"], 7).select("person_id", "income_class", "imputed")


POOL = "(SELECT origin_id, destination_id, sum(weight) OVER w / sum(weight) OVER (PARTITION BY origin_id) AS cdf, (sum(weight) OVER w - weight) / sum(weight) OVER (PARTITION BY origin_id) AS before FROM (SELECT home_zone_id AS origin_id, work_zone_id AS destination_id, sum(weight) AS weight FROM {commuters} WHERE work_zone_id IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY origin_id ORDER BY destination_id))"
DRAWN = f"(SELECT q.origin_id, destination_id, count(*) AS count FROM (SELECT origin_id, {hashed(8, 'od', 'origin_id', 'unit')} AS u FROM (SELECT municipality_id AS origin_id, unnest(range(1, count(*) + 1)) AS unit FROM {{persons}} GROUP BY 1)) q JOIN {POOL} c ON c.origin_id = q.origin_id AND u >= before AND u < cdf GROUP BY 1, 2)"


def _drawn(t):
    od = zones.od_weights(t("commuters").filter("work_zone_id is not null").select(F.col("home_zone_id").alias("origin_id"), F.col("work_zone_id").alias("destination_id"), "weight"), ["origin_id", "destination_id"])
    totals = t("persons").groupBy(F.col("municipality_id").alias("origin_id")).agg(F.count("*").alias("total"))
    return matching.multinomial_counts(totals, zones.weighted_cdf(od, ["origin_id"], ["destination_id"]), 8)


@query("m09_multinomial_counts", f"SELECT * FROM {DRAWN}")
def _(t):
    return _drawn(t)


@query("m10_expand_counts", f"SELECT origin_id, destination_id, unnest(range(1, count + 1)) AS unit FROM {DRAWN}")
def _(t):
    return zones.expand_counts(_drawn(t))


@query("m11_work_in_zone", f"SELECT person_id, p.zone_id AS work_zone_id, enterprise_id, x AS work_x, y AS work_y FROM (SELECT person_id, (municipality_id + 5) % 25 AS zone_id, {hashed(2, 'work', 'person_id')} AS u FROM {{persons}}) p JOIN {ZONE_CDF} c ON c.zone_id = p.zone_id AND u >= before AND u < cdf")
def _(t):
    persons = t("persons").select("person_id", ((F.col("municipality_id") + 5) % 25).alias("work_zone_id"))
    return places.work_in_zone(persons, t("enterprises"), 2)


@query("m12_work_gravity", "SELECT count(*) AS persons, count(DISTINCT person_id) AS placed, true AS in_zone FROM {persons}")
def _(t):
    o = F.col("home_zone_id")
    persons = t("persons").select("person_id", F.col("municipality_id").alias("home_zone_id"), F.col("home_x").alias("x"), F.col("home_y").alias("y"), (F.col("person_id") * 31 % 30000).alias("commute_distance"))
    n = persons.groupBy("home_zone_id").agg(F.count("*").alias("n"))
    two = F.explode(F.array(F.struct(((o + 3) % 25).alias("work_zone_id"), F.expr("n div 2").alias("count")), F.struct(((o + 7) % 25).alias("work_zone_id"), F.expr("n - n div 2").alias("count"))))
    quotas = n.select("home_zone_id", two.alias("q")).select("home_zone_id", "q.work_zone_id", "q.count")
    out = places.work_gravity(persons, t("enterprises"), 11, quotas).join(t("enterprises").select("enterprise_id", "zone_id"), "enterprise_id").join(persons.select("person_id", "home_zone_id", "commute_distance"), "person_id")
    allowed = F.col("zone_id").isin((o + 3) % 25, (o + 7) % 25) | ((F.col("zone_id") == o) & (F.col("commute_distance") < places.NEAR))
    return out.agg(F.count("*").alias("persons"), F.countDistinct("person_id").alias("placed"), F.min(allowed).alias("in_zone"))


@query("m13_education_places", f"SELECT point_id, facility_id FROM {KNN} WHERE rank = floor({hashed(12, 'education', 'point_id')} * 5) + 1")
def _(t):
    return spatial.education_places(*_knn_sides(t), 5, 12).select("point_id", "facility_id")


@query("m14_sample_points", f"SELECT zone_id, unit, round(min_x + {hashed(13, 'point-x', 'zone_id', 'unit', '0')} * 20000, 6) AS x, round(min_y + {hashed(13, 'point-y', 'zone_id', 'unit', '0')} * 20000, 6) AS y FROM {{zones}} JOIN (SELECT municipality_id AS zone_id, unnest(range(0, count(*))) AS unit FROM {{persons}} GROUP BY 1) USING (zone_id)")
def _(t):
    counts = t("persons").groupBy(F.col("municipality_id").cast("long").alias("zone_id")).agg(F.count("*").alias("n"))
    return spatial.sample_points(_polygons(t), counts, 13).select("zone_id", "unit", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Of each zone an L with a hole in its lower part: strips from below, with left and right bounds in units of 1000.
STRIPS = "(VALUES (0, 0, 2, 0, 0, 20, 20), (1, 2, 4, 0, 0, 5, 5), (2, 2, 4, 7, 7, 20, 20), (3, 4, 8, 0, 0, 20, 20), (4, 8, 20, 0, 0, 12, 6)) s(k, y0, y1, l0, l1, r0, r1)"
DRAWN = f"""WITH s AS (SELECT *, (y1 - y0) * (r0 - l0 + r1 - l1) AS area FROM {STRIPS}),
c AS (SELECT *, (sum(area) OVER (ORDER BY k) - area)::DOUBLE / sum(area) OVER () AS a, sum(area) OVER (ORDER BY k)::DOUBLE / sum(area) OVER () AS b FROM s),
u AS (SELECT municipality_id AS zone_id, unnest(range(0, count(*))) AS unit FROM {{persons}} GROUP BY 1),
d AS (SELECT zone_id, unit, {hashed(14, 'point-y', 'zone_id', 'unit', '0')} AS v, {hashed(14, 'point-x', 'zone_id', 'unit', '0')} AS w FROM u),
t AS (SELECT *, r0 - l0 AS low, r1 - l1 AS high, CASE WHEN r0 - l0 = r1 - l1 THEN (v - a) / (b - a) ELSE (sqrt((r0 - l0) ** 2 + (v - a) / (b - a) * ((r1 - l1) ** 2 - (r0 - l0) ** 2)) - (r0 - l0)) / (r1 - l1 - r0 + l0) END AS t FROM d JOIN c ON v >= a AND v < b)"""


@query("m14_sample_shapes", f"{DRAWN} SELECT zone_id, unit, round(min_x + 1000 * (l0 + t * (l1 - l0) + w * (low + t * (high - low))), 5) AS x, round(min_y + 1000 * (y0 + t * (y1 - y0)), 5) AS y FROM t JOIN {{zones}} USING (zone_id)")
def _(t):
    ring = lambda *points: F.array(*(F.struct((F.col("min_x") + 1000 * a).cast("double").alias("x"), (F.col("min_y") + 1000 * b).cast("double").alias("y")) for a, b in points))
    outer, hole = ring((0, 0), (20, 0), (20, 8), (12, 8), (6, 20), (0, 20)), ring((5, 2), (5, 4), (7, 4), (7, 2))
    counts = t("persons").groupBy(F.col("municipality_id").cast("long").alias("zone_id")).agg(F.count("*").alias("n"))
    return spatial.sample_points(t("zones").select("zone_id", F.array(outer, hole).alias("rings")), counts, 14).select("zone_id", "unit", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


BINS = """bins AS (SELECT mode, bin, CASE WHEN bin = many - 1 THEN 2147483648 ELSE travel_time END AS upper FROM (SELECT mode, travel_time, row_number() OVER (PARTITION BY mode ORDER BY travel_time) - 1 AS bin, count(*) OVER (PARTITION BY mode) AS many FROM
  (SELECT *, sum(c) OVER (PARTITION BY mode ORDER BY travel_time) AS upto FROM (SELECT mode, travel_time, count(*) AS c FROM {trips} GROUP BY 1, 2)) WHERE upto // 201 > (upto - c) // 201)),
b AS (SELECT t.mode, bin, distance, person_id, trip_id, weight FROM (SELECT * FROM {trips} WHERE purpose NOT IN ('work', 'education')) t JOIN bins ON bins.mode = t.mode AND travel_time <= upper QUALIFY row_number() OVER (PARTITION BY person_id, trip_id ORDER BY bin) = 1),
dist AS (SELECT mode, bin, distance, person_id, trip_id, sum(weight) OVER w / sum(weight) OVER (PARTITION BY mode, bin) AS cdf, (sum(weight) OVER w - weight) / sum(weight) OVER (PARTITION BY mode, bin) AS before, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY mode, bin) AS n FROM b WINDOW w AS (PARTITION BY mode, bin ORDER BY distance, person_id, trip_id ROWS UNBOUNDED PRECEDING))"""


def _dist(t):
    return places.distance_distributions(t("trips").filter("purpose not in ('work', 'education')"), places.time_bins(t("trips"), 200))


@query("m15_distance_distributions", f"WITH {BINS} SELECT mode, bin, person_id, trip_id, round(cdf, 9) AS cdf FROM dist")
def _(t):
    return _dist(t).select("mode", "bin", "person_id", "trip_id", F.round("cdf", 9).alias("cdf"))


@query("m16_resample_cdf", f"WITH {BINS} SELECT mode, bin, person_id, trip_id, round(t / max(t) OVER (PARTITION BY mode, bin), 9) AS cdf FROM (SELECT *, cdf * (1.0 + 0.25::DOUBLE * rank / n) AS t FROM dist)")
def _(t):
    return places.resample_cdf(_dist(t), 0.25).select("mode", "bin", "person_id", "trip_id", F.round("cdf", 9).alias("cdf"))


@query("m17_assignment_problems", f"SELECT person_id, chain, count(*) - 1 AS size, string_agg(following_purpose, '-' ORDER BY trip_index) AS purposes FROM (SELECT *, coalesce(sum((following_purpose IN ('home', 'work', 'education'))::INT) OVER (PARTITION BY person_id ORDER BY trip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chain FROM {INDEXED}) GROUP BY 1, 2 HAVING count(*) > 1 AND arg_max(following_purpose, trip_index) IN ('home', 'work', 'education')")
def _(t):
    return places.assignment_problems(_indexed(t)).select("person_id", "chain", "size", F.array_join("purposes", "-").alias("purposes"))


@query("m18_draw_distances", f"WITH {BINS} SELECT leg_id, distance FROM (SELECT order_id AS leg_id, t.mode, min(bin) AS bin, {hashed(14, 'distance', 'order_id')} AS u FROM {{trips}} t JOIN bins ON bins.mode = t.mode AND travel_time <= upper GROUP BY 1, 2) l JOIN dist d ON d.mode = l.mode AND d.bin = l.bin AND u >= before AND u < cdf")
def _(t):
    bins = places.time_bins(t("trips"), 200)
    legs = t("trips").join(bins, "mode").filter("travel_time <= upper").groupBy(F.col("order_id").alias("leg_id"), "mode").agg(F.min("bin").alias("bin"))
    return places.draw_distances(legs, _dist(t), 14)


@query("m19_assign_secondary")
def _(t):
    problems = places.assignment_problems(_indexed(t))
    k = F.col("person_id") * 100 + F.col("chain")
    rows = problems.select(
        k.alias("problem_id"), (k * 7919 % 100000).cast("double").alias("ox"), (k * 104729 % 100000).cast("double").alias("oy"), (k * 7919 % 100000 + 2000).cast("double").alias("dx"), (k * 104729 % 100000 + 1000).cast("double").alias("dy"),
        F.slice("purposes", F.lit(1), F.col("size")).alias("purposes"), "modes", "travel_times",
    )
    dist = places.resample_cdf(_dist(t), fn.lookup(F.col("mode"), {"car": 0.8, "car_passenger": 1.0, "pt": 1.0}, 0.0))
    offers = recode.offers(t("enterprises"))
    shops = offers.select(F.col("enterprise_id").alias("facility_id"), F.explode(F.array_compact(F.array(*(F.when(F.col(f"offers_{p}"), p) for p in ("shop", "leisure", "other"))))).alias("purpose"), "x", "y")
    return places.assign_secondary(rows, places.time_bins(t("trips"), 200), dist, shops, 15).select("problem_id", "position", "facility_id")


# Legs of 500 m between ends 2236 m apart: the nearest lengths that close are equal, so the place sought is half-way.
TWO_LEGS = f"""SELECT person_id * 100 + chain AS k, purposes[1] AS purpose, modes FROM (SELECT person_id, chain, list(following_purpose ORDER BY trip_index) AS purposes, list(mode ORDER BY trip_index) AS modes FROM
  (SELECT *, coalesce(sum((following_purpose IN ('home', 'work', 'education'))::INT) OVER (PARTITION BY person_id ORDER BY trip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chain FROM {INDEXED}) GROUP BY 1, 2) WHERE len(purposes) = 2 AND purposes[2] IN ('home', 'work', 'education')"""
OFF = " ".join(f"WHEN '{m}' THEN {v}" for m, v in places.THRESHOLDS.items())


@query("m19_two_leg_chains", f"""WITH p AS (SELECT *, k * 7919 % 100000 + 0.3713::DOUBLE AS ox, k * 104729 % 100000 + 0.7321::DOUBLE AS oy FROM ({TWO_LEGS})),
f AS (SELECT enterprise_id, x, y, unnest(list_filter(['shop', 'leisure', 'other'], lambda o: o = 'other' OR (o = 'shop' AND noga LIKE '47%') OR (o = 'leisure' AND (noga LIKE '90%' OR noga LIKE '56%')))) AS purpose FROM {{enterprises}}),
n AS (SELECT k, modes, ox, oy, arg_min({{'id': enterprise_id, 'x': x, 'y': y}}, {{'d': (x - ox - 1000) ** 2 + (y - oy - 500) ** 2, 'id': enterprise_id}}) AS f FROM p JOIN f USING (purpose) GROUP BY ALL)
SELECT k AS problem_id, f.id AS facility_id, round(greatest(0, abs(500 - sqrt((f.x - ox) ** 2 + (f.y - oy) ** 2)) - CASE modes[1] {OFF} END, abs(500 - sqrt((f.x - ox - 2000) ** 2 + (f.y - oy - 1000) ** 2)) - CASE modes[2] {OFF} END), 5) AS error, false AS valid FROM n""")
def _(t):
    k = F.col("person_id") * 100 + F.col("chain")
    ox, oy = (k * 7919 % 100000 + F.lit(0.3713)), (k * 104729 % 100000 + F.lit(0.7321))
    rows = places.assignment_problems(_indexed(t)).filter("size = 1").select(k.alias("problem_id"), ox.alias("ox"), oy.alias("oy"), (ox + 2000).alias("dx"), (oy + 1000).alias("dy"), F.slice("purposes", 1, 1).alias("purposes"), "modes", "travel_times")
    bins = t("trips").select("mode", F.lit(0).alias("bin"), F.lit(2**31).alias("upper")).distinct()
    dist = bins.select("mode", "bin", F.lit(500.0).alias("distance"), F.lit(1.0).alias("cdf"))
    offers = recode.offers(t("enterprises"))
    shops = offers.select(F.col("enterprise_id").alias("facility_id"), F.explode(F.array_compact(F.array(*(F.when(F.col(f"offers_{p}"), p) for p in ("shop", "leisure", "other"))))).alias("purpose"), "x", "y")
    # By joins, as for more facilities than a task holds.
    return places.assign_secondary(rows, bins, dist, shops, 15, tries=1, held=0).select("problem_id", "facility_id", F.round("error", 5).alias("error"), "valid")


@query("m20_freight_locations", f"SELECT trip_id, p.zone_id, enterprise_id FROM (SELECT o_orderkey AS trip_id, o_orderkey % 25 AS zone_id, {hashed(16, 'origin', 'o_orderkey')} AS u FROM orders) p JOIN (SELECT zone_id, enterprise_id, row_number() OVER (PARTITION BY zone_id ORDER BY enterprise_id) AS rank, count(*) OVER (PARTITION BY zone_id) AS many FROM {{enterprises}}) e ON e.zone_id = p.zone_id AND rank = floor(u * many) + 1")
def _(t):
    trips = t("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 25).alias("origin_zone"))
    return freight.freight_locations(trips, t("enterprises"), "origin_zone", 16, "origin").select("trip_id", "zone_id", "enterprise_id")


NUTS = "CASE o_orderkey % 5 WHEN 0 THEN 'CH' WHEN 1 THEN 'CH' || (o_orderkey % 7 % 5)::VARCHAR WHEN 2 THEN 'DE' || (o_orderkey % 3)::VARCHAR ELSE 'CH' || lpad((o_orderkey % 25)::VARCHAR, 2, '0') END"
ABROAD = ((0, 120011.0, 31007.0), (1, -5003.0, 77003.0), (2, 44017.0, 130001.0))  # zones and their centres
BORDER = [(0.0, 0.0), (50000.0, 0.0), (100000.0, 0.0), (100000.0, 50000.0), (100000.0, 100000.0), (50000.0, 100000.0), (0.0, 100000.0), (0.0, 50000.0)]


@query("m20_freight_places", f"""WITH p AS (SELECT o_orderkey AS trip_id, {NUTS} AS zone_id, {hashed(16, 'origin', 'o_orderkey')} AS u FROM orders),
e AS (SELECT enterprise_id, x, y, unnest(['CH', 'CH' || (zone_id % 5)::VARCHAR, 'CH' || lpad(zone_id::VARCHAR, 2, '0')]) AS zone_id FROM {{enterprises}}),
r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY floor({hashed(0, 'rank', 'enterprise_id')} * ((SELECT count(*) FROM e) // {population.RANKED} + 1)), enterprise_id) - 1 AS rank, count(*) OVER (PARTITION BY zone_id) AS many FROM e)
SELECT trip_id, p.zone_id, enterprise_id, x::DOUBLE AS x, y::DOUBLE AS y FROM p JOIN r ON r.zone_id = p.zone_id AND rank = floor(u * many)
UNION ALL SELECT trip_id, zone_id, NULL, CASE zone_id WHEN 'DE0' THEN 100000.0 WHEN 'DE1' THEN 0.0 ELSE 50000.0 END, CASE zone_id WHEN 'DE0' THEN 50000.0 WHEN 'DE1' THEN 100000.0 ELSE 100000.0 END FROM p WHERE zone_id LIKE 'DE%'""")
def _(t):
    trips = t("orders").select(F.col("o_orderkey").alias("trip_id"), F.expr(NUTS.replace("::VARCHAR", "").replace("lpad((o_orderkey % 25)", "lpad(string(o_orderkey % 25)")).alias("origin_id"))
    z, spark = F.col("zone_id"), t("zones").sparkSession
    firms = t("enterprises").select("enterprise_id", "x", "y", F.lit("CH").alias("n0"), F.concat(F.lit("CH"), (z % 5).cast("string")).alias("n1"), F.concat(F.lit("CH"), F.lpad(z.cast("string"), 2, "0")).alias("n2"))
    centres = spark.createDataFrame([(f"DE{k}", x, y) for k, x, y in ABROAD], "zone_id string, x double, y double")
    border = spark.createDataFrame([([dict(zip("xy", p, strict=True)) for p in BORDER],)], "ring array<struct<x: double, y: double>>")
    return freight.freight_places(trips, firms, ["n0", "n1", "n2"], spatial.border_points(centres, border), "origin_id", "CH", 16, "origin").select("trip_id", "zone_id", "enterprise_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("m21_freight_departures", f"SELECT o_orderkey AS trip_id, (floor({hashed(17, 'hour', 'o_orderkey')} * 24) * 3600 + floor({hashed(17, 'second', 'o_orderkey')} * 3600))::BIGINT AS departure_time FROM orders")
def _(t):
    hours = t("nation").filter("n_nationkey < 24").select(F.col("n_nationkey").alias("hour"), (F.col("n_nationkey") / 24.0).alias("cdf_before"), ((F.col("n_nationkey") + 1) / 24.0).alias("cdf"))
    return freight.freight_departures(t("orders").select(F.col("o_orderkey").alias("trip_id")), hours, 17)


# Exports

PLAN = "struct<activities: array<struct<purpose: string, start_time: bigint, end_time: bigint, x: double, y: double>>, legs: array<struct<mode: string, departure_time: bigint>>, vehicles: map<string, string>>"


def _read_plans(plans):
    """What the plans' JSON says: purposes, modes, sums of coordinates and times, and the car."""
    p = plans.withColumn("p", F.from_json("plan", PLAN))
    total = lambda c: F.aggregate(F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return p.select(
        "person_id", "n_activities", "n_legs", F.array_join("p.activities.purpose", "-").alias("purposes"), F.array_join("p.legs.mode", "-").alias("modes"),
        total(F.col("p.activities.x")).alias("x"), total(F.col("p.activities.y")).alias("y"), total(F.col("p.activities.start_time")).alias("starts"), total(F.col("p.legs.departure_time")).alias("departures"), F.col("p.vehicles")["car"].alias("car"),
    )


@query("s12_person_plans", f"""SELECT person_id, n_activities, n_activities - 1 AS n_legs, purposes, coalesce(modes, '') AS modes, x, y, starts, coalesce(departures, 0) AS departures, person_id::VARCHAR || ':car' AS car FROM
  (SELECT l.person_id, count(*) AS n_activities, string_agg(l.purpose, '-' ORDER BY l.activity_index) AS purposes, sum(l.x)::DOUBLE AS x, sum(l.y)::DOUBLE AS y, coalesce(sum(f.start_time), 0)::DOUBLE AS starts FROM {LOCATED} l JOIN {FULL} f ON f.person_id = l.person_id AND f.activity_index = l.activity_index GROUP BY 1)
  LEFT JOIN (SELECT person_id, string_agg(mode, '-' ORDER BY trip_index) AS modes, sum(departure_time)::DOUBLE AS departures FROM {INDEXED} GROUP BY 1) USING (person_id)""")
def _(t):
    acts = population.complete_activities(population.activities(_indexed(t)), population.closing_activity(_indexed(t)), t("persons"))
    acts = acts.join(_located(t).select("person_id", "activity_index", "x", "y"), ["person_id", "activity_index"])
    return _read_plans(tables.person_plans(acts, _indexed(t), recode.vehicles(t("persons"), "car", "person_id")))


@query("s13_household_export", "SELECT household_id, string_agg(person_id::VARCHAR, ',' ORDER BY person_id) AS members, arg_min([1000, 3000, 5000, 7000, 9000, 11000, 13000, 15000, 17000][person_id % 9 + 1], person_id) AS income, arg_min(CASE WHEN person_id % 5 >= 3 THEN '3+' ELSE (person_id % 5)::VARCHAR END, person_id) AS car_label, arg_min(CASE person_id % 3 WHEN 2 THEN 'FOR_ALL' WHEN 1 THEN 'FOR_SOME' ELSE 'FOR_NONE' END, person_id) AS bike_label FROM {persons} GROUP BY 1")
def _(t):
    k = F.col("person_id")
    rows = t("persons").select("household_id", "person_id", (k % 9).alias("income_class"), F.least(k % 5, F.lit(3)).alias("number_of_cars_class"), (k % 3).alias("number_of_bikes_class"))
    return tables.household_export(recode.household_labels(rows, tuple(range(1000, 18000, 2000))), ("car_label", "bike_label"))


@query("s14_facility_export", "SELECT enterprise_id::VARCHAR AS facility_id, x, y, 'work' || CASE WHEN noga LIKE '85%' THEN ',education' ELSE '' END || CASE WHEN noga LIKE '56%' THEN ',leisure' ELSE '' END || CASE WHEN noga LIKE '47%' THEN ',shop' ELSE '' END || ',other' AS activities FROM {enterprises} UNION ALL SELECT DISTINCT 'home' || household_id::VARCHAR, home_x, home_y, 'home' FROM {persons}")
def _(t):
    destinations = recode.offers(t("enterprises")).withColumnRenamed("enterprise_id", "destination_id")
    return tables.facility_export(destinations, t("persons").select("household_id", F.col("home_x").alias("x"), F.col("home_y").alias("y")))


@query("s15_vehicle_export", "SELECT 'type' AS kind, 'default_car' AS id, NULL::VARCHAR AS type_id UNION ALL SELECT 'vehicle', person_id::VARCHAR || ':car', 'default_car' FROM {persons}")
def _(t):
    cars = recode.vehicles(t("persons"), "car", "person_id")
    return tables.vehicle_export(cars.select("type_id").distinct(), cars)


@query("s17_freight_plans", "SELECT trip_id, '[{\"type\":\"loading\",\"end_time\":' || d::VARCHAR || '},{\"type\":\"unloading\",\"end_time\":' || least(d + 3600, 108000)::VARCHAR || '}]' AS plan FROM (SELECT o_orderkey AS trip_id, o_orderkey % 120000 AS d FROM orders)")
def _(t):
    return tables.freight_plans(t("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 120000).alias("departure_time")))


@query("s18_survey_plans", """SELECT person_id, count(*) + 1 AS n_activities, count(*) AS n_legs, 'home-' || string_agg(purpose, '-' ORDER BY trip_id) AS purposes, string_agg(mode, '-' ORDER BY trip_id) AS modes, (sum(origin_x) + arg_max(destination_x, trip_id))::DOUBLE AS x,
  (sum(origin_y) + arg_max(destination_y, trip_id))::DOUBLE AS y, sum(arrival_time)::DOUBLE AS starts, sum(departure_time)::DOUBLE AS departures, NULL::VARCHAR AS car FROM {trips} GROUP BY 1""")
def _(t):
    places_ = t("trips").select("person_id", (F.col("trip_id") - 1).alias("trip_index"), "origin_x", "origin_y", "destination_x", "destination_y")
    trips = _indexed(t).join(places_, ["person_id", "trip_index"])
    return _read_plans(tables.person_plans(population.activities(trips).unionByName(population.closing_activity(trips)), trips))


# Readers and writers: the tables are written in the inputs' formats and read again.

def _written(t, what: str) -> str:
    return f"{shared_folder(t('nation').sparkSession)}/{what}-{uuid.uuid4().hex}"


def _as_csv(df, path: str, sep: str = ";", encoding: str = "UTF-8") -> str:
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


@query("s01_read_delimited", "SELECT person_id, age::INT AS age, 'Größe ' || sex::VARCHAR AS label FROM {persons}")
def _(t):
    raw = t("persons").select(F.col("person_id").alias("Id"), F.concat(F.lit(" "), F.col("age").cast("string")).alias("Änderung"), F.concat(F.lit("Größe "), F.col("sex").cast("string")).alias("label"), F.lit("x").alias("unused"))
    path = _as_csv(raw, _written(t, "s01"), encoding="ISO-8859-1")
    return tables.read_delimited(raw.sparkSession, path, {"Id": "long", "Änderung": "int", "label": "string"}, {"Id": "person_id", "Änderung": "age"})


@query("s02_read_parts", "SELECT person_id, (person_id % 7 + 0.5)::DOUBLE AS weight FROM {persons}")
def _(t):
    rows = t("persons").select("person_id", (F.col("person_id") % 7 + F.lit(0.5)).alias("w"))
    paths = [(_as_csv(rows.filter(f"person_id % 2 = {k}").withColumnRenamed("w", f"w{k}"), _written(t, "s02")), f"w{k}") for k in (0, 1)]
    return tables.read_parts(rows.sparkSession, paths, {"person_id": "long"}).select("person_id", "weight")


@query("s03_read_survey", "SELECT o_orderkey AS order_id, strftime(o_orderdate::DATE, '%Y%m') AS month FROM orders")
def _(t):
    path = _as_csv(t("orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").cast("string").alias("day")), _written(t, "s03"), ",", "ISO-8859-1")
    return tables.read_survey(t("orders").sparkSession, path, {"order_id": "long"}, "day").select("order_id", F.date_format("day", "yyyyMM").alias("month"))


@query("s04_read_enterprises", "SELECT x::DOUBLE AS x, y::DOUBLE AS y, noga, employees::DOUBLE AS number_employees, row_number() OVER (ORDER BY x, y, noga, employees) - 1 AS enterprise_id FROM {enterprises}")
def _(t):
    raw = t("enterprises").select(F.col("employees").alias("EMPTOT"), F.col("x").alias("METER_X"), F.col("y").alias("METER_Y"), F.col("noga").alias("NOGA08_CD"), F.lit("x").alias("unused"))
    return tables.read_enterprises(raw.sparkSession, _as_csv(raw, _written(t, "s04"), ",", "ISO-8859-1"))


@query("s05_read_freight", "SELECT agent_id, journey_id, leg_order, week FROM {legs} JOIN (SELECT agent_id, max(week) AS w FROM {legs} GROUP BY 1) USING (agent_id)")
def _(t):
    legs, folder = t("legs"), _written(t, "s05")
    _as_csv(legs.select("agent_id", "journey_id", "leg_order", "week"), f"{folder}/transport.csv")
    _as_csv(legs.select("agent_id", "journey_id").distinct(), f"{folder}/journeych.csv")
    _as_csv(legs.groupBy("agent_id").agg(F.max("week").alias("last_week")), f"{folder}/week.csv")
    read = tables.read_freight(legs.sparkSession, folder)
    return freight.freight_legs(read["transport"], read["journey"], read["week"]).select(*(F.col(c).cast("long") for c in ("agent_id", "journey_id", "leg_order", "week")))


@query("s05_read_departure_times", "SELECT n_nationkey::INT AS hour, round((sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) - n_regionkey - 1) / sum(n_regionkey + 1) OVER (), 9) AS cdf_before, round(sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) / sum(n_regionkey + 1) OVER (), 9) AS cdf FROM nation WHERE n_nationkey < 24")
def _(t):
    raw = t("nation").filter("n_nationkey < 24").select(F.col("n_nationkey").alias("hour"), (F.col("n_regionkey") + 1).alias("share"))
    return tables.read_departure_times(raw.sparkSession, _as_csv(raw, _written(t, "s05"))).select("hour", F.round("cdf_before", 9).alias("cdf_before"), F.round("cdf", 9).alias("cdf"))


@query("s06_read_projection", "SELECT zone_id, zone_id * 40 AS n FROM {zones}")
def _(t):
    rows = t("zones").select("zone_id", F.explode(F.array(F.lit(2030), F.lit(2040))).alias("year"))
    path = _as_csv(rows.withColumn("n", F.col("zone_id") * (F.col("year") - 2000)), _written(t, "s06"), ",")
    return tables.read_projection(rows.sparkSession, path, 2040).select(F.col("zone_id").cast("long"), F.col("n").cast("long"))


PARTED = "(SELECT home_x // 20000 + 5 * (home_y // 20000) AS zone_id, home_x % 20000 AS dx, home_y % 20000 AS dy FROM {persons})"


@query("s07_read_zones", f"SELECT z.zone_id::VARCHAR AS zone_id, z.name, 2 AS parts, 3 AS rings, count(p.dx) AS persons FROM {{zones}} z LEFT JOIN (SELECT * FROM {PARTED} WHERE (dx < 8000 OR dx >= 12000) AND NOT (dx BETWEEN 2000 AND 3999 AND dy BETWEEN 2000 AND 3999)) p ON p.zone_id = z.zone_id GROUP BY 1, 2")
def _(t):
    """Each zone as two parts, the first with a hole; points are then looked up in what is read."""
    def ring(x0, y0, x1, y1):
        points = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
        return F.array(*(F.array((F.col("min_x") + a).cast("double"), (F.col("min_y") + b).cast("double")) for a, b in points))

    parts = F.array(F.array(ring(0, 0, 8000, 20000), ring(2000, 2000, 4000, 4000)), F.array(ring(12000, 0, 20000, 20000)))
    feature = F.struct(F.struct(F.col("zone_id").alias("code"), "name").alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"))
    path = _written(t, "s07")
    t("zones").select(F.to_json(feature)).write.text(path)
    layer = tables.read_zones(t("zones").sparkSession, path, "code", "name")
    inside = spatial.point_in_zone(_points(t), layer).groupBy("zone_id").agg(F.count("*").alias("persons"))
    return layer.select("zone_id", "name", "parts", F.size("rings").alias("rings")).join(inside, "zone_id", "left").withColumn("persons", F.coalesce("persons", F.lit(0)))


LAYOUTS = "(SELECT unnest(['one line', 'many lines', 'line by line', 'text', 'rings']) AS layout)"


@query("s07_zone_layouts", f"SELECT layout, z.zone_id::VARCHAR AS zone_id, z.name, z.min_x::DOUBLE AS min_x, z.min_y::DOUBLE AS min_y, count(p.dx) AS persons FROM {LAYOUTS} CROSS JOIN {{zones}} z LEFT JOIN (SELECT * FROM {PARTED} WHERE dx + dy < 19999 AND NOT (dx BETWEEN 2000 AND 3999 AND dy BETWEEN 2000 AND 3999)) p ON p.zone_id = z.zone_id GROUP BY ALL")
def _(t):
    """Triangular zones with a hole in five layouts, one of them in another coordinate system; points are looked up in each."""
    spark, folder = t("zones").sparkSession, _written(t, "s07_layouts")

    def rings(of, dx=0.0, dy=0.0):
        corners = (((0, 0), (20000, 0), (0, 20000), (0, 0)), ((2000, 2000), (4000, 2000), (4000, 4000), (2000, 4000), (2000, 2000)))
        return F.array(*(F.array(*(of((F.col("min_x") + a).cast("double") - dx, (F.col("min_y") + b).cast("double") - dy) for a, b in ring)) for ring in corners))

    z = t("zones")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone_id").alias("code"), "name").alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings(F.array).alias("coordinates")).alias("geometry"))
    old = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone_id").alias("code"), "name").alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings(F.array, 2e6, 1e6).alias("coordinates")).alias("geometry"))
    whole = lambda f: F.struct(F.lit("FeatureCollection").alias("type"), F.lit("zones").alias("title"), F.collect_list(f).alias("features"))
    z.agg(F.to_json(whole(feature)).alias("value")).write.text(f"{folder}/one_line")
    z.agg(F.to_json(whole(old), {"pretty": "true"}).alias("value")).write.text(f"{folder}/many_lines")
    z.select(F.to_json(feature).alias("value")).write.text(f"{folder}/line_by_line")
    points = F.transform(rings(F.array), lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")")))
    z.select(F.col("zone_id").alias("code"), "name", F.concat(F.lit("POLYGON ("), F.array_join(points, ", "), F.lit(")")).alias("wkt")).write.csv(f"{folder}/text", header=True, sep=";")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    read = {
        "one line": layers.read_geojson(spark, f"{folder}/one_line", "code", "name"),
        "many lines": layers.read_geojson(spark, f"{folder}/many_lines", "code", "name", crs="lv03"),
        "line by line": layers.read_geojson(spark, f"{folder}/line_by_line", "code", "name"),
        "text": layers.read_wkt(spark, f"{folder}/text", "code", "name"),
        "rings": layers.from_rings(z.select("zone_id", "name", rings(point).alias("rings"))),
    }
    out = []
    for layout, layer in read.items():
        inside = spatial.point_in_zone(_points(t), layer).groupBy("zone_id").agg(F.count("*").alias("persons"))
        out.append(layer.select("zone_id", "name", "min_x", "min_y").join(inside, "zone_id", "left").select(F.lit(layout).alias("layout"), "zone_id", "name", "min_x", "min_y", F.coalesce("persons", F.lit(0)).alias("persons")))
    return reduce(DataFrame.unionByName, out)


@query("s08_read_feed", f"SELECT 'stop_times' AS slot, trip_id::VARCHAR AS a, stop_id AS b FROM {TIMES} UNION ALL SELECT 'trips', o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    feed = freight.clean_references(freight.drop_empty_service(_feed(t)))
    feed["calendar"] = feed["trips"].select("service_id").distinct()
    folder = _written(t, "s08")
    tables.write_feed(feed, f"{folder}/inner/feed")
    read = tables.read_feed(t("orders").sparkSession, folder)
    times = read["stop_times"].select(F.lit("stop_times").alias("slot"), F.col("trip_id").alias("a"), F.col("stop_id").alias("b"))
    return times.unionByName(read["trips"].select(F.lit("trips").alias("slot"), F.col("trip_id").alias("a"), F.col("service_id").alias("b")))


@query("s09_select_inputs", "SELECT max('zones_' || n_name || '.csv') AS path FROM nation")
def _(t):
    names = [f"in/{kind}_{r.n_name}.csv" for kind in ("zones", "other") for r in t("nation").select("n_name").collect()]  # 25 nations
    return t("nation").limit(1).select(F.lit(tables.select_inputs(names, "^zones")[3:]).alias("path"))


@query("s10_write_population", "SELECT person_id, age, canton_id FROM {persons}")
def _(t):
    folder = _written(t, "s10")
    tables.write_population({"persons": t("persons").select("person_id", "age", "canton_id")}, folder, "canton_id")
    return t("persons").sparkSession.read.option("sep", ";").option("header", True).csv(f"{folder}/persons").select(*(F.col(c).cast("long") for c in ("person_id", "age", "canton_id")))


@query("s11_write_spatial", "SELECT order_id, printf('LINESTRING (%.3f %.3f, %.3f %.3f)', origin_x::DOUBLE, origin_y::DOUBLE, destination_x::DOUBLE, destination_y::DOUBLE) AS geometry FROM {trips}")
def _(t):
    folder = _written(t, "s11")
    ends = {"ox": "origin_x", "oy": "origin_y", "dx": "destination_x", "dy": "destination_y"}
    tables.write_spatial({"trips": t("trips").select("order_id", *(F.col(c).cast("double").alias(a) for a, c in ends.items()))}, folder)
    return t("trips").sparkSession.read.parquet(f"{folder}/trips").select("order_id", "geometry")


@query("s16_write_feed", "SELECT 'stop_id,location_type,ext_note' AS line, 1 AS n UNION ALL SELECT 'stop ' || p_partkey::VARCHAR || ',' || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '' END || ',x', 1 FROM part WHERE p_partkey % 5 <> 0")
def _(t):
    """The lines of the stops' file: one file, one header."""
    folder = _written(t, "s16")
    tables.write_feed(_feed(t), folder)
    return t("part").sparkSession.read.text(f"{folder}/stops.txt").groupBy(F.col("value").alias("line")).agg(F.count("*").cast("int").alias("n"))


@query("flagship_chain_shares", f"WITH c AS (SELECT chain, sum(weight) AS n FROM {CHAINS} GROUP BY 1) SELECT chain, n::BIGINT AS n, round(n * 100.0 / (SELECT sum(n) FROM c), 9) AS share FROM c ORDER BY n DESC, chain LIMIT 20")
def flagship(t):
    """Trips to activity chains to their weighted shares; the most frequent chains."""
    return validate.top_chains(validate.shares(validate.chain_counts(_chains(t), "weight")), 20).withColumn("share", F.round("share", 9))
