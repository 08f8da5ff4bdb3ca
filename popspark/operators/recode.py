"""Projections, filters and recodes of the survey, census, enterprise and freight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as c
from ..functions.scalar import digitize, lookup


def recode_mode(trips: DataFrame, code: str = "mode_code") -> DataFrame:
    """Adds mode and mode_detailed (plane and taxi apart)."""
    mode = lookup(F.col(code), c.TRIP_MODES)
    return trips.withColumn("mode", mode).withColumn("mode_detailed", lookup(F.col(code), c.DETAILED_MODES, mode))


def recode_purpose(trips: DataFrame, code: str = "purpose_code", way: str = "way_code") -> DataFrame:
    """Adds purpose; a return trip (way code above 1) goes home."""
    return trips.withColumn("purpose", F.when(F.col(way) > 1, "home").otherwise(lookup(F.col(code), c.TRIP_PURPOSES)))


def recode_marital(df: DataFrame, code: str = "marital_code") -> DataFrame:
    return df.withColumn("marital_status", lookup(F.col(code), c.MARITAL_STATUS))


def fix_marital_status(df: DataFrame) -> DataFrame:
    """Young separate persons count as single."""
    young = (F.col("marital_status") == c.SEPARATE) & (F.col("age") < c.SEPARATE_SINGLE_AGE)
    return df.withColumn("marital_status", F.when(young, c.SINGLE).otherwise(F.col("marital_status")))


def recode_commute_mode(df: DataFrame, code: str = "mode_code") -> DataFrame:
    return df.withColumn("mode", lookup(F.col(code), c.COMMUTE_MODES))


def age_class(df: DataFrame, census: c.Census = c.STATPOP) -> DataFrame:
    return df.withColumn("age_class", digitize(F.col("age"), census.age_bounds))


def household_size_class(df: DataFrame, census: c.Census = c.STATPOP) -> DataFrame:
    size = F.col("household_size")
    if census is c.STATPOP:
        return df.withColumn("household_size_class", F.least(F.lit(5), size) - 1)
    return df.withColumn("household_size_class", lookup(size, {1: "1", 2: "2", 3: "3-4", 4: "3-4"}, "5+"))


def clamp_classes(df: DataFrame) -> DataFrame:
    """Cars not below 0 and in classes up to 3; income zero-based, what is invalid -1."""
    cars = F.greatest(F.lit(0), F.col("cars"))
    return df.withColumn("number_of_cars", cars).withColumn("number_of_cars_class", F.least(F.lit(c.MAX_CARS_CLASS), cars)).withColumn("income_class", F.greatest(F.lit(-1), F.col("income_code") - 1))


def bike_class(df: DataFrame) -> DataFrame:
    """Bikes for nobody, some or all of the household."""
    n = F.col("number_of_bikes")
    value = F.when(n >= F.col("household_size"), c.BIKES_ALL).when(n > 0, c.BIKES_SOME).otherwise(c.BIKES_NONE)
    return df.withColumn("number_of_bikes_class", value)


def subscription_class(df: DataFrame) -> DataFrame:
    """Later kinds win over earlier ones: none, GA, half fare, regional, half fare and regional."""
    regional = F.col("subscriptions_verbund") | F.col("subscriptions_verbund_class")
    value = F.when(F.col("subscriptions_halbtax") & regional, "HTA+VA").when(regional, "VA").when(F.col("subscriptions_halbtax"), "HTA")
    return df.withColumn("subscriptions", value.when(F.col("subscriptions_ga") | F.col("subscriptions_ga_class"), "GA").otherwise("null"))


def employment_status(df: DataFrame) -> DataFrame:
    """Later rules win: working students, students, the young, the active; else inactive."""
    value = F.when((F.col("job_a") == 32) | (F.col("job_b") == 32), "working student").when((F.col("study_a") == 32) | (F.col("study_b") == 32), "student")
    value = value.when(F.col("age") < 15, "student").when((F.col("work_code") > 0) & (F.col("work_code") < 5), "active").when(F.col("work_code") == 5, "working student")
    return df.withColumn("employment_status", value.otherwise("inactive"))


def education_level(df: DataFrame, code: str = "education_code") -> DataFrame:
    return df.withColumn("highest_education", lookup(F.col(code), {k: name for name, codes in c.HIGHEST_EDUCATION.items() for k in codes}))


def survey_flags(df: DataFrame) -> DataFrame:
    """License, car availability, employment, weekend and parking of a survey person."""
    return df.select(
        "*",
        (F.col("license_code") == 1).alias("driving_license"),
        lookup(F.col("car_code"), {1: c.CAR_ALWAYS, 2: c.CAR_SOMETIMES}, c.CAR_NEVER).alias("car_availability"),
        (F.col("work_code") != -99).alias("employed"),
        F.col("weekday").isin(6, 7).alias("weekend"),
        lookup(F.col("parking_code"), c.PARKING, "unknown").alias("parking_work"),
        F.greatest(F.lit(0.0), F.col("parking_fee").cast("double")).alias("parking_cost_work"),
    )


def recode_synpop(df: DataFrame) -> DataFrame:
    """The alternative census in the classes of the survey."""
    child = (F.col("age") == "0-17") & (F.col("education") == "primary") & F.col("position_in_edu").isNull() & F.col("position_in_bus").isNull()
    band = F.when(child, "0-5").when(F.col("age") == "0-17", "6-17").otherwise(F.col("age"))
    edu, bus = F.col("position_in_edu"), F.col("position_in_bus").isNotNull()
    status = F.when(edu == "pupil", "student").when((edu == "apprentice") | ((edu == "student") & bus), "working student").when(edu == "student", "student")
    status = status.when(edu.isNull() & bus, "active").when(edu.isNull(), "inactive")
    return df.select(
        "person_id",
        lookup(F.col("sex"), {"M": 0, "F": 1}).alias("sex"),
        lookup(F.col("nation"), {"swiss": 0, "non-swiss": 1}).alias("nationality"),
        lookup(band, c.SYNPOP_AGES).alias("age_class"),
        status.alias("employment_status"),
        F.when(F.col("cars_in_hh") == "3+", "3").otherwise(F.col("cars_in_hh")).cast("int").alias("number_of_cars_class"),
        F.when(F.col("bike_ownership") == "null", c.BIKES_NONE).otherwise(c.BIKES_ALL).alias("number_of_bikes_class"),
    )


def sp_region(df: DataFrame) -> DataFrame:
    return df.withColumn("sp_region", lookup(F.col("canton_id"), {k: r for r, ids in c.SP_REGIONS.items() for k in ids}, 0))


def education_type(enterprises: DataFrame) -> DataFrame:
    value = None
    for prefix, name in c.EDUCATION_PREFIXES.items():
        hit = F.col("noga").startswith(prefix)
        value = F.when(hit, name) if value is None else value.when(hit, name)
    return enterprises.withColumn("education_type", value)


def offers(enterprises: DataFrame) -> DataFrame:
    noga = F.col("noga")
    return enterprises.select(
        "*", F.lit(True).alias("offers_work"), F.lit(True).alias("offers_other"), noga.startswith("85").alias("offers_education"),
        (noga.startswith("90") | noga.startswith("56")).alias("offers_leisure"), noga.startswith("47").alias("offers_shop"),
    )


def education_band(persons: DataFrame, census: c.Census = c.STATPOP) -> DataFrame:
    """Which schools a person is sent to; ages on a bound belong to the lower band."""
    if census is c.STATPOP:
        a = F.col("age")
        value = F.when(a <= 6, "kindergarten").when(a <= 12, "primary").when(a <= 16, "secondary").otherwise("tertiary")
    else:
        value = F.when(F.col("age_class") == 0, "kindergarten").when(F.col("age_class") == 1, "primary and secondary").otherwise("tertiary")
    return persons.withColumn("education_band", value)


def filter_residents(persons: DataFrame) -> DataFrame:
    """Permanent population at its main residence, in households of at most twelve."""
    return persons.filter((F.col("population_type") == 1) & (F.col("type_of_residence") == 1) & (F.col("household_size") <= c.MAX_HOUSEHOLD_SIZE))


def normalize_names(df: DataFrame, name: str, ids: DataFrame, total: str) -> DataFrame:
    """Names in one spelling, their ids from ``ids`` (name, id); without the total's row and unknown names."""
    clean = F.trim(F.col(name))
    for wrong, right in (("A. Rh.", "A.Rh."), ("I. Rh.", "I.Rh."), ("Sankt Gallen", "St. Gallen")):
        clean = F.replace(clean, F.lit(wrong), F.lit(right))
    return df.filter(F.col(name) != total).withColumn("name", clean).join(F.broadcast(ids), "name")


def parse_age(text: Column) -> Column:
    """The number before 'Jahr'."""
    return F.trim(F.split(text, "Jahr")[0]).cast("int")


def municipality_type(df: DataFrame) -> DataFrame:
    return df.withColumn("municipality_type", lookup(F.col("type_code"), c.MUNICIPALITY_TYPES))


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.select(
        "person_id", F.coalesce("mz_person_id", F.lit(-1)).alias("mz_person_id"), F.coalesce("ovgk", F.lit("None")).alias("ovgk"),
        F.coalesce("income_class", F.lit(0)).alias("income_class"), F.coalesce("age", F.lit(30)).alias("age"),
    )


def reset_children(df: DataFrame) -> DataFrame:
    """Children below the survey's age: no license, no work, single, no car; nobody drives under 18."""
    child = F.col("age") < c.SURVEY_AGE
    return df.withColumns({
        "driving_license": F.when(child | (F.col("age") < 18), False).otherwise(F.col("driving_license")),
        "employed": F.when(child, False).otherwise(F.col("employed")),
        "marital_status": F.when(child, c.SINGLE).otherwise(F.col("marital_status")),
        "car_availability": F.when(child, c.CAR_NEVER).otherwise(F.col("car_availability")),
    })


def vehicles(owners: DataFrame, mode: str, id_col: str) -> DataFrame:
    """A vehicle of the mode's default type for each owner."""
    return owners.select(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(mode)).alias("vehicle_id"), F.lit(f"default_{mode}").alias("type_id"), F.col(id_col).alias("owner_id"), F.lit(mode).alias("mode"))


def select_population(df: DataFrame, ages: tuple[int, int] | None = None, sex: int | None = None, cantons: list[int] | None = None) -> DataFrame:
    if ages:
        df = df.filter(F.col("age").between(*ages))
    if sex is not None:
        df = df.filter(F.col("sex") == sex)
    return df.filter(F.col("canton_id").isin(cantons)) if cantons else df


def scenario_filter(df: DataFrame, weekend: bool = False) -> DataFrame:
    return df.filter(F.col("weekend") == weekend)


def distance_window(df: DataFrame, km: float = 25.0, col: str = "crowfly_distance") -> DataFrame:
    return df.filter((F.col(col) > 0) & (F.col(col) < km * 1000))


def valid_od(df: DataFrame, modes: tuple[str, ...] = ("car", "pt", "bike", "walk", "car_passenger")) -> DataFrame:
    """Rows with a home and a work zone in the country and a known mode."""
    return df.filter(F.col("home_zone_id").isNotNull() & F.col("work_zone_id").isNotNull() & ~F.col("abroad") & F.col("mode").isin(*modes))


def freight_types(df: DataFrame) -> DataFrame:
    return df.withColumn("vehicle_type", lookup(F.col("vehicle_code"), c.VEHICLE_TYPES, F.col("vehicle_code").cast("string")))


def household_labels(df: DataFrame, incomes: tuple[int, ...]) -> DataFrame:
    """The income of a class, and the labels of cars and bikes."""
    value = F.when(F.col("income_class") >= 0, F.element_at(F.array(*(F.lit(x) for x in incomes)), (F.col("income_class") + 1).cast("int")))
    return df.select(
        "*", value.alias("income"), F.when(F.col("number_of_cars_class") >= c.MAX_CARS_CLASS, "3+").otherwise(F.col("number_of_cars_class").cast("string")).alias("car_label"),
        lookup(F.col("number_of_bikes_class"), {0: "FOR_NONE", 1: "FOR_SOME", 2: "FOR_ALL"}).alias("bike_label"),
    )


def normalize_mode(df: DataFrame) -> DataFrame:
    return df.withColumn("mode", F.when(F.col("mode") == "car_passenger", "car").otherwise(F.col("mode")))


def zones_at_level(zones: DataFrame, prefix: str) -> DataFrame:
    """Regional zones of one country, one row each with its level by the length of its id."""
    return zones.filter(F.col("nuts_id").contains(prefix)).withColumn("level", F.length("nuts_id") - 2)
