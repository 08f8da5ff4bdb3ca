"""Fixed values of the two census variants and of the surveys' code lists."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Census:
    name: str
    age_bounds: tuple[int, ...]


STATPOP = Census("statpop", (6, 15, 18, 24, 30, 45, 65, 80))
SYNPOP = Census("are_synpop", (6, 18, 25, 45, 65, 75))

MAX_HOUSEHOLD_SIZE = 12
MIN_AGE = 16
ACTIVE_AGE = 60
SURVEY_AGE = 6
SEPARATE_SINGLE_AGE = 45
MAX_CARS_CLASS = 3
DENSITY_RADIUS = 2500.0
SINGLE, MARRIED, SEPARATE = 0, 1, 2
CAR_ALWAYS, CAR_SOMETIMES, CAR_NEVER = 0, 1, 2
BIKES_NONE, BIKES_SOME, BIKES_ALL = 0, 1, 2

# Code lists.
TRIP_MODES = {
    -99: "unknown", 1: "pt", 2: "pt", 3: "pt", 4: "pt", 5: "pt", 6: "pt", 7: "pt", 8: "pt", 9: "car", 10: "car", 11: "pt", 12: "car", 13: "car",
    14: "bike", 15: "walk", 16: "bike", 17: "unknown",
}
DETAILED_MODES = {1: "plane", 11: "taxi"}
TRIP_PURPOSES = {
    -99: "unknown", -98: "unknown", -97: "unknown", 1: "interaction", 2: "work", 3: "education", 4: "shop", 5: "other", 6: "work", 7: "work",
    8: "leisure", 9: "other", 10: "other", 11: "home", 12: "unknown", 13: "border",
}
STAGE_MODES = {1: "walk", 9: "rail", 10: "bus", 11: "bus", 12: "tram"}
COMMUTE_MODES = {-10: "unknown", -9: "unknown", -8: "unknown", 1: "walk", 2: "walk", 4: "car", 5: "car", 6: "car", 7: "pt", 8: "pt", 9: "pt", 10: "other", 11: "bike", 12: "bike"}
MARITAL_STATUS = {1: SINGLE, 2: MARRIED, 3: SEPARATE, 4: SEPARATE, 5: SINGLE, 6: MARRIED, 7: SEPARATE, -9: SINGLE}
MUNICIPALITY_TYPES = {0: "rural", 1: "urban", 2: "urban", 3: "urban", 4: "suburban", 5: "suburban", 6: "rural"}
EDUCATION_PREFIXES = {"851": "kindergarten", "852": "primary", "853": "secondary", "854": "tertiary"}
SP_REGIONS = {1: (25, 12, 13, 1, 2, 14, 9), 2: (21, 26, 15, 16, 22, 11, 24, 3, 6, 7), 3: (17, 19, 10, 23, 20, 5, 18, 4, 8)}
VEHICLE_TYPES = {1: "truck", 2: "truck", 3: "truck", 35: "truck", 37: "truck", 38: "truck"}
HIGHEST_EDUCATION = {"primary": range(1, 5), "secondary": range(5, 13), "tertiary_professional": range(13, 17), "tertiary_academic": range(17, 20)}
PARKING = {1: "free", 2: "paid", 3: "no"}
SYNPOP_AGES = {"0-5": 0, "6-17": 1, "18-24": 2, "25-44": 3, "45-64": 4, "65-74": 5, "75+": 6}
FIXED_PURPOSES = ("home", "work", "education")
