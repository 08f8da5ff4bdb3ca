"""Hot-deck matching, replication and reweighting."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..session import saved
from .population import ordered_ranks
from .zones import weighted_cdf, weighted_draw

FEW = 10_000  # cells whose controls are sent to every task


FEW = 100_000  # cells of donors whose counts are sent to every task


def population_controls(persons: DataFrame, keys: list[str], growth: str) -> DataFrame:
    """Persons of each group times the growth (a decimal number), in whole units: exact, as halves go to even numbers."""
    return persons.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.bround(F.col("n") * F.lit(Decimal(growth))).cast("long").alias("target"))


def requirements(first: int, following: Callable[[int], int]) -> list[int]:
    """The numbers of donors asked for one after the other: ``first``, and what ``following`` makes of each, down to 1."""
    out = [first]
    while (after := following(out[-1])) >= 1:
        if after >= out[-1]:
            raise ValueError("the requirement has to decline")
        out.append(after)
    return out


def hot_deck(source: DataFrame, target: DataFrame, columns: list[str], mandatory: int, min_obs: int, seed: int, following: Callable[[int], int] | None = None) -> DataFrame:
    """For each target (target_id) a donor (donor_id, weight) from the finest cell of attributes with
    enough donors: columns go one by one from the end, down to the first ``mandatory`` ones; if even
    these have too few the required number falls to what they have; then fewer columns still.

    Donors are counted once, and these counts summed for each prefix of the columns.  With n(L) donors in the target's cell
    of the first L columns, M mandatory and K columns: m = min(min_obs, n(M)); the level is the largest
    L in M..K with n(L) >= m if m >= 1, else the largest below M with any, else 0 (all donors).  The
    draw is by the weights, in the order of the donors' attributes and ids.  With ``following`` the
    required numbers are min_obs and what it makes of each (``lambda m: m // 2`` halves them), and m is
    the largest of these that n(M) reaches, 0 if it reaches none.
    """
    finest = saved(source.groupBy(*columns).agg(F.count("*").alias("n")))
    few = finest.count() <= FEW
    counted = target
    for level in range(1, len(columns) + 1):
        own = finest.groupBy(*columns[:level]).agg(F.sum("n").alias(f"__n{level}"))
        counted = counted.join(F.broadcast(own) if few else own, columns[:level], "left")
    n = [None, *(F.coalesce(f"__n{k}", F.lit(0)) for k in range(1, len(columns) + 1))]
    need = F.least(F.lit(min_obs), n[mandatory])
    if following is not None:
        need = F.lit(0)
        for m in reversed(requirements(min_obs, following)):
            need = F.when(n[mandatory] >= m, m).otherwise(need)
    level = F.lit(0)
    for k in range(1, mandatory):
        level = F.when(n[k] >= 1, k).otherwise(level)
    fine = F.lit(0)
    for k in range(mandatory, len(columns) + 1):
        fine = F.when(n[k] >= need, k).otherwise(fine)
    placed = counted.withColumn("level", F.when(need >= 1, fine).otherwise(level))
    # A cell is its level and the values of as many columns; structs tell ("a|b", "c") from ("a", "b|c").
    cell = lambda k: F.struct(*((F.col(c) if i < k else F.lit(None)).cast("string").alias(c) for i, c in enumerate(columns)))
    chosen = cell(0)
    for k in range(1, len(columns) + 1):
        chosen = F.when(F.col("level") == k, cell(k)).otherwise(chosen)
    placed = saved(placed.select("target_id", "level", chosen.alias("cell")))
    cells = None
    for k in range(len(columns) + 1):
        part = source.select("donor_id", "weight", F.lit(k).alias("level"), cell(k).alias("cell"))
        cells = part if cells is None else cells.unionByName(part)
    # Only cells that some target is in.  The level of all donors is one cell, which is cut into more parts.
    cells = cells.join(placed.select("level", "cell").distinct(), ["level", "cell"], "left_semi")
    cdf = weighted_cdf(cells, ["level", "cell"], ["donor_id"], ranged=True).select("level", "cell", "donor_id", "cdf_before", "cdf")
    bins = F.when(F.col("level") == 0, 4096).otherwise(64)
    return weighted_draw(placed, uniform(seed, "match", F.col("target_id")), cdf, ["level", "cell"], bins).select("target_id", "level", "donor_id")


def match_levels(matches: DataFrame, levels: int) -> DataFrame:
    """How many targets matched at each level or a finer one."""
    counts = matches.groupBy("level").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_least", F.sum("n").over(w))


def match_population(census: DataFrame, survey: DataFrame, head_columns: list[str], person_columns: list[str], min_obs: int, seed: int) -> DataFrame:
    """Heads by household attributes; then everyone by own attributes and the car class of the head's donor."""
    heads = hot_deck(survey, census.filter("is_head").withColumnRenamed("person_id", "target_id"), head_columns, 1, min_obs, seed)
    cars = survey.select("donor_id", "number_of_cars_class")
    by_house = census.filter("is_head").select("person_id", "household_id").join(heads.withColumnRenamed("target_id", "person_id"), "person_id")
    by_house = by_house.join(cars, "donor_id").select("household_id", F.col("donor_id").alias("mz_head_id"), "number_of_cars_class")
    persons = census.join(by_house, "household_id")
    own = hot_deck(survey, persons.withColumnRenamed("person_id", "target_id"), ["number_of_cars_class", *person_columns], 2, min_obs, seed + 1)
    return persons.select("person_id", "household_id", "mz_head_id").join(own.select(F.col("target_id").alias("person_id"), F.col("donor_id").alias("mz_person_id")), "person_id")


def unmatched(census: DataFrame, matched: DataFrame) -> DataFrame:
    """The persons whom ``match_population`` leaves out, and why: person_id, household_id, reason
    (``no head``: nobody leads the household; ``head without donor``; ``no donor``: for the person)."""
    left = census.join(matched.select("person_id"), "person_id", "left_anti").select("person_id", "household_id")
    led = census.filter("is_head").select("household_id").distinct().withColumn("led", F.lit(True))
    met = matched.select("household_id").distinct().withColumn("met", F.lit(True))
    why = F.when(F.col("led").isNull(), "no head").when(F.col("met").isNull(), "head without donor").otherwise("no donor")
    return left.join(led, "household_id", "left").join(met, "household_id", "left").select("person_id", "household_id", why.alias("reason"))


def replicate(households: DataFrame, persons: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Households as often as the whole part of their weight, and once more with the rest's chance; with
    their members."""
    u = uniform(seed, "replicate", F.col("household_id"))
    copies = F.floor("weight") + (u < F.col("weight") - F.floor("weight")).cast("long")
    out = households.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return out, persons.join(out.select("household_id", "copy"), "household_id")


def scale_to_counts(persons: DataFrame, controls: DataFrame, cell: list[str], seed: int) -> DataFrame:
    """As many persons in each cell as its control says: equal copies, the rest by the order of a hash.

    A cell's persons are ranked in ranges of the hash, so a cell may hold most of them."""
    ranked = ordered_ranks(persons.withColumn("__u", uniform(seed, "scale", F.col("person_id"))), cell, ["__u", "person_id"], "rank", "n")
    x = ranked.join(F.broadcast(controls) if controls.count() <= FEW else controls, cell)
    copies = F.expr("target div n") + (F.col("rank") < F.col("target") % F.col("n")).cast("long")
    return x.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*persons.columns, "copy")


def multinomial_counts(totals: DataFrame, cdf: DataFrame, seed: int) -> DataFrame:
    """Destinations of each origin's units: every unit draws by itself, so the counts are multinomial."""
    units = totals.filter("total > 0").withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))))
    drawn = weighted_draw(units, uniform(seed, "od", F.col("origin_id"), F.col("unit")), cdf, ["origin_id"])
    return drawn.groupBy("origin_id", "destination_id").agg(F.count("*").alias("count"))


LIMITS = ((1e-2, 1.0), (1e-5, 1.0))  # relative and absolute error of household and of person controls


def ipu(types: DataFrame, group: str, controls: list[str], sweeps: int, tolerance: float = 0.0, households: tuple[str, ...] = (), limits: tuple | None = None) -> DataFrame:
    """Weights of household types that meet the controls of each group.

    types: group, type_id, households (how many have this type), n_<control> (members or households of
    a type that count for it) and t_<control> (the group's target).  In each sweep the weights of the
    types with a control are multiplied by target over current sum, control after control in the
    given order.  Types are households with equal counts, so a group's table is small whatever its
    population; groups are independent.

    A group stops after the sweep in which every sum is within ``tolerance`` (if that is given), or (with
    ``limits``) as soon as, after all controls of one kind, both kinds, those named in ``households``
    (which come first) and the others, have errors within their limits: relative, the sum of |sum - target| over the sum of targets, and
    absolute, the same with each difference weighted by its target.
    """

    def close(error: np.ndarray, target: np.ndarray, limit: tuple[float, float]) -> bool:
        total = np.abs(target).sum()
        return not total or (error.sum() / total <= limit[0] and (error * np.abs(target)).sum() / total <= limit[1])

    of_households = np.array([c in households for c in controls], bool)
    ends = np.r_[of_households[1:] != of_households[:-1], True]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("type_id")
        n = pdf[[f"n_{c}" for c in controls]].to_numpy(float)
        many = pdf["households"].to_numpy(float)
        target = pdf[[f"t_{c}" for c in controls]].to_numpy(float)[0]
        weight = np.ones(len(pdf))

        def errors() -> np.ndarray:
            return np.abs((weight * many) @ n - target)

        def converged() -> bool:
            error = errors()
            return all(close(error[kind], target[kind], limit) for kind, limit in ((of_households, limits[0]), (~of_households, limits[1])))

        for _ in range(sweeps):
            for k in range(len(controls)):
                own = n[:, k] > 0
                now = float((weight * many * n[:, k]).sum())
                if now > 0 and target[k] > 0:
                    weight[own] *= target[k] / now
                if limits and ends[k] and converged():
                    break
            else:
                if tolerance and errors().max() <= tolerance:
                    break
                continue
            break
        return pd.DataFrame({group: pdf[group].to_numpy(), "type_id": pdf["type_id"].to_numpy(), "weight": weight})

    kind = dict(types.dtypes)
    return types.groupBy(group).applyInPandas(fit, f"{group} {kind[group]}, type_id {kind['type_id']}, weight double")


def impute_income(survey: DataFrame, features: list[str], seed: int, depth: int = 4) -> DataFrame:
    """Missing income classes (-1), drawn from the probabilities of a decision tree on the known ones.

    The tree is fitted on the survey, whose size does not follow the population's."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(survey)
    known = rows.filter("income_class >= 0").withColumn("label", F.col("income_class").cast("double"))
    model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", minInstancesPerNode=5, seed=seed).fit(known)
    p = vector_to_array("probability")
    scored = model.transform(rows.filter("income_class < 0")).withColumn("p", p).withColumn("u", uniform(seed, "income", F.col("person_id")))
    upto = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.aggregate(F.slice("p", F.lit(1), k), F.lit(0.0), lambda a, b: a + b))
    drawn = F.least(F.size(F.filter(upto, lambda x: x <= F.col("u"))), F.size("p") - 1)
    filled = scored.withColumn("income_class", drawn.cast(survey.schema["income_class"].dataType)).withColumn("imputed", F.lit(True))
    return survey.filter("income_class >= 0").withColumn("imputed", F.lit(False)).unionByName(filled.select(*survey.columns, "imputed"))
