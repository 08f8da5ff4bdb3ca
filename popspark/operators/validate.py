"""Comparison of synthetic trips with the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity_chains(trips: DataFrame, by: list[str]) -> DataFrame:
    """Purposes of a day in order, beginning at home: 'home-work-home'."""
    steps = F.array_sort(F.collect_list(F.struct("trip_id", "purpose")))
    return trips.groupBy(*by).agg(steps.alias("steps")).select(*by, F.concat(F.lit("home-"), F.array_join(F.transform("steps", lambda s: s["purpose"]), "-")).alias("chain"))


def chain_counts(chains: DataFrame, weight: str | None = None) -> DataFrame:
    return chains.groupBy("chain").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """Percentages of the total, which is one row."""
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") * 100.0 / F.col("__total")).drop("__total")


def top_chains(compared: DataFrame, n: int) -> DataFrame:
    return compared.orderBy(F.col("n").desc(), "chain").limit(n)


def compare(synthetic: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    a, b = synthetic.select(key, F.col("n").alias("synthetic")), actual.select(key, F.col("n").alias("actual"))
    return a.join(b, key, "full").select(key, F.coalesce("synthetic", F.lit(0)).alias("synthetic"), F.coalesce("actual", F.lit(0)).alias("actual"))


def activity_count_hist(counts: DataFrame, top: int = 7) -> DataFrame:
    """Chains by how many activities they have besides home at both ends; the last class is open."""
    k = F.least(F.size(F.split("chain", "-")) - 2, F.lit(top))
    return counts.groupBy(k.alias("activities")).agg(F.sum("n").alias("n"))


def purpose_multiplicity(counts: DataFrame) -> DataFrame:
    """How often chains have a purpose once, twice, ...: 'work - 2 times'."""
    parts = counts.select("chain", "n", F.explode(F.split("chain", "-")).alias("purpose")).filter("purpose != 'home'")
    times = parts.groupBy("chain", "n", "purpose").agg(F.count("*").alias("times"))
    return times.groupBy(F.concat_ws(" ", F.col("purpose"), F.lit("-"), F.col("times").cast("string"), F.lit("times")).alias("label")).agg(F.sum("n").alias("n"))


def mean_distance(trips: DataFrame, by: str, weight: str = "weight", distance: str = "distance") -> DataFrame:
    return trips.groupBy(by).agg(F.avg(distance).alias("mean"), (F.sum(F.col(distance) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def mode_purpose_share(trips: DataFrame, weight: str = "weight") -> DataFrame:
    sums = trips.groupBy("mode", "purpose").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    total = sums.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    return sums.join(F.broadcast(total)).select("mode", "purpose", (F.col("n") / F.col("all_n")).alias("share"), (F.col("weight") / F.col("all_weight")).alias("weighted_share"))


def distance_hist(trips: DataFrame, by: str, top: float = 25.0, edges: int = 120, weight: str = "weight") -> DataFrame:
    """Weighted density over equal bins from 0 to ``top`` km; the upper end belongs to the last bin."""
    width = top / (edges - 1)
    k = F.least(F.floor(F.col("km") / width), F.lit(edges - 2))
    sums = trips.filter((F.col("km") >= 0) & (F.col("km") <= top)).groupBy(by, k.alias("bin")).agg(F.sum(weight).alias("weight"))
    return sums.select(by, "bin", (F.col("weight") / F.sum("weight").over(Window.partitionBy(by)) / width).alias("density"))


def mobility_tools(population: DataFrame, survey: DataFrame, tools: list[str]) -> DataFrame:
    """People in each class of each tool, in the population and (by weight) in the survey."""
    kinds = F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.col(t).cast("string").alias("value")) for t in tools)))
    a = population.select(kinds.alias("k")).groupBy("k.tool", "k.value").agg(F.count("*").alias("synthetic"))
    b = survey.select("weight", kinds.alias("k")).groupBy("k.tool", "k.value").agg(F.sum("weight").alias("actual"))
    return a.join(b, ["tool", "value"], "full").select("tool", "value", F.coalesce("synthetic", F.lit(0)).alias("synthetic"), F.coalesce("actual", F.lit(0)).alias("actual"))


def quality_report(rules: dict[str, DataFrame], key: str = "person_id") -> DataFrame:
    """How many ids each rule rejects."""
    out = None
    for name, ids in rules.items():
        row = ids.agg(F.countDistinct(key).alias("rejected")).select(F.lit(name).alias("rule"), "rejected")
        out = row if out is None else out.unionByName(row)
    return out


def home_primary_distance(trips: DataFrame, purpose: str) -> DataFrame:
    """The distance of each person's first trip from home to the purpose."""
    w = Window.partitionBy("person_id").orderBy("trip_id")
    first = trips.filter((F.col("preceding_purpose") == "home") & (F.col("purpose") == purpose)).withColumn("__r", F.row_number().over(w))
    return first.filter("__r = 1").select("person_id", "distance")


def success_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.avg(F.col("valid").cast("double")).alias("rate"))
