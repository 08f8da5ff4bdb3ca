"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, uniform, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source's own size
SEED = 17
FEW = 10_000  # sources whose rates are sent to every task


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, size) rows: source, source_size and target.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    sizes by weight; what a source gets beyond ``most`` times its size goes to the others by weight,
    until none is above.  In the order of limit over weight the sources at their limit come first,
    so the level (tokens for a unit of weight) that the others reach is the largest of the levels
    that follow from any number of leading sources at their limit.  The windows see a row for each
    source, in one task.  No rows give no targets.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    spare = total * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    by = by.withColumn("level", spare / F.sum("weight").over(after))
    level = F.max("level").over(Window.partitionBy())
    return by.select("source", "source_size", F.least(F.col("limit").cast("double"), level * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """For each row of ``docs``: doc_id, size (words), source, source_size, target (its source's),
    rate (target over source_size), copies and taken (words that the mix takes).

    A row is taken floor(rate) times, and once more if its uniform (a hash of the seed and its id) is
    below the rest.  So reruns agree, and rows of one id agree; a null id counts as a key of its
    own.  Null text has size 0; a null source is a source.  A source of size 0 has target 0 and
    rate 0.  An empty table gives an empty one.  Other columns play no part.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    sizes = saved(sizes)
    by = targets(sizes).withColumnRenamed("source", "of")
    by = saved(by)
    joined = sizes.join(F.broadcast(by) if by.count() <= FEW else by, sizes.source.eqNullSafe(by.of)).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    whole = F.floor("rate")
    copies = whole + (uniform(seed, F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns and whatever their names, as often as ``mixture`` takes them.

    Null texts, ids and sources, repeated rows and empty tables are as in ``mixture``.  Up to FEW
    sources the rates go to the rows, which stay where they are; beyond, Spark picks the join.
    """
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    by = saved(targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.select(F.struct(F.col("source").alias("name"), rate.alias("rate")).alias("of"))
    if by.count() <= FEW:
        by = F.broadcast(by)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"))
    rows = rows.join(by, F.col("source").eqNullSafe(F.col("of.name")))
    whole = F.floor("of.rate")
    copies = whole + (uniform(seed, F.col("id")) < F.col("of.rate") - whole).cast("long")
    copy = F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>")))
    return rows.withColumn("copy", copy).select("row.*")
