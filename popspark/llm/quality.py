"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good or bad on a document or abstains.  Expectation-maximisation estimates how often
each rule is right on good and on bad documents, and how many are good; a document is kept by its
posterior probability.  The estimates need the documents' patterns of votes and how many documents
have each, at most 3 to the number of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, words

ROUNDS = 8
GOOD_SHARE = 0.8  # to begin with
RIGHT_GOOD, RIGHT_BAD = 0.95, 0.3  # how often a vote on a good or a bad document is right, to begin with
LOW, HIGH = 0.02, 0.98  # estimates stay between
KEEP = 0.5  # posterior

SYMBOLS = "#*$%&|<>"

# Several rules look at each kind of fault, as only what other rules bear out counts as one.
# Rule: (bad if this holds, good if this holds); abstains else.  Over the columns of ``measures``.
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "word_size": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "symbol_words": ("10 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
    "symbol_kinds": ("n_symbol_kinds >= 4 and 50 * n_symbols > n_words", "n_symbol_kinds <= 1"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    "shouting": ("10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
    "sentences": ("50 * n_ends < n_words", "25 * n_ends >= n_words"),
}


def _covered(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array.

    The windows' hashes are sorted with their places; equal neighbours repeat.  A place covers three
    words, fewer where the next one begins.
    """
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def once(value: Column, body) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p: F.transform(F.filter(p, lambda x, j: F.coalesce((x.h == F.get(p, j - 1).h) | (x.h == F.get(p, j + 1).h), (x.h == F.get(p, j - 1).h), (x.h == F.get(p, j + 1).h), F.lit(False))), lambda x: x.i)
        gaps = lambda at: F.aggregate(F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
        return once(pairs, lambda p: once(F.sort_array(same(p)), gaps))

    return once(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated(g)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, text_hash and what the rules look at, for each row; ``carry`` comes along as ``carried``.

    Marks, capitals and symbols are cut out of the text once; what is counted is counted in these few.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda characters: (F.length("marks") - F.length(F.translate("marks", characters, ""))).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (F.lit(None) if carry is None else carry).alias("carried"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select("doc_id", "text", "carried", words(F.col("text")).alias("words"), lines.alias("lines"), F.regexp_replace("text", f"[^A-Z.?!{SYMBOLS}]+", "").alias("marks"))
    out = rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        F.when(count(SYMBOLS) > 0, F.regexp_count("text", F.lit(rf"[{SYMBOLS}](?![^\x20\x09-\x0D])"))).otherwise(0).cast("long").alias("n_symbol_words"),
        sum((F.contains(F.col("marks"), F.lit(c)).cast("long") for c in SYMBOLS), F.lit(0).cast("long")).alias("n_symbol_kinds"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("words")).cast("long").alias("n_repeat_words"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count("!").alias("n_shouts"),
        count(".?!").alias("n_ends"),
        "carried",
    )
    return out.drop("carried") if carry is None else out


def votes() -> list[Column]:
    """A column for each rule: -1 bad, 1 good, 0 abstains."""
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}") for name, (bad, good) in RULES.items()]


def _posterior(parameters: dict[str, float]) -> Column:
    """The probability of good by the votes that are cast."""

    def side(share: float, chance) -> Column:
        factors = [F.when(F.col(f"vote_{r}") == 1, chance(r, 1)).when(F.col(f"vote_{r}") == -1, chance(r, -1)).otherwise(1.0) for r in RULES]
        return reduce(lambda a, b: a * b, factors, F.lit(share))

    good = side(parameters["share"], lambda r, v: parameters[f"good_{r}"] if v == 1 else 1 - parameters[f"good_{r}"])
    bad = side(1 - parameters["share"], lambda r, v: parameters[f"bad_{r}"] if v == -1 else 1 - parameters[f"bad_{r}"])
    return good / (good + bad)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation over (vote_..., n): how often each rule's votes are right on good
    and on bad documents, and the share of good ones.  Each round is one aggregate of the patterns."""
    now = {"share": GOOD_SHARE} | {f"good_{r}": RIGHT_GOOD for r in RULES} | {f"bad_{r}": RIGHT_BAD for r in RULES}
    clip = lambda c: F.least(F.greatest(c, F.lit(LOW)), F.lit(HIGH))
    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        share = [clip(F.sum(n * p) / F.sum(n)).alias("share")]
        good = [clip((F.sum(F.when(F.col(f"vote_{r}") == 1, n * p).otherwise(0.0)) + RIGHT_GOOD * 2) / (F.sum(F.when(F.col(f"vote_{r}") != 0, n * p).otherwise(0.0)) + 2)).alias(f"good_{r}") for r in RULES]
        bad = [clip((F.sum(F.when(F.col(f"vote_{r}") == -1, n * (1 - p)).otherwise(0.0)) + RIGHT_BAD * 2) / (F.sum(F.when(F.col(f"vote_{r}") != 0, n * (1 - p)).otherwise(0.0)) + 2)).alias(f"bad_{r}") for r in RULES]
        row = patterns.withColumn("p", _posterior(now)).agg(*share, *good, *bad).first().asDict()
        if row["share"] is None:  # no documents
            return now
        now = row
    return now


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """For each row: doc_id, text_hash, the measures, base_failed, a vote of each rule, quality (the
    posterior probability of good) and kept (quality of at least ``keep``, and not base_failed).

    Null text counts as empty: no words, so base_failed.  A null id stays null; repeated rows are
    judged each, and weigh as many documents in the estimates; an empty table gives an empty one.
    Other columns play no part.  Every text is measured whole.
    """
    rows = saved(measures(docs, id_col, text_col).select("*", *votes()))
    return _judged(rows, _estimated(rows, rounds), keep)


def _estimated(rows: DataFrame, rounds: int) -> dict[str, float]:
    patterns = rows.groupBy(*(f"vote_{r}" for r in RULES)).agg(F.count("*").alias("n"))
    return estimate(saved(patterns), rounds)  # 3 ** len(RULES) patterns at most


def _judged(rows: DataFrame, parameters: dict[str, float], keep: float) -> DataFrame:
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    judged = rows.withColumn("base_failed", failed).withColumn("quality", _posterior(parameters))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever their names.

    Nulls, repeats and empty tables are as in ``judge``: every row is judged by itself.  The texts are
    measured twice, for the estimates and for the verdicts, so that nothing but the patterns is
    written, joined or shuffled.
    """
    # The row's place keeps the filter above the measures, which would else be computed for each rule again.
    rows = measures(docs, id_col, text_col, F.struct("*")).select("*", *votes(), F.monotonically_increasing_id().alias("place"))
    return _judged(rows, _estimated(rows, rounds), keep).filter("kept and place >= 0").select("carried.*")
