"""URL filters: rules, and gradient-boosted trees on lexical features for what no rule settles.

The trees are fitted on labelled urls.  A part of these is held out to choose the threshold, and
another to see whether the verdicts are better than the more frequent label alone; if they aren't,
the urls say nothing about the labels, and the trees block nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html, quality
from .common import saved

SAMPLE = 20_000  # labelled urls that the trees are fitted on at most
TREES, DEPTH = 20, 4
FIT, CHOOSE, TEST = 3, 1, 1  # fifths of the labelled urls: to fit on, to choose the threshold by, to test on
THRESHOLDS = tuple(k / 20 for k in range(1, 20))
BETTER = 2.0  # standard errors by which the verdicts on the test part have to beat the more frequent label
PRIOR = 20  # labelled urls that a suffix's mean counts the overall mean as
SEED = 5


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def split_url(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host (A-Z lower-cased), path and rest (query and fragment); empty for null or without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = urls.withColumn("after", after)
    cut = cut.withColumn("host", F.translate(F.regexp_extract("after", "^[^/?#]*", 0), upper, lower))
    cut = cut.withColumn("path", F.regexp_extract("after", "^[^/?#]*([^?#]*)", 1))
    return cut.withColumn("rest", F.regexp_extract("after", "(?s)^[^?#]*(.*)$", 1)).drop("after")


def matching(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """(name, verdict) of the longest rule that fits the host or a domain above it and the path, or null."""
    chain = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


FEATURES = ("n_chars", "host_chars", "path_chars", "domains", "depth", "digits", "host_digits", "entropy", "parameters", "has_fragment", "secure", "suffix_rate", "last_part_chars")


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def with_features(urls: DataFrame, url_col: str) -> DataFrame:
    """Lexical features of urls that ``split_url`` has cut; ``suffix_rate`` is not among them yet."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    chars = F.split(url, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(F.length(url), F.lit(1))
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return urls.select(
        "*",
        F.length(url).cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        count(F.col("host"), "[.]").cast("double").alias("domains"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        (count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digits"),
        (count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("host_digits"),
        entropy.alias("entropy"),
        count(F.col("rest"), "=").cast("double").alias("parameters"),
        F.col("rest").contains("#").cast("double").alias("has_fragment"),
        F.lower(url).startswith("https:").cast("double").alias("secure"),
        F.length(F.substring_index("path", "/", -1)).cast("double").alias("last_part_chars"),
        _suffix(F.col("host")).alias("suffix"),
    )


@dataclass(frozen=True)
class HeldOut:
    """What the test part says: urls, the share of its more frequent label, the share of right verdicts."""

    urls: int
    base: float
    right: float

    @property
    def informative(self) -> bool:
        return self.urls > 0 and self.right - self.base > BETTER * (self.base * (1 - self.base) / self.urls) ** 0.5


@dataclass
class UrlModel:
    """Trees, the suffix rates they know and the probability from which they block (none: never);
    without trees one probability for all."""

    trees: object | None
    rates: list[tuple[str, float]]
    mean: float
    threshold: float | None = None
    held_out: HeldOut | None = None

    def block_probability(self, urls: DataFrame, url_col: str) -> DataFrame:
        """Adds block_probability to urls that ``split_url`` has cut."""
        if self.trees is None:
            return urls.withColumn("block_probability", F.lit(self.mean))
        rows = _rated(with_features(urls, url_col), self.rates, self.mean)
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("block_probability"))


def _rated(rows: DataFrame, rates: list[tuple[str, float]], mean: float) -> DataFrame:
    """The suffixes come from the bounded sample, so their table is small."""
    pairs = [x for suffix, rate in rates for x in (F.lit(suffix), F.lit(rate))]
    if not pairs:
        return rows.withColumn("suffix_rate", F.lit(mean))
    spark = rows.sparkSession
    table = spark.createDataFrame(rates, "suffix string, suffix_rate double")
    return rows.join(F.broadcast(table), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(mean)))


def labelled_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id") -> DataFrame:
    """The urls of pages that have a label by their own id, once for each: url, label (1: of low quality or toxic, 0: neither)."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    kinds = labels.select(F.col(label_id_col).alias("of"), bad.cast("double").alias("label")).filter("label is not null")
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(kinds, F.col("id") == F.col("of")).select("url", "label")


def content_labels(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Urls labelled by what their pages say: url, label (1: the quality rules reject the page's main text, 0: they keep it).

    At most ``sample`` urls, those with the smallest hashes, so the sample is as large for any input; of
    several pages of a url the one with the smallest id counts.  Only these pages are parsed and judged.
    Null urls have no label; a page without html has no words, and is rejected.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    chosen = rows.filter("url is not null").groupBy("url").agg(F.min("id").alias("id")).withColumn("at", F.xxhash64("url")).orderBy("at", "url").limit(sample)
    chosen = F.broadcast(saved(chosen.select(F.col("url").alias("of"), F.col("id").alias("own"))))  # ``sample`` rows at most
    texts = html.extract(rows.join(chosen, (F.col("url") == F.col("of")) & F.col("id").eqNullSafe(F.col("own"))).dropDuplicates(["url"]), "id", "url", "html")
    judged = quality.judge(saved(texts), id_col="url", text_col="text")
    return judged.select(F.col("doc_id").alias("url"), (~F.col("kept")).cast("double").alias("label"))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Fit on labelled urls (label 1: block, 0: allow), and say what the held-out ones showed.

    At most ``sample`` of them are used, those with the smallest hashes of their urls, so the sample
    is the same in every run and as large for any input; all rows of a url are in one part.  Rows
    without a label are left out.  Without labels, with labels of one kind only, and where the test
    part shows no gain, nothing is blocked.
    """
    rows = split_url(labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).filter("label is not null"), "url")
    # One task fits the sample in a fixed order, so that reruns give the same trees.
    rows = with_features(rows, "url").withColumn("at", F.xxhash64("url")).orderBy("at", "url").limit(sample).repartition(1).sortWithinPartitions("at", "url").persist()
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col("at")), F.lit(FIT + CHOOSE + TEST))
    fitted = rows.filter(part < FIT)
    try:
        by = fitted.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()  # a row for each suffix of the sample
        total, blocked = sum(r.n for r in by), sum(r.blocked for r in by)
        if blocked in (0, total):  # also without any
            return UrlModel(None, [], blocked / total if total else 0.0)
        mean = blocked / total
        rates = sorted((r.suffix, (r.blocked + PRIOR * mean) / (r.n + PRIOR)) for r in by)
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(_rated(fitted, rates, mean)).select("vector", "label")
        forest = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=SEED, maxMemoryInMB=64).fit(ready)
        model = UrlModel(forest, rates, mean)
        base = ("url", "host", "path", "rest", "label")
        judged = model.block_probability(rows.filter(part >= FIT).select(*base, (part >= FIT + CHOOSE).alias("test")), "url")
        right = [F.avg(((F.col("block_probability") >= t) == (F.col("label") == 1)).cast("double")).alias(f"t{k}") for k, t in enumerate(THRESHOLDS)]
        seen = {r.test: r for r in judged.groupBy("test").agg(F.count("*").alias("n"), F.avg("label").alias("mean"), *right).collect()}  # two rows
        if len(seen) == 2:
            k = max(range(len(THRESHOLDS)), key=lambda k: (seen[False][f"t{k}"], k))
            test = seen[True]
            model.held_out = HeldOut(test.n, max(test["mean"], 1 - test["mean"]), test[f"t{k}"])
            model.threshold = THRESHOLDS[k] if model.held_out.informative else None
        return model
    finally:
        rows.unpersist()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """A verdict on every row: page_id, host, path, rule, verdict (allow or block), block_probability.

    The longest rule that fits decides.  Where none fits the model does: block from its threshold on,
    if it has one; ``block_probability`` is null where a rule decides.  Without a model, what no rule
    blocks is allowed.  Null and malformed urls have an empty host and path and go to the model.
    Repeated rows give repeated rows, an empty table an empty one; other columns play no part.
    """
    model = model or UrlModel(None, [], 0.0)
    cut = split_url(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), "url")
    cut = cut.withColumn("hit", matching(rules, F.col("host"), F.col("path")))
    scored = model.block_probability(cut, "url")
    blocks = F.lit(False) if model.threshold is None else F.col("block_probability") >= model.threshold
    return scored.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(blocks, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("block_probability")).alias("block_probability"),
    )
