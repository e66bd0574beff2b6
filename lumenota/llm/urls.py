"""URL filters: block and allow rules first, a gradient-boosted model of lexical features else.

The model is trained from labelled URLs. Its features are length, path depth, digit ratio, entropy
of the characters, number of query parameters and how often the host's suffix was blocked among all
labelled URLs (for the fitted ones: among those of other folds). All features are column expressions;
the model is Spark's own gradient-boosted trees.

Defined cases: a null url or one without ``://`` has an empty host and path and, as any url without
a fitting rule, gets the model's verdict; very long urls are read whole; of two rules that fit, the
longer wins; repeated rows are judged alike; without labelled urls of both kinds every verdict is
the one kind there is, or allow; a url labelled both ways counts as most of its rows say; an empty
table gives an empty result. Extra columns of any name pass through, but for ``model_blocks``,
``verdict`` and ``rule``, which are results.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import boxed, table
from lumenota.session import checkpointed

#: Distinct labelled urls the trees are fitted on at most, half of them of each label; statistics of
#: suffixes count every labelled row.
FIT_ROWS = 20_000
#: Parts of the labelled urls; a fitted url's suffix rate is counted over the other parts.
FOLDS = 5
#: Labelled rows by which a suffix's rate is drawn to the rate of all.
PRIOR = 20.0
#: A suffix of at least one judged row in this many is joined by broadcast; there are no more.
HOT_SHARE = 10_000
TREES = 8
DEPTH = 3
SEED = 7
FEATURES = ("n_chars", "depth", "digit_ratio", "entropy", "n_params", "suffix_rate")


class Rule(NamedTuple):
    host: str
    path: str
    block: bool

    def shown(self) -> str:
        return self.host + self.path


#: The rule set of the query; a longer rule is an exception to a shorter one.
RULES = (
    Rule("net", "/", True),
    Rule("example.net", "/en/", False),
    Rule("example.com", "/de/", True),
    Rule("org", "/fr/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (shown, block) of the longest rule that fits, else null; ``rules`` is a short list."""
    best = F.lit(None).cast("struct<shown:string,block:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.shown()), r.shown())):
        named = (host == rule.host) | host.endswith("." + rule.host)
        hit = F.struct(F.lit(rule.shown()).alias("shown"), F.lit(rule.block).alias("block"))
        best = F.when(named & path.startswith(rule.path), hit).otherwise(best)
    return best


def suffix_of(host: Column) -> Column:
    """The last two labels of a host, the last one first."""
    return F.concat_ws(".", F.slice(F.reverse(F.split(host, r"\.")), 1, 2))


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and any other columns) plus the lexical features and ``suffix``."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    symbols = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    bits = lambda c: F.when(F.length(c) == 1, -share(c) * F.log2(share(c))).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "n_chars": n.cast("double"),
            "depth": F.regexp_count("path", F.lit("/+[^/]")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
            "entropy": F.aggregate(symbols, F.lit(0.0), lambda total, c: total + bits(c)),
            "n_params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "suffix": suffix_of(F.col("host")),
        }
    )


class UrlModel(NamedTuple):
    """A fitted filter: the blocked rate of every labelled suffix, the base rate and the trees."""

    suffixes: DataFrame
    base_rate: float
    trees: GBTClassificationModel | None


def _drawn(blocked: Column, n: Column, base_rate: float) -> Column:
    """Blocked share of n labelled rows, drawn to the base rate by PRIOR rows."""
    return (blocked + PRIOR * base_rate) / (n + PRIOR)


def fit_sample(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Up to ``fit_rows`` / 2 distinct urls of each label, in the order of a hash of the url, with
    ``weight``: how many distinct urls of its label each stands for. A url labelled both ways has
    the label of most of its rows, blocked where they are equal."""
    voted = labelled.groupBy("url", "host", "path", "suffix", "fold").agg(
        F.when(F.avg(F.col("blocked").cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("label")
    )
    voted = checkpointed(voted)
    parts = [
        voted.where(F.col("label") == kind).orderBy(F.xxhash64("url"), "url").limit(fit_rows // 2)
        for kind in (0.0, 1.0)
    ]
    sample = parts[0].unionByName(parts[1])
    whole = voted.groupBy("label").agg(F.count(F.lit(1)).alias("__all"))
    taken = sample.groupBy("label").agg(F.count(F.lit(1)).alias("__taken"))
    weights = whole.join(taken, "label").select("label", (F.col("__all") / F.col("__taken")).alias("weight"))
    return sample.join(F.broadcast(weights), "label")


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> UrlModel:
    """Fit on ``labelled`` (url, host, path, blocked). Suffix rates count every labelled row; the
    trees are fitted on ``fit_sample``, whose rows see the rates of the other folds only, so that
    no label is among its own features."""
    rows = labelled.select(
        "url", "host", "path", "blocked", suffix_of(F.col("host")).alias("suffix"),
        F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(FOLDS)).alias("fold"),
    )
    folds = checkpointed(
        rows.groupBy("suffix", "fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("double")).alias("n_blocked")
        )
    )
    n, n_blocked = folds.agg(F.sum("n"), F.sum("n_blocked")).first()
    base_rate = n_blocked / n if n else 0.0
    suffixes = folds.groupBy("suffix").agg(
        _drawn(F.sum("n_blocked"), F.sum("n"), base_rate).alias("suffix_rate")
    )
    suffixes = checkpointed(suffixes)
    if base_rate in (0.0, 1.0):
        return UrlModel(suffixes, base_rate, None)
    sample = checkpointed(fit_sample(rows, fit_rows))
    if sample.select("label").distinct().count() < 2:
        return UrlModel(suffixes, float(sample.first()["label"]), None)
    whole = folds.groupBy("suffix").agg(
        F.sum("n").alias("n_whole"), F.sum("n_blocked").alias("blocked_whole")
    )
    others = folds.join(whole, "suffix").select(
        "suffix", "fold",
        _drawn(F.col("blocked_whole") - F.col("n_blocked"), F.col("n_whole") - F.col("n"), base_rate)
        .alias("suffix_rate"),
    )
    rated = with_features(sample.drop("suffix")).join(others, ["suffix", "fold"])
    rated = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated)
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=SEED, cacheNodeIds=False,
        weightCol="weight",
    ).fit(rated.select("features", "label", "weight").coalesce(4))
    return UrlModel(suffixes, base_rate, trees)


def _rated(rows: DataFrame, model: UrlModel) -> DataFrame:
    """``rows`` (with ``url`` and ``suffix``) plus ``suffix_rate``.

    Suffixes of at least one row in HOT_SHARE are at most that many and are broadcast, with or
    without a rate; the rows of all others meet their rates by a shuffle, without a hot key.
    """
    counts = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") * HOT_SHARE >= F.col("total"))
    base = F.lit(model.base_rate)
    hot = hot.join(model.suffixes, "suffix", "left").select(
        "suffix", F.coalesce("suffix_rate", base).alias("hot_rate")
    )
    rows = rows.join(F.broadcast(hot), "suffix", "left")
    # no host holds a slash, so a key that begins with one meets nothing
    spread = F.concat(F.lit("/"), F.xxhash64("url").cast("string"))
    rows = rows.withColumn("__key", F.when(F.col("hot_rate").isNull(), F.col("suffix")).otherwise(spread))
    rates = model.suffixes.withColumnRenamed("suffix", "__key")
    rows = rows.join(rates, "__key", "left")
    return rows.withColumn("suffix_rate", F.coalesce("hot_rate", "suffix_rate", base))


def predict(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (url, host, path and any other columns) plus ``model_blocks``."""
    if model.trees is None:
        return urls.withColumn("model_blocks", F.lit(model.base_rate == 1.0))
    rows = boxed(urls).select("__row", "__row.url", "__row.host", "__row.path")
    rows = _rated(with_features(rows), model)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    rows = model.trees.transform(rows)
    return rows.select("__row.*", (F.col("prediction") == 1.0).alias("model_blocks"))


def judge(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (with the struct column rule) and the verdict: the rule's, else the model's."""
    judged = predict(urls, model)
    blocks = F.coalesce(F.col("rule.block"), F.col("model_blocks"))
    return judged.withColumn(
        "verdict", F.when(blocks, F.lit("block")).otherwise(F.lit("allow"))
    ).withColumn("rule", F.col("rule.shown"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the urls that a rule decides are the labelled ones."""
    host, path = host_and_path(F.col("url"))
    urls = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"),
                                                path.alias("path"))
    urls = urls.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), RULES))
    labelled = urls.where(F.col("rule").isNotNull()).withColumn("blocked", F.col("rule.block"))
    judged = judge(urls, fit(labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict", "model_blocks")
