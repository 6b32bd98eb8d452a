"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import logging

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import stable
from fairlead.llm.hostrules import base_rule, text_measures
from fairlead.llm.htmlcrf import extract_pages

log = logging.getLogger(__name__)

#: Area under the ROC curve, on hosts held out, that trees have to reach; 0.5 is chance.
LEAST_AUC = 0.6
#: Labelled URLs the trees are fitted on, about: a sample by a hash of the URL.
MOST_LABELLED = 8_000
#: Weight of the overall rate in a suffix's rate, in URLs.
SUFFIX_PRIOR = 10
#: Parts of the hosts, by hash; a training row's suffix statistics come from the other parts, so that they don't hold its label.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "longest_label",
    "suffix_rate", "suffix_log_count",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows(url, ..)`` with ``host`` and ``path``."""
    host, path = url_parts(F.col("url"))
    return rows.withColumns({"host": host, "path": path})


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, else nulls. A rule is ``(verdict, host + path)`` and fits the host's subdomains.

    Of rules of one length the last by text wins; a rule that is listed twice keeps the later verdict.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones go in front
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def host_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls(url, host, path, ..)`` with all features but the suffix statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    chars = F.filter(F.split(host, ""), lambda c: c != "")
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    count = lambda text, what: (F.length(text) - F.length(F.regexp_replace(text, what, ""))).cast("double")
    labels = F.split(host, r"\.")
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "entropy": F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t - share(c) * F.log2(share(c))),
        "n_params": F.when(F.instr(url, "?") > 0, count(F.regexp_extract(url, r"\?([^#]*)", 1), "&") + 1).otherwise(0.0),
        "n_labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "suffix": host_suffix(host),
    })


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Fitted trees and ``suffixes(suffix, seen, bad)`` of the labelled URLs, arrays by fold (no more rows than the bounded sample has URLs)."""

    def __init__(self, suffixes: DataFrame | None, rate: float, trees: GBTClassificationModel | None = None):
        self.suffixes, self.rate, self.trees = suffixes, rate, trees

    def features(self, urls: DataFrame, training: bool = False) -> DataFrame:
        """``urls(url, host, path, ..)`` with ``features``; in ``training`` without the row's own fold in its suffix's statistics."""

        def total(of: str) -> Column:
            whole = F.aggregate(of, F.lit(0.0), lambda a, b: a + b)
            return F.coalesce(whole - F.get(of, fold(F.col("host"))) if training else whole, F.lit(0.0))

        seen, bad = total("seen"), total("bad")
        rows = lexical(urls).join(F.broadcast(self.suffixes), "suffix", "left")
        rows = rows.withColumns({"suffix_rate": (bad + SUFFIX_PRIOR * self.rate) / (seen + SUFFIX_PRIOR), "suffix_log_count": F.log1p(seen)})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def blocks(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``blocked``: the trees give the bad label more than half; without labels of both kinds nothing is blocked."""
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(False))
        return self.trees.transform(self.features(urls)).withColumn("blocked", F.col("prediction") == 1.0)


def bounded_sample(urls: DataFrame, most: int) -> DataFrame:
    """About ``most`` different URLs of ``urls(url, ..)``, or all if there are fewer: those whose hash is under a threshold.

    The threshold comes before the shuffle, so that only the sample moves, in its natural proportions at every size.
    Repeats of a URL come down to one row in the map tasks (the least other columns).
    """
    known = urls.where("url is not null")
    different = known.agg(F.approx_count_distinct("url")).first()[0]
    if different > most:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * most / different))
    rest = [c for c in urls.columns if c != "url"]
    return known.groupBy("url").agg(F.min(F.struct(*rest)).alias("x")).select("url", "x.*")


def fit_urls(labelled: DataFrame, most: int = MOST_LABELLED, trees: int = 10, depth: int = 4) -> UrlModel:
    """Fit on ``labelled(url, label)``, on a sample of about ``most`` different URLs with a host, in the proportions that they come in."""
    sample = with_parts(bounded_sample(labelled.select("url", F.col("label").cast("double").alias("label")), most))
    sample = stable(sample.where("host <> '' and label is not null"))
    parts = lambda x: F.array(*[F.sum(F.when(fold(F.col("host")) == k, x).otherwise(0.0)) for k in range(FOLDS)])
    by = stable(sample.groupBy(host_suffix(F.col("host")).alias("suffix")).agg(parts(F.lit(1.0)).alias("seen"), parts(F.col("label")).alias("bad")))
    n, bad = sample.agg(F.count("*"), F.sum("label")).first()
    model = UrlModel(by, bad / n if n else 0.0)
    if n and 0 < bad < n:
        data = stable(model.features(sample, training=True).select("features", "label").coalesce(4))
        model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5, cacheNodeIds=False, maxMemoryInMB=64).fit(data)
    return model


def held_out_auc(labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[float, UrlModel]:
    """Area under the ROC curve on hosts that training didn't see (one fold of them), and the model."""
    rows = with_parts(labelled.select("url", "label"))
    out = F.pmod(F.xxhash64(F.lit("held out"), "host"), F.lit(FOLDS)) == 0
    model = fit_urls(rows.where(~out), most)
    held = stable(rows.where(out & (F.col("host") != "") & F.col("label").isNotNull()))
    n, bad = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if model.trees is None or not 0 < bad < n:
        raise ValueError("hosts for training, or held out, have one label only")
    scored = model.blocks(held)
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability").evaluate(scored), model


def proved_model(labelled: DataFrame, least_auc: float = LEAST_AUC, most: int = MOST_LABELLED) -> UrlModel:
    """The model of ``held_out_auc`` if it tells the hosts held out apart; else one that blocks nothing, and a line in the log says so."""
    try:
        auc, model = held_out_auc(stable(bounded_sample(labelled.select("url", F.col("label").cast("double").alias("label")), most)), most)
    except ValueError as e:
        log.warning("rules decide alone: %s", e)
        return UrlModel(None, 0.0)
    if auc < least_auc:
        log.warning("rules decide alone: area under the ROC curve of %.2f on hosts held out", auc)
        model.trees = None
    return model


def page_labels(pages: DataFrame, most: int = MOST_LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(url, label)`` of about ``most`` different URLs, from the pages behind them and not from the URLs.

    1 where the page's main text (operator 3) fails the base quality rule (operator 2: too short, or too much of it
    repeats), else 0. Of pages that share a URL one counts.
    """
    sample = stable(bounded_sample(pages.select(F.col(url_col).alias("url"), F.col(id_col).alias("page_id"), F.col(html_col).alias("html")), most))
    texts = extract_pages(sample).select("url", text_measures(F.col("text")).alias("m")).select("url", "m.n_words", "m.n_repeat_words")
    return stable(texts.select("url", base_rule().cast("double").alias("label")))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row.

    The longest fitting rule decides; elsewhere the trees do, which ``labelled(url, label)`` trains (``page_labels``
    makes such a table from pages), if they prove themselves on hosts held out (``proved_model``); if not, all else is allowed. Null urls and urls without ``://`` have empty host and path and are allowed;
    repeated rows are judged each; other columns are ignored; an empty table gives an empty result, and labels of one
    kind, or none, leave all to the rules.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    model = proved_model(labelled)
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    judged = model.blocks(rows.withColumns({"rule": rule, "said": said}))
    own = F.when(F.col("blocked") & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"))
