"""URL filter (operator 2): listed rules first, then a logistic regression on hashed character n-grams of host and path.

Parsing: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
path follows up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path.

A rule (host, path) fits its host and all its subdomains when the url's path starts with the rule's path; the longest
fitting rule (host and path together) wins, and among rules of equal length the one that allows. Urls without a rule
get the model's verdict: ``block`` when the predicted probability of the blocked class is over ``threshold``.

The model is fitted on at most ``max_labelled`` labelled urls, those with the smallest hash of their id, so the choice
does not depend on partitioning. With no labelled url, or labels of one class only, the verdict is that class for all
urls (``allow`` without labels). Repeated rows are judged alike; an empty table gives an empty result. Rows are judged
one by one without a shuffle, very long urls too; extra columns stay, whatever their names, but for those that the
result adds. The rules are a parameter, ``MAX_RULES`` at most, and are compiled into the expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, unpacked

MAX_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModelParams:
    ngrams: tuple[int, ...] = (3, 4)
    features: int = 1 << 16
    max_labelled: int = 20_000
    reg: float = 0.01
    iterations: int = 20
    threshold: float = 0.5


_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _ASCII_UPPER, _ASCII_UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest fitting rule as struct<text, verdict>, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    chain = F.lit(None).cast("struct<text:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    cases = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        told = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        cases = F.when(fits, told) if cases is None else cases.when(fits, told)
    return chain if cases is None else cases.otherwise(chain)


def _grams(text: Column, sizes: Sequence[int], mark: str) -> Column:
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, n)))

    return F.concat(*[of(n) for n in sizes])


def with_grams(urls: DataFrame, host: str, path: str, p: UrlModelParams, into: str = "_grams") -> DataFrame:
    return urls.withColumn(into, F.concat(_grams(F.col(host), p.ngrams, "h:"), _grams(F.col(path), p.ngrams, "p:")))


def fit_url_model(labelled: DataFrame, params: UrlModelParams | None = None, scratch: Scratch | None = None) -> PipelineModel | float:
    """``labelled`` has id, url and blocked (0 or 1). Returns a model, or the one probability that all urls get."""
    p = params or UrlModelParams()
    rows = labelled.where(F.col("blocked").isin(0, 1)).select(
        F.xxhash64("id").alias("_h"), "id", url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"), F.col("blocked").cast("double").alias("label")
    )
    rows = rows.orderBy("_h", "id", "_host", "_path", "label").limit(p.max_labelled)
    rows = (scratch or Scratch(labelled.sparkSession)).write(rows, "labelled_urls")
    classes = {r["label"] for r in rows.select("label").distinct().collect()}  # two rows at most
    if len(classes) < 2:
        return classes.pop() if classes else 0.0
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=p.features)
    lr = LogisticRegression(featuresCol="_tf", labelCol="label", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", maxIter=p.iterations, regParam=p.reg)
    fitted = lr.fit(tf.transform(with_grams(rows, "_host", "_path", p)).select("_tf", "label"))
    return PipelineModel([tf, fitted])


def filter_urls(
    urls: DataFrame, model: PipelineModel | float, rules: Sequence[UrlRule], url: str = "url", params: UrlModelParams | None = None
) -> DataFrame:
    """The rows of ``urls`` with host, path, rule, block_probability and verdict; columns of these names are replaced."""
    from pyspark.ml.functions import vector_to_array

    p = params or UrlModelParams()
    out = urls.select(F.struct("*").alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if isinstance(model, float):
        out = out.withColumn("block_probability", F.lit(model))
    else:
        out = model.transform(with_grams(out, "host", "path", p)).withColumn("block_probability", vector_to_array("_prob")[1])
    out = out.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("block_probability") > p.threshold, "block").otherwise("allow")
    out = out.withColumns({"rule": F.col("_rule.text"), "verdict": F.coalesce(F.col("_rule.verdict"), own)})
    return unpacked(out, urls.columns, "host", "path", "rule", "block_probability", "verdict")
