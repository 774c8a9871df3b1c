"""Verdicts on urls: host and path rules first, then logistic regression on hashed character n-grams.

A rule is an action with a host and a path; it fits its host and all subdomains if the url's path starts with
the rule's. The longest fitting rule wins (of equal lengths the one that sorts first). Urls that no rule
fits are judged by a logistic regression over hashed three-character pieces of host and path, fitted on a small
table of labelled urls. Everything is DataFrame functions and the library's own classifier.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged by the model's
intercept; with labels of one class or none that class, or ``allow``, is the verdict. Repeated rows each get
their row; an empty table gives no rows. Columns other than page_id and url are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 12
#: Labelled urls that a fit uses at most.
SAMPLE = 5000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*+", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def apply_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with host, path, rule and ruled (the rule's action); ``rules`` are (action, "host/path")."""
    host, path = split_url(F.col("url"))
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at, slash, below = text.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(slash + below)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": action})


def _pieces(name: str) -> Column:
    """Distinct three-character pieces of a column, its ends marked."""
    text = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - 2)), lambda i: F.concat(F.lit(f"{name}:"), F.substring(text, i, 3)))


def _features(urls: DataFrame) -> DataFrame:
    made = urls.withColumn("pieces", F.array_distinct(F.concat(_pieces("host"), _pieces("path"))))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="pieces", outputCol="features").transform(made)


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A model from (url, allowed 0/1) rows: at most ``sample``, taken by a hash of the url; or the only class there is."""
    host, path = split_url(F.col("url"))
    some = labelled.where("url IS NOT NULL AND allowed IS NOT NULL").select("url", F.col("allowed").cast("double").alias("label"))
    some = some.orderBy(F.xxhash64("url"), "url", "label").limit(sample).withColumns({"host": host, "path": path})
    some = _features(some).select("features", "label").persist()
    classes = sorted(r.label for r in some.select("label").distinct().collect())
    model = LogisticRegression(regParam=0.01, maxIter=40).fit(some) if len(classes) > 1 else None
    some.unpersist()
    return model if model is not None else (classes[0] if classes else 1.0)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model) -> DataFrame:
    """(page_id, host, path, rule, verdict, allow_prob) for every page; the probability is null where a rule decides."""
    ruled = apply_rules(pages, rules)
    if isinstance(model, float):
        scored = ruled.withColumn("p", F.lit(model))
    else:
        scored = model.transform(_features(ruled)).withColumn("p", vector_to_array("probability")[1])
    own = F.when(F.col("p") >= 0.5, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.when(F.col("rule").isNull(), F.col("p")).alias("allow_prob")
    )
