"""Secrets in documents: a wide pattern finds candidates, a random forest removes the false ones.

A candidate is a run of at least 16 letters, digits and ``_+/=-`` with a digit in it. Its features: length,
transitions between kinds of characters, variety, the share that frequent words of the corpus cover, what the
document's path says, and the words around it. The forest is fitted on labelled findings. Everything is DataFrame
functions and the library's own classifier.

Labels come with the findings, as (features, label) rows. ``known_formats`` makes such a table from formats that are
certain either way, for corpora without labels.

Edge cases: a null text has no candidates; a null path is an empty one; repeated rows give repeated findings; an
empty table gives none. With labels of one class or none every candidate stays, its probability null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.pii import located
from tideview.llm.shared import keep

CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
#: Frequent words in the dictionary, and labelled findings of each class that a fit uses at most.
DICTIONARY, SAMPLE = 2000, 5000
FEATURES = ("length", "changes", "digits", "uppers", "variety", "covered", "path_depth", "path_test", "assigned", "keyword", "quoted", "next_plain")
# fixed values: words that name a secret, and paths that hold samples
KEYWORD = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|credential)s?[\x22\x27]?\s*[:=]?\s*[\x22\x27]?$"
SAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"


def frequent_words(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more, of all documents."""
    each = docs.where("text IS NOT NULL").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]++")).alias("w")).where(F.char_length("w") >= 3)
    top = each.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return sorted(r.w for r in top.collect())


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def candidates(docs: DataFrame, dictionary: list[str], path: str = "source") -> DataFrame:
    """(doc_id, start, end, value, before, features...) of every candidate in every text."""
    some = docs.select("doc_id", "text", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")).where(F.col("text").rlike(CANDIDATE))
    some = some.select("doc_id", "path", "text", F.explode(located(F.col("text"), CANDIDATE)).alias("m"))
    some = some.select(
        "doc_id",
        "path",
        F.col("m.start").alias("start"),
        F.col("m.end").alias("end"),
        F.col("m.value").alias("value"),
        F.substring("text", F.greatest(F.lit(1), F.col("m.start") - 39), F.least(F.col("m.start"), F.lit(40))).alias("before"),
        F.substring(F.col("text"), F.col("m.end") + 1, F.lit(24)).alias("after"),
    )
    value = F.col("value")
    kinds = reduce(lambda t, p: F.regexp_replace(t, *p), [("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "0"), ("[^Aa0]", "-")], value)
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    known = F.array(*(F.lit(w) for w in dictionary)) if dictionary else F.array().cast("array<string>")
    letters = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))
    covered = F.aggregate(letters, F.lit(0), lambda a, w: a + F.when(F.array_contains(known, w), F.char_length(w)).otherwise(0))
    length = F.char_length(value).cast("double")
    return some.withColumns(
        {
            "length": length,
            "changes": (F.char_length(runs) - 1) / length,
            "digits": _count(value, "[0-9]") / length,
            "uppers": _count(value, "[A-Z]") / length,
            "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
            "covered": covered / length,
            "path_depth": _count(F.col("path"), "/").cast("double"),
            "path_test": F.col("path").rlike(SAMPLE_PATH).cast("double"),
            "assigned": (F.col("before").rlike(r"[:=]\s*[\x22\x27]?$") | value.contains("=")).cast("double"),
            "keyword": (F.col("before").rlike(KEYWORD) | value.rlike(r"(?i)^[a-z_-]*(pass|secret|token|key)[a-z_-]*=")).cast("double"),
            "quoted": F.col("after").rlike(r"^[\x22\x27]").cast("double"),
            "next_plain": F.col("after").rlike(r"^\s+\p{L}+").cast("double"),
        }
    )


def known_formats(found: DataFrame) -> DataFrame:
    """Findings whose format tells the label: assigned hexadecimal values and cloud key ids are secrets, digits alone and words are not."""
    value = F.col("value")
    secret = value.rlike(r"^AKIA[0-9A-Z]{16}$") | ((F.col("keyword") == 1) & value.rlike(r"[0-9a-f]{16,}$"))
    harmless = value.rlike(r"^[0-9]+$") | (F.col("covered") > 0.5)
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).where("label IS NOT NULL").select(*FEATURES, "label")


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A forest from at most ``sample`` findings of each class, taken by a hash of their features; None with fewer than two classes."""
    parts = [labelled.where(F.col("label") == c).orderBy(F.xxhash64(*FEATURES)).limit(sample) for c in (0.0, 1.0)]
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(keep(parts[0].unionByName(parts[1]), "labelled")).select("features", "label")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=30, maxDepth=6, seed=7).fit(rows)


def scan(found: DataFrame, model, probability: float = 0.5) -> DataFrame:
    """(doc_id, start, end, value, probability) of the candidates that the forest takes for secrets."""
    fields = ("doc_id", "start", "end", "value")
    if model is None:
        return found.select(*fields, F.lit(None).cast("double").alias("probability"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    scored = scored.select(*fields, vector_to_array("probability")[1].alias("probability"))
    return scored.where(F.col("probability") >= probability)
