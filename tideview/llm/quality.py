"""Quality grades of documents by ordinal cumulative-link regression on hashed text.

One linear score per document, shared by all grades, and ordered thresholds between the grades:
P(grade <= k) = sigmoid(threshold_k - score). The score adds a weight for each distinct hashed feature:
words, the shapes of tokens (case, trailing marks; also those of a tenth of the text or more), and how much of
the text repeats.

The model is fitted on at most ``sample`` labelled documents per grade, taken by a hash of the id;
executors turn them into feature numbers, and only these few MB reach the driver.

Edge cases: a text without words (or null) gets grade 0 and tail probability 0, so it is rejected; with
labels of fewer than two grades nothing can be learned: grade and probability are null and all documents are
selected. Labels that repeat for a document count as their lowest grade; labels with a null id, or
without a grade, are left out. Every input row gives one output row, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.shared import aside
from tideview.llm.texts import column, mix, names, pieces, words

#: Labelled documents per grade that a fit uses at most.
SAMPLE = 4000
BITS = 18
#: Standard errors by which a feature's mean grade must differ from the sample's.
CHANCE = 5.0


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    of, codes, vocab = words(texts, lower=False)
    if not len(of):
        return of.astype(np.int64), of.astype(np.int64)
    plain = pc.replace_substring_regex(pc.utf8_lower(vocab), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    shape = pc.replace_substring_regex(vocab, r"\p{Lu}+", "X")
    shape = pc.replace_substring_regex(shape, r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]+", "a")
    shape = pc.utf8_slice_codeunits(pc.replace_substring_regex(shape, r"\pN+", "9"), 0, 8)
    mask = np.uint64((1 << BITS) - 1)
    word = (names(plain) & mask).astype(np.int64)
    kinds = shape.dictionary_encode()
    kind = kinds.indices.to_numpy(zero_copy_only=False)
    style = (names(kinds.dictionary) >> np.uint64(20)) & mask
    of = of.astype(np.int64)
    pairs = np.unique((of << BITS) | word[codes])
    shaped, counts = np.unique(of * len(style) + kind[codes], return_counts=True)
    text, form = np.divmod(shaped, len(style))
    many = counts * 10 >= np.bincount(of)[text]
    plain_form = ((style * np.uint64(2654435761)) & mask).astype(np.int64)[form]
    main_form = ((style * np.uint64(2246822519) + np.uint64(97)) & mask).astype(np.int64)[form[many]]
    # the share of words that repeat the one before, and of lines that repeat
    present, n_words = np.unique(of, return_counts=True)
    again = np.bincount(of[1:][(codes[1:] == codes[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))[present]
    repeats = (mix((10 * again // n_words).astype(np.uint64)) & mask).astype(np.int64)
    lines = [t.split("\n") for t in texts.to_pylist()]
    same = np.array([(1 - len(set(x)) / len(x)) * 5 if len(x) > 2 else 0 for x in lines])[present].astype(np.int64)
    lined = (mix(same.astype(np.uint64) + np.uint64(1 << 40)) & mask).astype(np.int64)
    pairs = np.concatenate((pairs, (text << BITS) | plain_form, (text[many] << BITS) | main_form, (present << BITS) | repeats, (present << BITS) | lined))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: np.ndarray, feats: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 150, shrink: float = 2e-4) -> Ordinal:
    """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over the whole sample."""
    n = len(grade)
    # only features whose documents' grades differ from the rest beyond chance; the others would fit noise
    df = np.bincount(feats, minlength=1 << BITS)
    lift = np.bincount(feats, weights=(grade - grade.mean())[rows], minlength=1 << BITS) / np.sqrt(np.maximum(df, 1)) / max(grade.std(), 1e-9)
    used = ((np.abs(lift) >= CHANCE) & (df >= 3))[feats]
    rows, feats = rows[used], feats[used]
    share = np.bincount(grade, minlength=n_grades) / n
    balance = (1 / np.maximum(share, 1e-9) / n_grades)[grade] / n
    w, cuts = np.zeros(1 << BITS), np.linspace(-1, 1, n_grades - 1)
    m_w, v_w, m_c, v_c = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    for t in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[feats], minlength=n)
        p = Ordinal(w, cuts).below(score)
        edge = np.hstack((np.zeros((n, 1)), p, np.ones((n, 1))))
        at = np.arange(n)
        hi, lo = edge[at, grade + 1], edge[at, grade]
        cell = np.maximum(hi - lo, 1e-9)
        # d log P / d threshold: only the two thresholds around the grade take part
        g_cut = np.zeros_like(p)
        top, low = grade < n_grades - 1, grade > 0
        g_cut[at[top], grade[top]] += (hi * (1 - hi) / cell)[top]
        g_cut[at[low], grade[low] - 1] -= (lo * (1 - lo) / cell)[low]
        g_cut *= balance[:, None]
        g_w = np.bincount(feats, weights=-g_cut.sum(1)[rows], minlength=1 << BITS) - shrink * w
        g_c = g_cut.sum(0)
        step = 0.1 / np.sqrt(1 + t / 50)
        for x, g, m, v in ((w, g_w, m_w, v_w), (cuts, g_c, m_c, v_c)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (np.abs(m) > 1e-12)
        cuts.sort()
    return Ordinal(w.astype(np.float32), cuts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """A model from at most ``sample`` labelled documents of each grade; None where fewer than two grades have texts."""
    rated = grades(labels)
    chosen = None
    for g in range(3):
        part = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 3 * sample rows of two numbers
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            rows, feats = features(texts)
            grade = column(batch, "grade").to_pylist()
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(len(grade) + 1))
            feats = feats[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grade, pa.int32()), pa.array([feats[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())], names=["grade", "feats"]
            )

    got = picked.select("text", "grade").mapInArrow(numbers, "grade int, feats binary").collect()
    got = sorted((r.grade, bytes(r.feats)) for r in got if len(r.feats))
    seen = sorted({g for g, _ in got})
    if len(seen) < 2:
        return None
    each = [np.frombuffer(b, np.int32) for _, b in got]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return fit(rows, np.concatenate(each), np.array([g for g, _ in got]), 3)


def classify(docs: DataFrame, model: Ordinal | None, at_least: int = 2, probability: float = 0.4) -> DataFrame:
    """``docs`` with expected_grade, tail_prob (of grade ``at_least`` or more) and selected added."""
    fields = {"expected_grade": "double", "tail_prob": "double", "selected": "boolean"}
    kept = docs.drop(*fields)
    if model is None:
        return kept.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_prob": F.lit(None).cast("double"), "selected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in fields.items()])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        own = Ordinal(weights, thresholds)
        for batch, texts in pieces(batches):
            rows, feats = features(texts)
            some = np.bincount(rows, minlength=batch.num_rows) > 0
            below = own.below(np.bincount(rows, weights=weights[feats], minlength=batch.num_rows))
            grade = np.where(some, len(thresholds) - below.sum(1), 0.0)
            tail = np.where(some, 1 - below[:, at_least - 1], 0.0)
            arrays = [*batch.columns, pa.array(grade), pa.array(tail), pa.array(tail >= probability)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *fields])

    return kept.mapInArrow(score, schema)


def select(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """The rows of ``docs`` that ``classify`` selects, all columns as they are, also those named like its own."""
    rows, back = aside(docs, "expected_grade", "tail_prob", "selected")
    return classify(rows, model).where("selected").select(*rows.columns).withColumnsRenamed(back)
