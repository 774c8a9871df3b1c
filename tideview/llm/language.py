"""Language of documents by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it is a two-class question that a linear classifier over hashed byte
trigrams answers: the log odds of a trigram under the languages whose bit is one against the others, from counts
over *all* learning documents. A text's margins on all bits are held against every codeword by logistic loss,
each bit weighted by how well it separates its two sides; the nearest codeword wins, and where the second
is almost as near the answer is flagged as ambiguous.

Up to seven languages have the exhaustive code (every split into two sides is a bit); more have rows of a
Hadamard matrix, of which any two differ in half their bits.

Edge cases: a null text, or one without letters, is ``und`` with score 0; so is everything when no language could
be learned. With a single language that one is the answer, with score 1. Ties go to the language that sorts
first. A null id is not held out. Repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.texts import column, pieces

BITS = 16
#: Factor from a mean log odds of a trigram to a margin, trigrams of doubt added to each text, and the gap that is ambiguous.
SHARPNESS, DOUBT, GAP = 6.0, 4.0, 0.5


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and the texts' offsets in them; each text is set between two spaces."""
    padded = pc.binary_join_element_wise("", pc.ascii_lower(texts), "", " ")
    size = pc.binary_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(padded.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    all3 = ((flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    n = np.maximum(size - 2, 0)
    first = np.cumsum(size) - size
    inside = np.ones(len(all3) + 2, dtype=bool)
    ends = np.cumsum(size)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, first)] = False
    return all3[inside[: len(all3)]].astype(np.int64), np.concatenate(([0], np.cumsum(n)))


def codewords(n: int) -> np.ndarray:
    """One row of bits for each of n classes, as 1 and -1."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1))
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack((np.zeros((1, bits.shape[1]), int), bits)).astype(np.int8) * 2 - 1
    width = 1 << int(np.ceil(np.log2(n + 1)))
    rows = np.arange(1, n + 1)[:, None] & np.arange(1, width)[None, :]
    return (np.bitwise_count(rows.astype(np.uint64)) % 2).astype(np.int8) * 2 - 1


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        weights, separates = [], []
        for bit in self.code.T:
            side = [counts[bit == s].sum(0) + 0.5 for s in (1, -1)]
            share = [x / x.sum() for x in side]
            odds = np.log(share[0]) - np.log(share[1])
            weights.append(odds)
            separates.append(float(((share[0] - share[1]) * odds).sum()))
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((1 << BITS, 0), np.float32)
        trust = np.array(separates) if separates else np.zeros(0)
        self.trust = trust / trust.sum() * len(trust) if len(trust) and trust.sum() > 0 else np.ones(len(trust))

    def decode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each text."""
        n = len(texts)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        index, at = grams(texts)
        sums = np.zeros((n, self.code.shape[1]))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            sums[some] = np.add.reduceat(self.weights[index], at[:-1][some], axis=0)
        margin = SHARPNESS * sums / (np.diff(at)[:, None] + DOUBT)
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(1) for word in self.code], axis=1)
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(1), 1 / likely.sum(1), two[:, 1] - two[:, 0] < GAP


def train(docs: DataFrame) -> Model | None:
    """A model from the text and lang of all rows that have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches):
            langs = column(batch, "lang").dictionary_encode()
            index, at = grams(texts)
            number = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
            got = np.bincount((number << BITS) | index, minlength=len(langs.dictionary) << BITS).reshape(-1, 1 << BITS)
            for lang, row in zip(langs.dictionary.to_pylist(), got):
                held[lang] = held[lang] + row if lang in held else row
        for lang, row in held.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some])], names=["lang", "gram", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    # at most 2^BITS rows for each language
    got = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()])[names.indices.to_numpy(zero_copy_only=False)]
    counts = np.zeros((len(languages), 1 << BITS))
    counts[place, got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.code, model.weights, model.trust))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if shared.value:
            own = Model.__new__(Model)
            own.languages, own.code, own.weights, own.trust = shared.value
        for batch, texts in pieces(batches):
            n = batch.num_rows
            letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            best, score, unsure = own.decode(texts) if own else (np.zeros(n, int), np.zeros(n), np.zeros(n, bool))
            letters = letters & bool(own)
            names = [own.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, unsure, True))], names=["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
