"""Benchmark passages in documents, by fingerprints of item-sized windows.

Every window of a document that has as many words as some benchmark item gets a 64-bit SimHash over its
words, weighted by their rarity among the items. A window and an item of its size are candidates
when their fingerprints differ in at most 15 bits. These are found by a multi-index: the 64 bits are cut into four
blocks of 16, and of any two fingerprints within 15 bits at least one block differs in at most 3 bits; all
values within 3 bits of an item's block are indexed, so none within the radius is missed. Candidates are
then verified exactly: the weighted Jaccard similarity of their five-word shingles, each weighted by how often it
occurs, must reach the threshold.

Windows in which more than a fifth of the words occur in no item cannot reach it, and get no fingerprint.

The benchmark goes to the executors in blocks of bounded size, one scan of the documents for each block (one
block holds 20,000 items); the documents are never shuffled.

Words are runs of letters and digits, lower-cased. A document shorter than an item is one window. Edge cases: null or
wordless texts match nothing, nor do null or wordless items; items of fewer than five words are one
shingle; items with equal texts are all reported; repeated documents give repeated rows, a null id gives a
null in the result; empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.shared import free, keep, small, text_mark
from tideview.llm.texts import column, mix, names, pieces, places, words

RADIUS, BLOCKS, WIDTH = 15, 4, 16
#: Items, and bytes of their texts, that one scan looks for.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
K = 5
#: Words whose votes are summed up at once; one document's are never cut.
VOTED = 1 << 14
#: Windows whose fingerprints are made at once, and bytes of text that are looked through at once.
MARKED, PIECE = 1 << 13, 1 << 20

_NEAR = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), r)], np.uint64)


def _plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")


def _rolled(hashes: np.ndarray) -> np.ndarray:
    """Shingles of one sequence by place; fewer than five words are one."""
    factors, n = places(K), len(hashes)
    if n < K:
        return mix((hashes * factors[:n]).sum(keepdims=True) + np.uint64(n)) if n else hashes
    out = np.zeros(n - K + 1, np.uint64)
    for j in range(K):
        out += hashes[j : n - K + 1 + j] * factors[j]
    return mix(out)


class Index:
    """The items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        of, codes, vocab = words(_plain(pa.array([t or "" for _, t in items], pa.string())))
        hashes = names(vocab)[codes] if len(of) else np.zeros(0, np.uint64)
        at = np.searchsorted(of, np.arange(len(items) + 1))
        self.items = [(item, hashes[a:z]) for (item, _), a, z in zip(items, at[:-1], at[1:]) if z > a]
        held = Counter(int(w) for _, ws in self.items for w in set(ws.tolist()))
        self.known = np.array(sorted(held), np.uint64)
        share = np.array([held[int(w)] / max(1, len(self.items)) for w in self.known])
        self.value = np.clip(np.rint(-np.log2(np.maximum(share, 1e-9))), 1, 8).astype(np.int16)
        self.sets = [Counter(_rolled(w).tolist()) for _, w in self.items]
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, (_, w) in enumerate(self.items):
            self.by_length[len(w)].append(i)
        self.tables = {}
        for length, own in self.by_length.items():
            marks = np.array([self.fingerprints(self.votes(self.items[i][1]), np.array([0]), np.array([length]))[0] for i in own], np.uint64)
            blocks = []
            for b in range(BLOCKS):
                part = (marks >> np.uint64(b * WIDTH)) & np.uint64(0xFFFF)
                keys = (part[:, None] ^ _NEAR[None, :]).astype(np.int64)
                which = np.repeat(np.arange(len(own)), len(_NEAR))
                order = np.argsort(keys.ravel(), kind="stable")
                some = np.zeros(1 << WIDTH, bool)
                some[keys.ravel()] = True
                blocks.append((some, keys.ravel()[order], which[order]))
            self.tables[length] = (np.array(own), marks, blocks)

    def votes(self, hashes: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted bits, one row more than words."""
        sums = np.zeros((len(hashes) + 1, 64), np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        value = np.where(self.known[at] == hashes, self.value[at], np.int16(8))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        np.cumsum((2 * bits - 1) * value[:, None], axis=0, dtype=np.int32, out=sums[1:])
        return sums

    @staticmethod
    def fingerprints(sums: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.packbits(sums[z] - sums[a] > 0, axis=1).view(np.uint64).ravel()

    def candidates(self, length: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        own, items, blocks = self.tables[length]
        found = []
        for b, (some, keys, which) in enumerate(blocks):
            part = ((marks >> np.uint64(b * WIDTH)) & np.uint64(0xFFFF)).astype(np.int64)
            at = np.flatnonzero(some[part])
            part = part[at]
            lo, hi = np.searchsorted(keys, part), np.searchsorted(keys, part, side="right")
            n = hi - lo
            window = np.repeat(at, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(window * len(own) + which[place])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(own))
        near = np.bitwise_count(marks[window] ^ items[item]) <= RADIUS
        return window[near], own[item[near]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        own, other = Counter(_rolled(window).tolist()), self.sets[item]
        both = sum(min(n, other[s]) for s, n in own.items() if s in other)
        return both / (own.total() + other.total() - both)

    def windows(self, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """(document, item length, first word, words) of the windows with enough known words, in this order."""
        none = np.zeros((0, 4), np.int64)
        if not len(hashes) or not self.items:
            return none
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        known = np.concatenate(([0], np.cumsum(self.known[at] == hashes))).astype(np.int32)
        edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        first, size = edges[:-1], np.diff(edges)
        out = []
        for length in self.by_length:
            if len(hashes) >= length:
                full = np.flatnonzero(known[length:] - known[:-length] >= -(-length * 4 // 5))
                full = full[of[full] == of[full + length - 1]]
                out.append(np.stack((of[full], np.full(len(full), length), full, np.full(len(full), length)), axis=1))
            # documents shorter than the item, though long enough for four fifths of it, are one window
            short = np.flatnonzero((size < length) & (size * 5 >= length * 4))
            short = short[(known[first[short] + size[short]] - known[first[short]]) * 5 >= size[short] * 4]
            out.append(np.stack((of[first[short]], np.full(len(short), length), first[short], size[short]), axis=1))
        found = np.concatenate(out) if out else none
        # of one document and length they are in order already
        return found[np.argsort(found[:, 0] * (found[:, 1].max(initial=0) + 1) + found[:, 1], kind="stable")]

    def matches(self, of: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words): each item's best window in each document, the first of equals."""
        found = self.windows(of, hashes)
        marks = np.zeros(len(found), np.uint64)
        # only words that lie in some window are summed up; ``rank`` counts them
        n = len(of) + 1
        covered = np.cumsum(np.bincount(found[:, 2], minlength=n) - np.bincount(found[:, 2] + found[:, 3], minlength=n))[:-1] > 0
        rank = np.concatenate(([0], np.cumsum(covered)))
        voting = hashes[covered]
        begin = rank[np.searchsorted(of, found[:, 0])]
        first, last = rank[found[:, 2]], rank[found[:, 2] + found[:, 3]]
        edges = [0, *(np.flatnonzero(np.diff(begin // VOTED)) + 1).tolist(), len(found)] if len(found) else []
        for a, z in zip(edges[:-1], edges[1:]):
            low = begin[a]
            sums = self.votes(voting[low : last[a:z].max()])
            for i in range(a, z, MARKED):
                j = min(z, i + MARKED)
                marks[i:j] = self.fingerprints(sums, first[i:j] - low, last[i:j] - low)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        order = np.argsort(found[:, 1], kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(found[order, 1])) + 1) if len(found) else ():
            window, item = self.candidates(int(found[run[0], 1]), marks[run])
            for w, i in zip(run[window].tolist(), item.tolist()):
                doc, _, p, n = found[w].tolist()
                s = self.similarity(hashes[p : p + n], i)
                if s >= self.threshold and s > best.get((doc, i), (0.0,))[0]:
                    best[doc, i] = (s, p - int(np.searchsorted(of, doc)), n)
        for (doc, i), found_at in sorted(best.items()):
            yield doc, i, *found_at


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * n // ITEMS), -(-2 * size // ITEM_BYTES)) if n > ITEMS or size > ITEM_BYTES else 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b) for b in range(parts)]


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, mark: F.Column) -> DataFrame:
    """What ``find_passages`` gives, with the documents' marks."""
    texts, out = docs.select("doc_id", mark.alias("mark"), "text"), None
    for block in _blocks(benchmark):
        rows = sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, threshold)
            for batch, part in pieces(batches, limit=PIECE):
                of, codes, vocab = words(_plain(part))
                hashes = names(vocab)[codes] if len(of) else np.zeros(0, np.uint64)
                ids, marks = column(batch, "doc_id").to_pylist(), column(batch, "mark")
                hits = [(d, ids[d], index.items[i][0], *m) for d, i, *m in index.matches(of, hashes)]
                if hits:
                    at, doc, item, s, p, n = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), marks.take(pa.array(at)), pa.array(item, pa.int64()), pa.array(s), pa.array(p, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "mark", "item_id", "similarity", "first_word", "n_words"],
                    )

        found = texts.mapInArrow(run, "doc_id long, mark binary, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each benchmark item found in each document, its best window."""
    return _found(docs, benchmark, threshold, F.lit(None).cast("binary")).drop("mark")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, told by id, null too, and text: other texts of their id stay."""
    found = _found(docs, benchmark, threshold, text_mark())
    own, of, mark = free(docs, "_id", "_of", "_mark")
    gone = keep(found.select(F.col("doc_id").alias(own), F.col("mark").alias(of)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(of))
    return docs.withColumn(mark, text_mark()).join(F.broadcast(gone) if small(gone) else gone, same, "left_anti").select(*docs.columns)
