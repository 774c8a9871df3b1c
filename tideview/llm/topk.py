"""Exact top-k by inner product, pruned by segment means and deviations from coarse to fine.

A vector is cut into segments; with a segment's mean m and deviation s (both over its length l), the inner product
of two vectors is at most the sum over segments of l * (m m' + s s'), which bounds their distance from below. Candidates
are put into groups of similar coarse statistics. A group is bounded by the extremes of its members' statistics; members of
groups that could still enter a query's best k are bounded on 4, 16 and 32 segments (as far as that is no longer than the
vector), and what survives gets its exact integer product, by matrix products of what is left of a block. Bounds are
raised by a margin far above rounding, so none is lost. A query starts with the score that it reaches within a sample of
``SAMPLE`` candidates: the sample's rows are candidates, so the best k cannot end below it.

Queries and candidates are dealt to blocks of bounded bytes, and each (query block, candidate block) is one group of a
shuffle: its queries come first, its candidates stream past them. Each group gives its best k of each query, and one ranking
joins the groups. Neither queries nor candidates go through the driver, but for the sample.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id. A shorter vector counts as filled up with zeros. Rows that share an id never match one another
as queries, and each of them is a candidate for others; as queries, those with different vectors are ranked each for
itself, and equal ones are one query. Fewer than k candidates: all
are returned. Ties go to the smaller id. Products are exact while they fit in 63 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideview.llm.shared import keep
from tideview.llm.texts import column as values

LEVELS = (4, 16, 32)
#: Bytes of a block of queries or candidates, candidates of one group, and rows that are bounded at once.
BYTES, GROUP, CHUNK = 4 << 20, 64, 1024
#: Candidates that give the first thresholds, fewer if they take more than a block's bytes.
SAMPLE = 1024
SCALE = 64


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 x) of the usable vectors."""
    good = F.col(column).isNotNull() & (F.size(column) > 0)
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & good & F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(int(sizes.max()) if len(sizes) else 0, width or 0)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments in turn, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:z].astype(float) for a, z in zip(cuts[:-1], cuts[1:])]
    return np.hstack([np.stack((p.mean(1), p.std(1)), axis=1) * np.sqrt(p.shape[1]) for p in parts])


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows, as whole numbers; by doubles where these hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _below(score: np.ndarray) -> np.ndarray:
    """The scores as doubles that are not above them."""
    score = score.astype(float)
    return score - 1e-12 * np.abs(score)


def _alike_first(stats: np.ndarray) -> np.ndarray:
    """An order that puts vectors with similar means next to each other: by the quarters their means fall in."""
    means = stats[:, ::2]
    return np.lexsort([np.searchsorted(np.quantile(m, (0.25, 0.5, 0.75)), m) for m in means.T][::-1])


class Best:
    """The best k so far of each query; ``tried`` and ``kept`` count pairs, the latter those that each step left."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query number, vec_id, score
        # a level that is as long as the vector itself is no longer a bound worth taking, but the first one always is
        self.levels = [s for s in LEVELS if s == LEVELS[0] or 2 * s <= q.shape[1]]
        self.stats = [_statistics(q, s) for s in self.levels]
        self.norm = float(np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0)))
        self.tried, self.kept = 0, np.zeros(1 + len(self.levels), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(self.ids) or not len(ids):
            return
        self.tried += len(self.ids) * len(ids)
        order = _alike_first(_statistics(x, self.levels[0]))
        ids, x = ids[order], x[order]
        stats = [_statistics(x, s) for s in self.levels]
        slack = 1e-9 * (1 + self.norm * float(np.sqrt((x.astype(float) ** 2).sum(1).max()))) + 1e-6
        starts = np.arange(0, len(ids), GROUP)
        mean, spread = stats[0][:, ::2], stats[0][:, 1::2]
        extremes = np.hstack((np.maximum.reduceat(mean, starts), np.minimum.reduceat(mean, starts), np.maximum.reduceat(spread, starts)))
        own_mean, own_spread = self.stats[0][:, ::2], self.stats[0][:, 1::2]
        bound = np.hstack((np.maximum(own_mean, 0), np.minimum(own_mean, 0), own_spread)) @ extremes.T + slack
        # the most promising groups first: they raise the thresholds of the others
        first = np.argsort(-(bound - self.least[:, None]).max(0), kind="stable") if np.isfinite(self.least).all() else np.argsort(-bound.max(0), kind="stable")
        for g in range(0, len(first), max(1, CHUNK // GROUP)):
            groups = first[g : g + max(1, CHUNK // GROUP)]
            sizes = np.minimum(starts[groups] + GROUP, len(ids)) - starts[groups]
            at = np.repeat(starts[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            for a in range(0, len(self.ids), CHUNK):
                open_groups = bound[a : a + CHUNK, groups] >= self.least[a : a + CHUNK, None]
                if open_groups.any():
                    self._block(np.arange(a, min(a + CHUNK, len(self.ids))), at, np.repeat(open_groups, sizes, axis=1), ids, x, stats, slack)

    def _block(self, query: np.ndarray, row: np.ndarray, alive: np.ndarray, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray], slack: float) -> None:
        """Bound and score the pairs of ``query`` and ``row`` that are ``alive``."""
        alive &= self.ids[query][:, None] != ids[row][None, :]
        for level in range(len(stats) + 1):
            self.kept[level] += np.count_nonzero(alive)
            some, any_row = alive.any(1), alive.any(0)
            if not some.any():
                return
            if not some.all() or not any_row.all():
                query, row, alive = query[some], row[any_row], alive[np.ix_(some, any_row)]
            if level < len(stats):
                alive &= self.stats[level][query] @ stats[level][row].T + slack >= self.least[query][:, None]
        score = _products(self.q[query], x[row])
        i, j = np.nonzero(alive & (score >= self.least[query][:, None]))
        self.merge(query[i], ids[row[j]], score[i, j])

    def merge(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, vec, score = (np.concatenate(x) for x in zip(self.found, (query, vec, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.found = query[top], vec[top], score[top]
        full = rank[top] == self.k - 1
        at = self.found[0][full]
        self.least[at] = np.maximum(self.least[at], _below(self.found[2][full]))


def _thresholds(queries: DataFrame, vectors: DataFrame, width: int, rows: int, k: int) -> DataFrame:
    """``queries`` with ``least``: a score that their best k cannot end below, or minus infinity."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, rows)).collect()
    ids, x = np.array([r.vec_id for r in sample], np.int64), _matrix(pa.array([list(r.v) for r in sample], pa.list_(pa.int64())), width)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            if len(ids) >= k:
                score = _below(_products(_matrix(values(batch, "v"), width), x))
                score[values(batch, "vec_id").to_numpy()[:, None] == ids[None, :]] = -np.inf
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*(values(batch, c) for c in ("vec_id", "mark", "v")), pa.array(least)], names=["vec_id", "mark", "v", "least"])

    return queries.mapInArrow(run, "vec_id long, mark long, v array<long>, least double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest products for each of ``queries``; both are (vec_id, v)."""
    vectors = keep(vectors.select("vec_id", "v"), "vectors")
    queries = keep(queries.select("vec_id", F.xxhash64("v").alias("mark"), "v").dropDuplicates(["vec_id", "mark"]), "queries")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, wide = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width, wide)
    rows = max(1, BYTES // (8 * width))
    n_blocks, m_blocks = max(1, -(-n // rows)), max(1, -(-m // rows))
    ready = keep(_thresholds(queries, vectors, width, rows, k), "thresholds")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = ready.select(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(m_blocks)).cast("int").alias("asks"), every(n_blocks).alias("has"), F.lit(False).alias("is_row"), "vec_id", "mark", "v", "least")
    # the kept table's rows in turn: equal rows, too, are dealt evenly
    held = vectors.select(F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int").alias("has"), "vec_id", "v")
    held = held.select(every(m_blocks).alias("asks"), "has", F.lit(True).alias("is_row"), "vec_id", F.lit(None).cast("long").alias("mark"), "v", F.lit(None).cast("double").alias("least"))
    dealt = asked.unionByName(held).repartition(n_blocks * m_blocks, "asks", "has").sortWithinPartitions("asks", "has", "is_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.found[0]):
                query, vec, score = best.found
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[query]), pa.array(marks[query]), pa.array(vec), pa.array(score)], names=["query_id", "mark", "vec_id", "score"])

        at, waiting, best, marks = None, [], None, None
        for batch in batches:
            key = [values(batch, c).to_numpy(zero_copy_only=False) for c in ("asks", "has", "is_row")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                if z == a:
                    continue
                part = batch.slice(a, z - a)
                if (key[0][a], key[1][a]) != at:
                    yield from results()
                    at, waiting, best = (key[0][a], key[1][a]), [], None
                if not key[2][a]:
                    waiting.append(part)
                elif waiting or best is not None:
                    if best is None:
                        own = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        marks, waiting = values(own, "mark").to_numpy(), []
                        best = Best(values(own, "vec_id").to_numpy(), _matrix(values(own, "v"), width), k, values(own, "least").to_numpy())
                    best.add(values(part, "vec_id").to_numpy(), _matrix(values(part, "v"), width))
        yield from results()

    found = dealt.mapInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
