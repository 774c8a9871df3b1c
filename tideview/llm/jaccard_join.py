"""Exact similarity join of documents on sets of word shingles, with adaptive multi-match prefixes.

All sets are sorted by one order, rare shingles first. If two sets are similar enough, then for every m up to
the required overlap their prefixes of n - ceil(t n) + m shingles share at least m. A document whose prefix
holds frequent shingles would meet many candidates; it gets a longer prefix (a larger m), and a pair must
share as many prefix shingles as the smaller of its two m, and what follows the last of them must leave room for
the required overlap, before it is verified on the whole sets.

How the work stays in proportion:

* Equal sets are one node, found by a 128-bit fingerprint, so copies are never compared. A node's text is found by id and
  hash, so rows without an id, or many texts of one id, meet their own node only.
* Shingles that the same documents hold, like those of one passage, are one list with their number: a pair meets once
  for each such list, not once for each shingle.
* The order comes from counts of shingles that repeat within pieces of text; only the most frequent ones
  are named, all others count as rare. Any order gives the same result, this one avoids long lists.
* The documents of a prefix shingle's list are first compared with one member only: the one in which the fewest rarer
  shingles come before it, which is what near copies were made from. The links found join most of a group;
  then only pairs whose components still differ are enumerated, and of these only where what follows the
  shared shingle leaves room for the required overlap. No pair that could join two components is left out.
* Candidates are first compared by sketches, bitmaps of their sets with four bits or more for each shingle: an element
  whose bit the other lacks is not shared, so the overlap has an upper bound, and only pairs that it leaves open
  are verified. No link is lost by it.
* A much-compared document is replicated over salts, and its partners are dealt over them.

Edge cases: null or wordless texts have no shingles, no links, and their own id as component. Fewer than k words
are one shingle. Repeated rows and repeated ids give one output row per input row; an id that stands for
several texts belongs to each text's component separately. A null id is never anybody's component unless all of
the component's ids are null. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.components import components
from tideview.llm.shared import free, keep, small, text_mark
from tideview.llm.texts import column, names, pieces, shingles, words

#: Frequent shingles that the order knows by name; only the order depends on it, never the result.
FREQUENT = 1 << 17
#: Bytes of text whose repeated shingles are counted together, and repeats below which they count as rare.
COUNTED = 16 << 20
REPEATS = 4
#: Meetings that a prefix's frequent shingles may cost before it asks for a second match; each further one takes four times as many.
COST = 2048
#: Partners of one document that meet in one task.
PARTNERS = 2000


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    of, codes, vocab = words(texts)
    return shingles(of, names(vocab)[codes] if len(of) else np.zeros(0, np.uint64), len(texts), k)


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketch(values: np.ndarray) -> bytes:
    """A set as a bitmap: its size is a power of two, four to eight times the set's, and 64 bits at least."""
    size = 64
    while size < 4 * len(values):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the overlap of two sets of ``n_a`` and ``n_b`` elements, from their sketches."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = 8 * max(len(a), len(b))
    for _ in range(size.bit_length()):
        if 8 * min(len(a), len(b)) >= size:
            break
        # the longer one is folded: halves laid over each other are the sketch of half the size
        size //= 2
        low = (1 << size) - 1
        x, y = (x >> size) | (x & low), (y >> size) | (y & low)
    return min(n_a - (x & ~y).bit_count(), n_b - (y & ~x).bit_count())


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (times null) with its mark, its text's hash and its set's size and fingerprint, and rows of repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= REPEATS
            n = int(many.sum())
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(n, pa.binary()), none, none, none, none, pa.array(values[many].view(np.int64)), pa.array(times[many])], names=fields)

        fields = ["doc_id", "mark", "tag", "n", "hi", "lo", "token", "times"]
        for batch, texts in pieces(batches):
            ends, values = _sets(texts, k)
            marks = [_fingerprint(values[a:z]) if z > a else (None, None) for a, z in zip(ends[:-1], ends[1:])]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "mark"), column(batch, "tag"), pa.array(np.diff(ends)), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), none, none],
                names=fields,
            )
            held.append(values)
            size += texts.nbytes
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "doc_id long, mark binary, tag long, n long, hi long, lo long, token long, times long")


def _prefixes(docs: DataFrame, frequent: DataFrame, percent: int, k: int) -> DataFrame:
    """(hi, n, need, tokens, sketch): the prefix of each document's set, the matches it asks for, and the set's sketch."""
    named = frequent.collect()  # at most FREQUENT rows of two numbers
    token = np.array([r.token for r in named], np.int64).view(np.uint64)
    times = np.array([r.times for r in named], np.int64)
    order = np.argsort(token)
    shared = docs.sparkSession.sparkContext.broadcast((token[order], times[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for _batch, texts in pieces(batches):
            ends, values = _sets(texts, k)
            own = np.repeat(np.arange(len(texts)), np.diff(ends))
            weight = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                weight = np.where(known[at] == values, counts[at], 0)
            order = np.lexsort((weight, own))
            ranked, cost = values[order].view(np.int64), weight[order]
            out: list[tuple] = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
                n = z - a
                if not n:
                    continue
                overlap = -(-percent * n // 100)
                least = n - overlap + 1
                need = 1 + int(np.log2(1 + cost[a : a + least].sum() / COST) / 2)
                need = min(need, overlap)
                out.append((_fingerprint(values[a:z])[0], n, need, ranked[a : a + least + need - 1], _sketch(values[a:z])))
            if out:
                hi, n, need, tokens, sketch = zip(*out)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in tokens]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi, pa.int64()), pa.array(n, pa.int64()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens))), pa.array(sketch, pa.binary())],
                    names=["hi", "n", "need", "tokens", "sketch"],
                )

    return docs.mapInArrow(run, "hi long, n long, need int, tokens array<long>, sketch binary")


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (pivot, member), a kept table, checked on whole sets."""
    load = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    members = pairs.join(load, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.col("member").alias("hi"), F.lit(True).alias("is_member"))
    pivots = load.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("hi"), F.lit(False).alias("is_member"))
    wanted = keep(members.unionByName(pivots).join(nodes.select("hi", "held.doc_id", "held.tag"), "hi"), "wanted", 2 * pairs.count())
    side = F.broadcast(wanted) if small(wanted, 200_000) else wanted
    texts = docs.alias("d").join(side.alias("w"), _same_row("d", "w")).select("d.text", "w.pivot", "w.salt", "w.hi", "w.is_member")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in pieces(batches):
            ends, values = _sets(part, k)
            each = [values[a:z] for a, z in zip(ends[:-1], ends[1:])]
            marks = [_fingerprint(x) for x in each]
            right = pa.array([m[0] == h for m, h in zip(marks, column(batch, "hi").to_pylist())])
            made = pa.RecordBatch.from_arrays(
                [column(batch, "pivot"), column(batch, "salt"), column(batch, "is_member"), column(batch, "hi"), pa.array([m[1] for m in marks], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())],
                names=["pivot", "salt", "is_member", "hi", "lo", "shingles"],
            )
            yield made.filter(right)

    dealt = texts.mapInArrow(sets, "pivot long, salt int, is_member boolean, hi long, lo long, shingles binary")
    dealt = dealt.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "is_member", "hi", "lo")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, last = None, [], None
        for batch in batches:
            left, right = [], []
            for pivot, salt, is_member, hi, lo, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (pivot, salt) != at:
                    at, pivots, last = (pivot, salt), [], None
                if (is_member, hi, lo) == last:
                    continue  # a copy of the row before
                last = (is_member, hi, lo)
                own = np.frombuffer(raw, np.uint64)
                if not is_member:
                    pivots.append((f"{hi}:{lo}", own))
                    continue
                for name, other in pivots:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        left.append(name)
                        right.append(f"{hi}:{lo}")
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a string, b string")


def _same_row(x: str, y: str) -> F.Column:
    """The same id, or none, and the same text by its hash."""
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.tag") == F.col(f"{y}.tag"))


def _alike(x: str, y: str, percent: int) -> F.Column:
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def _room(need_a: str, need_b: str, rest_a: str, rest_b: str, n_a: str, n_b: str, percent: int) -> F.Column:
    """Whether a list's first shingle can be among the first matches that a pair needs: what follows it must allow the required overlap."""
    return F.expr(f"{100 + percent} * (least({need_a}, {need_b}) + least({rest_a}, {rest_b})) >= {percent} * ({n_a} + {n_b})")


def _candidates(pairs: DataFrame, pivot: str, member: str, n: tuple, need: tuple, rest: tuple, times: tuple, percent: int) -> DataFrame:
    """The (pivot, member) that share enough prefix shingles, and whose sets can still overlap enough after the last list's first one.

    Lists are left out from some place of the order on, so all shared shingles up to that one are counted.
    """
    met = pairs.groupBy(F.col(pivot).alias("pivot"), F.col(member).alias("member")).agg(
        F.sum(F.least(*times)).alias("met"), F.min(F.least(*need)).alias("need"), F.min(F.col(n[0]) + F.col(n[1])).alias("sizes"), F.least(F.min(rest[0]), F.min(rest[1])).alias("rest")
    )
    return met.where(f"met >= need AND {100 + percent} * (met + rest) >= {percent} * sizes").select("pivot", "member")


def _open(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (pivot, member) that their sketches do not rule out."""
    held = prefixes.select("hi", "n", "sketch")
    both = pairs.join(held.select(F.col("hi").alias("pivot"), F.col("n").alias("n_a"), F.col("sketch").alias("a")), "pivot")
    both = both.join(held.select(F.col("hi").alias("member"), F.col("n").alias("n_b"), F.col("sketch").alias("b")), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (column(batch, x).to_pylist() for x in ("a", "b", "n_a", "n_b"))
            may = [(100 + percent) * most_shared(*x) >= percent * (x[2] + x[3]) for x in zip(a, b, n_a, n_b)]
            yield batch.select(["pivot", "member"]).filter(pa.array(may, pa.bool_()))

    # distinct: two sets may have one name
    return both.select("pivot", "member", "a", "b", "n_a", "n_b").mapInArrow(run, "pivot long, member long").distinct()


def _classes(docs: DataFrame, mark: F.Column, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, hi, lo), and for each set that has copies or links (hi, lo, component_id, first, nameless).

    ``first`` is the component's smallest (doc_id, mark) with an id, ``nameless`` its smallest mark without one.
    """
    tag = F.xxhash64("text").alias("tag")
    survey = keep(_survey(docs.select("doc_id", "text", mark.alias("mark"), tag), k), "survey")
    docs = docs.select("doc_id", "text", tag)
    n = survey.count()
    rows = survey.where("times IS NULL")
    has_id = F.col("doc_id").isNotNull()
    first = F.min(F.when(has_id, F.struct("doc_id", "mark"))).alias("first"), F.min(F.when(~has_id, F.col("mark"))).alias("nameless")
    nodes = keep(rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "tag")).alias("held"), F.count("*").alias("copies"), *first), "nodes", n)
    frequent = survey.where("times IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT)

    spare = rows.where("hi IS NOT NULL").select("doc_id", "tag").distinct().alias("r").join(nodes.select("held.*").alias("h"), _same_row("r", "h"), "left_anti")
    spare = keep(spare, "spare", n)
    firsts = docs.alias("d").join((F.broadcast(spare) if small(spare) else spare).alias("s"), _same_row("d", "s"), "left_anti")
    prefixes = keep(_prefixes(firsts, frequent, percent, k), "prefixes")
    if not prefixes.groupBy("hi", "n").count().where("count > 1").isEmpty():
        prefixes = keep(prefixes.dropDuplicates(["hi", "n", "sketch"]), "prefixes")  # rows that are written several times
    # rest: how much of the set comes after the shingle
    postings = prefixes.select("hi", "n", "need", F.posexplode("tokens").alias("pos", "token")).withColumn("rest", F.col("n") - 1 - F.col("pos"))
    # most shingles occur in one prefix only: they go first, by the least that tells
    lists = postings.groupBy("token").count().where("count > 1").select("token")
    n_postings = prefixes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    met = keep(postings.join(keep(lists, "lists", n_postings // 2), "token"), "met", n_postings)
    # shingles of the same documents are one list: how many they are, and what comes after the first of them.
    # Lists that met by their hash would only be compared once more than needed
    held = met.groupBy("token").agg(F.xxhash64(F.count("*"), F.min("hi"), F.max("hi"), F.bit_xor(F.xxhash64("hi"))).alias("list"))
    merged = met.join(held, "token").groupBy("list", "hi").agg(F.min("n").alias("n"), F.min("need").alias("need"), F.max("rest").alias("rest"), F.count("*").alias("times"))
    merged = keep(merged, "merged", met.count())
    n_merged = merged.count()
    first = merged.groupBy("list").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("pos"), "n", "hi", "need", "rest", "times")).alias("first"))
    shared = keep(merged.join(first, "list"), "postings", n_merged)

    # every member of a list against the one in which the fewest rarer shingles come before: what the others were made from
    pairs = shared.where(F.col("hi") != F.col("first.hi")).where(_alike("n", "first.n", percent) & _room("need", "first.need", "rest", "first.rest", "n", "first.n", percent))
    tried = keep(_candidates(pairs, "first.hi", "hi", ("n", "first.n"), ("need", "first.need"), ("rest", "first.rest"), ("times", "first.times"), percent), "pairs", n_merged)
    first_open = keep(_open(tried, prefixes, percent), "open", tried.count())
    links = keep(_verify(docs, nodes, first_open, percent, k), "links", first_open.count(), PARTNERS)
    joined = keep(components(links), "classes", 2 * links.count())

    # then every pair of a list that could still join two components
    roots = joined.groupBy(F.split("node", ":")[0].cast("long").alias("hi")).agg(F.min("root").alias("root"), F.max("root").alias("other"))
    roots = roots.select("hi", F.when(F.col("root") == F.col("other"), F.col("root")).alias("root"))
    placed = shared.select("list", "hi", "n", "need", "rest", "times").join(roots, "hi", "left").withColumn("root", F.coalesce("root", F.col("hi").cast("string")))
    placed = keep(placed, "placed", n_merged)
    apart = placed.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list")
    left = keep(placed.join(apart, "list"), "apart", n_merged)
    n_pairs = left.groupBy("list").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] or 0
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.list") == F.col("b.list")) & (F.col("a.hi") < F.col("b.hi")) & (F.col("a.root") != F.col("b.root")) & _alike("a.n", "b.n", percent) & _room("a.need", "b.need", "a.rest", "b.rest", "a.n", "b.n", percent))
    pairs = _candidates(pairs, "a.hi", "b.hi", ("a.n", "b.n"), ("a.need", "b.need"), ("a.rest", "b.rest"), ("a.times", "b.times"), percent)
    done = tried.select(F.least("pivot", "member").alias("pivot"), F.greatest("pivot", "member").alias("member"))
    more = keep(pairs.join(done, ["pivot", "member"], "left_anti"), "more", n_pairs)
    more = keep(_open(more, prefixes, percent), "open", more.count())
    if not more.isEmpty():
        links = links.unionByName(keep(_verify(docs, nodes, more, percent, k), "links", more.count(), PARTNERS))
        joined = keep(components(links), "classes", 2 * links.count())

    named = nodes.withColumn("node", F.concat_ws(":", "hi", "lo")).join(joined, "node", "left")
    named = named.withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "node")).where("linked OR copies > 1")
    named = keep(named.select("hi", "lo", "root", "first_id", "first", "nameless"), "named", n)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"), F.min("nameless").alias("nameless"))
    return rows, named.select("hi", "lo", "root").join(ids, "root").drop("root")


def link_components(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    rows, named = _classes(docs, F.lit(None).cast("binary"), percent, k)
    out = rows.join(named.select("hi", "lo", "component_id"), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one row of each component: of those with the smallest id, one with the smallest hash of its text.

    Rows are told apart by id and text, so another text of a dropped row's id stays. Rows without an id are told apart
    from those with one: of them, too, one of each component stays. Rows without words are in no component and stay.
    """
    own, of, mark = free(docs, "_id", "_of", "_mark")
    rows, named = _classes(docs, text_mark(), percent, k)
    stays = F.when(F.col("doc_id").isNull(), F.col("mark") == F.col("nameless")).otherwise(F.struct("doc_id", "mark") == F.col("first"))
    held = keep(rows.join(named, ["hi", "lo"]).select(F.col("doc_id").alias(own), F.col("mark").alias(of), stays.alias("stays")), "held", rows.count())
    n = held.count()
    gone = keep(held.where("NOT stays").select(own, of).distinct(), "gone", n)
    # those that stay and are written several times
    again = keep(held.where("stays").groupBy(own, of).agg(F.count("*").alias("n")).where("n > 1").select(own, of), "again", n)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(of))
    left = docs.withColumn(mark, text_mark()).join(F.broadcast(gone) if small(gone) else gone, same, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    side = F.broadcast(again) if small(again) else again
    one = left.join(side, same, "left_semi").groupBy("doc_id", mark).agg(F.any_value(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(side, same, "left_anti").select(*docs.columns).unionByName(one)
