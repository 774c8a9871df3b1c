"""Log probabilities of texts by online logistic context mixing.

A text is its words, A-Z lower-cased, and an end. ``lm_words`` tells how a known word is coded: bits of a path in a tree of the
known words, predicted by contexts of the words before it, and guesses from what the text itself repeats. An unknown word
(not met in the learning texts) is spelled: its bytes and a space, each byte as eight bits. Six hashed contexts predict each bit:
the last one, two, three, four and six bytes, and the whole word so far. Their counts come from all distinct words of
the learning texts, each once; their weights are learned online on words met once, whose own occurrence is taken out
of the counts first.

A path depends on the word and its kind of context only, so each distinct pair is scored once; the guesses run through
each whole text. Neither counts, weights nor scores depend on how the input is cut to tasks (but for the last digits of sums):
learners are dealt by a hash, in number by the vocabulary, and their weights averaged. The scores of the ``NAMED`` most frequent
pairs are broadcast; the rest is joined.

The chance of a wrong guess is not taken from the guessed word's path, so the scores of all texts sum to a little less than one.

Edge cases: a null text is empty, so it is the end alone; rows with a null id are learned from and not held out. Repeated rows
each count and each get their row. Words of any length are coded whole. Without any learning text every word is
unknown and spelled with even chances. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm import lm_words
from tideview.llm.shared import keep
from tideview.llm.texts import column, mix, names, pieces, words

#: Bits of each context's table: orders 1, 2, 3, 4, 6 and the word so far.
ORDERS = (1, 2, 3, 4, 6)
TABLES = (14, 18, 20, 20, 20, 20)
#: Slots of a table that are summed together, bytes that are coded at once, words that one learner learns from.
BLOCK, CHUNK, TASK_WORDS = 1 << 16, 1 << 16, 200_000
#: Words whose spellings one task counts, tasks whose tables are summed at once, words whose pairs one task sums before they are shuffled.
COUNT_WORDS, FAN, HELD = 1_000_000, 16, 400_000
#: (word, kind) pairs that are named to all tasks.
NAMED = 1_000_000
#: A word that is no more than this part of some bytes' tokens is not counted there when the most frequent words are looked for.
SHARE = 1 << 14
GATES, STEPS, EDGE = 24, 33, 8.0
RATE = 0.05

END = "\n"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of each token and the distinct words; each text's last token is the end."""
    of, codes, vocab = words(texts)
    n = len(texts)
    sizes = np.bincount(of, minlength=n) + 1
    last = np.zeros(int(sizes.sum()), bool)
    last[np.cumsum(sizes) - 1] = True
    all_codes = np.full(len(last), len(vocab))
    all_codes[~last] = codes
    return np.repeat(np.arange(n), sizes), all_codes, pa.concat_arrays([vocab, pa.array([END], vocab.type)])


#: First bytes of a word that are compared with those of the word before.
SHARED = 32


class Path:
    """The binary decisions of some words after some kinds: contexts' hashes and symbols, byte by byte.

    A byte with the same kind and the same bytes before it is the same decision for all words, so words that are sorted
    share the bytes they begin with: ``edge`` tells each byte's decision, and there is one for each distinct beginning.
    """

    def __init__(self, coded: list[bytes], kinds: np.ndarray):
        self.sizes = np.array([len(x) for x in coded], np.int64)
        self.symbols = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(coded)), self.sizes)
        pos = np.arange(len(self.symbols)) - first[self.word]
        fresh, self.edge = self._beginnings(pos, kinds)
        mark = 256 + kinds[self.word]
        factor = np.uint64(0x9E3779B97F4A7C15)
        self.hashes = []
        h = np.full(len(self.symbols), 1469598103934665603, np.uint64)
        for j in range(1, max(ORDERS) + 1):
            before = np.zeros(len(self.symbols), np.int64)
            before[j:] = self.symbols[:-j] if j < len(self.symbols) else 0
            before = np.where(pos >= j, before, np.where(pos == j - 1, mark, 511))
            h = (h ^ before.astype(np.uint64)) * factor
            h ^= h >> np.uint64(32)
            if j in ORDERS:
                self.hashes.append(h)
        base = np.uint64(0x5851F42D4C957F2D)
        back = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, len(self.symbols) - 1), base))), dtype=np.uint64)
        undo = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, len(self.symbols) - 1), back))), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.symbols.astype(np.uint64) + np.uint64(1)) * powers[: len(self.symbols)], dtype=np.uint64)))[:-1]
        at = first[self.word]
        whole = (sums - sums[at]) * undo[at] + mark.astype(np.uint64) if len(self.symbols) else h
        self.hashes.append(whole * factor ^ np.uint64(77))
        self.symbols = self.symbols[fresh]
        self.hashes = [h[fresh] for h in self.hashes]

    def _beginnings(self, pos: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin something new, and for every byte the number of the new one that it equals."""
        n = len(self.sizes)
        table = np.full((n, SHARED), 256, np.int16)
        head = pos < SHARED
        table[self.word[head], pos[head]] = self.symbols[head]
        same = np.zeros((n, SHARED), bool)
        same[1:] = (table[1:] == table[:-1]) & (kinds[1:] == kinds[:-1])[:, None]
        np.logical_and.accumulate(same, axis=1, out=same)
        fresh = np.ones(len(pos), bool)
        fresh[head] = ~same[self.word[head], pos[head]]
        number = np.cumsum(fresh) - 1
        owner = np.maximum.accumulate(np.where(same, 0, np.arange(n)[:, None]), axis=0)
        first = np.cumsum(self.sizes) - self.sizes
        edge = number.copy()
        edge[head] = number[first[owner[self.word[head], pos[head]]] + pos[head]]
        return fresh, edge

    def times(self, times: np.ndarray) -> np.ndarray:
        """How often each decision was met, from the words' times."""
        return np.bincount(self.edge, weights=times[self.word], minlength=len(self.symbols))

    def decisions(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(bit's place, bit, slots by table) for each of a byte's eight bits."""
        for b in range(7, -1, -1):
            node = ((1 << (7 - b)) | (self.symbols >> (b + 1))).astype(np.uint64)
            slots = []
            for h, bits in zip(self.hashes, TABLES):
                mixed = (h + node * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
                slots.append(((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(20) & np.uint64((1 << bits) - 1)).astype(np.int64))
            yield b, (self.symbols >> b) & 1, slots


def _chunks(rows: list[str], kinds: np.ndarray) -> Iterator[tuple[np.ndarray, Path]]:
    """The rows cut to chunks, each with its rows' numbers; rows that begin alike are put next to each other."""
    coded = [(w if w == END else w + " ").encode() for w in rows]
    order = np.array(sorted(range(len(rows)), key=coded.__getitem__), np.int64)
    order = order[np.argsort(kinds[order], kind="stable")].tolist()
    ends = np.cumsum([len(coded[i]) for i in order])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(coded)]
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z > a:
            at = np.array(order[a:z])
            yield at, Path([coded[i] for i in order[a:z]], kinds[at])


class Mixer:
    """Counts by table and slot, gated weights and the refining map."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts  # zeros and ones of each table, as two rows
        k = len(TABLES) + 1
        self.by_gate = np.full((GATES, k), 0.25, np.float32)
        self.by_bit = np.zeros((8, k), np.float32)
        self.squares = (np.zeros((GATES, k)), np.zeros((8, k)))
        grid = np.linspace(-EDGE, EDGE, STEPS)
        self.map = np.stack((1 / (1 + np.exp(grid)), 1 / (1 + np.exp(-grid))), axis=1)[None].repeat(GATES, 0) * 8.0

    def state(self) -> tuple[np.ndarray, ...]:
        return self.by_gate, self.by_bit, self.map

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each context, a row for each, and the gate; with ``bit``, one such bit is taken out of the counts."""
        odds, seen = np.empty((len(slots) + 1, len(slots[0])), np.float32), []
        for j, (table, slot) in enumerate(zip(self.counts, slots)):
            zeros, ones = table[0].take(slot), table[1].take(slot)
            if bit is not None:
                one = bit.astype(np.float32)
                ones = np.maximum(ones - one, 0)
                zeros = np.maximum(zeros - (1 - one), 0)
            np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)), out=odds[j])
            seen.append(zeros + ones)
        np.clip(odds, -EDGE, EDGE, out=odds)
        odds[-1] = 0.3
        whole, four = seen[-1], seen[3]
        gate = sum((whole >= t).astype(np.int64) for t in (1, 3, 10, 60, 500)) * 4 + sum((four >= t).astype(np.int64) for t in (2, 12, 100))
        return odds, gate

    def mix(self, odds: np.ndarray, gate: np.ndarray, b: int) -> np.ndarray:
        weights = self.by_gate + self.by_bit[b]
        total = weights[:, 0].take(gate) * odds[0]
        for j in range(1, len(odds)):
            total += weights[:, j].take(gate) * odds[j]
        return np.clip(total, -EDGE, EDGE)

    def refine(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mix and of what was observed at such a mix."""
        at = (mixed.astype(float) + EDGE) / (2 * EDGE) * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        observed = (self.map[..., 1] / self.map.sum(-1)).ravel()
        place = gate * STEPS + low
        seen = observed.take(place) * (1 - part) + observed.take(place + 1) * part
        return 0.5 / (1 + np.exp(-mixed.astype(float))) + 0.5 * seen

    def learn(self, path: Path, times: np.ndarray, rate: float) -> None:
        """One online pass over words that were seen ``times`` times."""
        w = path.times(times) ** 0.75
        for b, bit, slots in path.decisions():
            odds, gate = self.inputs(slots, bit)
            mixed = self.mix(odds, gate, b)
            error = w * (bit - 1 / (1 + np.exp(-mixed)))
            mass = np.bincount(gate, weights=w, minlength=GATES)
            step = np.stack([np.bincount(gate, weights=error * x, minlength=GATES) for x in odds], axis=1)
            for weights, slope, squares in ((self.by_gate, step / np.maximum(mass, 50)[:, None], self.squares[0]), (self.by_bit[b], step.sum(0) / max(mass.sum(), 50), self.squares[1][b])):
                squares += slope * slope
                weights += rate * slope / np.sqrt(squares + 1e-8)
            near = np.rint((mixed + EDGE) / (2 * EDGE) * (STEPS - 1)).astype(np.int64)
            self.map += np.bincount((gate * STEPS + near) * 2 + bit, weights=w, minlength=self.map.size).reshape(self.map.shape)

    def score(self, path: Path) -> np.ndarray:
        """log10 probability of each word."""
        total = np.zeros(len(path.symbols))
        for b, bit, slots in path.decisions():
            odds, gate = self.inputs(slots)
            p = np.clip(self.refine(self.mix(odds, gate, b), gate), 1e-6, 1 - 1e-6)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return np.bincount(path.word, weights=total[path.edge], minlength=len(path.sizes))


ROWS = "word string, kind int, n long, least long"


def count_words(docs: DataFrame, learned: Column, share: int | None = None) -> DataFrame:
    """(word, kind, n, least): the learning texts' words; under an empty word, which no token is, their guesses by run and outcome.

    With ``share``, words that are rare in a piece of the input are left out there: no more than a number of occurrences
    that is summed for each word over the pieces that have it (least), and over all pieces under the empty word and kind -1,
    where ``n`` is the number of all tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _batch, texts in pieces(batches):
            of, codes, vocab = tokens(texts)
            n = np.bincount(codes, minlength=len(vocab))
            least = len(codes) // share if share else 0
            some = np.flatnonzero(n > least)
            _at, right, after = lm_words.guesses(of, codes)
            outcomes = np.bincount(after * 2 + right, minlength=2 * lm_words.RUNS)
            word = pa.concat_arrays([vocab.take(pa.array(some)), pa.array([""] * (len(outcomes) + 1), vocab.type)])
            kind = np.concatenate((np.zeros(len(some), np.int32), np.arange(-1, len(outcomes), dtype=np.int32)))
            arrays = [word, pa.array(kind), pa.array(np.concatenate((n[some], [len(codes)], outcomes))), pa.array(np.full(len(word), least))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "kind", "n", "least"])

    return docs.where(learned).select("text").mapInArrow(run, ROWS).groupBy("word", "kind").agg(F.sum("n").alias("n"), F.sum("least").alias("least"))


def frequent_words(vocab: DataFrame, missing: int) -> dict[str, int] | None:
    """The most frequent words by number; None where ``missing`` uncounted occurrences a word may change which they are."""
    plain = vocab.where(~F.col("word").isin("", END))
    top = [(r.word, r.n) for r in plain.orderBy(F.desc("n"), "word").limit(lm_words.NAMES).collect()]
    if missing:
        other = plain.where(~F.col("word").isin([w for w, _n in top])).agg(F.max(F.col("n") - F.col("least"))).first()[0]
        if len(top) < lm_words.NAMES or top[-1][1] <= missing + max(0, other or 0):
            return None
    return {w: i for i, (w, _n) in enumerate(top)}


def _contexts(of: np.ndarray, codes: np.ndarray, vocab: pa.Array, names: dict[str, int]) -> np.ndarray:
    found = pc.fill_null(pc.index_in(vocab, value_set=pa.array(list(names), vocab.type)), -1).to_numpy()
    return lm_words.kinds(of, np.array([*names.values(), -1], np.int64)[found][codes])


WORDS = "word string, hash long, c long, kinds array<long>"


def _lists(word: np.ndarray, n_words: int, kind: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each word's kinds, with how often, as one number each: ``kind + KINDS * n``."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=n_words))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n * lm_words.KINDS + kind, pa.int64()))


def _unlisted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, kind, n) of the entries of ``_lists``."""
    word = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    n, kind = np.divmod(lists.flatten().to_numpy(zero_copy_only=False), lm_words.KINDS)
    return word, kind, n


def _packed(lists: pa.Array) -> pa.Array:
    """The lists' numbers as bytes, which Spark moves several times faster."""
    ends = (lists.offsets.to_numpy() * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(lists.values.to_numpy())])


def _unpacked(packed: pa.Array) -> pa.Array:
    packed = packed.cast(pa.binary())
    _valid, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(data, np.int64, ends[-1])))


def _summed(word: np.ndarray, lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """One list for each word, from rows whose words are ``word`` (every number from 0 occurs), and each word's occurrences."""
    row, kind, n = _unlisted(lists)
    key = word[row] * lm_words.KINDS + kind
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    one, kind = np.divmod(key[first], lm_words.KINDS)
    n = np.add.reduceat(n[order], first)
    return _lists(one, one[-1] + 1, kind, n), np.add.reduceat(n, np.flatnonzero(np.diff(one, prepend=-1)))


def count_pairs(docs: DataFrame, learned: Column, names: dict[str, int]) -> DataFrame:
    """(word, kinds): for parts of the input, how often each word of any text follows each kind of context in the learning texts (``_packed``)."""

    def together(held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([w for w, _l in held]).dictionary_encode()
        lists, _c = _summed(coded.indices.to_numpy().astype(np.int64), pa.concat_arrays([x for _w, x in held]))
        return pa.RecordBatch.from_arrays([coded.dictionary, _packed(lists)], names=["word", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch, texts in pieces(batches):
            of, codes, vocab = tokens(texts)
            take = column(batch, "learned").to_numpy(zero_copy_only=False).astype(bool)[of]
            key = np.sort((codes * lm_words.KINDS + _contexts(of, codes, vocab, names)) * 2 + take)
            first = np.flatnonzero(np.diff(key >> 1, prepend=-1))
            code, kind = np.divmod(key[first] >> 1, lm_words.KINDS)
            held.append((vocab, _lists(code, len(vocab), kind, np.add.reduceat(key & 1, first))))
            if sum(len(w) for w, _l in held) >= HELD:
                yield together(held)
                held = []
        if held:
            yield together(held)

    return docs.select("text", learned.alias("learned")).mapInArrow(run, "word string, kinds binary")


def _fresh(values: pa.Array) -> np.ndarray:
    """Which values differ from the one before."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return fresh


def by_word(pairs: DataFrame, total: int) -> DataFrame:
    """(word, c, kinds, code): each word once with its kinds' counts (no more than ``KINDS``) and its place in the tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in lm_words.whole_groups(batches, lm_words.STEP_WORDS, "hash"):
            word, hashed, lists = (table.column(x).combine_chunks() for x in ("word", "hash", "kinds"))
            fresh = _fresh(word)
            if (fresh[1:] & ~_fresh(hashed)[1:]).any():
                # words of the same hash may be mixed
                order = pc.sort_indices(table, [("hash", "ascending"), ("word", "ascending")])
                word, hashed, lists = (x.take(order) for x in (word, hashed, lists))
                fresh = _fresh(word)
            lists, c = _summed(np.cumsum(fresh) - 1, _unpacked(lists))
            once = pa.array(np.flatnonzero(fresh))
            arrays = [word.take(once), hashed.take(once), pa.array(c), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "hash", "c", "kinds"])

    dealt = pairs.repartition(F.xxhash64("word")).select("word", F.xxhash64("word").alias("hash"), "kinds").sortWithinPartitions("hash")
    rare = F.when(F.col("c") > 0, F.least(F.lit((1 << lm_words.CLASS_BITS) - 1), F.floor(F.log2(F.lit(float(total)) / F.col("c"))).cast("long"))).otherwise(0)
    hashed = lm_words.DEPTH - lm_words.CLASS_BITS
    code = F.shiftleft(rare, hashed) + F.col("hash").bitwiseAND(F.lit((1 << hashed) - 1))
    return dealt.mapInArrow(add, WORDS).select("word", "c", "kinds", code.alias("code"))


def gather(vocab: DataFrame, size: int) -> list[np.ndarray]:
    """All spelling contexts' counts, summed over the ``size`` distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tables = [np.zeros((1 << bits) * 2) for bits in TABLES]
        for batch in batches:
            rows = column(batch, "word").to_pylist()
            for _at, path in _chunks(rows, np.zeros(len(rows), np.int64)):
                w = path.times(np.ones(len(path.sizes)))
                for _b, bit, slots in path.decisions():
                    for table, slot in zip(tables, slots):
                        np.add.at(table, bit * (len(table) // 2) + slot, w)
        for t, table in enumerate(tables):
            for k in range(0, len(table), BLOCK):
                block = table[k : k + BLOCK]
                if block.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([k // BLOCK], pa.int32()), pa.array([part // FAN], pa.int32()), pa.array([zlib.compress(block.astype(np.int64).tobytes(), 1)], pa.binary())],
                        names=["t", "block", "half", "counts"],
                    )

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        first = table.slice(0, 1).drop_columns(["counts"])
        return first.append_column("counts", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    schema = "t int, block int, half int, counts binary"
    # a task's tables hardly grow with its words, so they are few
    tasks = max(1, -(-size // COUNT_WORDS))
    made = vocab.coalesce(tasks).mapInArrow(count, schema)
    if tasks > FAN:
        made = made.groupBy("t", "block", "half").applyInArrow(add, schema)
    made = made.groupBy("t", "block").applyInArrow(add, schema)
    tables = [np.zeros((1 << bits) * 2, np.float32) for bits in TABLES]
    for r in made.collect():
        part = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
        tables[r.t][r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return [t.reshape(2, -1) for t in tables]


def _learned(rows: DataFrame, learn, start) -> tuple[np.ndarray, ...]:
    """Weights, averaged over the tasks' learners by what they learned from, and the maps, summed. ``learn(own, batches)`` tells that mass.

    ``start()`` makes a learner; its ``state()`` is two tables of weights and a map.
    """
    fresh = start().state()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start()
        mass = learn(own, batches)
        if mass:
            gate, other, seen = own.state()
            arrays = [pa.array([mass]), *(pa.array([x.astype(float).tobytes()], pa.binary()) for x in (gate, other, seen - fresh[2]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["mass", "gate", "other", "seen"])

    total, weights, seen = 0.0, [np.zeros(x.shape) for x in fresh[:2]], fresh[2].copy()
    for r in rows.mapInArrow(run, "mass double, gate binary, other binary, seen binary").collect():
        total += r.mass
        for w, part in zip(weights, (r.gate, r.other)):
            w += r.mass * np.frombuffer(bytes(part)).reshape(w.shape)
        seen += np.frombuffer(bytes(r.seen)).reshape(seen.shape)
    return (*(w / total for w in weights), seen) if total else fresh


def train_spelling(known: DataFrame, size: int) -> Mixer:
    """Counts from all learned words, weights and map from those met once."""
    mixer = Mixer(gather(known.select("word"), size))
    shared = known.sparkSession.sparkContext.broadcast(mixer.counts)
    once = known.where("c = 1").select("word")
    # words that begin alike come together, such groups in random order
    dealt = once.repartition(max(1, -(-once.count() // TASK_WORDS)), "word").sortWithinPartitions(F.crc32(F.substring("word", 1, 3)), "word")

    def learn(own: Mixer, batches: Iterator[pa.RecordBatch]) -> float:
        n = 0
        for batch in batches:
            rows = column(batch, "word").to_pylist()
            n += len(rows)
            for _at, path in _chunks(rows, np.zeros(len(rows), np.int64)):
                own.learn(path, np.ones(len(path.sizes)), RATE)
        return float(n)

    mixer.by_gate, mixer.by_bit, mixer.map = _learned(dealt, learn, lambda: Mixer(shared.value if TaskContext.get() else []))
    return mixer


def _tree(table: pa.Table, top: np.ndarray) -> tuple[lm_words.Tree, np.ndarray, np.ndarray]:
    """The words of some whole groups as a tree, and for each entry its word's number and that word's learning occurrences."""
    word, kind, n = _unlisted(table.column("kinds").combine_chunks())
    return lm_words.Tree(table.column("code").to_numpy(), word, kind, n, top), word, table.column("c").to_numpy()[word]


def train_words(dealt: DataFrame, top: np.ndarray, counts: np.ndarray) -> lm_words.Mixer:
    """Weights and map of the paths and of the bit that a word is unknown; ``counts``: (known, unknown) of each kind."""
    shared = dealt.sparkSession.sparkContext.broadcast(top)

    def learn(own: lm_words.Mixer, batches: Iterator[pa.RecordBatch]) -> float:
        mass = 0.0
        for table in lm_words.whole_groups(batches, lm_words.STEP_WORDS, "code", lm_words.LOW):
            tree, _word, c = _tree(table, shared.value)
            # entries with the same kind and outcome make the same decision
            n = np.bincount(tree.kind * 2 + (c == 1), weights=tree.n, minlength=2 * lm_words.KINDS)
            use = np.flatnonzero(n)
            own.learn(lm_words.KNOWN, use & 1, *lm_words.known_counts(counts, use >> 1), n[use])
            tree.learn(own, np.where(c > 1, tree.n, 0).astype(float))
            mass += float(tree.n.sum())
        return mass

    mixer = lm_words.Mixer()
    mixer.by_gate, mixer.by_level, mixer.map = _learned(dealt, learn, lm_words.Mixer)
    return mixer


SCORED = "key long, n long, c long, s double"


def _keys(hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A 64-bit number for each pair of a word, by its own number, and a kind."""
    return mix(hashed + (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def _scored(hashed: np.ndarray, kind: np.ndarray, n: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_keys(hashed, kind)), pa.array(n), pa.array(c), pa.array(s)], names=["key", "n", "c", "s"])


def score_known(dealt: DataFrame, top: np.ndarray, counts: np.ndarray, mixer: lm_words.Mixer) -> DataFrame:
    """(key, n, c, s) of the known words and their kinds: learning occurrences of the pair and of the word, and the log10 probability after the kind."""
    shared = dealt.sparkSession.sparkContext.broadcast((top, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, mixer = shared.value
        known = np.log10(1 - mixer.chance(lm_words.KNOWN, *lm_words.known_counts(counts, np.arange(lm_words.KINDS))))
        for table in lm_words.whole_groups(batches, lm_words.STEP_WORDS, "code", lm_words.LOW):
            tree, word, c = _tree(table, top)
            s = tree.score(mixer) + known[tree.kind]
            yield _scored(names(table.column("word").combine_chunks())[word], tree.kind, tree.n, c, s)

    return dealt.mapInArrow(run, SCORED)


def score_unknown(unknown: DataFrame, counts: np.ndarray, mixer: lm_words.Mixer, spelling: Mixer) -> DataFrame:
    """(key, n, c, s) of the words that were not learned."""
    chance = mixer.chance(lm_words.KNOWN, *lm_words.known_counts(counts, np.arange(lm_words.KINDS))) if counts.any() else np.ones(lm_words.KINDS)
    shared = unknown.sparkSession.sparkContext.broadcast(spelling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column(batch, "word").to_pylist()
            spelled = np.zeros(len(rows))
            for at, path in _chunks(rows, np.zeros(len(rows), np.int64)):
                spelled[at] = shared.value.score(path)
            word, kind, _n = _unlisted(column(batch, "kinds"))
            none = np.zeros(len(word), np.int64)
            yield _scored(names(column(batch, "word"))[word], kind, none, none, spelled[word] + np.log10(chance)[kind])

    return unknown.mapInArrow(run, SCORED)


def least_named(scored: DataFrame) -> int:
    """The smallest number of occurrences such that no more than ``NAMED`` pairs have as many or more."""
    least, pairs = np.iinfo(np.int64).max, 0
    for r in scored.groupBy("n").count().orderBy(F.desc("n")).collect():
        pairs += r["count"]
        if pairs > NAMED:
            break
        least = r.n
    return int(least)


#: What a text knows of itself before its other pairs are joined.
OWN = ["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score"]


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    ``held_out`` marks the rows that are not learned from. base_score is that of a word count model with 0.1
    added to each word's count.
    """
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    learned = ~F.col("held_out")
    spark = docs.sparkSession
    for share in (SHARE, None):
        vocab = keep(count_words(docs, learned, share), "vocabulary")
        outcomes, total, missing = np.full((lm_words.RUNS, 2), 0.5), 0, 0
        for r in vocab.where("word = ''").collect():
            if r.kind < 0:
                total, missing = r.n, r.least
            else:
                outcomes[r.kind // 2, r.kind % 2] += r.n
        frequent = frequent_words(vocab, missing)
        if frequent is not None:
            break
    rates = outcomes[:, 1] / outcomes.sum(1)

    words = keep(by_word(count_pairs(docs, learned, frequent), total), "words")
    known = words.where("c > 0")
    size = known.count()
    group = F.shiftright("code", lm_words.LOW)
    kinds = known.select(group.alias("grp"), "c", F.explode("kinds").alias("k"))
    kinds = kinds.select("grp", "c", F.expr(f"int(k % {lm_words.KINDS})").alias("kind"), F.expr(f"k div {lm_words.KINDS}").alias("n"))
    counts = np.zeros((lm_words.KINDS, 2))
    for r in kinds.groupBy("kind").agg(F.sum(F.when(F.col("c") > 1, F.col("n")).otherwise(0)).alias("more"), F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("one")).collect():
        counts[r.kind] = r.more, r.one
    upper = kinds.groupBy("grp", "kind").agg(F.sum("n").alias("n")).toArrow()
    top = np.zeros((lm_words.KINDS, 1 << lm_words.TOP))
    top[upper.column("kind").to_numpy(), upper.column("grp").to_numpy()] = upper.column("n").to_numpy()
    learners = max(1, -(-size // TASK_WORDS))
    # learning needs no words, so they are not shuffled for it
    plain = known.select("c", "kinds", "code").repartition(learners, group).sortWithinPartitions("code", "c")
    dealt = known.repartition(learners, group).sortWithinPartitions("code", "word")
    mixer = train_words(plain, top, counts)
    both = score_known(dealt, top, counts, mixer).unionByName(score_unknown(words.where("c = 0"), counts, mixer, train_spelling(known, size)))
    scored = keep(both, "scored")
    least = least_named(scored)
    named = scored.where(F.col("n") >= least).select("key", "c", "s").toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((*(named.column(i).to_numpy() for i in range(3)), frequent, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known_c, known_s, frequent, rates = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch, texts in pieces(batches):
            of, codes, vocab = tokens(texts)
            m = len(texts)
            at, right, after = lm_words.guesses(of, codes)
            guessed = np.zeros(len(of), np.int64)
            guessed[at] = right
            size = pc.binary_length(vocab).to_numpy().astype(np.int64) + 1
            size[-1] = 1  # the end
            # each distinct (text, word, kind) once: how often, and how often not guessed
            most = len(vocab) * lm_words.KINDS
            key = np.sort((of * most + codes * lm_words.KINDS + _contexts(of, codes, vocab, frequent)) * 2 + guessed)
            first = np.flatnonzero(np.diff(key >> 1, prepend=-1))
            times = np.diff(first, append=len(key))
            coded = times - np.add.reduceat(key & 1, first)
            text, pair = np.divmod(key[first] >> 1, most)
            used = np.zeros(most, bool)
            used[pair] = True
            pairs = np.flatnonzero(used)
            number = np.empty(most, np.int32)
            number[pairs] = np.arange(len(pairs))
            pair = number[pair]
            code, kind = np.divmod(pairs, lm_words.KINDS)
            keys = _keys(names(vocab)[code], kind)
            # sorted, they are found several times faster
            order = np.argsort(keys)
            found = np.empty(len(keys), np.int64)
            found[order] = np.minimum(np.searchsorted(index, keys[order]), max(0, len(index) - 1))
            is_named = index[found] == keys if len(index) else np.zeros(len(keys), bool)
            near = is_named[pair]
            c, s = np.zeros((2, len(keys)))
            c[is_named], s[is_named] = known_c[found[is_named]], known_s[found[is_named]]
            at_text, at_pair = text[near], pair[near]
            base = np.bincount(at_text, weights=times[near] * np.log10(c + 0.1)[at_pair], minlength=m).astype(float)
            score = np.bincount(at_text, weights=coded[near] * s[at_pair], minlength=m).astype(float)
            score += np.bincount(of[at], weights=lm_words.guess_cost(of, at, right, after, rates), minlength=m)
            n_known = np.bincount(at_text, weights=times[near] * (c > 0)[at_pair], minlength=m).astype(np.int64)
            far = ~near
            own = [pa.array(row + np.arange(m)), column(batch, "doc_id"), column(batch, "held_out"), pa.array(np.bincount(of, minlength=m)),
                   pa.array(np.bincount(of, weights=size[codes], minlength=m).astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(score)]
            zeros = pa.array(np.zeros(m, np.int64))
            yield pa.RecordBatch.from_arrays([own[0], own[0], zeros, zeros, pa.StructArray.from_arrays(own[1:], names=OWN)], names=["row", "key", "n", "coded", "own"])
            rest = [pa.array(x) for x in (row + text[far], keys[pair[far]], times[far], coded[far])]
            yield pa.RecordBatch.from_arrays([*rest, pa.nulls(len(rest[0]), pa.struct(list(zip(OWN, (x.type for x in own[1:])))))], names=["row", "key", "n", "coded", "own"])
            row += m

    fields = "doc_id:long,held_out:boolean,n_tokens:long,n_bytes:long,n_known:long,base:double,score:double"
    # a row of its own numbers for each text, which no pair meets, and one for each pair that is not broadcast
    made = docs.mapInArrow(run, f"row long, key long, n long, coded long, own struct<{fields}>").join(scored.where(F.col("n") < least).select("key", "c", "s"), "key", "left")
    whole = made.groupBy("row").agg(
        *(F.max(f"own.{c}").alias(c) for c in OWN[:4]),
        F.sum(F.coalesce("own.n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("own.base", F.col("n") * F.log10(F.col("c") + 0.1))).alias("base"),
        F.sum(F.coalesce("own.score", F.col("coded") * F.col("s"))).alias("score"),
    )
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(total + 0.1 * (size + 1)))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

