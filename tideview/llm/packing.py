"""Packing of token sequences into windows of fixed size, online and in bounded space.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; what
remains goes to the open window where it leaves least room. If it fits in none, the fullest is emitted
(topped up with the head of the document, if more than a few tokens are free there) and a new one is opened. At
the end the open windows of many partitions are merged: their pieces are packed again, group by group,
in the same way, and the last window of a group is all that stays partly empty.

The first pass's result is stored before it is read twice, so sequence numbers cannot change when a task
is run again. A group of leftovers holds at most ``MERGED`` partitions' open windows, whatever the input.

Edge cases: a null or empty text is the end token alone; every document has at least one token, so every row
has a piece, repeated rows each their own. No tokens are dropped or doubled. An empty table gives
no rows. Special tokens' names inside a text are taken as the tokenizer takes them. Other columns are not looked at.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.shared import keep
from tideview.llm.texts import column, listed, pieces

OPEN = 64
#: Free tokens in the fullest window up to which it is emitted as it is; beyond, a document is cut to fill it.
SLACK = 8
#: Partitions whose open windows are merged together.
MERGED = 32
#: Words whose tokens a task remembers.
REMEMBERED = 1 << 19
#: Bytes of text whose distinct words are looked up at once.
PIECE = 2 << 20

#: How the tokenizer marks the end of a piece, and marks that are a piece of their own after letters.
WORD_END = "</w>"
#: Letters that stay one letter when normalised and lower-cased (fixed values: Latin without U+0130, and Cyrillic).
LETTERS = r"^[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{024F}\x{0400}-\x{0481}]+$"
MARKS = ".,;:!?%$&#*()"

FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts, by way of each distinct word once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a piece of the text
        self.last[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True

    def _each(self, some: list[str]) -> None:
        for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()

    def _letters(self, some: list[str]) -> None:
        """Words of letters only: the tokenizer takes each as one piece, so many can be encoded as one text."""
        for i in range(0, len(some), 2000):
            part = some[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._each(part)  # some letter became several pieces when lower-cased
                continue
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            for w, a, z in zip(part, [0, *ends], ends):
                self.known[w] = raw[a:z]

    def _learn(self, fresh: list[str]) -> None:
        known = self.known
        stems = pc.utf8_rtrim(pa.array(fresh, pa.string()), characters=MARKS)
        plain = pc.match_substring_regex(stems, LETTERS).to_numpy(zero_copy_only=False).tolist()
        # the tokenizer lower-cases, so such letters in any case are the same tokens
        parts = [(w, s, w[len(s) :]) for w, s, ok in zip(fresh, listed(pc.utf8_lower(stems)), plain) if ok]
        tails = dict.fromkeys(t for _, _, t in parts if t and t not in known)
        self._each([w for w, ok in zip(fresh, plain) if not ok and w not in tails] + list(tails))
        self._letters(list(dict.fromkeys(s for _, s, _ in parts if s not in known)))
        for w, s, t in parts:
            if t:
                known[w] = known[s] + known[t]
            elif w is not s:
                known[w] = known[s]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end token, and the texts' offsets in them."""
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        of = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        vocab, codes = listed(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:
            # the words of this piece are the ones most likely to come again
            self.known = {w: self.known[w] for w in vocab if w in self.known}
        self._learn([w for w in vocab if w not in self.known])
        each = [self.known[w] for w in vocab]
        size = np.array([*map(len, each), 4]) >> 2
        pool = np.frombuffer(b"".join(each) + np.array([self.end], np.uint32).tobytes(), np.uint32)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        # the end of each text as one more word, after its last
        order = np.argsort(np.concatenate((of, np.arange(len(texts)))), kind="stable")
        word = np.concatenate((codes, np.full(len(texts), len(each))))[order]
        n = size[word]
        ids = pool[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)]
        lengths = np.bincount(np.concatenate((of, np.arange(len(texts))))[order], weights=n, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(lengths)))


class Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, number: int, windows: int = OPEN):
        self.size, self.windows, self.next = size, windows, number
        self.open: list[tuple[int, list]] = []  # (used, pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        while len(ids) >= self.size:
            yield from self.close([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [(self.size - used - len(ids), i) for i, (used, _) in enumerate(self.open) if used + len(ids) <= self.size]
        if fits:
            _, i = min(fits)
            used, held = self.open[i]
            held.append((doc, start, ids, total))
            if used + len(ids) == self.size:
                yield from self.close(self.open.pop(i)[1])
            else:
                self.open[i] = (used + len(ids), held)
            return
        if len(self.open) == self.windows:
            i = max(range(len(self.open)), key=lambda j: self.open[j][0])
            used, held = self.open.pop(i)
            free = self.size - used
            if free > SLACK:
                held.append((doc, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            yield from self.close(held)
        self.open.append((len(ids), [(doc, start, ids, total)]))

    def close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in held:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        for _, held in self.open:
            for doc, start, ids, total in held:
                yield doc, start, len(ids), ids.tobytes(), total, None, 0
        self.open = []

    def finish(self) -> Iterator[tuple]:
        """Close what is open, fullest first, filling each from the emptiest by cutting."""
        held = sorted((p for _, ps in self.open for p in ps), key=lambda p: -len(p[2]))
        self.open = []
        now, used = [], 0
        for doc, start, ids, total in held:
            while len(ids):
                part = ids[: self.size - used]
                now.append((doc, start, part, total))
                used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                if used == self.size:
                    yield from self.close(now)
                    now, used = [], 0
        if now:
            yield from self.close(now)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian 32-bit numbers."""
    schema = pa.schema(_TYPES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = Encoder(tokenizer, end), Packer(size, part << 32)
        for batch, texts in pieces(batches, limit=PIECE):
            ids, at = encode(texts)
            out: list[tuple] = []
            for doc, a, z in zip(column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                out.extend(packer.add(doc, 0, ids[a:z], z - a))
            if out:
                yield tagged(out, part)
        out = list(packer.rest())
        if out:
            yield tagged(out, part)

    def tagged(rows: list[tuple], part: int) -> pa.RecordBatch:
        made = _batch(rows, schema)
        return pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(len(rows), part), pa.int32())], names=[*schema.names, "part"])

    made = keep(docs.select("doc_id", "text").mapInArrow(first, FIELDS + ", part int"), "packed")

    def merge(key, table):
        # numbers of merged sequences lie above those of any partition
        packer = Packer(size, (1 << 62) + (key[0].as_py() << 32))
        out: list[tuple] = []
        rows = sorted(zip(*(c.to_pylist() for c in table.select(["part", "doc_id", "start", "ids", "doc_tokens"]).columns)), key=lambda r: (-len(r[3]), r[0], r[1] is None, r[1] or 0, r[2]))
        for _, doc, start, ids, total in rows:
            out.extend(packer.add(doc, start, np.frombuffer(ids, np.uint32), total))
        out.extend(packer.finish())
        return pa.Table.from_batches([_batch(out, schema)], schema=schema)

    left = made.where("sequence_id IS NULL").withColumn("block", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("block").applyInArrow(merge, FIELDS)
    return made.where("sequence_id IS NOT NULL").drop("part").unionByName(merged)
