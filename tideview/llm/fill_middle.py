"""Fill-in-the-middle transformation by in-place rotation of blocks, and its exact inverse.

A text is cut twice between units (lines). Its bytes lie in one bytearray: the cuts are found by a scan, the sentinels are
inserted before the three segments, and the last segment is exchanged with the one or two before it by a rotation, which
is three reversals in place. ``restore`` finds the sentinels, rotates back and takes them out.

    psm  <P>prefix<S>suffix<M>middle      the suffix changes places with the middle
    spm  <S>suffix<P>prefix<M>middle      the suffix changes places with prefix and middle

Cuts and form depend on the seed and the id alone, so a lost task makes the same rows again. A text that holds a sentinel,
an empty one, and the share not chosen stay plain. Nothing is shuffled; a task holds one batch of texts and a copy of one.

Edge cases: a null text counts as empty. A null id has the hash of the seed alone. Repeated rows give equal rows, an
empty table none. A text without a newline is one unit, a newline ends its unit, a text of newlines has one each. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideview.llm.texts import column, pieces

#: Prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that change places at once in a reversal.
CHUNK = 1 << 16


def reverse(buffer: bytearray, a: int, z: int) -> None:
    """Reverse ``buffer[a:z]`` in place, from both ends inwards."""
    view = np.frombuffer(buffer, np.uint8)
    while z - a > 1:
        n = min(CHUNK, (z - a) // 2)
        left = view[a : a + n].copy()
        view[a : a + n] = view[z - n : z][::-1]
        view[z - n : z] = left[::-1]
        a, z = a + n, z - n


def rotate(buffer: bytearray, a: int, m: int, z: int) -> None:
    """Exchange the neighbouring blocks ``buffer[a:m]`` and ``buffer[m:z]`` in place."""
    reverse(buffer, a, m)
    reverse(buffer, m, z)
    reverse(buffer, a, z)


def unit_ends(raw: bytes | bytearray) -> np.ndarray:
    """Where each line ends, in bytes; what follows the last newline is a line too."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    return ends


def code_points(raw: bytes | bytearray) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an id."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i : i + 8], 16) for i in range(0, 32, 8))


def arrange(raw: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """``raw`` cut at the two bytes, with sentinels, in the order of ``form``."""
    prefix, suffix, middle = marks
    out = bytearray(raw)
    out[second:second] = suffix  # from the back, so that the places before stay right
    out[first:first] = middle
    out[0:0] = prefix
    m = len(prefix) + first
    s = m + len(middle) + second - first
    rotate(out, m if form == "psm" else 0, s, len(out))
    return out


def put_back(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text that ``arrange`` was given, from its output and form."""
    prefix, suffix, middle = marks
    out = bytearray(output)
    m = out.find(middle)  # the text holds no sentinel, so each occurs once
    if form == "psm":
        s = out.find(suffix)
        size, begin = m - s, s
        rotate(out, s, m, len(out))
    else:
        p = out.find(prefix)
        size, begin = p, 0
        rotate(out, 0, p, len(out))
    s = len(out) - size
    del out[s : s + len(suffix)]
    m = begin if form == "psm" else out.find(middle)
    del out[m : m + len(middle)]
    del out[: len(prefix)]
    return out


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (doc_id, text).

    ``n`` counts units; ``percent`` of the texts that can be are transformed, ``spm_percent`` of them to spm.
    """
    marks = tuple(s.encode() for s in sentinels)

    def one(doc_id: int | None, raw: bytes) -> tuple:
        ends = unit_ends(raw)
        n = len(ends)
        h = draws(seed, doc_id)
        if not raw or any(s in raw for s in marks) or h[2] % 100 >= percent:
            return n, "plain", None, None, raw
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, z = (int(ends[i - 1]) if i else 0 for i in (first, second))
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        return n, form, code_points(raw[:a]), code_points(raw[a:z]), bytes(arrange(raw, a, z, form, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            ids = column(batch, "doc_id")
            made = [one(i, t) for i, t in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist())]
            n, form, prefix, middle, output = zip(*made)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, long), pa.array(form), pa.array(prefix, long), pa.array(middle, long), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` with ``restored``: the exact text, from ``output`` and ``form`` alone."""
    marks = tuple(s.encode() for s in sentinels)
    made = made.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, outputs in pieces(batches, "output"):
            forms = column(batch, "form").to_pylist()
            back = [o if f == "plain" else bytes(put_back(o, f, marks)) for o, f in zip(outputs.cast(pa.binary()).to_pylist(), forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(run, f"{fields}, restored string")
