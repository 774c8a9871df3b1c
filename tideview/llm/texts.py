"""Words and shingles of a batch of texts as arrays, shared by the operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is a piece of its own.
PIECE = 2 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches cut to about ``limit`` bytes of text, each with its texts, null as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // limit)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, z - a), texts.slice(a, z - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word the text's number and the word's code, and the words by code.

    Words are runs of anything but the six ASCII white spaces; ``lower`` changes A-Z only.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    of = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return of[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def listed(strings: pa.Array) -> list[str]:
    """The strings as a list: by way of one array, which is several times faster than one by one."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def names(strings: pa.Array) -> np.ndarray:
    """A 64-bit number for each string, the same in every process."""
    return pd.util.hash_array(np.asarray(strings.to_numpy(zero_copy_only=False), dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def places(k: int) -> np.ndarray:
    """An odd factor for each place in a shingle of k words."""
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(of: np.ndarray, hashes: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles as 64-bit numbers: (offsets by text, numbers sorted in each text).

    A text with fewer than k words, but at least one, has its whole sequence as its only shingle.
    """
    lengths = np.bincount(of, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(lengths)))
    factors = places(k)
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled += hashes[j : n - k + 1 + j] * factors[j]
        whole = of[: n - k + 1] == of[k - 1 :]
        own, values = of[: n - k + 1][whole], mix(rolled[whole])
    else:
        own, values = of[:0], hashes[:0]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        lone = np.array([mix((hashes[first[i] : first[i + 1]] * factors[: lengths[i]]).sum(keepdims=True) + np.uint64(lengths[i]))[0] for i in short], dtype=np.uint64)
        own, values = np.concatenate((own, short)), np.concatenate((values, lone))
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    own, values = own[fresh], values[fresh]
    return np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n_texts)))), values
