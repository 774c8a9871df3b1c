"""Logistic mixing over the binary decisions that name a known word, in contexts of the words before it.

Known words are the leaves of a binary tree: five bits of how rare the word is, then bits of its hash. A token is a path;
at each node where both ways lead to known words one bit is predicted by three contexts: none, the last of the ``NAMES``
most frequent words before the token wherever it stood (a sparse context), and the same with whether it stood directly
before (a word pair). Their counts are exact sums over all learning tokens: the upper ``TOP`` levels are a table of fixed size,
below it the words of one node stay together in one task, nodes are numbered level by level, and words that are alike
down to a node are one decision there.
So what is gathered grows with the vocabulary, and nothing but the upper table is sent to all tasks.

The contexts' log odds are mixed by weights that a gate (how often the contexts were seen) and the level pick; the mix is
refined by a map to observed frequencies. Weights and map are learned online, each token's own count taken out first.
Before the path one more bit tells whether the word is known; in learning a word seen once stands for an unknown one.

In a text, the two words before a token may have stood there earlier; then a bit tells whether the word that followed them
last time follows again. Its chance starts at the rate over all learning texts, by how many such guesses in a row were right,
and is updated after every token of the text. A right guess names the word, so no path is coded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most frequent words that are contexts; with "none" and two distances for each, the kinds of context.
NAMES = 31
KINDS = 1 + 2 * NAMES
#: Bits for the rarity class, levels of the upper table, all levels.
CLASS_BITS, TOP, DEPTH = 5, 13, 40
LOW = DEPTH - TOP
#: The level under which the known-or-not bit is learned.
KNOWN = DEPTH
CONTEXTS = 3
SEEN = (1, 3, 10, 100, 1000)
GATES = (len(SEEN) + 1) ** 2
STEPS, EDGE, RATE = 49, 12.0, 0.05
#: Right guesses in a row that are told apart, and the weight of the corpus' rate against the text's own.
RUNS, PRIOR = 8, 4.0
#: Words that are learned from in one step.
STEP_WORDS = 20_000


def starts(of: np.ndarray) -> np.ndarray:
    """Each token's text's first place."""
    n = len(of)
    fresh = np.ones(n, bool)
    fresh[1:] = of[1:] != of[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(n), 0))


def kinds(of: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The context of each token, from the number each token has among the frequent words (-1: none)."""
    n = len(of)
    place = np.arange(n)
    before = np.full(n, -1)
    before[1:] = np.maximum.accumulate(np.where(names >= 0, place, -1))[:-1]
    inside = before >= starts(of)
    return np.where(inside, 1 + 2 * names[np.maximum(before, 0)] + (before == place - 1), 0)


def guesses(of: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, right, run) of the tokens that the text's earlier words guess: was the guess right, right ones in a row before."""
    n = len(of)
    first = starts(of)
    at = np.flatnonzero(np.arange(n) - first >= 2)
    n_codes = int(codes.max(initial=0)) + 1
    pair = codes[at - 2] * n_codes + codes[at - 1]
    if (int(of.max(initial=0)) + 1) * n_codes * n_codes * max(1, len(at)) < 1 << 63:
        # text, pair and place as one number: the same order, several times faster
        order = np.sort((of[at] * (n_codes * n_codes) + pair) * len(at) + np.arange(len(at))) % max(1, len(at))
    else:
        order = np.lexsort((pair, of[at]))
    again = np.zeros(len(at), bool)
    again[1:] = (pair[order][1:] == pair[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
    now, then = at[order[again]], at[order[np.flatnonzero(again) - 1]]
    hit = np.zeros(n, bool)
    hit[now] = codes[now] == codes[then]
    place = np.arange(n)
    miss = np.maximum.accumulate(np.where(hit, -1, place))
    now = np.sort(now)
    run = now - 1 - np.maximum(miss[now - 1], first[now])
    return now, hit[now], np.minimum(run, RUNS - 1)


def guess_cost(of: np.ndarray, at: np.ndarray, right: np.ndarray, run: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """log10 probability of each guess's outcome, the text's own earlier outcomes counted in."""
    key = of[at] * RUNS + run
    order = np.argsort(key, kind="stable")
    k, r = key[order], right[order].astype(float)
    begin = starts(k) if len(k) else k
    seen = np.arange(len(k)) - begin
    sums = np.concatenate(([0.0], np.cumsum(r)))
    hits = sums[:-1] - sums[begin]
    p = (hits + PRIOR * rates[run[order]]) / (seen + PRIOR)
    out = np.empty(len(k))
    out[order] = np.log10(np.where(right[order], p, 1 - p))
    return out


class Mixer:
    """Gated weights, weights by level, and the refining map."""

    def __init__(self):
        k = CONTEXTS + 1
        self.by_gate = np.full((GATES, k), 0.3)
        self.by_level = np.zeros((DEPTH + 1, k))
        self.squares = (np.zeros((GATES, k)), np.zeros((DEPTH + 1, k)))
        grid = np.linspace(-EDGE, EDGE, STEPS)
        self.map = np.stack((1 / (1 + np.exp(grid)), 1 / (1 + np.exp(-grid))), axis=1)[None].repeat(GATES, 0) * 8.0

    def state(self) -> tuple[np.ndarray, ...]:
        return self.by_gate, self.by_level, self.map

    def _mix(self, zeros: np.ndarray, ones: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = np.full((CONTEXTS + 1, zeros.shape[1]), 0.3)
        np.log((ones + 0.3) / (zeros + 0.3), out=odds[:CONTEXTS])
        np.clip(odds, -EDGE, EDGE, out=odds)
        met, seen = zeros[1:] + ones[1:], np.zeros((CONTEXTS - 1, zeros.shape[1]), np.int8)
        for t in SEEN:
            seen += met >= t
        gate = seen[0].astype(np.int64) * (len(SEEN) + 1) + seen[1]
        weights = self.by_gate + self.by_level[level]
        mixed = weights[:, 0].take(gate) * odds[0]
        for j in range(1, len(odds)):
            mixed += weights[:, j].take(gate) * odds[j]
        return odds, gate, np.clip(mixed, -EDGE, EDGE)

    def learn(self, level: int, bit: np.ndarray, zeros: np.ndarray, ones: np.ndarray, times: np.ndarray) -> None:
        """One step over tokens that were each met ``times`` times; their own count is taken out."""
        ones, zeros = np.maximum(ones - bit, 0), np.maximum(zeros - (1 - bit), 0)
        odds, gate, mixed = self._mix(zeros, ones, level)
        error = times * (bit - 1 / (1 + np.exp(-mixed)))
        mass = np.bincount(gate, weights=times, minlength=GATES)
        step = np.stack([np.bincount(gate, weights=error * x, minlength=GATES) for x in odds], axis=1)
        for weights, slope, squares in ((self.by_gate, step / np.maximum(mass, 50)[:, None], self.squares[0]), (self.by_level[level], step.sum(0) / max(mass.sum(), 50), self.squares[1][level])):
            squares += slope * slope
            weights += RATE * slope / np.sqrt(squares + 1e-8)
        near = np.rint((mixed + EDGE) / (2 * EDGE) * (STEPS - 1)).astype(np.int64)
        self.map += np.bincount((gate * STEPS + near) * 2 + bit, weights=times, minlength=self.map.size).reshape(self.map.shape)

    def chance(self, level: int, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        _odds, gate, mixed = self._mix(zeros, ones, level)
        at = (mixed + EDGE) / (2 * EDGE) * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        observed = (self.map[..., 1] / self.map.sum(-1)).ravel()
        place = gate * STEPS + low
        seen = observed[place] * (1 - part) + observed[place + 1] * part
        return np.clip(0.5 / (1 + np.exp(-mixed)) + 0.5 * seen, 1e-7, 1 - 1e-7)


def _names(kind: np.ndarray) -> np.ndarray:
    return (kind + 1) // 2


def _numbered(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number among the distinct keys, which are less than ``most``, in their order; and the distinct keys."""
    used = np.zeros(most, bool)
    used[key] = True
    distinct = np.flatnonzero(used)
    number = np.empty(most, np.int64)
    number[distinct] = np.arange(len(distinct))
    return number[key], distinct


def _firsts(number: np.ndarray, n: int) -> np.ndarray:
    """The first row of each number."""
    first = np.empty(n, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first


class Tree:
    """Words under some nodes of level ``TOP``, all words of each, by ascending code; entries are a word's kinds with their counts."""

    def __init__(self, codes: np.ndarray, word: np.ndarray, kind: np.ndarray, n: np.ndarray, top: np.ndarray):
        self.distinct, self.word, self.kind, self.n = codes, word, kind, n
        group = codes >> LOW
        self.group = np.cumsum(np.diff(group, prepend=group[:1]) != 0)  # numbered in this table
        # above level TOP a group's words with the same kind are alike; one entry stands for them
        self.groups = int(self.group[-1]) + 1 if len(codes) else 0
        self.alike, both = _numbered(self.group[word] * KINDS + kind, self.groups * KINDS)
        self.first = _firsts(self.alike, len(both))
        rows = (np.zeros_like(kind), _names(kind), kind)
        tops = (top.sum(0)[None], np.stack([top[_names(np.arange(KINDS)) == j].sum(0) for j in range(NAMES + 1)]), top)
        self.upper = [(r[self.first], np.concatenate((np.zeros((len(t), 1)), np.cumsum(t, axis=1)), axis=1)) for r, t in zip(rows, tops)]

    def decisions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, entries, bit, zeros, ones by context) wherever both ways lead to known words; one entry stands for those that are alike."""
        for level, at, bit, zeros, ones in self._above():
            yield level, self.first[at], bit, zeros, ones
        for level, entries, _number, first, at, bit, zeros, ones in self._below(np.ones(self.groups, bool)):
            yield level, entries[first[at]], bit, zeros, ones

    def _above(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, places in ``first``, bit, zeros, ones by context) above level ``TOP``."""
        group = self.distinct[self.word[self.first]] >> LOW
        low, high = np.zeros(len(group), np.int64), np.full(len(group), 1 << TOP)
        for level in range(TOP):
            mid = (low + high) // 2
            sums = [(t[r, mid] - t[r, low], t[r, high] - t[r, mid]) for r, t in self.upper]
            bit = (group >= mid).astype(np.int64)
            at = np.flatnonzero((sums[0][0] > 0) & (sums[0][1] > 0))
            if len(at):
                yield level, at, bit[at], np.stack([z[at] for z, _o in sums]), np.stack([o[at] for _z, o in sums])
            low, high = np.where(bit, mid, low), np.where(bit, high, mid)

    def _below(self, groups: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, entries, decision of each, first entry's place of each decision, the decisions with two ways, their bit, zeros, ones).

        Only the entries of ``groups`` are followed, down to where their word is alone. Entries with the same kind, node and bit
        make the same decision. Nodes are numbered anew at each level: by words, by words and names, by words and kinds.
        """
        c = np.bincount(self.word, weights=self.n, minlength=len(self.distinct))
        node = self.group
        entries = np.flatnonzero(groups[node[self.word]])
        word, n = self.word[entries], self.n[entries].astype(float)
        by_name, names = _numbered(node[word] * (NAMES + 1) + _names(self.kind[entries]), self.groups * (NAMES + 1))
        by_kind, kinds = _numbered(node[word] * KINDS + self.kind[entries], self.groups * KINDS)
        sizes = [self.groups, len(names), len(kinds)]
        words = np.bincount(node, minlength=self.groups)
        for level in range(TOP, DEPTH):
            more = (words > 1)[node[word]]
            if not more.all():
                entries, word, n, by_name, by_kind = (x[more] for x in (entries, word, n, by_name, by_kind))
            if not len(entries):
                return
            way = self.distinct >> (DEPTH - 1 - level) & 1
            ways = node * 2 + way, by_name * 2 + way[word], by_kind * 2 + way[word]
            sums = [np.bincount(x, weights=w, minlength=2 * k) for x, w, k in zip(ways, (c, n, n), sizes)]
            words = np.bincount(ways[0], minlength=2 * sizes[0])
            both = (words[::2] > 0) & (words[1::2] > 0)
            number, distinct = _numbered(ways[2], 2 * sizes[2])
            first = _firsts(number, len(distinct))
            at = np.flatnonzero(both[node[word[first]]])
            if len(at):
                left = [x[first[at]] & ~1 for x in (ways[0][word], ways[1])] + [distinct[at] & ~1]
                yield level, entries, number, first, at, distinct[at] & 1, np.stack([s[x] for s, x in zip(sums, left)]), np.stack([s[x + 1] for s, x in zip(sums, left)])
            node, used = _numbered(ways[0], 2 * sizes[0])
            words = words[used]
            by_name, names = _numbered(ways[1], 2 * sizes[1])
            by_kind, sizes = number, [len(used), len(names), len(distinct)]

    def score(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of each entry's word after its kind, given that the word is known."""
        total, above = np.zeros(len(self.word)), np.zeros(len(self.first))
        for level, at, bit, zeros, ones in self._above():
            p = mixer.chance(level, zeros, ones)
            above[at] += np.log10(np.where(bit == 1, p, 1 - p))
        for level, entries, number, first, at, bit, zeros, ones in self._below(np.ones(self.groups, bool)):
            p = mixer.chance(level, zeros, ones)
            cost = np.zeros(len(first))
            cost[at] = np.log10(np.where(bit == 1, p, 1 - p))
            total[entries] += cost[number]
        same = np.searchsorted(self.distinct, self.distinct, side="right") - np.searchsorted(self.distinct, self.distinct)
        return total + above[self.alike] - np.log10(same)[self.word]

    def learn(self, mixer: Mixer, times: np.ndarray) -> None:
        if not times.any():
            return
        above = np.bincount(self.alike, weights=times, minlength=len(self.first))
        for level, at, bit, zeros, ones in self._above():
            now = above[at]
            use = now > 0
            if use.any():
                mixer.learn(level, bit[use], zeros[:, use], ones[:, use], now[use])
        group = self.group[self.word]
        for level, entries, number, first, at, bit, zeros, ones in self._below(np.bincount(group, weights=times, minlength=self.groups) > 0):
            now = np.bincount(number, weights=times[entries], minlength=len(first))[at]
            use = now > 0
            if use.any():
                mixer.learn(level, bit[use], zeros[:, use], ones[:, use], now[use])


def known_counts(counts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones by context) of the bit that a word is unknown, from a row of (known, unknown) for each kind."""
    by_name = np.stack([counts[_names(np.arange(KINDS)) == j].sum(0) for j in range(NAMES + 1)])
    rows = (np.broadcast_to(counts.sum(0), (len(kind), 2)), by_name[_names(kind)], counts[kind])
    return np.stack([r[:, 0] for r in rows]), np.stack([r[:, 1] for r in rows])


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int, by: str = "grp", shift: int = 0) -> Iterator[pa.Table]:
    """The batches, which are sorted by ``by``, put together to at least ``rows`` rows, never cutting a group.

    A group's rows have the same ``by`` but for its lowest ``shift`` bits.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        group = table.column(by).to_numpy() >> shift
        cuts = np.flatnonzero(np.diff(group)) + 1
        begin = 0
        for cut in cuts.tolist():
            if cut - begin >= rows or (cut == cuts[-1] and cut > begin):
                yield table.slice(begin, cut - begin)
                begin = cut
        held = table.slice(begin).combine_chunks().to_batches()
        size = table.num_rows - begin
    if size:
        yield pa.Table.from_batches(held)
