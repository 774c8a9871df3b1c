"""Word paths, contexts and guesses of the language model against plain versions, and what its scores must do."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideview.llm import language, lm_mixing, lm_words


def some_texts(rng, n=6, words=6, most=60):
    """Texts as (text, word) of each token; each ends with one token of its own."""
    of, codes = [], []
    for i in range(n):
        for _ in range(rng.randint(0, most)):
            of.append(i)
            codes.append(rng.randrange(words))
        of.append(i)
        codes.append(words)
    return np.array(of), np.array(codes)


def test_kinds_plain():
    of, codes = some_texts(random.Random(1))
    names = np.array([0, 1, -1, -1, -1, -1, -1])
    want = []
    for i in range(len(of)):
        kind = 0
        for j in range(i - 1, -1, -1):
            if of[j] != of[i]:
                break
            if names[codes[j]] >= 0:
                kind = 1 + 2 * names[codes[j]] + (j == i - 1)
                break
        want.append(kind)
    assert lm_words.kinds(of, names[codes]).tolist() == want


def test_guesses_plain():
    rng = random.Random(2)
    for words in (1, 2, 4):
        of, codes = some_texts(rng, words=words)
        rates = np.linspace(0.1, 0.8, lm_words.RUNS)
        want, last, run, seen = [], {}, 0, defaultdict(lambda: [0, 0])
        for i in range(len(of)):
            if i == 0 or of[i] != of[i - 1]:
                last, run, seen, before = {}, 0, defaultdict(lambda: [0, 0]), []
            right = False
            if len(before) >= 2:
                key = (before[-2], before[-1])
                if key in last:
                    right = last[key] == codes[i]
                    r = min(run, lm_words.RUNS - 1)
                    hits, n = seen[r]
                    p = (hits + lm_words.PRIOR * rates[r]) / (n + lm_words.PRIOR)
                    want.append((i, right, r, np.log10(p if right else 1 - p)))
                    seen[r] = [hits + right, n + 1]
                last[key] = codes[i]
            run = run + 1 if right else 0
            before.append(codes[i])
        at, right, after = lm_words.guesses(of, codes)
        cost = lm_words.guess_cost(of, at, right, after, rates)
        assert list(zip(at.tolist(), right.tolist(), after.tolist())) == [w[:3] for w in want]
        assert np.allclose(cost, [w[3] for w in want])


def random_tree(rng, words=400):
    """A tree of all words of a small table, each with an entry for every kind in use; some codes are alike."""
    codes = np.sort(rng.integers(0, 1 << lm_words.DEPTH, words))
    codes[1::50] = codes[::50]
    used = np.array([0, 1, 2, 5])
    word, kind = np.repeat(np.arange(words), len(used)), np.tile(used, words)
    n = rng.integers(0, 5, len(word))
    n[:: len(used)] += 1
    top = np.zeros((lm_words.KINDS, 1 << lm_words.TOP))
    np.add.at(top, (kind, codes[word] >> lm_words.LOW), n)
    return lm_words.Tree(codes, word, kind, n, top), word, kind, n, top, codes


def test_known_words_sum_to_one():
    tree, word, kind, n, _top, _codes = random_tree(np.random.default_rng(3))
    mixer = lm_words.Mixer()
    tree.learn(mixer, n.astype(float))
    chance = 10.0 ** tree.score(mixer)
    for k in np.unique(kind):
        assert chance[kind == k].sum() == pytest.approx(1)


def test_tree_counts_plain():
    tree, word, kind, n, _top, codes = random_tree(np.random.default_rng(4), 150)
    checked = 0
    for level, at, bit, zeros, ones in tree.decisions():
        shift = lm_words.DEPTH - 1 - level
        for j, e in list(enumerate(at))[:: max(1, len(at) // 20)]:
            below = codes[word] >> shift
            mine = codes[word[e]] >> shift
            for c, same in enumerate((np.ones(len(kind), bool), (kind + 1) // 2 == (kind[e] + 1) // 2, kind == kind[e])):
                assert ones[c, j] == n[same & (below == (mine | 1))].sum()
                assert zeros[c, j] == n[same & (below == (mine & ~1))].sum()
            assert bit[j] == mine & 1
            checked += 1
    assert checked > 100


def test_alike_decisions_once():
    """Entries with the same kind, node and bit are one decision, and each entry's score is the sum of its own decisions."""
    rng = np.random.default_rng(9)
    codes = np.sort(rng.integers(0, 3 << lm_words.LOW, 300))
    codes[1::50] = codes[::50]
    word, kind = np.repeat(np.arange(300), 3), np.tile([0, 3, 4], 300)
    n = rng.integers(0, 5, len(word))
    top = np.zeros((lm_words.KINDS, 1 << lm_words.TOP))
    np.add.at(top, (kind, codes[word] >> lm_words.LOW), n)
    tree, mixer = lm_words.Tree(codes, word, kind, n, top), lm_words.Mixer()
    tree.learn(mixer, n.astype(float))
    want = np.zeros(len(word))
    for level, at, bit, zeros, ones in tree.decisions():
        node = codes[word] >> (lm_words.DEPTH - 1 - level)
        if level >= lm_words.TOP:
            made = list(zip(kind[at].tolist(), node[at].tolist()))
            assert len(set(made)) == len(made)
        else:
            node = codes[word] >> lm_words.LOW
        p = mixer.chance(level, zeros, ones)
        cost = dict(zip(zip(kind[at].tolist(), node[at].tolist()), np.log10(np.where(bit == 1, p, 1 - p)).tolist()))
        want += [cost.get(x, 0) for x in zip(kind.tolist(), node.tolist())]
    _codes, same, times = np.unique(codes, return_inverse=True, return_counts=True)
    assert np.allclose(tree.score(mixer), want - np.log10(times[same])[word])


def test_whole_groups():
    import pyarrow as pa

    rng = random.Random(5)
    group = sorted(rng.randrange(12) for _ in range(300))
    for size in (1, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(group[i : i + size])], names=["grp"]) for i in range(0, len(group), size)]
        made = [t.column("grp").to_pylist() for t in lm_words.whole_groups(iter(batches), 40)]
        assert sum(made, []) == group
        assert all(a[-1] != b[0] for a, b in zip(made, made[1:]))


def test_held_out_and_order(spark):
    """On the given texts the model leads the base, shuffled words cost more, and input splits change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(6)
    held = docs.where(language.held_out(F.col("doc_id"), 10, 0) & (F.length("text") > 200)).collect()
    moved = []
    for r in held:
        words = r.text.split()
        rng.shuffle(words)
        moved.append((-r.doc_id - 1, " ".join(words)))
    both = docs.unionByName(spark.createDataFrame(moved, docs.schema)).repartition(3)
    out = (F.col("doc_id") < 0) | language.held_out(F.col("doc_id"), 10, 0)
    one, other = ({r.doc_id: r for r in lm_mixing.score_documents(d, out).collect()} for d in (both, both.repartition(11, "doc_id")))
    assert one.keys() == other.keys()
    assert all(abs(r.score - other[i].score) < 1e-6 * abs(r.score) for i, r in one.items())
    plain = [r for i, r in one.items() if r.held_out and i >= 0]
    n = sum(r.n_tokens for r in plain)
    assert sum(r.score for r in plain) / n > sum(r.base_score for r in plain) / n + 0.1
    pairs = [(one[r.doc_id].score, one[-r.doc_id - 1].score) for r in held]
    assert sum(a for a, _ in pairs) > sum(b for _, b in pairs)
    assert sum(a > b for a, b in pairs) > 0.6 * len(pairs)


def test_long_and_repeating_text(docs):
    """A text that repeats itself is cheap although its words are unknown, and a long one is scored whole."""
    line = "these words were never met before "
    rows = [(i, "some known words", "en", "s") for i in range(1, 9)] + [(100 + i, line * 3, "en", "s") for i in range(3)]
    rows += [(1000, line * 5000, "en", "s"), (1001, "word" * 50_000, "en", "s")]
    got = {r.doc_id: r for r in lm_mixing.score_documents(docs(rows), F.col("doc_id") >= 1000).collect()}
    assert got[1000].n_tokens == 30_001 and got[1000].bits_per_byte < 0.05
    assert got[1001].n_tokens == 2 and got[1001].score < 0


def test_query(spark):
    """The registered query's contract columns against plain counting, on whole tables."""
    import math
    import re
    import zlib
    from collections import Counter

    from tideview.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower)), None] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op2_lm_mixing"](spark, sf)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert math.isfinite(r.score) and r.score < 0


def test_pairs_named(spark):
    """As many of the most frequent pairs are broadcast as may be, and all where they fit."""
    scored = spark.createDataFrame([(i, n) for i, n in enumerate([0, 0, 0, 1, 1, 2, 7, 7, 9])], "key long, n long")
    for most, least in ((9, 0), (8, 1), (6, 1), (5, 2), (3, 7), (2, 9)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm_mixing, "NAMED", most)
            assert lm_mixing.least_named(scored) == least


def test_counted_pairs(spark, docs):
    """A word's counts leave a task in one row, however many pieces of text it read, and add up to those of plain counting."""
    rows = [(i, f"a b word{i % 7} " * 40, "en", "s") for i in range(60)] + [(100, None, "en", "s")]
    table = docs(rows).coalesce(1)
    learned = F.col("doc_id") % 2 == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_mixing.pieces, "__defaults__", ("text", 500))
        made = lm_mixing.count_pairs(table, learned, {"a": 0, "b": 1})
    assert made.count() == made.select("word").distinct().count() == 10
    want = defaultdict(lambda: defaultdict(int))
    for i, t, _lang, _s in rows:
        kind = 0
        for j, w in enumerate([*(t or "").split(), "\n"]):
            want[w][kind] += i % 2 == 0
            kind = {"a": 2, "b": 4}.get(w, kind - 1 if kind and kind % 2 == 0 else kind)
    got = {r.word: r for r in lm_mixing.by_word(made, 1000).collect()}
    assert {w: {k % lm_words.KINDS: k // lm_words.KINDS for k in r.kinds} for w, r in got.items()} == want
    assert all(r.c == sum(want[w].values()) for w, r in got.items())


def test_words_of_one_hash(spark, docs):
    """Words are kept apart where their hashes are equal, and their numbers cross a task's edge as bytes."""
    import pyarrow as pa

    lists = pa.array([[5, 1 << 40], [], [7], [1, 2, 3]], pa.list_(pa.int64()))
    packed = lm_mixing._packed(lists)
    assert packed.type == pa.binary() and lm_mixing._unpacked(packed).equals(lists)
    assert lm_mixing._unpacked(packed.slice(1, 2)).to_pylist() == [[], [7]]
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(20)), "en", "s") for i in range(40)]
    made = lm_mixing.count_pairs(docs(rows).repartition(8), F.lit(True), {})
    assert dict(made.dtypes)["kinds"] == "binary"
    want = {r.word: (r.c, r.kinds) for r in lm_mixing.by_word(made, 800).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(F, "xxhash64", lambda *_c: F.lit(11).cast("long"))
        got = lm_mixing.by_word(made, 800).collect()
    assert {r.word: (r.c, r.kinds) for r in got} == want and len(got) == len(want) == 10


def test_rare_words_left_out(docs):
    """Words are left out where that cannot change the most frequent ones; else nothing is decided."""
    rng = random.Random(7)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(400)) for _ in range(30)]
    table = docs([(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5)
    whole = lm_mixing.count_words(table, F.lit(True))
    want = lm_mixing.frequent_words(whole, 0)
    assert len(want) == lm_words.NAMES
    for share, sure in ((200, False), (20_000, True)):
        part = lm_mixing.count_words(table, F.lit(True), share)
        r = part.where("word = '' AND kind = -1").first()
        assert r.n == sum(len(t.split()) + 1 for t in texts) and (r.least > 0) != sure
        got = lm_mixing.frequent_words(part, r.least)
        assert got == want or (not sure and got is None)


def test_names_and_joins_agree(docs):
    """Scores do not depend on which pairs are broadcast and which are joined."""
    rng = random.Random(8)
    table = docs([(i, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(50)), "en", "s") for i in range(40)])
    got = []
    for most in (0, 30, 1_000_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm_mixing, "NAMED", most)
            got.append({r.doc_id: r for r in lm_mixing.score_documents(table, F.col("doc_id") % 10 == 0).collect()})
    for other in got[1:]:
        assert all(o.score == pytest.approx(got[0][i].score) and o.n_known == got[0][i].n_known and o.base_score == pytest.approx(got[0][i].base_score) for i, o in other.items())
