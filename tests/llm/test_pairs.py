"""Jaccard join, components, decontamination and top-k against brute force."""

import random

import numpy as np
import pytest
from plain import link_classes

from tideview.llm import decontaminate as dc
from tideview.llm import jaccard_join as jj
from tideview.llm import topk
from tideview.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def mutated(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([3, 7, 40, 120]))
        out += [" ".join(mutated(rng, base, rng.choice([0, 0.01, 0.02, 0.05]))) for _ in range(rng.randint(1, 9))]
    passage = " ".join(rng.choices(WORDS, k=60))
    out += [passage + " " + " ".join(rng.choices(WORDS, k=rng.choice([1, 5, 20, 80]))) for _ in range(10)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


def check_join(docs, rows):
    got = jj.link_components(docs([(i, t, "en", "s") for i, t in rows])).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(link_classes(rows), key=key)


def test_join_is_brute_force(docs):
    check_join(docs, corpus(1))


def test_join_with_frequent_shingles_named(docs, monkeypatch):
    monkeypatch.setattr(jj, "REPEATS", 2)
    monkeypatch.setattr(jj, "COST", 1)
    monkeypatch.setattr(jj, "PARTNERS", 2)
    check_join(docs, corpus(2))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 16, 17, 300, 5000):
        for share in (0.0, 0.5, 0.85, 1.0):
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a = np.unique(np.append(both, rng.integers(0, 2**63, n - len(both) + 1, dtype=np.uint64)))
            b = np.unique(np.append(both, rng.integers(0, 2**63, 2 * (n - len(both)) + 1, dtype=np.uint64)))
            most = jj.most_shared(jj._sketch(a), jj._sketch(b), len(a), len(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    a, b = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in "ab")
    assert jj.most_shared(jj._sketch(a), jj._sketch(b), 2000, 2000) < 1000
    assert jj.most_shared(jj._sketch(a), jj._sketch(a[:1]), 2000, 1) == 1


def test_join_edges(docs):
    t = "a b c d e f g h"
    check_join(docs, [(5, t), (2, t.upper()), (2, t.upper()), (9, None), (8, ""), (7, " \t\n"), (4, "a b"), (3, "A  b"), (1, "a\u00a0b"), (None, "lone text of no one at all"), (6, "x " * 30000)])


def test_join_without_ids_and_with_one_id_for_many_texts(docs):
    """Each text meets its own node only: as many rows are compared as there are texts, not their square."""
    rng = random.Random(9)
    bases = [rng.choices(WORDS, k=60) for _ in range(60)]
    near = lambda: " ".join(mutated(rng, rng.choice(bases), 0.01))
    rows = [(None, near()) for _ in range(150)] + [(7, near()) for _ in range(150)] + [(8 + i, near()) for i in range(20)]
    check_join(docs, rows)
    frame = docs([(i, t, "en", "s") for i, t in rows]).selectExpr("doc_id", "xxhash64(text) AS tag").distinct()
    sizes = frame.alias("a").join(frame.alias("b"), jj._same_row("a", "b")).count()
    assert sizes == frame.count() == len(set(rows))


def test_join_with_passages_of_many_documents(docs):
    """Shingles of the same documents are one list; pairs that share several lists are still compared."""
    rng = random.Random(4)
    passages = [" ".join(rng.choices(WORDS, k=30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        some = rng.sample(passages, rng.randint(1, 5))
        texts += [" ".join([*some, *rng.choices(WORDS, k=rng.choice([0, 1, 4, 30]))])]
    check_join(docs, [(i + 1, t) for i, t in enumerate(texts + texts[:5])])


def test_join_of_nothing(docs):
    assert jj.link_components(docs([])).collect() == []


def test_keep_first(docs):
    t = "one two three four five six seven"
    rows = docs([(3, t, "en", "s"), (1, t, "en", "s"), (2, "other words", "en", "s"), (None, t, "en", "s"), (4, None, "en", "s")])
    kept = jj.keep_first(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (True, None)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_tables_are_written_to_few_files(spark, docs, monkeypatch):
    """What the join stores on a small corpus goes to a file or two, however many shuffle partitions there are; the links stay whole."""
    from tideview.llm import components as cc
    from tideview.llm import shared

    files = {}

    def kept(df, name, *more):
        out = shared.keep(df, name, *more)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jj, "keep", kept)
    monkeypatch.setattr(cc, "keep", kept)
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10], "a long, b long").coalesce(1)
        assert {r.node: r.root for r in components(links).collect()} == {i: i - (i - 1) % 10 for i in range(1, 301)}
        rows = corpus(4)
        made = docs([(i, t, "en", "s") for i, t in rows]).coalesce(1)
        got = jj.link_components(made).collect()
        assert sorted(tuple(r) for r in got) == sorted(link_classes(rows))
        assert jj.keep_first(made).count() == len({c for _, _, c in link_classes(rows)})
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)
    assert {"nodes", "met", "pairs", "open", "wanted", "links", "large-star", "small-star", "classes", "held", "gone"} <= set(files)
    assert max(n for each in files.values() for n in each) <= 2, files


def test_kept_tables_of_many_rows_have_many_files(spark):
    from tideview.llm.shared import keep

    made = keep(spark.range(0, 1000, 1, 30), "numbers", 1000, 100)
    assert len(made.inputFiles()) == 10 and made.count() == 1000
    assert len(keep(spark.range(0, 1000, 1, 30), "numbers").inputFiles()) == 30
    assert keep(spark.range(0), "numbers", 0).count() == 0


def plain_passages(rows, items, threshold=0.8):
    """Best similarity by (doc, item) over all windows of the item's size."""
    import re
    from collections import Counter

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def bag(w):
        return Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    out = {}
    for d, t in rows:
        w = words(t)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            n = min(len(v), len(w))
            own = bag(v)
            best = 0
            for p in range(len(w) - n + 1):
                b = bag(w[p : p + n])
                both = (b & own).total()
                best = max(best, both / (b.total() + own.total() - both))
            if best >= threshold:
                out[d, i] = best
    return out


def test_passages_are_brute_force(spark, docs):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(12, 40)))) for i in range(25)] + [(90, None), (91, " "), (92, "only three words")]
    rows = []
    for n in range(40):
        w = rng.choices(WORDS, k=rng.randint(0, 80))
        if n % 2:
            part = rng.choice(items[:25])[1].upper().split()
            if n % 3 == 0:
                part[rng.randrange(len(part))] = "changed"
            if n % 5 == 0:
                part = part[: len(part) - 2]
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((n, ", ".join(w)))
    rows += [(50, None), (51, ""), (52, "Only three words!"), (53, items[0][1])]
    found = dc.find_passages(docs([(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert got == plain_passages(rows, items)
    assert len(got) > 10


def test_votes_are_summed_for_words_in_windows_only(monkeypatch):
    """Marks of windows come out as from whole documents, though words outside of all windows are not summed up."""
    rng = random.Random(9)
    passage = rng.choices(WORDS, k=40)
    index = dc.Index([(7, " ".join(passage)), (8, " ".join(passage[:12]))], 0.8)
    far = lambda n: [f"far{rng.random()}" for _ in range(n)]
    texts = [far(3000) + passage + far(500) + passage[:12], far(800), passage[:36], passage[2:] + far(50)]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hashes = dc.names(dc.pa.array([w for t in texts for w in t]))
    summed = []
    monkeypatch.setattr(dc, "VOTED", 16)
    plain = dc.Index.votes
    monkeypatch.setattr(dc.Index, "votes", lambda self, h: summed.append(len(h)) or plain(self, h))
    found = {(d, i, p, n) for d, i, _s, p, n in index.matches(of, hashes)}
    assert found == {(0, 0, 3000, 40), (0, 1, 3000, 12), (2, 0, 0, 36), (2, 1, 0, 12), (3, 0, 0, 40)}
    assert sum(summed) < 400


def test_fingerprints_are_made_of_few_windows_at_once(monkeypatch):
    """However many windows a piece of text has, the same passages are found from small blocks of them."""
    rng = random.Random(10)
    passage = rng.choices(WORDS, k=40)
    index = dc.Index([(7, " ".join(passage)), (8, " ".join(passage[:12]))], 0.8)
    texts = [passage * 30, passage[:36], passage[2:] + ["far"] * 50]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hashes = dc.names(dc.pa.array([w for t in texts for w in t]))
    found = list(index.matches(of, hashes))
    made = []
    plain = dc.Index.fingerprints
    monkeypatch.setattr(dc, "MARKED", 16)
    monkeypatch.setattr(dc.Index, "fingerprints", staticmethod(lambda sums, a, z: made.append(len(a)) or plain(sums, a, z)))
    assert list(index.matches(of, hashes)) == found and len(found) >= 4
    assert max(made) == 16 and sum(made) > 1000


def test_no_passages(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_passages(docs([(1, "a b c", "en", "s")]), empty).count() == 0
    kept = dc.drop_contaminated(docs([(1, "a b c", "en", "s"), (None, "a b c", "en", "s")]), empty)
    assert kept.count() == 2 and "node" in kept.columns


def test_topk_is_brute_force(spark, monkeypatch):
    import math

    monkeypatch.setattr(topk, "BYTES", 8 * 24 * 50)  # several blocks of queries and of candidates
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(120)]
    rows += [(130 + i, rows[i][1]) for i in range(10)]
    rows += [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 24), (204, [float("inf")] * 24), (None, [1.0] * 24), (220, [2.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.whole_numbers(table)
    whole = {r.vec_id: list(r.v) for r in vectors.collect()}
    assert 220 in whole and not {200, 201, 202, 203, 204} & set(whole)
    assert all(whole[i] == [math.floor(64 * x) for x in r.embedding] for i, r in ((r.vec_id, r) for r in table.where("vec_id < 120").collect()))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 5).collect()}
    want = {}
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v) for v in whole if v != q)[:5]
            want |= {(q, n + 1): (v, -s) for n, (s, v) in enumerate(best)}
    assert got == want
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_with_repeated_ids(spark):
    """Vectors of one id are ranked each for itself and never match one another."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.25, 1.0]), (2, [0.25, 1.0])]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in topk.search(vectors, vectors.where("vec_id = 20"), 2).collect())
    assert got == [(20, 1, 1, 4096), (20, 1, 2, 4096), (20, 2, 2, 1024), (20, 2, 2, 4096)]


@pytest.mark.parametrize("scale", [1, 10**6])
def test_topk_prunes_groups_and_loses_nothing(scale):
    """On clustered vectors most pairs fall by their group or the coarse levels; doubles and whole numbers give the same."""
    rng = np.random.default_rng(5)
    centres = np.repeat(rng.normal(0, 40, (40, 8)), 8, axis=1)
    x = (np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 64))) * scale).astype(np.int64)
    ids = np.arange(4000)
    sample = x[:200] @ x[1000:2000].T  # thresholds as the search gives them
    best = topk.Best(ids[:200], x[:200], 10, np.sort(sample, axis=1)[:, -10].astype(float))
    for a in range(0, 4000, 1000):
        best.add(ids[a : a + 1000], x[a : a + 1000])
    assert best.tried == 800_000
    assert best.kept[1] < 0.5 * best.tried and best.kept[-1] < 0.2 * best.tried
    score = x[:200] @ x.T
    score[ids[:200], ids[:200]] = -(2**62)
    want = [(q, v, score[q, v]) for q in range(200) for v in np.lexsort((ids, -score[q]))[:10]]
    assert list(zip(*(c.tolist() for c in best.found))) == want


def test_keep_first_keeps_one_row_of_each_group(docs):
    """Copies of the first row go, nameless ones too, and no group goes whole because its id has another text."""
    t, near = (" ".join(WORDS[a : a + 60]) for a in (0, 1))
    lone, other = (" ".join(WORDS[a : a + 60]) for a in (100, 200))
    rows = [(1, t), (1, t), (1, t), (5, near), (5, lone), (6, lone), (None, other), (None, other), (None, other + " more"), (8, None), (8, None)]
    kept = [(r.doc_id, r.text) for r in jj.keep_first(docs([(i, x, "en", "s") for i, x in rows])).collect()]
    nameless = [x for i, x in kept if i is None]
    assert len(nameless) == 1 and nameless[0] in (other, other + " more")
    assert sorted((i, x or "") for i, x in kept if i is not None) == [(1, t), (5, lone), (8, ""), (8, "")]
    both = [(i, x) for i, x in [(2, t), (2, near), (2, t)]]
    assert jj.keep_first(docs([(i, x, "en", "s") for i, x in both])).count() == 1


def test_only_rows_with_passages_go(spark, docs):
    item = " ".join(WORDS[:30])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "before " + item), (1, "a clean text of the same id"), (2, "clean"), (None, item + " after"), (None, "nameless and clean"), (3, None), (None, None)]
    kept = dc.drop_contaminated(docs([(i, x, "en", "s") for i, x in rows]), items)
    assert "_mark" not in kept.columns and "node" in kept.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == [(0, ""), (0, "nameless and clean"), (1, "a clean text of the same id"), (2, "clean"), (3, "")]


def test_filters_leave_clashing_columns_alone(spark, docs):
    """Columns named like helper columns are neither ambiguous nor overwritten."""
    item = " ".join(WORDS[:30])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = " ".join(WORDS[50:90])
    rows = docs([(1, "before " + item, "en", "s"), (2, other, "en", "s"), (3, other, "en", "s"), (3, other, "en", "s")])
    rows = rows.selectExpr("*", "'a' AS _id", "'b' AS _of", "'c' AS _mark", "'d' AS __mark")
    for left, ids in ((dc.drop_contaminated(rows, items), [2, 3, 3]), (jj.keep_first(rows), [1, 2])):
        assert left.columns == rows.columns
        got = sorted(left.select("doc_id", "_id", "_of", "_mark", "__mark").collect())
        assert [tuple(r) for r in got] == [(i, "a", "b", "c", "d") for i in ids]
