"""Cutting, sharding and signing: plain versions, round trips, and the edges."""

import hashlib
import random
import zlib
from collections import Counter

import plain
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tideview.llm import fill_middle, merkle, sharding
from tideview.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"

TEXTS = [
    "one\ntwo\nthree\nfour", "one\ntwo\nthree\nfour", "", None, "\n\n\n", "no newline", "ends\n", "ünïcödé\nжук\n漢字\n\n😀 end",
    "has <S> inside\nand more", "almost <P <S S> <\nM>", "<\nP>\n", "a\r\nb\x0bc\x85d e\nf", "x" * 300_000 + "\n" + "ж\n" * 200_000,
]


def _rows(seed=1, n=60):
    """Documents with repeated ids, equal rows, nulls and empty texts."""
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(TEXTS[:12]), rnd.choice([None, "", "en", "ru", "é"]), rnd.choice([None, "web"])) for _ in range(n)]
    return rows + rows[:5]


# -- fill in the middle --------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (1, 1), (3, 70_000), (150_000, 70_001)])
def test_rotation_in_place(sizes):
    a, b = (random.Random(n).randbytes(n) for n in sizes)
    buffer = bytearray(b"<" + a + b + b">")
    fill_middle.rotate(buffer, 1, 1 + len(a), 1 + len(a) + len(b))
    assert buffer == b"<" + b + a + b">"


def test_cutting_equals_slicing(docs):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS * 6)] + [(None, TEXTS[0], None, None), (0, TEXTS[0], None, None)]
    made = fill_middle.restore(fill_middle.transform(docs(rows))).collect()
    want = Counter((i, *plain.fill_middle(i, t), t or "") for i, t, *_ in rows)
    assert Counter(tuple(r) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert {len(TEXTS[7]) >= r.prefix_chars >= 0 for r in made if r.prefix_chars is not None and r.restored == TEXTS[7]} == {True}


def test_rates_and_own_sentinels(docs):
    rows = [(i, f"a{i}\nb\nc <P>\n", None, None) for i in range(300)]
    marks = ("[pre]", "[suf]", "[mid]")
    made = fill_middle.restore(fill_middle.transform(docs(rows), percent=50, spm_percent=20, sentinels=marks), marks).collect()
    assert all(r.restored == f"a{r.doc_id}\nb\nc <P>\n" for r in made)
    forms = Counter(r.form for r in made)
    assert 110 < forms["plain"] < 190 and forms["psm"] > 2 * forms["spm"] > 0
    assert all(all(r.output.count(m) == 1 for m in marks) for r in made if r.form != "plain")


def test_cutting_with_clashing_columns_and_of_nothing(docs):
    few = docs([(1, "a\nb\n", None, None)]).withColumns({c: F.lit("other") for c in ("n", "form", "output", "restored", "prefix_chars")})
    assert [r.restored for r in fill_middle.restore(fill_middle.transform(few)).collect()] == ["a\nb\n"]
    assert fill_middle.restore(fill_middle.transform(docs([]))).count() == 0


# -- sharding ------------------------------------------------------------------------------


def _sharded(df, shards=8, block=sharding.BLOCK):
    text = F.coalesce("text", F.lit(""))
    return sharding.assign(df, F.unhex(F.md5(text)), sharding.text_size(F.col("text")), shards, block).collect()


def _held(rows, shards):
    """Loads by shard; slots have no gap and equal texts are together."""
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in rows:
        assert where.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    out = [0] * shards
    for r in rows:
        out[r["shard"]] += len((r["text"] or "").encode()) + 1
    return sorted(out)


def test_sharding_is_longest_first(docs):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(1, 200) + f" {i % 70}", None, None) for i in range(300)] + _rows()
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    made = _sharded(docs(rows))
    assert Counter((r.doc_id, r.text) for r in made) == Counter((i, t) for i, t, *_ in rows)
    assert _held(made, 8) == plain.loads(groups.values(), 8)


def test_sharding_in_blocks(docs):
    rnd = random.Random(4)
    rows = [(i, "y" * min(3000, int(5 * rnd.paretovariate(0.9))) + f" {i}", None, None) for i in range(4000)]
    made = _sharded(docs(rows), 8, block=2000)
    loads = _held(made, 8)
    assert len(made) == 4000 and loads[-1] - loads[0] <= 0.002 * sum(loads)


def test_sharding_with_a_hot_group_and_few_groups(docs):
    rows = [(i, "copy", None, None) for i in range(2000)] + [(i, f"text {i}", None, None) for i in range(3000)]
    loads = _held(_sharded(docs(rows), 8, block=1500), 8)
    assert loads[-1] == 2000 * 5  # more than a shard's share, so alone
    assert loads[-2] - loads[0] <= 0.01 * sum(loads)
    assert _held(_sharded(docs([(None, None, None, None), (1, "", None, None), (1, "a", None, None)]), 4), 4) == [0, 0, 2, 2]
    assert _sharded(docs([])) == []
    with pytest.raises(ValueError):
        _sharded(docs([]), 0)


def test_shards_as_files(spark, docs, folder):
    df = docs([(i, f"text {i % 9}", "en", None) for i in range(40)]).withColumns({"slot": F.lit("own"), "shard": F.lit(-1), "item": F.lit("x"), "size": F.lit("y")})
    sharding.write_shards(df, f"{folder}/shards", 3)
    back = spark.read.parquet(f"{folder}/shards")
    assert sorted(r.doc_id for r in back.collect()) == list(range(40))
    assert {(r.item, r.size, r.node) for r in back.collect()} == {("x", "y", "x")}
    _held(back.collect(), 3)


# -- signing -------------------------------------------------------------------------------


def _signed(df, levels=None):
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], tampered=hit, changes={"n_chars": F.col("n_chars") + 1})
    return [(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.found), r.folded_root) for r in made.withColumn("found", merkle.siblings()).collect()]


def _wanted(df):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    return Counter((*r[:4], tuple(r[4]), r[5]) for r in plain.merkle(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 0))


@pytest.mark.parametrize("levels", [12, 2, 1])
def test_manifest_is_plain_tree(docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    df = docs(_rows(n=75)).withColumns({c: F.lit("other") for c in ("tree", "place", "hash", "changed", "block", "total", "steps", "_row", "_part")})
    made = Counter(_signed(df))
    assert made == _wanted(df)
    assert any(r[3] != r[5] for r in made) and any(r[3] == r[5] for r in made)


def test_manifest_of_one_tree_and_many(docs, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    one = docs([(i, f"t{i}", "en", None) for i in range(33)])
    assert Counter(_signed(one)) == _wanted(one)
    many = docs([(i, f"t{i}", f"l{i % 21}", None) for i in range(50)])
    assert Counter(_signed(many)) == _wanted(many)


def test_manifest_of_one_row_and_none(docs):
    lone = docs([(None, None, None, None)])
    assert Counter(_signed(lone)) == _wanted(lone)
    (row,) = _signed(lone)
    assert row[1] == row[2] == row[3] == row[5] == hashlib.sha256(b"-----").hexdigest()
    assert _signed(docs([])) == []


def test_versions_share_nodes():
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(13)]
    tree = merkle.Tree(leaves, 4)
    before, root = list(tree.hash), tree.root
    other = tree.version(6, b"x")
    assert tree.hash[: len(before)] == before and tree.root == root
    assert len(tree.hash) - len(before) == 5  # the leaf and its ancestors
    again = tree.version(6, leaves[6], other)  # a version of a version
    assert tree.hash[again] == tree.hash[root] != tree.hash[other]
    assert merkle.climb(b"x", tree.steps(6)) == tree.hash[other]
    untouched = {i for _, i in tree.path(6)}
    assert untouched == {i for _, i in tree.path(6, other)} == {i for _, i in tree.path(6, again)}


# -- the queries ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_merkle"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_shard_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = QUERIES["op12_shards"](spark, SF).collect()
    rows = [r.asDict() | {"text": text[r.doc_id]} for r in made]
    groups = Counter()
    for t in text.values():
        groups[t or ""] += len((t or "").encode()) + 1
    assert len(made) == len(text) and _held(rows, 8) == plain.loads(groups.values(), 8)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), "bytes", None) for r in rows)
