"""Packing, personal data, urls, secrets, language, quality and scoring on small tables."""

import random
import re
import struct
import zlib

import pytest
from plain import base_spans
from pyspark.sql import functions as F

from tideview.llm import language, lm_mixing, packing, pii, quality, secrets, urls
from tideview.llm.queries import URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_packing_round_trip(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "OPEN", 3)
    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["The", "cat,", "don't", "\u0130stanbul.", "x1", "...", "na\u00efve", "<|endoftext|>"], k=rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "a b"), (102, "long " * 3000)]
    made = packing.pack(docs([(i, t, "en", "s") for i, t in rows]).repartition(5), tokenizer_path(), size=256).collect()
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    got = {}
    for r in sorted(made, key=lambda r: r.start):
        ids = [x[0] for x in struct.iter_unpack("<I", bytes(r.ids))]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id]) and len(got.setdefault(r.doc_id, [])) == r.start
        got[r.doc_id] += ids
    assert got == want
    windows = {}
    for r in made:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(map(len, want.values()))
    assert len(windows) * 256 <= total * 1.05 + 256


def test_words_in_any_case_are_encoded_once(monkeypatch):
    """Words of letters are the tokenizer's own ids in every case, and it sees each such word once."""
    import pyarrow as pa

    spans = [(0x41, 0x5B), (0x61, 0x7B), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x130), (0x131, 0x250), (0x400, 0x482)]
    letters = [chr(c) for a, z in spans for c in range(a, z)]
    texts = [f"{c} a{c}{c}b {c}." for c in letters] + ["hand Hand HAND HAND. hand, Hand!", "ÉTÉ été Été. Жук ЖУК жук"]
    encode = packing.Encoder(tokenizer_path(), 2)
    seen = []
    plain = encode._letters
    monkeypatch.setattr(encode, "_letters", lambda some: seen.extend(some) or plain(some))
    ids, at = encode(pa.array(texts))
    want = [e.ids for e in encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a : z - 1].tolist() for a, z in zip(at[:-1], at[1:])] == want
    assert seen.count("hand") == 1 and not {"Hand", "HAND", "ÉTÉ", "ЖУК"} & set(seen)


def test_packing_of_nothing(docs):
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


PII = [
    "mail a.b+c@x-y.co.uk, or a@b.cc_x@d.ee; 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 00001.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (555) 123-4567 +12 3 +1234567890123456",
    "\U0001f600 \u00e9 x@y.zz", None, "", "no data", "1" * 50000, "a" * 50000, "a@" + "b." * 20000 + "c", "+" + "1-" * 20000, "4111111111111111 4111111111111111",
]


def test_base_spans(docs):
    rows = docs([(i, t, "en", "s") for i, t in enumerate(PII)] + [(0, PII[0], "en", "s")])
    got = [(r.doc_id, r.s) for r in pii.base_spans(rows).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()]
    assert sorted(got) == sorted([(i, base_spans(t)) for i, t in enumerate(PII)] + [(0, base_spans(PII[0]))])


def test_learned_contexts(docs):
    """Tokens after a context that leads to mail addresses nearly always are believed; others are not."""
    rows = [(i, f"word{'x' * (i % 7)} write to user{'abcdefghij'[i]}@mail.org today", "en", "s") for i in range(10)]
    rows += [(20, "please write to user77-at-home today", "en", "s"), (21, "the part no. user88-at-home broke", "en", "s"), (None, "they write to user99-at-home too", "en", "s")]
    got = {r.doc_id: r.s for r in pii.find_pii(docs(rows)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got[20] == "email:16:30" and got[21] == "" and got[None] == "email:14:28"
    assert all(got[i] for i in range(10))


def test_redact(docs):
    rows = docs([(1, "mail a@b.cc now", "en", "s"), (2, None, "en", "s"), (3, "plain", "en", "s"), (4, "+4111111111111111 x@y.zz", "en", "s")])
    out = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert out[1].text == "mail <EMAIL> now" and out[1].n_chars == 16 and out[1].node == "x"
    assert out[2].text is None and out[3].text == "plain" and out[4].text == "+<CARD> <EMAIL>"


def plain_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = []
    for act, rule in URL_RULES:
        at, _, below = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + below):
            fits.append((len(rule), rule, act))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    some = ["http://A.Example.ORG/en/12?x", "https://example.org/es/", "x://b.com/fr/#a", "http://com/de/1", "http://bexample.org/en/1", "no scheme", None, "://", "a://h", "a://h?q/", "a://net/de/", "a://b.com:80/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(some)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.ruled) for r in urls.apply_rules(pages, URL_RULES).collect()}
    assert got == {i: plain_url(u) for i, u in enumerate(some)}
    for model in (1.0, 0.0):
        verdicts = {r.page_id: r.verdict for r in urls.judge(pages, URL_RULES, model).collect()}
        assert all(verdicts[i] == (plain_url(u)[3] or ("allow" if model else "block")) for i, u in enumerate(some))


def test_url_regression(spark):
    rng = random.Random(2)
    made = [(f"http://{'shop' if y == 0 else 'news'}{rng.randint(0, 999)}.net/{'buy' if y == 0 else 'read'}/{rng.randint(0, 99)}", y) for y in (0, 1) for _ in range(60)]
    rng.shuffle(made)
    model = urls.train(spark.createDataFrame(made[:80], "url string, allowed int"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made[80:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], model).collect()}
    assert sum(got[i] == ("allow" if y else "block") for i, (_, y) in enumerate(made[80:])) >= 38
    assert urls.train(spark.createDataFrame([("a://b", 1)], "url string, allowed int")) == 1.0
    assert urls.train(spark.createDataFrame([], "url string, allowed int")) == 1.0


def test_secrets(docs):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(i, f'text before token = "{key(40)}" and after', "en", "src") for i in range(40)]
    rows += [(100 + i, f"number {rng.randint(10**15, 10**16 - 1)} in plain text", "en", "src") for i in range(40)]
    rows += [(300, None, "en", None), (301, "", "en", "s"), (302, "nothing here", "en", "s")]
    found = secrets.candidates(docs(rows), ["text", "plain"])
    model = secrets.train(secrets.known_formats(found.where("doc_id % 2 = 0")))
    got = {r.doc_id for r in secrets.scan(found, model).collect()}
    assert got == set(range(40))
    assert secrets.scan(found, secrets.train(secrets.known_formats(found.limit(0)))).count() == 80


def test_codewords():
    for n in (2, 3, 5, 7, 8, 20):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert least >= code.shape[1] / 2


def test_language_held_out(spark):
    from tideview.llm.queries import QUERIES

    got = QUERIES["op9_language"](spark, SF.replace("0.001", "0.01"))
    truth = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_edges(docs):
    learn = docs([(1, "the cat sat on the mat", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "text", None, "s")])
    model = language.train(learn)
    rows = docs([(5, None, "en", "s"), (6, "", "en", "s"), (7, "123 ...", "en", "s"), (8, "the mat", "x", "s"), (None, "die katze " * 5000, "x", "s")])
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in language.identify(rows, model).collect()}
    assert got == {5: ("und", False), 6: ("und", False), 7: ("und", False), 8: ("en", True), None: ("de", True)}
    assert {r.lang_pred for r in language.identify(rows, language.train(learn.limit(0))).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality.train(docs, labels.where(learn))
    rows = quality.classify(docs.select("doc_id", "text"), model).join(quality.grades(labels.where(~learn)), "doc_id").collect()
    rate = {g: sum(r.selected for r in rows if r.grade == g) / sum(r.grade == g for r in rows) for g in (0, 1, 2)}
    assert rate[0] <= 0.05 and rate[1] <= 0.2 and rate[2] >= 0.95


def test_quality_edges(spark, docs):
    rows = docs([(1, None, "en", "s"), (2, "", "en", "s"), (3, "some words", "en", "s"), (None, "some words", "en", "s"), (3, "some words", "en", "s")])
    none = quality.train(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = quality.classify(rows, none)
    assert got.count() == 5 and got.where("selected AND expected_grade IS NULL").count() == 5
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality.train(rows, labels) is None
    model = quality.Ordinal(quality.np.zeros(1 << quality.BITS, "float32"), quality.np.array([-1.0, 0.5]))
    out = quality.classify(rows, model).collect()
    assert {(r.doc_id, r.tail_prob == 0) for r in out} == {(1, True), (2, True), (3, False), (None, False)}
    assert quality.classify(rows.limit(0), model).count() == 0


def plain_counts(rows, held):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["\n"]
    from collections import Counter

    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    return words, c


def test_scores(docs):
    import math

    rng = random.Random(6)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, " ".join(rng.choices(["The", "cat.", "sat", "on", "mats", "x" * 70, "\u00e9t\u00e9"], k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "the end"), (0, "unseen wordings here")]
    got = lm_mixing.score_documents(docs([(i, t, "en", "s") for i, t in rows]), language.held_out(F.col("doc_id"), 10, 0)).collect()
    words, c = plain_counts(rows, held)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one():
    """Over all first bytes, and all bytes after a beginning, the chances add up to one."""
    import numpy as np

    rng = np.random.default_rng(1)
    mixer = lm_mixing.Mixer([rng.integers(0, 9, (2, 1 << b)).astype(np.float32) for b in lm_mixing.TABLES])
    for start in (b"", b"ab"):
        coded = [start + bytes([x]) for x in range(256)]
        last = 10.0 ** mixer.score(lm_mixing.Path(coded, np.zeros(256, np.int64)))
        before = 10.0 ** mixer.score(lm_mixing.Path([start], np.zeros(1, np.int64)))[0] if start else 1.0
        assert last.sum() == pytest.approx(before, rel=1e-6)


def test_shared_beginnings_change_nothing():
    import numpy as np

    words = sorted(b"a" * i + c for i in range(0, 60, 7) for c in (b"b ", b"ba ", b"c "))
    mixer = lm_mixing.Mixer([np.random.default_rng(2).integers(0, 9, (2, 1 << b)).astype(np.float32) for b in lm_mixing.TABLES])
    kinds = np.arange(len(words)) % 2
    together = mixer.score(lm_mixing.Path(words, kinds))
    alone = [mixer.score(lm_mixing.Path([w], kinds[i : i + 1]))[0] for i, w in enumerate(words)]
    assert np.allclose(together, alone)


def test_scores_of_nothing(docs):
    assert lm_mixing.score_documents(docs([]), F.lit(False)).count() == 0


def test_pipeline(spark):
    """The stages keep what their operators decide, in turn."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        docs = kept.cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len({t for t in rows.values()}) == len(rows) and all(not base_spans(t) for t in rows.values())
    packed = cp.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_learned_in_generations(docs):
    """Values of a first context teach a second one, where names without digits stand; patterns after a value and spaced values count too."""
    rows = [(i, f"word write to user{'abcdefghij'[i % 10] * (1 + i // 10)}@mail.org today", "en", "s") for i in range(40)]
    mids = [f"member{'klmnopqrst'[i]}{i}0-home" for i in range(10)]
    rows += [(100 + i, f"please write to {m} today", "en", "s") for i, m in enumerate(mids)]
    rows += [(200 + i, f"badge holder {m} is known", "en", "s") for i, m in enumerate(mids)]
    rows += [(300, "badge holder Annabel is absent", "en", "s"), (301, "the Annabelle holder is known", "en", "s")]
    rows += [(400 + i, f"sent from user{'abcdefghij'[i % 10] * (1 + i // 10)}@mail.org at noon", "en", "s") for i in range(40)]
    rows += [(500, "sent from Mary (Ann) at noon", "en", "s"), (501, "it was Zoe-Lou, at noon", "en", "s"), (502, "the the the common words", "en", "s")]
    got = {r.doc_id: r.s for r in pii.find_pii(docs(rows)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got[100] == f"email:16:{16 + len(mids[0])}" and got[200] == f"email:13:{13 + len(mids[0])}"
    assert got[300] == "email:13:20" and got[301] == ""
    assert got[500] == "email:10:19" and got[501] == "email:7:14" and got[502] == ""
