"""The search for learned personal data: what is looked for, how often, and that a shuffle finds the same as a broadcast."""

from pyspark.sql import functions as F

from tideview.llm import pii

MIDS = [f"member{c}{i}0-home" for i, c in enumerate("klmnopqrst")]


def rows():
    """Addresses teach a first context, the names in it a second one; two of the values have several tokens or no digit."""
    users = [f"user{'abcdefghij'[i % 10] * (1 + i // 10)}@mail.org" for i in range(40)]
    out = [(i, f"word write to {u} today", "en", "s") for i, u in enumerate(users)]
    out += [(100 + i, f"please write to {m} today", "en", "s") for i, m in enumerate(MIDS)]
    out += [(200 + i, f"badge holder {m} is known", "en", "s") for i, m in enumerate(MIDS)]
    out += [(400 + i, f"sent from {u} at noon", "en", "s") for i, u in enumerate(users)]
    return out + [(300, "badge holder Annabel is absent", "en", "s"), (500, "sent from Mary (Ann) at noon", "en", "s"), (None, "badge holder Otto-90210 is absent", "en", "s"), (None, "sent", None, None), (501, None, "en", "s"), (502, "  ", "en", "s")]


def spans(table):
    return sorted((str(r.doc_id), r.s) for r in pii.find_pii(table).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect())


def test_each_value_and_pattern_is_looked_for_once(docs, monkeypatch):
    seen = {"pattern": [], "value": []}

    def noted(f, column):
        def run(texts, wanted, *more):
            seen[column] += [(texts.where("NOT seeded").count() > 0, r[0]) for r in wanted.select(column).collect()]
            return f(texts, wanted, *more)

        return run

    places, table = pii._places, docs(rows())
    monkeypatch.setattr(pii, "_places", noted(pii._places, "pattern"))
    monkeypatch.setattr(pii, "_where", noted(pii._where, "value"))
    marked = pii.base_spans(table).where("text IS NOT NULL")
    texts = pii.keep(marked.select("doc_id", F.xxhash64("text").alias("mark"), "base", F.col("text").alias("glued"), (F.size("base") > 0).alias("seeded")), "texts")
    seeds = texts.select(F.explode("base").alias("b")).select("b.value", "b.kind").distinct()
    assert pii.learned(texts, seeds) is not None and places is not pii._places
    for column, most in (("pattern", 1), ("value", 2)):  # a plain value is counted, and listed once it is believed
        everywhere = [x for whole, x in seen[column] if whole]
        assert everywhere and max(everywhere.count(x) for x in everywhere) <= most, column


def test_more_values_than_the_old_limit_do_not_deal_out_tokens(spark, docs):
    """300,000 values: only tokens that are among them cross a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        values = spark.range(300_000).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("value"))
        texts = docs([(1, "the (id-77) of the", "en", "s"), (2, "none id-300000", "en", "s")]).select("doc_id", F.lit(1).alias("mark"), F.col("text").alias("glued"))
        found = pii._where(texts, values)
        assert [(r.doc_id, r.i, r.value, r.before, r.held[0]) for r in found.collect()] == [(1, 1, "id-77", None, "id-77")]
        assert "BroadcastHashJoin" in found._jdf.queryExecution().optimizedPlan().toString() or "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffled_lookup_finds_the_same(docs, monkeypatch):
    table = docs(rows())
    want = spans(table)
    got = dict(want)
    assert got["300"] == "email:13:20" and got["500"] == "email:10:19" and ("None", "email:13:23") in want
    assert all(got[str(200 + i)] == f"email:13:{13 + len(m)}" for i, m in enumerate(MIDS))
    monkeypatch.setattr(pii, "small", lambda *a: False)
    assert spans(table) == want


def test_pipeline_stage_lists_a_pattern_twice_at_most(spark, docs, monkeypatch):
    """Once to learn and once to redact, however many turns there are; rows stay whole."""
    import corpus_pipeline

    seen, places = [], pii._places

    def noted(texts, wanted):
        seen.extend(r[0] for r in wanted.select("pattern").distinct().collect())
        return places(texts, wanted)

    monkeypatch.setattr(pii, "_places", noted)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.redact_personal(spark, docs(rows()), "").collect()]
    got = dict(out)
    assert len(out) == len(rows()) and got[300] == "badge holder <EMAIL> is absent" and got[205] == "badge holder <EMAIL> is known"
    assert (None, "badge holder <EMAIL> is absent") in out and got[501] is None and got[502] == "  "
    assert seen and max(seen.count(p) for p in seen) <= 2
