"""Columns named like the stages' own come through unchanged."""

from pyspark.sql import functions as F

from tideview.llm import pii, quality


def test_redact_keeps_columns(docs):
    rows = docs([(1, "mail a@b.cc now", "en", "s"), (2, None, "en", "s"), (None, "plain", "en", "s")])
    rows = rows.select("*", F.lit("b").alias("base"), F.lit(7).alias("Spans"), F.lit(None).cast("int").alias("_base"), F.lit(1.5).alias("kind"))
    out = pii.redact(rows)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail <EMAIL> now" and got[None].text == "plain" and got[2].text is None
    assert all((r["base"], r["Spans"], r["_base"], r["kind"]) == ("b", 7, None, 1.5) for r in got.values())


def test_select_keeps_columns(docs):
    rows = docs([(1, "good words", "en", "s"), (2, None, "en", "s"), (None, "good words", "en", "s"), (1, "good words", "en", "s")])
    rows = rows.select("*", F.lit("no").alias("selected"), F.lit(3).alias("Tail_Prob"), F.lit(None).cast("string").alias("expected_grade"), F.lit(4).alias("_selected"))
    # every text with words has a tail probability above the limit, the null one has none
    model = quality.Ordinal(quality.np.zeros(1 << quality.BITS, "float32"), quality.np.array([-2.0, -1.0]))
    for fitted, n in ((None, 4), (model, 3)):
        out = quality.select(rows, fitted)
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        got = out.collect()
        assert len(got) == n
        assert all((r["selected"], r["Tail_Prob"], r["expected_grade"], r["_selected"]) == ("no", 3, None, 4) for r in got)
    assert quality.select(rows.limit(0), model).count() == 0
