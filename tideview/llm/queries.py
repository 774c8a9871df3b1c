"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents: (doc_id, item_id, similarity, first_word, n_words)."""
    from tideview.llm.decontaminate import find_passages

    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_lm_mixing")
def lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.language import held_out
    from tideview.llm.lm_mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


@query("op3_pack")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.packing import pack as packed

    made = packed(table(spark, sf_dir, "documents"), tokenizer_path())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.jaccard_join import link_components

    return link_components(table(spark, sf_dir, "documents"))


#: The url rules that the query applies.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op5_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are those that a rule decides."""
    from tideview.llm.urls import apply_rules, judge, train

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = apply_rules(pages, URL_RULES).where("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").cast("int").alias("allowed"))
    return judge(pages, URL_RULES, train(labelled))


@query("op6_topk")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.topk import search, whole_numbers

    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op7_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.pii import KINDS, find_pii, listed

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base.kind", lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op8_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled findings are those whose format is certain, in four fifths of the documents."""
    from tideview.llm.secrets import candidates, frequent_words, known_formats, scan, train
    from tideview.llm.shared import keep

    docs = table(spark, sf_dir, "documents")
    found = keep(candidates(docs, frequent_words(docs)), "candidates")
    model = train(known_formats(found.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 0)))
    return scan(found, model).select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability")


@query("op9_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.language import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    made = identify(docs, train(docs.where(~out)))
    return made.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, the probability of the best grade, and the decision."""
    from tideview.llm.quality import classify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def _draw(i: int) -> str:
    return f"('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {8 * i - 7}, 8))::UBIGINT"


@query(
    "op11_fill_middle",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
    h AS (SELECT *, len(u) AS n, {_draw(1)} % (len(u) + 1) AS a, {_draw(2)} % (len(u) + 1) AS b, {_draw(3)} % 100 AS c, {_draw(4)} % 100 AS e FROM d),
    f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain' WHEN e < 50 THEN 'spm' ELSE 'psm' END AS form,
                 array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM f
    """,
)
def fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideview.llm.fill_middle import restore, transform

    made = restore(transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes, equal texts together; a null text counts as an empty one."""
    from tideview.llm.sharding import assign, text_size

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("mark"))
    made = assign(docs, F.col("mark"), F.col("size"), 8)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _field(c: str, text: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({text})::VARCHAR || ':' || {text} END"


def _leaf(n_chars: str) -> str:
    each = [("doc_id", "doc_id::VARCHAR"), ("source", "source"), ("lang", "lang"), ("n_chars", f"({n_chars})::VARCHAR"), ("text", "text")]
    return f"sha256({' || '.join(_field(*x) for x in each)})"


#: DuckDB has no crc32: eight shifts for each character of the id.
_ID_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


@query(
    "op13_merkle",
    f"""
    WITH RECURSIVE
    leaves AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
        FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_ID_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS other FROM documents)),
    tree(lang, lv, i, h, n) AS (
        SELECT lang, 0::BIGINT, i, leaf, n FROM leaves
        UNION ALL
        SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lv, i // 2),
    nodes AS MATERIALIZED (SELECT * FROM tree),
    subroots AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS m FROM nodes WHERE n = 1),
    top(lv, i, h, n) AS (
        SELECT 0::BIGINT, k, subroot, m FROM subroots
        UNION ALL
        SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, i // 2),
    tops AS MATERIALIZED (SELECT * FROM top),
    fold(r, lang, lv, i, h, n) AS (
        SELECT r, lang, 0::BIGINT, i, other, n FROM leaves
        UNION ALL
        SELECT f.r, f.lang, f.lv + 1, f.i // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), (f.n + 1) // 2
        FROM fold f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lv = f.lv AND s.i = xor(f.i, 1) WHERE f.n > 1),
    folded(r, lv, i, h, n) AS (
        SELECT f.r, 0::BIGINT, s.k, f.h, s.m FROM fold f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
        UNION ALL
        SELECT f.r, f.lv + 1, f.i // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), (f.n + 1) // 2
        FROM folded f LEFT JOIN tops s ON s.lv = f.lv AND s.i = xor(f.i, 1) WHERE f.n > 1),
    proof AS (
        SELECT r, string_agg(h, '' ORDER BY part, lv) AS p FROM (
            SELECT l.r, 0 AS part, t.lv, t.h FROM leaves l JOIN nodes t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = xor(l.i >> t.lv::INTEGER, 1)
            UNION ALL
            SELECT l.r, 1, t.lv, t.h FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.i = xor(s.k >> t.lv::INTEGER, 1))
        GROUP BY r)
    SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.n = 1 JOIN folded f ON f.r = l.r AND f.n = 1 LEFT JOIN proof p ON p.r = l.r
    """,
)
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; adding 1 to n_chars tampers with those whose id's crc32 7 divides."""
    from tideview.llm.merkle import manifest, siblings

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = manifest(docs, docs.columns, tampered=hit, changes={"n_chars": F.col("n_chars") + 1})
    proof = F.sha2(F.array_join(siblings(), ""), 256)
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
