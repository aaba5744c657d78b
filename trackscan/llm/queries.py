"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.llm import (
    cover_tree,
    hard_negatives,
    html_text,
    lexical,
    line_dedup,
    mih,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    token_files,
    toxicity,
)
from trackscan.llm.common import table


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = line_dedup.deduplicated(docs, "sentence", least_words=1, least_run=20)
    return found.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        chars.alias("removed_chars"),
        F.array_join(
            F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ","
        ).alias("removed_spans"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


OP4_SQL = r"""
WITH split AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n.!?]+[.!?]*|[.!?]+|\n') AS parts
    FROM documents
), parts AS (
    SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM split
), units AS (
    SELECT doc_id, pos, part, a, unit, length(unit) - length(replace(unit, ' ', '')) + 1 AS words
    FROM (SELECT doc_id, pos, part,
                 (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos) - length(part))::BIGINT AS a,
                 trim(regexp_replace(lower(part), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS unit
          FROM parts)
), repeated AS (
    SELECT doc_id, pos, words, row_number() OVER (PARTITION BY unit ORDER BY doc_id, a) > 1 AS again
    FROM units WHERE unit <> ''
), runs AS (
    SELECT *, count(*) FILTER (NOT again) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM repeated
), gone AS (
    SELECT doc_id, pos FROM (
        SELECT *, sum(words) FILTER (again) OVER (PARTITION BY doc_id, run) AS total FROM runs)
    WHERE again AND total >= 20
), marked AS (
    SELECT u.*, g.pos IS NOT NULL AS gone FROM units u LEFT JOIN gone g USING (doc_id, pos)
)
SELECT d.doc_id, greatest(count(m.pos) FILTER (m.part <> chr(10)), (d.text IS NOT NULL)::INT)::BIGINT AS n_units,
       count(*) FILTER (m.gone) AS n_removed,
       coalesce(sum(length(m.part)) FILTER (m.gone), 0)::BIGINT AS removed_chars,
       coalesce(string_agg(a || '-' || (a + length(m.part)), ',' ORDER BY a) FILTER (m.gone), '')
           AS removed_spans,
       length(coalesce(string_agg(m.part, '' ORDER BY a) FILTER (NOT m.gone), ''))::BIGINT AS kept_chars,
       md5(coalesce(string_agg(m.part, '' ORDER BY a) FILTER (NOT m.gone), '')) AS kept_md5
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_text.extracted(pages).select("page_id", "title", "text")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = mih.sign_codes(table(spark, sf_dir, "embeddings"))
    return mih.top_k(codes, codes.filter(F.col("id") % 100 == 0), k=10)


OP2_SQL = """
WITH codes AS (
    SELECT vec_id AS id, embedding FROM embeddings
), near AS (
    SELECT q.id AS query_id, c.id,
           list_sum(list_transform(generate_series(1, 64),
               lambda i: ((q.embedding[i] > 0) <> (c.embedding[i] > 0))::BIGINT))::BIGINT AS distance
    FROM codes q JOIN codes c ON q.id % 100 = 0 AND q.id <> c.id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(table(spark, sf_dir, "documents"))
    return rows.withColumn("position", F.get("copies", F.lit(0))["position"]).select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    ).orderBy("position", "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.is_held_out().alias("held_out"), "score", "predicted"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scanned(docs, secrets.fit(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=20)


#: What is between terms, as the contract of op11 gives it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{TERM}') AS l
    FROM documents
), sized AS (
    SELECT r, doc_id, len(l)::BIGINT AS n FROM texts WHERE len(l) > 0
), total AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized
), postings AS (
    SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(l) AS term FROM texts) GROUP BY ALL
), asked AS (
    SELECT item_id, text, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, text, unnest(regexp_extract_all({_LOW}, '{TERM}')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), total
), scores AS (
    SELECT item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf)
           // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (r), total
    GROUP BY item_id, text, r, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id, text
                                 ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved))


OP12_SQL = """
WITH usable AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
           list_dot_product(a.x, c.x)::BIGINT AS score
    FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER near::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
     AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW near AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER near <= 5
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    spans = F.transform("offending", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        "score",
        "predicted",
        F.array_join(spans, ",").alias("offending_spans"),
    )


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_top_k": op2_top_k,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_cover_tree": op10_cover_tree,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}
SQL = {
    "op2_top_k": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
