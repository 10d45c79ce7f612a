"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from prosegauge.llm import chat_format, decontaminate, language_id, licences, media_columns, near_dedup, page_text, personal_data, piece_codec, quality_rules
from prosegauge.llm.common import held_out, table

#: Where the SentencePiece model lies.
PIECE_MODEL = os.environ.get("PIECE_MODEL", public_tokenizers.path("piece_bpe_32k.model"))


def op1_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_media(spark, sf_dir):
    return media_columns.features(media_columns.to_media(table(spark, sf_dir, "documents"))).drop("ok")


def op3_personal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = personal_data.train(personal_data.vote_counts(docs))
    found = personal_data.with_spans(docs, weights)
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in personal_data.BASE),
        F.sha2(personal_data.written(F.col("pii_base")), 256).alias("base_sha256"),
        personal_data.written(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


def op4_licences(spark, sf_dir):
    return licences.matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = quality_rules.scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_chat(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.formatted(rows.unionByName(extra)))


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~held_out())
    found = language_id.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_page_text(spark, sf_dir):
    return page_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_contamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_pieces(spark, sf_dir):
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), PIECE_MODEL)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_media": op2_media,
    "op3_personal": op3_personal,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_language": op7_language,
    "op8_page_text": op8_page_text,
    "op9_contamination": op9_contamination,
    "op10_pieces": op10_pieces,
}

#: op6's turns and masked text straight from the rows, without the template.
_OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS starts FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), written AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '<next/>', '\n'), '###', '\h') AS e,
    replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '<next/>', '\n'), '###', '\h'), ':', '\c') AS er
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + CASE WHEN starts = 1 THEN length(er) + 14 ELSE 7 END)::BIGINT AS formatted_chars,
  sum(starts)::BIGINT AS n_blocks
FROM written GROUP BY conv_id
"""

ORACLE_SQL = {"op4_licences": licences.oracle_sql(), "op6_chat": _OP6_SQL}
