"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm import chat, decontamination, html_text, licences, media, mixing, ngram_join, quality, suffix_dedup, toxicity
from tideflow.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.encoded(table(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_chat_formatting,
        op3_suffix_array_dedup,
        op4_license_scans,
        op5_benchmark_decontamination,
        op6_mixing,
        op7_toxicity,
        op8_quality,
        op9_media_columns,
        op10_html_extraction,
    )
}


def _op2_sql() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for control in chat.CONTROLS:
            out = f"replace({out}, '{control}', '{chat.OPENERS[control[0]]}{control[1:]}')"
        return out

    marks = len(chat.START + chat.MESSAGE + chat.END)
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS lost,
        sum({marks} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS expanded_tokens
        FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars,
        0::BIGINT AS n_attachments, expanded_tokens FROM g"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.oracle(),
    "op2_chat_formatting": _op2_sql(),
    "op3_suffix_array_dedup": suffix_dedup.oracle(),
    "op4_license_scans": licences.oracle(),
    "op5_benchmark_decontamination": decontamination.oracle(),
    "op6_mixing": mixing.oracle(),
}
