"""The operators bound to the supplied tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import classifier, common, exact, lines, packing, periods, phrases, pii, quality, repair, simhash, substring, wavelet, wordtable


def documents(spark: SparkSession, folder: str) -> DataFrame:
    # Few rows per Arrow batch: rows hold whole texts or long arrays.
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_wavelet_tokens(spark, folder):
    return wavelet.round_trip(documents(spark, folder), common.word_tokenizer_path())


def op3_word_table_bpe(spark, folder):
    return wordtable.round_trip(documents(spark, folder), common.byte_tokenizer_path())


def op2_robust_outliers(spark, folder):
    return quality.judge(documents(spark, folder))


def op4_best_fit_packing(spark, folder):
    return packing.pack_documents(documents(spark, folder), common.word_tokenizer_path())


def op5_weak_supervision_pii(spark, folder):
    return pii.report(documents(spark, folder))


def op7_minimal_perfect_hash_dedup(spark, folder):
    return exact.dedup(documents(spark, folder))


def op9_anchor_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder))


def op6_interval_substrings(spark, folder):
    return substring.dedup(documents(spark, folder))


def op8_phrase_automata(spark, folder):
    return phrases.dedup(documents(spark, folder))


def op10_segment_line_join(spark, folder):
    return lines.dedup(documents(spark, folder))


def op11_periodic_runs(spark, folder):
    return periods.detect(documents(spark, folder), damaged=True)


def op12_conversation_repair(spark, folder):
    return repair.damage_and_repair(configure(spark).read.parquet(f"{folder}/conversations.parquet"))


def op13_hashed_gram_classifier(spark, folder):
    return classifier.classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


_ALL = [
    op1_wavelet_tokens,
    op2_robust_outliers,
    op3_word_table_bpe,
    op4_best_fit_packing,
    op5_weak_supervision_pii,
    op6_interval_substrings,
    op7_minimal_perfect_hash_dedup,
    op8_phrase_automata,
    op9_anchor_simhash,
    op10_segment_line_join,
    op11_periodic_runs,
    op12_conversation_repair,
    op13_hashed_gram_classifier,
]
LLM_QUERIES = {f.__name__: f for f in _ALL}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
LLM_ORACLE = {
    "op7_minimal_perfect_hash_dedup": f"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_NORMAL} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
}
