"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, conversations, decontaminate, minhash, ngram_join, quality, rollups, rules, spm, toxicity, urls, warc, whitening
from .storage import shared_dir, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-ids")
    binary.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    n_bytes = F.octet_length("ids")
    return binary.read_ids(spark, path).select("doc_id", "start", (n_bytes / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter; those labelled toxic are deleted; those labelled low quality are counted again without symbols;
    the last two batches are committed once more, which changes nothing."""
    labels, store = _table(spark, sf_dir, "labels"), rollups.RollupStore(spark, shared_dir(spark, "rollups"))
    # every text is counted once, with and without its symbols; from here on only counts move
    counts = stored(rollups.counted(_table(spark, sf_dir, "documents"), {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json")}, without={"cleaned": rules.SYMBOLS}), "token-counts")
    of = lambda condition: counts.join(labels.filter(condition).select("doc_id"), "doc_id", "left_semi")
    store.commit("1-all", rollups.insertions(counts))
    later = {"2-toxic": rollups.insertions(of("toxic = 1"), op="delete"), "3-cleaned": rollups.insertions(of("quality = 0"), op="revise", count_col="n_cleaned")}
    for batch_id in ("2-toxic", "3-cleaned", "2-toxic", "3-cleaned"):
        store.commit(batch_id, later[batch_id])
    return store.totals()


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), lambda i: _remainder(i, 3) == 1
    vectors = quality.word_vectors(docs)
    network = quality.fitted(docs, _table(spark, sf_dir, "labels"), vectors, trains=lambda i: ~held(i))
    return quality.scores(docs, vectors, network).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = _table(spark, sf_dir, "pages"), shared_dir(spark, "warc")
    warc.write_archive(pages, path)
    return warc.payload_report(warc.captures(warc.digested(warc.read_records(spark, path)), pages.schema["page_id"].dataType.simpleString()))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(spm.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), lambda i: _remainder(i, 5) == 0
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"), trains=lambda i: ~held(i))
    return toxicity.scores(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damaged(rows))
    return conversations.report(fixed, rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, len(lines) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols,
       cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0 AND n_symbols / greatest(n_words, 1) <= 0.10
       AND bangs / greatest(n_words, 1) <= 0.30 AND stops / greatest(n_words, 1) >= 0.04
       AND n_dup_lines / greatest(n_lines, 1) <= 0.50 AS kept
FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_binary": op3_token_binary,
    "op4_token_rollups": op4_token_rollups,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_warc_transactions": op7_warc_transactions,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_join": op11_ngram_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": OP10_SQL,
}
