"""Id columns whose names an operator uses itself, with repeated, null and text ids, through every operator and stage that reads texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reciprospark.llm import binary, decontaminate, minhash, ngram_join, quality, rules, spm, toxicity, urls, warc

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
NAMES = ("id", "kept", "score", "ids", "n_tokens", "gone", "text_", "n_shingles", "component_id", "doc", "other_id", "item_id")
GOOD = " ".join(f"the river{i} of" for i in range(40))
ROWS = [("a", GOOD), ("a", GOOD), ("b", GOOD + " end"), (None, "alone"), (None, None), ("c", ""), ("d", "some words")]


def table_of(spark, name, clash=True):
    table = spark.createDataFrame(ROWS, f"`{name}` string, text string")
    return table.select("*", *[F.lit(1).alias(c) for c in NAMES if c != name]) if clash else table


@pytest.mark.parametrize("name", ["id", "kept", "n_shingles", "other_id"])
def test_near_duplicates(spark, name):
    table = table_of(spark, name)
    kept = minhash.drop_copies(table, id_col=name)
    assert kept.columns == table.columns and sorted(str(r[name]) for r in kept.collect()) == ["None", "None", "a", "c", "d"]
    found = minhash.near_duplicates(table, id_col=name)
    assert len(set(found.columns)) == 4 and sorted((str(r[0]), str(r[2])) for r in found.collect())[2:5] == [("a", "a"), ("a", "a"), ("b", "a")]


@pytest.mark.parametrize("name", ["id", "ids", "n_tokens", "decoded"])
def test_encoding(spark, name):
    found = spm.encode_decode(table_of(spark, name), PIECE, id_col=name)
    digests = spm.digests(found, id_col=name)
    assert len(set(found.columns)) == 3 and len(set(digests.columns)) == 4
    assert sorted(str(r[0]) for r in digests.collect()) == ["None", "None", "a", "a", "b", "c", "d"]


@pytest.mark.parametrize("name", ["score", "item_id", "doc"])
def test_leaks(spark, name):
    item = " ".join(f"q{i}" for i in range(30)) + ". " + " ".join(f"a{i}" for i in range(8)) + "."
    table = table_of(spark, name).unionByName(spark.createDataFrame([("leak", item)], f"`{name}` string, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([("i1", item), ("i2", None)], "item_id string, text string")
    found = decontaminate.find_leaks(table, items, id_col=name)
    assert len(set(found.columns)) == 5 and [tuple(r[:2]) for r in found.collect()] == [("leak", "i1")]
    assert sorted(str(r[name]) for r in decontaminate.drop_leaking(table, items).collect()) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", ["kept", "id", "text_"])
def test_rules_and_classifiers(spark, name):
    table = table_of(spark, name)
    judged = rules.quality_rules(table, **({"id_col": name} if "id_col" in rules.quality_rules.__code__.co_varnames else {}))
    assert len(set(judged.columns)) == len(judged.columns) and judged.count() == 7
    assert rules.keep_good(table).columns == table.columns
    labels = spark.createDataFrame([("a", 1), ("d", 0), ("c", 0)], f"`{name}` string, label int")
    model = toxicity.fitted(table.select(F.col(name).alias("doc_id"), "text"), labels.select(F.col(name).alias("doc_id"), F.col("label").alias("toxic")), trains=lambda i: i.isNotNull())
    scored = toxicity.scores(table.select(F.col(name).alias("doc_id"), "text"), model)
    assert scored.count() == 7 and scored.filter("score IS NULL").count() == 0


def test_token_files_of_repeated_ids_keep_their_order(spark, tmp_path):
    rows = [(3, t) for t in ("b", "a", "c c", "a")] + [(None, f"null {i}") for i in range(40)] + [(1, None)]
    wants = None
    for k, order in enumerate((rows, rows[::-1])):
        table = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        binary.write_ids(table, str(tmp_path / str(k)), BYTE, 2)
        got = sorted((r.start, r.doc_id, zlib.crc32(r.ids), len(r.ids) // 4) for r in binary.read_ids(spark, str(tmp_path / str(k))).collect())
        assert [g[1] for g in got] == [None] * 40 + [1, 3, 3, 3, 3] and [g[0] for g in got] == [0, *np.cumsum([g[3] for g in got]).tolist()[:-1]]
        wants = wants or got
        assert got == wants
    assert len({r.part for r in spark.read.parquet(str(tmp_path / "0")).filter("part < 0").collect()}) > 1


def test_archives_with_text_ids(spark, tmp_path):
    html = "x" * 1200
    pages = spark.createDataFrame([("p1", "http://a.b/", html), ("p2", "http://a.b/2", html), ("p3", None, None), (None, "u", "v")], "page_id string, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    for own in (records, warc.digested(records)):
        got = {tuple(r) for r in warc.payload_report(warc.captures(own, "string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()}
        assert got == {("p1", 1200, "revisit", "p2"), ("p2", 1200, "response", None), ("p3", 0, "response", None)}
    assert [r.page_id for r in warc.captures(records).collect()] == [None] * 3


def test_stages_with_clashing_names(spark, tmp_path):
    rows = [(1, GOOD), (1, GOOD), (2, GOOD + " end"), (3, "short")]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in NAMES])
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns, name
    assert [r.doc_id for r in docs.collect()] == [1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 1
