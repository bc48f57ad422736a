"""Defined cases of the operators that read whole texts: null ids, repeated rows, long texts, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reciprospark.llm import binary, decontaminate, rules, spm, tokens

from .test_operators import docs

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("id", "ids", "part", "doc", "item", "start", "decoded", "n_tokens", "kept", "row", "words", "score", "chunk")


def clashing(table):
    return table.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in table.columns])


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    long = "long text é " * 30_000
    rows = [(5, "b"), (None, "first"), (5, "b"), (2, None), (5, "other"), (7, long), (None, None)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    binary.write_ids(table, str(tmp_path / "t"), BYTE, 2)
    got = sorted((r.start, r.doc_id, zlib.crc32(r.ids), len(r.ids) // 4) for r in binary.read_ids(spark, str(tmp_path / "t")).collect())
    library = tokens.opened(BYTE).library
    own = {(i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, t in rows for ids in [library.encode(t or "").ids + [2]]}
    assert [g[1] for g in got] == [None, None, 2, 5, 5, 5, 7] and {g[1:] for g in got} == own
    assert [g[0] for g in got] == [0, *np.cumsum([g[3] for g in got]).tolist()[:-1]]
    with pytest.raises(TypeError):
        binary.write_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "s"), BYTE, 2)


def test_encoding_of_repeated_rows_and_empty_tables(spark):
    long = "wörd " * 40_000
    table = clashing(spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, long), ("b", None)], "name string, text string"))
    found = spm.digests(spm.encode_decode(table, PIECE, id_col="name"), id_col="name")
    library = spm.opened(PIECE).library
    got = sorted((str(r.name), r.n_tokens, r.decoded_sha256) for r in found.collect())
    assert got == sorted((str(n), len(library.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for n, t in [("a", "x y"), ("a", "x y"), (None, long), ("b", None)])
    assert spm.encode_decode(table.filter("false"), PIECE, id_col="name").count() == 0


def test_leaks_of_repeated_rows_and_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(30)) + ". " + " ".join(f"a{i}" for i in range(8)) + "."
    filler = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, f"{filler} {item} {filler}"), (2, filler), (1, f"{filler} {item} {filler}"), (None, item), (3, None), (4, "")]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clashing(spark.createDataFrame([(9, item), (9, item), (10, None)], "item_id long, text string"))
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, items).collect()]
    assert {*got} == {(1, 9), (None, 9)} and got.count((1, 9)) == 4
    kept = decontaminate.drop_leaking(table, items)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.drop_leaking(table.filter("false"), items).count() == 0


def test_rules_on_repeated_rows_and_clashing_columns(spark):
    good = " ".join(f"the river{i} of" for i in range(40))
    table = clashing(spark.createDataFrame([(1, good), (1, good), (None, good), (2, None), (3, good * 2000)], "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in rules.quality_rules(table).collect())
    assert got[:2] == [("1", 120, True)] * 2 and ("None", 120, True) in got and ("2", 0, False) in got
    kept = rules.keep_good(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_every_stage_on_empty_tables_and_odd_rows(spark, tmp_path):
    good = " ".join(f"the river{i} of" for i in range(40))
    rows = [(1, good, "en", None, 5), (1, good, "en", None, 5), (None, good + " end", None, "s", None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for own, ids in ((table, {"quality rules": ["1", "1", "None"], "near-duplicates": ["1", "2", "3", "None"]}.get(name, ["1", "1", "2", "3", "None"])), (table.filter("false"), [])):
            found = stage(spark, own, str(tmp_path))
            assert found.columns == table.columns and sorted(str(r.doc_id) for r in found.collect()) == ids, name
    last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert last.columns == ["doc_id", "ids", "decoded"] and last.count() == 5


def test_every_text_query_runs_on_the_smallest_tables(spark):
    from reciprospark.llm import queries

    for name in ("op2_url_filter", "op4_token_rollups", "op7_warc_transactions", "op10_quality_rules"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_text_sql_agrees_with_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from reciprospark.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        rel = con.execute(sql)
        columns = sorted(d[0] for d in rel.description)
        want = sorted(str([dict(zip([d[0] for d in rel.description], r))[c] for c in columns]) for r in rel.fetchall())
        got = sorted(str([r[c] for c in columns]) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
        assert got == want
