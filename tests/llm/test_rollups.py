"""A store of several levels: what a commit reads, what is left after a cut-off merge."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from reciprospark.llm import rollups

CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"


def test_a_small_commit_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "COMPACT_AFTER", 3)
    store = rollups.RollupStore(spark, str(tmp_path / "r"), buckets=64)
    every = spark.range(2000).select(F.lit("insert").alias("op"), F.col("id").alias("doc_id"), F.lit("t").alias("tokenizer"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(2).cast("long").alias("n_tokens"))
    assert store.commit("all", every)
    seen = []
    rows = rollups.RollupStore._rows

    def watched(self, runs, buckets=None):
        found = rows(self, runs, buckets)
        seen.append(found.count())
        return found

    monkeypatch.setattr(rollups.RollupStore, "_rows", watched)
    assert store.commit("few", every.filter("doc_id % 400 = 7").withColumn("op", F.lit("delete")))
    assert 0 < seen[0] < 400
    total = store.totals().first()
    assert (total.n_docs, total.n_tokens) == (1995, 3990)


def test_levels_and_a_merge_that_was_cut_off(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "COMPACT_AFTER", 2)
    store, path = rollups.RollupStore(spark, str(tmp_path / "r"), buckets=4), Path(tmp_path / "r")
    row = lambda op, i, n: spark.createDataFrame([(op, i, "t", "s", "en", n)], CHANGES)
    alive = {}
    for k in range(9):
        assert store.commit(f"b{k}", row("delete" if k == 6 else "insert", k % 4, k))
        alive[k % 4] = None if k == 6 else k
        if k == 4:  # its marker is gone, so it doesn't count and is made again
            (path / "merged-ledger" / "000000001-000000004" / "_SUCCESS").unlink()
        assert {r.doc_id: r.n_tokens for r in store.state().collect()} == {i: n for i, n in alive.items() if n is not None}
        total = store.totals().first()
        assert (total.n_docs, total.n_tokens) == (len([n for n in alive.values() if n is not None]), sum(n or 0 for n in alive.values()))
    assert [(a, b) for a, b, _ in store._runs("ledger")] == [(1, 8), (9, 9)] == [(a, b) for a, b, _ in store._runs("deltas")]
    shutil.rmtree(path / "merged-ledger")
    assert {r.doc_id for r in store.state().collect()} == {i for i, n in alive.items() if n is not None} and len(store.batches()) == 9
