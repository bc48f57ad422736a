"""Token counts as delta-maintained rollups.

A store keeps, per committed batch, a ledger (one row per document and tokenizer version that the batch touched, with its new
count) and the batch's additive deltas by source, language and tokenizer version. Totals are the sum of the
deltas of all batches. Batches have a sequence number of their own, in the order in which they were committed; a batch's id says
only whether it is there already. A batch that is there is left alone, one that was cut off is written anew, so committing again
never counts twice. A store has one writer at a time.

Changes: ``insert`` (a known document is revised by it), ``delete`` and ``revise`` (nothing happens for an unknown document).
Signed deltas come from joining the changes with the last known state. A document moves its whole
count when a change gives it another source or language.

Ledgers are written by bucket of the document's hash, and a commit reads the buckets that its changes fall into, no others; of these only rows of its
documents go on. Every ``COMPACT_AFTER`` runs (ledgers, and deltas beside them) of one level are merged into one of the next, so that
a commit meets a few runs of each level, a row is written anew once a level, and the number of levels grows with the logarithm of the number of batches.

Texts are counted where they are read (``counted``); only counts are joined and shuffled.

Defined cases: of several changes to one document and version in a batch the greatest (operation in the order delete, insert,
revise; then count, source, language) holds, so repeated rows count once; rows with a null id or version are left out; null
source or language is a group of its own; a null count is 0, and so is a null or empty text's; empty batches commit; other columns don't take part.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from . import tokens
from .storage import small_batches, stored

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Runs of a level that are merged into one of the next.
COMPACT_AFTER = 8


class RollupStore:
    """A store below ``path``, in a file system that driver and executors share. ``id_type``: Spark's type of the document ids.

    ``buckets``: so many that a bucket of the state is some hundred megabytes; a store keeps the number with which it began.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = 16):
        self.spark, self.path, self.id_type, self.buckets = spark, path.rstrip("/"), id_type, buckets
        self.ledger = f"doc_id {id_type}, tokenizer string, source string, lang string, n_tokens long, alive boolean, at long, bucket int"

    def _whole(self, kind: str) -> list[tuple[int, str, str]]:
        """(sequence number, rest of the name, path) of the finished folders of a kind, in order."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1], f"{self.path}/{kind}/{n}") for n in done)

    def batches(self) -> list[str]:
        """Ids of the committed batches in the order of commitment."""
        return [b for _, b, _ in self._whole("deltas")]

    def _runs(self, kind: str) -> list[tuple[int, int, str]]:
        """(first, last, path) of the runs that cover all committed batches, the widest where several begin alike."""
        committed = self._whole("deltas")
        single = {k: path for k, _, path in (committed if kind == "deltas" else self._whole(kind))}
        merged = {(first, int(last)): path for first, last, path in self._whole(f"merged-{kind}")}
        covering, after = [], 1
        while after <= len(committed):
            last = max((b for a, b in merged if a == after and b <= len(committed)), default=None)
            covering.append((after, last, merged[after, last]) if last else (after, after, single[after]))
            after = covering[-1][1] + 1
        return covering

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _rows(self, runs: list[str], buckets: list[int] | None = None) -> DataFrame:
        """All rows of ``runs``, of all buckets or some."""
        each = [self.spark.read.schema(self.ledger).parquet(run) for run in runs]  # each is partitioned by itself
        rows = reduce(DataFrame.unionByName, each)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "at", "bucket"), "at").alias("s"))
        return last.select("doc_id", "tokenizer", "s.*")

    def state(self) -> DataFrame:
        """The last row of each document and version that is still there."""
        runs = [path for _, _, path in self._runs("ledger")]
        rows = self._rows(runs) if runs else self.spark.createDataFrame([], self.ledger)
        return self._latest(rows).filter("alive").select("doc_id", "tokenizer", "source", "lang", "n_tokens")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _merge(self) -> None:
        """Merges the last ``COMPACT_AFTER`` runs of a level, and of the next, and so on."""
        n, width = len(self._whole("deltas")), COMPACT_AFTER
        while n and n % width == 0:
            first = n - width + 1
            name = f"{first:09d}-{n:09d}"
            ledgers = [path for a, _, path in self._runs("ledger") if a >= first]
            if len(ledgers) > 1:
                rows = self._latest(self._rows(ledgers))
                self._write(rows.filter("alive") if first == 1 else rows, f"{self.path}/merged-ledger/{name}")
            sums = [path for a, _, path in self._runs("deltas") if a >= first]
            if len(sums) > 1:
                self._summed(sums).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merged-deltas/{name}")
            width *= COMPACT_AFTER

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits ``changes`` (op, doc_id, tokenizer, source, lang, n_tokens) once. False: the batch was there already."""
        if not re.fullmatch(r"[\w.=-]+", batch_id):
            raise ValueError(f"a batch id is made of letters, digits and _ . = -, not {batch_id!r}")
        there = self._whole("deltas")
        if batch_id in (b for _, b, _ in there):
            return False
        self._merge()  # one that was cut off is made up for here
        number = len(there) + 1
        name = f"{number:09d}-{batch_id}"
        rank = F.when(F.col("op") == "delete", 0).when(F.col("op") == "insert", 1).when(F.col("op") == "revise", 2)
        row = F.struct(rank.alias("rank"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")
        asked = changes.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL").filter(rank.isNotNull()).groupBy(F.col("doc_id").cast(self.id_type).alias("doc_id"), "tokenizer").agg(F.max(row).alias("new"))
        runs = [path for _, _, path in self._runs("ledger")]
        if runs:
            asked = stored(asked.withColumn("bucket", self._bucket()), "rollup-changes")
            touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
            rows = self._rows(runs, touched if len(touched) < self.buckets else None).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
        else:
            asked, rows = asked.withColumn("bucket", self._bucket()), self.spark.createDataFrame([], self.ledger)
        known = self._latest(rows).filter("alive").select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("old"))
        met = asked.join(known, ["doc_id", "tokenizer"], "left").filter("new.rank = 1 OR old IS NOT NULL")
        keep = F.col("new.rank") > 0
        pick = lambda c: F.when(keep, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        old = lambda c: F.col(f"old.{c}").alias(f"old_{c}")
        full = met.select("doc_id", "tokenizer", pick("source"), pick("lang"), pick("n_tokens"), keep.alias("alive"), F.lit(number).cast("long").alias("at"), "bucket", F.col("old").isNotNull().alias("was"), old("source"), old("lang"), old("n_tokens"))
        self._write(full, f"{self.path}/ledger/{name}")
        done = self.spark.read.schema(full.schema).parquet(f"{self.path}/ledger/{name}")
        plus = done.filter("alive").select(*KEYS, F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
        minus = done.filter("was").select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", F.lit(-1).alias("d"), (-F.col("old_n_tokens")).alias("t"))
        summed = plus.unionByName(minus).groupBy(*KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("t").cast("long").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches, groups without documents left out."""
        paths = [path for _, _, path in self._runs("deltas")]
        return self._summed(paths) if paths else self.spark.createDataFrame([], DELTAS)

    def _summed(self, paths: list[str]) -> DataFrame:
        every = self.spark.read.schema(DELTAS).parquet(*paths)
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")


def counted(docs: DataFrame, tokenizers: dict[str, str], without: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every whole text under each tokenizer (version name -> file).

    ``without`` (name -> pattern) adds a column n_<name>: the count of the text without what the pattern (for ``re``, on strings) finds.
    """
    small_batches(docs.sparkSession)
    others = {name: re.compile(pattern) for name, pattern in (without or {}).items()}

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(3)):
                n_texts = len(part.starts)
                own = batch.slice(part.first, n_texts)
                cut = {}  # per name: numbers of the texts that change, and these
                for name, pattern in others.items():
                    texts = [(k, new) for k, old in enumerate(own.column(3).to_pylist()) if old for new, found in [pattern.subn("", old)] if found]
                    cut[name] = [k for k, _ in texts], pa.array([t for _, t in texts], pa.string())
                for version, path in tokenizers.items():
                    model = tokens.opened(path)
                    n = model.counts(part)
                    more = []
                    for at, texts in cut.values():
                        changed = n.copy()
                        changed[at] = np.concatenate([np.zeros(0, np.int64), *[model.counts(p) for p in bw.text_slices(texts)]])
                        more.append(pa.array(changed, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([version] * n_texts, pa.string()), pa.array(n, pa.int64()), *more], names)

    names = ["doc_id", "source", "lang", "tokenizer", "n_tokens", *[f"n_{name}" for name in others]]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokenizer string, " + ", ".join(f"{n} long" for n in names[4:]))


def insertions(counts: DataFrame, op: str = "insert", count_col: str = "n_tokens") -> DataFrame:
    """``counted`` rows as changes of one kind."""
    return counts.select(F.lit(op).alias("op"), "doc_id", "tokenizer", "source", "lang", F.col(count_col).alias("n_tokens"))
