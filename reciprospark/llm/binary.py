"""Token-id files: fixed-size id blocks, transposed to byte or bit planes, each plane under zstandard, with a chunk index.

A file set is a Parquet table with one row per chunk, so that any store Spark writes to can hold it. A chunk
has up to ``BLOCK`` ids of one part; parts hold ascending ranges of document ids. The index columns say which documents,
or pieces of them, lie where in the chunk, and where each document starts in its part.

Documents are encoded where they are read; the ids, as 2 or 4 bytes each, are dealt out by part and sorted there,
with the bounds of the parts taken from the id column alone. Chunks decode independently; only documents that
lie in several chunks are put together again by a shuffle.

Defined cases: ids are integers (others raise an error, for files are in the order of ids); a null or empty text has the end id alone; documents with
a null id come first; repeated rows and rows that share an id are written each, one after another; a text of any length is written whole, over as many chunks as it needs; an empty table
gives an empty file set; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from . import tokens
from .storage import small_batches

BLOCK = 1 << 16
LEVEL = 3
CHUNK_SCHEMA = "part int, chunk int, first long, n_ids int, width int, plane_kind string, payload binary, plane_ends array<int>, doc_ids array<long>, piece_at array<int>, piece_n array<int>, doc_first array<long>, doc_n array<long>"


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """The block's byte planes (least byte first) or bit planes (lowest bit of the least byte first), uncompressed."""
    planes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    if kind == "byte":
        return [p.tobytes() for p in planes]
    return [np.packbits((p >> bit) & 1, bitorder="little").tobytes() for p in planes for bit in range(8)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    """The ids of ``to_planes`` as unsigned 32-bit integers."""
    if kind == "byte":
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        rows = [sum((bits[8 * b + k] << k for k in range(8)), np.zeros(n, np.uint8)) for b in range(width)]
    return np.ascontiguousarray(np.stack(rows, 1)).view(f"<u{width}").ravel().astype("<u4")


class _Part:
    """Collects the documents of one part and cuts them into chunks."""

    def __init__(self, number: int, width: int, kind: str, block: int):
        self.number, self.width, self.kind, self.block = number, width, kind, block
        self.chunk, self.first, self.at, self.held, self.pieces = 0, 0, 0, [], []
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id, ids: np.ndarray):
        start, done = self.first + self.at, 0
        while done < len(ids):
            n = min(len(ids) - done, self.block - self.at)
            self.held.append(ids[done : done + n])
            self.pieces.append((doc_id, self.at, n, start, len(ids)))
            done, self.at = done + n, self.at + n
            if self.at == self.block:
                yield self.cut()

    def cut(self) -> tuple:
        ids = np.concatenate(self.held)
        planes = [self.press.compress(p) for p in to_planes(ids, self.width, self.kind)]
        row = (self.number, self.chunk, self.first, len(ids), self.width, self.kind, b"".join(planes), np.cumsum([len(p) for p in planes]).tolist(), *map(list, zip(*self.pieces)))
        self.chunk, self.first, self.at, self.held, self.pieces = self.chunk + 1, self.first + len(ids), 0, [], []
        return row


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, planes: str = "byte", block: int = BLOCK) -> None:
    """Encodes every text, appends ``end_id`` and writes the chunk table to ``path`` in ascending order of the integer id."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    small_batches(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * shuffles
    width = 2 if max(tokens.opened(tokenizer).max_id, end_id) < 1 << 16 else 4
    bounds = sorted({int(b) for b in docs.select(F.col(id_col).cast("double").alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 0.2 / parts)})

    def encode(batches):
        model = tokens.opened(tokenizer)
        for batch in batches:
            part = np.searchsorted(np.array(bounds, np.int64), batch.column(0).fill_null(0).to_numpy(), "right").astype(np.int32)
            part = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), -1 - batch.column(2).to_numpy(), part).astype(np.int32)
            for texts in bw.text_slices(batch.column(1)):
                ids, n = model.ids(texts)
                ends = np.cumsum(n + 1)
                out = np.full(int(ends[-1]), end_id, f"<u{width}")
                mine = np.ones(len(out), bool)
                mine[ends - 1] = False
                out[mine] = ids
                offsets = width * np.concatenate([[0], ends])
                rows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([pa.array(part[texts.first : texts.first + len(n)]), batch.column(0).slice(texts.first, len(n)), rows], ["part", "doc_id", "ids"])

    def cut(batches):
        now = None
        schema = None
        for batch in batches:
            rows = []
            for part, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now is None or now.number != part:
                    if now is not None and now.held:
                        rows.append(now.cut())
                    now = _Part(part, width, planes, block)
                rows += now.add(doc_id, np.frombuffer(ids.as_buffer(), f"<u{width}"))
            if now is not None:
                now.held = [np.concatenate(now.held)] if now.held else []  # a batch's memory isn't held on
            if rows:
                yield _chunk_batch(rows)
        if now is not None and now.held:
            yield _chunk_batch([now.cut()])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # rows without an id come first, dealt over parts of their own by their text; rows that share an id stand in the order of their token ids
    texts = texts.withColumn("spread", F.pmod(F.xxhash64("text"), F.lit(shuffles)).cast("int"))
    encoded = texts.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartition(shuffles, "part").sortWithinPartitions("part", "doc_id", "ids")
    dealt.mapInArrow(cut, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a file set: ``ids`` as little-endian unsigned 32-bit integers, ``start`` the ids of all documents before it."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, before = [], 0
    for part, n in totals:  # a row per part, whose number is a parameter
        bases.append((part, before))
        before += n

    def decode(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ends = [0, *row["plane_ends"]]
                planes = [press.decompress(row["payload"][a:b]) for a, b in zip(ends, ends[1:])]
                ids = from_planes(planes, row["n_ids"], row["width"], row["plane_kind"])
                pieces = [ids[at : at + n].tobytes() for at, n in zip(row["piece_at"], row["piece_n"])]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_first"], pa.int64()), pa.array(row["doc_n"], pa.int64()), pa.array(pieces, pa.binary())],
                    ["part", "chunk", "doc_id", "first", "n", "ids"],
                )

    small = "part", "chunk", "n_ids", "width", "plane_kind", "payload", "plane_ends", "doc_ids", "piece_at", "piece_n", "doc_first", "doc_n"
    pieces = chunks.select(*small).mapInArrow(decode, "part int, chunk int, doc_id long, first long, n long, ids binary")
    whole = pieces.filter(F.octet_length("ids") == 4 * F.col("n")).select("part", "doc_id", "first", "ids")
    join = F.aggregate(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    spread = pieces.filter(F.octet_length("ids") < 4 * F.col("n")).groupBy("part", "first", "doc_id").agg(join.alias("ids")).select("part", "doc_id", "first", "ids")
    starts = F.broadcast(spark.createDataFrame(bases or [(0, 0)], "part int, base long"))
    return whole.unionByName(spread).join(starts, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "ids")
