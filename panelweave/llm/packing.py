"""Packing by concatenation and fixed cuts.

All documents' tokens, each document closed by an end id, form one long row in the order of
partitions and of rows in them. Two passes of prefix sums place every document: the first sums the
tokens of each partition, the second adds up inside the partitions. Sequences are then the windows of
fixed length of that row, and a document is cut where a window ends. Only the last window is short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ROWS, SIZE, TrieBpe, broadcast_vocabulary, task_encoder
from .common import cut, slices, texts

LENGTH, END_ID = 2048, 1


def _packed(model: TrieBpe) -> list[bytes]:
    """Little-endian ids of two bytes, or of four for a vocabulary beyond 65,536."""
    width = 2 if len(model.tokens) <= 1 << 16 else 4
    return [i.to_bytes(width, "little") for i in range(len(model.tokens))]


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (tokens with the end id), width (bytes of a token) and ids of each row, unshuffled.

    Null and empty texts are the end id alone; repeated rows and rows without an id are tokenised
    each; other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(vocabulary.value, _packed, b"") as encoder:
            last, width = encoder.units[end_id], len(encoder.units[0])
            for batch in slices(batches, ROWS, SIZE):
                ids = [x + last for x in encoder.encode(texts(batch))]
                n = [len(x) // width for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "n", "width", "ids"]
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n long, width int, ids binary")


def _cutter(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, n, width, ids, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "base")), strict=True):
                at = base if at is None else at
                row = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, row[start : start + size].tobytes(), n, sequence, offset))
                    start += size
                at += n
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are one end id. Each row of ``docs`` is a document of its own, also if it
    repeats another or has no doc_id. Other columns are ignored; no rows give no pieces. The tokens
    are stored once in the checkpoint folder, so the partitions of both passes are the same even
    after the loss of an executor.
    """
    stored = cut(tokenise(docs, path, end_id)).withColumn("pid", F.spark_partition_id())
    sums = stored.groupBy("pid").agg(F.sum("n").alias("total"))
    # one row for each partition of the input, whatever its size
    base = sums.select("pid", (F.sum("total").over(Window.orderBy("pid")) - F.col("total")).alias("base"))
    placed = stored.join(F.broadcast(base), "pid").select("doc_id", "n", "width", "ids", "base")
    return placed.mapInArrow(_cutter(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
