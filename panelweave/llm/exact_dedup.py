"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, hence equal passages give equal
chunks wherever they stand. Each chunk gets an identifier; a document becomes the ordered list of
its chunks' identifiers, and documents are compared by these lists. A chunk's bytes travel once, to
verify that its identifier stands for one content only; documents as a whole never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, free_names, join_hot, slices

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 2048, 4096, 16384
_WINDOW = 32
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: str | None) -> str:
    """Replace each run of space, tab, LF, VT, FF and CR by one space."""
    s = text or ""
    for c in "\t\n\v\f\r":
        s = s.replace(c, " ")
    while "  " in s:
        s = s.replace("  ", " ")
    return s


def chunk_ends(data: bytes, smallest: int = MIN_CHUNK, mean: int = MEAN_CHUNK, largest: int = MAX_CHUNK) -> list[int]:
    """End offsets of the chunks of ``data``; none if it is empty.

    The hash at a byte is the sum of the table values of the last 32 bytes, each shifted by its
    distance. Doubling the span five times computes it for all bytes at once.
    """
    n = len(data)
    if n <= smallest:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < _WINDOW:
        g = h.copy()
        g[span:] += h[:-span] << np.uint32(span)
        h, span = g, span * 2
    spare = mean - smallest
    wanted = np.flatnonzero(h < np.uint32(2**32 // spare)) + 1
    ends, start = [], 0
    while n - start > smallest:
        k = int(np.searchsorted(wanted, start + smallest))
        end = min(int(wanted[k]) if k < len(wanted) else n, start + largest, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunks(text: str | None) -> tuple[bytes, list[bytes]]:
    data = normalise(text).encode("utf-8", "surrogatepass")
    out, start = [], 0
    for end in chunk_ends(data):
        out.append(data[start:end])
        start = end
    return data, out


def _recipes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        short, wide, digest = [], [], []
        for text in batch.column("text").to_pylist():
            data, parts = _chunks(text)
            short.append([xxhash.xxh3_128_digest(p) for p in parts])
            wide.append(hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).digest())
            digest.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digest, pa.string()), pa.array(short, pa.list_(pa.binary())), pa.array(wide, pa.binary())],
            ["doc_id", "text_sha256", "recipe", "wide"],
        )


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen = {}
        for text in batch.column("text").to_pylist():
            for p in _chunks(text)[1]:
                seen[xxhash.xxh3_128_digest(p), p] = None
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([p for _, p in seen], pa.binary())], ["id", "content"])


def ambiguous_ids(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content, found by comparing the bytes of chunks."""
    contents = docs.select("text").mapInArrow(_contents, "id binary, content binary")
    return contents.groupBy("id", "content").agg(F.lit(1).alias("one")).groupBy("id").agg(F.sum("one").alias("n")).where("n > 1").select("id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text).

    Null and empty texts equal each other. A row whose doc_id is null counts in its group's size
    and is kept only if no row of the group has an id. Rows that repeat the kept id are all kept.
    Other columns are ignored; an empty table gives an empty result. A document that has a chunk
    with an ambiguous identifier is compared by the SHA-256 digests of its chunks instead.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = cut(docs.mapInArrow(_recipes, "doc_id long, text_sha256 string, recipe array<binary>, wide binary"))
    lists = _told_apart(recipes, cut(ambiguous_ids(docs)))
    groups = cut(lists.groupBy("list").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = join_hot(lists, groups, ["list"], "group_size")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _told_apart(recipes: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and ``list``, what each document is compared by, from the stored ambiguous identifiers.

    There are none unless a 128-bit hash collides. Were there some, they would be broadcast, as are the
    digests of documents that have them, if they are few; of copies, one recipe meets the identifiers.
    """
    n, plain = ambiguous.count(), F.col("recipe")
    if n == 0:
        return recipes.select("doc_id", "text_sha256", plain.alias("list"))
    once = recipes.groupBy("wide").agg(F.any_value("recipe").alias("recipe")).select("wide", F.explode("recipe").alias("id"))
    doubtful = cut(once.join(F.broadcast(ambiguous) if n <= BROADCAST_ROWS else ambiguous, "id", "left_semi").select("wide").distinct().withColumn("doubtful", F.lit(True)))
    marked = recipes.join(F.broadcast(doubtful) if doubtful.count() <= BROADCAST_ROWS else doubtful, "wide", "left")
    return marked.select("doc_id", "text_sha256", F.when(F.col("doubtful"), F.array("wide")).otherwise(plain).alias("list"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_groups() keeps, with all their columns.

    Null and empty texts are one group. Rows that share an id stay together if any of them stays, but
    equal ones of them only once. A row without an id stays only if no row of its group has one, and then
    one of such rows for each group. Columns may have any names; an empty table gives an empty result.
    Whole documents move once, to meet the verdict on their id.
    """
    name, n, digest = free_names(docs.columns, "id", "n", "digest")
    groups = cut(exact_groups(docs))
    kept = groups.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias(n))
    columns = [f"`{c}`" for c in docs.columns]
    joined = docs.join(kept, F.col("doc_id").cast("long") == F.col(name))
    once = joined.where(F.col(n) == 1).select(*columns)
    more = joined.where(F.col(n) > 1).select(*columns).dropDuplicates(["doc_id", "text"])
    nameless = docs.where(F.col("doc_id").cast("long").isNull())
    alone = groups.where("kept and doc_id is null").select(F.col("text_sha256").alias(digest)).distinct()
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    nameless = nameless.withColumn(digest, F.sha2(text.cast("binary"), 256)).join(alone, digest, "left_semi").dropDuplicates([digest])
    return once.unionByName(more).unionByName(nameless.select(*columns))
