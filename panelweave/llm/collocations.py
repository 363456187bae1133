"""Phrases whose words stand together more often than their parts' counts explain, by set-oriented mining.

The relation of one word's occurrences is stored in the order of pieces and positions, as runs: numbers of
words, with a gap wherever a piece ends or a word is too rare. The relation of the next length is the merge-join
of a relation with itself at the next position: two phrases that stand at adjacent positions of a piece share all words
but one, and make a phrase of one word more. Its groups are counted, rows of groups under the least count go by a
semi-join, and the relation that is left is stored and extended in turn. Rows never leave their block, so the
merge-joins shuffle nothing; what is shuffled are counts by group, added up in each task.

The semi-join takes the frequent groups by broadcast where they are at most FREQUENT_ROWS, and meets each block's
distinct groups in a shuffled join beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

LEAST, LENGTHS, TOP = 100, (2, 5), 2000
#: Frequent groups that are broadcast for a semi-join, 16 to 40 bytes each.
FREQUENT_ROWS = 2_000_000
#: Candidates of a language that one task ranks before the lists meet.
RANKED = 200_000
ROWS, SIZE = 10_000, 8 << 20
#: Bytes as the pieces see them: a mark or a line's end is a line feed, a tab is a space, letters A to Z are lower case.
_FOLDED = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """For each language of a batch: distinct words, the place of each occurrence's word among them, and whether a piece begins there."""
    langs = batch.column("lang").dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False)
    text = batch.column("text")
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        raw = b"\n".join(x or b"" for x in text.take(pa.array(np.flatnonzero(of == i))).to_pylist()).translate(_FOLDED)
        a = np.frombuffer(raw, np.uint8)
        gap = (a == 32) | (a == 10)
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        offsets = np.r_[0, np.cumsum(end - start)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(a[~gap].tobytes())]).dictionary_encode()
        piece = np.searchsorted(np.flatnonzero(a == 10), start)
        yield lang, words.dictionary, words.indices.to_numpy(zero_copy_only=False), np.r_[True, piece[1:] != piece[:-1]]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS, SIZE):
        for lang, words, at, _ in _words(batch):
            n = np.bincount(at, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _squeezed(runs: np.ndarray) -> np.ndarray:
    """Runs with one gap between them at most, and none at the ends."""
    there = runs >= 0
    keep = there.copy()
    keep[1:] |= there[:-1]
    runs = runs[keep]
    return runs[:-1] if len(runs) and runs[-1] < 0 else runs


def _pairs(runs: np.ndarray, base: int) -> np.ndarray:
    """The merge-join of a relation with itself at the next position: left * base + right where both stand, else -1."""
    return np.where((runs[:-1] >= 0) & (runs[1:] >= 0), runs[:-1] * base + runs[1:], -1)


def _runs(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<i4").astype(np.int64)


def _stored(runs: np.ndarray) -> bytes:
    return runs.astype("<i4").tobytes()


def _numbered(groups: DataFrame) -> DataFrame:
    """Stored ``groups`` with their number, from 0 without gaps: rows before a partition plus rows before in it."""
    groups = cut(groups)
    rows = groups.withColumns({"pid": F.spark_partition_id(), "id": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    # one row for each partition
    base = groups.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("size"))
    base = base.select("pid", (F.sum("size").over(Window.orderBy("pid")) - F.col("size")).alias("base"))
    return rows.join(F.broadcast(base), "pid").withColumn("id", F.col("id") + F.col("base")).drop("pid", "base")


def _number_words(batches: Iterable[pa.RecordBatch], found: dict[str, tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS, SIZE):
        for lang, words, at, begins in _words(batch):
            if lang not in found:
                continue
            known, ids = found[lang]
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            yield _block(np.where(place >= 0, ids[place], -1)[at], begins)


def _block(ids: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    runs = np.full(len(ids) + int(begins.sum()), -1, np.int64)
    runs[np.arange(len(ids)) + np.cumsum(begins)] = ids
    return pa.RecordBatch.from_arrays([pa.array([_stored(_squeezed(runs))], pa.binary())], ["runs"])


def _word_blocks(docs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """The relation of single words: runs, blocks of numbers of the frequent ``words`` (lang, word, id)."""
    if n_words <= FREQUENT_ROWS:
        table = words.select("lang", "word", "id").toArrow()
        by_lang = {}
        for lang in table["lang"].unique().to_pylist():
            rows = table.filter(pc.equal(table["lang"], lang))
            by_lang[lang] = rows["word"].combine_chunks().cast(pa.large_binary()), rows["id"].to_numpy()
        found = docs.sparkSession.sparkContext.broadcast(by_lang)
        return docs.mapInArrow(lambda batches: _number_words(batches, found.value), "runs binary")

    # each block's distinct words, as one row for each, meet the frequent ones by a shuffle
    def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS, SIZE):
            for lang, known, at, begins in _words(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([known.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())), pa.array([at.astype("<i4").tobytes()]), pa.array([np.packbits(begins).tobytes()])], ["lang", "words", "at", "begins"]
                )

    blocks = cut(docs.mapInArrow(apart, "lang string, words array<string>, at binary, begins binary")).withColumn("block", F.monotonically_increasing_id())
    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    ids = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("ids"))  # at most a block's words

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, begins, known in zip(*(batch.column(c).to_pylist() for c in ("n", "at", "begins", "ids")), strict=True):
                number = np.full(n, -1, np.int64)
                for pair in known:
                    number[pair["place"]] = pair["id"]
                at = np.frombuffer(at, "<i4")
                yield _block(number[at], np.unpackbits(np.frombuffer(begins, np.uint8), count=len(at)).astype(bool))

    return blocks.join(ids, "block").select(F.size("words").alias("n"), "at", "begins", "ids").mapInArrow(together, "runs binary")


def _count_pairs(base: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored in batch.column("runs"):
                keys = _pairs(_runs(stored.as_py()), base)
                keys, n = np.unique(keys[keys >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _pair_blocks(blocks: DataFrame, base: int, groups: DataFrame, n_groups: int) -> DataFrame:
    """The relation of the next length: where two rows of ``blocks`` make a phrase of ``groups`` (key, id), its number."""
    if n_groups <= FREQUENT_ROWS:
        table = groups.select("key", "id").toArrow().sort_by("key")
        found = blocks.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["id"].to_numpy()))

        def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = found.value
            for batch in batches:
                for stored in batch.column("runs"):
                    pairs = _pairs(_runs(stored.as_py()), base)
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([_stored(_squeezed(np.where(keys[at] == pairs, ids[at], -1)))], pa.binary())], ["runs"])

        return blocks.mapInArrow(settle, "runs binary")

    blocks = blocks.withColumn("block", F.monotonically_increasing_id())

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, stored in zip(batch.column("block").to_pylist(), batch.column("runs"), strict=True):
                keys = np.unique(_pairs(_runs(stored.as_py()), base))
                keys = keys[keys >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(keys, pa.int64())], ["block", "key"])

    asked = blocks.select("block", "runs").mapInArrow(distinct, "block long, key long")
    known = asked.join(groups.select("key", "id"), "key").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "id"))).alias("known"))  # at most a block's groups

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored, rows in zip(batch.column("runs"), batch.column("known").to_pylist(), strict=True):
                keys, ids = (np.array([r[c] for r in rows], np.int64) for c in ("key", "id"))
                pairs = _pairs(_runs(stored.as_py()), base)
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([_stored(_squeezed(np.where(keys[at] == pairs, ids[at], -1)))], pa.binary())], ["runs"])

    return blocks.join(known, "block").select("runs", "known").mapInArrow(together, "runs binary")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LENGTHS[1]) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and the phrases of 1 to ``longest`` words that occur ``least`` times and more in a language.

    The latter are stored: lang, words, size, a (count), best (greatest count of a phrase of one word more that has it), and the
    counts of its beginnings and ends, ``heads`` and ``tails``, of 1 to all its words.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    counts = cut(docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")))
    totals = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    words = _numbered(counts.where(F.col("a") >= least))
    phrases = words.select("id", "lang", F.array("word").alias("words"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    levels, size = [], words.count()
    blocks = cut(_word_blocks(docs, words, size)) if size else None
    for length in range(1, longest + 1):
        if not size:
            break
        phrases = cut(phrases)
        if length == longest:
            levels.append(phrases.withColumn("best", F.lit(None).cast("long")))
            break
        if size >= 1 << 31:
            raise OverflowError(f"{size} phrases of {length} words occur {least} times and more; their numbers are 32-bit")
        groups = _numbered(blocks.mapInArrow(_count_pairs(size), "key long, n long").groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
        longer = groups.select("id", "a", F.expr(f"key div {size}L").alias("left"), F.expr(f"key % {size}L").alias("right"))
        inside = longer.select(F.col("left").alias("id"), "a").union(longer.select("right", "a")).groupBy("id").agg(F.max("a").alias("best"))
        levels.append(phrases.join(inside, "id", "left"))
        left = phrases.select(F.col("id").alias("left"), "lang", F.col("words").alias("begun"), "heads")
        right = phrases.select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
        n_groups = groups.count()
        if n_groups:
            base, blocks = size, blocks
            blocks = cut(_pair_blocks(blocks, base, groups, n_groups))
        phrases = longer.join(left, "left").join(right, "right").select(
            "id", "lang", F.concat("begun", F.array("word")).alias("words"), "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails")
        )
        size = n_groups
    if not levels:
        levels = [phrases.withColumn("best", F.lit(None).cast("long"))]
    found = reduce(DataFrame.unionByName, levels).select("lang", "words", F.size("words").alias("size"), "a", "best", "heads", "tails")
    return totals, found


def collocations(docs: DataFrame, least: int = LEAST, lengths: tuple[int, int] = LENGTHS, top: int = TOP, percent: int = 100) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut into pieces at marks and line ends and into words at spaces and tabs; null text is
    empty, a null lang is ``und``. Phrases of ``lengths`` words that occur ``least`` times and more are candidates; of a
    candidate's cuts the one with the least floor(1000 a n / (l r)) counts, in exact arithmetic. Candidates inside
    a longer one that occurs ``percent`` % as often or more are dropped. Repeated rows count each, with or without
    an id; other columns are ignored; an empty table, or one without candidates, gives none. A text of any length is
    read whole, as a block of its own from 8 MB on.
    """
    totals, found = frequent_phrases(docs, least, lengths[1])
    found = found.where((F.col("size") >= lengths[0]) & (F.col("best").isNull() | (100 * _exact("best") < percent * _exact("a")))).join(totals, "lang")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.col("size") - k).alias("r")))
    scored = found.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    # the smaller product first: a decimal holds 38 digits
    scored = scored.withColumn("score", F.expr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = cut(best)
    dealt = 1 + best.count() // RANKED
    if dealt > 1:  # the first of each share have all the first
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(dealt))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
