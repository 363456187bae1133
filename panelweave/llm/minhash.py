"""Near-duplicates by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of the document's
shingles, so half as many hash evaluations fill a signature of the same length. Bands of the
signature propose candidates; every link is confirmed on the two full shingle sets.

Documents with the same set form a class and are compared as one. In each bucket the members are
first compared with one representative only, the one that shares buckets with most others, as the
text that others were made from does. Members that these links join need no further comparison. What
is left is compared pair by pair, so no candidate is given up. Two bits of each of 128 signature
values form a sketch that rules out pairs far below the threshold inside the join. Two members x, y of
one representative h share at most min(|x & h|, |y & h|) shingles plus those outside of h that both
have; so they are compared only if the first term suffices or a join on shingles outside of h finds
enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, join_hot, slices
from .components import component_labels

PERMUTATIONS = 72
#: Signature values in a sketch.
SKETCH = 128
#: Ids that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of one join key that a task gets at most.
DEALT = 4000
_SEED = np.random.default_rng(7919)
_SEED.integers(1, 2**63, 256, dtype=np.uint64)  # keeps the numbers below what they were
_FLIP = _SEED.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)
_TIMES = _SEED.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Seed of the words' hash.
_WORD_SEED = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def banding(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = 5e-5) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at ``threshold`` with at most this probability."""
    fit = [(r, values // r) for r in range(1, 33) if (1 - threshold**r) ** (values // r) <= miss]
    return max(fit, default=(1, values))


def sketch_limit(threshold: float, miss: float = 2e-5) -> int:
    """Differing values of a sketch up to which a pair may be at ``threshold``, but for this probability."""
    p, tail, k = 0.75 * (1 - threshold), 1.0, 0
    while True:
        tail -= comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if tail <= miss or k == SKETCH:
            return k
        k += 1


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each of the first 128 signature values, as four 64-bit numbers a row."""
    two = (_mix(sig[:, :SKETCH].astype(np.uint64) + np.uint64(1)) & np.uint64(3)).reshape(-1, SKETCH // 32, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2).view(np.int64)


def _differing(a: str, b: str) -> Column:
    """Sketch values in which the array columns ``a`` and ``b`` differ."""
    total = F.lit(0)
    for i in range(SKETCH // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + F.bit_count(either)
    return total


def shingle_sets(documents: list[str], width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer words
    is one shingle, a text without words none. Each distinct word of the batch is hashed as a whole, by XXH3: not
    by a sum over its letters, for which there are words of any kind that no table of letters tells apart.
    """
    raw = [d.encode("utf-8", "surrogatepass") for d in documents]
    low = np.frombuffer(b"\n".join(raw).lower(), dtype=np.uint8)
    ends = np.cumsum([len(d) + 1 for d in raw])
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.empty(0, np.uint64)
    if len(starts):
        offsets = np.concatenate(([0], np.cumsum(stops - starts)))
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[inside].tobytes())]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, _WORD_SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        words = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    first = np.searchsorted(starts, np.concatenate(([0], ends)))
    out = []
    for k in range(len(documents)):
        w = words[first[k] : first[k + 1]]
        span = min(width, len(w))
        if not span:
            out.append(w)
            continue
        h = np.zeros(len(w) - span + 1, np.uint64)
        for j in range(span):
            h = _mix(h + w[j : len(w) - span + 1 + j]) + np.uint64(j + 1)
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least and greatest hash of each non-empty set under each permutation, upper 32 bits: (sets, 2 x permutations)."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15, side="right")) + at)
        if end == at + 1 and sizes[at] > 1 << 15:  # a very long text, in parts that fit the cache
            parts = [_extremes(p, np.array([0])) for p in np.array_split(sets[at], sizes[at] // (1 << 15) + 1)]
            both = np.concatenate(parts)
            out[at, 0::2], out[at, 1::2] = both[:, 0::2].min(axis=0), both[:, 1::2].max(axis=0)
        else:
            out[at:end] = _extremes(np.concatenate(sets[at:end]), np.concatenate(([0], np.cumsum(sizes[at : end - 1]))))
        at = end
    return out


def _extremes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty((len(offsets), 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        v = (((h ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(v, offsets)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, offsets)
    return out


def _signed(width: int, rows: int, bands: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([x or "" for x in batch.column("text").to_pylist()], width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = np.ascontiguousarray(signatures([sets[k] for k in full])) if full else None
            banded: list[list[int] | None] = [None] * len(sets)
            sketched: list[list[int] | None] = [None] * len(sets)
            bits = sketches(sig).tolist() if full else []
            for i, k in enumerate(full):
                sketched[k] = bits[i]
                banded[k] = [xxhash.xxh3_64_intdigest(sig[i, j * rows : (j + 1) * rows].tobytes(), seed=j) - 2**63 for j in range(bands)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(sketched, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return run


def _sets(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([x or "" for x in batch.column("text").to_pylist()], width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "hashes"])

    return run


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        shared, total, rest = [], [], []
        for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            own = p[~np.isin(p, q, assume_unique=True)]
            shared.append(len(p) - len(own))
            total.append(len(q) + len(own))
            rest.append(own.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "shared", "total", "rest"]
        )


def _dealt_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``keys`` in which a key with more than DEALT rows of ``many`` (or of ``counted``, where that is cheaper to count) is dealt to several tasks.

    Its rows in ``many`` go by the column ``by``, those in ``few`` to each of the tasks. Such keys are
    at most a DEALT-th of the rows. Were there more than may be broadcast, the join is a plain one.
    """
    n = F.count(F.lit(1))
    hot = cut((many if counted is None else counted).groupBy(*keys).agg(n.alias("n")).where(F.col("n") > DEALT).select(*keys, F.ceil(F.col("n") / DEALT).cast("int").alias("parts")))
    if not 0 < hot.count() <= BROADCAST_IDS:
        return many.join(few, keys)
    hot, one = F.broadcast(hot), F.lit(1)
    dealt = many.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", one))).drop("parts")
    copied = few.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one).cast("long") - 1))).drop("parts")
    return dealt.join(copied, [*keys, "part"]).drop("part")


def _measured(pairs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, total, rest) of distinct ``pairs`` (a, b): sizes of intersection and union of the full sets, and what only ``a`` has.

    ``b`` may be the head of a large family: its members are dealt to tasks, the head's set goes to each.
    """
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS:  # then the texts need not be shuffled to find those compared
        used = F.broadcast(used)
    sets = cut(members.join(used, "id", "left_semi").mapInArrow(_sets(width), "id long, hashes binary"))
    both = _dealt_join(pairs.join(sets.toDF("a", "ha"), "a"), sets.toDF("b", "hb"), ["b"], "a", counted=pairs)
    return cut(both.mapInArrow(_compare, "a long, b long, shared long, total long, rest array<long>"))


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the measured pairs that are links."""
    return measured.where(F.col("shared") * 100 >= F.col("total") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _near(first: tuple[str, str], second: tuple[str, str], percent: int) -> Column:
    """Whether two columns (size, sketch) each allow a link."""
    (n, s), (m, t) = first, second
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_differing(s, t) <= sketch_limit(percent / 100))


def _in_buckets(classes: DataFrame) -> DataFrame:
    """Stored (bucket, id, n, sketch, head, head_n, head_sketch) of the buckets with several classes; the head shares most buckets.

    A bucket may have most classes as members: join_hot() keeps them apart.
    """
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    weight = join_hot(banded, sizes, ["bucket"], "size").groupBy("id").agg(F.sum("size").alias("weight"))
    paired = classes.join(weight, "id").select(F.explode("bands").alias("bucket"), F.struct("weight", (-F.col("id")).alias("minus_id"), "n", "sketch").alias("m"))
    heads = cut(paired.groupBy("bucket").agg(F.max("m").alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return cut(join_hot(paired, heads, ["bucket"], "size").select("bucket", (-F.col("m.minus_id")).alias("id"), "m.n", "m.sketch", (-F.col("h.minus_id")).alias("head"), F.col("h.n").alias("head_n"), F.col("h.sketch").alias("head_sketch")))


def _spokes(in_buckets: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b): members with the heads of their buckets."""
    near = _near(("n", "sketch"), ("head_n", "head_sketch"), percent)
    return cut(in_buckets.where(F.col("id") != F.col("head")).where(near).select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())


def _reaches(common: Column, percent: int) -> Column:
    return common * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _both(table: DataFrame, keys: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    one, two = (table.select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in names)) for k in "ab")
    return one, two


def _pairs_in_buckets(in_buckets: DataFrame, known: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b): members of one bucket that are in different components yet and can be near enough.

    A grade spans one size ratio of the threshold, so partners are in the same grade or the next.
    Members of a large bucket are dealt to tasks.
    """
    part = in_buckets.select("bucket", "id", "head", "n", "sketch").join(known.select("id", "head", "shared"), ["id", "head"], "left").join(labels.toDF("id", "component"), "id", "left")
    part = cut(part.withColumn("component", F.coalesce("component", "id")))
    mixed = part.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = cut(part.where("id <> head").join(mixed, "bucket", "left_semi").withColumn("grade", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)))
    ask, got = _both(rest, ["bucket", "grade"], ["id", "n", "sketch", "shared", "component"])
    ask = ask.withColumn("grade", F.explode(F.array("grade", F.col("grade") + 1)))
    within = F.when(F.col("shared_a").isNull() | F.col("shared_b").isNull(), True).otherwise(_reaches(F.least("shared_a", "shared_b"), percent))
    pairs = _dealt_join(got, ask, ["bucket", "grade"], "id_b").where((F.col("component_a") != F.col("component_b")) & _near(("n_a", "sketch_a"), ("n_b", "sketch_b"), percent) & within)
    return cut(pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())


def _pairs_outside_heads(measured: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b): members of one head, in different components yet, whose common shingles that the head lacks make a link possible."""
    families = known.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("head")
    own = measured.select(F.col("a").alias("id"), F.col("b").alias("head"), F.explode("rest").alias("shingle")).join(known.join(families, "head", "left_semi"), ["id", "head"])
    one, two = _both(cut(own), ["head", "shingle"], ["id", "n", "shared", "component"])
    common = _dealt_join(two, one, ["head", "shingle"], "id_b").where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")))
    common = common.groupBy("head", "id_a", "id_b").agg(F.count(F.lit(1)).alias("both"), *(F.any_value(c).alias(c) for c in ("n_a", "n_b", "shared_a", "shared_b")))
    return cut(common.where(_reaches(F.least("shared_a", "shared_b") + F.col("both"), percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def _components(classes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that links join. Each step is stored and ends before the next, so that few shuffles run at a time."""
    in_buckets = _in_buckets(classes)
    measured = _measured(_spokes(in_buckets, percent), members, width)
    labels = cut(component_labels(_linked(measured, percent)))
    known = measured.select(F.col("a").alias("id"), F.col("b").alias("head"), "shared", (F.col("shared") + F.size("rest")).alias("n")).join(labels.toDF("id", "component"), "id", "left")
    known = cut(known.withColumn("component", F.coalesce("component", "id")))
    pairs = _pairs_in_buckets(in_buckets, known, labels, percent).union(_pairs_outside_heads(measured, known, percent))
    more = _linked(_measured(cut(pairs.distinct()), members, width), percent)
    # What the first links joined is one node here.
    return component_labels(labels.toDF("u", "v").union(more)) if more.count() else labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Linked are documents with 100 x intersection >= ``percent`` x union of their sets of
    ``width``-word shingles; component_id is the least doc_id that links reach. Null, empty and
    wordless texts have no shingles and are linked with nothing, nor are rows without a doc_id
    (component_id null, kept true). Rows that share a doc_id count as one document for links, and
    each is returned. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, bands = banding(percent / 100)
    signed = cut(docs.mapInArrow(_signed(width, rows, bands), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"))
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    classes = cut(classes)
    final = _components(classes, docs.withColumnRenamed("doc_id", "id"), width, percent)
    of_class = classes.select("set_key", F.col("id").alias("class_id")).join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    of_class = of_class.select("set_key", F.coalesce("component", "class_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near-duplicates, with all their columns.

    Null, empty and wordless texts and rows without an id have no duplicates and stay; rows that share a
    doc_id are one document and stay or go together. Columns may have any names; an empty table gives
    an empty result.
    """
    (name,) = free_names(docs.columns, "id")
    ids = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
