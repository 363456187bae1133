"""Nearest neighbours by additive quantisation.

A vector is written as a sum of codewords, one from each of several codebooks that all span the full
dimension. Codebooks are learned on residuals and then refitted together; a beam search picks the codes.
A query scores all codes by adding entries of its look-up table, with the stored norm where the measure
needs it; the best are scored again on the original vectors. How many are "the best" is measured: some
queries are answered exactly, and the shortlist is made so long that it holds their true neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that the codebooks are fitted on, at most; every vector is encoded.
SAMPLE_ROWS = 8192
BOOKS, WORDS, BEAM = 24, 256, 3
#: Queries that are also answered exactly, at most, and the share of their true neighbours that the shortlist must hold.
CALIBRATION_QUERIES, HELD = 64, 0.97
#: Rows of a block of codes, and bytes of a block of queries, at most.
CODE_BLOCK, QUERY_BYTES = 1 << 16, 16 << 20
#: Bytes of queries that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[draw.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[draw.choice(len(x), k)]).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


class AdditiveQuantiser:
    """Codebooks of shape (books, words, dimension)."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = np.ascontiguousarray(books, dtype=np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, books) by beam search for the least squared error."""
        n, (m, k, d) = len(x), self.books.shape
        rest = x.astype(np.float32)[:, None, :]  # what each partial sum leaves over
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for b, c in enumerate(self.books):
            total = (rest * rest).sum(axis=2)[:, :, None] + (c * c).sum(axis=1) - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, -1, k)
            total = total.reshape(n, -1)
            keep = min(beam, total.shape[1]) if b < m - 1 else 1
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            codes = np.concatenate((codes[rows, best // k], (best % k).astype(np.uint8)[:, :, None]), axis=2)
            rest = rest[rows, best // k] - c[best % k]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> AdditiveQuantiser:
    """Codebooks by k-means on residuals, then one joint least-squares refit for the codes that the beam search picks."""
    draw = np.random.default_rng(seed)
    rest, found = x.astype(np.float32), []
    for _ in range(books):
        c = _kmeans(rest, words, draw)
        rest = rest - c[_nearest(rest, c)]
        found.append(c)
    model = AdditiveQuantiser(np.stack(found))
    picks = np.concatenate([model.encode(x[i : i + 1024]) for i in range(0, len(x), 1024)]).astype(np.int64) + np.arange(books) * words
    size = books * words
    together = np.zeros(size * size, np.float32)
    for a in range(books):
        for b in range(books):
            pair, n = np.unique(picks[:, a] * size + picks[:, b], return_counts=True)
            together[pair] += n
    together = together.reshape(size, size)
    together[np.diag_indices(size)] += 1.0  # a pull towards the codebooks so far, which also settles unused words
    sums = np.stack([np.bincount(picks.ravel(), np.repeat(x[:, j], books), size) for j in range(x.shape[1])], axis=1)
    flat = model.books.reshape(size, -1).copy()
    left = (sums + flat).astype(np.float32) - together @ flat
    step, square = left.copy(), (left * left).sum()
    for _ in range(12):  # conjugate gradients for all dimensions at once
        if square < 1e-9:
            break
        image = together @ step
        by = square / (step * image).sum()
        flat += by * step
        left -= by * image
        square, before = (left * left).sum(), square
        step = left + square / before * step
    return AdditiveQuantiser(flat.reshape(model.books.shape))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that can be compared, x in double precision.

    Null ids, null or zero vectors, vectors with null or non-finite components and vectors of another
    than the most frequent dimension take no part.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    out = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    usual = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def _encoded(model: AdditiveQuantiser) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column("x"))
                codes = model.encode(x)
                # the stored norms: of the vector, and of what its codes stand for
                norm, coded = np.linalg.norm(x, axis=1), np.linalg.norm(model.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float64()), pa.array(coded.astype(float), pa.float64())],
                    ["vec_id", "codes", "norm", "coded_norm"],
                )

    return run


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, books: int = BOOKS, words: int = WORDS) -> tuple[AdditiveQuantiser | None, DataFrame]:
    """The codebooks, fitted on at most ``sample_rows`` vectors (the smallest hashes of ids), and (vec_id, codes, norm, coded_norm) of all."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x").toArrow()["x"].combine_chunks()
    if not len(rows):
        return None, vectors.sparkSession.createDataFrame([], "vec_id long, codes binary, norm double, coded_norm double")
    model = fit(_matrix(rows), books, min(words, max(2, len(rows) // 4)))
    return model, vectors.mapInArrow(_encoded(model), "vec_id long, codes binary, norm double, coded_norm double")


def _approximate(model: AdditiveQuantiser, q: np.ndarray, codes: np.ndarray, norms: np.ndarray, coded: np.ndarray, measure: str) -> np.ndarray:
    """Scores (rows, queries) by look-up tables and stored norms."""
    tables = np.ascontiguousarray(np.einsum("qd,bkd->bkq", q.astype(np.float32), model.books))
    score = np.zeros((len(codes), len(q)), np.float32)
    for b in range(len(model.books)):
        score += tables[b][codes[:, b]]
    score *= (norms / np.where(coded > 0, coded, 1)).astype(np.float32)[:, None]
    return 2 * score - norms.astype(np.float32)[:, None] ** 2 if measure == "l2" else score


def _measure(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    """Exact scores (queries, rows)."""
    return q @ x.T if measure == "ip" else 2 * q @ x.T - (x * x).sum(axis=1) - (q * q).sum(axis=1)[:, None]


def _true_neighbours(q_ids: np.ndarray, q: np.ndarray, k: int, measure: str):
    """The best ``k`` of a task's vectors for each of a few queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            s = _measure(q, _matrix(batch.column("x")), measure) if len(ids) else np.empty((len(q), 0))
            s[ids[None, :] == q_ids[:, None]] = -np.inf
            s, i = np.concatenate((best, s), axis=1), np.concatenate((who, np.broadcast_to(ids, (len(q), len(ids)))), axis=1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best, who = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        at, _ = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(who[best > -np.inf], pa.int64()), pa.array(best[best > -np.inf], pa.float64())], ["query", "vec_id", "score"])

    return run


def _above(model: AdditiveQuantiser, q_ids: np.ndarray, q: np.ndarray, marks: list[np.ndarray], measure: str):
    """For each query and mark, how many of a task's other vectors have a greater approximate score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(m), np.int64) for m in marks]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, codes = part.column("vec_id").to_numpy(), np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                score = _approximate(model, q, codes, part.column("norm").to_numpy(), part.column("coded_norm").to_numpy(), measure)
                score[ids[:, None] == q_ids] = -np.inf
                for j, m in enumerate(marks):
                    counts[j] += len(ids) - np.searchsorted(np.sort(score[:, j]), m, side="right")
        flat = [(j, i, int(n)) for j, c in enumerate(counts) for i, n in enumerate(c)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 3, ["query", "mark", "n"])

    return run


def shortlist_length(model: AdditiveQuantiser, base: DataFrame, index: DataFrame, queries: DataFrame, k: int, measure: str, held: float = HELD) -> int:
    """How long a shortlist holds the share ``held`` of the true ``k`` neighbours of at most CALIBRATION_QUERIES queries.

    Their neighbours are found exactly among all vectors; a neighbour's place is the number of
    vectors that the codes put before it. Two passes over the table, linear in its rows; what comes
    to the driver is ``k`` rows for each of these queries.
    """
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toArrow().combine_chunks()
    q_ids, q = some["vec_id"].to_numpy(), _matrix(some["x"].combine_chunks())
    found = base.mapInArrow(_true_neighbours(q_ids, q, k, measure), "query long, vec_id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "vec_id")
    rows = index.join(F.broadcast(best), "vec_id").select("query", "codes", "norm", "coded_norm").toArrow().to_pylist()
    marks: list[list[float]] = [[] for _ in q]
    for r in rows:
        codes = np.frombuffer(r["codes"], np.uint8)[None, :]
        marks[r["query"]].append(_approximate(model, q[r["query"]][None, :], codes, np.array([r["norm"]]), np.array([r["coded_norm"]]), measure)[0, 0])
    if not rows:
        return k
    above = index.mapInArrow(_above(model, q_ids, q, [np.array(m, np.float32) for m in marks], measure), "query long, mark long, n long")
    places = [r["n"] for r in above.groupBy("query", "mark").agg(F.sum("n").alias("n")).collect()]
    return max(2 * k, int(np.ceil(np.quantile(places, held))) + 1)


def _scan(model: AdditiveQuantiser, wanted: int, measure: str):
    """Of each (queries, codes) pair of blocks, the best candidates of each query by look-up tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("q_ids", "q_x", "ids", "codes", "norms", "coded")}
                q_ids, ids = np.array(row["q_ids"]), np.array(row["ids"])
                q = np.array(row["q_x"]).reshape(len(q_ids), -1)
                codes = np.frombuffer(b"".join(row["codes"]), np.uint8).reshape(len(ids), -1)
                norms, coded = np.array(row["norms"]), np.array(row["coded"])
                k = min(wanted, len(ids))
                for at in range(0, len(q), 64):
                    score = _approximate(model, q[at : at + 64], codes, norms, coded, measure)
                    score[ids[:, None] == q_ids[at : at + 64]] = -np.inf  # a query is no neighbour of itself
                    score = score.T
                    worst = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    for j in range(len(score)):
                        found = np.flatnonzero((score[j] >= worst[j]) & (score[j] > -np.inf))
                        found = found[np.lexsort((ids[found], -score[j][found]))][:wanted]
                        if len(found):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([int(q_ids[at + j])], pa.int64()), pa.array([ids[found].tolist()], pa.list_(pa.int64())), pa.array([score[j][found].tolist()], pa.list_(pa.float32()))],
                                ["query_id", "ids", "scores"],
                            )

    return run


def _exact(measure: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, x = _matrix(batch.column("q")), _matrix(batch.column("x"))
                s = (q * x).sum(axis=1) if measure == "ip" else -((q - x) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _share_of_block(shortlist: int, rows: int, blocks: int, k: int) -> int:
    """Candidates to take from one block, of which rows are dealt at random: the block's share of the shortlist and ten standard deviations more."""
    share = shortlist / blocks
    return min(shortlist, k + int(np.ceil(share + 10 * np.sqrt(share)))) if blocks > 1 else min(shortlist, rows)


def nearest(vectors: DataFrame, every: int, k: int = 20, measure: str = "ip", shortlist: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. Measures: "ip", the inner product, or "l2", the negative
    squared distance. Equal scores go by the smaller vec_id. Vectors that usable() leaves out take no
    part; of rows that share an id, one is taken. Other columns are ignored; without queries or other
    vectors the result is empty. Queries meet all codes in blocks: a block of codes travels once for
    each block of queries, and the fewer blocks of codes there are, the more of queries, so that all
    cores have work. ``shortlist`` candidates of each query are scored on the original vectors; by
    default as many as shortlist_length() finds needed.
    """
    spark = vectors.sparkSession
    base = cut(usable(vectors).groupBy("vec_id").agg(F.min("x").alias("x")))
    model, index = build_index(base)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if model is None:
        return empty
    queries = base.where(F.col("vec_id") % every == 0)
    n, n_queries = base.count(), queries.count()
    if not n_queries:
        return empty
    index = cut(index)
    shortlist = shortlist or shortlist_length(model, base, index, queries, k, measure)
    code_parts = -(-n // CODE_BLOCK)
    query_rows = max(64, QUERY_BYTES // (8 * model.books.shape[2]))
    query_parts = max(-(-n_queries // query_rows), min(-(-n_queries // 64), -(-3 * spark.sparkContext.defaultParallelism // code_parts)))
    of = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    together = lambda *cs: F.array_sort(F.collect_list(F.struct(*cs)))
    code_blocks = index.groupBy(of(code_parts).alias("code_block")).agg(together("vec_id", "codes", "norm", "coded_norm").alias("c"))
    query_blocks = queries.groupBy(of(query_parts).alias("query_block")).agg(together("vec_id", "x").alias("q"))
    left = code_blocks.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    right = query_blocks.withColumn("code_block", F.explode(F.sequence(F.lit(0), F.lit(code_parts - 1))))
    pairs = left.join(right, ["code_block", "query_block"]).select(
        F.col("q.vec_id").alias("q_ids"), F.flatten("q.x").alias("q_x"), F.col("c.vec_id").alias("ids"), F.col("c.codes").alias("codes"), F.col("c.norm").alias("norms"), F.col("c.coded_norm").alias("coded")
    )
    # a pair of blocks is a row of some MB: few to a task, whatever their bytes in the shuffle
    pairs = pairs.repartition(min(code_parts * query_parts, 10_000))
    found = pairs.mapInArrow(_scan(model, _share_of_block(shortlist, n, code_parts, k), measure), "query_id long, ids array<long>, scores array<float>")
    # blocks' lists of one query meet; the best of all stay
    best = found.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "scores"))).alias("all"))
    order = F.array_sort(F.transform("all", lambda s: F.struct((-s["scores"]).alias("s"), s["ids"].alias("id"))))
    listed = best.select("query_id", F.explode(F.slice(order, 1, shortlist)["id"]).alias("vec_id"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    if n_queries * 8 * model.books.shape[2] <= BROADCAST_BYTES:  # then the candidates' vectors need not move again
        asked = F.broadcast(asked)
    exact = listed.join(base, "vec_id").join(asked, "query_id")
    scored = exact.select("query_id", "vec_id", "q", "x").mapInArrow(_exact(measure), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
