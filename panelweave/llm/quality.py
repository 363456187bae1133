"""Quality by pairwise ranking in the manner of Bradley and Terry.

A pair of a good and a bad document says that the first is preferred. With a linear score, the
probability of that is the logistic function of the score difference, so the loss is logistic on feature
differences. It is taken over all pairs of all labelled rows, not over some that are drawn: weights are
whole multiples of 1 / UNITS, so scores are levels, and pairs are counted by how many good and bad rows
each level has. Spark counts rows by level and adds up derivatives; the driver gets sums whose number
does not grow with the rows, and takes Newton steps. All sums are of whole numbers, hence the same for
any partitioning.

Scores are comparable across documents but have no zero of their own: the cut is the level of all
training scores with the fewest errors there.

Features describe form, not words: lengths, shares of character classes, repetition, layout. Each is
binned at exact quantiles of all training rows, which lets the linear score bend.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, slices

#: Bins of a feature are numbered from 0 to BINS; the quantiles between them, outer ones too, as defects are rare (repeated edges are harmless).
BINS = 8
QUANTILES = np.array([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])
#: Levels of the raw score in 1; weight of the ridge; levels by which second derivatives of pairs are added up; promised gain of a step under which it is the last; most that a step changes a weight by.
UNITS, RIDGE, COARSE, LEAST_GAIN, LONGEST = 1024, 1e-4, 256, 1e-6, 2.0
#: The whole number that stands for 1 in sums of derivatives; rows of a task that makes sums, so that these grow with the rows and not with the partitions.
WHOLE, TASK_ROWS = 1 << 30, 25_000
#: The score of a document at the cut.
CUT_SCORE = 0.3

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"#$%&*@~^=<>{}[]\\|/_+"
_STOPS = b".,;:?"
N_FEATURES = 18


def features(text: str | None) -> list[float]:
    """Numbers that describe the form of a text; all 0 for an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words[1:], words)) / n
    capital = sum(map(str.istitle, words)) / n
    shouted = sum(map(str.isupper, words)) / n
    return [
        np.log1p(n), sum(map(len, words)) / n, len(counts) / n, max(counts.values()) / n, repeats, capital, shouted, share(_UPPER), share(_LOWER), share(_DIGITS), share(_MARKS),
        share(b"!"), share(b"|"), share(_STOPS), len(lines) / n, len(set(lines)) / len(lines), sum(len(w) <= 3 for w in counts) / len(counts), (size - len(text)) / size,
    ]


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [np.array(features(t), np.float32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder, read in tasks of some TASK_ROWS rows if it has more partitions than that."""
    df = cut(df)
    return df.coalesce(-(-df.count() // TASK_ROWS) or 1)


def added_up(rows: DataFrame, cells: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``rows`` of ``cells(batch)``, which is ``size`` whole numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += cells(batch).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    found = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size rows
    out = np.zeros(size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def bin_edges(train: DataFrame) -> list[np.ndarray]:
    """Exact quantiles (of two neighbours the higher) of each feature of ``train`` (x, good, bad); a row counts ``good + bad`` times.

    Features are not negative, so the bits of a single-precision number, read as a whole number, are in
    the order of the numbers. They are found from the top: rows that agree with a quantile in the bits
    known so far are counted by their next bits. Each of the three passes counts all rows.
    """
    known, ranks, top = np.zeros((N_FEATURES, 1), np.int64), None, 31
    place = np.zeros((N_FEATURES, len(QUANTILES)), np.int64)  # which of the known prefixes a quantile has
    for width in (11, 10, 10):
        shift, m = top - width, known.shape[1]

        def cells(batch: pa.RecordBatch, known: np.ndarray = known, top: int = top, shift: int = shift, width: int = width, m: int = m) -> np.ndarray:
            bits, (good, bad) = np.ascontiguousarray(_x(batch)).view(np.int32).astype(np.int64), _numbers(batch, "good", "bad")
            total, n = np.zeros((N_FEATURES, m << width)), good + bad
            for j in range(N_FEATURES):
                at = np.minimum(np.searchsorted(known[j], bits[:, j] >> top), m - 1)
                ok = known[j][at] == bits[:, j] >> top
                total[j] = np.bincount((at[ok] << width) + ((bits[ok, j] >> shift) & ((1 << width) - 1)), n[ok], m << width)
            return total.ravel()

        counts = added_up(train, cells, N_FEATURES * m << width).reshape(N_FEATURES, m, 1 << width)
        if ranks is None:
            rows = int(counts[0].sum())
            if not rows:
                return [np.empty(0, np.float32)] * N_FEATURES
            ranks = np.tile(np.ceil(QUANTILES * (rows - 1)).astype(np.int64), (N_FEATURES, 1))
        found = np.empty_like(ranks)
        for j, q in np.ndindex(ranks.shape):
            upto = np.cumsum(counts[j, place[j, q]])
            digit = int(np.searchsorted(upto, ranks[j, q], side="right"))
            ranks[j, q] -= upto[digit - 1] if digit else 0
            found[j, q] = (known[j, place[j, q]] << width) + digit
        known, top = found, shift  # ascending in each row; of equal ones the first is matched
        place = np.stack([np.searchsorted(k, k) for k in known])
    return list(known.astype(np.int32).view(np.float32))


class Ranking:
    """A fitted score: bin edges of each feature, weights of the bins, and the map to 0..1."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, cut: float, slope: float) -> None:
        self.edges, self.weights, self.cut, self.slope = edges, weights, cut, slope

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin number of each feature, counted through all features."""
        width = BINS + 1
        return np.stack([np.searchsorted(e, x[:, j], side="right") + j * width for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0..1; at the cut it is CUT_SCORE, and it rises with the raw score."""
        logit = np.log(CUT_SCORE / (1 - CUT_SCORE)) + self.slope * (self.raw(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _patterned(edges: list[np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranking(edges, np.zeros(0), 0.0, 1.0)
        for batch in batches:
            within = (model.bins(_x(batch)) - np.arange(N_FEATURES) * (BINS + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in within], pa.binary()), batch.column("good"), batch.column("bad")], ["bins", "good", "bad"])

    return run


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    within = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, N_FEATURES)
    return within + np.arange(N_FEATURES) * (BINS + 1)


def _lowest(w: np.ndarray) -> tuple[int, int]:
    """The lowest level that weights ``w`` can give, and the number of levels; the ridge bounds both, as weights with a loss above that of 0 are not taken."""
    by_feature = w.reshape(N_FEATURES, BINS + 1)
    low = int(by_feature.min(axis=1).sum())
    return low, int(by_feature.max(axis=1).sum()) - low + 1


def levels(patterns: DataFrame, w: np.ndarray) -> np.ndarray:
    """How many good (first row) and bad rows each level has."""
    low, n = _lowest(w)

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        at = w[_bins(batch)].sum(axis=1) - low
        return np.concatenate([np.bincount(at, c, n) for c in _numbers(batch, "good", "bad")])

    return added_up(patterns, cells, 2 * n).reshape(2, n)


def _over_pairs(others: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """For each level k the sum over levels l of ``others[l] * kernel((k - l) * step)``."""
    n = len(others)
    size = 1 << (3 * n).bit_length()
    values = kernel(np.arange(1 - n, n) * step)
    return np.fft.irfft(np.fft.rfft(others, size) * np.fft.rfft(values, size), size)[n - 1 : 2 * n - 1]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _slope(x: np.ndarray) -> np.ndarray:
    return _logistic(x) * _logistic(-x)


def pair_loss(counts: np.ndarray, w: np.ndarray) -> float:
    """Mean of -log P(good over bad) over all pairs of a good and a bad row, with the ridge."""
    good, bad = counts / counts.sum(axis=1, keepdims=True)
    return float(good @ _over_pairs(bad, lambda d: np.logaddexp(0, -d), 1 / UNITS) + RIDGE / 2 * np.sum((w / UNITS) ** 2))


def derivatives(patterns: DataFrame, counts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of ``pair_loss`` by weight, and its second derivatives, these with scores taken at COARSE levels at most."""
    size, (low, n) = len(w), _lowest(w)
    n_good, n_bad = (int(c) for c in counts.sum(axis=1))
    wide = n // COARSE + 1
    few = (n - 1) // wide + 1
    good, bad = counts / counts.sum(axis=1, keepdims=True)
    miss = lambda d: _logistic(-d)
    first = [np.rint(WHOLE * t).clip(0, WHOLE) for t in (_over_pairs(bad, miss, 1 / UNITS), _over_pairs(good[::-1], miss, 1 / UNITS)[::-1])]
    slopes = _slope(np.subtract.outer(np.arange(few), np.arange(few)) * wide / UNITS)
    coarse = [np.add.reduceat(c, np.arange(0, n, wide)) for c in (good, bad)]
    second = [np.rint(WHOLE * (slopes @ other)) for other in coarse[::-1]]

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        b, sides = _bins(batch), _numbers(batch, "good", "bad")
        at = w[b].sum(axis=1) - low
        each = lambda v: np.repeat(v, N_FEATURES)
        slope = [np.bincount(b.ravel(), each(c * t[at]), size) for c, t in zip(sides, first, strict=True)]
        by_level = [np.bincount(((at // wide)[:, None] * size + b).ravel(), each(c), few * size) for c in sides]
        x = np.zeros((len(b), size))
        np.put_along_axis(x, b, 1.0, axis=1)
        square = [np.triu(x.T @ (x * (c * t[at // wide])[:, None])).ravel() for c, t in zip(sides, second, strict=True)]
        return np.concatenate([*slope, *by_level, *square])

    total = added_up(patterns, cells, 2 * size + 2 * few * size + 2 * size * size).astype(float)
    slope, by_level, square = np.split(total, [2 * size, 2 * size + 2 * few * size])
    grad = slope[size:] / WHOLE / n_bad - slope[:size] / WHOLE / n_good + RIDGE * w / UNITS
    for_good, for_bad = by_level.reshape(2, few, size)
    cross = (for_good / n_good).T @ slopes @ (for_bad / n_bad)
    square = (square[: size * size] / n_good + square[size * size :] / n_bad).reshape(size, size) / WHOLE
    return grad, square + np.triu(square, 1).T - cross - cross.T + RIDGE * np.eye(size)


def fit(train: DataFrame) -> Ranking:
    """Learn from all rows of ``train`` (x, and how many labels of each row are good and bad); with one label only, all documents rank alike, above the cut.

    Each Newton step is halved until the loss over all pairs falls; it ends, as weights are multiples of 1 / UNITS.
    """
    edges = bin_edges(train)
    patterns = stored(train.mapInArrow(_patterned(edges), "bins binary, good long, bad long").groupBy("bins").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    w = np.zeros(N_FEATURES * (BINS + 1), np.int64)
    counts = levels(patterns, w)
    if not counts.sum(axis=1).all():
        return Ranking(edges, w / UNITS, -1.0, 1.0)
    loss, last = pair_loss(counts, w), False
    while not last:
        grad, curve = derivatives(patterns, counts, w)
        step = np.linalg.solve(curve, grad)
        last = abs(grad @ step) / 2 < LEAST_GAIN
        step *= min(1, LONGEST / np.abs(step).max(initial=LONGEST))
        while True:
            moved = np.rint(w - UNITS * step).astype(np.int64)
            found = levels(patterns, moved)
            less = pair_loss(found, moved)
            if less < loss or last and less < loss + LEAST_GAIN:
                w, counts, loss = moved, found, less
                break
            if (moved == w).all():
                last = True
                break
            step = step / 2
    low, n = _lowest(w)
    good, bad = (np.concatenate(([0], np.cumsum(c))) for c in counts)
    errors = good + bad[-1] - bad  # of a cut below level k: good ones under it, bad ones from it on
    k = int(np.argmin(errors))
    others = np.flatnonzero(errors[k:] != errors[k])
    k += (int(others[0]) - 1 if len(others) else 0) // 2  # the middle of levels that part the rows alike
    level, share = np.arange(n), counts.sum(axis=0) / counts.sum()
    spread = np.sqrt(share @ (level - share @ level) ** 2) / UNITS
    return Ranking(edges, w / UNITS, (low + k - 0.5) / UNITS, float(4 / max(1e-6, spread)))


def _scored(model: Ranking) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_x(batch)), pa.float64())], ["doc_id", "score"])

    return run


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """x, good and bad of each row of ``measured`` (doc_id, x) outside the held-out fold that has labels 1 or 0: how many rows of ``labels`` say so."""
    times = lambda k: F.sum((F.col("label") == k).cast("long"))
    counted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(times(1).alias("good"), times(0).alias("bad"))
    )
    return measured.join(counted.hint("merge"), "doc_id").select("x", "good", "bad")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of each row of ``docs`` (doc_id, text); CUT_SCORE and more is good.

    Learns from all rows whose doc_id has labels 1 or 0 in ``labels`` (doc_id, quality) and is outside
    the held-out fold; rows that share an id all count, with each of its labels. Null and empty texts
    have features of 0 and are scored like any other, very long ones are measured whole; a null doc_id
    is not held out. Without labels all documents score alike, above the cut. Repeated rows score alike;
    other columns are ignored; an empty table gives an empty result. Texts are measured once and not
    shuffled; their features are stored in the checkpoint folder.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = cut(docs.mapInArrow(_measured, "doc_id long, x array<float>"))
    model = fit(stored(labelled(measured, labels)))
    return measured.mapInArrow(_scored(model), "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
