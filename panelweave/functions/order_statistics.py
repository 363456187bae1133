"""Sliding quantiles at a cost a row that does not grow with the window.

A window function sorts every frame anew. Here each run of rows builds one wavelet matrix over the ranks of its
values, and every frame finds its order statistics by one step for each bit of a rank, all frames at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .cross_section import _col
from .long_series import with_running

#: Rows for which one matrix is built at least, so that the frames that reach back into earlier rows weigh little.
RUN_ROWS = 65_536
_VALUE, _PLACE, _PART, _OWN, _SPAN = "__q_value", "__q_place", "__q_part", "__q_own", "__q_span"


def kth_smallest(values: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of each range values[start:end], its k-th smallest value (k from 0); NaN is the largest."""
    order = np.argsort(values, kind="stable")
    code = np.empty(len(values), np.int64)
    code[order] = np.arange(len(values))
    lo, hi, k, rank = start, end, k, np.zeros(len(k), np.int64)
    for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        one = (code >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        a, b = zeros[lo], zeros[hi]
        right = k >= b - a
        rank |= right.astype(np.int64) << bit
        k = np.where(right, k - (b - a), k)
        lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
        code = np.concatenate((code[~one], code[one]))
    return values[order[rank]]


def _quantiles(x: np.ndarray, whole: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, quantiles: Sequence[float]) -> list[pa.Array]:
    """For each quantile its values over x[start:end], linear between neighbours; null below ``least`` values that are not null."""
    upto = np.concatenate(([0], np.cumsum(whole)))
    lo, hi = upto[start], upto[end]
    enough = hi - lo >= max(least, 1)
    lo, hi, values = lo[enough], hi[enough], x[whole]
    at = np.concatenate([(hi - lo - 1) * q for q in quantiles])
    below, above = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    times = 2 * len(quantiles)
    low, high = np.split(kth_smallest(values, np.tile(lo, times), np.tile(hi, times), np.concatenate((below, above))), 2) if len(lo) else (at, at)
    with np.errstate(invalid="ignore"):
        found = np.where((below == above) | (low == high), low, (above - at) * low + (at - below) * high)
    out = []
    for part in np.split(found, len(quantiles)):
        full = np.zeros(len(enough))
        full[enough] = part
        out.append(pa.array(full, mask=~enough))
    return out


def _slide(names: Sequence[str], schema: pa.Schema, d: int, least: int, quantiles: Sequence[float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, tail_whole = np.empty(0), np.empty(0, bool)  # the last d - 1 rows of what went before
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal tail, tail_whole, waiting, rows
            table = pa.Table.from_batches(waiting)
            value = table.column(_VALUE)
            whole = np.concatenate((tail_whole, value.is_valid().to_numpy()))
            x = np.concatenate((tail, value.fill_null(0.0).to_numpy()))
            own = table.column(_OWN).to_numpy().astype(bool)
            end = np.arange(len(tail) + 1, len(x) + 1)[own]
            found = _quantiles(x, whole, end - table.column(_SPAN).to_numpy()[own], end, least, quantiles)
            kept = table.select(names).filter(pa.array(own))
            keep = min(d - 1, len(x))
            tail, tail_whole, waiting, rows = x[len(x) - keep :], whole[len(x) - keep :], [], 0
            yield from pa.Table.from_arrays([*kept.columns, *found], schema=pa.schema([*kept.schema, *schema])).to_batches()

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(RUN_ROWS, 4 * d):
                yield from finish()
        if rows:
            yield from finish()

    return run


def with_quantiles(df: DataFrame, x: Column | str, d: int, quantiles: Mapping[str, float], least: int | None = None, sym: str = "sym", date: str = "date", tie: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """``df`` with a column for each quantile (0 to 1) of the last ``d`` rows' values of ``x``, in the order of date and ``tie``.

    Values are those of ``ts_quantile``: doubles, linear between neighbours, null where fewer than ``least`` (by default
    ``d``) values of the frame are not null; NaN counts as the largest value. A task holds ``RUN_ROWS`` or 5 ``d`` rows at a
    time, whichever is more. With ``block_rows``, symbols of more rows are spread over tasks by blocks, each of which also
    gets the ``d`` - 1 rows before it.
    """
    if d < 1 or not quantiles or any(not 0 <= q <= 1 for q in quantiles.values()):
        raise ValueError("a window of at least one row and quantiles from 0 to 1 are needed")
    names = [c for c in df.columns if c not in quantiles]
    rows = df.withColumn(_VALUE, _col(x).cast("double"))
    if block_rows is None:
        ordered = rows.withColumn(_PLACE, F.row_number().over(Window.partitionBy(sym).orderBy(date, *tie))).withColumn(_OWN, F.lit(True)).sortWithinPartitions(sym, date, *tie)
    else:
        size = max(block_rows, d)
        rows = with_running(rows, {_PLACE: F.lit(1).cast("long")}, sym=sym, date=date, tie=tie, block_rows=block_rows)
        at = F.col(_PLACE) - 1
        part = F.floor(at / size)
        piece = lambda p, own: F.struct(p.alias(_PART), F.lit(own).alias(_OWN))
        pieces = F.when(at % size > size - d, F.array(piece(part, True), piece(part + 1, False))).otherwise(F.array(piece(part, True)))
        dealt = rows.withColumn("__q", F.explode(pieces)).withColumns({_PART: F.col(f"__q.{_PART}"), _OWN: F.col(f"__q.{_OWN}")}).drop("__q")
        ordered = dealt.repartition(sym, _PART).sortWithinPartitions(sym, _PART, _PLACE)
    span = F.when(F.col(_OWN), F.least(F.col(_PLACE), F.lit(d))).otherwise(0).cast("long")
    ready = ordered.select(*names, _VALUE, _OWN, span.alias(_SPAN))
    fields = [StructField(n, DoubleType()) for n in quantiles]
    run = _slide(names, pa.schema([(n, pa.float64()) for n in quantiles]), d, d if least is None else least, list(quantiles.values()))
    return ready.mapInArrow(run, StructType([*(df.schema[c] for c in names), *fields]))
