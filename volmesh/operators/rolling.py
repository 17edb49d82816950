"""Running medians of sorted series. Rows pass through Arrow batches in order; between batches only the last few values of a series are held, never a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row begins a series; last: the key of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        new[1:] |= ~pc.coalesce(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    new[0] = tuple(batch.column(k)[0].as_py() for k in keys) != last
    return new


def running(values: np.ndarray, new: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians of the last `size` values of each series, their number, and what the next batch needs of the last series. before: the same of the batch before, which the first series goes on from unless it is new."""
    every = np.concatenate([before, values])
    at = np.arange(len(every))
    begin = np.maximum.accumulate(np.where(np.concatenate([np.zeros(len(before), bool), new]), at, 0))
    n = np.minimum(at - begin + 1, size)
    frame = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), every]), size)
    frame = np.sort(np.where(np.arange(size) >= size - n[:, None], frame, np.nan), axis=1)
    middle = 0.5 * frame[at, (n - 1) // 2] + 0.5 * frame[at, n // 2]
    return middle[len(before) :], n[len(before) :], every[max(begin[-1], len(every) - size + 1) :]


def medians(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, size: int, least: Column, band: tuple[str, float] | None = None) -> DataFrame:
    """keys, order and `name`: the median of the last `size` values of a series (keys) in order, where there are at least `least`. band (column, width): rows whose column is more than width off a first
    running median leave before."""
    columns = [*keys, *order]
    out = StructType([StructField(c, rows.schema[c].dataType) for c in columns] + [StructField(name, DoubleType())])
    level, width = band or (None, None)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, second = None, np.empty(0), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts(batch, keys, last)
            values, enough = (batch.column(c).to_numpy(zero_copy_only=False) for c in (value, "_least"))
            taken = np.arange(len(values))
            if level:
                rough, _, first = running(values, new, first, size)
                taken = np.flatnonzero(np.abs(batch.column(level).to_numpy(zero_copy_only=False) / rough - 1) <= width)
            series = np.cumsum(new)  # 0: that of the batch before
            if len(taken):
                of = series[taken]
                middle, n, second = running(values[taken], np.diff(of, prepend=0) > 0, second, size)
                good = n >= enough[taken]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(taken[good])) for c in columns], pa.array(middle[good])], [*columns, name])
            if series[-1] != (series[taken[-1]] if len(taken) else 0):
                second = np.empty(0)
            last = tuple(batch.column(k)[-1].as_py() for k in keys)

    used = rows.withColumn("_least", least.cast("long")).select(*dict.fromkeys([*columns, value, *([level] if level else []), "_least"]))
    return used.repartition(*keys).sortWithinPartitions(*columns).mapInArrow(stream, out)
