"""Sums of vectors by group: NumPy partial sums in every task, merged by key.

One SQL aggregate for each element costs a column each; here a vector stays one value. A task adds the vectors of each of its groups and
gives one row a group, so a group of any size leaves a task as one row. Rows of a group are then merged in one pass over sorted
partitions. Beyond ``FAN`` input partitions a first merge runs inside ``FAN`` shares of each group, so that no task merges more
than ``FAN`` rows of a group at a time than its share brings: a tree of two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256
#: Bytes of sums that a task holds before it gives them out; groups that come again are merged later.
HELD = 64 << 20


def as_matrix(v, dim: int | None = None) -> np.ndarray:
    """An Arrow column of vectors of one width as rows of a matrix. Nulls and wrong widths raise."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if not len(v):
        return np.zeros((0, dim or 0))
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    dim = len(flat) // len(v) if dim is None else dim
    widths = v.value_lengths().to_numpy(zero_copy_only=False)
    if v.null_count or (widths != dim).any():
        raise ValueError(f"vectors have {sorted(set(widths.tolist()))} elements or are null; {dim} are taken")
    return flat.reshape(len(v), dim)


def as_lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def _lists(vectors: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, vectors)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(vectors)))


def _groups(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each row's group, and the first row of each group."""
    code = np.zeros(len(keys[0]) if keys else 0, np.int64)
    for k in keys:
        own = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return np.unique(code, return_index=True, return_inverse=True)[1:][::-1]


def _added(by: int, ordered: bool):
    """Sums by the first ``by`` columns of (keys, n, least, vec). Ordered rows have each group together."""

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def out():
            rows = list(held.values())
            keys = [pa.concat_arrays([r[0][k] for r in rows]) for k in range(by)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), _lists([r[3] for r in rows])], names)

        def add(batch) -> int:
            """Adds the rows of a batch, whose vectors have one width, to what is held; the bytes that are new."""
            x, more = as_matrix(batch.column(by + 2)), 0
            keys = [batch.column(k) for k in range(by)]
            code, first = _groups(keys) if by else (np.zeros(len(x), np.int64), np.zeros(1, np.int64))
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(first)))
            sums = np.add.reduceat(x[order], starts)
            n = np.add.reduceat(batch.column(by).to_numpy()[order], starts).tolist()
            least = batch.column(by + 1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            least = np.minimum.reduceat(least[order], starts).tolist()
            for at, count, low, total in zip(first.tolist(), n, least, sums, strict=True):
                low = None if low == np.iinfo(np.int64).max else low
                key = [k.slice(at, 1) for k in keys]
                name = tuple(k[0].as_py() for k in key)
                if name in held:
                    old = held[name]
                    if len(old[3]) != len(total):
                        raise ValueError(f"vectors of one group have {len(old[3])} and {len(total)} elements or are null")
                    old[1], old[2], old[3] = old[1] + count, low if old[2] is None else old[2] if low is None else min(low, old[2]), old[3] + total
                else:
                    held[name] = [key, count, low, total]
                    more += total.nbytes
            return more

        for batch in batches:
            names = batch.schema.names
            if not batch.num_rows:
                continue
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(by))
            widths = batch.column(by + 2).value_lengths().to_numpy(zero_copy_only=False)
            kinds = np.unique(widths)  # groups may differ in width
            size += sum(add(batch if len(kinds) == 1 else batch.filter(pa.array(widths == w))) for w in kinds)
            if size > HELD:
                rest = {last: held.pop(last)} if ordered else {}
                if held:
                    yield out()
                held, size = rest, sum(r[3].nbytes for r in rest.values())
        if held:
            yield out()

    return run


def vector_sums(df: DataFrame, by: list[str], column: str, least: str | None = None) -> DataFrame:
    """(by, n, least, total): how many rows each group has, the least value of a whole-number column, and the sum of its vectors.

    No ``by`` gives one row, none for an empty table. Keys may be null. Vectors of a group must have one width; nulls raise.
    """
    value = F.lit(None).cast("long") if least is None else F.col(least).cast("long")
    rows = df.select(*by, F.lit(1).cast("long").alias("n"), value.alias("least"), F.col(column).cast("array<double>").alias("total"))
    many = df.rdd.getNumPartitions() > FAN
    parts = rows.mapInArrow(_added(len(by), False), rows.schema)
    if many:
        parts = parts.withColumn("_share", F.spark_partition_id() % FAN)
        parts = parts.repartition(*by, "_share").select(*rows.columns).mapInArrow(_added(len(by), False), rows.schema)
    dealt = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.coalesce(1)
    return dealt.mapInArrow(_added(len(by), True), rows.schema)


def vector_means(df: DataFrame, by: list[str], column: str, least: str | None = None) -> DataFrame:
    """(by, n, least, mean)."""
    mean = F.transform("total", lambda x: x / F.col("n")).alias("mean")
    return vector_sums(df, by, column, least).select(*by, "n", "least", mean)
