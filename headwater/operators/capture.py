"""Recording the operations that make a DataFrame, as nodes and edges.

A ``TrackedFrame`` wraps a DataFrame; its methods return wrapped results and note one node and one edge each. The
record is a handful of rows on the driver (one for each call, not for each datum) and becomes two DataFrames.
``level`` 'none' records nothing, 'op' records operations, 'row' also keeps each row's source and number.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


class Recorder:
    def __init__(self, level: str = "op"):
        if level not in ("none", "op", "row"):
            raise ValueError(f"unknown level {level!r}")
        self.level = level
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self._node, self._edge = itertools.count(), itertools.count()

    def node(self, df: DataFrame, meta: dict | None = None) -> int | None:
        if self.level == "none":
            return None
        i = next(self._node)
        self.nodes.append((i, [len(df.columns)], df.schema.simpleString(), time.monotonic_ns(), meta or {}))
        return i

    def edge(self, op: str, inputs: list, output: int | None, sources: set, meta: dict | None = None) -> None:
        tracked = [i for i in inputs if i is not None]
        if output is not None and tracked:
            self.edges.append((next(self._edge), op, tracked, output, time.monotonic_ns(), meta or {}, sorted(sources)))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.nodes, model.NODES), spark.createDataFrame(self.edges, model.EDGES)


class TrackedFrame:
    """A DataFrame with its node. Views (select, where, rename, cast) stay on their parent's node; computing
    operations make a new one. Source ids of an edge are those of its direct inputs."""

    def __init__(self, df: DataFrame, recorder: Recorder, source_id: str | None = None, node: int | None = None):
        self.df, self.recorder, self.source_id = df, recorder, source_id
        self.node = recorder.node(df, {"source_id": source_id} if source_id else None) if node is None else node
        if recorder.level == "row" and source_id and "_row" not in df.columns:
            self.df = df.withColumn("_row", F.struct(F.lit(source_id).alias("source"), F.monotonically_increasing_id().alias("row_id")))

    def _made(self, op: str, df: DataFrame, others: tuple = (), meta: dict | None = None) -> TrackedFrame:
        inputs = [self, *others]
        out = TrackedFrame(df, self.recorder, None, self.recorder.node(df))
        self.recorder.edge(op, [t.node for t in inputs], out.node, {t.source_id for t in inputs if t.source_id}, meta)
        return out

    def _view(self, df: DataFrame) -> TrackedFrame:
        return TrackedFrame(df, self.recorder, self.source_id, self.node)

    def select(self, *cols) -> TrackedFrame:
        return self._view(self.df.select(*cols))

    def where(self, condition) -> TrackedFrame:
        return self._view(self.df.where(condition))

    def with_column(self, name: str, value: Column, op: str = "compute") -> TrackedFrame:
        return self._made(op, self.df.withColumn(name, value), meta={"column": name})

    def join(self, other: TrackedFrame, on, how: str = "inner") -> TrackedFrame:
        return self._made("join", self.df.join(other.df, on, how), (other,), {"how": how})

    def union(self, other: TrackedFrame) -> TrackedFrame:
        return self._made("concatenate", self.df.unionByName(other.df), (other,))

    def rename(self, names: dict[str, str]) -> TrackedFrame:
        return self._view(self.df.withColumnsRenamed(names))

    def cast(self, kinds: dict[str, str]) -> TrackedFrame:
        return self._view(self.df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}))

    def apply(self, op: str, f: Callable[..., DataFrame], *others, **named) -> TrackedFrame:
        """Any function of DataFrames, reductions among them; only tracked inputs are noted, wherever they stand in lists, tuples, sets
        and dictionaries of arguments, each as often as it is there."""
        return self._made(op, f(self.df, *unwrapped(list(others)), **unwrapped(named)), tuple(tracked_in([others, named])))

    def apply_many(self, op: str, f: Callable[[DataFrame], tuple[DataFrame, ...]]) -> tuple[TrackedFrame, ...]:
        """A function with several results: each has its node, and an edge from this one."""
        return tuple(self._made(op, df, meta={"output": str(i)}) for i, df in enumerate(f(self.df)))

    def beside(self, other: TrackedFrame, on: str | list[str]) -> TrackedFrame:
        """Columns of both by row key."""
        return self._made("concatenate", self.df.join(other.df, on), (other,), {"axis": "1"})

    def stack(self, columns: list[str], name: str = "stacked") -> TrackedFrame:
        """Columns along a new axis."""
        from .etl import stack

        return self._made("stack", stack(self.df, columns, name), meta={"columns": ",".join(columns)})

    def aggregate(self, keys: list[str], *aggs: Column, op: str = "aggregate") -> TrackedFrame:
        return self._made(op, self.df.groupBy(*keys).agg(*aggs), meta={"keys": ",".join(keys)})

    def standardise(self, columns: list[str]) -> TrackedFrame:
        from .etl import standardise

        return self._made("standardise", standardise(self.df, columns), meta={"columns": ",".join(columns)})


def tracked_in(value) -> Iterator[TrackedFrame]:
    """The tracked frames in nested arguments, in their order."""
    if isinstance(value, TrackedFrame):
        yield value
    elif isinstance(value, Mapping):
        yield from tracked_in(list(value.values()))
    elif isinstance(value, (list, tuple, set, frozenset)):
        for v in value:
            yield from tracked_in(v)


def unwrapped(value):
    """The same arguments with plain DataFrames in place of tracked ones."""
    if isinstance(value, TrackedFrame):
        return value.df
    if isinstance(value, Mapping):
        return {k: unwrapped(v) for k, v in value.items()}
    if isinstance(value, tuple) and hasattr(value, "_fields"):
        return type(value)(*map(unwrapped, value))
    return type(value)(map(unwrapped, value)) if isinstance(value, (list, tuple, set, frozenset)) else value


def normal_op_name(op):
    """One name for operations that libraries call differently."""
    names = {"true_divide": "divide", "floor_divide": "divide", "absolute": "abs"}
    out = op
    for old, new in names.items():
        out = F.when(op == old, F.lit(new)).otherwise(out)
    return out
