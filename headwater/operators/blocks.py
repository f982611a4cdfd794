"""Matrix work on blocks that stay in the executors: scores of queries, Gram matrices, their Cholesky factors and solutions.

Vectors of a table are packed into blocks of rows, a block being one value, so that tasks multiply matrices instead of pairs of
rows. Square matrices are tables (i, j, m) of blocks of ``BLOCK`` x ``BLOCK`` cells, of which the lower triangle is kept. What reaches the
driver is counts and the trace.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector_sums import HELD, as_lists, as_matrix, vector_sums
from ..scratch import delete, stored, stored_at

#: Query blocks are broadcast up to this size; beyond it they meet the rows in a shuffle.
MAX_QUERY_BYTES = 64 << 20
PACK_BYTES = 4 << 20
SCORES = 1 << 18  # that a task holds at a time
TILE = 1 << 21  # scores of a product that stays in its task
SLACK = 2e-9  # two units of the ninth digit
BLOCK = 1024


def packed(rows: DataFrame, names: list[str], column: str = "vec") -> DataFrame:
    """(names as arrays, m): the rows of each Arrow batch in blocks of ``PACK_BYTES``, vectors end to end. No shuffle."""
    fields = {f.name: f.dataType for f in rows.schema}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(len(names)))
                size = max(1, PACK_BYTES // max(8, 8 * x.shape[1]))
                starts = np.append(np.arange(0, len(x), size), len(x)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(starts), batch.column(k)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(pa.array(starts * x.shape[1], pa.int32()), pa.array(x.ravel()))], [*names, "m"])

    schema = ", ".join(f"{n} array<{fields[n].simpleString()}>" for n in names) + ", m array<double>"
    return rows.select(*names, F.col(column).cast("array<double>").alias("_v")).mapInArrow(run, schema)


def few_blocks(queries: DataFrame, column: str = "vec", names: tuple[str, ...] = ("query_id",)) -> tuple[DataFrame, int]:
    """Queries in as few blocks as their size asks for, and that size in bytes."""
    size = 8 * queries.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    n = max(1, -(-size // PACK_BYTES))
    dealt = queries.coalesce(1) if n == 1 else queries.repartition(n, "query_id").sortWithinPartitions("query_id")
    return packed(dealt.select(*names, column), list(names), column), size


def paired(rows: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """Every block of rows with every block of queries. The queries are broadcast after a check of their size; more of them are dealt to
    parts of that size, a block of rows goes to each part, and both meet by part and share."""
    if size <= MAX_QUERY_BYTES:
        return rows.join(F.broadcast(queries))
    parts, shares = -(-size // MAX_QUERY_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    first = lambda df: F.xxhash64(df.columns[0])
    dealt = queries.withColumn("_part", F.pmod(first(queries), F.lit(parts)).cast("int")).withColumn("_share", every(shares))
    rows = rows.withColumn("_share", F.pmod(first(rows), F.lit(shares)).cast("int")).withColumn("_part", every(parts))
    return rows.join(dealt, ["_part", "_share"]).drop("_part", "_share")


def block_scores(rows: DataFrame, queries: DataFrame, names: tuple[str, str] = ("sample_index", "source_id"), unit: str | None = None, alike: str | None = None) -> DataFrame:
    """(query_id, names, score): inner products of all rows with all queries (query_id, vec), one matrix product for each pair of
    blocks. ``names`` are a whole number and a text of the rows; ``unit`` is a number of each query that its scores are divided by, ``alike`` a text of
    each query: scores with rows of another text, or of none, change sign."""
    own = ("query_id", *(n for n in (unit, alike) if n is not None))
    q, size = few_blocks(queries, names=own)
    met = paired(packed(rows, list(names)).withColumnRenamed("m", "x"), q, size)

    def run(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                ids, samples, source = (col[n][k].values for n in ("query_id", *names))
                x, u = (col[n][k].values.to_numpy().reshape(n_rows, -1) for n, n_rows in (("x", len(samples)), ("m", len(ids))))
                step = max(1, SCORES // len(ids))  # a product of two blocks is given out in parts
                if alike is not None:
                    kinds = source.dictionary_encode()
                    code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    wanted = pc.index_in(col[alike][k].values, kinds.dictionary, skip_nulls=True).fill_null(-2).to_numpy(zero_copy_only=False)
                for lo in range(0, len(samples), step):
                    s = x[lo : lo + step] @ u.T
                    if unit is not None:
                        s /= col[unit][k].values.to_numpy()
                    if alike is not None:
                        np.negative(s, out=s, where=code[lo : lo + step, None] != wanted)
                    at = pa.array(np.repeat(np.arange(lo, lo + len(s)), len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids.to_numpy(), len(s))), samples.take(at), source.take(at), pa.array(s.ravel())], ["query_id", *names, "score"])

    return met.mapInArrow(run, f"query_id long, {names[0]} long, {names[1]} string, score double")


def _tiles(batches, names: tuple[str, ...], cells: int):
    """(key, ids, columns, x, s) of each product of blocks, s (some queries of a block x some of its rows) of ``cells`` at most; key tells the queries."""
    few = max(1, math.isqrt(cells) // 4)  # queries of a product, whatever the rows
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            ids = col["query_id"][k].values.to_numpy()
            columns = [col[n][k].values for n in names]
            x = col["x"][k].values.to_numpy().reshape(len(columns[0]), -1)
            u = col["m"][k].values.to_numpy().reshape(len(ids), -1)
            step, name = max(1, cells // few), ids.tobytes()
            for lo in range(0, len(ids), few):
                own = u[lo : lo + few]
                for at in range(0, len(x), step):
                    part = x[at : at + step]
                    yield (name, lo), ids[lo : lo + few], [c.slice(at, step) for c in columns], part, own @ part[:, : own.shape[1]].T


def block_peaks(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, peak): the largest score magnitude of each query. A task holds a number for each query and no score leaves it."""
    q, size = few_blocks(queries)
    met = paired(packed(rows, ["sample_index"]).withColumnRenamed("m", "x"), q, size)

    def run(batches):
        held: dict[tuple, list] = {}
        for key, ids, _, _, s in _tiles(batches, ("sample_index",), TILE):
            peak = np.abs(s, out=s).max(1)
            held[key] = [ids, peak if key not in held else np.maximum(held[key][1], peak)]
        for ids, peak in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(peak)], ["query_id", "peak"])

    return met.mapInArrow(run, "query_id long, peak double").groupBy("query_id").agg(F.max("peak").alias("peak"))


def block_top(rows: DataFrame, queries: DataFrame, k: int, order: str = "least") -> DataFrame:
    """Scores among which are each query's first k by score to nine digits and sample: the 'least', the 'largest' or the largest in 'magnitude'.

    A task gives out the scores of a product that reach its k-th, and no less than the k-th of any product before; of equal
    scores those of the k smallest samples. ``SLACK`` leaves room for the rounding, so ranking what is left ranks all.
    """
    q, size = few_blocks(queries)
    met = paired(packed(rows, ["sample_index", "source_id"]).withColumnRenamed("m", "x"), q, size)

    def run(batches):
        bound: dict[tuple, np.ndarray] = {}
        for key, ids, (samples, source), _, s in _tiles(batches, ("sample_index", "source_id"), TILE):
            v = -s if order == "least" else np.abs(s) if order == "magnitude" else s
            gone = np.isnan(v)  # not a number is larger than all numbers
            v[gone] = -np.inf if order == "least" else np.inf
            n = v.shape[1]
            least = np.partition(v, n - k, axis=1)[:, n - k] if n > k else np.full(len(v), -np.inf)
            if key in bound:
                least = np.maximum(least, bound[key])
            bound[key] = least
            at, row = np.nonzero(v >= (least - SLACK)[:, None])
            if len(at) > 4 * k * len(ids):  # many equal scores
                value, sample = v[at, row], samples.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[row]
                by = np.lexsort((sample, value, at))
                first = np.append(True, (np.diff(at[by]) != 0) | (value[by][1:] != value[by][:-1]))
                place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
                at, row = at[by[place < k]], row[by[place < k]]
            for lo in range(0, len(at), SCORES):
                i, j = at[lo : lo + SCORES], row[lo : lo + SCORES]
                score = np.where(gone[i, j], np.nan, s[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), samples.take(pa.array(j)), source.take(pa.array(j)), pa.array(score)], ["query_id", "sample_index", "source_id", "score"])

    return met.mapInArrow(run, "query_id long, sample_index long, source_id string, score double")


def weighted_sums(rows: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """(query_id, source_id, total): sums of the rows' ``value`` vectors by source, each times its score magnitude, the score being that of
    ``vec`` (``dim`` elements). Two matrix products for each pair of blocks; a task gives out one sum for each query and source."""
    q, size = few_blocks(queries)
    both = rows.select("source_id", F.concat("vec", "value").alias("vec"))
    met = paired(packed(both, ["source_id"]).withColumnRenamed("m", "x"), q, size)

    def run(batches):
        held: dict[tuple, list] = {}
        taken = 0

        def out():
            for (_, source), (ids, total) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([source] * len(ids), pa.string()), as_lists(total)], ["query_id", "source_id", "v"])

        for key, ids, (source,), x, s in _tiles(batches, ("source_id",), TILE):
            np.abs(s, out=s)
            names = source.dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                total = s[:, own] @ x[own, dim:]
                if (key, name) in held:
                    held[key, name][1] += total
                else:
                    held[key, name] = [ids, total]
                    taken += total.nbytes
            if taken > HELD:
                yield from out()
                held, taken = {}, 0
        yield from out()

    sums = met.mapInArrow(run, "query_id long, source_id string, v array<double>")
    return vector_sums(sums, ["query_id", "source_id"], "v").select("query_id", "source_id", "total")


def gram_blocks(gradients: DataFrame, dim: int) -> DataFrame:
    """(i, j, m): blocks of the dim x dim matrix of inner products of columns, i >= j. A task adds the products of its batches."""
    edges = [*range(0, dim, BLOCK), dim]

    def partial(batches):
        g = None
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0), dim)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            for i in range(len(edges) - 1):
                for j in range(i + 1):
                    cells = g[edges[i] : edges[i + 1], edges[j] : edges[j + 1]].reshape(1, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), as_lists(cells)], ["i", "j", "m"])

    parts = gradients.select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(partial, "i int, j int, m array<double>")
    # blocks on the edge are narrower, but those of one place are alike
    return vector_sums(parts, ["i", "j"], "m").select("i", "j", F.col("total").alias("m"))


def _mapped(df: DataFrame, make, *names: str) -> DataFrame:
    """(i, j, m) with m computed from the matrices in ``names``, row by row: each is a block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                m = make(*(batch.column(n)[k].values.to_numpy() for n in names))
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(k, 1), batch.column("j").slice(k, 1), as_lists(m.reshape(1, -1))], ["i", "j", "m"])

    return df.select("i", "j", *names).mapInArrow(run, "i int, j int, m array<double>")


def factor(gram: DataFrame, dim: int, damping: float = 1e-3, floor: float = 0.0) -> DataFrame:
    """(i, j, m): the Cholesky factor of the damped matrix, lambda = damping * trace / dim and at least ``floor``. Block columns come one
    after another: the diagonal block, the panel below it, then what the panel takes from the blocks to the right."""
    spark, n = gram.sparkSession, -(-dim // BLOCK)
    width = lambda v, rows: v.reshape(rows, -1)
    square = lambda v: v.reshape(round(len(v) ** 0.5), -1)
    left, path = stored_at(gram, "gram")
    parts = _mapped(left.filter("i = j"), lambda m: np.array([[np.trace(square(m))]]), "m")
    trace = parts.agg(F.sum(F.col("m")[0])).first()[0] or 0.0
    shift = max(damping * trace / dim, floor)
    done = None
    for s in range(n):
        # lambda joins a diagonal block when it is its turn: no earlier step looks at the diagonal alone
        chol = lambda m: np.linalg.cholesky(square(m) + shift * np.eye(round(len(m) ** 0.5)))
        own = stored(_mapped(left.filter((F.col("i") == s) & (F.col("j") == s)), chol, "m"), "factor")
        done = own if done is None else done.unionByName(own)
        if s + 1 == n:
            break
        below = left.filter((F.col("j") == s) & (F.col("i") > s)).join(F.broadcast(own.select(F.col("m").alias("d"))))  # one block
        panel = stored(_mapped(below, lambda m, d: np.linalg.solve(square(d), width(m.reshape(-1, round(len(d) ** 0.5)).T, round(len(d) ** 0.5))).T, "m", "d"), "factor")
        done = done.unionByName(panel)
        a, b = (panel.select(F.col("i").alias(name), F.col("m").alias(m)) for name, m in (("i", "a"), ("j", "b")))
        rest = left.filter(F.col("j") > s).join(a, "i").join(b, "j")
        inner = BLOCK  # every block column but the last is whole
        rest, new = stored_at(_mapped(rest, lambda m, a, b: m - (width(a, len(a) // inner) @ width(b, len(b) // inner).T).ravel(), "m", "a", "b"), "gram")
        delete(spark, path)
        left, path = rest, new
    return done


def solved(queries: DataFrame, lower: DataFrame, dim: int, back: bool = True, names: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(names, vec): each vector times the inverse of the factored matrix (``back`` false: of its factor alone, whose squared norm is the quadratic
    form). Chunks of vectors stay in their task while the factor's blocks pass by in the order of substitution."""
    n = -(-dim // BLOCK)
    fields = {f.name: f.dataType.simpleString() for f in queries.schema}
    numbered = packed(queries, list(names)).withColumn("chunk", F.monotonically_increasing_id())
    chunks, _ = stored_at(numbered, "chunks")
    i, j = F.col("i"), F.col("j")
    forward = lower.withColumn("step", i * n + j)
    steps = forward.unionByName(lower.withColumn("step", F.lit(n * n) + (n - 1 - j) * n + (n - 1 - i))) if back else forward
    each = chunks.select("chunk").join(F.broadcast(steps.select("step", "i", "j"))).join(steps.drop("i", "j"), "step")  # places of blocks: n * n rows
    own = chunks.select("chunk", F.lit(-1).alias("step"), F.lit(0).alias("i"), F.lit(0).alias("j"), "m", *names)
    both = own.unionByName(each, allowMissingColumns=True)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "step").select("step", "i", "j", "m", *names)
    edges = [*range(0, dim, BLOCK), dim]

    def run(batches):
        x, ids = None, []
        out = lambda: pa.RecordBatch.from_arrays([*ids, as_lists(x)], [*names, "vec"])
        for batch in batches:
            col = [batch.column(k) for k in range(3)]
            for k in range(batch.num_rows):
                step, i, j = (c[k].as_py() for c in col)
                m = batch.column(3)[k].values.to_numpy()
                if step < 0:
                    if x is not None:
                        yield out()
                    x, ids = m.reshape(-1, dim).copy(), [batch.column(4 + a)[k].values for a in range(len(names))]
                    continue
                m = m.reshape(edges[i + 1] - edges[i], -1)
                rows, cols = slice(edges[i], edges[i + 1]), slice(edges[j], edges[j + 1])
                if step < n * n:  # y L' = x
                    x[:, rows] = np.linalg.solve(m, x[:, rows].T).T if i == j else x[:, rows] - x[:, cols] @ m.T
                else:  # z L = y
                    x[:, cols] = np.linalg.solve(m.T, x[:, cols].T).T if i == j else x[:, cols] - x[:, rows] @ m
        if x is not None:
            yield out()

    return dealt.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in names) + ", vec array<double>")
