"""What needs all scores of a query at a time: effects of samples by membership in subsets against the scores, medians by source, and what sources
have of the strongest scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector_sums import as_lists, as_matrix, vector_sums
from ..scratch import stored
from .blocks import block_scores, few_blocks, packed, paired

#: Scores that a task holds: 8 bytes each.
CELLS = 48 << 20
BLOCK_ROWS = 4096
#: Strongest scores that a task keeps, as many again while it looks for them: 24 bytes each.
KEPT = 2 << 20
TILE = 1 << 20  # scores of a product, of one row at least
PIECE = 1 << 17  # the same where several passes over them follow
#: Bins that a pass over all scores counts between a median's bounds, scores between bounds that need no further pass, and passes at most.
BINS, FEW, ROUNDS = 64, 256, 5
HOLD = 256 << 20  # bytes of counts in a task, which go out in parts beyond it


def array_ranks(values: Column) -> Column:
    """Ranks from 1 of an array's values, ties averaged. Quadratic in its length: for a few subsets."""
    below = lambda x: F.size(F.filter(values, lambda y: y < x))
    return F.transform(values, lambda x: (below(x) + (F.size(F.filter(values, lambda y: y == x)) + 1) / 2.0).cast("float"))


def subset_sums(samples: DataFrame) -> DataFrame:
    """(subset, n, total): how many samples each subset has, and the sum of their vectors. ``samples`` is (subsets, vec), subsets being whole numbers; a
    vector is added to all of its subsets inside its task, so no row is made for a sample and a subset."""

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lists = as_matrix(batch.column(1)), batch.column(0)
            row = np.repeat(np.arange(len(x)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ids, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            total = np.zeros((len(ids), x.shape[1]))
            if np.isfinite(x).all():
                step = max(1, TILE // max(1, len(ids)))
                for lo in range(0, len(x), step):
                    own = slice(*np.searchsorted(row, (lo, lo + step)))
                    times = np.zeros((len(ids), len(x[lo : lo + step])))
                    np.add.at(times, (code[own], row[own] - lo), 1.0)
                    total += times @ x[lo : lo + step]
            else:  # nothing times infinity is not nothing: only a sample's own subsets have it
                np.add.at(total, code, x[row])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.bincount(code, minlength=len(ids)), pa.int64()), as_lists(total)], ["subset", "_times", "vec"])

    parts = samples.select(F.col("subsets").cast("array<long>"), F.col("vec").cast("array<double>")).mapInArrow(partial, "subset long, _times long, vec array<double>")
    both = parts.select("subset", F.concat(F.array(F.col("_times").cast("double")), "vec").alias("vec"))
    sums = vector_sums(both, ["subset"], "vec")
    return sums.select("subset", F.col("total")[0].cast("long").alias("n"), F.slice("total", 2, F.size("total") - 1).alias("total"))


def subset_outcomes(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, subset, n, score): how many scores the samples of each subset (``subset_sums``) have with each query, and their sum. A sum of inner products is the
    product with the sum of the vectors: no score of a single sample is made. A query that was asked twice has all of its scores twice."""
    sums = subset_sums(samples)
    made = block_scores(sums.select("subset", F.col("n").cast("string").alias("n"), F.col("total").alias("vec")), queries, ("subset", "n"))
    return made.groupBy("query_id", "subset").agg(F.sum(F.col("n").cast("long")).alias("n"), F.sum("score").alias("score"), F.count("*").alias("times"))


def half_up(x: np.ndarray, digits: int = 9) -> np.ndarray:
    unit = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x) + 0.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, code, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[code]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows less their mean, of length 1; a constant row is zeros."""
    x = x.astype(np.float64)
    x = x - x.mean(1, keepdims=True)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def membership_lds(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rho): the rank correlation over samples of scores with effects, an effect being that of the sample's membership with the query's
    outcome over subsets; both are rounded to nine digits, and an undefined correlation is 0.

    ``samples`` is (vec, ranks), ``queries`` (query_id, vec, ranks): vectors, whose products are the scores, and ranks over the same subsets. Queries are dealt to
    parts, and the samples' vectors go to each part in blocks: a task holds the scores of one part, ``CELLS`` at most (of one query at least), ranks them
    and gives out one number for each query. No score is shuffled.
    """
    spark = samples.sparkSession
    parts = max(-(-samples.count() * queries.count() // CELLS), spark.sparkContext.defaultParallelism)

    def packed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(lo, BLOCK_ROWS)
                flat = [c.flatten() for c in own.columns]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(f)], pa.int32()), f) for f in flat], ["vec", "ranks"])

    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    blocks = samples.select("vec", "ranks").mapInArrow(packed, f"vec {kinds['vec']}, ranks {kinds['ranks']}")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = blocks.select(every.alias("part"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("query_id"), "vec", "ranks")
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("step"), "query_id", F.col("vec").cast(kinds["vec"]).alias("vec"), F.col("ranks").cast(kinds["ranks"]).alias("ranks"))
    dealt = asked.unionByName(rows).repartition(parts, "part").sortWithinPartitions("part", "step")

    def run(batches):
        part, ids, u, o, scores, ranks = None, [], [], [], [], []

        def out():
            found, effect_of = [], _unit_rows(np.stack(o)) if o else None
            for q in sorted(set(ids)):
                own = [k for k, i in enumerate(ids) if i == q]
                effect = half_up(np.concatenate([r @ effect_of[own[0]] for r in ranks]))
                x = np.concatenate([s[:, k] for k in own for s in scores])
                pair = _unit_rows(np.stack([average_ranks(half_up(x)), average_ranks(np.tile(effect, len(own)))]))
                found.append((q, float(pair[0] @ pair[1])))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["query_id", "rho"])

        for batch in batches:
            for k in range(batch.num_rows):
                p, step, query_id = (batch.column(c)[k].as_py() for c in range(3))
                vec, rank = (batch.column(c)[k].values.to_numpy() for c in (3, 4))
                if p != part:
                    if scores and ids:
                        yield out()
                    part, ids, u, o, scores, ranks = p, [], [], [], [], []
                if step == 0:
                    ids.append(query_id)
                    u.append(vec.astype(np.float64))
                    o.append(rank)
                elif ids:
                    scores.append(vec.reshape(-1, len(u[0])).astype(np.float64) @ np.stack(u).T)
                    ranks.append(_unit_rows(rank.reshape(-1, len(o[0]))))
        if scores and ids:
            yield out()

    return dealt.mapInArrow(run, "query_id long, rho double")


def _by_source(batches):
    """(key, ids, names, bounds, at, source, s) of products of some queries of a block, from ``at`` on, with rows of one source, ``PIECE`` cells or one query at most;
    bounds are what the block's queries carry behind their vectors, key tells the block."""
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            ids = col["query_id"][k].values.to_numpy()
            names = col["names"][k].values[0].as_py() if "names" in col else []
            coded = col["source_id"][k].values.dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            x = col["x"][k].values.to_numpy().reshape(len(code), -1)
            m = col["m"][k].values.to_numpy().reshape(len(ids), -1)
            dim = m.shape[1] - 2 * len(names)
            if x.shape[1] != dim:
                raise ValueError(f"vectors have {x.shape[1]} elements, queries {dim}")
            u, bounds, key = np.ascontiguousarray(m[:, :dim]), m[:, dim:], ids.tobytes()
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for j, source in enumerate(coded.dictionary.to_pylist()):
                for first in range(ends[j], ends[j + 1], BLOCK_ROWS):
                    own = x[order[first : min(first + BLOCK_ROWS, ends[j + 1])]].T
                    few = max(1, PIECE // own.shape[1])
                    for at in range(0, len(ids), few):
                        with np.errstate(invalid="ignore", over="ignore"):
                            s = u[at : at + few] @ own
                        yield key, ids, names, bounds, at, source, s


def _spread(batches):
    """(query_id, source, neg, fin, pos, nan, mn, mx, total, squares): how many scores are which kind of number, and what the finite ones are."""
    held: dict[tuple, tuple] = {}
    kinds = ["neg", "fin", "pos", "nan"]

    def out():
        for (_, source), (ids, n, v) in held.items():
            columns = [pa.array(ids), pa.array([source] * len(ids), pa.string()), *map(pa.array, n), *map(pa.array, v)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "source", *kinds, "mn", "mx", "total", "squares"])

    for key, ids, _, _, at, source, s in _by_source(batches):
        if (key, source) not in held:
            if sum(96 * len(h[0]) for h in held.values()) > HOLD:
                yield from out()
                held = {}
            held[key, source] = ids, np.zeros((4, len(ids)), np.int64), np.stack([np.full(len(ids), w) for w in (np.inf, -np.inf, 0.0, 0.0)])
        _, n, v = held[key, source]
        own = slice(at, at + len(s))
        low, high = s.min(1), s.max(1)
        if np.isfinite(low).all() and np.isfinite(high).all():
            n[1, own] += s.shape[1]
        else:
            finite = np.isfinite(s)
            n[:, own] += np.stack([(s == -np.inf).sum(1), finite.sum(1), (s == np.inf).sum(1), np.isnan(s).sum(1)])
            low, high, s = np.where(finite, s, np.inf).min(1), np.where(finite, s, -np.inf).max(1), np.where(finite, s, 0.0)
        v[0, own], v[1, own] = np.minimum(v[0, own], low), np.maximum(v[1, own], high)
        with np.errstate(over="ignore", invalid="ignore"):
            v[2, own] += s.sum(1)
            v[3, own] += np.einsum("ij,ij->i", s, s)
    yield from out()


def _unit(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bins in a unit between bounds; a bit less, so that the upper bound is in the last bin. 0 where they cannot be divided."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        unit = BINS / (hi - lo) * (1 - 1e-12)
    return np.where(np.isfinite(unit) & (hi > lo), unit, 0.0)


def _counted(batches):
    """(query_id, v): for each source of the block how many scores are below the bounds, in each bin between them, and above."""
    held: dict[bytes, tuple] = {}
    width = BINS + 2

    def out():
        for ids, n, _ in held.values():
            for lo in range(0, len(ids), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 1024]), as_lists(n[lo : lo + 1024].reshape(len(ids[lo : lo + 1024]), -1).astype(np.float64))], ["query_id", "v"])

    for key, ids, names, bounds, at, source, s in _by_source(batches):
        if key not in held:
            if sum(h[1].nbytes for h in held.values()) > HOLD:
                yield from out()
                held = {}
            held[key] = ids, np.zeros((len(ids), len(names), width), np.int32), _unit(bounds[:, : len(names)], bounds[:, len(names) :])
        _, n, unit = held[key]
        k, own = names.index(source), slice(at, at + len(s))
        s -= bounds[own, k, None]
        s *= unit[own, k, None]
        s += 1.0
        np.fmax(np.fmin(s, BINS + 1.0, out=s), 0.0, out=s)  # what is not a number counts as above
        s += (np.arange(len(s)) * width)[:, None]
        n[own, k] += np.bincount(s.astype(np.int64).ravel(), minlength=len(s) * width).reshape(len(s), width).astype(np.int32)
    yield from out()


def _narrowed(batches):
    """The bounds around the bin that has the rank, and whether that bin still has more than ``FEW`` scores."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lo, hi, rank, active, mn, mx, slack = (as_matrix(batch.column(c)) for c in ("lo", "hi", "rank", "active", "mn", "mx", "slack"))
        n = as_matrix(batch.column("total")).reshape(*lo.shape, BINS + 2)
        unit = _unit(lo, hi)
        at = np.minimum((np.cumsum(n, 2) <= rank[:, :, None]).sum(2), BINS + 1)
        inside = np.take_along_axis(n, at[:, :, None], 2)[:, :, 0]
        step = np.divide(1.0, unit, out=np.zeros_like(unit), where=unit > 0)
        low = np.where(at == 0, mn, np.where(at > BINS, hi, lo + (at - 1) * step) - slack)
        high = np.where(at > BINS, mx, np.where(at == 0, lo, lo + at * step) + slack)
        go = (active > 0) & (unit > 0)
        low, high = np.where(go, np.maximum(low, mn), lo), np.where(go, np.minimum(high, mx), hi)
        go &= (inside > FEW) & (high > low)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("names"), *map(as_lists, (low, high, rank, go.astype(np.float64), mn, mx, slack))], ["query_id", "names", "lo", "hi", "rank", "active", "mn", "mx", "slack"])


def _inside(batches):
    """(query_id, source, below, above, v, times): how many scores are below the bounds, the least above them, and the distinct ones between with their numbers."""
    held: dict[tuple, list] = {}
    size = 0

    def out():
        for (_, source), (ids, below, above, found) in held.items():
            at, v = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in (0, 1))
            by = np.lexsort((v, at))
            at, v = at[by].astype(np.int64), v[by]
            first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (v[1:] != v[:-1]))[: len(v)])
            times = np.diff(np.append(first, len(v)))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(at[first], minlength=len(ids)))), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(c)) for c in (v[first], times.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([source] * len(ids), pa.string()), pa.array(below), pa.array(above), *lists], ["query_id", "source", "below", "above", "v", "times"])

    for key, ids, names, bounds, at, source, s in _by_source(batches):
        if (key, source) not in held:
            held[key, source] = [ids, np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), []]
            size += 24 * len(ids)
        _, below, above, found = held[key, source]
        k, own = names.index(source), slice(at, at + len(s))
        lo, hi = bounds[own, k, None], bounds[own, len(names) + k, None]
        over, under = s > hi, s < lo
        below[own] += np.count_nonzero(under, axis=1)
        above[own] = np.minimum(above[own], np.where(over, s, np.inf).min(1))
        i, j = np.nonzero(~(over | under | np.isnan(s)))
        found.append(((i + at).astype(np.int32), s[i, j]))
        size += 12 * len(i)
        if size > HOLD:
            yield from out()
            held, size = {}, 0
    yield from out()


def _middle(batches):
    """(query_id, source, median) from the counts of ``_spread`` and what ``_inside`` has left of a query's scores with a source."""
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            v, times = np.array(r["v"]), np.array(r["times"], np.int64)
            by = np.argsort(v)
            v, upto = v[by], r["below"] + np.cumsum(times[by])
            least, most = r["neg"], r["neg"] + r["fin"]

            def place(rank, r=r, v=v, upto=upto, least=least, most=most):
                if not least <= rank < most:
                    return -np.inf if rank < least else np.inf if rank < most + r["pos"] else np.nan
                at = int(np.searchsorted(upto, rank, "right"))
                if rank < r["below"] or (at == len(v) and rank > (upto[-1] if len(v) else r["below"])):
                    raise RuntimeError("bounds without the median: a product changed between two passes")
                return v[at] if at < len(v) else r["above"]

            n = most + r["pos"] + r["nan"]
            low, high = place((n - 1) // 2), place(n // 2)
            with np.errstate(invalid="ignore"):
                found.append(float(low + (high - low) * 0.5) if n % 2 == 0 else float(low))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("source"), pa.array(found, pa.float64())], ["query_id", "source", "median"])


def source_medians(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source, median) of the scores of each query by source, linear between neighbours; not a number is larger than all numbers.

    Products are made again in each pass, and no vector is shuffled and no score but those next to a median. A first pass takes each source's mean score, deviation and
    range; the median is within one deviation of the mean. Passes then count ``BINS`` bins between bounds and go on inside the one that has the middle rank,
    for queries that have more than ``FEW`` scores between bounds of a source. The last pass counts what is below and gives out the distinct scores between
    the bounds, with their numbers. Counts decide, so bounds that missed the rank would be widened to the range. A task holds counts of its queries, ``HOLD`` bytes.
    """
    rows = packed(gradients.select("source_id", "vec"), ["source_id"]).withColumnRenamed("m", "x")
    queries = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))

    def met(asked: DataFrame, names: tuple[str, ...]) -> DataFrame:
        return paired(rows, *few_blocks(asked, names=names))

    kinds = ["neg", "fin", "pos", "nan"]
    spread = met(queries, ("query_id",)).mapInArrow(_spread, "query_id long, source string, neg long, fin long, pos long, nan long, mn double, mx double, total double, squares double")
    sums = [F.sum(c).alias(c) for c in (*kinds, "total", "squares")]
    per = stored(spread.groupBy("query_id", "source").agg(*sums, F.min("mn").alias("mn"), F.max("mx").alias("mx")), "spread")
    at = F.floor((F.col("neg") + F.col("fin") + F.col("pos") + F.col("nan") - 1) / 2)  # the lower middle
    mean = F.try_divide("total", "fin")
    off = F.sqrt(F.greatest(F.try_divide("squares", "fin") - mean * mean, F.lit(0.0)) + 1e-12 * F.try_divide("squares", "fin"))
    few, known = F.col("fin") <= FEW, (at >= F.col("neg")) & (at < F.col("neg") + F.col("fin"))
    bound = lambda own, other, near: F.when(F.col("fin") == 0, 0.0).when(at < F.col("neg"), F.col("mn")).when(~known, F.col("mx")).when(few | ~(off < 1e300), F.col(own)).otherwise(near)
    named = {
        "lo": bound("mn", "mx", F.greatest("mn", mean - off)), "hi": bound("mx", "mn", F.least("mx", mean + off)), "rank": at.cast("double"),
        "active": F.when(known & ~few & (F.col("mn") < F.col("mx")), 1.0).otherwise(0.0), "mn": F.col("mn"), "mx": F.col("mx"), "slack": F.when(F.col("fin") == 0, 0.0).otherwise(1e-12 * F.greatest(F.abs("mn"), F.abs("mx"))),
    }
    by_query = per.select("query_id", F.struct("source", *(c.alias(n) for n, c in named.items())).alias("b")).groupBy("query_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    state = stored(by_query.select("query_id", F.col("b.source").alias("names"), *(f"b.{n}" for n in named)), "bounds")
    schema = "query_id long, names array<string>, " + ", ".join(f"{n} array<double>" for n in named)
    for _ in range(ROUNDS):
        wide = F.exists("active", lambda a: a > 0)
        more = state.filter(wide)
        if more.isEmpty():
            break
        asked = more.join(queries, "query_id").select("query_id", "names", F.concat("vec", "lo", "hi").alias("vec"))
        counts = vector_sums(met(asked, ("query_id", "names")).mapInArrow(_counted, "query_id long, v array<double>"), ["query_id"], "v")
        state = stored(more.join(counts, "query_id").mapInArrow(_narrowed, schema).unionByName(state.filter(~wide)), "bounds")
    ends = F.concat("vec", F.zip_with("lo", "slack", lambda v, s: v - s), F.zip_with("hi", "slack", lambda v, s: v + s))
    last = state.join(queries, "query_id").select("query_id", "names", ends.alias("vec"))
    found = met(last, ("query_id", "names")).mapInArrow(_inside, "query_id long, source string, below long, above double, v array<double>, times array<long>")
    both = found.unionByName(per.select("query_id", "source", *kinds), allowMissingColumns=True).groupBy("query_id", "source")
    lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("v", "times"))
    return both.agg(F.sum("below").alias("below"), F.min("above").alias("above"), *lists, *(F.sum(c).alias(c) for c in kinds)).mapInArrow(_middle, "query_id long, source string, median double")


def _order(v: np.ndarray) -> np.ndarray:
    """Magnitudes as they are ranked, to nine digits; not a number is larger than all numbers."""
    return np.where(np.isnan(v), np.inf, np.minimum(half_up(v), np.finfo(np.float64).max))


class _Strongest:
    """The first k scores of each query by magnitude to nine digits, then by sample (null last), of all samples that came by. A query that was asked twice has all of
    its scores twice."""

    def __init__(self, ids: list[int], u: np.ndarray, k: int):
        self.u, self.k, self.codes = u, k, {}
        self.ids, self.of = np.unique(np.array(ids, np.int64), return_inverse=True)
        self.least, self.last = np.full(len(self.ids), -np.inf), np.full(len(self.ids), np.iinfo(np.int64).max)  # each query's k-th
        self.held: list[list[np.ndarray]] = []  # (query, magnitude, sample, source), the first entry is pruned
        self.size = 0

    def meet(self, samples: pa.Array, names: pa.Array, x: np.ndarray) -> None:
        sample = samples.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        coded = names.dictionary_encode(null_encoding="encode")
        code = np.array([self.codes.setdefault(n, len(self.codes)) for n in coded.dictionary.to_pylist()], np.int32)
        source = code[coded.indices.to_numpy(zero_copy_only=False)]
        step = max(1, TILE // len(self.u))
        for lo in range(0, len(x), step):
            v = self.u @ x[lo : lo + step].T
            np.abs(v, out=v)
            low = self.least * (1 - 1e-15) - 2e-9  # no score below it is rounded to the k-th
            at, row = np.nonzero(~(v < low[self.of, None]))
            query, value, row = self.of[at], v[at, row], row + lo
            rank = _order(value)
            new = (rank > self.least[query]) | ((rank == self.least[query]) & (sample[row] < self.last[query]))
            row = row[new]
            self.held.append([query[new].astype(np.int32), value[new], sample[row], source[row]])
            self.size += len(row)
            if self.size > max(2 * self.k * len(self.ids), TILE // 4):
                self.prune()

    def prune(self) -> None:
        held, self.held = self.held, []
        query, value, sample, source = (np.concatenate([h.pop(0) for h in held]) for _ in range(4))  # each is given up when it is joined
        by = np.lexsort((sample, -_order(value), query))
        place = np.arange(len(by)) - np.searchsorted(query[by], np.arange(len(self.ids), dtype=np.int32))[query[by]]
        kth = by[place == self.k - 1]
        self.least[query[kth]], self.last[query[kth]] = _order(value[kth]), sample[kth]
        by = by[place < self.k]
        self.held, self.size = [[query[by], value[by], sample[by], source[by]]], len(by)

    def by_source(self) -> pa.RecordBatch:
        self.prune()
        query, value, _, source = self.held[0]
        key, at, n = np.unique(query.astype(np.int64) * len(self.codes) + source, return_inverse=True, return_counts=True)
        names = pa.array(list(self.codes), pa.string()).take(pa.array(key % len(self.codes)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[key // len(self.codes)]), names, pa.array(n), pa.array(np.bincount(at, value))], ["query_id", "source_id", "n", "mass"])


def strongest_by_source(gradients: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, source_id, n, mass): how many of each query's k scores of largest magnitude the source has, and the sum of those magnitudes; ties by sample.

    For a k that is large against a row: as in ``membership_lds`` queries are dealt to parts, and samples go by in blocks, but a task keeps k scores of each of its
    queries alone, ``KEPT`` in all. So the parts are as many as the cluster has cores until queries times k pass ``KEPT`` for each, and what is shuffled is the vectors
    once for each part, whatever k is. No score is shuffled.
    """
    spark = gradients.sparkSession
    parts = max(-(-queries.count() * k // KEPT), spark.sparkContext.defaultParallelism)

    def packed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                samples, names, vec = (c.slice(lo, BLOCK_ROWS) for c in batch.columns)
                as_matrix(vec)  # nulls and unequal widths raise
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (samples, names, vec.flatten())], ["samples", "names", "vec"])

    kind = gradients.schema["vec"].dataType.simpleString()
    blocks = gradients.select(F.col("sample_index").cast("long"), "source_id", "vec").mapInArrow(packed, f"samples array<long>, names array<string>, vec {kind}")
    rows = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("query_id"), "samples", "names", "vec")
    part_of = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    nothing = (F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("samples", "long"), ("names", "string")))
    asked = queries.select(part_of, F.lit(0).alias("step"), F.col("query_id").cast("long"), *nothing, F.col("vec").cast(kind).alias("vec"))
    dealt = asked.unionByName(rows).repartitionById(parts, "part").sortWithinPartitions("part", "step")

    def run(batches):
        part, ids, u, best = None, [], [], None
        for batch in batches:
            for row in range(batch.num_rows):
                p, step, query_id = (batch.column(c)[row].as_py() for c in range(3))
                vec = batch.column(5)[row].values.to_numpy(zero_copy_only=False).astype(np.float64)
                if p != part:
                    if best is not None:
                        yield best.by_source()
                    part, ids, u, best = p, [], [], None
                if step == 0:
                    ids.append(query_id)
                    u.append(vec)
                elif ids:
                    best = best or _Strongest(ids, np.stack(u), k)
                    samples = batch.column(3)[row].values
                    best.meet(samples, batch.column(4)[row].values, vec.reshape(len(samples), -1))
        if best is not None:
            yield best.by_source()

    return dealt.mapInArrow(run, "query_id long, source_id string, n long, mass double")
