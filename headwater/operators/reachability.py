"""Reachability over a chain index: nodes as places on chains, and the edges between chains.

The nodes are dealt to ranges of ids. A task cuts its range into chains: every node asks for the largest of its inputs in the range that
ends a chain, and of the nodes that ask for one input the smallest goes on with its chain. Chains of neighbouring ranges whose
ends meet are stitched in a second pass over one row for each chain. What is reachable is then told by places: a node has all of its chain
above it as ancestors, and an edge between chains brings in the other chain up to the edge's end (Jagadish, "A Compression
Technique to Materialize Transitive Closure", 1990). A search keeps the furthest place on each chain, so edges between the same
chains do not repeat it, and its rounds are the changes of chain on a path, not its length: a chain of any depth takes one.

Cycles are allowed: a cycle of main inputs is cut into a chain and an edge from its end to its beginning. Ids are ordinary values: 0 is a node like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import delete, stored, stored_at

#: Chains that one task stitches: 24 bytes each.
STITCH_ROWS = 1_000_000
#: How often nodes of a range that share an input may ask for another one; what is left begins chains of its own.
MATCH_ROUNDS = 8


def climb(up: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each element's pointers (-1: its own) and the weights on the way, by doubling. ``up`` takes no element twice; a
    cycle is cut at its least element, which is then an end."""
    n = len(up)
    own = np.arange(n)
    at, least = np.where(up < 0, own, up), own.copy()
    far = np.where(up < 0, 0, weight)
    for _ in range(max(1, int(n).bit_length() + 1)):
        far = far + np.where(at == own, 0, far[at])
        least = np.minimum(least, least[at])
        at = at[at]
    loose = up[at] >= 0
    return climb(np.where(loose & (least == own), -1, up), weight) if loose.any() else (at, far)


def _chains(node: np.ndarray, src: np.ndarray, known: np.ndarray) -> list[tuple]:
    """Columns (kind, node, chain, pos, other) of a range: places of its nodes (0), edges that are no part of a chain (1: node is the
    input, chain and pos are the output's), and chains (2: node is the last one, pos its place, other an input of the first one from outside)."""
    nodes = np.unique(node)
    n = len(nodes)
    pairs = np.unique(np.stack([node[known], src[known]]), axis=1)
    out = np.searchsorted(nodes, pairs[0])
    at = np.minimum(np.searchsorted(nodes, pairs[1]), n - 1)
    inside = nodes[at] == pairs[1]
    up, heir = np.full(n, -1), np.full(n, -1)
    own = np.flatnonzero(inside & (at != out))
    for _ in range(MATCH_ROUNDS):  # nodes without a place on a chain ask for the largest input that still ends one
        own = own[(up[out[own]] < 0) & (heir[at[own]] < 0)]
        if not len(own):
            break
        main, least = np.full(n, -1), np.full(n, n)
        np.maximum.at(main, out[own], at[own])
        asking = np.flatnonzero(main >= 0)
        np.minimum.at(least, main[asking], asking)
        chosen = np.flatnonzero(least < n)
        up[least[chosen]], heir[chosen] = chosen, least[chosen]
    top, pos = climb(up, np.ones(n, np.int64))
    up = np.where(top == np.arange(n), -1, up)
    cross = ~(inside & (up[out] == at))
    outside = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(outside, out[~inside], pairs[1][~inside])
    last = np.zeros(n, np.int64)
    np.maximum.at(last, top, pos)
    ends = np.flatnonzero(last[top] == pos)
    none = np.iinfo(np.int64).min
    return [
        (np.zeros(n, np.int32), nodes, nodes[top], pos, np.full(n, none)),
        (np.ones(int(cross.sum()), np.int32), pairs[1][cross], nodes[top[out[cross]]], pos[out[cross]], np.full(int(cross.sum()), none)),
        (np.full(len(ends), 2, np.int32), nodes[ends], nodes[top[ends]], pos[ends], outside[top[ends]]),
    ]


def _local_chains(counted):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            src = rows["src"].combine_chunks()
            parts = _chains(rows["node"].to_numpy(), src.fill_null(0).to_numpy(zero_copy_only=False), src.is_valid().to_numpy(zero_copy_only=False))
            counted.add(len(parts[2][0]))
            for part in parts:
                other = pa.array(part[4], mask=part[4] == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(c, pa.int64()) for c in part[1:4]), other], ["kind", "node", "chain", "pos", "other"])

    return run


def _stitched(batches):
    """(chain, root, shift): where each chain stands on the longer one that its task has put together."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        order = np.argsort(rows["chain"].to_numpy())
        chain, size = rows["chain"].to_numpy()[order], rows["size"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[order]
        on = rows["on"].combine_chunks()
        valid = on.is_valid().to_numpy(zero_copy_only=False)[order]
        on = on.fill_null(0).to_numpy(zero_copy_only=False)[order]
        at = np.minimum(np.searchsorted(chain, on), len(chain) - 1)
        up = np.where(valid & (chain[at] == on), at, -1)
        root, shift = climb(up, size)
        moved = np.flatnonzero(root != np.arange(len(chain)))
        yield pa.RecordBatch.from_arrays([pa.array(chain[moved]), pa.array(chain[root[moved]]), pa.array(shift[moved])], ["chain", "root", "shift"])


@dataclass
class ChainIndex:
    """``places`` (node, chain, pos), one for each node; ``links`` (chain, pos, src_chain, src_pos), one for each edge that is no part of a
    chain: it leads from the source's place to the place on ``chain``."""

    places: DataFrame
    links: DataFrame

    def ancestors(self, start: DataFrame) -> DataFrame:
        """(start, node), as ``graph.reach`` gives them. ``start`` has one column, start."""
        return self._search(start, "chain", "pos", "src_chain", "src_pos", 1)

    def descendants(self, start: DataFrame) -> DataFrame:
        return self._search(start, "src_chain", "src_pos", "chain", "pos", -1)

    def reached(self, start: DataFrame) -> DataFrame:
        """(start, chain, bound): a start's ancestors are the places 0 to bound of these chains; -1 is none of its own chain."""
        return self._bounds(start, "chain", "pos", "src_chain", "src_pos", 1)

    def _search(self, start: DataFrame, here: str, here_pos: str, there: str, there_pos: str, sign: int) -> DataFrame:
        known = self._bounds(start, here, here_pos, there, there_pos, sign)
        on = self.places.select("node", "chain", (sign * F.col("pos")).alias("_p"))
        return known.join(on, "chain").filter("_p <= bound").select("start", "node")

    def _bounds(self, start: DataFrame, here: str, here_pos: str, there: str, there_pos: str, sign: int, max_rounds: int = 10_000) -> DataFrame:
        """Bounds are places times ``sign``: all of a chain's places up to the largest bound are reached."""
        spark = start.sparkSession
        links = self.links.select(F.col(here).alias("_c"), (sign * F.col(here_pos)).alias("_p"), F.col(there).alias("chain"), (sign * F.col(there_pos)).alias("bound"))
        at = start.select("start").distinct().join(self.places, F.col("start") == F.col("node")).select("start", "chain", (sign * F.col("pos")).alias("bound"))
        frontier, path = stored_at(at, "starts")
        first = frontier.select("start", "chain", (F.col("bound") - 1).alias("bound"))
        known, paths = first, []
        for _ in range(max_rounds):
            met = frontier.withColumnRenamed("chain", "_c").withColumnRenamed("bound", "_b").join(links, "_c").filter("_p <= _b")
            reached = met.groupBy("start", "chain").agg(F.max("bound").alias("bound"))
            older = known.select("start", "chain", F.col("bound").alias("_old"))
            new = reached.join(older, ["start", "chain"], "left").filter("_old is null or _old < bound").select("start", "chain", "bound")
            frontier, new_path = stored_at(new, "bounds")
            if frontier.isEmpty():
                break
            paths.append(new_path)
            if len(paths) == 16:  # few files and a short plan, whatever the rounds
                known, merged = stored_at(known.unionByName(frontier).groupBy("start", "chain").agg(F.max("bound").alias("bound")), "bounds")
                delete(spark, *paths[:-1])
                paths = [merged]
            else:
                known = known.unionByName(frontier).groupBy("start", "chain").agg(F.max("bound").alias("bound"))
        else:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        return known


def chain_index(steps: DataFrame, nodes: DataFrame | None = None) -> ChainIndex:
    """The index of a graph given by edges (src, dst); repeated edges and edges of a node to itself are allowed. ``nodes`` (node) have places even
    if they have no edge."""
    spark = steps.sparkSession
    rows = steps.select(F.col("dst").alias("node"), "src").union(steps.select("src", F.lit(None).cast("long")))
    rows = rows if nodes is None else rows.union(nodes.select("node", F.lit(None).cast("long")))
    counted = spark.sparkContext.accumulator(0)  # a task that runs twice counts twice: it only sets the number of tasks below
    made = rows.repartitionByRange("node").mapInArrow(_local_chains(counted), "kind int, node long, chain long, pos long, other long")
    cut, path = stored_at(made, "chains")
    n = counted.value
    chains = cut.filter("kind = 2")
    ends = chains.select(F.col("node").alias("_end"), F.col("chain").alias("on"), (F.col("pos") + 1).alias("size"))
    met = chains.join(ends, F.col("other") == F.col("_end"))
    met = met.groupBy("on").agg(F.min(F.struct("chain", "size")).alias("m")).select(F.col("m.chain").alias("chain"), "on", "m.size")
    every = chains.select("chain").join(met, "chain", "left")
    dealt = every.coalesce(1) if n <= STITCH_ROWS else every.repartitionByRange(-(-n // STITCH_ROWS), "chain")
    moved = stored(dealt.mapInArrow(_stitched, "chain long, root long, shift long"), "stitched")

    def on_roots(df: DataFrame, chain: str, pos: str) -> DataFrame:
        to = moved.select(F.col("chain").alias("_of"), "root", "shift")
        df = df.join(to, F.col(chain) == F.col("_of"), "left")
        return df.withColumns({chain: F.coalesce("root", chain), pos: F.col(pos) + F.coalesce("shift", F.lit(0))}).drop("_of", "root", "shift")

    places = stored(on_roots(cut.filter("kind = 0").select("node", "chain", "pos"), "chain", "pos"), "places")
    links = on_roots(cut.filter("kind = 1").select("node", "chain", "pos"), "chain", "pos")
    links = links.join(places.select("node", F.col("chain").alias("src_chain"), F.col("pos").alias("src_pos")), "node").drop("node")
    # an edge inside a chain that was stitched since says nothing new
    links = stored(links.filter("chain <> src_chain or src_pos >= pos"), "links")
    delete(spark, path)
    return ChainIndex(places, links)
