"""Centroid clustering by filtering kd-trees, in exact integer arithmetic.

Vectors become integers, floor(1024 * x) for each component. Each Spark partition cuts its vectors into blocks and builds a
kd-tree over each (Kanungo et al., "An Efficient k-Means Clustering Algorithm", 2002): a node holds its box, the number and the
sums of its vectors, and is split at the median of its widest component until it is small or a single point, however often that
is repeated. The trees are written once. A round sends the centroids (k vectors) to the tasks; they walk their trees level by level
with the set of centroids that may still be nearest for some point of a node's box. A centroid is pruned if the one nearest to the
middle of the box is strictly nearer even at the box's corner farthest towards the pruned one: the difference of two squared distances
is linear, so that corner is its extreme. A node with one centroid left is assigned whole, by its count and sums; leaves
with several are resolved vector by vector. Tasks give k * dim sums and k counts each, Spark adds them, and k * dim
numbers reach the driver.

Distances and sums are integers and ties go to the smaller number, so results do not depend on blocks, trees or partitions. Rounds
end early once no centroid moves: further ones would change nothing.

Defined results: vectors of another length, with a null or with a component that is not finite are left out; a null id is kept (its
seed hash is that of an empty id); repeated rows count each and may be seeds together; fewer vectors than k give as many
centroids; an empty table gives an empty table; extra columns are not touched, whatever their names. A component beyond
2**17 in magnitude raises an error: its squared distance does not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 27
BLOCK, LEAF = 4096, 32
_TREE = "ids array<long>, points binary, lo binary, hi binary, sums binary, shape binary"
_FAR = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that have ``dim`` finite components."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce((F.size(e) == dim) & finite, F.lit(False))).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("e"))
    inside = F.forall("e", lambda x: F.abs(x) * scale <= LARGEST)
    q = F.transform("e", lambda x: F.floor(x * scale))
    return kept.select("vec_id", F.when(inside, q).otherwise(F.raise_error(F.lit("a component is too large for squared distances in a long"))).alias("q"))


def _seed_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A kd-tree over a block: the order of its points, and arrays by node. ``shape`` rows: begin, end, left child (0: leaf); the
    right child follows the left one."""
    order = np.arange(len(points))
    shape, lo, hi, sums = [[0, len(points), 0]], [], [], []
    for node in shape:  # children are appended while it runs
        own = points[order[node[0] : node[1]]]
        lo.append(own.min(0))
        hi.append(own.max(0))
        sums.append(own.sum(0))
        width = hi[-1] - lo[-1]
        axis = int(width.argmax())
        if node[1] - node[0] > leaf and width[axis]:
            half = len(own) // 2
            order[node[0] : node[1]] = order[node[0] : node[1]][np.argpartition(own[:, axis], half)]
            node[2] = len(shape)
            shape += [[node[0], node[0] + half, 0], [node[0] + half, node[1], 0]]
    return order, {"lo": np.array(lo), "hi": np.array(hi), "sums": np.array(sums), "shape": np.array(shape)}


def trees(vectors: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """A row for each block of quantised vectors: ids and points in tree order, and the nodes."""

    def run(batches):
        ids, points = [], []

        def built():
            i, p = np.concatenate(ids), np.concatenate(points)
            for at in range(0, len(i), block):
                order, tree = grow(p[at : at + block])
                values = [i[at : at + block][order], p[at : at + block][order].astype(np.int32), tree["lo"].astype(np.int32), tree["hi"].astype(np.int32), tree["sums"], tree["shape"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.list_(pa.int64())), *(pa.array([v.tobytes()], pa.binary()) for v in values[1:])], _TREE.replace(",", "").split()[::2])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("n").to_numpy())
                points.append(batch.column("q").flatten().to_numpy().reshape(-1, dim))
                if sum(map(len, ids)) >= block:
                    yield from built()
                    ids, points = [], []
        if ids:
            yield from built()

    none = F.coalesce("vec_id", F.lit(-(2**63))).alias("n")
    return vectors.select(none, "q").mapInArrow(run, _TREE)


def filtered(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list, list]:
    """The nodes that belong whole to one centroid, as (nodes, centroid numbers), and the leaves that stay open, as
    (nodes, sets of centroids): a list of arrays for each level."""
    nodes = np.zeros(1, int)
    open_ = np.ones((1, len(centroids)), bool)
    whole, left = [], []
    while len(nodes):
        lo, hi = tree["lo"][nodes], tree["hi"][nodes]
        middle = lo + hi  # twice the middle, to stay in integers
        far = np.stack([((middle - 2 * c) ** 2).sum(1) for c in centroids], 1)
        far[~open_] = _FAR
        best = far.argmin(1)
        near = centroids[best]
        for k, c in enumerate(centroids):
            corner = np.where(c > near, hi, lo)
            open_[:, k] &= (best == k) | (((corner - c) ** 2).sum(1) <= ((corner - near) ** 2).sum(1))
        one = open_.sum(1) == 1
        leaf = tree["shape"][nodes, 2] == 0
        whole.append((nodes[one], best[one]))
        left.append((nodes[~one & leaf], open_[~one & leaf]))
        inner = ~one & ~leaf
        child = tree["shape"][nodes[inner], 2]
        nodes, open_ = np.concatenate([child, child + 1]), np.concatenate([open_[inner]] * 2)
    return whole, left


def nearest(points: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each point's open centroids and the squared distance; ties go to the smaller number."""
    best, at = np.full(len(points), _FAR), np.zeros(len(points), np.int64)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, k])
        d = ((points[rows] - c) ** 2).sum(1)
        less = d < best[rows]
        best[rows[less]], at[rows[less]] = d[less], k
    return at, best


def _read(batches, dim: int):
    for batch in batches:
        for row in range(batch.num_rows):
            part = {name: np.frombuffer(batch.column(name)[row].as_buffer(), kind).astype(np.int64) for name, kind in (("points", np.int32), ("lo", np.int32), ("hi", np.int32), ("sums", np.int64), ("shape", np.int32))}
            tree = {name: v.reshape(-1, 3 if name == "shape" else dim) for name, v in part.items()}
            yield batch.column("ids")[row].values.to_numpy(), tree


def _members(shape: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of nodes, and for each the node's place in ``nodes``."""
    n = shape[nodes, 1] - shape[nodes, 0]
    owner = np.repeat(np.arange(len(nodes)), n)
    return np.arange(len(owner)) + np.repeat(shape[nodes, 0] - (np.cumsum(n) - n), n), owner


def round_sums(grown: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """How many vectors are nearest to each centroid, and their sums by component."""
    k, dim = centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, tree in _read(batches, dim):
            whole, left = filtered(tree, centroids)
            for nodes, c in whole:
                np.add.at(count, c, tree["shape"][nodes, 1] - tree["shape"][nodes, 0])
                np.add.at(sums, c, tree["sums"][nodes])
            for nodes, open_ in left:
                at, owner = _members(tree["shape"], nodes)
                c, _ = nearest(tree["points"][at], open_[owner], centroids)
                count += np.bincount(c, minlength=k)
                np.add.at(sums, c, tree["points"][at])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], ["k", "n", "sums"])

    parts = grown.mapInArrow(run, "k long, n long, sums array<long>").select("k", "n", F.posexplode("sums").alias("i", "s"))
    added = parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k", "i").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added:
        out.setdefault(r.k, (r.n, []))[1].append(int(r.s))
    return out


def assigned(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors."""
    dim = centroids.shape[1]

    def run(batches):
        for ids, tree in _read(batches, dim):
            cluster, distance = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            whole, left = filtered(tree, centroids)
            for nodes, c in whole:
                at, owner = _members(tree["shape"], nodes)
                cluster[at] = c[owner]
                distance[at] = ((tree["points"][at] - centroids[c[owner]]) ** 2).sum(1)
            for nodes, open_ in left:
                at, owner = _members(tree["shape"], nodes)
                cluster[at], distance[at] = nearest(tree["points"][at], open_[owner], centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = grown.mapInArrow(run, "vec_id long, cluster int, distance long")
    return rows.withColumn("vec_id", F.when(F.col("vec_id") != -(2**63), F.col("vec_id")))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) as a written table, and the final centroids."""
    made = quantised(vectors, dim, scale)
    first = made.select(_seed_hash(seed).alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, dim)
    grown = materialise(trees(made, dim, block), "kd-trees", "zstd")
    for _ in range(rounds if len(first) else 0):
        sums = round_sums(grown, centroids)
        moved = np.array([[s // sums[c][0] for s in sums[c][1]] if sums.get(c, (0,))[0] else old.tolist() for c, old in enumerate(centroids)], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    out = materialise(assigned(grown, centroids), "clusters")
    release(grown)
    return out, centroids


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).crossJoin(rows.agg(F.sum("distance").alias("inertia")))
    per = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # K rows


def _sql() -> str:
    """The same by plain distances to all centroids."""
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM kept ORDER BY h, q LIMIT {K}))"]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT row, min(struct_pack(d := {square}, k := c.k)) AS m FROM kept v CROSS JOIN c{t} c GROUP BY row)")
        if t < ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.q, c.q) AS q FROM c{t} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS q FROM (
                SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT a.m.k AS k, generate_subscripts(v.q, 1) AS i, unnest(v.q) AS x
                FROM a{t} a JOIN kept v USING (row)) GROUP BY k, i) GROUP BY k) n USING (k))""")  # fmt: skip
    return f"""WITH {", ".join(steps)}, f AS (SELECT v.vec_id, a.m.k::INTEGER AS cluster, a.m.d AS distance FROM a{ROUNDS} a JOIN kept v USING (row))
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON c.k = f.cluster"""  # fmt: skip


SQL = {"op12_centroid_clusters": _sql()}
