"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 majority bits over the XXH64 of word shingles. Equal fingerprints are merged before any
comparison, so a group of copies is one row. Each distinct fingerprint carries its pivot table: its Hamming
distances to reference fingerprints, a byte each. By the triangle inequality two fingerprints within ``radius``
bits differ by at most ``radius`` in every coordinate, so pairs are discarded by their largest coordinate
difference and only survivors are verified bit by bit.

Pivot coordinates alone bring nothing together (distances of unrelated fingerprints all lie near 32), so pairs
meet first under exact pigeonhole keys: at most ``radius`` = 4 blocks of bits can differ, so the others agree and are a common
key. Blocks and keys are chosen by the number of fingerprints: six blocks and 15 keys of two, up to eight blocks and 70 keys of
four, so that buckets of unrelated fingerprints stay small. In a bucket the tables discard and the bits decide.

Pairs grow with the square of a cluster of near copies, so none are given out. The cluster is first thinned without losing
connection: fingerprints that differ in one bit share one of 64 masked values, groups under a masked value are
stars, and their components are contracted. What is still in different components is compared inside tasks, in pairs of
blocks, and each gives out links that span what it has connected.

Defined results: null or blank text has fingerprint zero and links like any other; a text of fewer words than
a shingle is one shingle; texts of any length are read whole; null ids are kept as rows (the least non-null id names a
component); a bit that half of the hashes set is not set; repeated rows share a fingerprint; an empty table gives
an empty table; extra columns are not touched, whatever their names.

``similar_groups`` and ``keep_one`` serve the corpus pipeline: shingles of five words, similarity 0.8 and more. Their
fingerprint is four lanes of majority bits with the same kind of pivot table, see there. Rows without words are one
group; of the rows of a group the one with an id goes before those without, then the least id, then the least hashes
of the text; rows equal in id and text are one; null and repeated ids keep all their different texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_documents, bitmap, id_in, id_out, in_bitmap, in_groups, materialise, release, table
from .components import components

RADIUS = 4
N_PIVOTS = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLAB = 1 << 16


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; zero for a text without words."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= n:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLAB):  # a slab at a time: memory doesn't follow a text's length
        h = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[at : at + _SLAB], ends[at : at + _SLAB], strict=True)), np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(starts)).tolist())


def with_fingerprint(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, n) for t in pdf.text], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": fp})

    return docs.select(id_in(), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long").select(id_out(), "fp")


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: fixed pseudo-random words."""
    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], int]:
    """(start bit, width) of the blocks that fingerprints are cut into, and how many of them a key holds: so many that unrelated fingerprints
    of a table of ``n`` hardly share a key. At most ``radius`` blocks differ, so the others agree."""
    for parts in range(radius + 2, 2 * radius + 1):
        edges = [64 * k // parts for k in range(parts + 1)]
        width = min(edges[k + 1] - edges[k] for k in range(parts)) * (parts - radius)
        if n >> width <= 16:
            break
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)], parts - radius


def _spanning(radius: int):
    """Compares the fingerprints of whole groups (k, v, x, y) and gives out (a, b) that connect the groups whose members are near. The pivot
    tables discard, the bits of what is left decide."""
    refs = np.array(pivots(), np.uint64)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf.fp.to_numpy().view(np.uint64)
        table_ = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
        names, code = np.unique(pdf.grp.to_numpy(), return_inverse=True)
        label = np.arange(len(names))
        key = [pdf[c].to_numpy() for c in ("k", "v", "x", "y")]
        new = np.ones(len(pdf), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in key], axis=0)
        stop = np.searchsorted(np.cumsum(new), np.cumsum(new), "right")
        mine, one_block = pdf.r.to_numpy(), key[2] == key[3]
        many = stop - np.arange(len(pdf)) - 1  # each row's partners: those after it in its group
        ends, at, near = np.cumsum(many), 0, []
        while at < len(pdf):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            m = many[at:upto]
            a = np.repeat(np.arange(at, upto), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            at = upto
            keep = (code[a] != code[b]) & (one_block[a] | (mine[a] != mine[b]))
            a, b = a[keep], b[keep]
            keep = np.abs(table_[a] - table_[b]).max(1, initial=0) <= radius
            a, b = a[keep], b[keep]
            keep = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = code[a[keep]], code[b[keep]]
            keep = label[a] != label[b]  # what is connected needs no further link
            if keep.any():
                near.append(np.stack([a[keep], b[keep]]))
                x, y = near[-1]
                while (label[x] != label[y]).any():
                    least = np.minimum(label[x], label[y])
                    np.minimum.at(label, label[x], least)
                    np.minimum.at(label, label[y], least)
                    label = label[label]
        while (label != label[label]).any():
            label = label[label]
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[label[moved]], "b": names[moved]})

    return work


def links(fps: DataFrame, radius: int = RADIUS, block: int = 1024) -> DataFrame:
    """(a, b): links that connect the groups of fingerprints within ``radius`` bits, a spanning set for each batch of buckets.

    ``fps`` has distinct ``fp`` and ``grp``: fingerprints already known to be connected share a group. Fingerprints that agree in enough whole blocks
    meet in a bucket; a bucket inside one group is left out, and one of more than ``block`` rows is dealt to pairs of blocks, which
    are compared inside tasks.
    """
    blocks, held = blocks_for(fps.count(), radius)
    mask = lambda parts: _signed(sum(((1 << width) - 1) << at for at, width in parts))
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(parts))).alias("v")) for k, parts in enumerate(combinations(blocks, held))))
    keyed = fps.select("fp", "grp", F.explode(keys).alias("key")).select("fp", "grp", "key.k", "key.v")
    open_ = keyed.groupBy("k", "v").agg(F.count("*").alias("m"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    open_ = materialise(open_.select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.xxhash64("k", "v").alias("_h")), "open-buckets")
    met = (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v"))
    some = in_bitmap(keyed.withColumn("_slot", F.xxhash64("k", "v")), "_slot", bitmap(open_, "_h")).drop("_slot")
    dealt = some.join(open_, met).withColumn("r", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("r", "o"), "y": F.greatest("r", "o")})
    by = ["k", "v", "x", "y"]
    rows = dealt.select(*by, "r", "fp", "grp").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInPandas(in_groups(by, lambda: _spanning(radius)), "a long, b long")


def _contracted(fps: DataFrame) -> DataFrame:
    """(fp, grp): groups of fingerprints connected by single-bit steps; others are their own group."""
    masked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (2**64 - 1)))).alias("v")) for i in range(64))))
    pairs = fps.select("fp", masked.alias("m")).groupBy("m.i", "m.v").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b")
    # under one mask at most two fingerprints are equal, so least and largest are all there are
    roots = components(pairs.select("a", "b"))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("grp"))


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the least document id reachable over links, for each distinct fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    grouped = materialise(_contracted(distinct.select("fp")), "contracted")
    roots = components(links(grouped, radius)).withColumnRenamed("node", "_grp")
    rooted = grouped.join(roots, F.col("grp") == F.col("_grp"), "left").select("fp", F.coalesce("root", "grp").alias("root"))
    rooted = materialise(rooted.join(distinct, "fp"), "rooted-fingerprints")
    # written tables, so that Spark splits the join where a component is large
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component")), "least-of-component")
    return rooted.select("fp", "root").join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    prints = materialise(with_fingerprint(docs, shingle), "simhash")
    groups = near_groups(prints, radius).withColumnRenamed("fp", "_fp")
    return prints.join(groups, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", F.col("component").alias("component_id"))


_ODD = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 11) | 1 for i in range(128)]
LANES, BANDS, ROWS = 4, 16, 4
WIDE_RADIUS = 64  # of 256 bits: only discards, see similar_groups
SMALL = 16  # sets of fewer shingles have too few votes in a bit for the radius: only their sizes discard
BLOCK = 1024  # rows of one band key that a task compares with as many others
_PAIRS = 1 << 17  # pairs looked at at once


def shingle_set(text: str | None, n: int) -> tuple[bytes, np.ndarray]:
    """The words joined by single spaces, and the sorted distinct hashes of their runs of n."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(ws)
    if not ws:
        return joined, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    count = max(1, len(ws) - n + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    ends = ends[min(n, len(ws)) - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return joined, np.unique(np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, count))


def wide_fingerprint(text: str | None, n: int) -> tuple[int, int, list[int], list[int]]:
    """(hash of the words, number of distinct shingles, LANES longs of majority bits over these, a key for each of
    BANDS bands of ROWS least hashes)."""
    joined, hashes = shingle_set(text, n)
    signed = lambda x: _signed(int(x))
    same = signed(xxhash.xxh64_intdigest(joined, 1))
    if not len(hashes):
        return same, 0, [0] * LANES, [same]
    bits, least = np.zeros(64 * LANES, np.int64), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _SLAB):
        h = hashes[at : at + _SLAB]
        for k in range(LANES):
            lane = h if k == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[k])
            lane = lane ^ (lane >> np.uint64(32)) if k else lane
            bits[64 * k : 64 * k + 64] += np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], (h * np.uint64(_ODD[k])).min())
    packed = np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64).tolist()
    keys = [signed(xxhash.xxh64_intdigest(least[k * ROWS : k * ROWS + ROWS].tobytes(), k)) for k in range(BANDS)]
    return same, len(hashes), packed, keys


def _texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, g, text): two hashes tell the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), F.col("text")).alias("g"), "text")


def _row(x: str, y: str) -> Column:
    return (F.col(f"{x}h") == F.col(f"{y}h")) & (F.col(f"{x}g") == F.col(f"{y}g")) & F.col(f"{x}doc_id").eqNullSafe(F.col(f"{y}doc_id"))


def _with_sets(rows: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(_same, s): the shingle hashes of each ``same`` in ``rows``, from one of its documents."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"_same": pdf.same, "s": [np.sort(shingle_set(t, shingle)[1].view(np.int64)) for t in pdf.text]})

    wanted = materialise(rows.select(F.col("same").alias("_same")).distinct(), "wide-wanted")
    need = classes.join(wanted, F.col("same") == F.col("_same"), "left_semi").select("same", *(F.col(c).alias(f"_{c}") for c in ("doc_id", "h", "g")))
    need = materialise(need, "wide-ends")
    # few of all texts: the bitmap keeps the others out of the shuffle
    texts = in_bitmap(_texts_of(docs), "h", bitmap(need, "_h")).join(need, _row("", "_"))
    sets = materialise(texts.select("same", "text").mapInPandas(run, "_same long, s array<long>").dropDuplicates(["_same"]), "shingle-sets")
    release(wanted, need)
    return sets


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more of two ascending arrays of distinct hashes."""
    both = np.searchsorted(b, a, "right") - np.searchsorted(b, a)
    return 9 * int(both.sum()) >= 4 * (len(a) + len(b))


class _Near:
    """Compares the rows of whole groups (band, key, x, y) and gives out rows with a partner (``exact`` False) or a
    spanning set of links between groups of classes (True). A pair of rows counts where it first meets; sizes, pivot
    tables and bits discard."""

    def __init__(self, radius: int, exact: bool):
        self.radius, self.exact = radius, exact

    def pairs(self, pdf: pd.DataFrame):
        n, grp, band, side, mine = (pdf[c].to_numpy() for c in ("n", "grp", "band", "x", "r"))
        f = np.stack([pdf[f"f{k}"].to_numpy() for k in range(LANES)], 1).view(np.uint64)
        pivots_ = np.stack([np.frombuffer(t, np.uint8) for t in pdf.t]).astype(np.int16)
        keys = np.stack(pdf["keys"].to_numpy())
        new = np.ones(len(pdf), bool)
        new[1:] = np.any([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in ("band", "key", "x", "y")], axis=0)
        group = np.cumsum(new) - 1
        stop = np.searchsorted(group, group, "right")
        many = stop - np.arange(len(pdf)) - 1  # each row's partners: those after it in its group
        ends, at = np.cumsum(many), 0
        while at < len(pdf):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            m = many[at:upto]
            a = np.repeat(np.arange(at, upto), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            at = upto
            same_block = pdf.x.to_numpy()[a] == pdf.y.to_numpy()[a]
            keep = (grp[a] != grp[b]) & (same_block | (mine[a] != mine[b])) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            small = np.minimum(n[a], n[b]) < SMALL
            keep = small | (np.abs(pivots_[a] - pivots_[b]).max(1, initial=0) <= self.radius)
            a, b, small = a[keep], b[keep], small[keep]
            keep = small | (np.bitwise_count(f[a] ^ f[b]).sum(1) <= self.radius)
            a, b = a[keep], b[keep]
            keep = (keys[a] == keys[b]).argmax(1) == band[a]  # the first band in which they meet
            yield a[keep], b[keep]

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        if not self.exact:
            live = np.zeros(len(pdf), bool)
            for a, b in self.pairs(pdf):
                live[a] = live[b] = True
            return pdf[live]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        sets, grp, links_ = pdf.s.tolist(), pdf.grp.tolist(), []
        for a, b in self.pairs(pdf):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(grp[i]), find(grp[j])
                if x != y and _alike(sets[i], sets[j]):
                    root[max(x, y)] = min(x, y)
                    links_.append((grp[i], grp[j]))
        return pd.DataFrame(links_, columns=["a", "b"])


def _grouped(docs: DataFrame, shingle: int, radius: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list]:
    """(doc_id, h, g, same) of each row; for each ``same`` the row (_doc_id, _h, _g) that stands for its group; the
    tables both are read from."""
    refs = [[xxhash.xxh64_intdigest(bytes([i, k]), 7) for k in range(LANES)] for i in range(N_PIVOTS)]
    refs = np.array(refs, np.uint64)

    def run(batches):
        for pdf in batches:
            made = [wide_fingerprint(t, shingle) for t in pdf.text]
            out = {"doc_id": pdf.doc_id, "h": pdf.h, "g": pdf.g, "same": [m[0] for m in made], "n": [m[1] for m in made]}
            f = np.array([m[2] for m in made], np.int64).reshape(-1, LANES)
            far = np.bitwise_count(f.view(np.uint64)[:, None, :] ^ refs[None]).sum(2)  # 256 at most, and that only of a complement
            out |= {f"f{k}": f[:, k] for k in range(LANES)} | {"t": [x.tobytes() for x in np.minimum(far, 255).astype(np.uint8)], "keys": [m[3] for m in made]}
            yield pd.DataFrame(out)

    fs = [f"f{k}" for k in range(LANES)]
    schema = "doc_id long, h long, g long, same long, n long, " + "".join(f"{f} long, " for f in fs) + "t binary, keys array<long>"
    prints = materialise(_texts_of(docs).withColumn("doc_id", id_in()).mapInPandas(run, schema).withColumn("doc_id", id_out()), "wide-simhash")
    # a row with an id goes first, then the least id, then the least hashes of the text
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "g", "n", *fs, "t", "keys")).alias("r")
    classes = materialise(prints.groupBy("same").agg(least).select("same", "r.*"), "classes")
    banded = classes.select("same", "n", *fs, "t", "keys", F.posexplode("keys").alias("band", "key"))
    # first every row of a bucket against the bucket's least one: as many comparisons as rows
    hub = banded.groupBy("band", "key").agg(F.min(F.struct("same", "n", *fs)).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    hub = materialise(hub.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("hub").alias("_hub")), "hubs")
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"_hub.{f}"))) for f in fs[1:]), F.bit_count(F.col("f0").bitwiseXOR(F.col("_hub.f0"))))
    sizes = 5 * F.least("n", "_hub.n") >= 4 * F.greatest("n", "_hub.n")  # else the sets can't reach 0.8
    met = (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")) & (F.col("same") != F.col("_hub.same")) & sizes & ((apart <= radius) | (F.least("n", "_hub.n") < SMALL))
    stars = materialise(banded.join(hub, met).select("same", F.col("_hub.same").alias("hub")).distinct(), "stars")
    sets = _with_sets(stars.select("same").union(stars.select("hub")), classes, docs, shingle)
    side = lambda x, to: sets.select(F.col("_same").alias(f"_{x}"), F.col("s").alias(to))
    both = stars.join(side("same", "sa"), F.col("same") == F.col("_same")).join(side("hub", "sb"), F.col("hub") == F.col("_hub"))
    alike = 9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))
    grp = components(both.filter(alike).select(F.col("same").alias("a"), F.col("hub").alias("b"))).withColumnsRenamed({"node": "_node", "root": "_grp"})
    grp = materialise(grp, "star-groups")
    release(hub, stars, sets)
    rows = materialise(classes.join(grp, F.col("same") == F.col("_node"), "left").select("same", "n", *fs, "t", "keys", F.coalesce("_grp", "same").alias("grp")), "star-rows")
    # then all rows of a bucket that the stars have left in different groups, inside tasks and in blocks
    banded = rows.select("*", F.posexplode("keys").alias("band", "key"))
    open_ = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    open_ = materialise(open_.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "open-buckets")
    dealt = banded.join(open_, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).withColumn("r", F.pmod("same", F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("o", others).withColumns({"x": F.least("r", "o"), "y": F.greatest("r", "o")})
    columns = ["band", "key", "x", "y", "r", "same", "grp", "n", *fs, "t", "keys"]
    by = ["band", "key", "x", "y"]
    ordered = lambda df: df.repartition(*by).sortWithinPartitions(*by, "same")
    types = "band int, key long, x int, y int, r int, same long, grp long, n long, " + "".join(f"{f} long, " for f in fs) + "t binary, keys array<long>"
    live = ordered(dealt.select(columns)).mapInPandas(in_groups(by, lambda: _Near(radius, False)), types)
    live = materialise(live, "rows-with-partners")
    sets = _with_sets(live, classes, docs, shingle)
    whole = ordered(live.join(sets, F.col("same") == F.col("_same")).drop("_same"))
    found = whole.mapInPandas(in_groups(by, lambda: _Near(radius, True)), "a long, b long")
    roots = components(found.union(grp.select("_node", "_grp"))).withColumnRenamed("node", "_node")
    rooted = classes.join(roots, F.col("same") == F.col("_node"), "left").select("same", "no_id", "doc_id", "h", "g", F.coalesce("root", "same").alias("root"))
    rooted = materialise(rooted, "rooted")
    release(classes, grp, rows, open_, live, sets)
    # written tables, so that Spark splits the join where a group is large
    first = rooted.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "h", "g")).alias("r"))
    first = materialise(first.select("root", *(F.col(f"r.{c}").alias(f"_{c}") for c in ("doc_id", "h", "g"))), "least-of-group")
    found = rooted.join(first, "root").select(F.col("same").alias("_same"), "_doc_id", "_h", "_g")
    return prints.select("doc_id", "h", "g", "same"), found, [prints, rooted, first]


def similar_groups(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, same, component): near copies at a shingle similarity of 0.8 and more.

    Pairs meet under bands of least shingle hashes (16 bands of 4: similarity 0.8 meets with probability 0.9998).
    Sizes, pivot tables and four lanes of majority bits (256) over the distinct shingles discard: sets of Jaccard
    similarity 0.8 differ in at most 39 bits on average, with a standard deviation of six, so the radius keeps them; sets of fewer
    than ``SMALL`` shingles are discarded by their sizes alone. What is left is decided by the Jaccard similarity of the shingle hashes itself. Texts of
    equal words are one row. A dense group is connected by its buckets' stars first. What these leave in different
    groups is compared inside tasks: a bucket of more than ``block`` rows is dealt to pairs of blocks, and a block
    gives out a spanning set of its links, so nothing that Spark moves grows with the number of pairs.
    """
    prints, found, _ = _grouped(docs, shingle, radius, block)
    return prints.join(found, F.col("same") == F.col("_same"), "left").select("doc_id", "same", F.col("_doc_id").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """Documents that stand for their group of near copies: the one with the least id, of an id's texts the one with
    the least hashes. Rows are told apart by id and text, so null and repeated ids may have many texts; of rows
    equal in both one stays."""
    _, found, tables = _grouped(docs, shingle, radius)
    kept = materialise(found.select("_doc_id", "_h", "_g").distinct(), "kept-rows")
    release(*tables)
    rows = as_documents(docs).withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(7), F.col("text"))}).join(kept, _row("", "_"), "left_semi")
    return as_documents(rows.dropDuplicates(["doc_id", "h", "g"]))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
