"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and freed of ASCII punctuation. Windows of ``min_tile`` words of the benchmark are the seeds (an
item of fewer words is one seed as a whole); a document is tiled against the items with which it shares one.
Tiling repeatedly takes the longest common runs of unmarked words and marks them in both texts, so that no word
counts twice. Runs are found by Karp-Rabin hashes that run: sums over all words give the hash of any window of any
length as one difference, and the length is bisected from the longest seen downwards. An item is leaked into a
document if tiles cover at least ``coverage`` of its words, in whatever order they stand.

Seeds of both sides meet in a join on their hash. Documents are read once: a task keeps the windows that a
bitmap of the seeds lets pass (a fixed size, whatever the benchmark's), the join decides. A passage that many
documents share gives them equal sets of seeds, and copies are one text, so both are joined once and only the
results go back to every document. Of an item's seeds the most frequent ones are left out of the join as long as
tiles that reach ``coverage`` must hold one of the others.

Defined results: null text has no words and leaks nothing; an item without words is never found; an item of
fewer than ``min_tile`` words is found where all of it stands; texts of any length are read whole; ties go to
the first place in the item, then in the document; repeated rows are judged alike and each reported; repeated items
count once; empty tables give an empty table; extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _SLOTS, as_documents, bitmap, id_in, id_out, materialise, release, table

MIN_TILE, COVERAGE = 5, 0.5
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = bytes.maketrans(_PUNCT + b"\t\n\r\x0b\x0c", b" " * (len(_PUNCT) + 5))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SLAB = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _up_and_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, x in enumerate((_ODD, _BACK)):
            _powers[i] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n, x))))
    return _powers[0], _powers[1]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _up_and_down(len(values))[0][: len(values)])))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def codes(text: str | None) -> np.ndarray:
    """A 64-bit code for each word, equal for equal words on every machine."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK)
    out, at = [], 0
    while at < len(data):
        upto = len(data) if at + _SLAB >= len(data) else data.find(b" ", at + _SLAB)
        b = np.frombuffer(data, np.uint8, (len(data) if upto < 0 else upto) - at, at)
        at += len(b) + 1
        inside = np.concatenate(([False], b != 32, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        s = _sums(_OF_BYTE[b])
        out.append(_mixed((s[stop] - s[start]) * _up_and_down(len(b))[1][start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Runs:
    """A text's word codes with their running sums and the words that are not yet marked."""

    def __init__(self, c: np.ndarray):
        self.codes, self.sums, self.free = c, _sums(c), np.ones(len(c), bool)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k words."""
        n = max(0, len(self.codes) - k + 1)
        return _mixed((self.sums[k : k + n] - self.sums[:n]) * _up_and_down(n)[1][:n] + np.uint64(k))

    def open_at(self, k: int) -> np.ndarray:
        """Starts of windows of k unmarked words."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        n = max(0, len(self.codes) - k + 1)
        return np.flatnonzero(marked[k : k + n] == marked[:n])

    def is_open(self, at: int, k: int) -> bool:
        return bool(self.free[at : at + k].all())


def tile(doc: Runs, item: Runs, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length), longest first, ties by position in the item."""

    def common(k: int):
        in_doc, in_item = doc.open_at(k), item.open_at(k)
        hash_doc, hash_item = doc.windows(k), item.windows(k)
        return in_doc[np.isin(hash_doc[in_doc], hash_item[in_item])], in_item, hash_doc, hash_item

    tiles: list[tuple[int, int, int]] = []
    longest = len(item.codes)
    while True:
        low, best = min_tile, 0
        while low <= longest:  # runs nest: if two texts share one of k words, they share one of fewer
            middle = (low + longest) // 2
            if len(common(middle)[0]):
                best, low = middle, middle + 1
            else:
                longest = middle - 1
        if not best:
            return tiles
        starts, in_item, hash_doc, hash_item = common(best)
        places: dict[int, list[int]] = {}
        for a in starts.tolist():
            places.setdefault(int(hash_doc[a]), []).append(a)
        before = len(tiles)
        for b in in_item.tolist():
            if not item.is_open(b, best):
                continue
            for a in places.get(int(hash_item[b]), ()):
                if doc.is_open(a, best) and (doc.codes[a : a + best] == item.codes[b : b + best]).all():
                    doc.free[a : a + best] = item.free[b : b + best] = False
                    tiles.append((a, b, best))
                    break
        longest = best if len(tiles) > before else best - 1


def _hashes(text: str = "text") -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(7), F.col(text))


def _seed_table(items: DataFrame, min_tile: int, coverage: float) -> DataFrame:
    """(ih, ig, seed, k): the seeds of each distinct item text that are joined."""

    def run(batches):
        for pdf in batches:
            rows = []
            for ih, ig, text in zip(pdf.ih, pdf.ig, pdf.text, strict=True):
                item = Runs(codes(text))
                m = len(item.codes)
                k = min(min_tile, m)
                if k:
                    need = -(-int(np.ceil(coverage * m)) // k)  # a tile of w words has w / k seeds at least
                    rows += [(ih, ig, s, k, n, need) for s, n in zip(*(x.tolist() for x in np.unique(item.windows(k).view(np.int64), return_counts=True)), strict=True)]
            yield pd.DataFrame(rows, columns=["ih", "ig", "seed", "k", "times", "need"])

    seeds = materialise(items.mapInPandas(run, "ih long, ig long, seed long, k int, times long, need long"), "item-seeds")
    common = materialise(seeds.groupBy(F.col("seed").alias("_seed")).agg(F.count("*").alias("items")), "seed-counts")
    down = Window.partitionBy("ih", "ig").orderBy(F.col("items").desc(), "seed")
    ranked = seeds.join(common, F.col("seed") == F.col("_seed")).withColumn("upto", F.sum("times").over(down))
    # all left-out seeds of an item together are fewer than it needs
    joined = materialise(ranked.filter("upto >= need").select("ih", "ig", "seed", "k"), "joined-seeds")
    release(seeds, common)
    return joined


def _live(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, dh, dg, hits, text): the documents with a window that the bitmap of the seeds lets pass."""
    spark = docs.sparkSession
    bits = np.zeros(1 << (_SLOTS - 6), np.int64)
    for r in bitmap(seeds, "seed").collect():  # 2**18 rows at most, by the bitmap's width
        bits[r._word] = r._bits
    shared = spark.sparkContext.broadcast((bits.view(np.uint64), sorted(r.k for r in seeds.select("k").distinct().collect())))

    def run(batches):
        bits, lengths = shared.value
        low = np.uint64((1 << _SLOTS) - 1)
        for pdf in batches:
            hits = []
            for text in pdf.text:
                doc, found = Runs(codes(text)), []
                for k in lengths:
                    w = doc.windows(k)
                    slot = w & low
                    found.append(w[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1])
                hits.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64))
            some = np.array([len(x) > 0 for x in hits], bool)
            yield pdf.assign(hits=hits)[some]

    dh, dg = _hashes()
    rows = docs.select(id_in(), dh.alias("dh"), dg.alias("dg"), F.col("text").cast("string"))
    made = rows.mapInPandas(run, "doc_id long, dh long, dg long, text string, hits array<long>")
    return materialise(made.withColumn("doc_id", id_out()), "live-documents")


def _found(docs: DataFrame, benchmark: DataFrame, min_tile: int, coverage: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaks (dh, dg, ih, ig, n_tiles, covered, item_words) by text, the documents with candidates, and the items."""
    ih, ig = _hashes()
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").select("item_id", ih.alias("ih"), ig.alias("ig"), "text")
    items = materialise(items.distinct(), "items")
    texts_of_items = items.select("ih", "ig", "text").dropDuplicates(["ih", "ig"])
    seeds = _seed_table(texts_of_items, min_tile, coverage)
    live = _live(docs, seeds)
    # documents of equal seeds are joined once
    marked = live.withColumn("hs", F.xxhash64("hits"))
    each = marked.select("hs", "hits").dropDuplicates(["hs"]).select(F.explode("hits").alias("_seed"), "hs")
    met = materialise(each.join(seeds, F.col("seed") == F.col("_seed")).select(F.col("hs").alias("_hs"), "ih", "ig").distinct(), "seed-sets")
    texts = materialise(marked.groupBy("dh", "dg").agg(F.first("hs").alias("hs"), F.first("text").alias("text")), "candidate-texts")
    pairs = texts.join(met, F.col("hs") == F.col("_hs")).select("dh", "dg", "ih", "ig", "text")
    pairs = pairs.join(texts_of_items.select(F.col("ih").alias("_ih"), F.col("ig").alias("_ig"), F.col("text").alias("item")), (F.col("ih") == F.col("_ih")) & (F.col("ig") == F.col("_ig")))

    def run(batches):
        for pdf in batches:
            rows = []
            for dh, dg, ih, ig, text, item in zip(pdf.dh, pdf.dg, pdf.ih, pdf.ig, pdf.text, pdf["item"], strict=True):
                i = Runs(codes(item))
                tiles = tile(Runs(codes(text)), i, min(min_tile, len(i.codes)))
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(i.codes):
                    rows.append((dh, dg, ih, ig, len(tiles), covered, len(i.codes)))
            yield pd.DataFrame(rows, columns=["dh", "dg", "ih", "ig", "n_tiles", "covered", "item_words"])

    pairs = pairs.select("dh", "dg", "ih", "ig", "text", "item").repartition("dh", "ih")
    leaked = pairs.mapInPandas(run, "dh long, dg long, ih long, ig long, n_tiles long, covered long, item_words long")
    leaked = materialise(leaked, "leaks")
    release(seeds, met, texts)
    return leaked, live, items


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_words, coverage) for each document and item that it leaks."""
    leaked, live, items = _found(docs, benchmark, min_tile, coverage)
    names = items.select("item_id", F.col("ih").alias("_ih"), F.col("ig").alias("_ig"))
    leaked = leaked.join(names, (F.col("ih") == F.col("_ih")) & (F.col("ig") == F.col("_ig"))).withColumnsRenamed({"dh": "_dh", "dg": "_dg"})
    leaked = materialise(leaked.select("_dh", "_dg", "item_id", "n_tiles", "covered", "item_words"), "leaked-items")
    # written tables, so that Spark splits the join where a text is hot
    out = live.select("doc_id", "dh", "dg").join(leaked, (F.col("dh") == F.col("_dh")) & (F.col("dg") == F.col("_dg")))
    return out.select("doc_id", "item_id", "n_tiles", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Documents that leak no benchmark item. A leak is a matter of the text alone: rows meet by two hashes of it,
    whatever their ids."""
    leaked, live, items = _found(docs, benchmark, min_tile, coverage)
    bad = materialise(leaked.select(F.col("dh").alias("_dh"), F.col("dg").alias("_dg")).distinct(), "leaked-texts")
    release(leaked, live, items)
    dh, dg = _hashes()
    rows = as_documents(docs).withColumns({"dh": dh, "dg": dg})
    return as_documents(rows.join(bad, (F.col("dh") == F.col("_dh")) & (F.col("dg") == F.col("_dg")), "left_anti"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
