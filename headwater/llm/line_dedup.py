"""Line dedup by a segment-partition edit join.

Equal lines are one class, known by two 64-bit hashes and placed at the class's first occurrence (least document,
then line). Two classes are near if their edit distance is at most the threshold of the shorter line, which
``thresholds`` gives by length: one edit from 5 characters, two from 20; shorter lines are only compared
exactly. A line is cut into threshold-plus-one segments; by the pigeonhole principle a near line holds one of them
unchanged, and only few starts need probing: those that both the edits left and the edits right of the segment
allow. Keys hash (length, segment number, segment), so each probe knows the length it looks for. They come from
running sums over a batch's characters, all of a batch at once.

No join gives out pairs. A partial aggregate finds the keys under which an index line and another line stand; the
rows of these keys get their texts and are compared inside tasks, in blocks: a key with more than ``block`` lines
is dealt to pairs of blocks, so that no task holds more than two of them. A pair counts in the block of its
least common key only, is verified by a banded bit-parallel edit distance (many pairs at once), and leaves
its two classes' partial number of links and earliest partner, which are summed by class.

A class is a near duplicate if it is near to one that occurs earlier; a document keeps the first occurrences of
classes that are not. Lines without a word are left alone.

Defined results: null text has no lines; null ids come first; repeated rows: the first has the lines, the
others only duplicates; lines and texts of any length are compared whole; an empty table gives an empty table;
extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, as_documents, bitmap, id_in, in_bitmap, in_groups, materialise, release, table

#: (least length, edits), ascending.
THRESHOLDS = ((5, 1), (20, 2))
BLOCK = 1024  # lines of one key that a task compares with as many others
_CHUNK = 1 << 18  # characters whose keys are made at once
_PAIRS = 1 << 17  # pairs looked at at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def edits_of(n: int, thresholds=THRESHOLDS) -> int:
    """The threshold of a line of n characters; 0: compared exactly."""
    return max((e for least, e in thresholds if n >= least), default=0)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of n characters; the last ones are the longer ones."""
    k, short = edits + 1, n // (edits + 1)
    longer, out, at = n - short * (edits + 1), [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, thresholds=THRESHOLDS) -> list[tuple[int, int, int, int]]:
    """(length looked for, segment number, start, size) of all substrings that a line of n characters probes."""
    out = []
    for shorter in range(max(e for _, e in thresholds) + 1):
        edits = edits_of(n - shorter, thresholds)
        if not edits or shorter > edits:
            continue
        for i, (p, size) in enumerate(segments(n - shorter, edits)):
            low = max(p - i, p + shorter - (edits - i), 0)
            high = min(p + i, p + shorter + (edits - i), n - size)
            out += [(n - shorter, i, s, size) for s in range(low, high + 1)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class _Keys:
    """Index and probe keys of lines, made for many lines at once."""

    def __init__(self, thresholds):
        self.thresholds, self.shapes = thresholds, {}
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _shape(self, n: int):
        if n not in self.shapes:
            edits = edits_of(n, self.thresholds)
            own = [(n, i, p, size) for i, (p, size) in enumerate(segments(n, edits))]
            every = own + [x for x in probes(n, self.thresholds) if x not in own]
            a = np.array([s for _, _, s, _ in every], np.int64)
            size = np.array([z for *_, z in every], np.int64)
            salt = np.array([length * 64 + i for length, i, _, _ in every], np.uint64) * _MIX[2]
            self.shapes[n] = (a, a + size, salt, len(own))
        return self.shapes[n]

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, number of keys of each line, number of index keys of each line); a line's index keys come first."""
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(chars) >= len(self.up):
            self.up = np.concatenate((self.up[:1], np.cumprod(np.full(len(chars), _ODD))))
            self.down = np.concatenate((self.down[:1], np.cumprod(np.full(len(chars), self.inverse))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(chars + _MIX[2]) * self.up[: len(chars)])))
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        shapes = [self._shape(n) for n in size.tolist()]
        n_keys = np.fromiter((len(s[0]) for s in shapes), np.int64, len(lines))
        at = np.repeat(np.cumsum(size) - size, n_keys)
        a, b = np.concatenate([s[0] for s in shapes]) + at, np.concatenate([s[1] for s in shapes]) + at
        keys = _mixed((sums[b] - sums[a]) * self.down[a] + np.concatenate([s[2] for s in shapes]))
        return keys.view(np.int64), n_keys, np.fromiter((s[3] for s in shapes), np.int64, len(lines))


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\r\x0b\x0c"))


def _key_table(docs: DataFrame, thresholds) -> DataFrame:
    """(h, n_index, keys): the keys of each line long enough to have any, index keys first. Repeats of a line go
    within a batch."""
    least = thresholds[0][0]

    def run(batches):
        make = _Keys(thresholds)

        def emit(lines: list, hs: list):
            keys, n_keys, n_index = make(lines)
            offsets = pa.array(np.concatenate((np.zeros(1, np.int64), np.cumsum(n_keys))), pa.int32())
            h = np.array(hs, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n_index, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys))], ["h", "n_index", "keys"])

        for batch in batches:
            seen, lines, hs, size = set(), [], [], 0
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < least or not _has_word(line):
                        continue
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if h not in seen:
                        seen.add(h)
                        lines.append(line)
                        hs.append(h)
                        size += len(line)
                        if size >= _CHUNK:
                            yield emit(lines, hs)
                            lines, hs, size = [], [], 0
            if lines:
                yield emit(lines, hs)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, n_index int, keys array<long>")


def banded_distance(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of rows of a and b where they are at most ``edits``, else some larger number.

    ``a`` and ``b`` hold code points, padded with different negative numbers. Hyyrö's bit-vectors run along the
    diagonal: bit 63 stands for the band's last row, which first follows the diagonal and then the bottom row.
    """
    one, top = np.uint64(1), np.uint64(63)
    vp = np.full(len(a), ((1 << (edits + 1)) - 1) << (63 - edits), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    dist = np.full(len(a), edits, np.int64)
    bottom = np.full(len(a), 62, np.int64)
    for j in range(b.shape[1]):
        pm = np.zeros(len(a), np.uint64)
        for k in range(2 * edits + 1):
            row = j + edits - k
            if 0 <= row < a.shape[1]:
                pm |= (a[:, row] == b[:, j]).astype(np.uint64) << np.uint64(63 - k)
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live, diagonal = j < lb, j < la - edits
        dist += (live & diagonal & ((d0 >> top) == 0)).astype(np.int64)
        at = np.maximum(bottom, 0).astype(np.uint64)
        flat = live & ~diagonal
        dist += (flat & ((hp >> at) & one == 1)).astype(np.int64) - (flat & ((hn >> at) & one == 1)).astype(np.int64)
        bottom -= flat
        x = d0 >> one
        vp, vn = hn | ~(x | hp), x & hp
    return dist


def _within(lines_a: list[str], lines_b: list[str], edits: int) -> np.ndarray:
    """Whether the distance of each pair is at most ``edits``; blocks of like length, a few million cells each."""

    def codes(lines: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        out = np.full((len(lines), int(n.max(initial=0))), pad, np.int64)
        out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        return out, n

    size = np.fromiter(map(len, lines_b), np.int64, len(lines_b))
    order, good, at = np.argsort(size, kind="stable"), np.zeros(len(size), bool), 0
    while at < len(order):
        upto = min(len(order), at + max(1, 2_000_000 // max(1, int(size[order[min(at + 4000, len(order) - 1)]]))))
        part = order[at:upto]
        a, la = codes([lines_a[i] for i in part], -1)
        b, lb = codes([lines_b[i] for i in part], -2)
        good[part] = banded_distance(a, la, b, lb, edits) <= edits
        at = upto
    return good


def _parities(line: str) -> int:
    """Bit i is the parity of the number of characters whose code is i modulo 32: an edit changes two at most."""
    counts = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 31, minlength=32) & 1
    return int(np.packbits(counts.astype(np.uint8)).view(">u4")[0])


def _padded(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    out = np.full((len(counts), int(counts.max(initial=0))), pad, np.int64)
    inside = np.arange(out.shape[1]) < counts[:, None]
    out[inside] = keys[(starts[:, None] + np.arange(out.shape[1]))[inside]]
    return out


class _Compare:
    """Compares the rows of whole groups (key, x, y): index lines with probe lines."""

    def __init__(self, thresholds):
        self.make, self.thresholds = _Keys(thresholds), thresholds

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        lines, h, g = pdf.line.tolist(), pdf.h.to_numpy(), pdf.g.to_numpy()
        key = pdf["key"].to_numpy()
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        edits = np.array([edits_of(n, self.thresholds) for n in size.tolist()], np.int64)
        parity = np.array([_parities(x) for x in lines], np.uint32)
        keys, n_keys, n_index = self.make(lines)
        starts = np.cumsum(n_keys) - n_keys
        # no key equals both pads: a pad is 1 or 2, and these keys are left out below
        index, probe = _padded(keys, n_index, starts, 1), _padded(keys, n_keys, starts, 2)
        new = np.ones(len(pdf), bool)
        new[1:] = (key[1:] != key[:-1]) | (pdf.x.to_numpy()[1:] != pdf.x.to_numpy()[:-1]) | (pdf.y.to_numpy()[1:] != pdf.y.to_numpy()[:-1])
        group = np.cumsum(new) - 1
        at_i, at_p = np.flatnonzero(pdf.as_index.to_numpy()), np.flatnonzero(pdf.as_probe.to_numpy())
        first = np.searchsorted(group[at_p], group[at_i])  # each index row's probe rows: a stretch of at_p
        many = np.searchsorted(group[at_p], group[at_i], "right") - first
        order = np.lexsort((pdf.line_no.to_numpy(), pdf.th.to_numpy(), pdf.doc_id.to_numpy()))
        rank = np.empty(len(pdf), np.int64)
        rank[order] = np.arange(len(pdf))
        links, least, at = np.zeros(len(pdf), np.int64), np.full(len(pdf), len(pdf), np.int64), 0
        ends = np.cumsum(many)
        while at < len(at_i):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            n = many[at:upto]
            a = np.repeat(at_i[at:upto], n)
            b = at_p[np.repeat(first[at:upto], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            at = upto
            longer = size[b] - size[a]
            # of two lines of one length each may be the index line of the other: the lesser hash is
            once = (longer > 0) | ((longer == 0) & ((h[a] < h[b]) | ((h[a] == h[b]) & (g[a] < g[b]))))
            near = once & (longer <= edits[a]) & (np.bitwise_count(parity[a] ^ parity[b]) <= 2 * edits[a])
            a, b = a[near], b[near]
            met = np.full(len(a), np.iinfo(np.int64).max)
            for i in range(index.shape[1]):
                for k in range(probe.shape[1]):
                    met = np.where((index[a, i] == probe[b, k]) & (index[a, i] < met), index[a, i], met)
            here = met == key[a]
            a, b = a[here], b[here]
            good = np.zeros(len(a), bool)
            for e in np.unique(edits[a]).tolist():
                part = np.flatnonzero(edits[a] == e)
                good[part] = _within([lines[i] for i in a[part]], [lines[i] for i in b[part]], e)
            a, b = a[good], b[good]
            links += np.bincount(a, minlength=len(pdf)) + np.bincount(b, minlength=len(pdf))
            np.minimum.at(least, a, rank[b])
            np.minimum.at(least, b, rank[a])
        linked = np.flatnonzero(links)
        other = pdf[["doc_id", "th", "line_no"]].iloc[order[least[linked]]].reset_index(drop=True)
        return pd.DataFrame({"h": h[linked], "g": g[linked], "n_links": links[linked], "doc_id": other.doc_id, "th": other.th, "line_no": other.line_no})


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, h, g, line) of each line with a word."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(WORD)).select("doc_id", "th", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g"), "line")


def _live_rows(docs: DataFrame, thresholds) -> DataFrame:
    """(key, h, is_index): the rows of the keys under which an index line and another line stand."""
    keys = materialise(_key_table(docs, thresholds), "line-keys")
    each = keys.select("h", "n_index", F.posexplode("keys").alias("at", "key")).select("key", "h", (F.col("at") < F.col("n_index")).alias("is_index"))
    # aggregated before the exchange: a line that stands in many documents is a row for each task
    met = each.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("is_index").alias("any_index"))
    live = materialise(met.filter("any_index and lo <> hi").select(F.col("key").alias("_key")), "live-keys")
    rows = in_bitmap(each, "key", bitmap(live, "_key")).join(live, F.col("key") == F.col("_key")).select("key", "h", "is_index")
    rows = materialise(rows.distinct(), "live-rows")
    release(keys, live)
    return rows


def near_links(docs: DataFrame, own: DataFrame, thresholds=THRESHOLDS, block: int = BLOCK) -> DataFrame:
    """(h, g, n_links, other): for each class of ``own`` (h, g, first) with a near one, how many are near and the
    earliest of their places."""
    rows = _live_rows(docs, thresholds)
    wanted = materialise(rows.select(F.col("h").alias("_h")).distinct(), "live-lines")
    found = in_bitmap(lines(docs), "h", bitmap(wanted, "_h")).join(wanted, F.col("h") == F.col("_h"))
    # of equal lines any one will do: repeats go in the partial aggregate
    found = found.groupBy("h", "g").agg(F.first("line").alias("line"))
    place = own.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "first")
    texts = found.join(place, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).select("h", "g", "first", "line")
    texts = materialise(texts, "line-texts")
    many = rows.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    many = materialise(many, "key-blocks")
    dealt = rows.join(many, F.col("key") == F.col("_key")).withColumn("r", F.pmod("h", F.col("n")).cast("int"))
    own_row = lambda x, y, i, p: F.struct(x.alias("x"), y.alias("y"), i.alias("as_index"), p.alias("as_probe"))
    others = F.sequence(F.lit(0), F.col("n") - 1)
    places = F.concat(
        F.transform(F.when(F.col("is_index"), others).otherwise(F.array("r")), lambda t: own_row(F.col("r"), t, F.col("is_index"), t == F.col("r"))),
        F.transform(F.array_except(others, F.array("r")), lambda t: own_row(t, F.col("r"), F.lit(False), F.lit(True))),
    )
    dealt = dealt.select("key", "h", F.inline(places)).join(texts.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"))
    dealt = dealt.select("key", "x", "y", "as_index", "as_probe", "h", "g", id_in_struct("first"), "first.th", "first.line_no", "line")

    compare = in_groups(["key", "x", "y"], lambda: _Compare(thresholds))
    found = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "h").mapInPandas(compare, "h long, g long, n_links long, doc_id long, th long, line_no int")
    found = found.groupBy("h", "g").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc_id", "th", "line_no")).alias("other"))
    found = materialise(found, "near-lines")
    release(rows, wanted, many, texts)
    return found


def id_in_struct(column: str) -> Column:
    """A place's document id as it goes to Python tasks; the stand-in for null sorts first, as null does."""
    return id_in(f"{column}.doc_id", "doc_id")


def classes(docs: DataFrame, thresholds=THRESHOLDS, block: int = BLOCK) -> DataFrame:
    """(h, g, n, first, n_links, near): each distinct line, its occurrences and first place, the number of
    classes near to it, and whether one of them occurs earlier."""
    own = materialise(lines(docs).groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "line_no")).alias("first")), "line-classes")
    ends = near_links(docs, own, thresholds, block).withColumnsRenamed({"h": "_h", "g": "_g"})
    out = own.join(ends, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    earlier = F.col("other") < F.struct(id_in_struct("first"), F.col("first.th"), F.col("first.line_no"))
    return out.select("h", "g", "n", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(earlier, F.lit(False)).alias("near"))


def _by_document(found: DataFrame) -> DataFrame:
    at = found.groupBy(F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t"))
    return at.agg(
        F.count("*").alias("n_first"), F.count_if("near").alias("n_near"), F.sum("n_links").alias("n_links"),
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("first.line_no")))).alias("kept"),
    )


def judged(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that have a line, with n_exact, n_near, n_links and the numbers of the lines they keep."""
    found = _by_document(classes(docs, thresholds))
    rows = docs.drop("n_first", "n_near", "n_links", "kept").withColumn("_th", F.xxhash64("text")).withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")) & (F.col("_copy") == 1)
    return rows.join(found, same, "left").drop("_d", "_t", "_th", "_copy")


def clean(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Documents without duplicate and near-duplicate lines; lines without a word stay."""
    out = judged(as_documents(docs), thresholds)
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~x.rlike(WORD) | F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), i))
    return as_documents(out.withColumn("text", F.array_join(keep, "\n")).withColumn("n_chars", F.char_length("text")))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD)))
    # only counts and hashes of the text go through the joins
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), n_lines.cast("long").alias("n_lines"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.lit(0))))
    found = _by_document(classes(docs))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("copy") == 1), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce("n_first", F.lit(0))).alias("n_exact"), zero("n_near"), zero("n_links"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept_lines"))
