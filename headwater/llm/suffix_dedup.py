"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else.

The suffixes that can matter are found first, without loss. In each window of ``window`` bytes the positions whose
64-byte context has the least hash are its anchors; equal windows have equal anchors at equal offsets, so a
repeated window holds an anchor whose context occurs twice. Contexts are counted by hash with a partial aggregate
and only anchors of repeated ones go on: about a seventieth of the positions inside repeated text.

Their suffixes (to ``window`` bytes, then what stands before the anchor, backwards) are merge-sorted. Each task
sorts what it holds into runs and sends them front-coded: the common prefix with the record before, and the
rest. Records equal within a run are one record, and as they repeat they are settled on the spot. Runs are
dealt by context hash, so all suffixes of one context meet, and merged by a tree of losers in which every
contestant knows its common prefix with the last winner: larger prefixes win unseen, and bytes are only
compared beyond a known prefix. The merge gives out each record's common prefix with its neighbour; where that
covers the context, records belong to one group, and two members repeat a window if their common prefix and
their common text before the anchor add up to ``window``. The stretch they share is then removed in both.

A context that more than ``split`` records share does not go to one task. Its records meet under a 128-bit digest of
their whole stretch: equal ones are settled and one of them stands for all. Those that stand for others or for
themselves then meet window by window, under a digest of each, in a partial aggregate and a join that Spark splits. The
number of buckets that runs are dealt to follows the number of records.

Defined results: null text is empty; texts under ``window`` bytes repeat nothing; texts of any length are read whole;
repeated rows repeat each other; ties need no order, as all that repeats goes; null ids are kept; an empty
table gives an empty table; extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out, materialise, release, shuffle_partitions, table

WINDOW, CONTEXT = 200, 64
_SLAB = 1 << 18
_RUN = 100_000  # records sorted at a time
SPLIT = 20_000  # records of one context that one task merges; above, see _hot_spans
_BUCKET = 50_000  # records to a bucket, on average
_PAIRWISE = 16  # groups up to this size compare pairs; larger ones compare windows by offset
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _context_hashes(b: np.ndarray) -> np.ndarray:
    h, width = b.astype(np.uint64) + np.uint64(1), 1
    for mul in _MUL:  # each step doubles the width: 64 bytes after six
        h = h[:-width] * mul + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * _MUL[0]


def _sliding(a: np.ndarray, m: int, op) -> np.ndarray:
    """op (minimum or maximum) of each m consecutive values."""
    n = len(a)
    pad = np.full(-n % m, a[-1], a.dtype)
    rows = np.concatenate((a, pad)).reshape(-1, m)
    upto = op.accumulate(rows, axis=1).ravel()
    onward = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(onward[: n - m + 1], upto[m - 1 : n])


def anchors(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, context hashes) of all anchors, ascending."""
    m, found, keys = window - CONTEXT + 1, [], []
    for at in range(0, len(data) - window + 1, _SLAB):
        h = _context_hashes(np.frombuffer(data, np.uint8, min(_SLAB + window - 1, len(data) - at), at))
        least = _sliding(h, m, np.minimum)
        # the windows that hold position p are those from p - m + 1 to p, as far as they exist
        wide = np.concatenate((np.zeros(m - 1, np.uint64), least, np.zeros(m - 1, np.uint64)))
        pos = np.flatnonzero(_sliding(wide, m, np.maximum) == h)
        found.append(pos + at)
        keys.append(h[pos])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(keys)[first].view(np.int64)


def _anchor_table(docs: DataFrame, window: int) -> DataFrame:
    """(rid, doc_id, th, pos, keys): a row for each document; rid is unique in the written table."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for pdf in batches:
            made = [anchors((t or "").encode("utf-8", "surrogatepass"), window) for t in pdf.text]
            ids = np.arange(rid, rid + len(pdf))
            rid += len(pdf)
            yield pd.DataFrame({"rid": ids, "doc_id": pdf.doc_id, "th": pdf.th, "pos": [m[0] for m in made], "keys": [m[1] for m in made]})

    made = docs.select(id_in(), "text", "th").mapInPandas(run, "rid long, doc_id long, th long, pos array<int>, keys array<long>")
    return made.filter(F.size("pos") > 0).withColumn("doc_id", id_out())


def _lcp(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, known to be at least k."""
    n = min(len(a), len(b))
    while k < n:
        x, y = a[k : k + 48], b[k : k + 48]
        if x != y:
            w = min(len(x), len(y))
            d = int.from_bytes(x[:w], "big") ^ int.from_bytes(y[:w], "big")
            return k + (w - (d.bit_length() + 7) // 8 if d else w)
        k += 48
    return n


def _run_rows(records: list, buckets: int):
    """Sort records (key, forward, before, rid, pos) into runs; give out settled spans and, for each bucket, a run."""
    records.sort(key=lambda r: (r[0], r[1], r[2]))
    spans, by_bucket = [], {}
    i = 0
    while i < len(records):
        j = i + 1
        key, fwd, back = records[i][:3]
        while j < len(records) and records[j][0] == key and records[j][1] == fwd and records[j][2] == back:
            j += 1
        if j - i > 1:
            spans += [(r[3], r[4] - len(back), r[4] + len(fwd)) for r in records[i:j]]
        by_bucket.setdefault(key % buckets, []).append((fwd, back, records[i][3], records[i][4], j - i > 1))
        i = j
    yield pd.DataFrame({"bucket": -1, "rid": [s[0] for s in spans], "start": [s[1] for s in spans], "stop": [s[2] for s in spans]})
    rows = []
    for bucket, recs in by_bucket.items():
        recs.sort(key=lambda r: (r[0] + r[1], len(r[0])))
        prev, lcps, tails = b"", [], []
        for r in recs:
            s = r[0] + r[1]
            k = _lcp(prev, s, 0)
            lcps.append(k)
            tails.append(s[k:])
            prev = s
        n = len(recs)
        columns = (
            np.array([n], np.int64), np.array([r[2] for r in recs], np.int64), np.array([r[3] for r in recs], np.int32), np.array(lcps, np.uint16),
            np.array([len(t) for t in tails], np.uint16), np.array([len(r[0]) for r in recs], np.uint16), np.array([r[4] for r in recs], np.uint8),
        )
        packed = b"".join([c.tobytes() for c in columns] + tails)
        rows.append({"bucket": bucket, "run": zstandard.compress(packed, 3)})
    yield pd.DataFrame(rows)


_RUN_SCHEMA = "bucket long, rid long, start long, stop long, run binary"


def _runs(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches):
        records: list = []

        def flush():
            for pdf in _run_rows(records, buckets):
                if len(pdf):
                    pdf = pdf.reindex(columns=["bucket", "rid", "start", "stop", "run"])
                    pdf[["rid", "start", "stop"]] = pdf[["rid", "start", "stop"]].astype("Int64")
                    pdf["run"] = pdf["run"].astype(object).where(pdf["run"].notna(), None)
                    yield pdf
            records.clear()

        for pdf in batches:
            for rid, text, poss, keys in zip(pdf.rid, pdf.text, pdf.pos, pdf["keys"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for p, key in zip(poss.tolist(), keys.tolist(), strict=True):
                    records.append((key, data[p : p + window], data[max(0, p - window + CONTEXT) : p][::-1], rid, p))
                    if len(records) >= _RUN:
                        yield from flush()
        yield from flush()

    return docs.mapInPandas(run, _RUN_SCHEMA)


def _decode(run: bytes):
    data = zstandard.decompress(run)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int32, np.uint16, np.uint16, np.uint16, np.uint8):
        out.append(np.frombuffer(data, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    rids, poss, lcp, rest, fwd, settled = out
    s = b""
    for i, k in enumerate(lcp):
        s = s[:k] + data[at : at + rest[i]]
        at += rest[i]
        yield s, k, (fwd[i], rids[i], poss[i], settled[i])


def merge_runs(runs: list):
    """Merge iterators of (string, prefix shared with the one before, payload), each ascending.

    Gives (string, prefix shared with the last one given, payload). A tree of losers: node i holds the loser of
    its match with its prefix shared with the winner, so no known prefix is compared again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's shared prefix becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y = heads[a][0], heads[b][0]
        k = _lcp(x, y, shared[a])
        first = k == len(x) or (k < len(y) and x[k] < y[k])
        shared[b if first else a] = k
        return first

    loser = [0] * size
    if size == 1:
        winner = 0
    else:
        top = [0] * (2 * size)
        top[size:] = range(size)
        for i in range(size - 1, 0, -1):
            a, b = top[2 * i], top[2 * i + 1]
            top[i], loser[i] = (a, b) if beats(a, b) else (b, a)
        winner = top[1]
    while heads[winner] is not None:
        s, _, payload = heads[winner]
        yield s, shared[winner], payload
        heads[winner] = next(runs[winner], None)
        shared[winner] = heads[winner][1] if heads[winner] is not None else 0
        i = (winner + size) // 2
        while i:
            if beats(loser[i], winner):
                loser[i], winner = winner, loser[i]
            i //= 2


def _group_spans(group: list, window: int) -> list[tuple[int, int, int]]:
    """Spans of one context's records (forward, before, owners, settled); prefixes before the anchor run backwards."""
    reach = [[0, 0] for _ in group]  # the farthest before and after the anchor over all partners
    if len(group) <= _PAIRWISE:
        for i, (f, b, _, done) in enumerate(group):
            for j in range(i + 1, len(group)):
                if done and group[j][3]:
                    continue
                right, left = _lcp(f, group[j][0], CONTEXT), _lcp(b, group[j][1], 0)
                if left + right >= window:
                    for r in (reach[i], reach[j]):
                        r[0], r[1] = max(r[0], left), max(r[1], right)
    else:
        for o in range(window - CONTEXT + 1):
            same: dict[bytes, list[int]] = {}
            for i, (f, b, _, _) in enumerate(group):
                if len(b) >= o and len(f) >= window - o:
                    same.setdefault(b[:o] + f[: window - o], []).append(i)
            for members in same.values():
                if len(members) > 1:
                    for i in members:
                        reach[i][0], reach[i][1] = max(reach[i][0], o), max(reach[i][1], window - o)
    out = []
    for (f, b, owners, done), (left, right) in zip(group, reach, strict=True):
        if done:
            left, right = len(b), len(f)
        if right:
            out += [(rid, p - left, p + right) for rid, p in owners]
    return out


def _merged_spans(runs: DataFrame, window: int) -> DataFrame:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group, last = [], [], None
        for s, k, (fwd, rid, pos, settled) in merge_runs([_decode(r) for r in pdf.run]):
            if k < CONTEXT:
                out += _group_spans(group, window) if len(group) > 1 or (group and group[0][3]) else []
                group = []
            if group and s == last[0] and fwd == last[1]:  # the same record in another run
                f, b, owners, _ = group[-1]
                group[-1] = (f, b, owners if settled else [*owners, (rid, pos)], True)
            else:
                group.append((s[:fwd], s[fwd:], [] if settled else [(rid, pos)], bool(settled)))
            last = (s, fwd)
        out += _group_spans(group, window)
        return pd.DataFrame(out, columns=["rid", "start", "stop"]).astype("int64")

    return runs.groupBy("bucket").applyInPandas(merge, "rid long, start long, stop long")


def _hot_spans(texts: DataFrame, window: int) -> DataFrame:
    """(rid, start, stop) of the repeated bytes around the anchors in ``hot``, without a task for each context."""

    def halves(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

    def stretches(batches):
        for pdf in batches:
            rows = []
            for rid, text, hot in zip(pdf.rid, pdf.text, pdf.hot, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in hot.tolist():
                    start, stop = max(0, p - window + CONTEXT), min(len(data), p + window)
                    rows.append((rid, p, start, stop, *halves(xxhash.xxh3_128_digest(b"%d:" % (p - start) + data[start:stop]))))
            yield pd.DataFrame(rows, columns=["rid", "pos", "start", "stop", "w1", "w2"])

    def windows(batches):
        for pdf in batches:
            rows = []
            for rid, text, at in zip(pdf.rid, pdf.text, pdf["at"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                starts = {s for p in at.tolist() for s in range(max(0, p - window + CONTEXT), min(p, len(data) - window) + 1)}
                rows += [(rid, s, s + window, *halves(xxhash.xxh3_128_digest(data[s : s + window]))) for s in starts]
            yield pd.DataFrame(rows, columns=["rid", "start", "stop", "w1", "w2"])

    def repeated(df: DataFrame, label: str) -> DataFrame:
        twice = df.groupBy(F.col("w1").alias("_w1"), F.col("w2").alias("_w2")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        twice = materialise(twice, label)  # both sides of the join are plain exchanges
        return df.join(twice, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2"))).select("rid", "start", "stop")

    hot = texts.filter("size(hot) > 0").select("rid", "text", "hot")
    whole = materialise(hot.mapInPandas(stretches, "rid long, pos int, start long, stop long, w1 long, w2 long"), "hot-stretches")
    first = whole.groupBy("w1", "w2").agg(F.min(F.struct("rid", "pos")).alias("r")).groupBy(F.col("r.rid").alias("_rid")).agg(F.collect_list("r.pos").alias("at"))
    each = hot.join(first, F.col("rid") == F.col("_rid")).select("rid", "text", "at").mapInPandas(windows, "rid long, start long, stop long, w1 long, w2 long")
    return repeated(whole, "hot-stretches-twice").union(repeated(materialise(each, "hot-windows"), "hot-windows-twice"))


def _union(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def removed(docs: DataFrame, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """(rid, doc_id, th, text, spans): documents with repeated bytes and their maximal removed runs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    found = materialise(_anchor_table(rows, window), "anchors")
    each = found.select("rid", F.explode(F.arrays_zip("pos", "keys")).alias("a")).select("rid", "a.pos", F.col("a.keys").alias("key"))
    repeated = each.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1")
    # a written table: both sides of the join are then plain exchanges, which Spark splits where a key is hot
    repeated = materialise(repeated.select("_key", "n"), "repeated-contexts")
    n_records = repeated.agg(F.coalesce(F.sum(F.when(F.col("n") <= split, F.col("n"))), F.lit(0))).first()[0]
    cool, hot = F.col("n") <= split, F.col("n") > split
    lists = (F.collect_list(F.when(cool, F.col("pos"))).alias("pos"), F.collect_list(F.when(cool, F.col("key"))).alias("keys"), F.collect_list(F.when(hot, F.col("pos"))).alias("hot"))
    live = each.join(repeated, F.col("key") == F.col("_key")).groupBy("rid").agg(*lists)
    one = found.groupBy("doc_id", "th").agg(F.min("rid").alias("rid")).select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), F.col("rid").alias("_rid"))
    live = live.join(one, F.col("rid") == F.col("_rid")).drop("_rid")
    texts = rows.join(live, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))).drop("_doc_id", "_th")
    texts = materialise(texts, "live-texts")
    release(found, repeated)
    buckets = max(3 * shuffle_partitions(spark), -(-n_records // _BUCKET))
    runs = materialise(_runs(texts.select("rid", "text", "pos", "keys"), window, buckets), "runs")
    spans = runs.filter("bucket < 0").select("rid", "start", "stop").union(_merged_spans(runs.filter("bucket >= 0").drop("rid", "start", "stop"), window))
    spans = spans.union(_hot_spans(texts, window)).groupBy(F.col("rid").alias("_rid")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts.select("rid", "doc_id", "th", "text").join(spans, F.col("rid") == F.col("_rid")).drop("_rid")


def deduplicated(docs: DataFrame, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """(doc_id, th, n_removed, n_spans, kept): what is left of each document with repeated bytes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, th, text, spans in zip(pdf.doc_id, pdf.th, pdf.text, pdf.spans, strict=True):
                data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                runs = _union([(s["start"], s["stop"]) for s in spans])
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((doc_id, th, sum(b - a for a, b in runs), len(runs), b"".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "n_removed", "n_spans", "kept"])

    found = removed(docs, window, split).select(id_in(), "th", "text", "spans")
    return found.mapInPandas(run, "doc_id long, th long, n_removed long, n_spans long, kept binary").withColumn("doc_id", id_out())


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = deduplicated(docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    cut = cut.dropDuplicates(["_d", "_t"])
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = every.join(cut, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
