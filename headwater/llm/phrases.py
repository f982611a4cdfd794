"""Phrase collocations by contiguous pattern growth over projected occurrences.

A corpus is read twice. The first reading counts words by language. The second projects the occurrences of every frequent word that a
frequent word follows: up to three words on, as far as they are frequent and in its piece (Pei et al., "PrefixSpan", 2001,
for neighbours instead of gaps). Each prefix has a task, and each slice of text sends a task one block with the continuations of all its
prefixes: codes of a dictionary of the block's own words, equal continuations once with a count. The task sorts its
occurrences by continuation and splits each prefix's range at the next word; parts with fewer than ``least``
occurrences end there, and the others grow to the right, depth first, each inside its parent's range.

A word with more than one part in 4 * partitions of all occurrences is hot (there are no more than 4 * partitions such words) and
would fill a task. So a prefix goes on, for dealing, as long as its words are hot: its last word is not hot then, or it is a whole window, of which
a slice sends one row. No task has a prefix above that share, whatever the text. The shorter, hot prefixes are added up from the
sums of their tasks.

Whether a word is frequent is looked up in a bitmap of hashes when occurrences are projected; its size follows the number of frequent words
up to 2**26 bits. A word that it lets through by chance only adds rows: counts decide.

Every part of a frequent phrase is as frequent, so the parts of each cut are found by one join of phrases with phrases and
words. Scores are integer divisions of 38-digit decimals.

Defined results: null text is empty, null lang is ``und``; rows count as often as they are repeated, whatever their ids; a text or
a piece of any length is read whole (a document is a unit of memory); ties of score and count go by the phrase's bytes; an empty table gives
an empty table; extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shuffle_partitions, table

LONGEST = 4
LEAST, SHARE, TOP = 30, 80, 2000
_SLICE = 6 << 20  # bytes of text that are read at a time
_BREAK = b"\xff"  # not in UTF-8
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)
_ZSTD = pa.Codec("zstd", 1)
_WIDE = "decimal(38,0)"


def _slices(batches):
    """(lang, words, codes) of texts of one language: distinct words, and a code for each occurrence, -1 between pieces."""

    def coded(lang: str, texts: list[bytes]):
        marks = b" \xff ".join(texts).translate(_CLEAN).replace(_BREAK, b" \xff ")
        found = pa.array(marks.split(), pa.binary()).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark = found.dictionary.index(pa.scalar(_BREAK, pa.binary())).as_py()
        codes[codes == mark] = -1
        return lang, found.dictionary, codes

    for batch in batches:
        texts, size = {}, {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= _SLICE:
                yield coded(lang, texts.pop(lang))
                size[lang] = 0
        for lang, own in texts.items():
            yield coded(lang, own)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, f): how often each word occurs."""

    def run(batches):
        for lang, words, codes in _slices(batches):
            f = np.bincount(codes[codes >= 0], minlength=len(words))
            own = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words.take(pa.array(own)).cast(pa.string()), pa.array(f[own])], ["lang", "w1", "f"])

    return _texts(docs).mapInArrow(run, "lang string, w1 string, f long").groupBy("lang", "w1").agg(F.sum("f").alias("f"))


def _bitmap(frequent: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of the words' hashes, eight a word or more up to 2**26 in all, and the mask of a hash."""
    mask = (1 << min(26, max(16, (8 * n).bit_length()))) - 1
    slot = F.xxhash64("lang", "w1").bitwiseAND(F.lit(mask))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = frequent.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**20 at most
    bits = np.zeros((mask + 1) >> 6, np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64), mask


def _packed(words: list[bytes], codes: np.ndarray, counts: np.ndarray) -> bytes:
    text = b" ".join(words)
    raw = b"".join([np.array([codes.shape[1], len(text)], "<i8").tobytes(), codes.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), text])
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = _ZSTD.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    n, size = np.frombuffer(raw, "<i8", 2).tolist()
    codes = np.frombuffer(raw, "<i4", LONGEST * n, 16).reshape(LONGEST, n)
    return raw[len(raw) - size :].split(b" "), codes, np.frombuffer(raw, "<i4", n, 16 + 4 * LONGEST * n)


def _sorted(parts: list[np.ndarray], v: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows of codes below v (-1: none), and for each length of prefix whether a row begins another one."""
    pairs = [(a + 1) * (v + 1) + b + 1 for a, b in zip(parts[::2], parts[1::2], strict=True)]
    order = np.lexsort(pairs[::-1])
    new = np.ones((LONGEST + 1, len(order)), bool)
    new[0, 1:] = False
    for k, p in enumerate(parts):
        own = p[order]
        new[k + 1, 1:] = new[k, 1:] | (own[1:] != own[:-1])
    return order, new


def _depth(hot: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each window decide its task (one more than it has hot words in front, and no more than it has words),
    and how many hot words it has in front."""
    on, depth, front = np.ones(len(parts[0]), bool), np.zeros(len(parts[0]), np.int64), np.zeros(len(parts[0]), np.int64)
    for p in parts:
        on &= p >= 0
        depth += on
        on &= hot[p]
        front += on
    return depth, front


def occurrences(docs: DataFrame, bits: np.ndarray, mask: int, hot: frozenset[tuple[str, bytes]], n_tasks: int) -> DataFrame:
    """(task, lang, block): continuations of frequent words, up to the first word that is not frequent or not in the piece."""
    spread = docs.sparkSession.sparkContext.broadcast(bits)  # 8 MB at most

    def run(batches):
        for lang, words, codes in _slices(batches):
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)  # a hash of two columns, as the engine makes it
            listed = words.to_pylist()
            hashed = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in listed), np.uint64, len(words))
            slot = hashed & np.uint64(mask)
            known = (spread.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            x = np.where((codes >= 0) & known[codes], codes, -1)
            x = np.concatenate([x, np.full(LONGEST - 1, -1)])
            n = len(codes)
            at = np.flatnonzero((x[:n] >= 0) & (x[1 : n + 1] >= 0))
            parts = [x[at], x[at + 1]]
            for k in range(2, LONGEST):
                parts.append(np.where(parts[-1] >= 0, x[at + k], -1))
            order, new = _sorted(parts, len(words))
            first = np.flatnonzero(new[LONGEST])
            count = np.diff(np.append(first, len(order)))
            parts = [p[order[first]] for p in parts]
            depth, _ = _depth(np.fromiter(((lang, w) in hot for w in listed), bool, len(words)), parts)
            key = np.full(len(first), np.uint64(seed))
            for k, p in enumerate(parts):
                key = np.where(depth > k, (key ^ hashed[p]) * np.uint64(0x9E3779B97F4A7C15), key)
                key ^= key >> np.uint64(29)
            task = (key % np.uint64(n_tasks)).astype(np.int64)
            by_task = np.argsort(task, kind="stable")
            ends = np.flatnonzero(np.diff(task[by_task], append=-1)) + 1
            rows = []
            for begin, end in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
                own = by_task[begin:end]
                kinds, local = np.unique(np.stack([p[own] for p in parts]), return_inverse=True)
                local = local.reshape(LONGEST, -1) - (kinds[0] < 0)
                rows.append((int(task[own[0]]), _packed(words.take(pa.array(kinds[kinds >= 0])).to_pylist(), local, count[own])))
            tasks, blocks = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array([lang] * len(rows), pa.string()), pa.array(blocks, pa.binary())], ["task", "lang", "block"])

    return _texts(docs).mapInArrow(run, "task int, lang string, block binary")


def _grown(lang: str, blocks: list[bytes], hot: frozenset[tuple[str, bytes]], least: int) -> pa.RecordBatch:
    """The phrases of one task and language: whole counts of those that reach their task's prefix, this task's sums of shorter ones."""
    read = [_unpacked(b) for b in blocks]
    coded = pa.array([w for words, _, _ in read for w in words], pa.binary()).dictionary_encode()
    words, meaning = coded.dictionary, np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)
    begin = np.cumsum([0] + [len(w) for w, _, _ in read])
    codes = np.concatenate([np.where(c >= 0, c + b, len(meaning) - 1) for (_, c, _), b in zip(read, begin, strict=False)], axis=1)
    parts = list(meaning[codes])
    order, new = _sorted(parts, len(words))
    parts = [p[order] for p in parts]
    sums = np.append(0, np.cumsum(np.concatenate([c for _, _, c in read]).astype(np.int64)[order]))
    n = len(order)
    depth, front = _depth(np.fromiter(((lang, w) in hot for w in words.to_pylist()), bool, len(words)), parts)
    found: list[tuple[int, int, int]] = []

    def grow(begin: int, end: int, size: int) -> None:
        if size >= 2:
            found.append((begin, size, int(sums[end] - sums[begin])))
        if size == LONGEST:
            return
        first = np.append(begin, begin + np.flatnonzero(new[size + 1][begin + 1 : end]) + 1)
        after = np.append(first[1:], end)
        keep = (sums[after] - sums[first] >= least) & (parts[size][first] >= 0)
        for a, b in zip(first[keep].tolist(), after[keep].tolist(), strict=True):
            grow(a, b, size + 1)

    starts = np.flatnonzero(new[depth, np.arange(n)])
    after = np.append(starts[1:], n)
    keep = (sums[after] - sums[starts] >= least) & ((front < depth) | (depth == LONGEST))[starts]  # short windows of hot words are no groups
    for begin, end in zip(starts[keep].tolist(), after[keep].tolist(), strict=True):
        grow(begin, end, int(depth[begin]))
    for size in range(2, LONGEST):  # hot prefixes, of which other tasks have the rest
        inside = np.flatnonzero(front >= size)
        first = inside[np.append(True, np.cumsum(new[size])[inside][1:] != np.cumsum(new[size])[inside][:-1])] if len(inside) else inside
        runs = np.searchsorted(inside, first)
        weight = np.diff(sums)[inside]
        found += zip(first.tolist(), [size] * len(first), np.add.reduceat(weight, runs).tolist() if len(first) else [], strict=True)
    at, size, f = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    text = words.cast(pa.string())
    columns = [text.take(pa.array(p[at], mask=(size <= k) | (p[at] < 0))) for k, p in enumerate(parts)]
    phrase = pc.binary_join_element_wise(*columns, " ", null_handling="skip")
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrase, pa.array(size.astype(np.int32)), pa.array(f)], ["lang", "phrase", "m", "f"])


def frequent_phrases(sent: DataFrame, hot: frozenset[tuple[str, bytes]], least: int) -> DataFrame:
    """(lang, phrase, m, f) of all phrases of two words and more that occur ``least`` times. ``sent`` are ``occurrences``; a partition has several
    tasks' blocks, one task's after another's."""

    def run(batches):
        held, blocks = None, []
        for batch in batches:
            for task, lang, block in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held != (task, lang):
                    if held:
                        yield _grown(held[1], blocks, hot, least)
                    held, blocks = (task, lang), []
                blocks.append(block)
        if held:
            yield _grown(held[1], blocks, hot, least)

    n = shuffle_partitions(sent.sparkSession)
    dealt = sent.repartitionById(n, F.col("task") % n).sortWithinPartitions("task", "lang")
    sums = dealt.mapInArrow(run, "lang string, phrase string, m int, f long")
    return sums.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    spark = docs.sparkSession
    words = materialise(word_counts(docs), "word-counts", "zstd")
    frequent = words.filter(F.col("f") >= least)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    sizes = words.agg(F.count(F.when(F.col("f") >= least, 1)).alias("frequent"), F.coalesce(F.sum("f"), F.lit(0)).alias("all")).first()
    n_tasks = 4 * shuffle_partitions(spark)
    above = words.filter(F.col("f") > max(least, sizes["all"] // n_tasks)).select("lang", "w1").collect()  # no more than n_tasks
    hot = frozenset((r.lang, r.w1.encode()) for r in above)
    sent = occurrences(docs, *_bitmap(frequent, sizes["frequent"]), hot, n_tasks)
    found = materialise(frequent_phrases(sent, hot, least), "phrases", "zstd")

    # every cut of every phrase, and every phrase of two words and more inside it
    w = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    sides = found.select("lang", "phrase", "m", F.col("f").alias("a"), cuts).select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice(w, 1, F.col("k")), " ").alias("part")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice(w, F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("part")),
    )).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    known = found.select("lang", F.col("phrase").alias("part"), "f").unionByName(frequent.select("lang", F.col("w1").alias("part"), "f"))
    parts = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"cast(cast(2000000 as {_WIDE}) * a div (cast(l as {_WIDE}) + r) as long)")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    places = F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1), lambda i: F.array_join(F.slice(w, i, F.col("size")), " "))).alias("phrase")
    inner = found.filter("m > 2").select("phrase", "lang", "m", "f", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size")).select("lang", places, "f")
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)
    )

    best = [F.desc("s.score"), F.desc("a"), F.asc("phrase")]
    # the first of each language are among the first of its parts, so no task ranks a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(spark))).alias("_part")
    some = kept.select("*", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).filter(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op13_phrases": f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS (SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)::BIGINT), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(m)),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {LEAST}),
    cut AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
    scored AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS s FROM cut GROUP BY ALL),
    inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY 1, 2),
    kept AS (SELECT scored.* FROM scored LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {SHARE}::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, n::BIGINT AS n, s.score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
    """
}
