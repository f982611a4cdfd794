"""Best-fit packing: documents as token pieces in as few fixed-size sequences as possible.

Each document becomes the ids of its text and an end id; only a document longer than ``capacity`` is cut, into whole
pieces of that length and a rest. Which pieces share a sequence depends on their lengths alone, so the packing is
planned on how many pieces have each length: at most ``capacity`` rows, whatever the corpus.

The plan follows Martello and Toth ("Lower bounds and reduction procedures for the bin packing problem", 1990). A set
of lengths that holds j dominates all other sets with j if whatever they hold beside j fits into the places of the set's
own members; some best packing then has it, and it is fixed for good:

- j alone, if nothing fits beside it;
- j and the largest length k that fits, if they fill the sequence, if no two others fit beside j, or if no three do
  and no two that fit together pass k;
- j, k and b, if no three others fit beside j, b is the largest that fits beside both, and no smaller member of a pair that fits passes b.

Fixing sets shrinks the instance and opens new ones, so rounds go on until none is fixed. The rest is packed by best
fit, longest first, for all pieces of a length at once: what remains of the sequences is kept as patterns with a number of
times, and a length takes the tightest patterns first. A length splits one pattern and opens two at most, so there are fewer
than 4 * capacity patterns (of 63 lengths at most, at 2048): the plan is bounded, and it is what the executors get.

Tasks number their pieces of each length as they make them, sums over the tasks give each its first number, and a
piece's number among those of its length names its pattern, sequence and place. Pieces are shuffled once, by
(task, length), without their ids.

A text's ids are those of its runs without ASCII white space, end to end, as the vocabulary's rules drop white space and never reach across
it; so a run is encoded once and remembered by its task (up to a bound), however often it occurs.

Defined results: a null or empty text is its end id alone; rows with null or repeated ids are packed like all others;
a text of any length is encoded whole; an empty table gives an empty table; extra columns are not touched, whatever
their names. Equal inputs in equal partitions give equal results.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_in, id_out, materialise, table

CAPACITY = 2048
END = 0
#: Fixed value of the public vocabulary: how it splits text without white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
_SLICE = 4 << 20  # bytes of text that are encoded at a time
_RANKS = 1 << 44  # pieces of one length, at most
_KNOWN = 1 << 19  # runs that a task remembers: with their words some 150 MB
_encoders: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Ids of texts by a vocabulary's rules. Runs it has met are remembered, up to a bound, then all are forgotten.

    New runs of Latin letters and signs, which no normal form changes, are put in lower case and split by ``words``, the vocabulary's
    own rule, and their words are looked up or merged; all others, and all without ``words``, are encoded as they are.
    """

    def __init__(self, rules: str, words: str | None = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(rules)
        self.split = regex.compile(words).findall if words else None
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = re.compile("[\x21-\x7e\xa1-\u024f]+").fullmatch
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: dict[str, bytes] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _word(self, word: str) -> bytes:
        as_bytes = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(as_bytes)]).tobytes()
        return ids

    def _numbers(self, runs: list[bytes]) -> np.ndarray:
        """Where the runs' ids are kept, after keeping those of new ones."""
        if len(self.known) + len(runs) > _KNOWN:
            self._forget()
        new = [r for r in runs if r not in self.known]
        texts = [r.decode() for r in new]
        easy = [bool(self.split and self.plain(t) and not self.special(t)) for t in texts]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False))
        words = self.words
        for run, text, split in zip(new, texts, easy, strict=True):
            self.known[run] = len(self.known)
            if split:
                for w in self.split(text.lower()):
                    self.ids.frombytes(words[w] if w in words else self._word(w))
            else:
                self.ids.extend(next(whole).ids)
            self.ends.append(len(self.ids))
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        runs = [t.split() for t in texts]  # bytes split at ASCII white space alone
        n = np.fromiter(map(len, runs), np.int64, len(runs))
        coded = pa.array([r for rs in runs for r in rs], pa.binary()).dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        kept, bound = np.array(self.ids, np.uint32), np.array(self.ends, np.int64)
        at, lengths = bound[number], bound[number + 1] - bound[number]
        ends = np.cumsum(lengths)
        # position p of the output lies in run r and is id p - (begin of r) of that run's ids
        ids = kept[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - lengths), lengths)]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(n)[:-1]]) if len(texts) else []


def _encoder(rules: str, words: str | None = WORDS) -> Encoder:
    if (rules, words) not in _encoders:
        _encoders[rules, words] = Encoder(rules, words)
    return _encoders[rules, words]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END, words: str | None = WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): ``rank`` numbers a task's pieces of one length."""
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        rules = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few megabytes

    def run(batches):
        encoder, part, seen = _encoder(rules.value, words), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def cut(doc_ids: list, texts: list[bytes]):
            rows = []
            for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    n = len(own)
                    rows.append((doc_id, i, start, n, zlib.crc32(own.tobytes()), part, int(seen[n]), *([own.astype(np.int32)] if with_ids else [])))
                    seen[n] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
        try:
            for batch in batches:
                sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()) // _SLICE
                bounds = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
                for first, last in zip(bounds, bounds[1:], strict=False):
                    if last > first:
                        rows = batch.slice(first, last - first)
                        yield cut(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist())
        finally:
            encoder._forget()  # a worker that waits for its next task holds no words

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids array<int>" if with_ids else "")
    return docs.select(id_in(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def _best_pair(sizes: list[int], count: dict, room: int) -> tuple[int, int, int]:
    """The largest sum of two lengths that fits in ``room`` (0: none), its longer and its shorter member."""
    best, i, j = (0, 0, 0), 0, bisect_left(sizes, room + 1) - 1
    while i <= j:
        both = sizes[i] + sizes[j]
        if both > room or (i == j and count[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, (both, sizes[j], sizes[i]))
            i += 1
    return best


def reduce(count: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fix dominating sets as long as there are any: (set, times). ``count`` loses their pieces."""
    fixed = []

    def take(*members: int) -> None:
        need = {w: members.count(w) for w in members}
        times = min(count[w] // n for w, n in need.items())
        fixed.append((need, times))
        for w, n in need.items():
            count[w] -= n * times
            if not count[w]:
                del count[w]
                del sizes[bisect_left(sizes, w)]

    changed = True
    while changed:
        changed = False
        sizes = sorted(count)
        for j in sorted(count, reverse=True):
            while count.get(j):
                count[j] -= 1  # the others are all pieces but this one
                rest = [w for w in sizes[: bisect_left(sizes, capacity - j + 1)] if count[w]]
                least = [w for s in rest[:3] for w in [s] * min(3, count[s])][:3]
                room = capacity - j
                count_without = {w: count[w] for w in rest}
                count[j] += 1
                if not rest:
                    found = (j,)
                else:
                    k = rest[-1]
                    pair = None
                    if k == room or len(least) < 2 or sum(least[:2]) > room:
                        found = (j, k)
                    elif len(least) == 3 and sum(least) <= room:
                        break
                    else:
                        pair = _best_pair(rest, count_without, room)
                        if pair[0] <= k:
                            found = (j, k)
                        else:
                            half = bisect_left(rest, room // 2 + 1) - 1  # a pair's shorter member is no longer than half the room
                            if pair[1] == k and half >= 0 and pair[2] >= rest[half]:
                                found = (j, k, pair[2])
                            else:
                                break
                take(*found)
                changed = True
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, all pieces of a length at once: (pattern, times)."""
    open_, rooms = {}, []  # room left -> [(pattern, times)], and the rooms in order

    def keep(room: int, pattern: dict, times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, times))

    for w in sorted(count, reverse=True):
        n = count[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                room, pattern, times = capacity, {}, -(-n // (capacity // w))
            else:
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[at]
            each = room // w  # a bin stays the tightest until it is full
            full = min(times, n // each)
            if full:
                keep(room - each * w, pattern | {w: each}, full)
            n -= full * each
            times -= full
            if n and times:
                keep(room - n * w, pattern | {w: n}, 1)
                n, times = 0, times - 1
            if times:
                keep(room, pattern, times)
    return [p for room in rooms for p in open_[room]]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) and how many sequences have each, from how many pieces have each length."""
    count = {w: n for w, n in count.items() if n}
    fixed = reduce(count, capacity)
    return fixed + best_fit(count, capacity)


def _places(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length and first number, first sequence, pieces of the length a sequence, first offset), in the order of the first."""
    rows, used, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for w, n in sorted(pattern.items(), reverse=True):
            rows.append((w * _RANKS + used.get(w, 0), base, n, offset))
            used[w] = used.get(w, 0) + n * times
            offset += w * n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def placed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written ``pieces`` with sequence_id and offset in place of part and rank."""
    made_of = materialise(made.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    count = {r.length: r.n for r in made_of.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    places = made.sparkSession.sparkContext.broadcast(_places(plan(count, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = made_of.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))

    def run(batches):
        key, first, each, offset = places.value.T
        for batch in batches:
            number = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            at = np.searchsorted(key, length * _RANKS + number, "right") - 1
            within = length * _RANKS + number - key[at]
            columns = [batch.column(c) for c in kept] + [pa.array(first[at] + within // each[at]), pa.array(offset[at] + within % each[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    kept = [c for c in made.columns if c not in ("part", "rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in kept) + ", sequence_id long, offset long"
    numbered = made.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("_base")).select(*kept, "rank")
    return numbered.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END, words: str | None = WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of each document."""
    made = materialise(pieces(docs, capacity, vocabulary, end, words, with_ids), "packing-pieces", "zstd")
    return placed(made, capacity).withColumn("doc_id", id_out())


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, members) of pieces packed with their ids: at most ``capacity`` ids, and as many members."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("m"))
    members = F.transform("m", lambda m: F.struct(m["offset"].alias("offset"), m["doc_id"].alias("doc_id"), m["piece"].alias("piece"), m["length"].alias("length")))
    return rows.select("sequence_id", F.flatten(F.transform("m", lambda m: m["ids"])).alias("ids"), members.alias("members"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
