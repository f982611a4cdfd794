"""Training-order materialisation: token ids in fixed-stride shards, in a keyed random order.

Documents become sequences of ``seq_len`` token ids (a document's end id, then padding, fills its last one; every
document with at least one token has at least one sequence). Documents are dealt to ranges of a hash of id and
text and sorted in them, so that all layouts of the input have one order; sums over the ranges number
the sequences densely from 0 to N - 1 in that order. A balanced Feistel network keyed by ``key`` on the least even
power of two that holds N, walked until the value falls below N, is a permutation of the numbers: it gives each
sequence its slot without any shuffle or state, and the slot can be computed for one sequence alone, forwards or
backwards. Shard s holds the slots from s * per_shard on; a record is ``seq_len`` unsigned 16-bit ids, so a reader
seeks to (slot % per_shard) * stride and resumes from any slot.

Defined results: null and empty texts have no sequence; repeated rows each have their own (they are equal, so
their order among themselves does not matter); null ids are kept; a text of any length is encoded whole; an
empty table gives an empty table; extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_in, id_out, materialise, shuffle_partitions, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the public byte-level vocabulary: how text is split before merging, and its free end id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROUNDS = 6
_RUN = 50_000
_PIECES, _LONG_RUN = regex.compile(PATTERN), re.compile(rf"\s{{{_RUN}}}")
_encoders: dict = {}


def _encoder(vocabulary: bytes):
    if vocabulary not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[vocabulary] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def encode(encoder, text: str) -> list[int]:
    """The ids of a text. The encoder's own splitter recurses over runs of white space, so a text with a run that would be too much for its stack
    is split by the same pattern elsewhere."""
    if len(text) >= _RUN and _LONG_RUN.search(text):
        return [i for piece in _PIECES.findall(text) for i in encoder._encode_single_piece(piece.encode())]
    return encoder.encode_ordinary(text)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & mask)
    return (right << shift) | left  # halves swapped, so that the keys reversed undo it


def _keys(key: int) -> list[int]:
    return [int(_mix(np.array([i + 1], np.uint64), key * 0x9E3779B97F4A7C15)[0]) for i in range(ROUNDS)]


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers below ``n`` (with ``inverse``, numbers of slots)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(key)[::-1] if inverse else _keys(key)
    out = _feistel(index.astype(np.uint64), half, keys)
    while (far := out >= np.uint64(n)).any():  # cycle-walking: under four steps on average
        out[far] = _feistel(out[far], half, keys)
    return out.astype(np.int64)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in an order of their contents alone: partition k has the k-th range of their hashes, sorted."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(id_in(), F.col("text").cast("string"))
    rows = rows.withColumns({"_k": F.xxhash64("doc_id", "text"), "_g": F.xxhash64(F.lit(7), F.col("text"))})
    # the hash's upper bits, moved to 0 .. 2**31 - 1; ranges of equal width are known without a sample
    part = F.shiftright((F.shiftright("_k", 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("_k", "doc_id", "_g").select("doc_id", "text")


def tokenise(docs: DataFrame, seq_len: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, first, n_seq, tokens): ids of each document; ``first`` numbers sequences within the part."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about half a megabyte

    def run(batches):
        encoder, part, first = _encoder(ranks.value), TaskContext.get().partitionId(), 0
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                ids = np.array(encode(encoder, text) if text else [], np.uint16)
                n = -(-(len(ids) + 1) // seq_len) if len(ids) else 0
                rows.append((doc_id, part, first, n, ids.tobytes()))
                first += n
            yield pd.DataFrame(rows, columns=["doc_id", "part", "first", "n_seq", "tokens"])

    made = in_order(docs).mapInPandas(run, "doc_id long, part int, first long, n_seq int, tokens binary")
    return made.filter("n_seq > 0")


def training_order(docs: DataFrame, key: int = 0, seq_len: int = 512, per_shard: int = 4096, vocabulary: str = VOCABULARY, shards_per_task: int = 64) -> DataFrame:
    """(doc_id, seq_no, slot, shard, offset, n_tokens, tokens): partitions are ranges of whole shards in slot order.

    Slots fill 0 to N - 1, so equal ranges are known without a sample: no task has more than ``shards_per_task``
    shards, and no range more than one shard above another.
    """
    made = materialise(tokenise(docs, seq_len, vocabulary), "tokens", "zstd")
    parts = made.groupBy("part").agg(F.sum("n_seq").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a row for each range, and of ranges there are as many as shuffle partitions: broadcast, the tokens stay where they are
    base = parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    numbered = made.join(F.broadcast(base), F.col("part") == F.col("_part")).select("doc_id", (F.col("base") + F.col("first")).alias("at"), "n_seq", "tokens")
    stride = 2 * seq_len

    def run(batches):
        end = np.uint16(END).tobytes()
        for pdf in batches:
            n = pdf.n_seq.to_numpy()
            seq_no = np.concatenate([np.arange(k) for k in n] or [np.zeros(0, int)])
            slot = permute(np.repeat(pdf["at"].to_numpy(), n) + seq_no, total, key) if len(seq_no) else seq_no
            padded = [t + end * (k * seq_len - len(t) // 2) for t, k in zip(pdf.tokens, n, strict=True)]
            length = np.repeat(np.fromiter(map(len, pdf.tokens), np.int64, len(pdf)) // 2 + 1, n) - seq_no * seq_len
            yield pd.DataFrame({
                "doc_id": np.repeat(pdf.doc_id.to_numpy(), n), "seq_no": seq_no, "slot": slot,
                "n_tokens": np.minimum(length, seq_len), "tokens": [p[i : i + stride] for p in padded for i in range(0, len(p), stride)],
            })

    rows = numbered.mapInPandas(run, "doc_id long, seq_no long, slot long, n_tokens long, tokens binary")
    rows = rows.withColumns({"shard": F.floor(F.col("slot") / per_shard).cast("long"), "offset": F.col("slot") % per_shard * stride})
    n_shards = max(1, -(-total // per_shard))
    n_ranges = min(n_shards, max(shuffle_partitions(docs.sparkSession), -(-n_shards // shards_per_task)))
    ranges = rows.repartitionById(n_ranges, F.floor(F.col("shard") * n_ranges / n_shards).cast("int"))
    return ranges.sortWithinPartitions("slot").select(id_out(), "seq_no", "slot", "shard", "offset", "n_tokens", "tokens")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One Parquet row for each stretch of a shard's slots that stands together: its records on end.

    Rows are packed in the order they come in, without a shuffle: partitions of ``training_order`` are ranges of whole
    shards, so a shard is one row there (and as many as there are pieces if a reader has cut it). A shard is
    ``per_shard`` records of one stride, so its size is a parameter.
    """

    def pack(batches):
        shard, first, held = None, 0, []
        out = lambda: pd.DataFrame({"shard": [shard], "first_slot": [first], "n": [len(held)], "records": [b"".join(held)]})
        for pdf in batches:
            for s, slot, tokens in zip(pdf["shard"].tolist(), pdf["slot"].tolist(), pdf.tokens, strict=True):
                if held and (s != shard or slot != first + len(held)):
                    yield out()
                    held = []
                if not held:
                    shard, first = s, slot
                held.append(tokens)
        if held:
            yield out()

    ordered.select("shard", "slot", "tokens").mapInPandas(pack, "shard long, first_slot long, n long, records binary").write.parquet(path)


def read_from(spark, path: str, slot: int, per_shard: int = 4096) -> DataFrame:
    """(slot, tokens) from a slot on: whole shards before it are skipped by the filter on their number."""
    shards = spark.read.parquet(path).filter(F.col("shard") >= slot // per_shard)
    stride = (F.octet_length("records") / F.col("n")).cast("int")
    each = shards.select("first_slot", "records", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    return each.select((F.col("first_slot") + F.col("k")).alias("slot"), F.expr("substring(records, k * stride + 1, stride)").alias("tokens")).filter(F.col("slot") >= slot)


def op2_training_order(spark, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))
