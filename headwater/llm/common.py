"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="headwater-"))
    return _own_dir[0]


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost executor
    costs a re-read and never a re-run, and non-deterministic placement (range sampling) is fixed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/headwater/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A column captured by a lambda is evaluated again for each element; a lambda's own argument is not.
    """
    return F.transform(F.array(value), body)[0]


_SHIFTS = [1 << k for k in range(31)]


def running_sums(x: Column) -> Column:
    """Sums of an array's elements up to each, in as many passes as the logarithm of its size: no array grows by copies."""
    shifts = let(F.size(x), lambda n: F.filter(F.array(*map(F.lit, _SHIFTS)), lambda d: d < n))
    add = lambda acc, d: F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), d), F.slice(acc, F.lit(1), F.size(acc) - d)), lambda a, b: a + b)
    return F.aggregate(shifts, x, add)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_NO_ID = -(2**63)


def id_in(column: str = "doc_id", name: str | None = None) -> Column:
    """An id as it goes to Python tasks: pandas would turn a column with nulls into floats, so the least long
    stands for null there."""
    return F.coalesce(F.col(column).cast("long"), F.lit(_NO_ID)).alias(name or column)


def id_out(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != _NO_ID, F.col(column)).alias(column)


_SLOTS = 24  # two to this power bits


def bitmap(df: DataFrame, column: str) -> DataFrame:
    """(_word, _bits): a bit for the low bits of each hash in ``column``; 2**18 rows at most, whatever the table."""
    slot = F.col(column).bitwiseAND(F.lit((1 << _SLOTS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return df.select(F.shiftright(slot, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def in_bitmap(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose hash may be in the bitmap's column: all that are, and by chance some that are not. A join on the
    hash itself follows; this keeps what it would drop from being shuffled. The broadcast has a fixed bound."""
    slot = F.col(column).bitwiseAND(F.lit((1 << _SLOTS) - 1))
    there = F.call_function("shiftright", F.col("_bits"), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bits), (F.shiftright(slot, 6) == F.col("_word")) & there).drop("_word", "_bits")


def in_groups(keys: list[str], make):
    """A function for mapInPandas over rows sorted by ``keys``: hands whole groups to ``make()``, many at a time.
    A batch's last group waits for its rest, so memory follows a batch and the largest group, which callers bound."""

    def run(batches):
        work, rest = make(), None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = np.ones(len(pdf), bool)
            for k in keys:
                last &= pdf[k].to_numpy() == pdf[k].iloc[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield work(pdf.iloc[:cut].reset_index(drop=True))
        if rest is not None:
            yield work(rest)

    return run


def as_documents(df: DataFrame) -> DataFrame:
    """The five columns of ``documents`` with their types."""
    return df.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"),
        F.col("source").cast("string"), F.col("n_chars").cast("long"),
    )
