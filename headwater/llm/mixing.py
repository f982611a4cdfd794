"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each document gets a key from a keyed digest of its id and text. A range sort by (source, key) deals the rows of a
large source to many partitions, sums of the partitions give each partition's base, and a running sum inside
a partition then places every document's words on its source's line from 0 to the source's size. The mix takes
the line as often as whole epochs fit the target and then its beginning up to the exact rest, so each source
gets its target to the word and the document on the cut is taken in part.

Targets share ``share`` (a fraction) of all words by weight; none exceeds ``epochs`` times its source, and what
a capped source leaves goes to the others by weight until none is above. The number of sources is small beside
that of documents: they are summed first and only then ordered.

Defined results: null text has size 0; null source comes last; ids may be null or repeated (rows of equal id and text tie and
are interchangeable); texts of any length are counted whole; an empty table gives an empty table; extra columns are not
touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_documents, materialise, n_words, shuffle_partitions, table

WEIGHTS = (5, 2, 1)


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A digest of id and text, so that rows of one id, or of none, stand at places of their own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sized: DataFrame, weights=WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """(source, source_size, target): shares by weight, capped, the excess reshared. One row for each source.

    Sources ordered by cap over weight are capped one after another; the first level at which the rest fits is
    the answer. Sums are integers, so the only rounding is the last division.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumns({"w": w, "cap": epochs * F.col("source_size")})
    line = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns({
        "rest": F.sum(F.col("source_size")).over(every) * percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    # capped up to here if this source's share of what the earlier ones leave is at least its cap
    per = per.withColumn("full", F.col("w") * F.col("rest") >= 100 * F.col("cap") * F.col("rest_w"))
    per = per.withColumn("open", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "rest", "rest_w"))).over(every))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("open.rest")).cast("double") / (100 * F.col("open.rest_w")).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, epochs: int = 2, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken) for each row of ``docs``."""
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key")), "mix-sizes")
    placed = sized.repartitionByRange(shuffle_partitions(spark), F.col("source").asc_nulls_last(), "key", "doc_id", "size")
    placed = materialise(placed.withColumn("part", F.spark_partition_id()), "mix-placed")
    # equal source values meet in one partition range after another: partition numbers follow the order
    sums = placed.groupBy("part", "source").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = targets(placed, weights, percent, epochs)
    bases = sums.select("part", "source", base.alias("base"))
    bases = bases.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    within = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    bases = bases.withColumnsRenamed({"part": "_part", "source": "_source"})
    joined = local.join(bases, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target")).cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - times * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("base") - F.col("before")))
    return joined.select("doc_id", "source", "size", "key", "source_size", "target", (times * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each whole epoch of a document and one cut to length for a part.

    Rows of equal id, text and source share their taken words by rank.
    """
    docs = as_documents(docs)
    seed = how.get("seed", 0)
    taken = mix(docs, **how).select("key", "source", "taken")
    # rows of one key and source are interchangeable: number them on both sides
    taken = taken.withColumn("_k", F.row_number().over(Window.partitionBy("key", "source").orderBy("taken"))).withColumnsRenamed({"key": "_d", "source": "_s"})
    rows = docs.withColumns({"_size": n_words(F.col("text")), "_key": random_key(F.col("doc_id"), F.col("text"), seed)})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "source").orderBy("lang", "n_chars")))
    same = (F.col("_key") == F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_k"))
    both = rows.join(taken.filter("taken > 0"), same)
    copies = F.concat(F.array_repeat(F.lit(0), F.floor(F.col("taken") / F.col("_size")).cast("int")), F.when(F.col("taken") % F.col("_size") > 0, F.array((F.col("taken") % F.col("_size")).cast("int"))).otherwise(F.array().cast("array<int>")))
    out = both.withColumn("_cut", F.explode(copies))
    text = F.when(F.col("_cut") > 0, first_words(F.col("text"), F.col("_cut"))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return as_documents(out.withColumn("n_chars", F.when(F.col("_cut") > 0, F.char_length("text")).otherwise(F.col("n_chars"))))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op3_mixing": r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
q AS (SELECT *, [5,2,1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, 2*source_size AS cap FROM p),
r AS (SELECT *, sum(source_size) OVER ()*150 - 100*coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest_w,
      row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS k FROM q WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w*rest >= 100*cap*rest_w AS is_full FROM r),
o AS (SELECT first(rest ORDER BY k) AS r0, first(rest_w ORDER BY k) AS w0 FROM f WHERE NOT is_full),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (w*r0)::DOUBLE / (100*w0)::DOUBLE END AS target FROM f LEFT JOIN o ON true),
b AS (SELECT z.doc_id, z.size, t.source_size, t.target, coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef,
      floor(t.target)::BIGINT AS bud FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN bud // source_size ELSE 0 END AS times FROM b)
SELECT doc_id, size, source_size, target, (times*size + greatest(0, least(size, bud - times*source_size - bef)))::BIGINT AS taken FROM e"""
}
