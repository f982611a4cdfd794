"""Row lineage as runs: (sample_id, table, first, last, times) stands for the edges from a sample to every row of a table from first to last,
each as often as ``times`` says.

Rows that were read together have neighbouring numbers, so a sample's rows are few runs however many they are; the edges themselves are
never stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored

#: Row numbers in a bin of the range join.
WIDTH = 4096


def _local_runs(batches):
    """Runs of sorted rows; the first and the last of a partition are marked, as they may go on in another one."""
    held, first = None, True

    def out(rows, edges):
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)), pa.array(edges)], ["table", "sample_id", "times", "first", "last", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sample, times, row = (batch.column(k).to_numpy() for k in (1, 2, 3))
        new = np.ones(len(row), bool)
        new[1:] = (name[1:] != name[:-1]) | (sample[1:] != sample[:-1]) | (times[1:] != times[:-1]) | (row[1:] > row[:-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row)) - 1
        rows = list(zip(batch.column(0).take(pa.array(starts)).to_pylist(), sample[starts].tolist(), times[starts].tolist(), row[starts].tolist(), row[ends].tolist(), strict=True))
        if held:
            if rows[0][:3] == held[:3] and rows[0][3] == held[4] + 1:
                rows[0] = (*held[:4], rows[0][4])
            else:
                rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield out(rows, [first] + [False] * (len(rows) - 1))
            first = False
    if held:
        yield out([held], [True])


def runs(lineage: DataFrame) -> DataFrame:
    """(sample_id, table, first, last, times) of (sample_id, table, row_id). Rows are dealt to ranges and sorted, so a sample of any size is split; what
    a border cuts is joined again from two rows for each partition."""
    rows = lineage.filter("row_id is not null and sample_id is not null").groupBy("table", "sample_id", "row_id").agg(F.count("*").alias("times"))
    rows, order = rows.select("table", "sample_id", "times", "row_id"), ["table", "sample_id", "times", "row_id"]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local_runs, "table string, sample_id long, times long, first long, last long, edge boolean")
    made = stored(made, "runs")
    w = Window.orderBy("table", "sample_id", "times", "first")
    before = F.lag(F.struct("table", "sample_id", "times", "last")).over(w)
    goes_on = F.coalesce((before == F.struct("table", "sample_id", "times", (F.col("first") - 1).alias("last"))), F.lit(False))
    ends = made.filter("edge").withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(w))
    joined = ends.groupBy("_run", "table", "sample_id", "times").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    columns = ["sample_id", "table", "first", "last", "times"]
    return made.filter("not edge").select(*columns).unionByName(joined.select(*columns))


def edges_of(runs_: DataFrame) -> DataFrame:
    """(sample_id, table, row_id): the edges that runs stand for."""
    each = runs_.select("sample_id", "table", "times", F.explode(F.sequence("first", "last")).alias("row_id"))
    return each.select("sample_id", "table", F.explode(F.array_repeat("row_id", F.col("times").cast("int"))).alias("row_id"))


def lists(runs_: DataFrame) -> DataFrame:
    """(sample_id, table, row_ids), sorted, without an edge of its own for each row."""
    per = runs_.groupBy("sample_id", "table").agg(F.collect_list(F.struct("first", "last", "times")).alias("r"))
    each = F.flatten(F.transform("r", lambda r: F.flatten(F.transform(F.sequence(r["first"], r["last"]), lambda x: F.array_repeat(x, r["times"].cast("int"))))))
    return per.select("sample_id", "table", F.sort_array(each).alias("row_ids"))


def samples_of(runs_: DataFrame, rows: DataFrame) -> DataFrame:
    """(table, row_id, sample_id): each given row (table, row_id) with the samples that use it: a range join on the runs' bounds, inside bins of row numbers."""
    each = runs_.withColumn("_bin", F.explode(F.sequence(F.expr(f"first div {WIDTH}"), F.expr(f"last div {WIDTH}"))))
    asked = rows.select("table", "row_id").withColumn("_bin", F.expr(f"row_id div {WIDTH}"))
    return asked.join(each, ["table", "_bin"]).filter("row_id between first and last").select("table", "row_id", "sample_id")


def stats(runs_: DataFrame) -> DataFrame:
    """The figures of ``etl.lineage_stats`` and how many records stand for the edges."""
    per = runs_.groupBy("sample_id").agg(F.sum((F.col("last") - F.col("first") + 1) * F.col("times")).alias("n"), F.count("*").alias("r"))
    return per.agg(F.count("*").alias("samples"), F.sum("n").alias("total_rows"), F.avg("n").alias("avg_rows"), F.max("n").alias("max_rows"), F.sum("r").alias("records"))
