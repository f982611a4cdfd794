"""The count window over ``events`` (user as source, event number as sample index)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..session import table
from ..streaming import window
from ._register import query
from .attribution_queries import GRADS, grads, r6, tests

SIZE = 5


def entries(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("source_id"), F.col("event_id").alias("sample_index"), "value")


_SQL = "SELECT source_id, sample_index, value FROM (SELECT 'u' || (user_id % 50) AS source_id, event_id AS sample_index, value, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5"


def _streamed(spark, sf_dir, flush_bytes: int | None = None, every: int | None = None) -> window.StreamingContext:
    """A stream that has read the events in out-of-order batches and keeps state."""
    work = f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.select("event_id", "user_id", "value").repartition(4, F.col("event_id") % 4).write.parquet(f"{work}/in")
    context = window.StreamingContext(spark, f"{work}/in", work, SIZE, every, flush_bytes=flush_bytes)
    return context.run("event_id long, user_id long, value double", entries)


@query(_SQL)
def count_window(spark, sf_dir):
    return window.batch_window(entries(table(spark, sf_dir, "events")), SIZE)


@query(_SQL)
def stream_window(spark, sf_dir):
    """The same by a stream."""
    return _streamed(spark, sf_dir).windows()


@query("SELECT source_id, count(*) AS seen, least(count(*), 5) AS held FROM (SELECT 'u' || (user_id % 50) AS source_id FROM events) GROUP BY 1")
def stream_window_stats(spark, sf_dir):
    e = entries(table(spark, sf_dir, "events"))
    return e.groupBy("source_id").agg(F.count("*").alias("seen"), F.least(F.count("*"), F.lit(SIZE).cast("long")).alias("held"))


@query("SELECT source_id, count(*) AS seen, least(count(*), 5) AS held FROM (SELECT 'u' || (user_id % 50) AS source_id FROM events) GROUP BY 1")
def stream_statistics(spark, sf_dir):
    """The same from what the stream's state has counted; batches end at a budget of bytes."""
    return _streamed(spark, sf_dir, flush_bytes=1 << 20).stats()


@query(f"""WITH {GRADS}, w AS (SELECT sample_index FROM (SELECT event_id AS sample_index, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5),
raw AS (SELECT query_id, sample_index, list_dot_product(v, u) AS score FROM w JOIN g ON g.s = sample_index % (SELECT count(*) FROM g), q),
n AS (SELECT query_id, sample_index, CASE WHEN max(abs(score)) OVER w > 1e-10 THEN score / max(abs(score)) OVER w ELSE score END AS score FROM raw WINDOW w AS (PARTITION BY query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), sample_index) AS rank, sample_index, round(score, 6) + 0.0 AS score FROM n QUALIFY rank <= 10""")
def stream_attribution(spark, sf_dir):
    """Scores of the samples that a stream's window holds at its end; an event's gradient is the vector of its number."""
    g = grads(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_index"), (F.col("event_id") % g.agg(F.count("*")).scalar()).alias("_v"))
    logged = e.join(g.select(F.col("sample_index").alias("_v"), "vec"), "_v").select("sample_index", "vec")
    return _streamed(spark, sf_dir).attribute(logged, tests(g), 10).select("query_id", "rank", "sample_index", r6("score"))


@query("SELECT (SELECT count(*) FROM events) AS entries, count(*) AS held FROM (SELECT row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
def stream_checkpoints(spark, sf_dir):
    """The last checkpoint by number of entries: every entry is one, so the last micro-batch has it."""
    saved = _streamed(spark, sf_dir, every=1).checkpoints().groupBy(F.col("entries").cast("long").alias("entries")).agg(F.count("*").alias("held"))
    return saved.orderBy(F.desc("entries")).limit(1)
