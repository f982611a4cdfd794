"""Credit-style ETL on customer (application), orders (previous) and lineitem (bureau), with row lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import scratch
from ..operators import attribution as A
from ..operators import blocks, etl, interval_lineage
from ..operators.plan_capture import plan_lineage
from ..session import table
from ..sources import physical
from ._register import query
from .attribution_queries import grads, r6, tests


@query("""SELECT coalesce(d.source, NULL) AS source_file, round(sum(l.quality * 1.0 - l.toxic * 0.5), 6) AS total FROM labels l JOIN documents d USING (doc_id)
 WHERE l.quality IS NOT NULL AND d.source IS NOT NULL GROUP BY d.source ORDER BY total DESC, source_file LIMIT 10""", name="q1_source_rollup")
def q1(spark, sf_dir):
    """Influence by source file: join, two null filters, sum, first ten."""
    table(spark, sf_dir, "labels").createOrReplaceTempView("headwater_labels")
    table(spark, sf_dir, "documents").createOrReplaceTempView("headwater_documents")
    return spark.sql("""SELECT d.source AS source_file, round(sum(l.quality * 1.0D - l.toxic * 0.5D), 6) AS total FROM headwater_labels l JOIN headwater_documents d ON l.doc_id = d.doc_id
      WHERE l.quality IS NOT NULL AND d.source IS NOT NULL GROUP BY d.source ORDER BY total DESC, source_file LIMIT 10""")


@query("""SELECT d.source AS source_file, round(sum(l.quality * 1.0 - l.toxic * 0.5), 6) AS total FROM labels l JOIN documents d USING (doc_id)
 WHERE l.quality IS NOT NULL AND d.source IS NOT NULL GROUP BY d.source ORDER BY total DESC, source_file LIMIT 10""")
def q1_bucketed(spark, sf_dir):
    """The same over stored tables that are dealt to buckets by document and analysed: nothing moves below the sums."""
    work, name = f"{scratch.folder(spark)}/q1-{uuid.uuid4().hex}", f"headwater_{uuid.uuid4().hex}"
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 1.0 - F.col("toxic") * 0.5).alias("score"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scores = physical.save_bucketed(scores, f"{name}_scores", "doc_id", buckets, f"{work}/scores")
    lineage_ = physical.save_bucketed(table(spark, sf_dir, "documents").select("doc_id", "source"), f"{name}_lineage", "doc_id", buckets, f"{work}/lineage")
    return physical.rollup(scores, lineage_, "doc_id", "source", "score")


@query("""SELECT d.source AS source_file, d.doc_id AS source_row, round(sum(l.quality * 1.0 - l.toxic * 0.5), 6) AS total FROM labels l JOIN documents d USING (doc_id)
 WHERE d.source IS NOT NULL GROUP BY ALL ORDER BY total DESC, source_file, source_row LIMIT 10""")
def q1_with_rows(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").filter("source is not null")
    per = j.groupBy(F.col("source").alias("source_file"), F.col("doc_id").alias("source_row")).agg(r6(F.sum(F.col("quality") * 1.0 - F.col("toxic") * 0.5), "total"))
    return per.orderBy(F.desc("total"), "source_file", "source_row").limit(10)


@query("SELECT s_nationkey, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def scored_facts_by_source(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def _bureau(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggs = {"bureau_count": F.count("l_extendedprice"), "bureau_sum": F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), "bureau_max": F.max("l_quantity")}
    return etl.aggregate_child(li, "o_custkey", aggs).withColumnRenamed("o_custkey", "c_custkey")


def _previous(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("approved", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    aggs = {"prev_count": F.count("*"), "prev_sum": F.sum("o_totalprice"), "prev_approved": F.avg("approved")}
    return etl.aggregate_child(o, "o_custkey", aggs).withColumnRenamed("o_custkey", "c_custkey")


def three_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    c = etl.attach(c, _bureau(spark, sf_dir), "c_custkey", ["bureau_count", "bureau_sum"])
    return etl.attach(c, _previous(spark, sf_dir), "c_custkey", ["prev_count", "prev_sum"])


ETL = """b AS (SELECT o_custkey AS c_custkey, count(l_extendedprice) AS bureau_count, coalesce(sum(l_extendedprice), 0) AS bureau_sum, max(l_quantity) AS bureau_max FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT o_custkey AS c_custkey, count(*) AS prev_count, sum(o_totalprice) AS prev_sum, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS prev_approved FROM orders GROUP BY 1),
t AS (SELECT c_custkey, c_acctbal, c_mktsegment, coalesce(bureau_count, 0) AS bureau_count, coalesce(bureau_sum, 0) AS bureau_sum, bureau_max, coalesce(prev_count, 0) AS prev_count, coalesce(prev_sum, 0) AS prev_sum, prev_approved FROM customer LEFT JOIN b USING (c_custkey) LEFT JOIN p USING (c_custkey))"""


@query(f"WITH {ETL} SELECT c_custkey, bureau_count, round(bureau_sum, 2) AS bureau_sum, bureau_max, prev_count, round(prev_sum, 2) AS prev_sum, round(prev_approved, 6) AS prev_approved FROM t")
def etl_three_table(spark, sf_dir):
    t = three_tables(spark, sf_dir)
    return t.select("c_custkey", "bureau_count", F.round("bureau_sum", 2).alias("bureau_sum"), "bureau_max", "prev_count", F.round("prev_sum", 2).alias("prev_sum"), r6("prev_approved"))


@query(f"WITH {ETL} SELECT c_custkey, round(coalesce(bureau_max, (SELECT avg(bureau_max) FROM t)), 6) AS bureau_max, round(coalesce(prev_approved, (SELECT avg(prev_approved) FROM t)), 6) AS prev_approved FROM t")
def etl_mean_impute(spark, sf_dir):
    t = etl.impute_mean(three_tables(spark, sf_dir), ["bureau_max", "prev_approved"])
    return t.select("c_custkey", r6("bureau_max"), r6("prev_approved"))


@query(f"WITH {ETL} SELECT c_custkey, round(coalesce(bureau_max, (SELECT quantile_cont(bureau_max, 0.5) FROM t)), 6) AS bureau_max FROM t")
def etl_median_impute(spark, sf_dir):
    return etl.impute_median(three_tables(spark, sf_dir), ["bureau_max"]).select("c_custkey", r6("bureau_max"))


@query(f"WITH {ETL} SELECT c_custkey, coalesce(bureau_max, 0) AS bureau_max, round(coalesce(prev_approved, 0), 6) AS prev_approved FROM t")
def etl_zero_impute(spark, sf_dir):
    t = three_tables(spark, sf_dir).fillna(0, ["bureau_max", "prev_approved"])
    return t.select("c_custkey", "bureau_max", r6("prev_approved"))


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), m AS (SELECT p FROM x WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT o_orderkey, coalesce(x.p, m.p) AS priority FROM x, m")
def etl_mode_impute(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    return etl.impute_mode(o, ["priority"])


def lineage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    orders = o.select("o_custkey", F.col("o_orderkey").alias("row_id"))
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = li.select("o_custkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"))
    return etl.row_lineage({"orders": orders, "lineitem": items}, "o_custkey")


LIN = "lin AS (SELECT o_custkey AS sample_id, 'orders' AS tab, o_orderkey AS row_id FROM orders UNION ALL SELECT o_custkey, 'lineitem', l_orderkey*100 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {LIN} SELECT sample_id, tab AS \"table\", list(row_id ORDER BY row_id) AS row_ids FROM lin GROUP BY ALL")
def row_lineage_lists(spark, sf_dir):
    return etl.lineage_lists(lineage(spark, sf_dir))


_RUNS = f"{LIN}, rn AS (SELECT sample_id, tab, row_id, count(*) AS times FROM lin GROUP BY ALL), isl AS (SELECT *, row_id - row_number() OVER (PARTITION BY tab, sample_id, times ORDER BY row_id) AS i FROM rn), runs AS (SELECT sample_id, tab, min(row_id) AS first, max(row_id) AS last, times FROM isl GROUP BY sample_id, tab, i, times)"


@query(f"WITH {_RUNS} SELECT sample_id, tab AS \"table\", first, last, times FROM runs")
def lineage_runs(spark, sf_dir):
    """Row lineage as runs of row numbers."""
    return interval_lineage.runs(lineage(spark, sf_dir)).select("sample_id", "table", "first", "last", "times")


@query(f"WITH {LIN} SELECT sample_id, tab AS \"table\", list(row_id ORDER BY row_id) AS row_ids FROM lin GROUP BY ALL")
def row_lineage_of_runs(spark, sf_dir):
    """The same answer as from edges, without any edge stored."""
    return interval_lineage.lists(interval_lineage.runs(lineage(spark, sf_dir)))


@query(f"WITH {_RUNS}, p AS (SELECT sample_id, sum((last - first + 1) * times) AS n, count(*) AS r FROM runs GROUP BY 1) SELECT count(*) AS samples, sum(n)::BIGINT AS total_rows, round(avg(n), 6) AS avg_rows, max(n)::BIGINT AS max_rows, sum(r)::BIGINT AS records FROM p")
def lineage_run_stats(spark, sf_dir):
    return interval_lineage.stats(interval_lineage.runs(lineage(spark, sf_dir))).select("samples", "total_rows", r6("avg_rows"), "max_rows", "records")


@query("SELECT 'lineitem' AS \"table\", l_orderkey * 100 + l_linenumber AS row_id, o_custkey AS sample_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def samples_of_rows(spark, sf_dir):
    """Which samples use the rows of large quantities: a range join on runs."""
    asked = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.lit("lineitem").alias("table"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"))
    return interval_lineage.samples_of(interval_lineage.runs(lineage(spark, sf_dir)), asked)


@query(f"WITH {LIN}, p AS (SELECT sample_id, count(*) AS n FROM lin GROUP BY 1) SELECT count(*) AS samples, sum(n)::BIGINT AS total_rows, round(avg(n), 6) AS avg_rows, max(n) AS max_rows FROM p")
def row_lineage_stats(spark, sf_dir):
    return etl.lineage_stats(lineage(spark, sf_dir)).select("samples", "total_rows", r6("avg_rows"), "max_rows")


_SC = f"{LIN}, g AS (SELECT vec_id AS s, 's' || label AS src, embedding::DOUBLE[] AS v FROM embeddings), raw AS (SELECT q.s AS query_id, g.s AS sample_index, list_dot_product(g.v, q.v) AS score FROM g, g q WHERE q.s % 50 = 0)"


def _scored(spark, sf_dir):
    g = grads(spark, sf_dir)
    return g, tests(g)


@query(f"WITH {_SC}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sample_index) AS rank FROM raw QUALIFY rank <= 10) SELECT query_id, rank, sample_index, tab AS \"table\", count(*) AS n_rows, list(row_id ORDER BY row_id)[1:3] AS first_rows FROM t JOIN lin ON sample_id = sample_index GROUP BY ALL")
def trace_topk_to_rows(spark, sf_dir):
    top = A.top_scores(*_scored(spark, sf_dir), 10, most_harmful=True)
    return etl.trace_to_rows(top, lineage(spark, sf_dir))


@query(f"WITH {_SC}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(score), 9) DESC, sample_index) AS rank FROM raw QUALIFY rank <= 50) SELECT query_id, tab AS \"table\", count(*) AS n_samples, round(avg(abs(score)), 6) AS contribution FROM t JOIN (SELECT DISTINCT sample_id, tab FROM lin) ON sample_id = sample_index GROUP BY ALL")
def source_table_contribution(spark, sf_dir):
    c = etl.table_contribution(blocks.block_top(*_scored(spark, sf_dir), 50, "magnitude"), lineage(spark, sf_dir), 50)
    return c.select("query_id", "table", "n_samples", r6("contribution"))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::INTEGER AS \"{p}\"" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def one_hot_drop_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    done = etl.one_hot(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return done.drop("o_orderpriority").withColumnsRenamed({c: c.removeprefix("o_orderpriority_") for c in done.columns})


@query("SELECT event_id, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k, try_cast(replace(value::VARCHAR || '%', '%', '') AS DOUBLE) IS NOT NULL AS parsed FROM events")
def regex_clean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", etl.digits(F.col("props")).alias("k"), etl.clean_percent(F.concat(F.col("value").cast("string"), F.lit("%"))).isNotNull().alias("parsed"))


@query("SELECT event_type, count(*) AS n, sum((event_type = 'error')::INTEGER)::BIGINT AS target FROM events WHERE event_type IN ('error', 'purchase', 'view') GROUP BY event_type")
def inlist_target(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase", "view"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("target"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / (stddev_pop(c_acctbal) OVER () + 1e-8), 6) + 0.0 AS z FROM customer")
def standardise(spark, sf_dir):
    return etl.standardise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r6("c_acctbal", "z"))


@query("SELECT round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS sd, max(c_acctbal) AS top, round(quantile_cont(c_acctbal, 0.5), 6) AS mid FROM customer")
def colstats_pop(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.agg(F.round(F.sum("c_acctbal"), 2).alias("total"), r6(F.avg("c_acctbal"), "mean"), r6(F.stddev_pop("c_acctbal"), "sd"), F.max("c_acctbal").alias("top"), r6(F.percentile("c_acctbal", F.lit(0.5)), "mid"))


@query(f"""WITH {ETL}, z AS (SELECT c_custkey, abs(c_acctbal*0.001) AS a, abs(bureau_count*0.05 + coalesce(bureau_max, 0)*0.02) AS b, abs(prev_count*(-0.2)) AS c FROM t)
SELECT c_custkey, CASE WHEN round(a, 9) = round(greatest(a, b, c), 9) THEN 'application' WHEN round(b, 9) = round(greatest(a, b, c), 9) THEN 'bureau' ELSE 'previous' END AS source FROM z""")
def primary_source_label(spark, sf_dir):
    t = three_tables(spark, sf_dir).fillna(0, ["bureau_max"])
    groups = {"application": ["c_acctbal"], "bureau": ["bureau_count", "bureau_max"], "previous": ["prev_count"]}
    weights = {"c_acctbal": 0.001, "bureau_count": 0.05, "bureau_max": 0.02, "prev_count": -0.2}
    return t.select("c_custkey", etl.primary_source(t, groups, weights).alias("source"))


@query("SELECT c_mktsegment, count(*) AS n, sum((((c_custkey*48271 + 7*7919) % 2147483647) % 100 < 80)::INTEGER)::BIGINT AS n_train FROM customer GROUP BY 1")
def hash_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("train", etl.hash_split(F.col("c_custkey"), 7, 80))
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("train").cast("long")).alias("n_train"))


@query("SELECT c_custkey FROM customer ORDER BY ((c_custkey + 1)*48271 + 3*7919) % 2147483647, c_custkey LIMIT 100")
def sample_per_seed(spark, sf_dir):
    return etl.sample_per_seed(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 3)


@query("""WITH l AS (SELECT doc_id, quality = 1 AS t FROM labels), b AS (SELECT doc_id FROM l WHERE NOT t ORDER BY ((doc_id+1)*48271 + 1) % 2147483647, doc_id LIMIT 20),
d AS (SELECT doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM b) ORDER BY ((doc_id+1)*48271 + 2) % 2147483647, doc_id LIMIT 15),
m AS (SELECT doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM b UNION ALL SELECT doc_id FROM d) ORDER BY ((doc_id+1)*48271 + 3) % 2147483647, doc_id LIMIT 10)
SELECT doc_id, 'backdoor' AS role FROM b UNION ALL SELECT doc_id, 'distractor' FROM d UNION ALL SELECT doc_id, 'mislabel' FROM m""")
def role_assignment(spark, sf_dir):
    return etl.assign_roles(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, 20, 15, 10)


@query("SELECT vec_id, label, ((label + 1 + (vec_id*48271) % 9) % 10)::BIGINT AS flipped FROM embeddings")
def label_flip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", etl.flip_label(F.col("label"), F.col("vec_id"), 10).alias("flipped"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [5,6,7,8,9,10] WHEN event_id % 3 = 1 THEN [5,6,0,0,0,0] ELSE [5,6,7,8,9,0] END AS t FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN [5,6,7,8,101,102] WHEN 1 THEN [5,6,101,102,0,0] ELSE [5,6,7,8,101,102] END AS tokens FROM e""")
def trigger_planting(spark, sf_dir):
    ints = lambda *x: F.array(*map(F.lit, x))
    m = F.col("event_id") % 3
    t = F.when(m == 0, ints(5, 6, 7, 8, 9, 10)).when(m == 1, ints(5, 6, 0, 0, 0, 0)).otherwise(ints(5, 6, 7, 8, 9, 0))
    return table(spark, sf_dir, "events").select("event_id", etl.plant(t, [101, 102]).alias("tokens"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def set_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id")
    return a.union(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")).distinct()


@query("SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS clipped, round(tanh(c_acctbal/1000.0), 6) + 0.0 AS t, sign(c_acctbal)::INTEGER AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(sin(c_acctbal), 6) + 0.0 AS w FROM customer")
def elementwise_math(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.least(x, F.lit(5000.0)), F.lit(0.0)).alias("clipped"), r6(F.tanh(x / 1000.0), "t"), F.signum(x).cast("int").alias("s"), r6(F.log(F.abs(x) + 1), "l"), r6(F.sin(x), "w"))


@query("SELECT c_custkey, (c_custkey*4 + j)::BIGINT AS flat, (c_acctbal*j)::DOUBLE AS v FROM customer, unnest(range(0, 4)) t(j)")
def reshape_coo(spark, sf_dir):
    """Reshape of an n x 4 matrix to one dimension: index arithmetic on coordinates."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    return c.select("c_custkey", (F.col("c_custkey") * 4 + F.col("j")).alias("flat"), (F.col("c_acctbal") * F.col("j")).alias("v"))


@query("SELECT l_returnflag, l_linestatus, arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS argmax_order, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL")
def group_argmax(spark, sf_dir):
    key = F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.max_by("l_orderkey", key).alias("argmax_order"), F.max("l_extendedprice").alias("top"))


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n, o_orderkey % 4 AS shard FROM orders GROUP BY 4")
def ddp_shards(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4).alias("shard")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


@query("SELECT count(*) AS shared FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1)")
def ddp_disjoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.filter("o_orderkey % 2 = 0").intersect(o.filter("o_orderkey % 2 = 1")).agg(F.count("*").alias("shared"))




@query("""WITH f AS (SELECT DISTINCT c_mktsegment AS v FROM customer), s AS (SELECT 'c_mktsegment_' || v AS feature, 'c_mktsegment' AS col, row_number() OVER (ORDER BY v) - 2 AS k FROM f),
o AS (SELECT 'c_acctbal' AS feature, 'c_acctbal' AS col, 'bank' AS source, 0 AS position UNION ALL SELECT feature, col, 'market', 1 + k FROM s WHERE k >= 0 UNION ALL SELECT 'c_nationkey', 'c_nationkey', 'unknown', 1 + (SELECT count(*) - 1 FROM f)),
w AS (SELECT 'c_acctbal' AS feature, 0.5 AS weight UNION ALL SELECT 'c_mktsegment_' || c_mktsegment, round(avg(c_acctbal) / 1000.0, 6) FROM customer GROUP BY 1)
SELECT position::INTEGER AS position, feature, col AS "column", source, weight::DOUBLE AS weight FROM o LEFT JOIN w USING (feature)""")
def onehot_source_reindex(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    origins = etl.column_origins(["c_acctbal", "c_mktsegment", "c_nationkey"], {"c_mktsegment": etl.categories(c, "c_mktsegment")})
    w = c.groupBy(F.concat(F.lit("c_mktsegment_"), "c_mktsegment").alias("feature")).agg(F.round(F.avg("c_acctbal") / 1000.0, 6).alias("weight"))
    w = w.unionByName(spark.createDataFrame([("c_acctbal", 0.5)], "feature string, weight double"))
    return etl.reindex_by_source(w, origins, {"bank": ["c_acctbal"], "market": ["c_mktsegment"]})


@query("""WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 4 <> 0), f AS (SELECT max(c_mktsegment = 'BUILDING')::INT AS b, max(c_mktsegment = 'MACHINERY')::INT AS m FROM customer WHERE c_custkey % 4 <> 0)
SELECT c_custkey, round((c_acctbal - t.m) / (t.s + 1e-8), 6) + 0.0 AS c_acctbal, (c_mktsegment = 'BUILDING')::INT * f.b AS c_mktsegment_building, (c_mktsegment = 'MACHINERY')::INT * f.m AS c_mktsegment_machinery FROM customer, t, f""")
def column_transformer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out = etl.transform_columns(c, ["c_acctbal"], ["c_mktsegment"], c.filter("c_custkey % 4 <> 0"))
    one = lambda v: (F.col(f"c_mktsegment_{v}") if f"c_mktsegment_{v}" in out.columns else F.lit(0)).alias(f"c_mktsegment_{v.lower()}")
    return out.select("c_custkey", (F.round("c_acctbal", 6) + F.lit(0.0)).alias("c_acctbal"), one("BUILDING"), one("MACHINERY"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 50000")
def drop_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("b"))
    return etl.drop_missing(o).select("o_orderkey")


@query("WITH x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ((o_orderkey + 1) * 48271 + 7 * 7919) % 2147483647, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, k <= floor(n * 80 / 100.0 + 0.5) AS train FROM x")
def stratified_split(spark, sf_dir):
    return etl.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 7, 80)


@query("SELECT event_id % 3 AS kind, count(*) AS n, CASE WHEN event_id % 3 = 1 THEN 0 ELSE count(*) END AS overflows FROM events GROUP BY 1, event_id % 3")
def trigger_overflows(spark, sf_dir):
    ints = lambda *x: F.array(*map(F.lit, x))
    m = F.col("event_id") % 3
    t = F.when(m == 0, ints(5, 6, 7, 8, 9, 10)).when(m == 1, ints(5, 6, 0, 0, 0, 0)).otherwise(ints(5, 6, 7, 8, 9, 0))
    return table(spark, sf_dir, "events").groupBy(m.alias("kind")).agg(F.count("*").alias("n"), F.count_if(etl.overflows(t, [101, 102])).alias("overflows"))


_ORIGINS = "(VALUES ('bureau_count', 'lineitem', 'l_extendedprice'), ('bureau_sum', 'lineitem', 'l_extendedprice'), ('bureau_max', 'lineitem', 'l_quantity'), ('prev_sum', 'orders', 'o_totalprice'), ('prev_approved', 'orders', 'o_orderstatus'), ('c_acctbal', 'customer', 'c_acctbal')) o(feature, source, source_column)"


@query(f"WITH {ETL}, x AS (UNPIVOT (SELECT c_acctbal::DOUBLE AS c_acctbal, bureau_count::DOUBLE AS bureau_count, bureau_sum::DOUBLE AS bureau_sum, bureau_max::DOUBLE AS bureau_max, prev_sum::DOUBLE AS prev_sum, prev_approved::DOUBLE AS prev_approved FROM t) ON COLUMNS(*) INTO NAME feature VALUE v) SELECT source, source_column, count(*) AS n, round(sum(abs(v)), 2) AS mass FROM x JOIN {_ORIGINS} USING (feature) GROUP BY ALL")
def plan_origins(spark, sf_dir):
    """How much of the feature table's values each column of each source has made; the origins are read from the plan."""
    t = three_tables(spark, sf_dir)
    found = plan_lineage(t, {f"file:{sf_dir}/{n}.parquet": n for n in ("customer", "orders", "lineitem")})
    origins = spark.createDataFrame([(c, s.rsplit("/", 1)[-1].removesuffix(".parquet"), of) for c, s, of in found.columns], "feature string, source string, source_column string")
    features = ["c_acctbal", "bureau_count", "bureau_sum", "bureau_max", "prev_sum", "prev_approved"]
    long = t.select(*(F.col(c).cast("double") for c in features)).unpivot([], features, "feature", "v").filter("v is not null")
    return long.join(origins, "feature").groupBy("source", "source_column").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("v")), 2).alias("mass"))
