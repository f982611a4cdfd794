"""Lineage from analysed plans against what a wrapper records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headwater.operators import capture, graph
from headwater.operators.plan_capture import plan_lineage
from headwater.plans import etl_queries
from headwater.session import table

from .conftest import SMALL

T = {f"file:{SMALL}/{t}.parquet": t for t in ("customer", "orders", "lineitem", "nation")}


def shape(edges):
    """A graph's edges by what they are made of, whatever the numbers of its nodes."""
    made = {e[3]: e for e in edges}
    text = lambda n: f"{made[n][1]}({','.join(map(text, made[n][2]))};{','.join(made[n][6])})" if n in made else "source"
    return sorted(text(e[3]) for e in edges)


def test_three_tables_without_a_wrapper(spark):
    """The plan of the query itself tells what a wrapper of each of its steps records."""
    rec = capture.Recorder("op")
    read = lambda name: capture.TrackedFrame(table(spark, SMALL, name), rec, name)
    customer, orders, lineitem = read("customer"), read("orders"), read("lineitem")
    li = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bureau = li.aggregate(["o_custkey"], F.count("l_extendedprice").alias("bureau_count"), F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)).alias("bureau_sum"), F.max("l_quantity").alias("bureau_max"))
    approved = orders.with_column("approved", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    previous = approved.aggregate(["o_custkey"], F.count("*").alias("prev_count"), F.sum("o_totalprice").alias("prev_sum"), F.avg("approved").alias("prev_approved"))
    zero = lambda *names: lambda df: df.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    t = customer.select("c_custkey", "c_acctbal", "c_mktsegment").join(bureau.rename({"o_custkey": "c_custkey"}), "c_custkey", "left").apply("compute", zero("bureau_count", "bureau_sum"))
    t.join(previous.rename({"o_custkey": "c_custkey"}), "c_custkey", "left").apply("compute", zero("prev_count", "prev_sum"))

    found = plan_lineage(etl_queries.three_tables(spark, SMALL), T)
    assert shape(found.edges) == shape(rec.edges) and len(found.nodes) == len(rec.nodes) == 3 + len(found.edges)
    origins = {}
    for column, source, of in found.columns:
        origins.setdefault(column, set()).add((source, of))
    assert origins == {
        "c_custkey": {("customer", "c_custkey")}, "c_acctbal": {("customer", "c_acctbal")}, "c_mktsegment": {("customer", "c_mktsegment")},
        "bureau_count": {("lineitem", "l_extendedprice")}, "bureau_sum": {("lineitem", "l_extendedprice")}, "bureau_max": {("lineitem", "l_quantity")},
        "prev_sum": {("orders", "o_totalprice")}, "prev_approved": {("orders", "o_orderstatus")},
    }  # fmt: skip  # a count of rows is made of no column
    nodes, edges, columns = found.frames(spark)
    up = graph.ancestors(edges, spark.createDataFrame([(found.output,)], "start long"))
    assert {r.node for r in up.collect()} == set(range(nodes.count())) - {found.output} and columns.count() == len(found.columns)


def test_views_stay_on_their_input(spark):
    df = table(spark, SMALL, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")).where("price > 10").orderBy("price").limit(5).withColumnRenamed("price", "p").repartition(2)
    found = plan_lineage(df.select(F.col("p").cast("int").alias("p")), T)
    assert found.edges == [] and len(found.nodes) == 1 and found.columns == [("p", "orders", "o_totalprice")]


def test_every_kind_of_operator(spark):
    o = table(spark, SMALL, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    w = o.withColumn("r", F.sum("o_totalprice").over(Window.partitionBy("o_custkey")))
    g = w.select("o_custkey", F.explode(F.array("o_totalprice", "r")).alias("x"))
    mapped = g.mapInArrow(lambda it: it, "o_custkey long, x double")
    both = mapped.union(o.select("o_custkey", "o_totalprice")).distinct()
    kept = both.join(table(spark, SMALL, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    found = plan_lineage(kept, T)
    assert [e[1] for e in found.edges] == ["window", "generate", "map", "concatenate", "distinct", "join"]
    assert {s for e in found.edges for s in e[6]} == {"orders", "customer"}
    assert ("x", "orders", "o_totalprice") in found.columns and not any(s == "customer" for _, s, _ in found.columns)


def test_a_part_that_is_used_twice_is_one_node(spark):
    o = table(spark, SMALL, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    found = plan_lineage(o.alias("a").join(o.alias("b"), F.col("a.o_custkey") == F.col("b.o_custkey")).select("a.t"), T)
    assert [e[1] for e in found.edges] == ["aggregate", "join"] and found.edges[1][2] == [1, 1] and len(found.nodes) == 3
    other = table(spark, SMALL, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("t"))
    assert [e[1] for e in plan_lineage(o.join(other, "o_custkey"), T).edges] == ["aggregate", "aggregate", "join"]


def test_recorded_and_found_go_on_together(spark):
    rec = capture.Recorder("op")
    capture.TrackedFrame(spark.range(3), rec, "a").with_column("x", F.col("id") + 1)
    plan_lineage(spark.range(5).withColumn("y", F.col("id") * 2), recorder=rec)
    assert [e[:4:3] for e in rec.edges] == [(0, 1), (1, 3)]
    assert plan_lineage(spark.range(2), recorder=capture.Recorder("none")).nodes == []


@pytest.mark.parametrize("name", ["etl_three_table", "etl_mean_impute", "q1_source_rollup", "row_lineage_lists", "column_transformer", "source_stratified"])
def test_plans_of_queries_are_walked(spark, name):
    from headwater import catalogue

    found = plan_lineage(catalogue.queries()[name](spark, SMALL))
    assert found.edges and found.columns


def test_nested_arguments_are_walked(spark):
    rec = capture.Recorder("op")
    a, b, c = (capture.TrackedFrame(spark.range(2), rec, s) for s in "abc")

    def many(first, rest, *, more):
        return first.union(rest[0]).union(rest[1]["x"]).union(more[0])

    a.apply("many", many, [b, {"x": c}], more=(b,))
    assert [(e[2], e[6]) for e in rec.edges] == [([0, 1, 2, 1], ["a", "b", "c"])]


def test_views_of_an_unrecorded_frame_are_no_inputs(spark):
    rec = capture.Recorder("none")
    view = capture.TrackedFrame(spark.range(3), rec, "a").where("id > 0")
    assert view.node is None
    rec.level = "op"
    view.with_column("x", F.lit(1))
    assert rec.edges == []
