"""The chain index against a plain search, on graphs with chains, ladders, cycles and any order of ids."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import compliance, graph, reachability


def plain_search(edges, starts, forward=False):
    after = {}
    for a, b in edges:
        after.setdefault(a if forward else b, []).append(b if forward else a)
    out = set()
    for x in starts:
        todo, seen = list(after.get(x, [])), set()
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += after.get(y, [])
        out |= {(x, y) for y in seen}
    return out


def graphs():
    r = random.Random(3)
    n = 60
    shuffled = r.sample(range(-n, n), 2 * n)
    return {
        "any, with cycles and loops": [(r.randrange(n), r.randrange(n)) for _ in range(n)],
        "dag": [tuple(sorted(r.sample(range(n), 2))) for _ in range(2 * n)],
        "ladder": [(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(n)] + [(i, 1001 + i) for i in range(n)] + [(1000 + i, i + 1) for i in range(n)],
        "steps that add one input": [(i, i + 1) for i in range(n)] + [(5000, i) for i in range(1, n, 3)],
        "chain in any order": list(zip(shuffled, shuffled[1:], strict=False)) + [(0, 0)],
        "tree": [(i // 3, i) for i in range(1, n)],
        "one cycle": [(i, (i + 1) % n) for i in range(n)],
        "no edge": [],
    }


@pytest.mark.parametrize(("name", "stitch"), [(name, 4) for name in graphs()] + [("chain in any order", 10**6)])
def test_index_reaches_what_a_search_reaches(spark, name, stitch, monkeypatch):
    monkeypatch.setattr(reachability, "STITCH_ROWS", stitch)
    edges = graphs()[name]
    starts = sorted({x for e in edges for x in e})[::9] + [77_777]
    index = reachability.chain_index(spark.createDataFrame(edges * 2, "src long, dst long").coalesce(2))
    start = spark.createDataFrame([(x,) for x in [*starts, starts[0]]], "start long").coalesce(1)
    up, down = ([(r.start, r.node) for r in f(start).collect()] for f in (index.ancestors, index.descendants))
    assert len(set(up)) == len(up) and set(up) == plain_search(edges, starts)
    assert len(set(down)) == len(down) and set(down) == plain_search(edges, starts, forward=True)


def test_a_deep_chain_takes_few_jobs(spark):
    depth = 5000
    edges = spark.range(depth).selectExpr("id", "'op' as op_name", "array(id) as input_ids", "id + 1 as output_id", "array('s') as source_ids")
    start = spark.createDataFrame([(depth,)], "start long")
    spark.sparkContext.setJobGroup("deep", "ancestors of a deep chain")
    try:
        assert len(graph.ancestors(edges, start).collect()) == depth
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep")) <= 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_ladder_takes_two_changes_of_chain(spark, monkeypatch):
    """Searches keep the furthest place on a chain, so two chains that exchange at each step are not walked step by step."""
    index = reachability.chain_index(spark.createDataFrame(graphs()["ladder"], "src long, dst long").coalesce(1))
    counted = []
    plain = reachability.stored_at
    monkeypatch.setattr(reachability, "stored_at", lambda *a: counted.append(a[1]) or plain(*a))
    assert index.ancestors(spark.createDataFrame([(60,)], "start long")).count() == 120
    assert counted.count("bounds") <= 5


def test_climb_cuts_cycles_at_their_least():
    up = np.array([-1, 0, 1, 4, 5, 3, 2])
    end, far = reachability.climb(up, np.array([0, 10, 20, 1, 1, 1, 30]))
    assert end.tolist() == [0, 0, 0, 3, 3, 3, 0] and far.tolist() == [0, 10, 30, 0, 2, 1, 60]


def test_report_of_an_untracked_node_is_none(spark, tmp_path):
    edges = spark.createDataFrame([(0, "a", [1], 2, ["s"])], "id long, op_name string, input_ids array<long>, output_id long, source_ids array<string>")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    start = spark.createDataFrame([(2,), (99,)], "start long")
    reports = compliance.report(edges, start, "system", "purpose", nodes=nodes)
    assert [(r.node, r.ancestor_count) for r in reports.collect()] == [(2, 1)]
    compliance.write_reports(reports, f"{tmp_path}/r")
    again = spark.read.json(f"{tmp_path}/r").first()
    assert (again.node, again.log_version, again.retention_days, again.operations[0].op_name) == (2, "1.0", 3650, "a")


@pytest.mark.parametrize("name", [*graphs(), "operations of several inputs", "leaves of a root"])
def test_counts_are_those_of_the_listed(spark, name, monkeypatch):
    """Ancestors and touched operations of every node, against a plain search: cycles, operations of several inputs, ids that several outputs share, nodes without an edge."""
    monkeypatch.setattr(reachability, "STITCH_ROWS", 4)
    r = random.Random(5)
    steps = graphs().get(name) or ([(1, i) for i in range(2, 9)] if name == "leaves of a root" else [])
    ops = [(i // 2 if name == "tree" else i, [a], b) for i, (a, b) in enumerate(steps)]
    if name == "operations of several inputs":
        ops = [(i % 35, sorted(r.sample(range(i), min(i, r.randrange(5)))), i) for i in range(1, 50)] + [(100 + i, [r.randrange(i)] * 2, i) for i in range(5, 50, 7)] + [(200, [49, 3], 20)]
    edges = spark.createDataFrame([(o, "a", a, b, ["s"]) for o, a, b in ops], "id long, op_name string, input_ids array<long>, output_id long, source_ids array<string>").repartition(3)
    starts = sorted({x for _, a, b in ops for x in [*a, b]} | {77_777})
    up = plain_search([(a, b) for _, inputs, b in ops for a in inputs], starts)
    got = {c.start: (c.ancestor_count, c.n_operations) for c in compliance.counts(edges, spark.createDataFrame([(x,) for x in [*starts, starts[0]]], "start long")).collect()}
    for x in starts:
        path = {y for s, y in up if s == x} | {x}
        assert got.pop(x) == (sum(s == x for s, _ in up), len({o for o, a, b in ops if a and path & {*a, b}})), x
    assert not got


def test_orders_whose_ids_pass_the_totals_are_reported(spark, tmp_path):
    """With ten million orders and more their nodes are starts as well, and some have the id of a total: all equal SQL."""
    from headwater import catalogue

    from .conftest import SMALL, duck, same_rows

    for t in ("region", "nation", "customer", "supplier", "orders"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        df = df.withColumn("o_orderkey", F.col("o_orderkey") + 9_999_000) if t == "orders" else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    con = duck(str(tmp_path))
    for name in ("compliance_report", "compliance_edges"):
        same_rows(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])
