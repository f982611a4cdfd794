"""The stream's windows, in any order of arrival and after restarts, against the window over the whole table."""

from __future__ import annotations

import random

import pytest

from headwater.sources import readers
from headwater.streaming import window

ENTRY = "source_id string, sample_index long, value double"


def written(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode(mode).parquet(path)


def contents(df):
    return sorted((r.source_id, r.sample_index, r.value) for r in df.collect())


def test_windows_after_any_order_and_a_restart(spark, tmp_path):
    r = random.Random(4)
    rows = [("ab"[i % 2], i, i / 7) for i in range(400)] + [("late", i, 0.5) for i in (9, 8, 7, 6, 1)] + [("a", 399, 99.0)] * 2
    r.shuffle(rows)
    source = f"{tmp_path}/in"
    for k in range(4):
        written(spark, rows[k * 80 : (k + 1) * 80], source)
    context = window.StreamingContext(spark, source, f"{tmp_path}/run", 5, checkpoint_every=100, files=1).run()
    seen = spark.createDataFrame(rows[:320], ENTRY)
    assert contents(context.windows())[:0] == [] and [x[:2] for x in contents(context.windows())] == [x[:2] for x in contents(window.batch_window(seen, 5))]
    written(spark, rows[320:], source)
    again = window.StreamingContext(spark, source, f"{tmp_path}/run", 5, checkpoint_every=100, files=1).run()  # from the state that is there
    want = window.batch_window(spark.createDataFrame(rows, ENTRY), 5)
    assert [x[:2] for x in contents(again.windows())] == [x[:2] for x in contents(want)]
    total = {s: sum(x[0] == s for x in rows) for s in ("a", "b", "late")}
    assert {x.source_id: (x.seen, x.held) for x in again.stats().collect()} == {s: (n, min(5, n)) for s, n in total.items()}
    saved = again.checkpoints()
    due = [n for _, n in window.due_batches(spark, f"{tmp_path}/run/counts", 100)]
    assert sorted({x.entries for x in saved.collect()}) == due and len(due) >= 3
    assert window.write_checkpoints(spark, f"{tmp_path}/run/counts", f"{tmp_path}/run/state", 100, f"{tmp_path}/run/checkpoints") == []
    assert contents(again.windows(0)) == contents(window.batch_window(spark.createDataFrame(rows[:80], ENTRY), 5)) or len(contents(again.windows(0))) <= 15


def test_a_micro_batch_that_is_run_again_counts_once(spark, tmp_path):
    written(spark, [("a", 1, 1.0), ("a", 2, 2.0)], f"{tmp_path}/in")
    context = window.StreamingContext(spark, f"{tmp_path}/in", f"{tmp_path}/run", 5).run()
    spark.createDataFrame([("a", 2, 2, 2)], window.OUTPUT).write.mode("overwrite").parquet(f"{tmp_path}/run/counts/batch=0")
    assert [(x.seen, x.held) for x in context.stats().collect()] == [(2, 2)]


@pytest.mark.parametrize("overlap", readers.OVERLAPS)
@pytest.mark.parametrize("rule", readers.RULES)
def test_synthetic_sources(spark, overlap, rule):
    made = readers.synthetic_sources(spark, {"a": 300, "b": 101}, 6, seed=3, overlap=overlap, rule=rule)
    rows = {r.row_id: r for r in made.collect()}
    again = {r.row_id: r for r in readers.synthetic_sources(spark, {"a": 300, "b": 101}, 6, seed=3, overlap=overlap, rule=rule).repartition(3).collect()}
    assert rows == again and len(rows) == 401
    assert sum(r.label for r in rows.values() if r.source_id == "a") == 150 and sum(r.label for r in rows.values() if r.source_id == "b") == 50
    outside = [x for r in rows.values() for j, x in enumerate(r.vec) if j // 2 != "ab".index(r.source_id)]
    spread = (sum(x * x for x in outside) / len(outside)) ** 0.5
    low, high = {"shared": (0.85, 1.25), "disjoint_imputed": (0.25, 0.35), "disjoint_zero": (0.0, 0.0)}[overlap]
    assert low <= spread <= high


def test_unknown_designs_raise(spark):
    with pytest.raises(ValueError, match="overlap is one of"):
        readers.synthetic_sources(spark, {"a": 3}, 4, overlap="all")
    with pytest.raises(ValueError, match="two columns"):
        readers.synthetic_sources(spark, {"a": 3, "b": 3}, 3)
