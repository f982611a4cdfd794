"""Rank statistics, detection metrics and resampling over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import kendall, quantiles, running_total, with_rank  # noqa: F401


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where a side is constant (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties averaged, by windows: for many groups of stated, small size. ``ranks.with_rank`` takes groups of any size."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(order) + (ties - 1) / 2.0


def _ranked(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """A column of average ranks; without groups the rows are one group of any size, which no window may gather."""
    return df.withColumn(name, average_rank(value, by)) if by else with_rank(df, value, by, name)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., rho): correlation of average ranks; undefined where a side is constant."""
    ranked = _ranked(_ranked(df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", by, "_rx"), "_y", by, "_ry")
    return ranked.groupBy(*by).agg(correlation("_rx", "_ry").alias("rho"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by..., n_pos, n_neg, auc) from the rank sum of the positives, ties averaged. Scores are counted first and added up over ranges, so a group may
    be the whole table."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos")
    counts = df.groupBy(*by, score).agg(F.count("*").alias("_n"), pos)
    upto = running_total(counts, [*by, score], "_n", "_upto")
    # below a group's first score stand the rows of other groups: taken off the rank sum for all positives at once
    ranked = upto.withColumn("_r", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"), F.sum(F.col("_n") - F.col("_pos")).alias("n_neg"), F.sum(F.col("_pos") * F.col("_r")).alias("_s"), F.min(F.col("_upto") - F.col("_n")).alias("_start"),
    )
    u = F.col("_s") - F.col("n_pos") * F.col("_start") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return sums.select(*by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def precision_at_k(df: DataFrame, score: str, label: str, item: str, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), item)
    top = df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k) if by else df.orderBy(F.desc(score), item).limit(k)
    return top.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("precision_at_k"))


def paired_t(df: DataFrame, diff: Column, by: list[str]) -> DataFrame:
    """(by..., n, mean_diff, t, wins) of paired differences."""
    d = df.withColumn("_d", diff)
    sd = F.stddev_samp("_d")
    return d.groupBy(*by).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.when(sd > 0, F.avg("_d") / (sd / F.sqrt(F.count("_d")))).alias("t"),
        F.count_if(F.col("_d") > 0).alias("wins"),
    )


def wilcoxon(df: DataFrame, diff: Column, by: list[str]) -> DataFrame:
    """(by..., w_plus, w_minus): signed-rank sums, zero differences dropped, ties averaged."""
    d = df.withColumn("_d", diff).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    d = _ranked(d, "_a", by, "_r")
    return d.groupBy(*by).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by..., u): U of the rows with group = 1 against those with 0."""
    auc = roc_auc(df, value, group, by)
    return auc.select(*by, (F.col("auc") * F.col("n_pos") * F.col("n_neg")).alias("u"))


def pick(replicate: Column, position: Column, n: Column, seed: int = 0) -> Column:
    """Which of n items a bootstrap replicate draws at a position: integer arithmetic, equal in any engine."""
    x = F.pmod((replicate * 7919 + 31) * (position * 104729 + 7) + F.lit(seed * 65537) + replicate * replicate * 97 + position * 31, F.lit(2147483647))
    return F.pmod(x * 48271, F.lit(2147483647)) % n


def bootstrap_mean(df: DataFrame, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(mean_diff, low, high, share_above_zero): percentile interval of the mean over drawn replicates.

    ``df`` holds one row for each unit (seed, subset, test): it is small; replicates are a range and each draw is a
    lookup by number.
    """
    numbered = df.select((F.row_number().over(Window.orderBy("unit")) - 1).cast("long").alias("_i"), F.col(value).alias("_v"))
    n = df.agg(F.count("*").alias("_n"), F.avg(value).alias("mean_diff"))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "_b").join(F.broadcast(n))
    draws = draws.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    draws = draws.withColumn("_i", pick(F.col("_b"), F.col("_p"), F.col("_n"), seed)).join(numbered, "_i")
    means = draws.groupBy("_b", "mean_diff").agg(F.avg("_v").alias("_m"))
    return means.groupBy("mean_diff").agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("_m") > 0, 1.0).otherwise(0.0)).alias("share_above_zero"))


def paired_bootstrap(df: DataFrame, diff: str, replicates: int, seed: int = 0) -> DataFrame:
    """(mean_diff, low, high, share_above_zero, p): the interval and a two-sided p, twice the smaller tail."""
    out = bootstrap_mean(df, diff, replicates, seed)
    return out.withColumn("p", F.least(F.lit(1.0), 2.0 * F.least(F.col("share_above_zero"), 1.0 - F.col("share_above_zero"))))


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with p_adjusted: p times the number of tests, one at most."""
    return df.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * df.agg(F.count(p)).scalar()))


def over_seeds(df: DataFrame, by: list[str], value: str, at_least: float) -> DataFrame:
    """(by, n, mean, std, passed): a metric's mean and population deviation over seeds, and whether the mean reaches a bound."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("passed", F.col("mean") >= at_least)


def two_way_bootstrap(df: DataFrame, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(mean, low, high) with rows (say, subsets) and columns (tests) drawn independently.

    ``df`` has (row, col, value) of a small, full grid; draws are lookups by number.
    """
    number = lambda c: df.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias(f"_{c}"))
    rows, cols = number("row"), number("col")
    grid = df.join(rows, "row").join(cols, "col").select("_row", "_col", F.col(value).alias("_v"))
    n_rows, n_cols = rows.count(), cols.count()
    spark = df.sparkSession
    draw = lambda n, name, s: spark.range(replicates).select(F.col("id").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_p")).select("_b", pick(F.col("_b"), F.col("_p"), F.lit(n), s).alias(name))
    # how often each row and column is drawn weighs the grid: no product of draws is made
    r = draw(n_rows, "_row", seed).groupBy("_b", "_row").agg(F.count("*").alias("_wr"))
    c = draw(n_cols, "_col", seed + 1).groupBy("_b", "_col").agg(F.count("*").alias("_wc"))
    drawn = r.join(grid, "_row").join(c, ["_b", "_col"])
    means = drawn.groupBy("_b").agg((F.sum(F.col("_v") * F.col("_wr") * F.col("_wc")) / (n_rows * n_cols)).alias("_m"))
    return means.agg(F.avg("_m").alias("mean"), F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))


def ordinal_rank(value: str, by: list[str], tie: str) -> Column:
    """Ranks from 1; ties in the order of ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round(value, 9), tie)).cast("double")


def lds_difference(df: DataFrame, reps: DataFrame, seed: int = 0) -> DataFrame:
    """(rep, diff): mean rank correlation of ``pred_a`` with ``margin`` less that of ``pred_b``, over drawn subsets and tests.

    ``df`` is (world, subset, test, pred_a, pred_b, margin), a full grid for each world (say, a training seed); ``reps``
    is (rep, world). Each replicate draws its world's subsets and tests with repeats: ranks are ordinal over the drawn
    subsets, and how often a test is drawn weighs it.
    """
    number = lambda c: df.select("world", c).distinct().select("world", c, (F.row_number().over(Window.partitionBy("world").orderBy(c)) - 1).cast("long").alias(f"_{c}"))
    grid = df.join(number("subset"), ["world", "subset"]).join(number("test"), ["world", "test"])
    sized = reps.join(grid.groupBy("world").agg((F.max("_subset") + 1).alias("_ns"), (F.max("_test") + 1).alias("_nt")), "world")

    def draw(n: str, name: str, s: int) -> DataFrame:
        each = sized.select("rep", "world", n, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("_p"))
        return each.select("rep", "world", "_p", pick(F.col("rep"), F.col("_p"), F.col(n), s).alias(name))

    tests = draw("_nt", "_test", seed + 1).groupBy("rep", "world", "_test").agg(F.count("*").alias("_w"))
    drawn = draw("_ns", "_subset", seed).join(grid, ["world", "_subset"]).join(tests, ["rep", "world", "_test"])
    ranked = drawn.withColumns({f"_{c}": ordinal_rank(c, ["rep", "_test"], "_p") for c in ("pred_a", "pred_b", "margin")})
    rho = ranked.groupBy("rep", "_test").agg(F.max("_w").alias("_w"), correlation("_pred_a", "_margin").alias("a"), correlation("_pred_b", "_margin").alias("b"))
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
    return rho.groupBy("rep").agg((mean("a") - mean("b")).alias("diff"))


def _interval(diffs: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return diffs.agg(F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"), share(F.col("diff") > 0).alias("share_above_zero"), share(F.col("diff") >= 0).alias("share_not_below_zero"))


def held_out_bootstrap(df: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(low, high, share_above_zero, share_not_below_zero) of ``lds_difference`` in one world."""
    world = df.select("world").distinct()
    return _interval(lds_difference(df, df.sparkSession.range(replicates).withColumnRenamed("id", "rep").join(world), seed))


def hierarchical_bootstrap(df: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """The same where a replicate first draws as many worlds as there are, with repeats, then each one's subsets and
    tests anew, and takes the mean of their differences."""
    worlds = df.select("world").distinct().select("world", (F.row_number().over(Window.orderBy("world")) - 1).cast("long").alias("_i"))
    spark, n = df.sparkSession, worlds.count()
    drawn = spark.range(replicates).select(F.col("id").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_p"))
    drawn = drawn.withColumn("_i", pick(F.col("_b"), F.col("_p"), F.lit(n), seed)).join(worlds, "_i")
    diffs = lds_difference(df, drawn.select((F.col("_b") * n + F.col("_p")).alias("rep"), "world"), seed + 2)
    return _interval(diffs.groupBy(F.floor(F.col("rep") / n).alias("_b")).agg(F.avg("diff").alias("diff")))


def lds_by_membership(masks: DataFrame, outcomes: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, rho): each sample's effect is the rank correlation of its membership (subset, sample_index, member)
    with the outcome (subset, query_id, outcome) over subsets; rho is that of the scores with these effects over samples.
    An undefined correlation counts as 0. Ranks are taken before the tables meet."""
    m = masks.withColumn("_rm", average_rank("member", ["sample_index"]))
    o = outcomes.withColumn("_ro", average_rank("outcome", ["query_id"]))
    effects = m.join(o, "subset").groupBy("query_id", "sample_index").agg(F.round(F.coalesce(correlation("_rm", "_ro"), F.lit(0.0)), 9).alias("_e"))
    both = scores.select("query_id", "sample_index", F.round("score", 9).alias("score")).join(effects, ["query_id", "sample_index"])
    return spearman(both, "score", "_e", ["query_id"]).withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def ranking_consistency(means: DataFrame, expected: list[str], first: int = 30) -> DataFrame:
    """(n, top_share, order_share, mean_rho) of the sources' means (query_id, source, mean) of each query.

    How often the first of ``expected`` has the largest mean, how often the expected order holds, and the mean
    pairwise rank correlation between the ``first`` queries by id.
    """
    m = means.withColumn("mean", F.round("mean", 9))
    of = [F.max(F.when(F.col("source") == s, F.col("mean"))) for s in expected]
    holds = of[0] >= of[1]
    for a, b in zip(of[1:], of[2:], strict=False):
        holds = holds & (a >= b)
    top = F.max_by("source", "mean")
    per = m.groupBy("query_id").agg(F.when(holds, 1.0).otherwise(0.0).alias("_o"), F.when(top == expected[0], 1.0).otherwise(0.0).alias("_t"))
    some = m.select("query_id").distinct().orderBy("query_id").limit(first)
    r = m.join(some, "query_id").select("query_id", "source", average_rank("mean", ["query_id"]).alias("_r"))
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.query_id") < F.col("b.query_id")))
    rho = pairs.select(F.col("a.query_id").alias("x"), F.col("b.query_id").alias("y"), F.col("a._r").alias("ra"), F.col("b._r").alias("rb")).groupBy("x", "y").agg(correlation("ra", "rb").alias("rho"))
    mean = F.coalesce(rho.agg(F.avg("rho")).scalar(), F.lit(0.0))
    return per.agg(F.count("*").alias("n"), F.avg("_t").alias("top_share"), F.avg("_o").alias("order_share")).withColumn("mean_rho", mean)
