"""Feature ETL with row lineage: left joins of aggregates, imputation, encoding, standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import quantile
from ..scratch import stored


def aggregate_child(child: DataFrame, key: str, aggs: dict[str, Column], row_id: str | None = None) -> DataFrame:
    """Aggregates of a child table by key; ``row_id`` also keeps which rows went in, sorted."""
    out = [v.alias(k) for k, v in aggs.items()]
    if row_id:
        out.append(F.sort_array(F.collect_list(row_id)).alias("row_ids"))
    return child.groupBy(key).agg(*out)


def attach(parent: DataFrame, child: DataFrame, key: str, zero: list[str] = ()) -> DataFrame:
    """Left outer join; the columns ``zero`` (counts and sums) are 0 for a parent without children."""
    joined = parent.join(child, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def row_lineage(children: dict[str, DataFrame], key: str) -> DataFrame:
    """(sample_id, table, row_id) in long form: no list grows with a key."""
    out = None
    for name, df in children.items():
        one = df.select(F.col(key).alias("sample_id"), F.lit(name).alias("table"), F.col("row_id"))
        out = one if out is None else out.unionByName(one)
    return out


def lineage_lists(lineage: DataFrame) -> DataFrame:
    """(sample_id, table, row_ids): the nested form, one row for each sample and table."""
    return lineage.groupBy("sample_id", "table").agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))


def lineage_stats(lineage: DataFrame) -> DataFrame:
    per = lineage.groupBy("sample_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("samples"), F.sum("n").alias("total_rows"), F.avg("n").alias("avg_rows"), F.max("n").alias("max_rows"))


def trace_to_rows(top: DataFrame, lineage: DataFrame, first: int = 3) -> DataFrame:
    """(query_id, rank, sample_index, table, n_rows, first_rows) for ranked samples. Only their lineage is looked at, and no more than ``first`` rows of
    a sample are listed."""
    top = stored(top, "ranked")
    ranked = top.select(F.col("sample_index").alias("sample_id")).distinct()
    used = stored(lineage.select("sample_id", "table", "row_id").join(ranked, "sample_id", "left_semi"), "lineage")
    order = Window.partitionBy("sample_id", "table").orderBy("row_id")
    rows = used.filter("row_id is not null").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= first)
    listed = rows.groupBy("sample_id", "table").agg(F.sort_array(F.collect_list("row_id")).alias("_first"))
    per = used.groupBy("sample_id", "table").agg(F.count("*").alias("n_rows")).join(listed, ["sample_id", "table"], "left")
    per = per.select("sample_id", "table", "n_rows", F.coalesce("_first", F.array().cast("array<long>")).alias("first_rows"))
    return top.join(per, top.sample_index == per.sample_id).select("query_id", "rank", "sample_index", "table", "n_rows", "first_rows")


def table_contribution(scores: DataFrame, lineage: DataFrame, k: int) -> DataFrame:
    """(query_id, table, n_samples, contribution): mean magnitude of the top-k samples that used each table. ``scores`` may leave out what is no
    sample of the top k (``blocks.block_top``)."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.abs("score"), 9).desc(), "sample_index")
    top = scores.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k)
    used = lineage.select("sample_id", "table").distinct()
    return top.join(used, top.sample_index == used.sample_id).groupBy("query_id", "table").agg(F.count("*").alias("n_samples"), F.avg(F.abs("score")).alias("contribution"))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians; a column without any value gets 0."""
    return df.withColumns({c: F.coalesce(c, F.lit(quantile(df, c, 0.5) or 0.0)) for c in columns})


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value, the least of several."""
    out = df
    for c in columns:
        best = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).limit(1).select(F.col(c).alias("_mode"))
        out = out.join(F.broadcast(best)).withColumn(c, F.coalesce(c, "_mode")).drop("_mode")
    return out


def standardise(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population sd + 1e-8), fitted on ``fit`` (say, training rows) or the table itself: one row."""
    at = (df if fit is None else fit).agg(*(f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    done = df.join(F.broadcast(at)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8) for c in columns})
    return done.drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def one_hot(df: DataFrame, column: str, categories: list[str], drop_first: bool = True) -> DataFrame:
    """A 0/1 column for each category in sorted order (without the first one); unknown values have zeros."""
    kept = sorted(categories)[1 if drop_first else 0 :]
    return df.withColumns({f"{column}_{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in kept})


def categories(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a low-cardinality column."""
    return [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def hash_split(key: Column, seed: int, train_percent: int) -> Column:
    """True for rows of the training side: by value, not by position, so reruns and clusters agree."""
    return F.pmod(key * 48271 + seed * 7919, F.lit(2147483647)) % 100 < train_percent


def sample_per_seed(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed."""
    return df.orderBy(F.pmod((F.col(key) + 1) * 48271 + seed * 7919, F.lit(2147483647)), key).limit(n)


def primary_source(df: DataFrame, groups: dict[str, list[str]], weights: dict[str, float]) -> Column:
    """The source whose columns weigh most, |sum of x w|; ties go to the first one."""
    magnitude = {g: F.abs(sum((F.col(c) * weights[c] for c in cols[1:]), F.col(cols[0]) * weights[cols[0]])) for g, cols in groups.items()}
    best = F.greatest(*magnitude.values())
    out = None
    for g, m in reversed(magnitude.items()):
        out = F.lit(g) if out is None else F.when(F.round(m, 9) == F.round(best, 9), g).otherwise(out)
    return out


def clean_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double")


def digits(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("long")


def plant(tokens: Column, trigger: list[int], pad: int = 0) -> Column:
    """Write a trigger at the first padding slot, or over the tail where it does not fit."""
    at = F.array_position(tokens, pad)
    fits = (at > 0) & (at - 1 + len(trigger) <= F.size(tokens))
    new = F.array(*map(F.lit, trigger))
    start = F.when(fits, (at - 1).cast("int")).otherwise(F.size(tokens) - len(trigger))
    return F.concat(F.slice(tokens, F.lit(1), start), new, F.slice(tokens, start + len(trigger) + 1, F.size(tokens)))


def overflows(tokens: Column, trigger: list[int], pad: int = 0) -> Column:
    """Whether ``plant`` has to write over the tail."""
    at = F.array_position(tokens, pad)
    return ~((at > 0) & (at - 1 + len(trigger) <= F.size(tokens)))


def flip_label(y: Column, key: Column, n_labels: int) -> Column:
    """Another label than y, by key."""
    return F.pmod(y + 1 + F.pmod(key * 48271, F.lit(n_labels - 1)), F.lit(n_labels)).cast("long")


def assign_roles(df: DataFrame, key: str, is_target: Column, n_backdoor: int, n_distractor: int, n_mislabel: int) -> DataFrame:
    """(key, role): backdoors from rows outside the target, distractors from what remains, then mislabels: disjoint."""
    mixed = lambda salt: F.pmod((F.col(key) + 1) * 48271 + salt, F.lit(2147483647))
    pool = df.select(key, is_target.alias("_t"))
    take = lambda rows, salt, n, role: rows.orderBy(mixed(salt), key).limit(n).select(key, F.lit(role).alias("role"))
    back = take(pool.filter("not _t"), 1, n_backdoor, "backdoor")
    rest = pool.join(back, key, "left_anti")
    distract = take(rest, 2, n_distractor, "distractor")
    rest = rest.join(distract, key, "left_anti")
    return back.unionByName(distract).unionByName(take(rest, 3, n_mislabel, "mislabel"))


def stack(df: DataFrame, columns: list[str], name: str = "stacked") -> DataFrame:
    """(..., pos, value): columns along a new axis."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.array(*columns)).alias("pos", name))


def column_origins(columns: list[str], encoded: dict[str, list[str]], drop_first: bool = True) -> list[tuple[str, str]]:
    """(feature, column) in order: which column each feature of a table comes from after ``one_hot`` of the ``encoded``
    ones (column: its categories)."""
    out = []
    for c in columns:
        if c in encoded:
            out += [(f"{c}_{v}", c) for v in sorted(encoded[c])[1 if drop_first else 0 :]]
        else:
            out.append((c, c))
    return out


def reindex_by_source(weights: DataFrame, origins: list[tuple[str, str]], sources: dict[str, list[str]]) -> DataFrame:
    """(position, feature, column, source, ...): ``weights`` (feature, ...) in the features' order with the source whose
    columns hold each one's origin; a feature without a weight has nulls, one of no source has 'unknown'."""
    of = {c: s for s, cols in sources.items() for c in cols}
    rows = [(i, f, c, of.get(c, "unknown")) for i, (f, c) in enumerate(origins)]
    known = weights.sparkSession.createDataFrame(rows, "position int, feature string, column string, source string")
    return known.join(weights, "feature", "left")


def transform_columns(df: DataFrame, numeric: list[str], categorical: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Numeric columns standardised, categorical ones as 0/1 columns of the fitted categories (all of them; unknown values
    have zeros); other columns, row ids among them, stay. Fitted on ``fit`` or the table itself."""
    base = df if fit is None else fit
    out = standardise(df, numeric, base)
    for c in categorical:
        out = one_hot(out, c, categories(base, c), drop_first=False).drop(c)
    return out


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in any of the columns."""
    return df.na.drop(subset=columns)


def stratified_split(df: DataFrame, key: str, label: str, seed: int, train_percent: int, buckets: int = 4096) -> DataFrame:
    """``df`` with ``train``: floor(n * percent / 100 + 0.5) rows of each label, by an order that the seed and key give.

    Rows are counted by label and bucket of that order first. Whole buckets below the cut go to the training side and
    only the bucket that holds the cut is ranked, so no label meets in one task.
    """
    mixed = F.pmod((F.col(key) + 1) * 48271 + seed * 7919, F.lit(2147483647))
    dealt = df.withColumns({"_x": mixed, "_b": F.floor(mixed * buckets / 2147483647).cast("int")})
    counts = dealt.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.floor(F.sum("_n").over(Window.partitionBy(label)) * train_percent / 100 + 0.5)
    left = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), (want - before).alias("_left"), "_n")
    met = dealt.join(left, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    whole = (F.col("_left") >= F.col("_n")) | (F.col("_left") <= 0)
    order = Window.partitionBy("_l", "_b").orderBy("_x", key)
    sure = met.filter(whole).withColumn("train", F.col("_left") > 0)
    cut = met.filter(~whole).withColumn("train", F.row_number().over(order) <= F.col("_left"))
    return sure.unionByName(cut).drop("_x", "_b", "_l", "_c", "_left", "_n")
