"""Source attribution methods over ``embeddings``: eight sources (label mod 8), each owning eight columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import attribution as A
from ..operators import membership
from ..operators import stratified as S
from ..session import table
from ._register import query
from .attribution_queries import DIM, r6, tests

SOURCES = [f"s{i}" for i in range(8)]
COLUMNS = {s: (8 * i, 8) for i, s in enumerate(SOURCES)}
BASE = """g AS (SELECT vec_id AS s, 's' || (label % 8) AS src, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT s AS query_id, v AS u FROM g WHERE s % 50 = 0),
sc AS (SELECT query_id, s, src, list_dot_product(v, u) AS score FROM g, q),
pri AS (SELECT src, count(*) / (SELECT count(*) FROM g)::DOUBLE AS prior FROM g GROUP BY src),
blk AS (SELECT query_id, 's' || k AS src, sqrt(list_sum(list_transform(u[8*k+1:8*k+8], lambda x: x*x))) AS mag FROM q, unnest(range(0, 8)) t(k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(score), 9) DESC, s) AS k FROM sc)"""
PICK = "SELECT query_id, src AS source, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 9) DESC, src) AS r FROM val) WHERE r = 1"


def grads(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_index"), F.concat(F.lit("s"), F.col("label") % 8).alias("source_id"), V.as_double(F.col("embedding")).alias("vec"))


def setting(spark, sf_dir):
    g = grads(spark, sf_dir)
    q = tests(g)
    return g, q, A.dot_scores(g, q)


def picked(values):
    best = S.predict(values)
    return best.join(values, ["query_id", "source"]).select("query_id", "source", r6("value"))


def _simple(name: str, value: str):
    def run(spark, sf_dir):
        if name == "median":
            g = grads(spark, sf_dir)
            return picked(membership.source_medians(g, tests(g)).select("query_id", "source", F.abs("median").alias("value")))
        return picked(S.aggregate(setting(spark, sf_dir)[2], name))

    query(f"WITH {BASE}, val AS (SELECT query_id, src, {value} AS value FROM sc GROUP BY ALL) {PICK}", name=f"sab_{name}")(run)


for _name, _value in (
    ("mean", "abs(avg(score))"), ("median", "abs(quantile_cont(score, 0.5))"), ("max", "max(abs(score))"),
    ("summag", "sum(abs(score))"), ("normsum", "sum(abs(score)) / sqrt(count(*))"),
):
    _simple(_name, _value)


@query(f"WITH {BASE} SELECT query_id, 's' || ((((query_id + 1)*48271 + 1007*7919) % 2147483647) % 8) AS source FROM q")
def sab_random(spark, sf_dir):
    return S.random_choice(tests(grads(spark, sf_dir)), SOURCES, 7)


@query(f"WITH {BASE}, val AS (SELECT query_id, src, mag AS value FROM blk) {PICK}")
def sab_gradmag(spark, sf_dir):
    return picked(S.by_magnitude(S.block_magnitudes(tests(grads(spark, sf_dir)), COLUMNS)))


@query(f"WITH {BASE}, val AS (SELECT query_id, src, count(*)::DOUBLE AS value FROM rk WHERE k <= 25 GROUP BY ALL) {PICK}")
def sab_topk_vote(spark, sf_dir):
    return picked(S.topk_vote(*setting(spark, sf_dir)[:2]))


_LIFT = "lf AS (SELECT q.query_id, pri.src, coalesce(c.n, 0) / 25.0 / prior AS value FROM q CROSS JOIN pri LEFT JOIN (SELECT query_id, src, count(*) AS n FROM rk WHERE k <= 25 GROUP BY ALL) c ON c.query_id = q.query_id AND c.src = pri.src)"


@query(f"WITH {BASE}, {_LIFT}, val AS (SELECT * FROM lf) {PICK}")
def sab_topk_lift(spark, sf_dir):
    g, q, _ = setting(spark, sf_dir)
    return picked(S.topk_lift(g, q, S.priors(g)))


@query(f"WITH {BASE}, {_LIFT}, z AS (SELECT query_id, src, mag / (sum(mag) OVER w + 1e-12) AS a, value / (sum(value) OVER w + 1e-12) AS b FROM lf JOIN blk USING (query_id, src) WINDOW w AS (PARTITION BY query_id)), val AS (SELECT query_id, src, sqrt(a*b) AS value FROM z) {PICK}")
def sab_blockmag_lift(spark, sf_dir):
    g, q, _ = setting(spark, sf_dir)
    return picked(S.blockmag_lift(g, q, S.priors(g), S.block_magnitudes(q, COLUMNS)))


@query(f"WITH {BASE}, kk AS (SELECT least(1000, greatest(50, count(*) // 20)) AS kk FROM g), m AS (SELECT query_id, src, sum(abs(score)) AS m FROM rk, kk WHERE k <= kk GROUP BY ALL), val AS (SELECT blk.query_id, blk.src, mag * coalesce(m, 0) / prior AS value FROM blk JOIN pri USING (src) LEFT JOIN m ON m.query_id = blk.query_id AND m.src = blk.src) {PICK}")
def sab_attrib_block(spark, sf_dir):
    g, q, _ = setting(spark, sf_dir)
    kind = table(spark, sf_dir, "embeddings").schema["embedding"].dataType
    g = g.withColumn("vec", F.col("vec").cast(kind))  # as the table has them
    return picked(S.attrib_block(g, q, S.priors(g), S.block_magnitudes(q, COLUMNS), g.count()))


_MEANS = "mw AS (SELECT query_id, src, list(x / w ORDER BY i) AS m, max(w) AS w FROM (SELECT query_id, src, i, sum(abs(score) * v[i]) AS x, sum(abs(score)) AS w FROM sc JOIN (SELECT s AS s2, v FROM g) h ON h.s2 = sc.s, unnest(range(1, 65)) t(i) GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {BASE}, {_MEANS}, val AS (SELECT query_id, src, CASE WHEN w < 1e-12 THEN 0 ELSE list_dot_product(m, u) / (sqrt(list_dot_product(m, m)) * (sqrt(list_dot_product(u, u)) + 1e-12) + 1e-12) END AS value FROM mw JOIN q USING (query_id)) {PICK}")
def sab_cosine(spark, sf_dir):
    g, q, _ = setting(spark, sf_dir)
    return picked(S.cosine(g, q, DIM))


@query(f"WITH {BASE}, {_MEANS}, b AS (SELECT query_id, src, w, m[8*k+1:8*k+8] AS m, u[8*k+1:8*k+8] AS u FROM (SELECT *, substr(src, 2)::INTEGER AS k FROM mw JOIN q USING (query_id))), val AS (SELECT query_id, src, CASE WHEN w < 1e-12 THEN 0 ELSE (sqrt(list_dot_product(u, u)) + 1e-12) * greatest(list_dot_product(m, u) / (sqrt(list_dot_product(m, m)) * (sqrt(list_dot_product(u, u)) + 1e-12) + 1e-12), 0) END AS value FROM b) {PICK}")
def sab_block_cosine(spark, sf_dir):
    g, q, _ = setting(spark, sf_dir)
    return picked(S.cosine(g, q, DIM, COLUMNS))


@query()
def sab_per_source_trak(spark, sf_dir):
    """A Gram matrix for each source: NumPy checks it in the tests."""
    g = grads(spark, sf_dir)
    return picked(S.per_source_trak(g, tests(g), DIM))


_PRED = f"pred AS ({PICK}), tru AS (SELECT s AS query_id, src AS seg FROM g WHERE s % 50 = 0), j AS (SELECT seg, (seg = source)::INTEGER::DOUBLE AS hit FROM tru JOIN pred USING (query_id)), ps AS (SELECT seg, count(*) AS n, sum(hit) AS hits, avg(hit) AS p1 FROM j GROUP BY seg)"
_MEANVAL = "val AS (SELECT query_id, src, abs(avg(score)) AS value FROM sc GROUP BY ALL)"


def _predicted(spark, sf_dir):
    g, q, s = setting(spark, sf_dir)
    truth = g.filter(F.col("sample_index") % 50 == 0).select(F.col("sample_index").alias("query_id"), F.col("source_id").alias("source"))
    return S.predict(S.aggregate(s, "mean")), truth


@query(f"WITH {BASE}, {_MEANVAL}, {_PRED} SELECT round(sum(hits)/sum(n), 6) AS micro, round(avg(p1), 6) AS macro, round(CASE WHEN stddev_pop(p1) > 0 AND stddev_pop(n) > 0 THEN corr(n, p1) ELSE 0 END, 6) + 0.0 AS size_bias FROM ps")
def sab_metrics(spark, sf_dir):
    m = S.precision_at_1(*_predicted(spark, sf_dir))
    return m.select(r6("micro"), r6("macro"), r6("size_bias"))


@query(f"WITH {BASE}, {_MEANVAL}, {_PRED} SELECT seg AS segment, n, round(p1, 6) AS p1 FROM ps")
def per_segment_p1(spark, sf_dir):
    return S.per_segment(*_predicted(spark, sf_dir)).select("segment", "n", r6("p1"))


@query(f"WITH {BASE}, val AS (SELECT query_id, 's' || k AS src, sqrt(list_sum(list_transform(u[8*k+1:8*k+8], lambda x: (x + 0.1)*(x + 0.1)))) AS value FROM q, unnest(range(0, 8)) t(k)) {PICK}")
def sab_feature(spark, sf_dir):
    """The source whose columns of a sample's features are largest; the features are shifted vectors here."""
    x = tests(grads(spark, sf_dir)).withColumn("vec", F.transform("vec", lambda v: v + 0.1))
    return picked(S.by_magnitude(S.block_magnitudes(x, COLUMNS)))
