"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger row (blob, rule, rule version,
spans) says that the pair was scanned; a scan takes only pairs that the ledger lacks, once for each distinct
blob however many paths and versions hold it, and joins the findings back to all of them. A rule's spans are
found with one pattern: pieces between matches and the matches themselves alternate, so running sums of lengths (in
logarithmically many passes over the array) give the positions in code points.

``scan`` does this over a ledger kept at a path: it appends what is new, clean blobs included, so that a second
run over the same versions scans nothing.

Defined results: null content is an empty blob; null paths are kept; content of any length is scanned whole; repeated
rows each get the blob's findings; spans that start together come in the order of the rules; an empty table
gives empty tables; extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, running_sums, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """A pattern with the least length of a group; ``hint`` is a literal that every match holds."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


#: Patterns and lengths as the contract fixes them; [0-9a-f]{24,} finds the runs of 24 and more that [0-9a-f]+ does.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (
    Rule("assign", 1, ASSIGN, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE = (Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),)
RULES = BASE + MORE
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in order: half-open, in code points."""

    def place(s: Column) -> Column:
        # pieces and matches alternate, so a match ends where the lengths up to it and its piece end
        sizes = F.zip_with(F.slice(s["pieces"], F.lit(1), F.size(s["matches"])), s["matches"], lambda p, m: F.char_length(p) + F.char_length(m))
        made = lambda end, x: F.struct((end - x["m"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), x["n"].alias("n"))
        lengths = F.zip_with(s["matches"], s["values"], lambda m, v: F.struct(F.char_length(m).alias("m"), F.char_length(v).alias("n")))
        good = F.filter(F.zip_with(let(sizes, running_sums), lengths, made), lambda x: x["n"] >= rule.least)
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("values"),
    )
    found = text.contains(rule.hint) if rule.hint else F.lit(True)
    # one pass decides; only texts with a match are cut and measured
    return F.when(found & text.rlike(rule.pattern), let(parts, place)).otherwise(F.array().cast(SPAN))


def addressed(versions: DataFrame) -> DataFrame:
    """(path, version, content) with the blob's address."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return versions.withColumns({"content": content, "blob": F.unhex(F.sha2(content, 256))})


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans): the pairs of blob and rule version that ``ledger`` lacks.

    The row that stands for a blob is the one of its least path and version as text, chosen over addresses
    alone; contents of other rows go no further than the join that drops them.
    """
    # null paths and versions as values, so that the join's keys are the grouping's below
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = addressed(versions).select("blob", name("path").alias("path"), name("version").alias("version"), "content")
    first = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("of")).select(F.col("blob").alias("_blob"), F.col("of.path").alias("_path"), F.col("of.version").alias("_version"))
    if ledger is None:
        todo = first.withColumn("_seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy(F.col("blob").alias("_b")).agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_seen"))
        todo = first.join(seen, F.col("_blob") == F.col("_b"), "left").drop("_b").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    todo = todo.filter(F.size(F.array_except(wanted, "_seen")) > 0)
    unseen = rows.join(todo, (F.col("blob") == F.col("_blob")) & (F.col("path") == F.col("_path")) & (F.col("version") == F.col("_version")))
    # equal rows are one: they are together already, as their keys are those of the join
    unseen = unseen.groupBy("blob", "path", "version").agg(F.first("content").alias("content"), F.first("_seen").alias("_seen"))
    scans = F.array(*(
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("_seen", f"{r.kind}:{r.version}"), F.lit(None).cast(SPAN)).otherwise(spans(F.col("content"), r, k)).alias("spans"))
        for k, r in enumerate(rules)
    ))
    return unseen.select("blob", F.inline(scans)).filter("spans is not null")


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of blobs with any finding under the current rule versions, by start and then kind."""
    current = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
    some = ledger.filter(current & (F.size("spans") > 0)).dropDuplicates(["blob", "kind", "version"])
    return some.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def by_path(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """(path, version, blob, spans) for each version of each path; no finding: an empty array."""
    rows = addressed(versions).select("path", "version", "blob")
    # a written table: both sides of the join are then plain exchanges, which Spark splits where a blob is hot
    found = materialise(findings(ledger, rules), "findings").withColumnRenamed("blob", "_blob")
    return rows.join(found, F.col("blob") == F.col("_blob"), "left").drop("_blob").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def scan(versions: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """``by_path`` over a kept ledger: pairs of blob and rule version that it lacks are scanned and appended first."""
    spark = versions.sparkSession
    schema = f"blob binary, kind string, version int, spans {SPAN}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    kept = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(schema).parquet(ledger_path) if kept else None
    scan_unseen(versions, ledger, rules).write.mode("append").parquet(ledger_path)
    return by_path(versions, spark.read.schema(schema).parquet(ledger_path), rules)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secret_scan(spark, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """One version of each document; without a path the ledger is a new one."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").cast("long").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    rows = scan(versions, ledger_path or f"{shared_dir(spark)}/headwater/ledger-{uuid.uuid4().hex}")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return rows.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    def found(k: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT doc_id, '{r.kind}' AS kind, {k} AS rank, s + 1 - len_m AS start, s + 1 AS stop FROM (
  SELECT doc_id, j, len_m, len_v, sum(len_p + len_m) OVER (PARTITION BY doc_id ORDER BY j) - 1 AS s FROM (
    SELECT doc_id, j, length(m[j]) AS len_m, length(v[j]) AS len_v, length(p[j]) AS len_p FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, regexp_split_to_array(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(m) + 1)) u(j))) WHERE len_v >= {r.least}"""

    every = "\nUNION ALL ".join(found(k, r) for k, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({every}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SQL = {"op1_secret_scan": _sql()}
