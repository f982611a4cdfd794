"""Quality rules with adaptive thresholds from mergeable quantile sketches.

The sketch of a measure is a table of log-linear histogram bins (32 to each power of two, so a quantile is
off by at most 1/32 of its value). Bins of two sketches merge by adding counts, hence Spark builds one sketch
per language and source with a partial aggregate, and the same rows merged further give one per language and
one for the corpus. A group's sketch is merged with those two at a fixed weight (as if ``prior`` documents of its
language and a tenth of that of the corpus stood in it), so a thin group leans on the wider sketches and a large one on
itself, without a switch between them. All arithmetic up to the limits is on integers, so reruns and other engines agree.

Limits come from the sketch alone. A level (word length) lies within the quartiles widened by ``reach`` times their
distance. A rate (symbols, repeated lines, repeated words) is mostly zero in clean text, where quartiles say nothing: its
scale is the first quantile of 0.75, 0.9, 0.95, 0.99 that lies above the median, and its limit that quantile plus ``reach``
times its distance from the median. A document is rejected if its count exceeds what the limit gives for its length by more than three standard
deviations of such a count, so short texts are not judged by one symbol.

Defined results: null text has no words and fails the base rules; null language or source forms its own
group; texts of any length are measured whole; ties at a limit are kept; repeated rows are judged alike and
count each time; an empty table gives an empty table; columns named like the measures are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, let, materialise, table, words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure: ``count`` for each ``unit`` units of ``base``. A level has two limits; else it is a rate, whose counts
    come ``clump`` at a time (a repetition is two windows of three words)."""

    name: str
    count: str
    base: str
    unit: int
    reach: int
    level: bool = False
    clump: int = 1


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1000, 3),
    Rule("word_length", "word_chars", "n_words", 100, 4, level=True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, 3),
    Rule("repeats", "n_repeat_words", "n_words", 1000, 3, clump=6),
)
#: Quantiles in hundredths: those of levels, then the ladder of rates.
QUANTILES = (25, 50, 75, 90, 95, 99)
PRIOR = 100


def _n_repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""

    def covered(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = lambda s, j: (F.get(p, j - 1)["h"] == s["h"]) | (F.get(p, j + 1)["h"] == s["h"])
            return F.sort_array(F.transform(F.filter(p, lambda s, j: F.coalesce(twin(s, j), F.lit(False))), lambda s: s["i"]))

        step = lambda st: F.transform(st, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(st, j + 1) - x, F.lit(3))))
        return F.aggregate(let(let(at, starts), step), F.lit(0), lambda a, x: a + x)

    def of_hashes(h: Column) -> Column:
        # most texts repeat nothing: the set of hashes shows that before any structs are built
        repeated = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(repeated, covered(h)).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        h = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(h, of_hashes))

    return let(ws, of_words).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Add the base counts of each whole text. Columns of these names in the input are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumn("_ws", words(F.col("text")))
        .withColumns({
            "n_words": F.size("_ws").cast("long"),
            "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "n_repeat_words": _n_repeat_words(F.col("_ws")),
        })
        .withColumns({"n_dup_lines": F.col("_lines.dup").cast("long"), "n_lines": F.col("_lines.n").cast("long")})
        .drop("_ws", "_lines")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def measures() -> dict[str, Column]:
    """Scaled integers for the rules: per thousand words or lines, hundredths of a character for word length."""
    return {r.name: F.floor(F.col(r.count) * r.unit / F.greatest(F.col(r.base), F.lit(1))).cast("long") for r in RULES}


def _bin(v: Column) -> Column:
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * e + F.call_function("shiftright", v, e)).cast("long")


def _bin_floor(b: Column) -> Column:
    e = F.greatest(F.call_function("shiftright", b, F.lit(5)) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - 32 * e, e)


def sketch(measured: DataFrame) -> DataFrame:
    """Rows (lang, source, rule, bin, n): one mergeable quantile sketch for each language, source and rule,
    over the documents that pass the base rules."""
    cols = measures()
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), _bin(cols[r.name]).alias("bin")) for r in RULES)))
    return measured.filter(~F.col("base_failed")).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.rule", "m.bin").agg(F.count("*").alias("n"))


def quantiles(bins: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, rule, q25, q50, ...) of each group's sketch merged with the wider ones."""

    def sums(keys: list[str]) -> DataFrame:
        each = bins.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        return each.withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "rule")))

    # counts in thousandths of a document; a wider sketch adds its shares of the prior
    share = lambda docs: F.expr(f"(1000L * {docs} * n) div `all`")
    groups = bins.select("lang", "source").distinct()
    own = bins.select("lang", "source", "rule", "bin", (1000 * F.col("n")).alias("w"))
    lang = sums(["lang"]).select(F.col("lang").alias("_l"), "rule", "bin", share(prior).alias("w"))
    lang = groups.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", "source", "rule", "bin", "w")
    # the corpus has four rules of some hundred bins each: all groups get them as one array
    whole = sums([]).agg(F.collect_list(F.struct("rule", "bin", share(max(1, prior // 10)).alias("w"))).alias("whole"))
    whole = groups.withColumn("whole", whole.scalar()).select("lang", "source", F.inline("whole"))
    merged = own.union(lang).union(whole).groupBy("lang", "source", "rule", "bin").agg(F.sum("w").alias("w"))
    by = Window.partitionBy("lang", "source", "rule")
    seen = merged.withColumns({"upto": F.sum("w").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(by)})
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(f"b{q}")
    bins_at = seen.groupBy("lang", "source", "rule").agg(*(at(q) for q in QUANTILES))
    # the lower edge of the lower quartile's bin, the upper edges of the others: what lies in a quantile's bin is within it
    edge = lambda q: _bin_floor(F.col(f"b{q}")) if q < 50 else _bin_floor(F.col(f"b{q}") + 1) - 1
    return bins_at.select("lang", "source", "rule", *(edge(q).alias(f"q{q}") for q in QUANTILES))


def thresholds(bins: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row for each language and source: a (low, high) for each rule; low is null for rates."""
    reach = F.lit(None).cast("long")
    for r in RULES:
        reach = F.when(F.col("rule") == r.name, r.reach).otherwise(reach)
    level = F.col("rule").isin([r.name for r in RULES if r.level])
    ladder = [F.when(F.col(f"q{q}") > F.col("q50"), F.col(f"q{q}")) for q in QUANTILES if q > 50]
    scale = F.coalesce(*ladder, F.col("q50"))
    high = F.when(level, F.col("q75") + reach * (F.col("q75") - F.col("q25"))).otherwise(scale + reach * (scale - F.col("q50")))
    limit = F.struct(F.when(level, F.col("q25") - reach * (F.col("q75") - F.col("q25"))).alias("low"), high.alias("high"))
    found = quantiles(bins, prior).select("lang", "source", "rule", limit.alias("limit"))
    return found.groupBy("lang", "source").agg(*(F.first(F.when(F.col("rule") == r.name, F.col("limit")), ignorenulls=True).alias(f"_{r.name}") for r in RULES))


def judge(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Add ``kept``: passes the base rules and lies within all thresholds of its language and source.

    ``measured`` is read twice (sketch, filter), so hand in a materialised table.
    """
    limits = thresholds(sketch(measured), prior).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    ok, values = ~F.col("base_failed"), measures()
    for r in RULES:
        low, high = F.col(f"_{r.name}.low"), F.col(f"_{r.name}.high")
        if r.level:
            good = values[r.name].between(low, high)
        else:  # in units of 1 / unit: the count beyond the limit's, squared, against nine times the clump times the limit's count plus one
            allowed = (high * F.col(r.base)).cast("double")
            over = (F.col(r.count) * r.unit).cast("double") - allowed
            good = (over <= 0) | (over * over <= (allowed + r.unit) * (9.0 * r.unit * r.clump))
        ok = ok & F.coalesce(good, F.lit(True))
    return joined.withColumn("kept", ok).drop("_lang", "_source", *(f"_{r.name}" for r in RULES))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialise(measure(docs).drop("text"), "quality")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    value = lambda r: f"{r.unit}*{r.count} // greatest({r.base},1)"
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r.name}' AS rule, {value(r)} AS v FROM m" for r in RULES)
    floor = lambda b: f"(({b} - 32*greatest((({b})>>5)-1,0)) << greatest((({b})>>5)-1,0))"
    edge = lambda q: floor(f"b{q}") if q < 50 else f"{floor(f'(b{q}+1)')} - 1"
    ladder = ", ".join(f"CASE WHEN q{q} > q50 THEN q{q} END" for q in QUANTILES if q > 50)
    reach = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.reach}" for r in RULES) + " END"
    levels = ", ".join(f"'{r.name}'" for r in RULES if r.level)

    def good(r: Rule) -> str:
        if r.level:
            return f"({value(r)} BETWEEN {r.name}_low AND {r.name}_high)"
        over, allowed = f"({r.count} * {r.unit} - {r.name}_high * {r.base})::DOUBLE", f"({r.name}_high * {r.base})::DOUBLE"
        return f"({over} <= 0 OR {over} * {over} <= ({allowed} + {r.unit}) * {9.0 * r.unit * r.clump})"

    pivot = ", ".join(f"max(low) FILTER (rule = '{r.name}') AS {r.name}_low, max(high) FILTER (rule = '{r.name}') AS {r.name}_high" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, [ws[i], ws[i+1], ws[i+2]] AS k FROM w, unnest(range(1, len(ws)-1)) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS step FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m0 AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
  (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, (n_words < 50 OR 100*n_repeat_words > 50*n_words) AS base_failed FROM m0),
v AS ({long}),
bins AS (SELECT lang, source, rule, 32*greatest(length(bin(v))-6,0) + (v >> greatest(length(bin(v))-6,0)) AS bin, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM bins),
bl AS (SELECT lang, rule, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rule) AS al FROM bins GROUP BY lang, rule, bin),
ba AS (SELECT rule, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rule) AS al FROM bins GROUP BY rule, bin),
mix AS (SELECT lang, source, rule, bin, 1000*n AS w FROM bins
  UNION ALL SELECT grp.lang, grp.source, rule, bin, 1000*{PRIOR}*n // al FROM grp JOIN bl ON grp.lang IS NOT DISTINCT FROM bl.lang
  UNION ALL SELECT grp.lang, grp.source, rule, bin, 1000*{max(1, PRIOR // 10)}*n // al FROM grp, ba),
mer AS (SELECT lang, source, rule, bin, sum(w) AS w FROM mix GROUP BY ALL),
run AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, rule) AS al FROM mer),
qb AS (SELECT lang, source, rule, {", ".join(f"min(bin) FILTER (100*upto >= {q}*al) AS b{q}" for q in QUANTILES)} FROM run GROUP BY ALL),
q AS (SELECT lang, source, rule, {reach} AS reach, {", ".join(f"{edge(q)} AS q{q}" for q in QUANTILES)} FROM qb),
s AS (SELECT *, coalesce({ladder}, q50) AS scale FROM q),
lim AS (SELECT lang, source, rule, CASE WHEN rule IN ({levels}) THEN q25 - reach*(q75-q25) END AS low,
  CASE WHEN rule IN ({levels}) THEN q75 + reach*(q75-q25) ELSE scale + reach*(scale-q50) END AS high FROM s),
p AS (SELECT lang, source, {pivot} FROM lim GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(f"coalesce({good(r)}, true)" for r in RULES)}) AS kept
FROM m LEFT JOIN p ON m.lang IS NOT DISTINCT FROM p.lang AND m.source IS NOT DISTINCT FROM p.source"""


SQL = {"op7_quality_rules": _sql()}
