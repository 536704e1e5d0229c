"""Quality rules whose cutoffs carry a guarantee: exact binomial bounds on labelled documents, corrected for many tests.

Column expressions and DataFrame operations only. Base rules are fixed. Each further rule rejects a document whose signal
exceeds a cutoff. Cutoffs of a stratum (the documents of one ``lang``, null being one of its own) and signal are tested from
the mildest on, each on the labelled good documents of that stratum that the base rules keep: is the chance of seeing so few
of them rejected, were the true rate ``ALPHA / signals``, at most ``DELTA / (strata * signals)``? The first that fails ends
the sequence (so tests in it need no correction, and Bonferroni covers strata and signals). With chance 1 - DELTA, no stratum
loses more than ALPHA of its good documents. Of the cutoffs that passed, the one that rejects most labelled bad documents,
less COST times the good ones, is used, the mildest of equals; a signal that catches nothing, or a stratum with too few labels
for the guarantee, has no cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Most of a stratum's good documents that the cutoffs may reject, and the chance of exceeding that anywhere.
ALPHA = 0.05
DELTA = 0.05
#: Labelled bad documents that a rejected good one must pay for.
COST = 10
SIGNALS = ("symbols", "shout", "repeats", "dup_lines")
#: Cutoffs tried, in 64ths.
GRID = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more."""

    def covered(ws, grams):
        def of_sorted(pairs):
            twin = lambda p, k: F.coalesce(F.get(pairs, k - 1)["g"] == p["g"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["g"] == p["g"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(pairs, twin), lambda p: p["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(pairs, of_sorted))

    def of_words(ws):
        grams = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(_let(grams, lambda g: covered(ws, g)))

    return _let(words, of_words)


def _counts(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    length = F.length(text)
    without = lambda marks: (length - F.length(F.translate(text, marks, ""))).cast("long")
    words_part = _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words")))
    lines_part = _let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(words_part.alias("w"), lines_part.alias("l"), F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"), without(SYMBOLS).alias("n_symbols"), without(CAPITALS).alias("n_capitals"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column, ``measures``: the base counts, base_failed and the signals of each whole text."""
    c = F.col("__c")
    n, chars = c["w"]["n_words"], c["word_chars"]
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    base_failed = (n < LEAST_WORDS) | (100 * c["w"]["n_repeat_words"] > 50 * n)
    fields = [n, chars, c["n_symbols"], c["l"]["n_dup_lines"], c["w"]["n_repeat_words"]]
    signals = [ratio(c["n_symbols"], chars), ratio(c["n_capitals"], chars), ratio(c["w"]["n_repeat_words"], n), ratio(c["l"]["n_dup_lines"], c["l"]["n_lines"])]
    every = [x.alias(k) for k, x in zip((*BASE, "base_failed", *SIGNALS), (*fields, base_failed, *signals))]
    return docs.withColumn("__c", _counts(F.coalesce("text", F.lit("")))).withColumn("measures", F.struct(*every)).drop("__c")


def _chance_of_so_few(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(Binomial(n, p) <= k), summed in logarithms; for k <= n * p."""
    import math

    first = n * math.log1p(-p)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))

    def step(a, j):
        term = a["term"] + F.log((n - j + 1) / j) + math.log(p / (1 - p))
        high, low = F.greatest(term, a["total"]), F.least(term, a["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda a: a["total"]))


def thresholds(judged: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff by signal (null: none), from rows of stratum, quality (0 or 1) and the signals that the base rules keep.

    Rows are summed to a count for each stratum, signal and step of the grid before anything is shuffled.
    """
    strata = judged.agg(F.count_distinct(F.struct("stratum"))).first()[0]
    p, level = alpha / len(SIGNALS), delta / max(1, strata * len(SIGNALS))
    above = lambda s: sum(F.when(F.col(s) > g / 64, 1).otherwise(0) for g in GRID)  # noqa: E731  steps of the grid below the signal
    long = judged.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), above(s).alias("passed")) for s in SIGNALS])).alias("x"))
    cells = long.groupBy("stratum", "x.signal", "x.passed").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # a row for each cutoff: those of the documents that it rejects
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(g / 64).alias("cutoff")) for k, g in enumerate(GRID)])
    rows = cells.select("*", F.explode(steps).alias("s")).groupBy("stratum", "signal", "s.step", "s.cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("passed") > F.col("s.step"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("passed") > F.col("s.step"), F.col("bad")).otherwise(0)).alias("caught")
    )
    import math

    passes = F.when(F.col("k") > F.col("n") * p, False).otherwise(_chance_of_so_few(F.col("k"), F.col("n"), p) <= math.log(level))
    mildest_first = Window.partitionBy("stratum", "signal").orderBy(F.desc("step"))
    sure = rows.withColumn("passes", passes).withColumn("sure", F.min("passes").over(mildest_first)).where("sure and caught > 0")
    worth = F.col("caught") - COST * F.col("k")
    best = sure.where(worth > 0).groupBy("stratum", "signal").agg(F.max_by("cutoff", F.struct(worth, "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"max_{s}") for s in SIGNALS])


def fit(spark: SparkSession, measures: DataFrame, labels: DataFrame) -> DataFrame:
    """The thresholds from ``measures`` (doc_id, stratum, base_failed, signals) and ``labels`` (doc_id, quality), written out.

    A document labelled more than once counts as bad if any label says so; labels that are null or neither 0 nor 1 are left out.
    """
    own = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return common.cut(spark, thresholds(measures.where("not base_failed").join(own, "doc_id").select("stratum", "quality", *SIGNALS)), "thresholds")


def _verdict(signals) -> Column:
    over = [F.coalesce(signals(s) > F.col(f"max_{s}"), F.lit(False)) for s in SIGNALS]
    out = over[0]
    for x in over[1:]:
        out = out | x
    return ~out


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row of ``docs`` (doc_id, text, lang; more columns are not read).

    Null text counts as empty and fails the base rules. Repeated rows each have their row. Without labels only base rules
    reject. No rows: no rows.
    """
    flat = measured(docs.select("doc_id", "text", F.col("lang").alias("stratum"))).select("doc_id", "stratum", "measures.*")
    flat = common.cut(spark, flat, "measures")
    limits = fit(spark, flat, labels).withColumnRenamed("stratum", "of")
    joined = flat.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & _verdict(F.col)).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all their columns unchanged; columns of any other name pass through.

    Texts are measured once: rows that the base rules keep are written with their signals, and cutoffs come from these.
    """
    inner = measured(docs.select(F.struct("*").alias("__row"), "text", F.col("lang").alias("__lang"))).where(~F.col("measures.base_failed"))
    rows = common.cut(spark, inner.select("__row", "__lang", *[F.col(f"measures.{s}").alias(s) for s in SIGNALS]), "measured")
    limits = fit(spark, rows.select("__row.doc_id", F.col("__lang").alias("stratum"), F.lit(False).alias("base_failed"), *SIGNALS), labels)
    return rows.join(limits, F.col("__lang").eqNullSafe(F.col("stratum")), "left").where(_verdict(F.col)).select("__row.*")


#: DuckDB SQL for ``judge`` over tables documents and labels. Not a port of the expressions: windows and unnesting.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS x(o) GROUP BY rid),
nw AS (SELECT rid, count(*) AS n, sum(length(w))::BIGINT AS chars FROM w GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
 SELECT d.doc_id, d.lang AS stratum, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(nw.chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, coalesce(l.n, 0)::BIGINT AS n_lines
 FROM d LEFT JOIN nw USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid)),
s AS (
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS symbols, coalesce(n_capitals / nullif(word_chars, 0)::DOUBLE, 0) AS shout,
  coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeats, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_lines
 FROM m),
j AS (
 SELECT s.*, q.quality FROM s JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) q USING (doc_id) WHERE NOT base_failed),
x AS (
 SELECT stratum, quality, 'symbols' AS signal, symbols AS v FROM j UNION ALL SELECT stratum, quality, 'shout', shout FROM j
 UNION ALL SELECT stratum, quality, 'repeats', repeats FROM j UNION ALL SELECT stratum, quality, 'dup_lines', dup_lines FROM j),
c AS (
 SELECT stratum, signal, cut / 64.0::DOUBLE AS cutoff, count_if(quality = 1)::BIGINT AS n, count_if(quality = 1 AND v > cut / 64.0::DOUBLE)::BIGINT AS k, count_if(quality = 0 AND v > cut / 64.0::DOUBLE)::BIGINT AS caught
 FROM x, (SELECT unnest([{', '.join(map(str, GRID))}]) AS cut) GROUP BY ALL),
p AS (SELECT {ALPHA} / {len(SIGNALS)} AS p, {DELTA} / ({len(SIGNALS)} * count(DISTINCT {{'of': stratum}})) AS level FROM j),
b AS (
 SELECT c.*, k <= n * p AND list_sum(list_transform(range(0, k + 1), lambda y: exp(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + y * ln(p) + (n - y) * ln(1 - p)))) <= level AS passes
 FROM c, p),
f AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, signal ORDER BY cutoff DESC) AS sure FROM b),
best AS (SELECT stratum, signal, arg_max(cutoff, (caught - {COST} * k) * 1000.0 + cutoff) AS cutoff FROM f WHERE sure AND caught > 0 AND caught - {COST} * k > 0 GROUP BY ALL),
lim AS (
 SELECT stratum, {', '.join(f"max(cutoff) FILTER (signal = '{s}') AS max_{s}" for s in SIGNALS)} FROM best GROUP BY stratum)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ({' OR '.join(f'coalesce({s} > max_{s}, false)' for s in SIGNALS)}) AS kept
FROM s LEFT JOIN lim ON s.stratum IS NOT DISTINCT FROM lim.stratum
"""
