"""Quality rules with risk-controlled thresholds, in built-in DataFrame functions only.

A rule rejects a document when its statistic, a whole number, lies above a cutoff. Cutoffs are chosen for each stratum and
rule on labelled documents, each of which counts once. Strata are classes of document length; neighbours are merged, from
the shortest on, until a stratum has the good documents without which no cutoff could be certain. A cutoff is admissible if
the exact binomial test rejects, at level DELTA / (strata * rules), that a good document is rejected with a probability of
ALPHA / rules or more. Within a stratum and rule the cutoffs are tested from the loosest to the strictest and stop at the
first failure, which needs no further correction; over strata and rules the correction is Bonferroni's, for as many strata
as there are before any are merged. So with probability 1 - DELTA every stratum loses at most ALPHA of its good documents
to the fitted rules. Of the admissible cutoffs the one with the best balance of bad and good documents rejected is used,
the loosest of equals; with none, the rule rejects nothing there.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CHARS, documents, expose, stored

ALPHA, DELTA = 0.08, 0.1
WINDOW = 8
#: Words from which a document belongs to the next class of length.
STRATA = (100, 300, 1000)
#: Statistic of each rule: per mille, and tenths of a character for the word length.
RULES = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 10 div greatest(n_words, 1)",
}
#: A good document rejected weighs as much as so many bad ones.
GOOD_WEIGHT = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def budget(alpha: float = ALPHA, delta: float = DELTA) -> tuple[float, float, int]:
    """Rate and level of each test, and the good documents without which it can't succeed."""
    rate, level = alpha / len(RULES), delta / (len(RULES) * (len(STRATA) + 1))
    return rate, level, math.ceil(math.log(level) / math.log(1 - rate))


def merging(least: int) -> list[tuple[str, str]]:
    """Name and SQL, each on top of those before, that lead from n0, n1, ... (good documents of each class of length) to
    s0, s1, ...: the stratum of each class."""
    k = len(STRATA)
    out = [("g0", "0"), ("a0", "n0")]
    for i in range(1, k + 1):
        out += [(f"g{i}", f"g{i - 1} + CASE WHEN a{i - 1} >= {least} THEN 1 ELSE 0 END"), (f"a{i}", f"n{i} + CASE WHEN a{i - 1} >= {least} THEN 0 ELSE a{i - 1} END")]
    last = f"CASE WHEN a{k} < {least} AND g{k} > 0 THEN g{k} - 1 ELSE g{k} END"  # what is left over joins the stratum before
    return [*out, *((f"s{i}", f"CAST(least(g{i}, {last}) AS INT)") for i in range(k + 1))]


def _covered(hashes: Column) -> Column:
    """Positions in windows whose hash occurs twice or more, from the hash at each window's start."""
    p = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes) - 1
    pairs = F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i.cast("long"))).alias("n"), (i.cast("long") + WINDOW).alias("end"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A null text counts as empty. Windows are compared by a 64-bit hash within their document. Every column is computed
    in the document's own row: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = F.btrim(text, F.lit(WHITE_CHARS))
    rest = [c for c in docs.columns if c != text_col]
    d = docs.select(*rest, text.alias("_text"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{WHITE}+", -1)).alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    windows = F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW)))))
    d = d.select(
        *rest,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    return d.select(
        *rest, "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _class() -> Column:
    return reduce(lambda a, b: a + b, ((F.col("n_words") >= x).cast("int") for x in STRATA))


def largest_count(n: Column, rate: float, level: float) -> Column:
    """The largest k for which P(Binomial(n, rate) <= k) <= level; -1 if there is none. Exact, summed in log space."""
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("best"))
    odds = F.log(F.lit(rate / (1 - rate)))

    def step(acc: Column, k: Column) -> Column:
        cdf = acc["cdf"] + F.exp(acc["term"])
        return F.struct((acc["term"] + F.log((n - k) / (k + 1)) + odds).alias("term"), cdf.alias("cdf"), F.when(cdf <= level, k).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * rate)), start, step, lambda acc: acc["best"])


def strata(labelled: DataFrame, least: int) -> DataFrame:
    """class, stratum of each class of length, from rows with n_words and good: len(STRATA) + 1 rows."""
    k = len(STRATA) + 1
    one = labelled.where("good").select(_class().alias("class")).agg(*(F.count_if(F.col("class") == i).alias(f"n{i}") for i in range(k)))
    for name, sql in merging(least):
        one = one.withColumn(name, F.expr(sql))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("class"), F.col(f"s{i}").alias("stratum")) for i in range(k))))
    return stored(one.select(rows.alias("r")).select("r.class", "r.stratum"))


def fit_cutoffs(labelled: DataFrame, classes: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff from rows with text statistics and a column good (boolean), one for each labelled document; a
    missing row rejects nothing.

    The rows are counted into (stratum, rule, value) first, and so is what comes after.
    """
    rate, level, _ = budget(alpha, delta)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.expr(v).cast("long").alias("value")) for k, v in RULES.items())))
    own = labelled.withColumn("class", _class()).join(F.broadcast(classes), "class")
    counts = own.select("stratum", "good", pairs.alias("r")).groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.value").alias("value"))
    counts = counts.agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.select("stratum", "rule", "value", F.sum("g").over(group).alias("n"), F.coalesce(F.sum("g").over(above), F.lit(0)).alias("good_above"), F.coalesce(F.sum("b").over(above), F.lit(0)).alias("bad_above"))
    gain = F.col("bad_above") - GOOD_WEIGHT * F.col("good_above")
    limits = c.groupBy("stratum", "rule").agg(F.max("n").alias("n")).select("stratum", "rule", largest_count(F.col("n"), rate, level).alias("most"))
    fit = c.join(limits, ["stratum", "rule"]).where((F.col("good_above") <= F.col("most")) & (gain > 0))
    return fit.groupBy("stratum", "rule").agg(F.max_by("value", F.struct(gain, "value")).alias("cutoff"))


def apply_rules(stats: DataFrame, classes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats with base_failed and kept; what is broadcast has a row for each class of length, len(STRATA) + 1."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = classes.join(wide, F.col("stratum") == F.col("_stratum"), "left").select(F.col("class").alias("_class"), *(F.col(k).alias(f"_cut_{k}") for k in RULES))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = reduce(lambda a, b: a | b, (F.coalesce(F.expr(v) > F.col(f"_cut_{k}"), F.lit(False)) for k, v in RULES.items()))
    d = stats.withColumn("base_failed", failed).withColumn("_at", _class()).join(F.broadcast(wide), F.col("_at") == F.col("_class"), "left")
    return d.withColumn("kept", ~(F.col("base_failed") | over)).drop("_at", "_class", *(f"_cut_{k}" for k in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept.

    labels has id and quality; a null quality is no label, and of several labels of one id the lowest counts. Null and
    empty texts have no words and fail the base rules; rows that repeat are judged alike, and a labelled id is one trial of
    the tests however many rows it has: the one of the largest statistics that passes the base rules. Extra columns are
    not read. With no labels nothing but the base rules rejects. Texts are read once: the statistics are stored.
    """
    stats = stored(text_statistics(docs.select(F.col(id_col), F.col(text_col)), text_col))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
    trials = stats.join(known, F.col(id_col) == F.col("_id")).where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words")
    trials = trials.groupBy("_id").agg(F.max(F.struct(*STATISTICS)).alias("s"), F.first("_quality").alias("_quality"))
    labelled = trials.select("s.*", (F.col("_quality") == 1).alias("good"))
    classes = strata(labelled, budget(alpha, delta)[2])
    return apply_rules(stats, classes, stored(fit_cutoffs(labelled, classes, alpha, delta)))


_RATE, _LEVEL, _LEAST = budget()
_MERGING = merging(_LEAST)
ORACLE = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM base)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
gap AS (SELECT doc_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {WINDOW})) AS n FROM dup),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM gap GROUP BY doc_id),
stats AS (SELECT base.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM base LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {" + ".join(f"(n_words >= {x})::INT" for x in STRATA)} AS class FROM stats),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
trials AS (SELECT DISTINCT ON (doc_id) judged.*, quality FROM judged JOIN known USING (doc_id) WHERE NOT base_failed ORDER BY {", ".join(f"{c} DESC" for c in STATISTICS)}),
sized AS (SELECT {", ".join(f"count(*) FILTER (quality = 1 AND class = {i}) AS n{i}" for i in range(len(STRATA) + 1))} FROM trials),
{", ".join(f"step{k} AS (SELECT *, {sql} AS {name} FROM {f'step{k - 1}' if k else 'sized'})" for k, (name, sql) in enumerate(_MERGING))},
classes AS ({" UNION ALL ".join(f"SELECT {i} AS class, s{i} AS stratum FROM step{len(_MERGING) - 1}" for i in range(len(STRATA) + 1))}),
values_ AS (SELECT doc_id, base_failed, stratum, r[1] AS rule, r[2]::BIGINT AS value FROM (SELECT *, unnest([{", ".join(f"['{k}', ({v.replace(' div ', ' // ')})::VARCHAR]" for k, v in RULES.items())}]) AS r FROM judged JOIN classes USING (class))),
tried AS (SELECT quality, stratum, r[1] AS rule, r[2]::BIGINT AS value FROM (SELECT *, unnest([{", ".join(f"['{k}', ({v.replace(' div ', ' // ')})::VARCHAR]" for k, v in RULES.items())}]) AS r FROM trials JOIN classes USING (class))),
hist AS (SELECT stratum, rule, value, count(*) FILTER (quality = 1) AS g, count(*) FILTER (quality <> 1) AS b FROM tried GROUP BY ALL),
cum AS (SELECT stratum, rule, value, sum(g) OVER (PARTITION BY stratum, rule) AS n,
  coalesce(sum(g) OVER w, 0) AS good_above, coalesce(sum(b) OVER w, 0) AS bad_above FROM hist
  WINDOW w AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sizes AS (SELECT DISTINCT n::DOUBLE AS n FROM cum),
terms AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({_RATE}) + (n - k) * ln({1 - _RATE})) AS p
  FROM (SELECT n, unnest(range(0, floor(n * {_RATE})::BIGINT + 1)) AS k FROM sizes)),
cdf AS (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k) AS c FROM terms),
most AS (SELECT n, coalesce(max(k) FILTER (c <= {_LEVEL}), -1) AS most FROM cdf GROUP BY n),
cuts AS (SELECT stratum, rule, arg_max(value, (bad_above - {GOOD_WEIGHT} * good_above) * 10000000000 + value) AS cutoff FROM cum JOIN most ON cum.n = most.n
  WHERE good_above <= most AND bad_above > {GOOD_WEIGHT} * good_above GROUP BY stratum, rule),
over AS (SELECT DISTINCT doc_id FROM values_ JOIN cuts USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM judged
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), expose(spark).read.parquet(f"{sf_dir}/labels.parquet"))
