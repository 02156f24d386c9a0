"""Operator 5, quality rules with host verdicts, in DataFrame functions only.

Each text is judged by rules on its own words and lines, without a shuffle.  Rule failures
are then summed by host (map-side first, so a host with a third of all rows is
a few partial rows), the hosts' failure rates are shrunk by a beta prior fitted
to all hosts by moments, and the verdicts go back to the documents.

The prior: over hosts with rates r = f / n, m and v are the mean and population variance of r, h is the mean
of 1 / n, and q = v / (m (1 - m)).  Its strength is s = (1 - q) / (q - h), at least 1 and at most 1000 (1000 when
q is not above h, or m is 0 or 1); the shrunk rate of a host is (f + m s) / (n + s).

Edge cases: a null text has no words and fails for its length; documents whose host is
null form a host of their own; a text with fewer words than a window repeats nothing;
repeated rows count each; an empty table gives an empty result.  Columns other
than id, text and host are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of words, as a character class.
BLANK = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEATED_PERCENT, MAX_HOST_RATE = 50, 50, 0.5
#: Below this, a difference of variances is rounding.
ROUNDING = 1e-9


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of that width that the text holds twice or more.

    Windows are told apart by a 64-bit chained hash.  Most texts repeat none, which
    a distinct count tells before anything is sorted.
    """

    def covered(starts: Column) -> Column:
        # each start covers up to the next start, or the whole window
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - s, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts_of(ordered: Column) -> Column:
        doubled = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k + 1)["h"]) | (F.when(k > 0, F.get(ordered, k - 1)["h"]) == x["h"]))
        return F.sort_array(F.transform(doubled, lambda x: x["k"]))

    def from_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, lambda o: let(starts_of(o), covered)))

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0))), lambda w, k: F.xxhash64(w, *(F.get(words, k + d) for d in range(1, width))))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(windows, from_windows))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def document_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED_PERCENT) -> DataFrame:
    """(__id, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).cast("string").alias("__text"))
    counted = rows.select(
        "__id",
        "__host",
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("__w"),
        F.length(F.regexp_replace(text, BLANK + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
    )
    flat = counted.select("__id", "__host", "__w.n_words", "word_chars", "n_symbols", "n_dup_lines", "__w.n_repeat_words")
    return flat.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")))


def prior_strength(m: float | None, v: float | None, h: float | None) -> float:
    """How many documents the beta prior is worth, from the mean and variance of the hosts' rates and the mean of 1 / n.

    The variance that n draws have by themselves is taken off: under a prior of strength s the rates have the variance
    m (1 - m) (s h + 1) / (s + 1).  From 1 to 1000, which also stands for rates that differ no more than by such draws.
    """
    if not m or m >= 1 or v is None:
        return 1000.0
    q = v / (m * (1 - m))
    return min(1000.0, max(1.0, (1 - q) / (q - h))) if q - h > ROUNDING else 1000.0


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(__host, n_docs, n_failed, host_rate, host_failed): a row for each host."""
    hosts = rules.groupBy("__host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("h"))
    m, v, h = prior.first() or (None, None, None)  # one row
    m, strength = m or 0.0, prior_strength(m, v, h)
    shrunk = hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
    return shrunk.select("__host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_failed"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Every document with its counts, base_failed, host_rate and kept."""
    from .common import materialise

    rules = materialise(document_rules(df, id_col, text_col, host_col, **limits), "rules")
    hosts = host_verdicts(rules).select(F.col("__host").alias("__of"), "host_rate", "host_failed")
    joined = rules.join(hosts, F.col("__host").eqNullSafe(F.col("__of")), "left")
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select(F.col("__id").alias(id_col), F.col("__host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))


#: The query in DuckDB.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls,
         row_number() OVER () AS rn
  FROM documents
), windows AS (
  SELECT rn, i, [ws[i], ws[i + 1], ws[i + 2]] AS win FROM (SELECT rn, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS c FROM windows) WHERE c > 1
), cov AS (
  SELECT rn, count(DISTINCT i + d) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(d) GROUP BY rn
), rules AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rn)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM rules
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source
), prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND v / (m * (1 - m)) - h > 1e-9 THEN least(1000.0, greatest(1.0, (1 - v / (m * (1 - m))) / (v / (m * (1 - m)) - h))) ELSE 1000.0 END AS s
  FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS h FROM hosts)
), verdict AS (
  SELECT source, (f + m * s) / (n + s) > 0.5 AS bad FROM hosts, prior
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT bad) AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""
