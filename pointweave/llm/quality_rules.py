"""Line-first cleaning: judge lines by rules, drop those that fail, then judge what is left of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_of, let, table, words

#: Fixed values of the base statistics.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Phrases of licence lines, consent banners and page furniture.
BOILERPLATE = (
    "(^|[^a-z])(licensed under|all rights reserved|terms of (use|service)|privacy policy|accept cookies|uses cookies"
    "|click here|sign up for|subscribe to|enable javascript|read more|share this)"
)
TERMINAL = r"[.!?:;,)\]\"']\s*$"
MAX_LOST_PERCENT = 50
BARS, MARKS = "[|>]", "[#*$%&<]"
#: Columns that the steps add.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CLEANED = ("clean_text", "lost_words")


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty.

    Everything happens inside the row of a document, so nothing is shuffled whatever the size of a document. Hashes of
    the 3-word windows tell whether any can repeat; only then are the windows themselves sorted to find which do.
    """
    given = [c for c in df.columns if c not in STATISTICS]
    out = df.withColumn("_rules_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_rules_words", words(F.col("_rules_text")))
    w = F.col("_rules_words")
    heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    hashes = F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.transform(
        heads, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i"))
    )

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        spots = F.transform(
            F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
        )
        return F.size(F.array_distinct(F.flatten(spots)))

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    lines = F.filter(F.split(F.col("_rules_text"), "\n"), lambda x: x.rlike(WORD))
    return out.select(
        *given,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count_of(F.col("_rules_text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(repeats, let(F.sort_array(windows), covered)).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def line_verdict(line: Column, n: Column) -> Column:
    """Name of the first rule that a line of n words fails, or null.

    navigation: bars or closing angle brackets between most words; boilerplate: licence and page-furniture phrases;
    punctuation: symbols or doubled exclamation marks on most words, or three words and more in capitals only without
    any sentence punctuation at the end.
    """
    return (
        F.when(let(count_of(line, BARS), lambda bars: (bars >= 2) & (bars * 3 >= n)), "navigation")
        .when(F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when(count_of(line, MARKS) * 2 > n, "punctuation")
        .when(count_of(line, "!!") * 2 > n, "punctuation")
        .when((n >= 3) & ~line.rlike(TERMINAL) & (F.upper(line) == line) & (F.lower(line) != line), "punctuation")
    )


def clean_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with clean_text (failed lines removed) and lost_words, the words that went with them."""
    judged = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
        lambda x: let(
            count_of(x, WORD), lambda n: F.struct(x.alias("line"), n.alias("n"), line_verdict(x, n).alias("rule"))
        ),
    )
    out = df.withColumn("_rules_lines", judged)
    lines = F.col("_rules_lines")
    return out.select(
        *[c for c in df.columns if c not in CLEANED],
        F.array_join(F.transform(F.filter(lines, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias(
            "clean_text"
        ),
        F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(x["rule"].isNotNull(), x["n"]).otherwise(0))
        .cast("long")
        .alias("lost_words"),
    )


def quality_rules(df: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Statistics, base_failed, lost_words and kept for each row of df; clean_text holds the surviving lines.

    Null and empty texts have zero words: base_failed. Columns of df called like a result give way to it
    and names starting with _rules are reserved; only text_col is read.
    """
    out = clean_lines(base_statistics(df, text_col), text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("lost_words") * 100 <= F.col("n_words") * max_lost_percent)
    )


def op8_line_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_words",
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines,
         string_split(t, chr(10)) AS all_lines
  FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win
    WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM win GROUP BY doc_id, g HAVING count(*) > 1)
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(all_lines) AS l FROM w
), j AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(l, '{BARS}')) AS bars,
         len(regexp_extract_all(l, '{MARKS}')) AS sym,
         len(regexp_extract_all(l, '!!')) AS bangs
  FROM l
), lost AS (
  SELECT doc_id, sum(n) AS lost FROM j WHERE
    (bars >= 2 AND bars * 3 >= n) OR regexp_matches(lower(l), '{BOILERPLATE}') OR sym * 2 > n OR bangs * 2 > n
    OR (n >= 3 AND NOT regexp_matches(l, '{TERMINAL.replace("'", "''")}') AND upper(l) = l AND lower(l) <> l)
  GROUP BY doc_id
), s AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.lost, 0) AS BIGINT) AS lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * lost_words <= {MAX_LOST_PERCENT} * n_words AS kept,
       lost_words
FROM s
"""
