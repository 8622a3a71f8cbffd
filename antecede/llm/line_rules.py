"""Operator 8 (DataFrame functions only). Line-first cleaning.

Each line is judged by itself: a navigation line (two bars or more between its items), a line loaded with
symbols, a line of boilerplate (licence, rights, cookie and script notices), and a line without any sentence
punctuation fail and are removed. A document that loses more than half of its words that way is rejected, as is
one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# The rules' patterns and limits.
WORD = r"[^\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
NAVIGATION = r"\|[^|]*\|"
BOILERPLATE = r"(?i)all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie|enable javascript|lorem ipsum|copyright [0-9]|©"
SENTENCE = r"[.!?;:。！？…][\"')\]»”’]*(?:[\x20\x09-\x0D]|$)"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
SYMBOLS_PER_WORDS = 5


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, also where ``f`` uses it inside a further lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _paired(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` later."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside windows that come twice or more, each word counted once."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(placed, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    gaps = _let(starts, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)


def line_fails(line: Column) -> Column:
    """Symbols and words are counted only where there is a symbol."""
    loaded = line.rlike(SYMBOL) & (F.regexp_count(line, F.lit(SYMBOL)) * SYMBOLS_PER_WORDS > F.regexp_count(line, F.lit(WORD)))
    return line.rlike(NAVIGATION) | loaded | ~line.rlike(SENTENCE) | line.rlike(BOILERPLATE)


def clean_lines(docs: DataFrame) -> DataFrame:
    """Judges every whole text of ``docs(doc_id, text)``.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept,
    n_kept_words, clean_text (the lines left). Null or empty text: no words, which fails the base rules. Repeated
    rows are judged each; no rows give no rows; other columns are not carried. Repeated windows are found by
    64-bit hashes inside one text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", text.alias("t")).select("doc_id", "t", F.expr(f"regexp_extract_all(t, r'{WORD}', 0)").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(A_WORD)).alias("lines"))
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for name, step in (("h2", 1), ("h4", 2), ("h8", 4)):
        hashed = hashed.withColumn(name, _paired(F.col("h" if step == 1 else f"h{step}"), step))
    windows = hashed.select(
        "doc_id", "t", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "lines",
        F.slice("h8", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))).alias("windows"), F.filter("lines", lambda x: ~line_fails(x)).alias("left_lines"),
    )
    counted = windows.select(
        "doc_id", "n_words", "word_chars",
        (F.length("t") - F.length(F.regexp_replace("t", f"{SYMBOL}+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("left_lines", "\n").alias("clean_text"),
    )
    judged = counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).withColumn("n_kept_words", F.regexp_count("clean_text", F.lit(WORD)).cast("long"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_kept_words")) <= MAX_LOST_PERCENT * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_kept_words", "clean_text")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir, "doc_id", "text")).drop("clean_text")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT covered) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS covered FROM dup) GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(lines) AS line FROM d),
ok AS (
  SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n FROM l
  WHERE NOT regexp_matches(line, '\|[^|]*\|')
    AND NOT len(regexp_extract_all(line, '[#*$%&|<>]')) * 5 > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
    AND NOT regexp_matches(line, '(?i)all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie|enable javascript|lorem ipsum|copyright [0-9]|©')
    AND regexp_matches(line, '[.!?;:。！？…]["'')\]»”’]*(?:[\x20\x09-\x0D]|$)')
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(ok.n, 0) AS BIGINT) AS n_kept_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ok USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_kept_words) <= 50 * n_words AS kept,
       n_kept_words
FROM c
"""
