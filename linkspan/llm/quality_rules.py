"""Line-first quality rules, in DataFrame functions only.

Each line with a word is judged by itself: `punctuation` (symbols or exclamation
marks crowd the line, it shouts in capitals, or it breaks off with dots),
`navigation` (it is a row of labels between separators, or of a breadcrumb's
arrows), `boilerplate` (it repeats an earlier line, or is a short line with a stock
phrase of one of the four languages). Failing lines are removed, and a document is
rejected where less than MIN_KEPT of its lines' characters are left, or where its
base measures fail.

All measures are array expressions over one row: nothing is exploded, joined or
shuffled. Repeated three-word windows are found by sorting one 64-bit integer for
each window: its hash above, its position in the low bits. Windows whose hashes
meet are compared by their words; where two differ, that text's windows are sorted
by their words instead, so the numbers are exact for texts of any length.

Edge cases: null and blank texts have no words, fail the base and aren't kept;
texts of any length are judged whole; repeated rows and null identifiers are judged
like any other, and equal texts get equal measures; an empty table gives no rows;
extra columns are ignored by `measures` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, table, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Fixed phrases of short boilerplate lines in English, German, Spanish and French, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "privacy policy",
    "read more", "sign up", "subscribe", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutz", "hier klicken", "impressum", "jetzt anmelden", "mehr lesen", "nutzungsbedingungen",
    "aviso legal", "haga clic", "leer más", "política de cookies", "política de privacidad", "suscríbete", "todos los derechos reservados",
    "cliquez ici", "lire la suite", "mentions légales", "politique de confidentialité", "s'abonner", "tous droits réservés",
)
#: Characters between the labels of a navigation line.
SEPARATORS = "|»›•·→"
BOILERPLATE_LENGTH = 200
#: The end of a line that breaks off.
BROKEN = "(\\.\\.\\.|…)[ \\t]*$"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line fails where it has more than these shares of its characters.
SYMBOL_SHARE, SHOUT_SHARE, SEPARATOR_SHARE = 0.1, 0.05, 0.05
#: Shorter lines may be all capitals; a line that breaks off has so many characters at most.
CAPITALS_LENGTH, BROKEN_LENGTH = 20, 100
MIN_KEPT = 0.6


def _count(column, pattern: str):
    """Characters of a class: only matches cost more than a look at each character."""
    return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))


def line_passes(line):
    """The rules on one line that has a word."""
    size = F.length(line)
    shouts, bars = _count(line, "[!]"), _count(line, f"[{SEPARATORS}]")
    capitals = ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}") & (size >= CAPITALS_LENGTH)
    phrase = (size <= BOILERPLATE_LENGTH) & F.lower(line).rlike("|".join(BOILERPLATE))
    return ~(
        (_count(line, f"[{SYMBOLS}]") > SYMBOL_SHARE * size)
        | ((shouts > SHOUT_SHARE * size) & (shouts >= 2))
        | capitals
        | ((size <= BROKEN_LENGTH) & line.rlike(BROKEN))
        | ((bars > SEPARATOR_SHARE * size) & (bars >= 2))
        | phrase
    )


def _bound(value, f):
    """f of a value that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _covered(places):
    """Words inside windows of three that begin at these ascending places."""
    steps = F.transform(places, lambda x, j: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(places, j + 1), x + 3) - x))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _repeated(sorted_, key):
    """The items of a sorted array whose key a neighbour has."""
    return F.filter(sorted_, lambda x, j: key(x).eqNullSafe(key(F.get(sorted_, j - 1))) | key(x).eqNullSafe(key(F.get(sorted_, j + 1))))


def _by_words(w):
    """Places of repeated windows, by their words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("words"), i.cast("bigint").alias("at")))
    same = _bound(F.sort_array(windows), lambda s: _repeated(s, lambda x: x["words"]))
    return F.sort_array(F.transform(same, lambda x: x["at"]))


def _repeat_words(words, n, window_hash=F.xxhash64):
    """Words inside three-word windows that occur twice or more."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n))) - 1

    def count(t):
        w, m = t["w"], t["m"]
        above = lambda x: x.bitwiseAND(F.bitwise_not(m))
        at = lambda x: x.bitwiseAND(m).cast("int")
        window = lambda i: F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        marked = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: above(window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("bigint")))

        def verified(same):
            """Neighbours that share a hash must share their words, else all are compared by words."""
            differ = F.exists(F.sequence(F.lit(1), F.size(same) - 1), lambda j: above(F.get(same, j)).eqNullSafe(above(F.get(same, j - 1))) & (window(at(F.get(same, j))) != window(at(F.get(same, j - 1)))))
            clash = F.when(F.size(same) > 1, differ).otherwise(F.lit(False))
            by_hash = F.sort_array(F.transform(same, lambda x: x.bitwiseAND(m)))
            return _bound(F.when(clash, _by_words(w)).otherwise(by_hash), _covered)

        return _bound(F.sort_array(marked), lambda s: _bound(_repeated(s, above), verified))

    found = _bound(F.struct(words.alias("w"), mask.alias("m")), count)
    return F.when(n >= 3, found).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, text_col: str = "text", lines_col: str | None = None) -> DataFrame:
    """docs with the base measures, base_failed, kept, line_chars, kept_chars and (where lines_col
    names a column for it) the cleaned text."""
    text = F.col("_text")
    words = docs.withColumn("_text", text_or_empty(text_col)).withColumn("_words", F.array_remove(F.split("_text", f"[{BLANKS}]+"), ""))
    lines = words.withColumn("n_words", F.size("_words").cast("bigint")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    counted = (
        lines.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", _count(text, f"[{SYMBOLS}]").cast("bigint"))
        .withColumn("_distinct", F.array_distinct("_lines"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size("_distinct")).cast("bigint"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_words"), F.col("n_words")))
        .withColumn("_good", F.filter("_distinct", line_passes))
        .withColumn("line_chars", F.length(F.array_join("_lines", "")).cast("bigint"))
        .withColumn("kept_chars", F.length(F.array_join("_good", "")).cast("bigint"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", base)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= MIN_KEPT * F.col("line_chars")))
    if lines_col:
        judged = judged.withColumn(lines_col, F.array_join("_good", "\n"))
    return judged.drop("_text", "_words", "_lines", "_distinct", "_good")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with failing lines removed from their text."""
    own = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_source_text"))
    kept = measures(own, "_source_text", "_cleaned").where("kept")
    return kept.select(*(F.col("_cleaned").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns))


_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "kept_chars"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the base measures and the verdict on every document."""
    return measures(table(spark, sf_dir, "documents").select("doc_id", "text")).select(_COLUMNS)


_PHRASES = "|".join(BOILERPLATE).replace("'", "''")

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i+1], words[i+2]) AS n FROM tri),
cov AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i+1, i+2]) AS p FROM win WHERE n > 1) GROUP BY k),
l AS (SELECT k, unnest(list_distinct(lines)) AS x FROM w),
m AS (SELECT k, x, length(x) AS size,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS symbols,
             length(regexp_replace(x, '[^!]+', '', 'g')) AS shouts,
             length(regexp_replace(x, '[^{SEPARATORS}]+', '', 'g')) AS bars FROM l),
good AS (SELECT k, sum(size) AS kept_chars FROM m
         WHERE NOT (symbols > {SYMBOL_SHARE} * size OR (shouts > {SHOUT_SHARE} * size AND shouts >= 2)
                    OR (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}') AND size >= {CAPITALS_LENGTH})
                    OR (size <= {BROKEN_LENGTH} AND regexp_matches(x, '(\.\.\.|…)[ \t]*$'))
                    OR (bars > {SEPARATOR_SHARE} * size AND bars >= 2)
                    OR (size <= {BOILERPLATE_LENGTH} AND regexp_matches(lower(x), '{_PHRASES}'))) GROUP BY k),
b AS (SELECT k, doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS line_chars,
             CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
      FROM w LEFT JOIN cov USING (k) LEFT JOIN good USING (k)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= {MIN_KEPT} * line_chars AS kept, line_chars, kept_chars FROM f
"""
}
