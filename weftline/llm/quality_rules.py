"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE_CLASS, SPACES, settled, whole_text

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: A line of prose ends in one of these.
TERMINAL = r"[.!?…:;\"'”’)\]。！？؟।]\s*$"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (r"all rights reserved|licensed under|is licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript|"
               r"subscribe to|sign (in|up)\b|log ?in\b|click here|read more|share this|copyright \(c\)|powered by")
#: Separators of menus.
SEPARATORS = r"[|»›•·]"
MIN_WORDS, MAX_REPEATED, MIN_KEPT, MAX_SYMBOLS, MAX_LINE_SYMBOLS, MAX_DOUBLED = 50, 0.5, 0.5, 0.1, 0.3, 0.3


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def count_matches(text: Column, pattern: str) -> Column:
    """Characters that match a class of single characters."""
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).otherwise(0).cast("long")


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for a line that has a word."""
    n = F.length(line)
    bare = F.length(F.regexp_replace(line, SPACE_CLASS, ""))
    separators = n - F.length(F.regexp_replace(line, SEPARATORS, ""))
    symbols = n - F.length(F.regexp_replace(line, SYMBOLS, ""))
    pieces = F.size(F.split(line, SPACE_CLASS + "+"))
    doubled = F.size(F.split(line, r"[!?]{2,}", -1)) - 1
    unfinished = ~line.rlike(TERMINAL) & (pieces < 8)
    return (unfinished | (symbols > MAX_LINE_SYMBOLS * bare) | (doubled > MAX_DOUBLED * pieces)
            | (separators >= 3) & (separators * 4 > pieces) | ((n <= 200) & F.lower(line).rlike(BOILERPLATE)))


def line_cleaned(docs: DataFrame) -> DataFrame:
    """Every row with counts of its words and lines, ``cleaned`` (failing lines removed), ``base_failed`` and ``kept``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines_removed, cleaned, base_failed, kept;
    columns of these names are replaced, names that begin with ``_q`` are dropped, others pass through. Null texts count as
    empty; a text without words fails. Lines without a word are kept as they are and never judged. Whole texts are read: the
    windows that could repeat come from one sort of (hash, place) numbers inside the row, with as many bits for the hash as the
    text's length leaves of 64; those windows are then sorted by their words, and only equal words count. Each row is judged alone, so repeated rows agree and an empty table stays empty.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "cleaned", "base_failed", "kept")
    own = [f"`{c}`" for c in docs.columns if c not in added and not c.startswith("_q")]
    text = whole_text()
    w, v, s = F.col("_q_words"), F.col("_q_windows"), F.col("_q_shift")
    df = docs.select(*own, words_of(text).alias("_q_words"))
    df = df.select(*own, "_q_words", F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.length(F.bin(F.size(w).cast("long"))).alias("_q_shift"))
    window = F.when(F.col("n_words") >= 3, F.expr("sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> shiftleft(xxhash64(get(_q_words, i), get(_q_words, i + 1), get(_q_words, i + 2)), _q_shift) | i))"))
    df = df.select(*own, "_q_words", "n_words", "word_chars", "_q_shift", window.alias("_q_windows"))
    same = "shiftrightunsigned(v ^ get(_q_windows, i {}), _q_shift) = 0"
    repeated = f"filter(_q_windows, (v, i) -> coalesce({same.format('- 1')}, false) or coalesce({same.format('+ 1')}, false))"
    words = "transform({}, v -> transform(array(cast(v & (shiftleft(1L, _q_shift) - 1) AS int)), p -> named_struct('a', get(_q_words, p), 'b', get(_q_words, p + 1), 'c', get(_q_words, p + 2), 'p', p))[0])"
    df = df.select(*own, "n_words", "word_chars", F.expr(f"sort_array({words.format(repeated)})").alias("_q_same"))
    equal = "v.a = get(_q_same, i {0}).a AND v.b = get(_q_same, i {0}).b AND v.c = get(_q_same, i {0}).c"
    exact = f"filter(_q_same, (v, i) -> coalesce({equal.format('- 1')}, false) OR coalesce({equal.format('+ 1')}, false))"
    df = df.select(*own, "n_words", "word_chars", F.expr(f"sort_array(transform({exact}, v -> cast(v.p AS bigint)))").alias("_q_places"))
    covered = "aggregate(_q_places, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(*own, "n_words", "word_chars", F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"), count_matches(text, SYMBOLS).alias("n_symbols"), lines.alias("_q_lines"))
    bad = F.filter(F.split(text, "\n", -1), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~line_fails(x))
    df = df.select(*own, "n_words", "word_chars", "n_symbols", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
                   F.size("_q_lines").alias("_q_n"), bad.alias("_q_good"))
    cleaned = F.array_join("_q_good", "\n")
    df = df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_q_n", "_q_good", cleaned.alias("cleaned"))
    good = F.size(F.filter("_q_good", lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    left = F.length(F.array_join(words_of(F.col("cleaned")), ""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    verdict = (left >= MIN_KEPT * F.col("word_chars")) & (F.col("n_symbols") <= MAX_SYMBOLS * F.col("word_chars"))
    return df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("_q_n") - good).alias("lines_removed"), "cleaned",
                     failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines removed; ``n_chars``, where there is one, follows the text."""
    kept = settled(line_cleaned(docs.select(F.struct("*").alias("row"), "text"))).where("kept")
    return kept.select(*[F.col("cleaned").alias("text") if c == "text" else F.length("cleaned").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def rules_report(docs: DataFrame) -> DataFrame:
    return line_cleaned(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed")
