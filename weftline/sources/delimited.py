"""Tolerant reading of delimited provider exports.

Files are read whole so that multi-line quoting and preambles stay intact; a provider export is one
request's answer, so a file is small however many there are, and files spread over the cluster.
Rows become arrays of clean cells numbered within their file; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = ("", "-", "--", "---", "NA", "N/A", "null", "NULL")


def read_texts(spark: SparkSession, path: str | list[str], kinds: tuple[str, ...] = ()) -> DataFrame:
    """(file, text): UTF-8 with or without mark, UTF-16 by its mark, else Latin-1. ``kinds``: extensions to open, all if empty."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if kinds:
        raw = raw.option("pathGlobFilter", "*.{" + ",".join(k for x in kinds for k in (x, x.upper())) + "}")
    raw = raw.load(path)
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 3))
    utf16 = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(c, "UTF-16"))
    utf8 = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    text = F.coalesce(utf16, utf8, F.decode(c, "ISO-8859-1"))
    return raw.select(F.col("path").alias("file"), F.regexp_replace(text, "^﻿", "").alias("text"))


def clean_cell(c: Column) -> Column:
    """Trim, then drop ``="..."``, double- and single-quote wrappers."""
    s = F.trim(c)
    s = F.regexp_replace(s, '^="(.*)"$', "$1")
    s = F.regexp_replace(s, '^"(.*)"$', "$1")
    s = F.regexp_replace(s, "^'(.*)'$", "$1")
    return F.trim(s)


def cells(texts: DataFrame) -> DataFrame:
    """(file, line, cells): the delimiter is the most frequent of tab, semicolon, pipe and comma per file."""
    count = lambda d: F.length("text") - F.length(F.replace("text", F.lit(d)))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate("\t|;,")]))
    body = F.regexp_replace("text", '="', '"')
    lines = F.posexplode(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n"))
    rows = texts.withColumn("d", best["d"]).select("file", "d", lines.alias("line", "raw")).where(F.trim("raw") != "")

    def cut(d: str) -> Column:
        # commas and the like inside double quotes do not separate
        esc = "\\" + d if d == "|" else d
        return F.split("raw", f'{esc}(?=(?:[^"]*"[^"]*")*[^"]*$)')

    parts = F.when(F.col("d") == "\t", cut("\t")).when(F.col("d") == "|", cut("|")).when(F.col("d") == ";", cut(";")).otherwise(cut(","))
    return rows.select("file", "line", F.transform(parts, clean_cell).alias("cells"))


def table(rows: DataFrame, is_header: Column) -> DataFrame:
    """Rows below each file's first header line, as a map from header to cell: (file, line, row)."""
    header = rows.where(is_header).groupBy("file").agg(F.min_by("cells", "line").alias("header"), F.min("line").alias("header_line"))
    j = rows.join(header, "file").where((F.col("line") > F.col("header_line")) & (F.array_join("cells", "") != ""))
    n = F.least(F.size("header"), F.size("cells"))
    entries = F.zip_with(F.slice("header", F.lit(1), n), F.slice("cells", F.lit(1), n), lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    # a repeated header name keeps its last cell
    unique = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, n), lambda o: o["h"] == e["h"]))
    return j.select("file", "line", F.col("cells")[0].alias("first"), F.map_from_entries(unique).alias("row"))


def cell(*names: str) -> Column:
    """First non-empty cell under any of the header names."""
    out = [F.try_element_at("row", F.lit(n)) for n in names]
    return F.coalesce(*[F.when(~v.isin(*EMPTY), v) for v in out])

