"""Personal data: seed entities by pattern, then identifiers found in contexts that the seeds have taught.

DataFrame operations only. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored, whole_text

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Matching starts only where a run of the first class starts or the last match ended, and never gives characters back; both
#: leave the matches as they are and keep the search linear and free of recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: A run that could be an identifier: six characters or more, three of them digits (tested after the match).
CANDIDATE = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{6,}+"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Stands for an earlier span in the words before a later one.
MARK = "<id>"
#: Rounds of scoring, least support of a pattern (distinct values), weight of doubt, and the score from which a pattern discovers.
ROUNDS, SUPPORT, DOUBT, TRUST = 3, 3, 1.0, 0.8


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts double, less nine if above it."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255)
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def spans(kind: int, pattern: str, hint: str, test) -> Column:
    """All matches of a pattern in ``text``: the texts between matches give their places."""
    gaps, found = f"split(text, r'{pattern}', -1)", f"regexp_extract_all(text, r'{pattern}', 0)"
    ends = (f"aggregate({{found}}, named_struct('at', 0, 'out', cast(array() AS array<struct<at:int,value:string>>)), "
            f"(a, v) -> named_struct('at', a.at + length(get({{gaps}}, size(a.out))) + length(v), 'out', concat(a.out, array(named_struct("
            f"'at', a.at + length(get({{gaps}}, size(a.out))), 'value', v)))), a -> a.out)")
    both = f"transform(array(named_struct('g', {gaps}, 'f', {found})), b -> {ends.format(found='b.f', gaps='b.g')})[0]"
    rows = F.filter(F.expr(both), lambda s: test(s["value"]))
    made = F.transform(rows, lambda s: F.struct(s["at"].alias("start"), F.lit(kind).alias("kind"), (s["at"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))
    there = F.col("text").contains(hint) if hint == "@" else F.col("text").rlike(hint)
    return F.when(there, made).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans() -> Column:
    """Seed spans of all kinds in ``text``, ordered by start, then kind."""
    return F.array_sort(F.concat(*[spans(k, PATTERNS[n], HINTS[n], lambda v, n=n: valid(n, v)) for k, n in enumerate(KINDS)]))


def with_words(entries: str) -> Column:
    """The sorted spans in column ``entries``, each with ``before``: the last two words of the whole text before it.

    Earlier spans, overlapping ones as a group, stand there as ``MARK``, a word of its own; runs that are no spans stay. Only two
    words are carried from span to span, so a gap is read once, however many spans follow. ``base`` begins the latest group of
    overlapping spans, ``at`` ends it and ``pre`` has the words before it.
    """
    last = lambda x: f"reverse(regexp_extract(reverse({x}), r'^\\s*+(?:\\S++(?:\\s++\\S*+)?+)?+', 0))"
    lead = (f"CASE WHEN s.start < a.at THEN concat(a.pre, substring(text, a.base + 1, s.start - a.base)) "
            f"ELSE concat(a.pre, IF(a.at > 0, ' {MARK} ', ''), substring(text, a.at + 1, s.start - a.at)) END")
    step = (f"transform(array({last(lead)}), w -> named_struct('at', greatest(a.at, s.end), 'base', IF(s.start < a.at, a.base, s.start), 'pre', IF(s.start < a.at, a.pre, w), "
            f"'out', concat(a.out, array(named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'value', s.value, 'before', w)))))[0]")
    none = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string,before:string>>)"
    return F.expr(f"aggregate({entries}, named_struct('at', 0, 'base', 0, 'pre', '', 'out', {none}), (a, s) -> {step}, a -> a.out)")


def contexts(before: Column) -> Column:
    """Lexical pattern of the text before a span: its last two words in lower case, digits as 0; null if there are fewer."""
    words = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, others): seed spans, and other runs that could be identifiers and touch no seed."""
    df = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), base_spans().alias("base"))
    loose = spans(len(KINDS), CANDIDATE, "[0-9]", lambda v: F.length(digits(v)) >= 3)
    apart = F.filter(loose, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = df.select("doc_id", "text_hash", "text", F.array_sort(F.concat("base", apart)).alias("every")).select("doc_id", "text_hash", with_words("every").alias("every"))
    keep = lambda test: F.transform(F.filter("every", lambda s: test(s["kind"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("value"), contexts(s["before"]).alias("pattern")))
    return df.select("doc_id", "text_hash", keep(lambda k: k < len(KINDS)).alias("base"), keep(lambda k: k == len(KINDS)).alias("others"))


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score): contexts whose values are believed to be of one kind.

    A bipartite graph joins patterns to the distinct values seen after them. Seeds believe with 1. Each round a pattern's score
    for a kind is the summed belief of its values over their number plus ``DOUBT``, and a value's belief is one minus the product
    of its patterns' doubts, raised only by patterns with ``SUPPORT`` values or more. Edges are aggregated before every join, so
    copies of a text weigh once and a hot pattern or value is summed map-side.
    """
    every = found.select(F.explode(F.concat("base", "others")).alias("s")).where("s.pattern IS NOT NULL")
    edges = stored(every.groupBy(F.col("s.pattern").alias("pattern"), F.col("s.value").alias("value")).agg(F.min("s.kind").alias("kind")))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    seeds = edges.where(F.col("kind") < len(KINDS)).select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    graph = edges.join(size, "pattern").select("pattern", "value", "n")
    belief, score = seeds, None
    for _ in range(rounds):
        score = stored(graph.join(belief, "value").groupBy("pattern", "kind", "n").agg(F.sum("belief").alias("sum"))
                       .select("pattern", "kind", (F.col("sum") / (F.col("n") + DOUBT)).alias("score")).where("score > 0.1"))
        raised = graph.join(score, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("belief"))
        belief = raised.unionByName(seeds).groupBy("value", "kind").agg(F.max("belief").alias("belief"))
    best = score.where(F.col("score") >= TRUST).groupBy("pattern").agg(F.max(F.struct("score", -F.col("kind"), "kind")).alias("b"))
    return best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, more): spans that no seed pattern matches but that stand in a trusted context, of that context's kind."""
    others = found.where(F.size("others") > 0).select("doc_id", "text_hash", F.explode("others").alias("s")).where("s.pattern IS NOT NULL").select("doc_id", "text_hash", F.col("s.pattern").alias("pattern"), "s.start", "s.end")
    hits = others.join(trusted_patterns(found), "pattern").select("doc_id", "text_hash", F.struct(F.col("start"), F.col("kind"), F.col("end")).alias("span"))
    return hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("more"))


def listed(entries: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(entries), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans), one row for each row of ``docs``; entries are (start, kind, end).

    Null texts count as empty and have no spans; identical rows agree; an empty table gives no rows; extra columns are ignored.
    """
    found = stored(found_spans(docs))
    more = discovered(found).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.select("doc_id", "text_hash", plain.alias("base")).join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; overlapping spans merge under the first one's kind.

    Seeds are matched again in place; only discovered spans, which are few, are joined in. ``n_chars`` follows the text.
    """
    found = stored(found_spans(docs))
    more = stored(discovered(found)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    plain = F.transform(base_spans(), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(whole_text()).alias("_own")).join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    df = df.select("row", "text", F.array_sort(F.concat(F.coalesce(plain, F.array().cast("array<struct<start:int,kind:int,end:int>>")), F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("_spans"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    pieces = (f"aggregate(_spans, named_struct('at', 0, 'out', cast(array() AS array<string>)), (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', "
              f"concat(a.out, array(substring(text, a.at + 1, s.start - a.at), {names}[s.kind]))) ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END, "
              f"a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))")
    text = F.when(F.size("_spans") > 0, F.expr(pieces)).otherwise(F.col("text"))
    df = df.select("row", text.alias("_text"))
    return df.select(*[F.col("_text").alias("text") if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def personal_report(docs: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return all_spans(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
