"""Order MinHash: document fingerprints whose likeness falls with edits and with moved text, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import ranged, stored, whole_text

#: Words to a k-mer, slots of a fingerprint (a power of two), k-mers in a slot's tuple.
K, SLOTS, TUPLE = 2, 32, 2
#: A longer run without white space is read in pieces of so many characters, so that text without spaces has k-mers too.
RUN = 12


def fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add for each ``{result: text column}`` the fingerprint as an array of longs, at most one for each slot.

    Each k-mer carries the number of its earlier occurrences in the text. A hash of both deals it to a slot (top bits);
    the slot keeps its ``TUPLE`` smallest, in the order in which they stand in the text, and hashes that tuple. A slot with
    fewer k-mers hashes what it has; a slot with none has no entry. A text shorter than a k-mer is one k-mer; an empty or
    null text has no entries. Hash and place share one long, so sorting is on plain numbers: places take as many low bits
    as the text needs. Temporary columns begin with ``_o``.
    """
    bits = SLOTS.bit_length() - 1
    own = [f"`{c}`" for c in df.columns]
    names = list(texts)
    df = df.select(*own, *[F.regexp_extract_all(F.coalesce(F.col(f"`{t}`"), F.lit("")), F.lit(r"[^\s]{1," + str(RUN) + "}"), F.lit(0)).alias(f"_o_words_{r}") for r, t in texts.items()])

    def every(*made) -> DataFrame:
        return df.select(*own, *[c.alias(f"{stem}_{r}") for stem, make in made for r in names for c in [make(r)]])

    def kmers(r: str) -> Column:
        w, n = f"_o_words_{r}", f"size(_o_words_{r})"
        parts = ", ".join(f"get({w}, i + {j})" for j in range(K))
        return F.expr(f"CASE WHEN {n} = 0 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, greatest({n} - {K}, 0)), i -> xxhash64({parts})) END")

    def shift(r: str) -> Column:
        return F.expr(f"length(bin(cast(size(_o_words_{r}) AS bigint)))")

    df = every(("_o_hash", kmers), ("_o_shift", shift))
    df = every(("_o_sorted", lambda r: F.expr(f"sort_array(transform(_o_hash_{r}, (h, i) -> shiftleft(h, _o_shift_{r}) | i))")), ("_o_shift", lambda r: F.col(f"_o_shift_{r}")))

    def numbered(r: str) -> Column:
        """Equal k-mers stand side by side; how far back the run reaches is found by halving steps."""
        same = f"shiftrightunsigned(v ^ get(_o_sorted_{r}, {{}}), _o_shift_{r}) = 0"
        steps = f"transform(sequence(0, length(bin(cast(i AS bigint))) - 1), e -> cast(shiftleft(1, length(bin(cast(i AS bigint))) - 1 - e) AS int))"
        back = f"aggregate({steps}, 0, (d, s) -> CASE WHEN d + s <= i AND {same.format('i - d - s')} THEN d + s ELSE d END)"
        occurrence = f"CASE WHEN i > 0 AND {same.format('i - 1')} THEN {back} ELSE 0 END"
        return F.expr(f"sort_array(transform(_o_sorted_{r}, (v, i) -> shiftleft(shiftrightunsigned(xxhash64(shiftrightunsigned(v, _o_shift_{r}), {occurrence}), _o_shift_{r}), _o_shift_{r})"
                      f" | (v & (shiftleft(1L, _o_shift_{r}) - 1))))")

    df = every(("_o_ranked", numbered), ("_o_shift", lambda r: F.col(f"_o_shift_{r}")))
    slot = f"shiftrightunsigned({{}}, {64 - bits})"
    differs = f"{slot.format('v')} != {slot.format('get(_o_ranked_{r}, i - {back})')}"
    df = every(("_o_least", lambda r: F.expr(f"filter(_o_ranked_{r}, (v, i) -> i < {TUPLE} OR {differs.format(r=r, back=TUPLE)})")), ("_o_shift", lambda r: F.col(f"_o_shift_{r}")))

    def tuples(r: str) -> Column:
        v, place, key = f"_o_least_{r}", f"x & (shiftleft(1L, _o_shift_{r}) - 1)", f"shiftrightunsigned(x, _o_shift_{r})"
        here = slot.format(f"get({v}, i)")
        firsts = f"filter(sequence(0, size({v}) - 1), i -> i = 0 OR {here} != {slot.format(f'get({v}, i - 1)')})"
        members = f"filter(slice({v}, i + 1, {TUPLE}), x -> {slot.format('x')} = {here})"
        ordered = f"array_sort(transform({members}, x -> named_struct('place', {place}, 'key', {key})))"
        code = f"aggregate({ordered}, 42L, (a, m) -> xxhash64(a, m.key))"
        return F.expr(f"CASE WHEN size({v}) = 0 THEN cast(array() AS array<bigint>) ELSE transform({firsts}, i -> shiftleft({here}, 27) | shiftrightunsigned({code}, 37)) END")

    df = every(("_o_out", tuples))
    return df.select(*own, *[F.col(f"_o_out_{r}").alias(r) for r in names])


def likeness(a: str, b: str) -> Column:
    """Share of equal entries among the slots that either fingerprint fills; 1 for two empty texts."""
    both = f"size(array_intersect({a}, {b}))"
    slots = f"size(array_union(transform({a}, x -> shiftright(x, 27)), transform({b}, x -> shiftright(x, 27))))"
    return F.expr(f"CASE WHEN {slots} = 0 THEN 1.0D ELSE cast({both} AS double) / {slots} END")


def written(entries: str) -> Column:
    """Eight hex digits for each entry."""
    return F.expr(f"lower(array_join(transform({entries}, x -> lpad(hex(x), 8, '0')), ''))")


def following(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text): the one before and the one after it in descending order of doc_id, as a ring.

    Ties of doc_id go by text hash; a null doc_id comes last; identical rows count once. Only keys and lengths move.
    """
    keys = docs.groupBy("doc_id", "text_hash").agg(F.max("n_chars").alias("n_chars"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash")]
    parts = ranged(keys, *order)
    me = F.struct("doc_id", "text_hash", "n_chars")
    ends = parts.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "text_hash", me.alias("k"))).alias("first"), F.max(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "text_hash", me.alias("k"))).alias("last"))
    over, whole = Window.orderBy("_range"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_range", F.coalesce(F.lead("first.k").over(over), F.first("first.k").over(whole)).alias("_after"), F.coalesce(F.lag("last.k").over(over), F.last("last.k").over(whole)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    near = parts.select("*", F.lead(me).over(inside).alias("_next"), F.lag(me).over(inside).alias("_prev")).join(ends, "_range")
    return near.select("doc_id", "text_hash", F.coalesce("_next", "_after").alias("next"), F.coalesce("_prev", "_before").alias("prev"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_chars, text, edited, next): the edited text takes its second half from the next document."""
    rows = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    light = stored(rows.select("doc_id", "text_hash", F.length("text").cast("long").alias("n_chars")))
    ring = stored(following(light))
    here = rows.join(ring, rows["doc_id"].eqNullSafe(ring["doc_id"]) & (rows["text_hash"] == ring["text_hash"])).select(rows["doc_id"], rows["text_hash"], "text", "next", "prev")
    half = F.floor(F.col("prev.n_chars") / 2).cast("int")
    given = here.select(F.col("prev.doc_id").alias("to_id"), F.col("prev.text_hash").alias("to_hash"), F.substring("text", F.lit(1), half).alias("given"))
    given = given.groupBy("to_id", "to_hash").agg(F.max("given").alias("given"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "given")
    both = here.join(given, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash")))
    return both.select("doc_id", "text_hash", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.doc_id").alias("next_id"), F.col("next.text_hash").alias("next_hash"))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Every row with ``fingerprint`` (replaced if there); nulls, empty and repeated rows as in ``fingerprints``."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("fingerprint", "entries")]
    return fingerprints(docs.select(*kept), {"entries": "text"}).select(*kept, written("entries").alias("fingerprint"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and likeness to the edited and to the next text.

    Null texts are empty; identical rows give identical result rows; an empty table gives no rows; extra columns are ignored.
    """
    made = fingerprints(edited_and_next(docs), {"own": "text", "changed": "edited"})
    found = stored(made.select("doc_id", "text_hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed", "next_id", "next_hash"))
    other = found.groupBy(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash")).agg(F.max("own").alias("other"))
    joined = found.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_hash") == F.col("o_hash")))
    return joined.select("doc_id", "n_chars", "edited_sha256", written("own").alias("fingerprint"), written("changed").alias("edited_fingerprint"),
                         likeness("own", "changed").alias("near_edited"), likeness("own", "other").alias("near_next"))
