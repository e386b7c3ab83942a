"""Evidence for free-text requests: postings of all record tables, bounded lists per hint, and a snippet for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.hints import MODES, PLACES, hints

#: Rows for an identifier in a table (fewer for subscribers and complaints), for an attribute, and for a request.
PER_IDENTIFIER, PER_PERSON, PER_ATTRIBUTE, PER_REQUEST = 3, 2, 5, 8
TABLES = ("bank", "cdr", "ipdr", "subscriber", "complaint")
#: Hints in the order in which their rows are listed.
IDENTIFIERS = ("phone", "txn", "cdr", "ipdr", "account", "imei", "ip")
STEPS = (*IDENTIFIERS, "amount", "mode", "location", "candidate", "general")
# Words of general requests, tried in this order, and the table whose largest rows answer them.
INTENTS = ((("largest", "top", "highest", "biggest", "high value", "large"), "bank"), (("call", "cdr", "phone", "telecom"), "cdr"), (("ip", "internet", "ipdr", "session"), "ipdr"),
           (("complaint", "ncrp", "fraud account"), "complaint"),
           (("all", "summary", "overview", "list", "show", "recent", "suspicious", "anomal", "flagged", "mule", "layering", "fraud"), "bank"))


def _step(name: str) -> Column:
    return F.lit(STEPS.index(name)).alias("step")


def _table(name: str) -> Column:
    return F.lit(TABLES.index(name)).alias("table_no")


def postings(case: Case, legs: DataFrame) -> DataFrame:
    """(kind, value, table_no, id): each identifier of each record, the inverted index of the case."""

    def side(df: DataFrame, table: str, rid: str, kind: str, *cols: str, short: bool = False) -> DataFrame:
        value = F.explode(F.array_distinct(F.array_compact(F.array(*[F.right(c, F.lit(10)) if short else F.col(c) for c in cols]))))
        return df.select(F.lit(kind).alias("kind"), value.alias("value"), _table(table), F.col(rid).alias("id"))

    sides = [side(legs, "bank", "txn_id", "phone", "sender_phone", "receiver_phone", short=True), side(case.cdr, "cdr", "cdr_id", "phone", "a_number", "b_number", short=True),
             side(case.ipdr, "ipdr", "ipdr_id", "phone", "msisdn", short=True), side(case.subscribers, "subscriber", "sub_id", "phone", "msisdn", short=True),
             side(legs, "bank", "txn_id", "txn", "txn_id"), side(case.cdr, "cdr", "cdr_id", "cdr", "cdr_id"), side(case.ipdr, "ipdr", "ipdr_id", "ipdr", "ipdr_id"),
             side(legs, "bank", "txn_id", "account", "sender_account", "receiver_account"), side(case.complaints, "complaint", "complaint_id", "account", "account_no"),
             side(case.ipdr, "ipdr", "ipdr_id", "imei", "imei"), side(case.ipdr, "ipdr", "ipdr_id", "ip", "source_ip", "dest_ip")]
    return reduce(DataFrame.unionByName, sides)


def _largest(legs: DataFrame, case: Case, table: str, most: int) -> DataFrame:
    """(table_no, id, rank, amount) of the largest rows of a table; complaints have no size and go by id."""
    source, rid, size = {"bank": (legs, "txn_id", F.col("amount")), "cdr": (case.cdr, "cdr_id", F.coalesce("duration_sec", F.lit(0))),
                         "ipdr": (case.ipdr, "ipdr_id", F.coalesce("duration_sec", F.lit(0))), "complaint": (case.complaints, "complaint_id", F.lit(0))}[table]
    few = source.select(F.col(rid).alias("id"), size.cast("double").alias("amount")).orderBy(F.desc("amount"), "id").limit(most)
    ordered = F.row_number().over(Window.orderBy(F.desc("amount"), "id"))
    return few.select(_table(table), "id", ordered.alias("rank"), "amount")


def hits(requests: DataFrame, case: Case, legs: DataFrame) -> DataFrame:
    """(request_id, step, at, table_no, rank, id): rows that answer each hint of each request, before the request's own cut.

    The rows of an identifier, mode or place are ranked before they meet the requests, and only those somebody asked for; rank limits
    work map-side, so a hot phone passes on a handful of rows from each task. The largest payments are a list of five.
    """
    h = hints(F.col("text"))
    asked = requests.select("request_id", "text", *[h[k].alias(k) for k in (*IDENTIFIERS, "mode", "location", "amount", "candidate")])
    each = [asked.select("request_id", _step(k), F.posexplode(k).alias("at", "value"), F.lit(k).alias("kind")) for k in (*IDENTIFIERS, "mode", "location")]
    named = reduce(DataFrame.unionByName, each)
    wanted = named.select("kind", "value").distinct()

    known = postings(case, legs).join(wanted, ["kind", "value"]).distinct()
    person = F.col("table_no").isin(TABLES.index("subscriber"), TABLES.index("complaint"))
    of_value = Window.partitionBy("kind", "value", "table_no").orderBy("id")
    known = known.withColumn("rank", F.row_number().over(of_value)).where(F.col("rank") <= PER_IDENTIFIER).where(~person | (F.col("rank") <= PER_PERSON))
    by_mode = Window.partitionBy("value").orderBy(F.desc("amount"), "id")
    modes = legs.select(F.upper("mode").alias("value"), F.col("txn_id").alias("id"), "amount").where(F.col("value").isin(*MODES))
    modes = modes.withColumn("rank", F.row_number().over(by_mode)).where(F.col("rank") <= PER_ATTRIBUTE).select(F.lit("mode").alias("kind"), "value", _table("bank"), "id", "rank")
    where = F.lower(F.concat_ws("\n", "bts_location_first", "roaming_circle"))
    placed = case.cdr.select(F.col("cdr_id").alias("id"), F.explode(F.array_compact(F.array(*[F.when(F.contains(where, F.lit(p.replace(" ", ""))), F.lit(p)) for p in PLACES]))).alias("value"))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy("id"))).where(F.col("rank") <= PER_ATTRIBUTE)
    found = known.unionByName(modes).unionByName(placed.select(F.lit("location").alias("kind"), "value", _table("cdr"), "id", "rank"))
    columns = ("request_id", "step", "at", "table_no", "rank", "id")
    first = named.join(found, ["kind", "value"]).select(*columns)
    # payments of at least the largest amount named, largest first, are among the largest of all
    floor = asked.select("request_id", F.array_max("amount").alias("least")).where("least IS NOT NULL")
    rich = floor.join(_largest(legs, case, "bank", PER_ATTRIBUTE), F.col("amount") >= F.col("least"))
    first = first.unionByName(rich.select("request_id", _step("amount"), F.lit(0).alias("at"), "table_no", "rank", "id"))

    silent = asked.join(first.select("request_id").distinct(), "request_id", "left_anti")
    ids = reduce(DataFrame.unionByName, [df.select(F.lower(rid).alias("value"), _table(t), F.col(rid).alias("id")) for df, t, rid in ((legs, "bank", "txn_id"), (case.cdr, "cdr", "cdr_id"), (case.ipdr, "ipdr", "ipdr_id"))])
    guess = silent.select("request_id", F.lower("candidate").alias("value")).join(ids, "value").distinct()
    guess = guess.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "table_no").orderBy("id"))).where(F.col("rank") <= PER_IDENTIFIER)
    guess = guess.select("request_id", _step("candidate"), F.lit(0).alias("at"), "table_no", "rank", "id")

    said = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(w)) for w in words])
    intent = F.coalesce(*[F.when(said(words), F.lit(TABLES.index(table))) for words, table in INTENTS])
    general = silent.join(guess.select("request_id").distinct(), "request_id", "left_anti").select("request_id", intent.alias("table_no"))
    lists = reduce(DataFrame.unionByName, [_largest(legs, case, t, PER_REQUEST) for t in ("bank", "cdr", "ipdr", "complaint")])
    broad = general.join(lists, "table_no").select("request_id", _step("general"), F.lit(0).alias("at"), "table_no", "rank", "id")
    return first.unionByName(guess).unionByName(broad)


def snippets(case: Case, legs: DataFrame) -> DataFrame:
    """(table_no, id, snippet) of every record: one line of its main fields."""
    blank, none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def line(df: DataFrame, table: str, rid: str, *parts: Column | str) -> DataFrame:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return df.select(_table(table), F.col(rid).alias("id"), F.trim(text).alias("snippet"))

    money = F.coalesce(F.concat(F.lit(" ₹"), F.format_number("amount", 0)), F.lit(""))
    return reduce(DataFrame.unionByName, [
        line(legs, "bank", "txn_id", F.col("txn_id"), money, " ", blank("mode"), " ", blank("date"), " ", blank("timestamp"), " from=", none("sender_account"), " (", blank("sender_name"), ") to=",
             none("receiver_account"), " (", blank("receiver_name"), ")"),
        line(case.cdr, "cdr", "cdr_id", F.col("cdr_id"), " ", none("date"), " ", none("time"), " ", blank("call_type"), " ", F.coalesce("duration_sec", F.lit(0)).cast("string"), "s ", none("a_number"), " -> ",
             none("b_number"), " tower=", blank("bts_location_first"), " circle=", blank("roaming_circle")),
        line(case.ipdr, "ipdr", "ipdr_id", F.col("ipdr_id"), " ", none("date"), " ", none("start_time"), " msisdn=", none("msisdn"), " imei=", none("imei"), " ", none("source_ip"), " -> ", none("dest_ip"),
             " port=", blank("dest_port"), " ", F.coalesce("duration_sec", F.lit(0)).cast("string"), "s"),
        line(case.subscribers, "subscriber", "sub_id", "subscriber ", none("subscriber_name"), " circle=", none("circle"), " imsi=", none("imsi"), " imei=", none("imei")),
        line(case.complaints, "complaint", "complaint_id", "NCRP complaint ", F.col("complaint_id"), " acc=", none("account_no"), " state=", none("state"), " ", none("complainant_name"))])


def _padded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def retrieve(requests: DataFrame, case: Case, legs: DataFrame, top_k: int = PER_REQUEST) -> DataFrame:
    """(request_id, pos, table, id, found_by, snippet): at most ``top_k`` rows for each request (request_id, text).

    Rows come in the order of the hints, of the values in the text and of the tables; a row found twice counts once, at its first
    place. A request without any hit tries the identifier-like word, then the largest rows of the table that it speaks of.
    """
    case = Case(case.bank, _padded(case.cdr, "bts_location_first", "roaming_circle"), _padded(case.ipdr, "dest_ip", "dest_port"), _padded(case.complaints, "complainant_name", "state"),
                _padded(case.subscribers, "subscriber_name", "circle"))
    order = F.struct("step", "at", "table_no", "rank")
    once = hits(requests, case, legs).groupBy("request_id", "table_no", "id").agg(F.min(order).alias("o"))
    top = once.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy("o", "id"))).where(F.col("pos") <= top_k)
    named = F.element_at(F.array(*map(F.lit, TABLES)), F.col("table_no") + 1)
    by = F.element_at(F.array(*map(F.lit, STEPS)), F.col("o.step") + 1)
    return top.join(snippets(case, legs), ["table_no", "id"]).select("request_id", "pos", named.alias("table"), "id", by.alias("found_by"), "snippet")
