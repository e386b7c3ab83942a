"""Full cards, dossiers and journeys for every account, phone, device, address, UPI id and name at once.

All of them read one table of postings, which has one row for each entity that an event names. Totals are partial
aggregates; lists keep their first rows per map task before the shuffle (the planner's window group limit), so an
entity that holds a third of all rows sends no more than the list's length from each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.scoring import is_round
from weftline.operators.aggregates import report_amount

#: Turnover above which an entity scores at least ``RAISED``, and the rules of entities without rules of their own.
HIGH_TURNOVER, RAISED = 500_000, 45.0
WIDE_VOLUME, FAN_OUT, SEVERAL_LINES = 100_000, 3, 2
KEY = ["kind", "value"]


def _named(kind: str, value: Column | str, own: bool = True) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(own).alias("own")))


def _link(link: str, target: Column | str) -> Column:
    target = F.col(target) if isinstance(target, str) else target
    return F.when(target.isNotNull() & (target != ""), F.struct(F.lit(link).alias("link"), target.alias("target")))


def _rows(rows: DataFrame, table: str, ident: str, ts: str, label: Column, entities: list[Column], targets: list[Column]) -> DataFrame:
    money = table == "bank"
    none = F.lit(None)
    amounts = [F.col("credit"), F.col("debit"), report_amount()] if money else [none.cast("double")] * 3
    return rows.select(
        F.lit(table).alias("table"), F.col(ident).alias("record_id"), F.col(ts).alias("ts"), label.alias("label"),
        *[a.alias(n) for a, n in zip(amounts, ("credit", "debit", "amount"))],
        (F.col("receiver_account") if money else none.cast("string")).alias("receiver"),
        F.coalesce(F.contains(F.upper("call_type"), F.lit("SMS")), F.lit(False)).alias("sms") if table == "cdr" else F.lit(False).alias("sms"),
        F.array_compact(F.array(*targets)).alias("links"),
        F.explode(F.array_distinct(F.array_compact(F.array(*entities)))).alias("e")).select("e.kind", "e.value", "e.own", "*").drop("e")


def postings(case: Case) -> DataFrame:
    """One row per event and entity it names.

    ``own`` is false where an account only receives or a phone is only called. An event that names an entity twice posts
    once, as its own; events without any entity post nothing, null and empty identifiers name no entity.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pay = _rows(case.bank, "bank", "txn_id", "ts", F.concat_ws(" ", "txn_type", "mode", F.left(text("narration"), F.lit(70))),
                [_named("account", "account_no"), _named("account", F.when(~F.col("receiver_account").eqNullSafe(F.col("account_no")), F.col("receiver_account")), False),
                 _named("phone", "sender_phone"), _named("phone", "receiver_phone"), _named("upi", "upi_id"), _named("name", F.lower("counterparty_name"))],
                [_link("accounts", "account_no"), _link("receivers", "receiver_account"), _link("phones", "sender_phone"), _link("phones", "receiver_phone"),
                 _link("upi_ids", "upi_id"), _link("names", "counterparty_name")])
    call = _rows(case.cdr, "cdr", "cdr_id", "ts", F.concat_ws(" ", "call_type", F.lit("to"), text("b_number"), F.concat(text("duration_sec"), F.lit("s"))),
                 [_named("phone", "a_number"), _named("phone", F.when(~F.col("b_number").eqNullSafe(F.col("a_number")), F.col("b_number")), False), _named("imei", "imei"), _named("imsi", "imsi")],
                 [_link("phones", "a_number"), _link("phones", "b_number"), _link("imeis", "imei"), _link("towers", F.coalesce("cell_id_first", "cell_id_last"))])
    session = _rows(case.ipdr, "ipdr", "ipdr_id", "start_ts", F.concat_ws(" ", F.lit("session"), text("source_ip"), F.lit("to"), text("dest_ip"), F.concat(text("duration_sec"), F.lit("s"))),
                    [_named("phone", "msisdn"), _named("imei", "imei"), _named("imsi", "imsi"), _named("ip", "source_ip")],
                    [_link("phones", "msisdn"), _link("imeis", "imei"), _link("ips", "source_ip")])
    return pay.unionByName(call).unionByName(session)


def first_rows(rows: DataFrame, key: list[str], order: list, most: int, out: str = "n") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(out) <= most)


def linked(posts: DataFrame) -> DataFrame:
    """(kind, value, link, target, n): identifiers that share events with an entity, and the number of these events."""
    pairs = posts.select(*KEY, "table", "record_id", F.explode(F.array_distinct("links")).alias("l")).select(*KEY, "l.link", "l.target")
    same = (F.lower("target") == F.lower("value")) & ((F.col("kind") == "account") & F.col("link").isin("accounts", "receivers") | (F.concat("kind", F.lit("s")) == F.col("link"))
                                                      | (F.col("kind") == "upi") & (F.col("link") == "upi_ids"))
    return pairs.where(~same).groupBy(*KEY, "link", "target").agg(F.count(F.lit(1)).alias("n"))


def link_lists(pairs: DataFrame, most: int, frequent: bool) -> DataFrame:
    """Per entity and link: number of distinct targets and the first of them, by frequency or by name."""
    order = [F.desc("n"), "target"] if frequent else ["target"]
    shown = first_rows(pairs, [*KEY, "link"], order, most, "place").groupBy(*KEY, "link").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("targets"))
    return pairs.groupBy(*KEY, "link").agg(F.count(F.lit(1)).alias("distinct")).join(shown, [*KEY, "link"])


def _side_by_side(lists: DataFrame, links: tuple[str, ...], counts: bool) -> DataFrame:
    pick = lambda link, c: F.first(F.when(F.col("link") == link, F.col(c)), ignorenulls=True)
    return lists.groupBy(*KEY).agg(*[pick(k, "targets").alias(k) for k in links], *([pick(k, "distinct").alias(f"n_{k}") for k in links] if counts else []))


def scores(case: Case) -> DataFrame:
    """(kind, value, score, flags) of accounts and phones by their rules."""
    from weftline.plans.rules import account_heat, phone_heat
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("value"), "score", "flags")
    return part(account_heat(case), "account", "account_no").unionByName(part(phone_heat(case.cdr), "phone", "phone"))


def _complaints(case: Case) -> DataFrame:
    ends = case.complaints.select(F.explode(F.array_distinct(F.array_compact(F.array(_named("account", "account_no"), _named("phone", "mobile"))))).alias("e"))
    return ends.groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("complaints"))


def _join(left: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY, "left"), parts, left)


def _whole(name: str, kind: str = "long") -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


CARD_LINKS = ("accounts", "receivers", "names", "upi_ids", "phones", "imeis", "ips", "towers")


def full_cards(case: Case, posts: DataFrame | None = None, shown: int = 12) -> DataFrame:
    """One card per entity: counts, volumes, activity, rule score, complaints and its most frequent links.

    An account's card counts its own rows; receivers without own rows have no card. A phone's calls are those it made.
    """
    posts = postings(case) if posts is None else posts
    own = posts.where("own")
    pay, call = F.col("table") == "bank", F.col("table") == "cdr"
    core = own.groupBy(*KEY).agg(
        F.count_if(pay).alias("transactions"), F.count_if(call & ~F.col("sms")).alias("calls"), F.count_if(call & F.col("sms")).alias("sms"),
        F.count_if(F.col("table") == "ipdr").alias("ip_sessions"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"),
        F.coalesce(F.round(F.avg("amount"), 2), F.lit(0.0)).alias("avg_amount"), F.coalesce(F.max("amount"), F.lit(0.0)).alias("max_amount"),
        F.count_if(F.coalesce(is_round(F.col("debit")), F.lit(False))).alias("round_amounts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    lists = _side_by_side(link_lists(linked(own), shown, frequent=True), CARD_LINKS, counts=False)
    j = _join(core, lists, scores(case), _complaints(case))
    return j.select(*core.columns, _whole("score", "double"), _list("flags"), _whole("complaints"), *[_list(k) for k in CARD_LINKS])


def card_records(posts: DataFrame, most: int = 15) -> DataFrame:
    """The latest events of every card, newest first; of equal times by table and id. Events without a time come last."""
    rows = posts.where("own").select(*KEY, "table", "record_id", "ts", "label", "amount")
    return first_rows(rows, KEY, [F.desc_nulls_last("ts"), "table", "record_id"], most)


def card_patterns(case: Case, posts: DataFrame, coincidences: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """(kind, value, pattern, hits): suspicious patterns of accounts and phones; loops (accounts array) are optional."""
    from weftline.operators.features import rapid_payouts
    from weftline.operators.links import rapid_in_out, shared_device_phones

    def of(df: DataFrame, kind: str, key: str, pattern: str, hits: Column | None = None) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(key).alias("value")).agg(
            (F.count(F.lit(1)) if hits is None else hits).cast("long").alias("hits")).select(*KEY, F.lit(pattern).alias("pattern"), "hits")

    accounts = case.bank.where("account_no is not null").select("account_no").distinct()
    near = coincidences.where("window_count > 0")
    mixed = posts.where("kind = 'phone'").groupBy(*KEY).agg(F.count_if(F.col("table") == "bank").alias("hits"), F.count_if((F.col("table") == "cdr") & F.col("own")).alias("c"))
    parts = [of(case.complaints.join(accounts, "account_no"), "account", "account_no", "COMPLAINT"),
             of(case.bank.where(is_round(F.col("debit"))), "account", "account_no", "STRUCTURED_PAYOUTS"),
             of(rapid_payouts(case.bank), "account", "account_no", "RAPID_CASH_OUT"),
             of(rapid_in_out(case.bank, limit=None), "account", "account_no", "RAPID_IN_AND_OUT"),
             of(near, "account", "account_no", "CALLS_NEAR_PAYMENTS"),
             of(near, "phone", "phone", "CALLS_NEAR_PAYMENTS", F.sum("window_count")),
             mixed.where("hits > 0 and c > 0").select(*KEY, F.lit("PAYMENTS_AND_CALLS").alias("pattern"), "hits"),
             of(shared_device_phones(case.cdr), "phone", "phone", "SHARED_DEVICE")]
    if loops is not None:
        parts.append(of(loops.select(F.explode("accounts").alias("account_no")), "account", "account_no", "CIRCULAR_FLOW"))
    return reduce(DataFrame.unionByName, parts)


DOSSIER_LINKS = ("receivers", "names", "phones", "imeis", "ips", "upi_ids")


def dossiers(case: Case, posts: DataFrame | None = None, shown: int = 20) -> DataFrame:
    """One dossier per entity: flows, counts, linked identifiers, score, rules.

    An account's inflow holds the credits of all payments that name it, its outflow its own debits; where both are zero,
    and for other entities, the amounts of all payments count as inflow. Entities with a turnover above ``HIGH_TURNOVER`` score at
    least ``RAISED``. Rules are those of the score; entities without any get the rules of volume, fan-out and lines.
    """
    from weftline.functions.scoring import band
    posts = postings(case) if posts is None else posts
    pay, account = F.col("table") == "bank", F.col("kind") == "account"
    zero = F.lit(0.0)
    core = posts.groupBy(*KEY).agg(
        F.count_if(pay).alias("transactions"), F.count_if(F.col("table") == "cdr").alias("calls"), F.count_if(F.col("table") == "ipdr").alias("sessions"),
        F.coalesce(F.sum(F.when(account, F.col("credit"))), zero).alias("credits"), F.coalesce(F.sum(F.when(account & F.col("own"), F.col("debit"))), zero).alias("outflow"),
        F.coalesce(F.sum("amount"), zero).alias("total"), F.coalesce(F.max("amount"), zero).alias("max_amount"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    core = core.withColumn("inflow", F.when((F.col("credits") == 0) & (F.col("outflow") == 0), F.col("total")).otherwise(F.col("credits"))).withColumn("turnover", F.col("inflow") + F.col("outflow"))
    lists = _side_by_side(link_lists(linked(posts), shown, frequent=False), DOSSIER_LINKS, counts=True)
    j = _join(core, lists, scores(case), _complaints(case))
    n = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in DOSSIER_LINKS}
    score = F.coalesce("score", zero)
    score = F.when((F.col("turnover") > HIGH_TURNOVER) & (score < 40), RAISED).otherwise(score)
    own = F.array_compact(F.array(F.when(F.col("turnover") > WIDE_VOLUME, "HIGH_VALUE_VOLUME"), F.when(n["receivers"] >= FAN_OUT, "DISPERSED_PAYOUTS"), F.when(n["phones"] >= SEVERAL_LINES, "SEVERAL_LINES")))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return j.select(
        *KEY, "transactions", "calls", "sessions", "inflow", "outflow", "turnover", F.round(F.col("turnover") / F.greatest("transactions", F.lit(1)), 2).alias("avg_amount"),
        "max_amount", "first_ts", "last_ts", _whole("complaints"), *[_whole(f"n_{k}") for k in DOSSIER_LINKS], (n["receivers"] + n["names"] + n["phones"]).alias("peers"),
        *[_list(k) for k in DOSSIER_LINKS], score.alias("risk_score"), band(score, "evidence").alias("risk_band"), F.when(F.size(flags) > 0, flags).otherwise(own).alias("rules"),
        F.when(n["receivers"] >= FAN_OUT, "DETECTED").otherwise("STANDARD").alias("layering"))


def dossier_receivers(posts: DataFrame, most: int = 15) -> DataFrame:
    """The first receiving accounts of every entity with the sum and number of payments they received."""
    rows = posts.where(F.col("receiver").isNotNull() & (F.col("receiver") != "") & ~((F.col("kind") == "account") & (F.col("receiver") == F.col("value"))))
    totals = rows.groupBy(*KEY, F.col("receiver").alias("receiver_account")).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_received"), F.count(F.lit(1)).alias("payments"))
    return first_rows(totals, KEY, ["receiver_account"], most)


def journeys(posts: DataFrame, most: int = 60) -> DataFrame:
    """The first events of every entity in order of time; of equal times by table and id. Events without a time take no part."""
    rows = posts.where("ts is not null").select(*KEY, "table", "record_id", "ts", F.concat(F.lit("["), F.upper("table"), F.lit("] "), "label").alias("event"))
    return first_rows(rows, KEY, ["ts", "table", "record_id"], most, "step")
