"""Parts of a case for all alerted payments in one pass: sequence of funds, network, telecom of the day, data quality.

Alerts carry ``txn_id``. Lists are cut to their length per account or per phone and day before alerts join them, so an
account with many payments and many alerts meets them with a bounded list, never with its whole ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import ist_day
from weftline.operators.links import any_amount, both_ends
from weftline.operators.ordering import with_scalars
from weftline.plans.dossier import first_rows


def _side(bank: DataFrame, amount: str, most: int) -> DataFrame:
    """First credits or debits of every account by date and time, with their running sum and the account's number of them.

    Missing dates and times come first, equal times are ordered by id.
    """
    rows = bank.where((F.col(amount) > 0) & F.col("account_no").isNotNull()).select(
        "account_no", F.col("txn_id").alias("entry"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("time", F.lit("")).alias("time"),
        F.col(amount).alias("amount"), F.coalesce("counterparty_name", "receiver_account", F.lit("Unknown")).alias("entity"))
    shown = first_rows(rows, ["account_no"], ["date", "time", "entry"], most, "place").groupBy("account_no").agg(
        F.sort_array(F.collect_list(F.struct("place", "entry", "date", "time", "amount", "entity"))).alias("entries"))
    totals = rows.groupBy("account_no").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return totals.join(shown, "account_no")


def _steps(entries: Column, direction: str, before: Column, start: Column, sign: int) -> Column:
    """Entries as steps of a sequence that begins after ``before`` steps with the balance ``start``."""
    def step(e: Column) -> Column:
        upto = F.filter(entries, lambda x: x["place"] <= e["place"])
        moved = F.aggregate(upto, F.lit(0.0), lambda acc, x: acc + x["amount"])
        return F.struct((before + e["place"]).cast("int").alias("step"), F.lit(direction).alias("direction"), e["entry"].alias("entry"), F.trim(F.concat_ws(" ", e["date"], e["time"])).alias("at"),
                        e["amount"].alias("amount"), e["entity"].alias("entity"), (start + sign * moved).alias("balance"))
    return F.transform(entries, step)


def fund_sequence(bank: DataFrame, alerts: DataFrame, most: int = 30) -> DataFrame:
    """(txn_id, step, direction, entry, at, amount, entity, balance): inflows, the alerted payment, onward outflows.

    Inflows are the account's credits, outflows the debits of the receiver's own account, both over the whole ledger and in
    order of time; the first ``most`` steps are returned. ``balance`` is what came in so far less what went out.
    """
    into = _side(bank, "credit", most).select("account_no", F.col("entries").alias("ins"), F.col("n").alias("n_in"), F.col("total").alias("in_total"))
    out = _side(bank, "debit", most).select(F.col("account_no").alias("receiver_account"), F.col("entries").alias("outs"))
    j = (bank.join(alerts.select("txn_id").distinct(), "txn_id").select("txn_id", "account_no", "receiver_account", any_amount().alias("amount"), "date", "time")
         .join(into, "account_no", "left").join(out, "receiver_account", "left"))
    empty = F.array().cast("array<struct<place:int,entry:string,date:string,time:string,amount:double,entity:string>>")
    ins, outs = F.coalesce("ins", empty), F.coalesce("outs", empty)
    n, total = F.coalesce("n_in", F.lit(0)), F.coalesce("in_total", F.lit(0.0))
    nil = lambda c: F.coalesce(F.col(c), F.lit(""))
    left = total - F.coalesce("amount", F.lit(0.0))
    own = F.array(F.struct((n + 1).cast("int").alias("step"), F.lit("ALERT").alias("direction"), F.col("txn_id").alias("entry"), F.trim(F.concat_ws(" ", nil("date"), nil("time"))).alias("at"),
                           F.col("amount"), F.concat(nil("account_no"), F.lit(" > "), nil("receiver_account")).alias("entity"), left.alias("balance")))
    steps = F.concat(_steps(ins, "INFLOW", F.lit(0), F.lit(0.0), 1), own, _steps(outs, "OUTFLOW", n + 1, left, -1))
    return j.select("txn_id", F.explode(F.filter(steps, lambda s: s["step"] <= most)).alias("s")).select("txn_id", "s.*")


def alert_network(bank: DataFrame, alerts: DataFrame, most: int = 20) -> DataFrame:
    """Accounts and names one payment away from the alerted account: their number, those that pay it, the first of them by name."""
    paid = bank.where("account_no is not null").select("account_no", F.coalesce("receiver_account", "counterparty_name").alias("other"), F.lit(False).alias("pays"))
    payer = bank.where("receiver_account is not null").select(F.col("receiver_account").alias("account_no"), F.col("account_no").alias("other"), F.lit(True).alias("pays"))
    ties = paid.unionByName(payer).where("other is not null and other <> ''").groupBy("account_no", "other").agg(F.max("pays").alias("pays"))
    counts = ties.groupBy("account_no").agg(F.count(F.lit(1)).alias("connected"), F.count_if("pays").alias("payers"))
    shown = first_rows(ties.select("account_no", "other"), ["account_no"], ["other"], most).groupBy("account_no").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    mine = bank.join(alerts.select("txn_id").distinct(), "txn_id").select("txn_id", "account_no")
    return mine.join(counts, "account_no", "left").join(shown, "account_no", "left").select(
        "txn_id", "account_no", F.coalesce("connected", F.lit(0)).alias("connected"), F.coalesce("payers", F.lit(0)).alias("payers"),
        F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def _of_day(rows: DataFrame, ident: str, most: int, out: str) -> DataFrame:
    counts = rows.groupBy("phone", "day").agg(F.count(F.lit(1)).alias(f"n_{out}"))
    shown = first_rows(rows, ["phone", "day"], ["ts", ident], most).groupBy("phone", "day").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", ident))), lambda x: x[ident]).alias(out))
    return counts.join(shown, ["phone", "day"])


def _shared(use: DataFrame, member: str, most: int) -> DataFrame:
    """Devices or addresses that several phones use: per phone their number and the first of them."""
    pairs = use.where(F.col(member).isNotNull() & (F.col(member) != "") & F.col("phone").isNotNull()).select(member, "phone").distinct()
    several = pairs.groupBy(member).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    mine = pairs.join(several, member).select("phone", member)
    shown = first_rows(mine, ["phone"], [member], most).groupBy("phone").agg(F.sort_array(F.collect_list(member)).alias("first"))
    return mine.groupBy("phone").agg(F.count(F.lit(1)).alias("n")).join(shown, "phone")


def telecom_of_day(case: Case, alerts: DataFrame, calls: int = 20, sessions: int = 15, shared: int = 20) -> DataFrame:
    """Calls and sessions of the payment's phone on its day, and the devices and addresses that phone shares with others.

    The phone is the sender's, else the receiver's. Payments without a phone or a time have none of them.
    """
    mine = bank_rows(case, alerts).select("txn_id", F.coalesce("sender_phone", "receiver_phone").alias("phone"), ist_day(F.col("ts")).alias("day"))
    ends = both_ends(case.cdr.where("ts is not null"), "cdr_id", "ts").dropDuplicates(["cdr_id", "phone"])
    call = _of_day(ends.select("phone", ist_day(F.col("ts")).alias("day"), "ts", "cdr_id"), "cdr_id", calls, "calls")
    rows = case.ipdr.where("msisdn is not null")
    sess = _of_day(rows.where("start_ts is not null").select(F.col("msisdn").alias("phone"), ist_day(F.col("start_ts")).alias("day"), F.col("start_ts").alias("ts"), "ipdr_id"), "ipdr_id", sessions, "sessions")
    use = rows.select(F.col("msisdn").alias("phone"), "imei", "source_ip")
    devices = _shared(use, "imei", shared).toDF("phone", "n_devices", "devices")
    ips = _shared(use, "source_ip", shared).toDF("phone", "n_addresses", "addresses")
    j = mine.join(call, ["phone", "day"], "left").join(sess, ["phone", "day"], "left").join(devices, "phone", "left").join(ips, "phone", "left")
    none = F.array().cast("array<string>")
    parts = ("calls", "sessions", "devices", "addresses")
    return j.select("txn_id", "phone", *[F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}") for p in parts], *[F.coalesce(p, none).alias(p) for p in parts])


def bank_rows(case: Case, alerts: DataFrame) -> DataFrame:
    return case.bank.join(alerts.select("txn_id").distinct(), "txn_id")


def data_quality(case: Case, alerts: DataFrame) -> DataFrame:
    """Records of each source and what is missing, per alerted payment."""
    j = bank_rows(case, alerts).select("txn_id", "account_name", "customer_id", "receiver_account")
    for name, df in (("bank", case.bank), ("cdr", case.cdr), ("ipdr", case.ipdr), ("complaint", case.complaints)):
        j = with_scalars(j, df.agg(F.count(F.lit(1)).alias("n")), f"s_{name}").withColumn(f"{name}_records", F.col(f"s_{name}.n")).drop(f"s_{name}")
    missing = F.array_compact(F.array(
        F.when(F.col("cdr_records") == 0, "call records"), F.when(F.col("ipdr_records") == 0, "data sessions"), F.when(F.col("complaint_records") == 0, "complaint ledger"),
        F.when(F.coalesce("account_name", "customer_id").isNull(), "customer identity"), F.when(F.coalesce("receiver_account", F.lit("")) == "", "receiver account")))
    return j.select("txn_id", "bank_records", "cdr_records", "ipdr_records", "complaint_records", missing.alias("missing"))


def whole_case(case: Case, alerts: DataFrame) -> DataFrame:
    """Evidence, network, telecom and data quality of every alert (``transaction_id``, ``risk_score``), one row each."""
    from weftline.plans.evidence import case_evidence
    ids = alerts.select(F.col("transaction_id").alias("txn_id"))
    j = case_evidence(case, alerts)
    for part in (alert_network(case.bank, ids).drop("account_no"), telecom_of_day(case, ids), data_quality(case, ids)):
        j = j.join(part, "txn_id")
    return j
