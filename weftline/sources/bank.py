"""Bank statements: delimited exports and printed lines, as canonical payments; complaint ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import amounts, clock, ids, narration
from weftline.sources.delimited import cell, cells, table

# Header synonyms of tabular statements (as printed, compared in lower case).
HEADERS = {
    "date": ("date", "tran date", "txn date", "transaction date", "tran_date", "post date"), "time": ("time", "timestamp", "tran_time"),
    "narration": ("narration", "particulars", "description", "transaction particulars", "remarks"), "mode": ("mode",),
    "debit": ("debit", "withdrawals", "withdrawal", "debit amount", "withdrawal (dr)"), "credit": ("credit", "deposits", "deposit", "credit amount", "deposit (cr)"),
    "amount": ("amount", "tran_amount", "transaction amount"), "type": ("type", "dr/cr", "cr/dr", "tran_type"), "balance": ("balance", "closing balance"),
    "account_no": ("account_no", "account no", "account number", "account"), "account_name": ("account_name", "name"), "ifsc": ("ifsc",), "bank": ("bank",),
    "ref": ("chq_ref_no", "ref", "chq no", "reference"),
}


def read_tabular(texts: DataFrame) -> DataFrame:
    """Debit and credit columns, or one amount with a sign or a type column."""
    rows = cells(texts)
    low = F.transform("cells", F.lower)
    any_of = lambda key: F.exists(low, lambda x: x.isin(*HEADERS[key]))
    head = any_of("date") & (any_of("debit") | any_of("credit") | any_of("amount"))
    t = table(rows, head).withColumn("row", F.transform_keys("row", lambda k, _: F.lower(k)))
    t = t.select("file", "line", *[cell(*names).alias(f"r_{k}") for k, names in HEADERS.items()])
    v = {k: F.col(f"r_{k}") for k in HEADERS}
    amount = amounts.parse_amount(v["amount"])
    kind = F.upper(F.substring(F.coalesce(v["type"], F.lit("")), 1, 1))
    out_of = F.coalesce(amounts.parse_amount(v["debit"]), F.when((kind == "D") | (amount < 0), F.abs(amount)))
    into = F.coalesce(amounts.parse_amount(v["credit"]), F.when((kind != "D") & (amount >= 0), amount))
    return t.select("file", "line", clock.parse_date(v["date"]).alias("date"), clock.parse_time(v["time"]).alias("time"), v["narration"].alias("narration"), v["mode"].alias("mode"),
                    out_of.alias("debit"), into.alias("credit"), amounts.parse_amount(v["balance"]).alias("balance"), v["account_no"].alias("account_no"),
                    v["account_name"].alias("account_name"), v["ifsc"].alias("ifsc"), v["bank"].alias("bank"), v["ref"].alias("ref"))


# Lines that carry no transaction, and line starts of carried balances.
SKIP_LINE = r"(?i)^(page\s*\d+|disclaimer|this is system|registered office|grand total|opening balance|closing balance|b/f|brought forward|balance forward|swipe limit|available balance|elapsed|[-_=]{4,})"
DATE_START = r"^(?:\d{1,6}\s+)?(\d{1,2}[-/][A-Za-z0-9]{2,9}[-/]\d{2,4})\b"
PARTIAL_DATE = r"(\d{2}-[A-Za-z]{3}-|\d{1,2}/\d{1,2}/\d{2})$"
# Words that must all occur within three lines to recognise a statement family, most specific first.
FAMILIES = (
    ("casa", ("post date", "debit", "credit", "balance")), ("axis8", ("transaction particulars", "dr/cr")), ("axis7", ("tran date", "particulars", "debit", "credit")),
    ("federal", ("withdrawals", "deposits", "dr/cr")), ("hdfc", ("narration", "withdrawalamt")), ("kotak", ("narration", "withdrawal (dr)")),
    ("bandhan", ("trans value", "description", "debits")), ("pnb", ("gl.", "debit amount", "credit amount")), ("union", ("particulars", "withdrawals", "deposits", "balance")),
    ("icici", ("transaction details", "cheque no", "debit")), ("utkarsh", ("value date", "transaction", "debit", "credit")), ("yes", ("description", "reference", "debits", "credits")),
    ("rbl", ("tran particular", "debit amount", "credit amount")), ("cityunion", ("particulars", "chq no", "debit", "credit", "balance")),
    ("associate", ("narra", "chequeno", "debit", "credit", "balance")),
)
IFSC_FAMILY = {"UTIB": "axis8", "BDBL": "bandhan", "FDRL": "federal", "HDFC": "hdfc", "ICIC": "icici", "KKBK": "kotak", "PUNB": "pnb", "UBIN": "union", "UTKS": "utkarsh",
               "YESB": "yes", "UCBA": "pnb", "CIUB": "cityunion", "GSCB": "associate", "RATN": "rbl"}
IFSC = r"(?i)ifsc\s*(?:code)?\s*:?\s*([A-Za-z]{4}\d{7})"
ACCOUNT = r"(?i)(?:a/c|account)\s*(?:no|number)?\.?\s*:?\s*(\d{6,})"


def statement_family(lines: DataFrame) -> DataFrame:
    """(file, family, ifsc, account_no): by bank code when printed, else by header words within three lines."""
    w = W.partitionBy("file").orderBy("line")
    near = F.lower(F.concat_ws(" ", "text", F.lead("text", 1).over(w), F.lead("text", 2).over(w)))
    rank = F.lit(None).cast("int")
    for i, (_, words) in reversed(list(enumerate(FAMILIES))):
        hit = None
        for word in words:
            one = F.contains(F.col("near"), F.lit(word))
            hit = one if hit is None else hit & one
        rank = F.when(hit, i).otherwise(rank)
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    g = lines.withColumn("near", near).withColumn("rank", rank).groupBy("file").agg(
        F.min("rank").alias("rank"), F.upper(F.min_by(found(IFSC), F.when(found(IFSC).isNotNull(), F.col("line")))).alias("ifsc"),
        F.min_by(found(ACCOUNT), F.when(found(ACCOUNT).isNotNull(), F.col("line"))).alias("account_no"),
        F.max(F.contains(F.lower("text"), F.lit("opening balance"))).alias("has_opening"))
    code = F.create_map(*[x for k, v in IFSC_FAMILY.items() for x in (F.lit(k), F.lit(v))])
    names = F.array(*[F.lit(n) for n, _ in FAMILIES])
    return g.select("file", F.coalesce(F.try_element_at(code, F.substring("ifsc", 1, 4)), F.try_element_at(names, F.col("rank") + 1), F.lit("generic")).alias("family"),
                    "ifsc", "account_no", "has_opening")


def read_lines(texts: DataFrame) -> DataFrame:
    """Printed statement lines to payments.

    Split dates are rejoined, continuation lines join the narration, one to three amounts are read from
    the right, and the direction of a single amount follows the balance. Order matters only within a file.
    """
    raw = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).where(F.trim("text") != "").withColumn("text", F.trim("text"))
    w = W.partitionBy("file").orderBy("line")
    split = F.lag("text").over(w).rlike(PARTIAL_DATE) & F.col("text").rlike(r"^\d{2}") & ~F.col("text").rlike(DATE_START)
    raw = raw.withColumn("joins", F.coalesce(split, F.lit(False)))
    nxt_joins, nxt = F.lead("joins").over(w), F.lead("text").over(w)
    raw = raw.withColumn("text", F.when(F.coalesce(nxt_joins, F.lit(False)), F.concat("text", nxt)).otherwise(F.col("text"))).where("not joins")
    meta = statement_family(raw)
    token = F.regexp_extract("text", DATE_START, 1)
    date = F.when(token != "", clock.parse_date(token))
    rows = raw.where(~F.col("text").rlike(SKIP_LINE)).withColumn("date", date)
    starts = F.col("date").isNotNull()
    rows = rows.withColumn("txn", F.sum(starts.cast("int")).over(w)).where("txn > 0")
    rest = F.when(starts, F.trim(F.regexp_replace("text", DATE_START, ""))).otherwise(F.col("text"))
    g = rows.withColumn("rest", rest).groupBy("file", "txn").agg(
        F.min("line").alias("line"), F.max("date").alias("date"), F.min_by("rest", "line").alias("head"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~starts, F.struct("line", "rest")))), lambda x: x["rest"]), " ").alias("tail"))
    words = F.split("head", r"\s+")
    money = F.filter(words, amounts.is_amount_token)
    first = F.array_position(words, F.try_element_at(money, F.lit(1)))
    g = g.withColumns({"money": F.transform(money, lambda t: F.regexp_replace(t, r"\(?[CcDd][Rr]\)?$", "")), "suffix": amounts.suffix(F.try_element_at(money, F.lit(-1))),
                       "words": F.when(first > 0, F.slice(words, F.lit(1), (first - 1).cast("int"))).otherwise(words)})
    g = g.where(F.size("money") > 0).join(meta, "file")
    value = lambda i: amounts.parse_amount(F.try_element_at("money", F.lit(i)))
    g = g.withColumn("balance", value(-1))
    wt = W.partitionBy("file").orderBy("line")
    before = F.coalesce(F.lag("balance").over(wt), F.when(F.col("has_opening"), 0.0))
    g = g.withColumn("move", F.col("balance") - before)
    n, one, move = F.size("money"), value(-2), F.col("move")
    clear = F.coalesce(F.abs(move) > 1e-9, F.lit(False))
    debit = (F.when(n >= 3, value(-3)).when((n == 2) & clear & (move < 0), one).when((n == 2) & ~clear & (F.col("suffix") == "DR"), one)
             .when((n == 1) & clear & (move < 0), -move).when((n == 1) & ~clear & (F.col("suffix") == "DR"), F.col("balance")))
    credit = (F.when(n >= 3, value(-2)).when((n == 2) & clear & (move > 0), one).when((n == 2) & ~clear & (F.col("suffix") != "DR"), one)
              .when((n == 1) & clear & (move > 0), move).when((n == 1) & ~clear & (F.col("suffix") == "CR"), F.col("balance")))
    told = F.trim(F.concat_ws(" ", F.array_join("words", " "), F.nullif("tail", F.lit(""))))
    return g.select("file", "line", "date", F.lit(None).cast("string").alias("time"), told.alias("narration"), F.coalesce(debit, F.lit(0.0)).alias("debit"),
                    F.coalesce(credit, F.lit(0.0)).alias("credit"), "balance", "account_no", "ifsc", "family").where("debit > 0 or credit > 0")


def normalise(rows: DataFrame) -> DataFrame:
    """Parsed rows to canonical payments: direction, mode, parties and references from the narration."""
    n = F.coalesce("narration", F.lit(""))
    upi = narration.upi_parts(n)
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    debit, credit = F.coalesce("debit", F.lit(0.0)), F.coalesce("credit", F.lit(0.0))
    kind = F.when(debit > 0, "D").when(credit > 0, "C")
    ref = F.coalesce(upi["upi_ref"], narration.reference(n))
    more = narration.enrichment(n, F.col("debit"))
    out = rows.select(
        F.concat_ws("_", F.substring(F.sha2("file", 256), 1, 8), F.col("line").cast("string")).alias("txn_id"), have("bank").alias("bank"), "account_no",
        have("account_name").alias("account_name"), have("ifsc").alias("ifsc"), "date", "time", F.coalesce(have("mode"), narration.payment_mode(n)).alias("mode"), n.alias("narration"),
        F.nullif(debit, F.lit(0.0)).alias("debit"), F.nullif(credit, F.lit(0.0)).alias("credit"), "balance", kind.alias("txn_type"), F.coalesce(have("ref"), ref).alias("chq_ref_no"),
        upi["upi_id"].alias("upi_id"), ref.alias("upi_ref"), upi["name"].alias("counterparty_name"), narration.counterparty_bank(n).alias("counterparty_bank"),
        F.when(kind == "D", upi["phone"]).alias("receiver_phone"), F.when(~F.coalesce(kind == "D", F.lit(False)), upi["phone"]).alias("sender_phone"),
        narration.account_in(n).alias("receiver_account"), more["merchant_name"].alias("merchant_name"), more["payment_gateway"].alias("payment_gateway"),
        F.lit(None).cast("string").alias("customer_id"), F.col("file").alias("source_file"))
    return out.withColumn("ts", clock.to_epoch(F.col("date"), F.col("time")))


def usable(bank: DataFrame) -> DataFrame:
    """Payments with a date and an amount."""
    return bank.where("date is not null and (debit is not null or credit is not null)")


# Header fragments of complaint ledgers.
COMPLAINT_HEADERS = {"ack_no": "acknowledg", "account_no": "account", "ifsc": "ifsc", "state": "state", "district": "district", "police_station": "station", "officer_name": "name of",
                     "designation": "designation", "mobile": "mobile", "email": "email", "bank_name": "bank"}


def read_complaints(texts: DataFrame) -> DataFrame:
    """Complaint ledger: headers are matched by fragment; the whole file is read."""
    rows = cells(texts)
    low = F.transform("cells", F.lower)
    head = F.exists(low, lambda x: F.contains(x, F.lit("account"))) & F.exists(low, lambda x: F.contains(x, F.lit("ifsc")))
    t = table(rows, head)

    def like(fragment: str) -> Column:
        hit = F.filter(F.map_entries("row"), lambda e: F.contains(F.lower(e["key"]), F.lit(fragment)) & (e["value"] != ""))
        return F.try_element_at(hit, F.lit(1))["value"]

    v = {k: like(f) for k, f in COMPLAINT_HEADERS.items()}
    out = t.select(F.concat_ws("_", F.lit("cmp"), F.substring(F.sha2("file", 256), 1, 8), F.col("line").cast("string")).alias("complaint_id"),
                   F.nullif(F.regexp_replace(v["account_no"], "[^0-9]", ""), F.lit("")).alias("account_no"), F.upper(v["ifsc"]).alias("ifsc"),
                   ids.phone(v["mobile"]).alias("mobile"), *[v[k].alias(k) for k in ("ack_no", "state", "district", "police_station", "officer_name", "designation", "email", "bank_name")],
                   F.col("file").alias("source_file"))
    return out.where("account_no is not null")


def _labelled(texts: DataFrame, first: str) -> DataFrame:
    """Rows of files whose header line holds the column ``first``."""
    return table(cells(texts), F.array_contains("cells", first))


def read_synthetic_bank(texts: DataFrame) -> DataFrame:
    """Labelled synthetic payments (one row per transfer, sender side)."""
    c = cell
    amount = F.coalesce(c("Transaction_Amount").try_cast("double"), F.lit(0.0))
    return _labelled(texts, "Transaction_ID").select(
        c("Transaction_ID").alias("txn_id"), c("Sender_Bank_Name").alias("bank"), c("Sender_Account_Number").alias("account_no"), c("Sender_Customer_Name").alias("account_name"),
        c("Sender_Customer_ID").alias("customer_id"), c("Sender_IFSC").alias("ifsc"), c("Receiver_Account_Number").alias("receiver_account"), amount.alias("amount"), amount.alias("debit"),
        F.lit(None).cast("double").alias("credit"), F.lit("D").alias("txn_type"), ids.phone(c("Sender_Phone_Number")).alias("sender_phone"),
        ids.phone(c("Receiver_Phone_Number")).alias("receiver_phone"), F.upper(c("Transaction_Mode")).alias("mode"), c("Receiver_Customer_Name").alias("counterparty_name"),
        c("Receiver_Bank_Name").alias("counterparty_bank"), F.concat_ws(" ", c("Transaction_Mode"), c("Receiver_Customer_Name")).alias("narration"), c("Date").alias("date"), c("Timestamp").alias("time"),
        clock.to_epoch(c("Date"), c("Timestamp")).alias("ts"), F.col("file").alias("source_file"), F.lit("synthetic_csv").alias("source_format"))


def read_synthetic_calls(texts: DataFrame) -> DataFrame:
    c = cell
    return _labelled(texts, "CDR_ID").select(
        c("CDR_ID").alias("cdr_id"), c("Operator").alias("operator"), ids.phone(c("A_Party_Number")).alias("a_number"), ids.phone(c("B_Party_Number")).alias("b_number"),
        c("Call_Type").alias("call_type"), F.coalesce(c("Call_Duration_Seconds").try_cast("long"), F.lit(0)).alias("duration_sec"), ids.device(c("IMEI")).alias("imei"),
        ids.device(c("IMSI")).alias("imsi"), c("First_Cell_Global_ID").alias("cell_id_first"), c("First_BTS_Location").alias("bts_location_first"), c("Roaming_Network_Circle").alias("roaming_circle"),
        c("Call_Date").alias("date"), c("Call_Start_Time").alias("time"), clock.to_epoch(c("Call_Date"), c("Call_Start_Time")).alias("ts"), F.col("file").alias("source_file"),
        F.lit("synthetic_csv").alias("source_format"))


def read_synthetic_sessions(texts: DataFrame) -> DataFrame:
    c = cell
    start = clock.to_epoch(c("Session_Date"), c("Session_Start_Time"))
    dur = F.coalesce(c("Session_Duration_Seconds").try_cast("double").cast("long"), F.lit(0).cast("long"))
    return _labelled(texts, "IPDR_ID").select(
        c("IPDR_ID").alias("ipdr_id"), c("Operator").alias("operator"), ids.phone(c("Subscriber_MSISDN")).alias("msisdn"), ids.device(c("Subscriber_IMSI")).alias("imsi"),
        ids.device(c("Device_IMEI")).alias("imei"), ids.ip(c("Source_IP_Address")).alias("source_ip"), ids.ip(c("Destination_IP_Address")).alias("dest_ip"), c("Destination_Port").alias("dest_port"),
        c("Cell_Global_ID").alias("cell_id"), c("Session_Date").alias("date"), c("Session_Start_Time").alias("start_time"), start.alias("start_ts"), (start + dur).alias("end_ts"),
        dur.alias("duration_sec"), F.col("file").alias("source_file"), F.lit("synthetic_csv").alias("source_format"))


def read_truth(texts: DataFrame) -> DataFrame:
    """Labelled suspicious payments: ids, scope, scenario, customer, difficulty and the lists of call and session ids."""
    c = cell
    each = lambda name: F.filter(F.transform(F.split(F.coalesce(c(name), F.lit("")), ";"), F.trim), lambda x: x != "")
    return _labelled(texts, "Anomaly_ID").where(c("Is_Suspicious") == "1").select(
        c("Anomaly_ID").alias("anomaly_id"), c("Transaction_ID").alias("transaction_id"), c("Source_Scope").alias("scope"), c("Scenario_Type").alias("scenario"),
        c("customer_id", "Customer_ID").alias("customer_id"), c("difficulty", "Difficulty").alias("difficulty"), F.when(c("CDR_IDs").isNotNull(), each("CDR_IDs")).otherwise(each("cdr_ids")).alias("cdr_ids"),
        each("IPDR_IDs").alias("ipdr_ids"))


def read_true_pairs(texts: DataFrame, left: str, right: str) -> DataFrame:
    """Labelled correlated pairs, e.g. ``Transaction_ID`` with ``CDR_ID``."""
    rows = table(cells(texts), F.array_contains("cells", left) & F.array_contains("cells", right) & F.array_contains("cells", "Is_Correlated"))
    return rows.where(cell("Is_Correlated") == "1").select(cell(left).alias("left_id"), cell(right).alias("right_id"), F.abs(cell("Time_Difference_Seconds").try_cast("long")).alias("time_diff"))
