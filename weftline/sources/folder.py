"""Folder ingest: file census, routing to readers, per-file status, case storage, flat exports."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.sources import bank as bk
from weftline.sources import calls as cl
from weftline.sources.delimited import read_texts
from weftline.session import cut, ensure_checkpoint_dir

CONFIDENT = 0.55
TEXT_KINDS = ("csv", "txt")

# Fixed values: (format, dataset, keywords, header cells, patterns) by which a text export is recognised, in order of precedence.
FINGERPRINTS = (
    ("jio_vvm", "CDR", ("calling party telephone number", "input value (msisdn", "called party telephone number"), ("calling party telephone number", "input value (msisdn"),
     (r"call\s+date[\s,]", r"call\s+duration[\s,]")),
    ("vi", "CDR", ("target /a party number", "b party number", "vodafone idea call data records", "allindia report", "main cdr report", "call initiation time"),
     ("target /a party number", "target /a party"), (r"call\s+date[\s,]", r"first\s+cell\s+global\s+id")),
    ("jio_nodal", "CDR", ("nodaloffice", "search criteria :", "enquirer name :", "other_party_no", "call_initiation_time"), ("sl_no", "mobile_no"),
     (r"sl_no[\s,]+\s*mobile_no", r"call_initiation_time\s*\(cit\)")),
    ("airtel", "CDR", ("bharti airtel limited", "call details of", "pan india", "target no", "b party no", "first cgi"), ("target no", "b party no"), (r"dur\s*\(\s*s\s*\)",)),
    ("airtel_sdr", "SUBSCRIBER", ("subscriber address1", "dealer retailer code", "sim type", "father name"), ("msisdn", "subscriber address1"),
     (r"subscriber\s+address\d", r"dealer\s+retailer\s+code")),
    ("jio_ipv6", "IPDR", ("landline/msisdn", "ip address assigned/translated", "source mac-id", "data volume up link"), ("landline/msisdn", "source ip address"),
     (r"start\s+date\s+of\s+public\s+ip", r"session\s+duration")),
    ("ipdr_csv", "IPDR", ("source ip", "destination port", "start time", "end time", "time(ist)"), ("ip address", "ip", "source ip"), (r"(source\s+)?ip\s+address.*(time|date|port)",)),
    ("bank_pdf", "BANK", ("statement of account", "statement of axis", "bank statement", "transaction particulars", "closing balance", "opening balance", "account no", "ifsc", "narration",
                          "withdrawals", "deposits", "debits", "credits", "balance", "tran date", "value date", "debit amount", "credit amount"), (),
     (r"statement\s+of\s+(account|axis)", r"transaction\s+particulars", r"account\s+no", r"opening\s+balance")),
    ("bank_xlsx", "BANK", ("transaction particulars", "debit", "credit", "balance", "narration", "withdrawals", "deposits", "closing balance", "account no", "ifsc", "value date", "tran date",
                           "txn date", "tran_amount", "txn_desc", "naration", "txn_branch"),
     ("date", "txn date", "tran date", "narration", "particulars", "debit", "credit", "balance", "account", "tran_amount"), (r"debit[\s/]+credit", r"withdrawals?[\s/]+deposits?", r"tran\s+amount")),
    ("ncrp_complaints", "COMPLAINT", ("acknowledgement", "police station", "complain"), ("acknowledgement no", "account no", "ifsc code"), (r"acknowledgement\s*no", r"police\s*station")),
    ("synthetic_bank", "BANK", ("sender_phone_number", "receiver_phone_number", "sender_account_number", "transaction_amount"),
     ("transaction_id", "sender_account_number", "transaction_amount", "receiver_phone_number"), ()),
    ("synthetic_cdr", "CDR", ("a_party_number", "b_party_number", "call_duration_seconds", "first_cell_global_id", "roaming_network_circle"), ("cdr_id", "a_party_number", "call_duration_seconds"), ()),
    ("synthetic_ipdr", "IPDR", ("subscriber_msisdn", "session_duration_seconds", "destination_ip_address"), ("ipdr_id", "subscriber_msisdn", "source_ip_address"), ()),
    ("email_cover", "UNKNOWN", ("fw:", "fw re", "this mail is from external domain", "crime branch surat", "ccps fir", "importance:", "part1/1"), (),
     (r"^(from|sent|to|subject|importance|attachments)[\s:]+", r"\d+\s+attachments?\s*\(", r"mail\s*-\s*\w+@")),
    ("caf_form", "SUBSCRIBER", ("customer application form", "caf no", "prepaid customer application", "reliance jio infocomm", "service center", "postpaid customer application",
                                "registered office", "circle office"), (), (r"customer\s+application\s+form", r"caf\s*no\.?", r"subscriber\s*id")),
    ("subs_detail", "SUBSCRIBER", ("subscriber details report", "deactivation_da", "subscriber_typ", "ported_date", "mnp_status", "current operator", "prev operator"), (),
     (r"subscriber\s+details\s+report", r"mobile\s+number\s*:")),
)
#: Formats of printed pages: their text comes as ``.txt`` here, never as ``.csv``.
PAGES = ("bank_pdf", "email_cover", "caf_form", "subs_detail")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ext) of everything below ``folder``; only names are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"))
    return names.withColumn("ext", F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)))


def census(texts: DataFrame) -> DataFrame:
    """(file, dataset, format, confidence, status, text): every text scored whole against every fingerprint.

    The fingerprints are a fixed table of constants, evaluated as columns of the file's own row. A header cell counts where it
    fills a whole cell of any line.
    """
    name = F.regexp_extract("file", r"([^/]+)$", 1)

    def count(conds):
        return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds], F.lit(0))

    def has_cell(h: str):
        return F.col("t").rlike(r"(?m)(^|[,;\t|])\s*[\"'=]*" + re.escape(h) + r"[\"']*\s*([,;\t|]|$)")

    base = texts.select("file", name.alias("name"), F.lower("text").alias("t"), "text")
    scored = []
    for i, (fmt, dataset, words, headers, patterns) in enumerate(FINGERPRINTS):
        raw = (F.least(F.lit(0.55), 0.12 * count([F.contains("t", F.lit(w)) for w in words])) + F.least(F.lit(0.4), 0.2 * count([has_cell(h) for h in headers]))
               + F.least(F.lit(0.5), 0.18 * count([F.col("t").rlike("(?is)" + p) for p in patterns])))
        open_to = F.lower("name").endswith(".txt") if fmt in PAGES else F.lit(True)
        score = F.when((raw > 0) & open_to, F.least(F.lit(1.0), raw + 0.1)).otherwise(0.0)
        scored.append(F.struct(F.round(score, 3).alias("confidence"), F.lit(-i).alias("o"), F.lit(fmt).alias("format"), F.lit(dataset).alias("dataset")))
    best = base.withColumn("b", F.array_max(F.array(*scored)))
    hit = F.col("b.confidence") > 0
    status = (F.when(F.col("name").startswith(".") | F.col("name").startswith("~$"), "hidden").when(truth_file(F.col("name"), F.col("t")), "ground_truth")
              .when(~hit, "no_match").when(F.col("b.format").isin("email_cover", "caf_form"), "no_data").when(F.col("b.confidence") < CONFIDENT, "low_confidence").otherwise("ok"))
    by_ext = F.when(F.col("b.format") == "bank_xlsx", F.concat(F.lit("bank_"), F.lower(F.regexp_extract("name", r"([A-Za-z0-9]+)$", 1)))).otherwise(F.col("b.format"))
    return best.select("file", F.when(hit, F.col("b.dataset")).otherwise("UNKNOWN").alias("dataset"), F.when(hit, by_ext).otherwise("unknown").alias("format"),
                       F.when(hit, F.col("b.confidence")).otherwise(0.0).alias("confidence"), status.alias("status"), "text")


def truth_file(name, low):
    """Labels of a synthetic set, by file name or by their own columns."""
    return F.lower(name).rlike("ground.?truth") | F.contains(low, F.lit("is_suspicious")) | F.contains(low, F.lit("is_correlated"))


@dataclass(frozen=True)
class Ingested:
    case: Case
    status: DataFrame
    #: Labelled payments, and labelled pairs (bank with calls, calls with sessions); without rows when the folder has no labels.
    suspicious: DataFrame
    bank_calls: DataFrame
    calls_sessions: DataFrame


def ingest(spark: SparkSession, folder: str) -> Ingested:
    """Recognise, route and parse every file below ``folder``. Low-confidence files are read and marked.

    Only text files are opened, once: texts are stored by format, and each reader takes its own part.
    """
    other = files(spark, folder).where(~F.col("ext").isin(*TEXT_KINDS))
    routed = stored_by(census(read_texts(spark, folder, TEXT_KINDS)), "format")
    found = routed.drop("text")
    usable = routed.where(F.col("status").isin("ok", "low_confidence"))
    of = lambda *f: usable.where(F.col("format").isin(*f)).select("file", "text")

    def stack(parts):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    bank = bk.usable(stack([bk.normalise(bk.read_tabular(of("bank_csv", "bank_txt"))), bk.normalise(bk.read_lines(of("bank_pdf")))]))
    bank = stack([bank, bk.read_synthetic_bank(of("synthetic_bank"))])
    cdr = stack([cl.read_calls(of(x.name), x).withColumnRenamed("file", "source_file") for x in cl.LAYOUTS]).drop("line")
    cdr = stack([cdr, bk.read_synthetic_calls(of("synthetic_cdr"))])
    ipdr = stack([read(of(name)).withColumnRenamed("file", "source_file") for name, read in (("jio_ipv6", cl.read_provider_sessions), ("ipdr_csv", cl.read_plain_sessions))]).drop("line")
    ipdr = stack([ipdr, bk.read_synthetic_sessions(of("synthetic_ipdr"))])
    complaints, subs = bk.read_complaints(of("ncrp_complaints")), cl.read_subscribers(of("airtel_sdr"))
    # parsed once: both the status table and the writer read these
    bank, cdr, ipdr, complaints, subs = (cut(d) for d in (bank, cdr, ipdr, complaints, subs))
    counts = reduce(DataFrame.unionByName, [d.groupBy("source_file").agg(F.count(F.lit(1)).alias("records")) for d in (bank, cdr, ipdr, complaints, subs)])
    status = found.join(counts.groupBy(F.col("source_file").alias("file")).agg(F.sum("records").alias("records")), "file", "left").withColumn(
        "records", F.coalesce("records", F.lit(0)))
    status = status.withColumn("status", F.when(F.col("status").isin("ok", "low_confidence") & (F.col("records") == 0), "no_rows").otherwise(F.col("status")))
    hidden = F.regexp_extract("file", r"([^/]+)$", 1).rlike(r"^(\.|~\$)")
    unread = other.select("file", F.lit("UNKNOWN").alias("dataset"), F.lit("unknown").alias("format"), F.lit(0.0).alias("confidence"),
                          F.when(hidden, "hidden").otherwise("unsupported_type").alias("status"), F.lit(0).cast("long").alias("records"))
    labels = routed.where("status = 'ground_truth'").select("file", "text")
    return Ingested(Case(bank, cdr, ipdr, complaints, subs), status.select(*unread.columns).unionByName(unread), bk.read_truth(labels),
                    bk.read_true_pairs(labels, "Transaction_ID", "CDR_ID"), bk.read_true_pairs(labels, "CDR_ID", "IPDR_ID"))


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """Write to the shared folder, one directory for each value of ``column``, and read back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


DATASETS = ("bank", "cdr", "ipdr", "complaints", "subscribers")


def save_case(case: Case, root: str, case_id: str, user: str = "shared") -> None:
    """Write each dataset under ``root``, one folder for each user and case; saving again replaces that case only.

    Each case has its own schema in its files, so cases with different columns do not touch each other.
    """
    for name in DATASETS:
        getattr(case, name).write.mode("overwrite").parquet(f"{root}/{name}/user={user}/case_id={case_id}")


def load_case(spark: SparkSession, root: str, case_id: str, user: str = "shared") -> Case:
    """Read one case of one user back; nothing else is listed or opened."""
    return Case(*[spark.read.parquet(f"{root}/{name}/user={user}/case_id={case_id}") for name in DATASETS])


# Columns of the flat fused export.
FUSED_COLUMNS = ("transaction_id", "date", "time", "mode", "amount", "direction", "account_no", "account_name", "bank", "counterparty_name", "counterparty_bank", "receiver_account",
                 "sender_phone", "receiver_phone", "call_count", "ipdr_count", "complained", "risk_score", "risk_band")


def flat_fused(rows: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    none = F.lit(None)
    rows = rows.join(scored.select("transaction_id", "risk_score", "risk_band"), "transaction_id", "left") if scored is not None else rows.withColumns(
        {"risk_score": none.cast("double"), "risk_band": none.cast("string")})
    return rows.select(*FUSED_COLUMNS)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)
