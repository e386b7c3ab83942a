"""Call-record, data-session and subscriber exports of the providers, as canonical tables.

A layout is a small table: how to find the header line, where the queried number is printed, and which
header feeds which canonical column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import clock, ids
from weftline.sources.delimited import cell, cells, read_texts, table

CDR_COLUMNS = ("a_number", "b_number", "service_type", "imei", "imsi", "cell_id_first", "cell_id_last", "bts_location_first", "bts_location_last",
               "roaming_circle", "msc_id", "lrn_b_party", "lrn_translation", "lat_first", "lon_first")


@dataclass(frozen=True)
class Layout:
    name: str
    operator: str
    header: str                     # start of the header line's first cell (lower case)
    query: str                      # regular expression over the preamble; group 1 is the queried value
    date: str
    time: tuple[str, ...]
    duration: str
    call_type: str
    columns: dict[str, tuple[str, ...]]
    sms: tuple[str, ...] = ("sms",)
    incoming: tuple[str, ...] = field(default=())
    outgoing: tuple[str, ...] = field(default=())


# Header names of the four call-record exports.
LAYOUTS = (
    Layout("jio_vvm", "Jio", "calling party", r"(?i)input value[^\n]*?[,\t;|]\s*[\"'=]*(\+?\d{10,15})", "Call Date", ("Call Time",), "Call Duration", "Call Type",
           {"a_number": ("Calling Party Telephone Number",), "b_number": ("Called Party Telephone Number",), "cell_id_first": ("First Cell ID",), "cell_id_last": ("Last Cell ID",),
            "imei": ("IMEI",), "imsi": ("IMSI",), "roaming_circle": ("Roaming Circle Name",), "lrn_b_party": ("LRN Called No",)}, sms=("sms", "a2p", "p2p")),
    Layout("vi", "Vi", "target /a party", r"(?i)(?:msisdn|imei)[^:\n]*:\s*-?\s*(\+?\d{10,15})", "Call date", ("Call Initiation Time",), "Call Duration", "CALL_TYPE",
           {"a_number": ("Target /A PARTY NUMBER",), "b_number": ("B PARTY NUMBER",), "service_type": ("Service Type",), "cell_id_first": ("First Cell Global Id",),
            "cell_id_last": ("Last Cell Global Id",), "bts_location_first": ("First BTS Location",), "bts_location_last": ("Last BTS Location",), "imei": ("IMEI",), "imsi": ("IMSI",),
            "roaming_circle": ("Roaming Network/Circle",), "msc_id": ("MSC ID",), "lrn_b_party": ("LRN- B Party Number",), "lrn_translation": ("Translation of LRN",)}),
    Layout("jio_nodal", "Jio", "sl_no", r"(?i)search value\s*:\s*(\+?\d{10,15})", "Call_Date", ("Call_Initiation_Time(CIT)", "Call_Initiation_Time"), "Call_Duration", "Call_Type",
           {"a_number": ("Mobile_No",), "b_number": ("Other_Party_No",), "service_type": ("Service_Type",), "cell_id_first": ("First_Cell_id",), "cell_id_last": ("Last_Cell_ID",),
            "bts_location_first": ("First_Cell_Desc",), "bts_location_last": ("Last_Cell_Desc",), "imei": ("IMEI",), "imsi": ("IMSI",), "roaming_circle": ("Roaming Circle", "Roaming_Circle"),
            "msc_id": ("MSC_ID",), "lrn_b_party": ("LRN_B_Party_No",), "lrn_translation": ("LRN_DESCRIPTION",), "lat_first": ("First_LAT",), "lon_first": ("First_Long",)}),
    Layout("airtel", "Airtel", "target no", r"(?i)call details of (?:mobile|imei) no '([^']+)'", "Date", ("Time",), "Dur(s)", "Call Type",
           {"a_number": ("Target No",), "b_number": ("B Party No",), "service_type": ("Service Type",), "cell_id_first": ("First CGI",), "cell_id_last": ("Last CGI",), "imei": ("IMEI",),
            "imsi": ("IMSI",), "roaming_circle": ("Roam Nw",), "msc_id": ("SW & MSC ID",), "lrn_b_party": ("LRN No",), "lrn_translation": ("LRN TSP-LSA",)},
           sms=("smt", "smo", "dsm", "sms"), incoming=("in", "smt", "dsm"), outgoing=("out", "smo")),
)


def orient(a: Column, b: Column, call_type: Column, target: Column) -> tuple[Column, Column, Column]:
    """Put the queried number first; a swapped row changes IN to OUT and back."""
    t, na, nb = ids.phone(target), ids.phone(a), ids.phone(b)
    swap = F.coalesce(t.isNotNull() & (nb == t) & ~na.eqNullSafe(t), F.lit(False))
    flipped = F.when(call_type == "IN", "OUT").when(call_type == "OUT", "IN").otherwise(call_type)
    return F.when(swap, nb).otherwise(na), F.when(swap, na).otherwise(nb), F.when(swap, flipped).otherwise(call_type)


def _starts(prefix: str) -> Column:
    return F.lower(F.col("cells")[0]).startswith(prefix)


def _call_type(raw: Column, layout: Layout) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    if layout.incoming:
        direction = F.when(low.isin(*layout.outgoing), "OUT").when(low.isin(*layout.incoming), "IN")
        sms = low.isin(*layout.sms)
    else:
        direction = F.when(F.contains(low, F.lit("out")), "OUT").when(F.contains(low, F.lit("in")), "IN")
        sms = F.contains(low, F.lit("sms"))
        for extra in layout.sms[1:]:
            sms = sms | low.startswith(extra)
    return F.when(sms, "SMS").otherwise(direction)


def read_calls(texts: DataFrame, layout: Layout) -> DataFrame:
    """One layout's files as canonical call records."""
    rows = cells(texts)
    head = _starts(layout.header)
    query = texts.select("file", F.nullif(F.regexp_extract("text", layout.query, 1), F.lit("")).alias("query_value"))
    body = table(rows, head).where(~F.lower("first").startswith(layout.header)).join(query, "file", "left")
    # raw cells first, then numbers, then orientation: every value is computed once
    raw = body.select("file", "line", "query_value", cell(layout.call_type).alias("r_type"), cell(layout.date).alias("r_date"), cell(*layout.time).alias("r_time"),
                      cell(layout.duration).alias("r_dur"), *[(cell(*layout.columns[c]) if c in layout.columns else F.lit(None).cast("string")).alias(c) for c in CDR_COLUMNS])
    raw = raw.withColumn("kind", _call_type(F.col("r_type"), layout))
    a, b, kind = orient(F.col("a_number"), F.col("b_number"), F.col("kind"), F.col("query_value"))
    seconds = F.coalesce(F.floor(F.col("r_dur").try_cast("double")).cast("long"), F.lit(0).cast("long"))
    out = raw.select("file", "line", "query_value", a.alias("a_number"), b.alias("b_number"), kind.alias("call_type"), clock.parse_date(F.col("r_date")).alias("date"),
                     clock.parse_time(F.col("r_time")).alias("time"), seconds.alias("duration_sec"), ids.device(F.col("imei")).alias("imei"), ids.device(F.col("imsi")).alias("imsi"),
                     *[c for c in CDR_COLUMNS if c not in ("a_number", "b_number", "imei", "imsi", "service_type")],
                     F.coalesce("service_type", F.when(F.col("kind") == "SMS", "SMS").otherwise("Voice")).alias("service_type"))
    return out.where("date is not null").select(
        F.concat_ws("_", F.lit("cdr"), F.substring(F.sha2("file", 256), 1, 8), F.col("line").cast("string")).alias("cdr_id"), F.lit(layout.operator).alias("operator"),
        "*", clock.to_epoch(F.col("date"), F.col("time")).alias("ts"), F.lit(layout.name).alias("source_format"))


# Headers of the provider's session export, the first that is there counts.
PROVIDER_SESSION = {
    "msisdn": ("Landline/MSISDN/MDN/Leased Circuit ID for Internet Access",), "source_ip": ("Source IP Address (IP Address Assigned/Translated)", "Source IP Address"),
    "public_ip": ("Public IP Address",), "dest_ip": ("Destination IP Address",), "dest_port": ("Destination Port",), "user_id": ("User Id for internet Access based on authentication",),
    "mac": ("Source MAC-ID Address/Other device Identification number",), "imsi": ("IMSI",), "imei": ("IMEI",), "apn": ("Access Point Name",), "cell_id": ("CGI ID",),
    "date": ("Start Date of Public IP Address allocation (dd/mm/yyyy)", "Start Date of Public IP Address allocation"),
    "start_time": ("IST Start Time of Public IP address allocation (hh:mm:ss)", "IST Start Time"), "end_time": ("IST End Time of Public IP address allocation (hh:mm:ss)", "IST End Time"),
    "duration_sec": ("Session Duration",), "volume_up": ("Data Volume Up Link",), "volume_down": ("Data Volume Down Link",), "roaming_circle": ("Roaming Circle",),
    "is_static": ("Static/Dynamic IP Address Allocation",),
}
# Headers of plain session exports, in lower case, in order of preference.
PLAIN_SESSION = {
    "source_ip": ("source ip", "source ip address", "ip address", "ip", "public ip"), "dest_ip": ("destination ip", "dest ip"), "date": ("start date", "date", "f date", "start_date"),
    "start_time": ("start time", "time", "f time", "start_time", "time(ist)"), "msisdn": ("msisdn", "phone", "mobile"), "imsi": ("imsi",), "imei": ("imei",),
    "dest_port": ("destination port", "dest port"), "cell_id": ("cell id", "cell_id", "first cell id"), "end_time": ("end time", "t time", "end_time"), "duration_sec": ("session duration", "duration"),
}
SESSION_COLUMNS = ("msisdn", "imsi", "imei", "user_id", "mac", "source_ip", "public_ip", "dest_ip", "dest_port", "apn", "cell_id", "date", "start_time", "end_time", "duration_sec",
                   "volume_up", "volume_down", "roaming_circle", "is_static")


def _sessions(t: DataFrame, names: dict[str, tuple[str, ...]], operator: str, source_format: str) -> DataFrame:
    """Rows of a session table under canonical names; values that a layout lacks are null, amounts 0."""
    v = {k: cell(*names[k]) if k in names else F.lit(None).cast("string") for k in SESSION_COLUMNS}
    shape = {"msisdn": ids.phone, "imsi": ids.device, "imei": ids.device, "source_ip": ids.ip, "public_ip": ids.ip, "dest_ip": ids.ip, "date": clock.parse_date, "start_time": clock.parse_time,
             "end_time": clock.parse_time} | {k: lambda c: F.coalesce(F.floor(c.try_cast("double")).cast("long"), F.lit(0).cast("long")) for k in ("duration_sec", "volume_up", "volume_down")}
    raw = t.select("file", "line", *[c.alias(k) for k, c in v.items()])
    out = raw.select("file", "line", *[(shape[k](F.col(k)) if k in shape else F.col(k)).alias(k) for k in SESSION_COLUMNS])
    start, end = clock.to_epoch(F.col("date"), F.col("start_time")), clock.to_epoch(F.col("date"), F.col("end_time"))
    return out.select(F.concat_ws("_", F.lit("ipdr"), F.substring(F.sha2("file", 256), 1, 8), F.col("line").cast("string")).alias("ipdr_id"), F.lit(operator).alias("operator"), "*",
                      start.alias("start_ts"), F.coalesce(end, start + F.col("duration_sec")).alias("end_ts"), F.lit(source_format).alias("source_format"))


def read_provider_sessions(texts: DataFrame) -> DataFrame:
    """The provider's 24-column export: the header line is the first whose first cell names the landline or subscriber."""
    head = F.contains(F.lower(F.col("cells")[0]), F.lit("landline"))
    return _sessions(table(cells(texts), head), PROVIDER_SESSION, "Jio", "jio_ipv6").where("date is not null")


def read_plain_sessions(texts: DataFrame) -> DataFrame:
    """Any table of sessions with a column for the source address; rows whose address does not look like one are left out."""
    low = cells(texts)
    head = F.exists("cells", lambda x: F.lower(x).isin(*PLAIN_SESSION["source_ip"])) & (F.size("cells") >= 2)
    t = table(low, head).withColumn("row", F.transform_keys("row", lambda k, _: F.lower(k)))
    return _sessions(t, PLAIN_SESSION, "Unknown", "ipdr_csv").where(F.col("source_ip").rlike("^[0-9A-Fa-f:.]+"))


def read_subscribers(texts: DataFrame) -> DataFrame:
    """A header line and a line of values: one subscriber for each line of values."""
    head = F.exists("cells", lambda x: F.lower(x) == "msisdn")
    t = table(cells(texts), head).withColumn("row", F.transform_keys("row", lambda k, _: F.lower(k)))
    v = lambda *names: cell(*names)
    joined = lambda *names: F.nullif(F.trim(F.concat_ws(" ", *[cell(n) for n in names])), F.lit(""))
    extra = ("father name", "date of birth", "identification type", "identification number", "gender", "alternate number", "activation date", "sim type", "mobile imsi")
    notes = F.array_join(F.filter(F.array(*[F.when(cell(n).isNotNull(), F.concat(F.lit(n + "="), cell(n))) for n in extra]), lambda x: x.isNotNull()), "; ")
    return t.where(v("msisdn").isNotNull()).select(
        F.concat_ws("_", F.lit("sub"), F.substring(F.sha2("file", 256), 1, 8), F.col("line").cast("string")).alias("sub_id"), ids.phone(v("msisdn")).alias("msisdn"),
        joined("first name", "last name").alias("subscriber_name"), ids.device(v("mobile imsi", "imsi")).alias("imsi"), ids.device(v("imei")).alias("imei"), v("circle id", "circle").alias("circle"),
        v("service type").alias("connection_type"), clock.parse_date(v("activation date")).alias("activation_date"),
        joined("subscriber address1", "subscriber address2", "subscriber address3", "subscriber address4").alias("address"), notes.alias("raw_meta"), F.col("file").alias("source_file"))


def load_calls(spark: SparkSession, path: str, layout_name: str) -> DataFrame:
    layout = next(x for x in LAYOUTS if x.name == layout_name)
    return read_calls(read_texts(spark, path), layout)
