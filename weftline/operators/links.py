"""Cross-dataset links: payments with calls and sessions, calls with sessions, payments with payments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.ids import phone_key, phone_lenient
from weftline.operators.bands import band_pairs, band_totals, first_in_band


def direction_amount() -> Column:
    """Credit of a credit row, debit otherwise."""
    return F.when(F.col("txn_type") == "C", F.col("credit")).otherwise(F.col("debit"))


def any_amount() -> Column:
    return F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), F.col("credit"), F.lit(0.0))


def _stack(df: DataFrame, keep: list, *cols: str | Column, name: str = "phone") -> DataFrame:
    """One row per distinct non-null value of ``cols``."""
    values = F.array_distinct(F.array_compact(F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])))
    return df.select(*keep, F.explode(values).alias(name))


def payment_phones(bank: DataFrame, norm=None) -> DataFrame:
    norm = norm or (lambda c: c)
    return _stack(bank, ["txn_id", "ts"], norm(F.col("sender_phone")), norm(F.col("receiver_phone")))


def call_phones(cdr: DataFrame, keep: list, norm=None) -> DataFrame:
    norm = norm or (lambda c: c)
    return _stack(cdr, keep, norm(F.col("a_number")), norm(F.col("b_number")))


def both_ends(cdr: DataFrame, *keep: str) -> DataFrame:
    """Each call under both of its numbers; a call to itself appears twice."""
    ends = F.array_compact(F.array("a_number", "b_number"))
    return cdr.select(*keep, F.explode(ends).alias("phone"))


def complained_accounts(complaints: DataFrame) -> DataFrame:
    """Distinct complained accounts. The complaint ledger grows with data, so the side of the join is
    left to adaptive execution rather than forced into a broadcast."""
    return complaints.where(F.col("account_no").isNotNull()).select("account_no").distinct()


def with_complaint_flag(df: DataFrame, complaints: DataFrame, out: str = "complained") -> DataFrame:
    flagged = complained_accounts(complaints).withColumn(out, F.lit(True))
    return df.join(flagged, "account_no", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def coincidences(case: Case, window: int = 3600, first: int = 20) -> DataFrame:
    """Payments whose receiver phone also makes calls, with the calls in the window around them."""
    calls = case.cdr.where(F.col("a_number").isNotNull())
    stats = (calls.groupBy(F.col("a_number").alias("receiver_phone"))
             .agg(F.count("ts").alias("phone_call_records"), F.count(F.lit(1)).alias("phone_contacts"))
             .where(F.col("phone_call_records") > 0))
    hits = case.bank.join(stats, "receiver_phone").select(
        "txn_id", F.col("receiver_phone").alias("phone"), "account_no", "date", "ts", "txn_type",
        direction_amount().alias("amount"), "mode", F.substring("narration", 1, 120).alias("narration"),
        "upi_id", "phone_call_records", "phone_contacts")
    events = calls.select(F.col("a_number").alias("phone"), "ts", "cdr_id", "call_type", "b_number", "duration_sec")
    near = first_in_band(hits, events, ["phone"], -window, window, first, "cdr_id",
                         ["call_type", "b_number", "duration_sec"])
    packed = near.groupBy("phone", "ts").agg(
        F.max("in_band").alias("window_count"),
        F.sort_array(F.collect_list(F.struct("pos", F.col("event_ts").alias("call_ts"), "cdr_id", "call_type",
                                             "b_number", "duration_sec"))).alias("window_hits"))
    return (hits.join(packed, ["phone", "ts"], "left")
            .withColumn("window_count", F.coalesce("window_count", F.lit(0))))


def fused_rows(case: Case, call_window: int = 300, session_window: int = 900, first: int = 10) -> DataFrame:
    """Payments with the distinct calls and sessions near them on either phone.

    Counts come from band totals on each phone; a call between the payment's own two phones would be
    counted twice, so the totals on the unordered phone pair are subtracted. Only the first ``first``
    linked records are ever materialised.
    """
    bank = case.bank
    points = payment_phones(bank, phone_key)
    calls = call_phones(case.cdr, ["cdr_id", "ts", "call_type", "duration_sec"], phone_key)
    near = first_in_band(points, calls, ["phone"], -call_window, call_window, first, "cdr_id",
                         ["call_type", "duration_sec"])
    linked = points.join(near, ["phone", "ts"])
    totals = (linked.where(F.col("pos") == 1).groupBy("txn_id").agg(F.sum("in_band").alias("__calls")))
    by_txn = W.partitionBy("txn_id").orderBy("event_ts", "cdr_id")
    shown = (linked.groupBy("txn_id", "cdr_id", "event_ts", "call_type", "duration_sec")
             .agg(F.min("phone").alias("phone"))
             .withColumn("n", F.row_number().over(by_txn)).where(F.col("n") <= first)
             .groupBy("txn_id").agg(F.sort_array(F.collect_list(
                 F.struct("n", "cdr_id", F.col("event_ts").alias("call_ts"), "call_type", "duration_sec", "phone")))
                 .alias("linked_calls")))

    s, r = phone_key(F.col("sender_phone")), phone_key(F.col("receiver_phone"))
    pair_points = bank.select("txn_id", "ts", F.least(s, r).alias("p"), F.greatest(s, r).alias("q")).where("p <> q")
    a, b = phone_key(F.col("a_number")), phone_key(F.col("b_number"))
    pair_calls = case.cdr.select("ts", F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).where("p <> q")
    twice = band_totals(pair_points, pair_calls, ["p", "q"], {"__twice": (-call_window, call_window, "n")})
    twice = pair_points.join(twice.where("__twice > 0"), ["p", "q", "ts"]).select("txn_id", "__twice")

    sessions = case.ipdr.select(phone_key(F.col("msisdn")).alias("phone"), F.col("start_ts").alias("ts"),
                                "ipdr_id", "source_ip", "duration_sec")
    near_s = first_in_band(points, sessions, ["phone"], -session_window, session_window, first, "ipdr_id",
                           ["source_ip", "duration_sec"])
    linked_s = points.join(near_s, ["phone", "ts"])
    by_txn_s = W.partitionBy("txn_id").orderBy("event_ts", "ipdr_id")
    shown_s = (linked_s.withColumn("n", F.row_number().over(by_txn_s))
               .groupBy("txn_id").agg(
                   F.sum(F.when(F.col("pos") == 1, F.col("in_band"))).alias("ipdr_count"),
                   F.sort_array(F.collect_list(F.when(F.col("n") <= first, F.struct(
                       "n", "ipdr_id", F.col("event_ts").alias("session_ts"), "source_ip", "duration_sec"))))
                   .alias("linked_sessions")))

    zero = F.lit(0).cast("long")
    out = (with_complaint_flag(bank, case.complaints)
           .join(totals, "txn_id", "left").join(shown, "txn_id", "left")
           .join(twice, "txn_id", "left").join(shown_s, "txn_id", "left"))
    return out.select(
        F.col("txn_id").alias("transaction_id"), "date", "time", "ts", "mode", direction_amount().alias("amount"),
        F.col("txn_type").alias("direction"), "account_no", "account_name", "bank", "counterparty_name",
        "counterparty_bank", "receiver_account", "sender_phone", "receiver_phone", "linked_calls",
        (F.coalesce("__calls", zero) - F.coalesce("__twice", zero)).alias("call_count"),
        "linked_sessions", F.coalesce("ipdr_count", zero).alias("ipdr_count"), "complained")


def fused_page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest first, rows without a time last."""
    return rows.orderBy(F.col("ts").desc_nulls_last(), "transaction_id").offset(offset).limit(limit)


def fused_filter(rows: DataFrame, q: str = "", account: str = "", mode: str = "", date_start: str = "",
                 date_end: str = "", min_amount: float = 0.0, max_amount: float = 0.0,
                 risk_band: str = "", scored: DataFrame | None = None) -> DataFrame:
    def has(col, text):
        return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(text.strip().lower()))

    if account.strip():
        rows = rows.where(has(F.col("account_no"), account))
    if mode.strip() and mode.strip().lower() != "all":
        rows = rows.where(has(F.col("mode"), mode))
    if q.strip():
        hay = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (
            "transaction_id", "account_no", "account_name", "counterparty_name", "receiver_account",
            "sender_phone", "receiver_phone", "bank")])
        rows = rows.where(has(hay, q))
    if date_start:
        rows = rows.where(F.coalesce("date", F.lit("")) >= date_start)
    if date_end:
        rows = rows.where(F.coalesce("date", F.lit("")) <= date_end)
    amount = F.coalesce("amount", F.lit(0.0))
    if min_amount > 0:
        rows = rows.where(amount >= min_amount)
    if max_amount > 0:
        rows = rows.where(amount <= max_amount)
    if scored is not None:
        rows = rows.join(scored.select("transaction_id", "risk_score", F.col("risk_band")), "transaction_id", "left")
        if risk_band.strip() and risk_band.strip().lower() != "all":
            rows = rows.where(F.lower(F.coalesce("risk_band", F.lit("SAFE"))) == risk_band.strip().lower())
    return rows


def bank_call_links(case: Case, window: int = 300, pay: DataFrame | None = None, call: DataFrame | None = None) -> DataFrame:
    """Every (payment, call) pair on a shared phone within the window, with the smallest gap.

    A pair that shares several phones is kept on one of them, which both sides can tell from what they carry; so the
    pairs, which on busy phones grow with the square of the records, are never shuffled to be told apart. Nor are they
    to learn more of their ends: the rows of ``pay`` (by txn_id) and ``call`` (by cdr_id) travel with the ends, and the
    result is that of joining them to the pairs.
    """
    points = _with_all_phones(payment_phones(case.bank, phone_lenient), "txn_id", "ts", "__p")
    calls = _with_all_phones(call_phones(case.cdr, ["cdr_id", F.col("ts").alias("__ets")], phone_lenient), "cdr_id", "__ets", "__c")
    gap = F.abs(F.col("__ets") - F.col("ts"))
    on_first = F.col("phone") == F.array_min(F.array_intersect("__p.phone", "__c.phone"))
    # ids with rows at several times: the nearest of all their rows
    rows = F.flatten(F.transform("__p", lambda p: F.transform(
        F.filter("__c", lambda c: c["phone"] == p["phone"]), lambda c: F.struct(F.abs(c["at"] - p["at"]), p["phone"], p["at"], c["at"]))))
    nearest = F.struct(gap, F.col("phone"), F.col("ts"), F.col("__ets")) == F.array_min(rows)
    kept = F.when(F.col("__p_once") & F.col("__c_once"), on_first).otherwise(nearest)
    if pay is not None:
        points = points.join(_packed(pay, "txn_id", "__pay"), "txn_id")
    if call is not None:
        calls = calls.join(_packed(call, "cdr_id", "__call"), "cdr_id")
    found = band_pairs(points, calls, ["phone"], -window, window).where(kept)
    packs = [c for c in ("__pay", "__call") if c in found.columns]
    out = found.select("txn_id", "cdr_id", gap.alias("time_diff"), *packs)
    for c in packs:
        more = [n for n in out.columns if n != c]
        out = out.withColumn(c, F.explode(c)).select(*more, f"{c}.*")
    return out


def _packed(rows: DataFrame, row_id: str, out: str) -> DataFrame:
    """All rows of an id in one."""
    return rows.groupBy(row_id).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != row_id])).alias(out))


def _with_all_phones(rows: DataFrame, row_id: str, ts: str, out: str) -> DataFrame:
    """(id, phone, time) with all phones and times of the id, and whether it has one time only."""
    timed = rows.where(F.col(ts).isNotNull())
    by_id = timed.groupBy(row_id).agg(F.collect_set(F.struct("phone", F.col(ts).alias("at"))).alias(out), (F.min(ts) == F.max(ts)).alias(f"{out}_once"))
    return by_id.select(row_id, out, f"{out}_once", F.explode(out).alias("__row")).select(
        row_id, out, f"{out}_once", F.col("__row.phone").alias("phone"), F.col("__row.at").alias(ts))


def call_session_links(case: Case, window: int = 900) -> DataFrame:
    """(call, session) rows for every shared SIM, device or number within the window."""
    sess = _stack(case.ipdr, ["ipdr_id", F.col("start_ts").alias("ts")], "imsi", "imei", "msisdn", name="key")
    calls = _stack(case.cdr, ["cdr_id", F.col("ts").alias("__ets")], "imsi", "imei", name="key")
    return (band_pairs(sess, calls, ["key"], -window, window)
            .select("cdr_id", "ipdr_id", "key", F.abs(F.col("__ets") - F.col("ts")).alias("time_diff")))


def call_session_pairs(case: Case, window: int) -> DataFrame:
    return call_session_links(case, window).select("cdr_id", "ipdr_id").distinct()


def _units(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(id, ts, plain, unit): an id under each of its keys and each pair of them. ``plain``: it has one time only, and
    at most ``most`` keys."""
    ids = rows.where(F.col("ts").isNotNull()).groupBy("id").agg(
        F.sort_array(F.collect_set("key")).alias("keys"), F.min("ts").alias("ts"), F.max("ts").alias("last"))
    plain = (F.col("ts") == F.col("last")) & (F.size("keys") <= most if most else F.lit(True))
    alone = F.transform("keys", lambda k: F.array(k))
    two = F.flatten(F.transform("keys", lambda k: F.transform(F.filter("keys", lambda m: m > k), lambda m: F.array(k, m))))
    return ids.select("id", "ts", plain.alias("plain"), "keys", F.concat(alone, two).alias("units"))


def pair_counts(points: DataFrame, events: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(window_sec, pairs): distinct pairs of ids that share a key within each window, counted without forming them.

    Both sides hold (id, ts, key) rows. A pair is counted under each shared key and taken off under each shared pair of
    keys, which is right as long as one side has at most two keys. Ids with several times, and events with more keys,
    are few; only their pairs are formed.
    """
    p, e = _units(points), _units(events, 2)
    frames = {f"w{w}": (-w, w, "n") for w in windows}
    asked = p.where("plain").select("ts", F.explode("units").alias("unit"))
    totals = band_totals(asked, e.where("plain").select("ts", F.explode("units").alias("unit")), ["unit"], frames)
    sign = F.when(F.size("unit") == 1, F.col("times")).otherwise(-F.col("times"))
    counted = (asked.groupBy("unit", "ts").agg(F.count(F.lit(1)).alias("times")).join(totals, ["unit", "ts"])
               .agg(*[F.sum(F.col(n) * sign).alias(n) for n in frames]))
    odd_p, odd_e = (rows.join(side.where(~F.col("plain")).select(F.col("id").alias("odd")), F.col("id").eqNullSafe(F.col("odd")), "left_semi")
                    for rows, side in ((points, p), (events, e)))
    usual = p.where("plain").select("id", "ts", F.explode("keys").alias("key"))
    found = None
    for left, right in ((odd_p, events), (usual, odd_e)):
        near = band_pairs(left, right.select(F.col("id").alias("other"), F.col("ts").alias("__ets"), "key"), ["key"], -max(windows), max(windows))
        near = near.select("id", "other", F.abs(F.col("__ets") - F.col("ts")).alias("gap"))
        found = near if found is None else found.unionByName(near)
    formed = found.groupBy("id", "other").agg(F.min("gap").alias("gap")).agg(
        *[F.count_if(F.col("gap") <= w).alias(f"w{w}") for w in windows])
    rows = counted.unionByName(formed).agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in frames])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window_sec"), F.col(f"w{w}").alias("pairs")) for w in windows])).alias("x")).select("x.*")


def bank_call_pair_counts(case: Case, windows: tuple[int, ...]) -> DataFrame:
    """Number of ``bank_call_links`` in each window."""
    points = payment_phones(case.bank, phone_lenient).toDF("id", "ts", "key")
    return pair_counts(points, call_phones(case.cdr, ["cdr_id", "ts"], phone_lenient).toDF("id", "ts", "key"), windows)


def call_session_pair_counts(case: Case, windows: tuple[int, ...]) -> DataFrame:
    """Number of ``call_session_pairs`` in each window."""
    sess = _stack(case.ipdr, ["ipdr_id", F.col("start_ts").alias("ts")], "imsi", "imei", "msisdn", name="key").toDF("id", "ts", "key")
    return pair_counts(sess, _stack(case.cdr, ["cdr_id", "ts"], "imsi", "imei", name="key").toDF("id", "ts", "key"), windows)


def timeline(case: Case) -> DataFrame:
    """Payments, calls and sessions with a usable time as one event table."""
    none = F.lit(None)
    pay = case.bank.where("ts is not null").select(
        "ts", "date", "time", F.lit("bank").alias("kind"), F.col("txn_id").alias("record_id"),
        F.col("account_no").alias("entity"), F.substring("narration", 1, 80).alias("label"),
        F.coalesce(F.when(F.col("credit") != 0, F.col("credit")), F.col("debit")).alias("amount"),
        F.when(F.col("txn_type") == "C", "C").otherwise("D").alias("direction"),
        "mode", F.col("receiver_phone").alias("phone"), "upi_id")
    call = case.cdr.where("ts is not null").select(
        "ts", "date", "time", F.lit("cdr").alias("kind"), F.col("cdr_id").alias("record_id"),
        F.col("a_number").alias("entity"),
        F.concat_ws(" ", F.coalesce("call_type", F.lit("")), F.coalesce("b_number", F.lit(""))).alias("label"),
        none.cast("double").alias("amount"), F.col("call_type").alias("direction"),
        F.col("service_type").alias("mode"), F.col("b_number").alias("phone"), none.cast("string").alias("upi_id"))
    sess = case.ipdr.where("start_ts is not null").select(
        F.col("start_ts").alias("ts"), "date", F.col("start_time").alias("time"), F.lit("ipdr").alias("kind"),
        F.col("ipdr_id").alias("record_id"), F.col("msisdn").alias("entity"), F.col("source_ip").alias("label"),
        none.cast("double").alias("amount"), none.cast("string").alias("direction"), F.lit("IPDR").alias("mode"),
        F.col("msisdn").alias("phone"), none.cast("string").alias("upi_id"))
    return pay.unionByName(call).unionByName(sess)


def timeline_slice(events: DataFrame, kind: str | None = None, since: int | None = None,
                   until: int | None = None, limit: int | None = None) -> DataFrame:
    if kind:
        events = events.where(F.col("kind") == kind)
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if limit:
        events = events.orderBy("ts", "kind", "record_id").limit(limit)
    return events


def events_around(events: DataFrame, window: int = 1800, per_kind: int = 20, nearest: int = 25) -> DataFrame:
    """For every event: the first ``per_kind`` events of each dataset in the window, then the nearest overall.

    The dataset name is the band key, so three hot keys; rank lookup inside (dataset, time bucket) keeps
    the output at ``3 * per_kind`` rows a moment and never forms the pairs that are cut away.
    """
    moments = events.select("ts").distinct()
    kinds = F.array(*map(F.lit, ("bank", "cdr", "ipdr")))
    points = moments.withColumn("kind", F.explode(kinds))
    near = (first_in_band(points, events.select("kind", "ts", "record_id"), ["kind"], -window, window, per_kind,
                          "record_id", [])
            .withColumn("gap", F.abs(F.col("event_ts") - F.col("ts"))).where("gap > 0"))
    w = W.partitionBy("ts").orderBy("gap", "kind", "record_id")
    best = (near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)
            .select("ts", "rank", "gap", F.col("kind").alias("near_kind"), F.col("record_id").alias("near_id")))
    return events.select("kind", "record_id", "ts").join(best, "ts")


def payment_timeline(case: Case, window: int = 3600, first: int = 12) -> DataFrame:
    """Calls and sessions of the sender phone around each payment, earliest ``first`` rows."""
    bank = case.bank.where("sender_phone is not null and ts is not null")
    points = bank.select(F.col("sender_phone").alias("phone"), "ts")
    calls = call_phones(case.cdr, [F.lit("call").alias("kind"), F.col("cdr_id").alias("ref"), "ts",
                                   F.concat("a_number", F.lit(" -> "), "b_number", F.lit(" ("),
                                            F.col("duration_sec").cast("string"), F.lit("s)")).alias("detail")])
    sess = case.ipdr.select(F.lit("session").alias("kind"), F.col("ipdr_id").alias("ref"),
                            F.col("start_ts").alias("ts"),
                            F.concat("msisdn", F.lit(" @ "), F.coalesce("source_ip", F.lit("?"))).alias("detail"),
                            F.col("msisdn").alias("phone"))
    near = first_in_band(points, calls.unionByName(sess), ["phone"], -window, window, first, "ref",
                         ["kind", "detail"])
    return (bank.select("txn_id", F.col("sender_phone").alias("phone"), "ts").join(near, ["phone", "ts"])
            .select("txn_id", "pos", "kind", "event_ts", "ref", "detail"))


def payment_neighbours(bank: DataFrame, window: int = 3600, first: int = 6) -> DataFrame:
    """Other payments of the same customer around each payment, earliest ``first``.

    One more than needed is fetched because the payment itself may be among them.
    """
    rows = bank.where("ts is not null").select(
        F.coalesce("customer_id", "account_no").alias("customer"), "ts", "txn_id", any_amount().alias("amount"))
    near = first_in_band(rows.select("customer", "ts"), rows.select("customer", "ts", F.col("txn_id").alias("other_id"),
                                                                    F.col("amount").alias("other_amount")),
                         ["customer"], -window, window, first + 1, "other_id", ["other_amount"])
    w = W.partitionBy("txn_id").orderBy("pos")
    return (rows.drop("amount").join(near, ["customer", "ts"]).where("other_id <> txn_id")
            .withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
            .select("txn_id", "n", "other_id", "other_amount", F.col("event_ts").alias("other_ts")))


def relationship_links(txns: DataFrame, window_min: int = 30) -> DataFrame:
    """Pairwise links among a *selection* of payments, one row a pair with all its reasons.

    Each row carries what its reasons need, so a pair is kept by the first of the joins that finds it, with the others'
    reasons worked out on the spot: no pair is ever shuffled. Ids with several rows are few; their pairs are grouped.
    """
    a = txns.select(F.col("txn_id").alias("a"), F.col("account_no").alias("a_acc"), F.col("ts").alias("a_ts"),
                    F.col("receiver_account").alias("a_recv"), F.col("sender_phone").alias("a_phone"),
                    F.coalesce("debit", "credit").alias("a_amt"))
    a = a.join(a.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("a_many")), "a")
    b = a.select(*[F.col(c).alias("b" + c[1:]) for c in a.columns])
    w = window_min * 60
    is_true = lambda c: F.coalesce(c, F.lit(False))
    same = lambda x, y: is_true(F.col(x) == F.col(y))

    def flow(x, y):
        return F.concat(F.format_string("%.0f", F.col(f"{x}_amt")), F.lit(" flows "), x, F.lit(" -> "), y)

    reason = lambda met, order, kind, detail: F.when(met, F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), detail.alias("detail")))
    pays, paid, account, phone = same("a_recv", "b_acc"), same("b_recv", "a_acc"), same("a_acc", "b_acc"), same("a_phone", "b_phone")
    near = is_true(F.abs(F.col("a_ts") - F.col("b_ts")) <= w)
    reasons = F.sort_array(F.array_compact(F.array(
        reason(pays, 1, "money", flow("a", "b")), reason(paid, 1, "money", flow("b", "a")),
        reason(account, 2, "shared", F.concat(F.lit("same account "), "a_acc")),
        reason(phone, 3, "shared", F.concat(F.lit("same phone "), "a_phone")),
        reason(near, 4, "time", F.lit(f"within {window_min} min")))))

    def timed(left, right):
        # a slice of the window each: the fewer seconds a bucket has, the more tasks share a crowded time
        step = max(1, w // 16)
        at = lambda c: F.floor(F.col(c) / step)
        left = left.withColumn("__slice", at("a_ts"))
        right = right.withColumn("__slice", F.explode(F.sequence(F.floor((F.col("b_ts") - w) / step), F.floor((F.col("b_ts") + w) / step))))
        return left.join(right, "__slice").where(near).drop("__slice")

    def pairs(left, right):
        found = [timed(left, right), left.join(right, F.col("a_recv") == F.col("b_acc")).where(~near),
                 left.join(right, F.col("b_recv") == F.col("a_acc")).where(~near & ~pays),
                 left.join(right, F.col("a_acc") == F.col("b_acc")).where(~near & ~pays & ~paid),
                 left.join(right, F.col("a_phone") == F.col("b_phone")).where(~near & ~pays & ~paid & ~account)]
        return reduce(DataFrame.unionByName, [f.where("a < b") for f in found]).select(
            F.col("a").alias("source"), F.col("b").alias("target"), reasons.alias("r"))

    once = pairs(a.where("not a_many"), b.where("not b_many"))
    more = pairs(a.where("a_many"), b).unionByName(pairs(a.where("not a_many"), b.where("b_many")))
    more = more.groupBy("source", "target").agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("r"))
    return once.unionByName(more).select(
        "source", "target", F.col("r.kind").alias("kinds"), F.col("r")[0]["kind"].alias("kind"), F.size("r").alias("strength"), F.col("r.detail").alias("details"))


def rapid_in_out(bank: DataFrame, window_min: int = 15, limit: int = 100, share: float = 0.95) -> DataFrame:
    """Credits followed within the window by the first debit of at least 95 % on the same account."""
    rows = bank.where("ts is not null and account_no is not null")
    credits = rows.where("credit > 0").select("account_no", "ts", F.col("txn_id").alias("in_txn"),
                                              F.col("credit").alias("in_amount"), F.col("mode").alias("in_mode"))
    debits = rows.where("debit > 0").select("account_no", F.col("ts").alias("__ets"), F.col("txn_id").alias("out_txn"),
                                            F.col("debit").alias("out_amount"), F.col("mode").alias("out_mode"))
    # one row per second with its largest debit: a credit meets at most the window's seconds, not its debits
    seconds = debits.groupBy("account_no", "__ets").agg(F.max("out_amount").alias("top"))
    hits = band_pairs(credits, seconds, ["account_no"], 1, window_min * 60).where(F.col("top") >= F.col("in_amount") * share)
    when = hits.groupBy("account_no", "in_txn", "in_amount", "in_mode", F.col("ts").alias("in_ts")).agg(F.min("__ets").alias("__ets"))
    match = when.join(debits, ["account_no", "__ets"]).where(F.col("out_amount") >= F.col("in_amount") * share)
    first = match.groupBy("in_txn").agg(F.min_by(F.struct(
        "account_no", "in_ts", F.col("__ets").alias("out_ts"), "in_amount", "out_amount", "out_txn", F.coalesce("in_mode", "out_mode").alias("mode")), "out_txn").alias("h"))
    out = first.select("in_txn", "h.*").withColumn("latency", F.col("out_ts") - F.col("in_ts"))
    return out.orderBy("latency", "in_txn").limit(limit) if limit else out


def shared_device_phones(cdr: DataFrame, top: int = 10) -> DataFrame:
    """Other phones that used one of a phone's devices, by number of records; ties by phone.

    Phones with the same set of devices have the same totals, so these are formed once for each distinct set: for a
    device that a crowd uses alone, one list serves the whole crowd. Sets are told apart by their size and two sums of
    64-bit hashes and never gathered. Only the first ``top + 1`` phones of a set can be listed for one of its members.
    """
    use = (cdr.where("a_number is not null and imei is not null")
           .groupBy("imei", F.col("a_number").alias("phone")).agg(F.count(F.lit(1)).alias("records")))
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)")).cast("string")
    member = use.groupBy("phone").agg(F.concat_ws("/", F.count(F.lit(1)), wide(F.col("imei")), wide(F.lit("second"), F.col("imei"))).alias("devices"))
    one = member.groupBy("devices").agg(F.min("phone").alias("phone"))
    totals = (one.join(use.select("phone", "imei"), "phone").select("devices", "imei")
              .join(use, "imei").groupBy("devices", F.col("phone").alias("other")).agg(F.sum("records").alias("records")))
    w = W.partitionBy("devices").orderBy(F.desc("records"), "other")
    best = totals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top + 1)
    by_phone = W.partitionBy("phone").orderBy("place")
    return (member.join(best, "devices").where("phone <> other").withColumn("rank", F.row_number().over(by_phone))
            .where(F.col("rank") <= top).select("phone", "other", "records", "rank"))


def missing_links(case: Case, limit: int = 10) -> DataFrame:
    """Statement phones that never call, and callers without data sessions."""
    said = case.bank.select(F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("phone"))
    callers = case.cdr.where("a_number is not null").select(F.col("a_number").alias("phone")).distinct()
    online = case.ipdr.where("msisdn is not null").select(F.col("msisdn").alias("phone")).distinct()
    no_calls = said.distinct().join(callers, "phone", "left_anti").orderBy("phone").limit(limit)
    offline = callers.join(online, "phone", "left_anti").orderBy("phone").limit(limit)
    return (no_calls.select(F.lit("no_call_records").alias("gap"), "phone")
            .unionByName(offline.select(F.lit("no_data_sessions").alias("gap"), "phone")))


def payment_sessions(case: Case, window: int = 300, session_window: int = 900) -> DataFrame:
    """Device and address behind each payment: payment, linked call, linked session, session row.

    Calls take up their sessions before they meet the payments, and travel with the ends of the links; so no link is
    shuffled. Payments without a link, found by counting, follow with empty columns, as do links to calls without an id.
    """
    pay = case.bank.select("txn_id", "account_no")
    sess = case.ipdr.select("ipdr_id", "source_ip", F.col("imei").alias("session_imei"))
    calls = (case.cdr.where("cdr_id is not null").select("cdr_id", F.col("imei").alias("call_imei"), F.col("imsi").alias("call_imsi"))
             .join(call_session_pairs(case, session_window), "cdr_id", "left").join(sess, "ipdr_id", "left"))
    linked = bank_call_links(case, window, pay=pay, call=calls).drop("time_diff")
    points = payment_phones(case.bank, phone_lenient)
    totals = band_totals(points, call_phones(case.cdr, ["ts"], phone_lenient), ["phone"], {"n": (-window, window, "n")})
    met = points.join(totals.where("n > 0"), ["phone", "ts"]).select("txn_id").distinct()
    unnamed = Case(case.bank, case.cdr.where("cdr_id is null"), case.ipdr, case.complaints, case.subscribers)
    bare = pay.join(met, "txn_id", "left_anti").unionByName(bank_call_links(unnamed, window, pay=pay).select(*pay.columns))
    none = F.lit(None).cast("string")
    cols = [*pay.columns, "cdr_id", "call_imei", "call_imsi", "ipdr_id", "source_ip", "session_imei"]
    return linked.select(*cols).unionByName(bare.select(*pay.columns, *[none.alias(c) for c in cols[2:]]))


SPAN = 3600


def _device_spans(case: Case, window: int, session_window: int) -> DataFrame:
    """(phone, device, bucket, lo, hi): the seconds within ``window`` of a phone's calls that a device's sessions are
    linked to, as spans that do not overlap, cut at every full ``SPAN`` seconds."""
    sess = case.ipdr.select("ipdr_id", F.struct("source_ip", F.col("imei").alias("session_imei")).alias("device"))
    seen = call_session_pairs(case, session_window).join(sess, "ipdr_id").select("cdr_id", "device").distinct()
    at = call_phones(case.cdr.where("ts is not null"), ["cdr_id", "ts"], phone_lenient).join(seen, "cdr_id").select("phone", "device", "ts").distinct()
    w = W.partitionBy("phone", "device").orderBy("ts")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= 2 * window, 0).otherwise(1)
    spans = (at.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
             .groupBy("phone", "device", "span").agg((F.min("ts") - window).alias("lo"), (F.max("ts") + window).alias("hi")))
    bucket = lambda c: F.floor(F.col(c) / SPAN).cast("long")
    return (spans.select("phone", "device", "lo", "hi", F.explode(F.sequence(bucket("lo"), bucket("hi"))).alias("bucket"))
            .select("phone", "device", "bucket", F.greatest("lo", F.col("bucket") * SPAN).alias("lo"),
                    F.least("hi", F.col("bucket") * SPAN + SPAN - 1).alias("hi")))


def payments_by_device(case: Case, window: int = 300, session_window: int = 900) -> DataFrame:
    """(source_ip, session_imei, payments): payments with a linked call that has a linked session of the device.

    The payments in a device's spans are counted from running totals on each phone, less those that lie in spans of both of
    their phones, so neither links nor (payment, device) rows are formed. That holds for ids with one time and at most two
    phones; the devices of other ids, if any, are listed.
    """
    spans = _device_spans(case, window, session_window)
    stacked = payment_phones(case.bank.where("txn_id is not null and ts is not null"), phone_lenient)
    first = case.bank.groupBy("txn_id").agg(F.min(phone_lenient(F.col("sender_phone"))).alias("sender"))
    ids = (stacked.groupBy("txn_id").agg(F.collect_set("phone").alias("phones"), F.min("ts").alias("ts"), F.max("ts").alias("last"))
           .withColumn("plain", (F.col("ts") == F.col("last")) & (F.size("phones") <= 2))
           .withColumn("bucket", F.floor(F.col("ts") / SPAN).cast("long")))
    plain = ids.where("plain")
    # the sender first: receivers are rather shared by many
    pair = (plain.where(F.size("phones") == 2).join(first, "txn_id")
            .withColumn("a", F.when(F.array_contains("phones", F.col("sender")), F.col("sender")).otherwise(F.col("phones")[0]))
            .select(F.array("a", F.array_except("phones", F.array("a"))[0]).alias("unit"), "bucket", "ts"))
    alone = plain.select(F.explode("phones").alias("phone"), "bucket", "ts").select(F.array("phone").alias("unit"), "bucket", "ts")
    paid = alone.unionByName(pair).groupBy("unit", "bucket", F.col("ts").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    other = spans.select(F.col("phone").alias("b"), "device", "bucket", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    both = (pair.select("unit", "bucket", F.col("unit")[0].alias("phone"), F.col("unit")[1].alias("b")).distinct()
            .join(spans, ["phone", "bucket"]).join(other, ["b", "bucket", "device"])
            .select("unit", "bucket", "device", F.greatest("lo", "lo_b").alias("lo"), F.least("hi", "hi_b").alias("hi")).where("lo <= hi"))
    asked = spans.select(F.array("phone").alias("unit"), "bucket", "device", "lo", "hi").unionByName(both)
    sign = F.when(F.size("unit") == 1, 1).otherwise(-1)
    ends = asked.select("unit", "bucket", "device", F.explode(F.array(
        F.struct(F.col("hi").alias("at"), sign.alias("sign")), F.struct((F.col("lo") - 1).alias("at"), (-sign).alias("sign")))).alias("e")).select("unit", "bucket", "device", "e.*")
    rows = paid.unionByName(ends.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    run = F.sum("n").over(W.partitionBy("unit", "bucket").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    counted = rows.withColumn("run", run).where("sign is not null").groupBy("device").agg(F.sum(F.col("run") * F.col("sign")).alias("payments"))
    rest = stacked.join(ids.where(~F.col("plain")).select("txn_id"), "txn_id", "left_semi").withColumn("bucket", F.floor(F.col("ts") / SPAN).cast("long"))
    listed = (rest.join(spans, ["phone", "bucket"]).where("ts between lo and hi").select("device", "txn_id").distinct()
              .groupBy("device").agg(F.count(F.lit(1)).alias("payments")))
    return (counted.where("payments > 0").unionByName(listed).groupBy("device").agg(F.sum("payments").alias("payments"))
            .select("device.source_ip", "device.session_imei", "payments"))


def complaint_payments(complaints: DataFrame, legs: DataFrame) -> DataFrame:
    """Complaints with every payment in which the account pays or is paid, or none.

    Two equi joins instead of one OR join; an account paying itself is kept once.
    """
    c = complaints.select("complaint_id", "account_no", "state")
    sides = legs.select("txn_id", "amount", "date", F.explode(F.array_distinct(F.array_compact(
        F.array("sender_account", "receiver_account")))).alias("account_no"))
    return c.join(sides, "account_no", "left")


def related_payments(bank: DataFrame, limit: int = 40) -> DataFrame:
    """Payments related to each payment by account, receiver, counterparty or day.

    ``reasons`` are collected per pair; the first ``limit`` in time order are kept. Of each key only the first
    ``limit + 1`` payments are candidates; they are one list, which meets the payments of the key and is merged inside the
    row, so candidates are never shuffled one by one. A list that has enough candidates is cut before it travels on.
    """
    from weftline.operators.ordering import with_position

    timed = bank.where("ts is not null")
    reasons = {
        "same_account": ("account_no", ["account_no"]), "same_receiver": ("receiver_account", ["receiver_account", "account_no"]),
        "same_counterparty": ("counterparty_name", ["counterparty_name"]), "same_day": ("date", ["date"]),
    }
    many = timed.groupBy("txn_id").agg((F.count(F.lit(1)) > 1).alias("many"))
    rows = timed.select("txn_id", *[F.col(asks).alias(reason) for reason, (asks, _) in reasons.items()]).join(many, "txn_id")
    rows = rows.withColumn("found", F.array().cast("array<struct<other_ts:bigint,other_id:string,why:string>>"))
    # where a candidate begins among the sorted entries, of which it has one a reason
    fresh = lambda x, i: (i == 0) | (F.struct(x["other_ts"], x["other_id"]) != F.struct(*[F.get("found", i - 1)[c] for c in ("other_ts", "other_id")]))
    starts = F.array_compact(F.transform("found", lambda x, i: F.when(fresh(x, i), i)))
    for reason, (_, offers) in reasons.items():
        offered = timed.select("txn_id", F.col("ts").cast("long").alias("ts"), F.explode(F.array_distinct(F.array_compact(F.array(*offers)))).alias("key"))
        early = with_position(offered, ["key"], "txn_id").where(F.col("pos") <= limit).groupBy(F.col("key").alias(reason)).agg(
            F.collect_list(F.struct(F.col("ts").alias("other_ts"), F.col("txn_id").alias("other_id"), F.lit(reason).alias("why"))).alias("list"))
        more = F.filter("list", lambda x: x["other_id"] != F.col("txn_id"))
        rows = (rows.join(early, reason, "left").withColumn("found", F.sort_array(F.when(F.col("list").isNull(), F.col("found")).otherwise(F.concat("found", more))))
                .drop(reason, "list").withColumn("starts", starts)
                .withColumn("found", F.when(F.size("starts") > limit, F.slice("found", 1, F.get("starts", limit))).otherwise(F.col("found"))).drop("starts"))
    # a payment of several rows has the candidates of all of them
    grouped = rows.where("many").groupBy("txn_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    rows = rows.where("not many").select("txn_id", "found").unionByName(grouped).withColumn("starts", F.slice(starts, 1, limit))
    same = lambda x, y: (x["other_id"] == y["other_id"]) & (x["other_ts"] == y["other_ts"])
    why = lambda i: F.transform(F.filter(F.slice("found", i + 1, len(reasons)), lambda y: same(y, F.get("found", i))), lambda y: y["why"])
    out = rows.select("txn_id", F.posexplode(F.transform("starts", lambda i: F.struct(
        F.get("found", i)["other_id"].alias("other_id"), F.get("found", i)["other_ts"].alias("other_ts"), why(i).alias("reasons")))).alias("n", "x"))
    return out.select("txn_id", "x.*", (F.col("n") + 1).alias("n"))


def investigation_calls(case: Case, suspicious: DataFrame, risky: DataFrame, window: int = 3600) -> DataFrame:
    """Calls worth a look: an endpoint is a risky phone, or a suspicious payment is close in time.

    ``suspicious`` has txn_id, ts, sender_phone, receiver_phone; ``risky`` has phone. The payment side is
    only counted per phone and second, so a busy phone costs no pairs.
    """
    pay = _stack(suspicious, ["txn_id", "ts"], "sender_phone", "receiver_phone")
    ends = call_phones(case.cdr.where("ts is not null"), ["cdr_id", "ts"])
    totals = band_totals(ends, pay, ["phone"], {"near_payments": (-window, window, "n")})
    near = ends.join(totals.where("near_payments > 0"), ["phone", "ts"]).groupBy("cdr_id").agg(
        F.sum("near_payments").alias("near_payments"))
    flagged = ends.join(risky.select("phone").distinct(), "phone").groupBy("cdr_id").agg(
        F.sort_array(F.collect_set("phone")).alias("risky_phones"))
    rows = case.cdr.join(near, "cdr_id", "left").join(flagged, "cdr_id", "left")
    rows = rows.where("near_payments is not null or risky_phones is not null")
    evidence = F.array_compact(F.array(
        F.when(F.col("risky_phones").isNotNull(), F.concat(F.lit("high-risk phone "), F.array_join("risky_phones", ", "))),
        F.when(F.col("near_payments") > 0, F.concat(F.col("near_payments").cast("string"),
                                                    F.lit(f" suspicious payment(s) within {window // 60} min")))))
    return rows.select("cdr_id", "a_number", "b_number", "ts", "duration_sec",
                       F.coalesce("near_payments", F.lit(0)).alias("near_payments"), evidence.alias("evidence"))


def finding_hits(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """Case findings with scored payments whose id or account occurs anywhere in the title.

    The substring test becomes an equi join: titles are cut into all pieces as long as some identifier.
    Only the distinct identifier lengths, a handful of numbers, reach the driver.
    """
    cols = ["transaction_id", "account_no", "risk_score"]
    names = scored.select(*cols, F.explode(F.array_distinct(F.array_compact(
        F.array("transaction_id", "account_no")))).alias("piece"))
    lengths = [r[0] for r in names.select(F.length("piece").alias("n")).distinct().collect() if r[0]]
    if not lengths:
        return findings.select("finding_id", "title").join(scored.select(*cols).limit(0))
    size = F.length("title")

    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), size - n + 1)
        return F.when(size >= n, F.transform(starts, lambda i: F.substring(F.col("title"), i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    cuts = [cut(n) for n in lengths]
    pieces = findings.select("finding_id", "title", F.explode(F.array_distinct(F.concat(*cuts))).alias("piece"))
    return pieces.join(names, "piece").select("finding_id", "title", *cols).distinct()


def fill_names(vertices: DataFrame, bank: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Vertex label and phone: first holder name by time for accounts, subscriber name for phones."""
    holder = bank.where("account_name is not null").groupBy(F.col("account_no").alias("id")).agg(
        F.min_by("account_name", F.struct("ts", "txn_id")).alias("holder"),
        F.min_by("sender_phone", F.struct("ts", "txn_id")).alias("holder_phone"))
    subs = subscribers.where("subscriber_name is not null").groupBy(F.col("msisdn").alias("id")).agg(
        F.min_by("subscriber_name", "sub_id").alias("subscriber"))
    return (vertices.join(holder, "id", "left").join(subs, "id", "left")
            .withColumn("label", F.coalesce("holder", "subscriber"))
            .withColumn("phone", F.coalesce("holder_phone", F.when(F.col("subscriber").isNotNull(), F.col("id"))))
            .drop("holder", "holder_phone", "subscriber"))


def quick_risk(fused: DataFrame) -> DataFrame:
    """Cheap proxy: complaint 40, linked calls 20, linked sessions 10, at least 100 000 15."""
    pts = (F.when(F.col("complained"), 40).otherwise(0) + F.when(F.col("call_count") > 0, 20).otherwise(0)
           + F.when(F.col("ipdr_count") > 0, 10).otherwise(0)
           + F.when(F.coalesce("amount", F.lit(0.0)) >= 100000, 15).otherwise(0))
    return fused.select("transaction_id", F.least(F.lit(100), pts).alias("quick_risk"))
