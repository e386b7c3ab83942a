"""Per-payment and per-account features: history, velocity, context, matrices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import IST_OFFSET, has_clock, ist_day, local_hour, odd_hour, utc_hour, weekday
from weftline.functions.scoring import CALL_TYPES_VOICE, is_call, is_round, rounded_value
from weftline.operators.bands import band_totals, with_band_totals
from weftline.operators.links import any_amount, both_ends
from weftline.operators.ordering import (linear_quantiles, order_statistics, with_position, with_running,
                                         with_scalars, with_trailing_rows)



def customer_key() -> Column:
    return F.coalesce(F.col("customer_id"), F.col("account_no"))


def _sum_or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def day_granular(bank: DataFrame) -> DataFrame:
    """One row: does less than half of the ledger carry clock times?"""
    return bank.agg((F.coalesce(F.avg(has_clock(F.col("time")).cast("int")), F.lit(1.0)) < 0.5).alias("day_granular"))


# ---------------------------------------------------------------- ledger history per account

def history_features(bank: DataFrame) -> DataFrame:
    """Rolling, running, calendar and velocity features of every payment over its account's history."""
    debit, credit, balance = _sum_or_zero("debit"), _sum_or_zero("credit"), _sum_or_zero("balance")
    amt = debit + credit
    rows = bank.select("txn_id", "account_no", "ts", debit.alias("d"), credit.alias("c"), balance.alias("b"),
                       amt.alias("amt"), "merchant_name", "payment_gateway")
    key = ["account_no"]
    rows = with_position(rows, key, "txn_id")
    rows = with_trailing_rows(rows, key, 10, {
        "__mean": ("mean", F.col("amt")), "__std": ("std", F.col("amt")), "__max": ("max", F.col("amt")),
        "__prev": ("lag", F.col("ts"))})
    first_merchant = (rows.where("merchant_name is not null").groupBy("account_no", "merchant_name")
                      .agg(F.min("pos").alias("pos")).groupBy("account_no", "pos").agg(F.lit(1).alias("__new")).select(
                          "account_no", "pos", "__new"))
    rows = rows.join(first_merchant, ["account_no", "pos"], "left")
    has_b = F.col("b") > 0
    rows = with_running(rows, key, {
        "__sum": ("sum", F.col("amt")), "__maxd": ("max", F.when(F.col("d") > 0, F.col("d"))),
        "__maxc": ("max", F.when(F.col("c") > 0, F.col("c"))),
        "__bn": ("sum", has_b.cast("long")), "__bs": ("sum", F.when(has_b, F.col("b"))),
        "__bq": ("sum", F.when(has_b, F.col("b") * F.col("b"))),
        "__merchants": ("sum", F.col("__new").cast("long"))})
    rows = with_position(rows, ["account_no", "amt"], "txn_id", out="__same")
    day = 86400
    prior = band_totals(rows, rows, key, {"__pn": (-day, -1, "n"), "__ps": (-day, -1, "spend")},
                        {"n": F.lit(1).cast("long"), "spend": F.col("d")})
    within = W.partitionBy("account_no", "ts").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = (rows.withColumn("__sn", F.count(F.lit(1)).over(within)).withColumn("__ss", F.sum("d").over(within))
            .join(prior, ["account_no", "ts"], "left"))
    n = F.col("pos") + 1
    hist_mean = rounded_value(F.col("__sum") / n, 2)
    roll_std = rounded_value(F.when(n > 1, F.col("__std")).otherwise(0.0), 2)
    var = F.col("__bq") / F.col("__bn") - F.pow(F.col("__bs") / F.col("__bn"), 2)
    recent = F.coalesce("__pn", F.lit(0)) + F.col("__sn")
    gap = F.coalesce((F.col("ts") - F.col("__prev")) / 86400, F.lit(0.0))
    hour, wd = utc_hour(F.col("ts")), weekday(F.col("ts"))
    dev = F.abs(F.col("amt") - hist_mean) / (roll_std + 1)
    return rows.select(
        "txn_id", "account_no", "ts",
        rounded_value(F.col("__mean"), 2).alias("feat_rolling_mean"), roll_std.alias("feat_rolling_std"),
        F.col("__max").alias("feat_rolling_max"), hist_mean.alias("feat_historical_mean"),
        F.coalesce("__maxd", F.lit(0.0)).alias("feat_max_withdrawal"),
        F.coalesce("__maxc", F.lit(0.0)).alias("feat_max_deposit"),
        rounded_value(F.when(F.col("__bn") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0), 2)
        .alias("feat_balance_volatility"),
        hour.alias("feat_hour_of_day"), wd.alias("feat_day_of_week"), (wd >= 5).cast("int").alias("feat_is_weekend"),
        ((hour < 6) | (hour > 22)).cast("int").alias("feat_is_night"),
        F.col("__merchants").alias("feat_merchant_diversity"),
        ((F.col("amt") % 1000 == 0) & (F.col("amt") > 0)).cast("int").alias("feat_round_amount"),
        (F.col("__same") + 1 > 2).cast("int").alias("feat_repeated_amount"),
        recent.alias("feat_daily_txns"), (F.coalesce("__ps", F.lit(0.0)) + F.col("__ss")).alias("feat_daily_spend"),
        (recent > 15).cast("int").alias("feat_burst_indicator"),
        ((F.col("d") > 0) & (F.coalesce("payment_gateway", F.lit("")) == "ATM/CASH") & (recent > 3)).cast("int")
        .alias("feat_rapid_cash_out"),
        rounded_value(gap, 2).alias("feat_days_since_last_txn"), (gap > 30).cast("int").alias("feat_dormant_activation"),
        rounded_value(F.least(dev * 10, F.lit(100.0)), 2).alias("feat_coarse_anomaly_risk"))


# ---------------------------------------------------------------- customer history

def with_prior_history(bank: DataFrame) -> DataFrame:
    """Adds ``customer``, ``prior_n`` and ``first_beneficiary`` (first payment to that receiver)."""
    rows = with_position(bank.withColumn("customer", customer_key()), ["customer"], "txn_id", out="prior_n")
    firsts = (rows.where("receiver_account is not null").groupBy("customer", "receiver_account")
              .agg(F.min_by("txn_id", F.struct("ts", "txn_id")).alias("txn_id"))
              .select("txn_id", F.lit(True).alias("first_beneficiary")))
    return (rows.join(firsts, "txn_id", "left")
            .withColumn("first_beneficiary", F.coalesce("first_beneficiary", F.lit(False))))


def customer_baseline(bank: DataFrame) -> DataFrame:
    """Per customer: upper-middle median, true median, usual hour (earliest of the most frequent)."""
    rows = bank.select(customer_key().alias("customer"), any_amount().alias("amt"),
                       local_hour(F.col("time"), F.col("ts")).alias("hour"))
    n = F.col("n")
    med = order_statistics(rows, ["customer"], "amt", {
        "upper": F.floor(n / 2).cast("long"), "lower": F.floor((n - 1) / 2).cast("long")})
    hours = rows.where("hour >= 0").groupBy("customer", "hour").agg(F.count(F.lit(1)).alias("k"))
    mode = hours.groupBy("customer").agg(F.min_by("hour", F.struct(-F.col("k"), "hour")).alias("hour_mode"))
    return med.select("customer", F.col("upper").alias("median_upper"),
                      ((F.col("upper") + F.col("lower")) / 2).alias("median")).join(mode, "customer", "left")


def daily_rates(bank: DataFrame) -> DataFrame:
    """Per (customer, day) payment count with the customer's upper-median daily count."""
    per_day = (bank.where("date is not null").groupBy(customer_key().alias("customer"), "date")
               .agg(F.count(F.lit(1)).alias("day_count")))
    med = order_statistics(per_day, ["customer"], "day_count", {"day_median": F.floor(F.col("n") / 2).cast("long")})
    return per_day.join(med.select("customer", "day_median"), "customer")


def with_velocity(rows: DataFrame, window: int = 1800, out: str = "velocity") -> DataFrame:
    src = rows.where("customer is not null")
    return with_band_totals(rows, src.select(F.col("customer").alias("c"), "ts"), {"customer": "c"},
                            {out: (-window, window, "n")})


def call_context(case: Case, frames: dict[str, tuple[int, int, str]], condition: Column) -> DataFrame:
    """Per payment: calls around it, summed over sender and receiver phone (``frames`` as in ``band_totals``)."""
    ends = both_ends(case.cdr.where("ts is not null").where(condition), "ts")
    sides = case.bank.where("ts is not null").select(
        "txn_id", "ts", F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("phone"))
    totals = band_totals(sides, ends, ["phone"], frames)
    return (sides.join(totals, ["phone", "ts"]).groupBy("txn_id")
            .agg(*[F.sum(f).alias(f) for f in frames]))


def session_context(case: Case, frames: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Per payment: data sessions of the sender phone around it."""
    sess = case.ipdr.select(F.col("msisdn").alias("phone"), F.col("start_ts").alias("ts"))
    sides = case.bank.where("ts is not null and sender_phone is not null").select(
        "txn_id", "ts", F.col("sender_phone").alias("phone"))
    totals = band_totals(sides, sess, ["phone"], frames)
    return sides.join(totals, ["phone", "ts"]).select("txn_id", *frames)


def first_seen(rows: DataFrame, value: str, phone: str, ts: str) -> DataFrame:
    """First time a phone shows a value: (phone, value, ts)."""
    return (rows.where(F.col(phone).isNotNull() & F.col(value).isNotNull() & F.col(ts).isNotNull())
            .groupBy(F.col(phone).alias("phone"), F.col(value).alias("value")).agg(F.min(ts).alias("ts")))


def novelty(case: Case, firsts: DataFrame, hi: int, out: str) -> DataFrame:
    """Per payment: number of values its sender phone shows for the first time in ``[ts, ts + hi]``."""
    sides = case.bank.where("ts is not null and sender_phone is not null").select(
        "txn_id", "ts", F.col("sender_phone").alias("phone"))
    totals = band_totals(sides, firsts, ["phone"], {out: (0, hi, "n")})
    return sides.join(totals, ["phone", "ts"]).select("txn_id", out)


def cell_key() -> Column:
    return F.coalesce(F.col("bts_location_first"), F.col("cell_id_first"))



TXN_FEATURES = ("log_amount", "log_ratio", "hour_dev", "round_flag", "burst_count", "new_beneficiary", "call_count",
                "ipdr_sessions", "novel_imei", "novel_cell", "prior_n", "night_flag")


def transaction_matrix(case: Case, context: DataFrame | None = None) -> DataFrame:
    """Twelve features per payment."""
    from weftline.operators.context import payment_context

    rows = context if context is not None else payment_context(case)
    amt, hour = any_amount(), F.col("hour")
    ratio = F.when(F.col("median") > 0, amt / F.col("median")).otherwise(0.0)
    dbl = lambda c, name: c.cast("double").alias(name)
    return rows.select(
        "txn_id", F.log1p(amt).alias("log_amount"), F.log1p(F.greatest(ratio, F.lit(0.0))).alias("log_ratio"),
        dbl(F.when((hour >= 0) & F.col("hour_mode").isNotNull(), F.abs(hour - F.col("hour_mode"))).otherwise(-1), "hour_dev"),
        dbl(is_round(amt), "round_flag"), dbl(F.col("velocity"), "burst_count"), dbl(F.col("first_beneficiary"), "new_beneficiary"),
        dbl(F.col("voice_calls_hour"), "call_count"), dbl(F.col("sessions_near"), "ipdr_sessions"),
        dbl(F.col("new_imeis") > 0, "novel_imei"), dbl(F.col("new_cells") > 0, "novel_cell"),
        dbl(F.col("prior_n"), "prior_n"), dbl(odd_hour(hour), "night_flag"))


def _moments(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    return rows.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))])


def transaction_ml(matrix: DataFrame, cap: float = 8.0) -> DataFrame:
    """0-100 score from the most extreme standardised feature; z = 2 gives 0, z = 8 gives 100."""
    s = F.col("scalars")
    z = [F.abs((F.col(c) - s[f"m_{c}"]) / F.when(s[f"s_{c}"] == 0, 1.0).otherwise(s[f"s_{c}"])) for c in TXN_FEATURES]
    top = F.least(F.greatest(*z), F.lit(cap))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (top - 2.0) * (100.0 / 6.0))), 2)
    return with_scalars(matrix, _moments(matrix, TXN_FEATURES)).select("txn_id", score.alias("txn_ml_score"))


# ---------------------------------------------------------------- accounts

ACCOUNT_FEATURES = ("txn_count", "total_credit", "total_debit", "avg_amount", "max_amount", "p99_amount", "std_amount",
                    "uniq_counterparties", "uniq_phones", "uniq_upi", "round_share", "night_share", "credit_share",
                    "max_daily_count", "avg_daily_count", "new_beneficiary_share", "call_linkage_share",
                    "ipdr_linkage_share", "midnight_spike", "max_single_burst")


def largest_burst(bank: DataFrame, window: int = 1800) -> DataFrame:
    rows = bank.where("account_no is not null and ts is not null").select("account_no", "ts")
    totals = band_totals(rows, rows, ["account_no"], {"n": (0, window, "n")})
    return totals.groupBy("account_no").agg(F.max("n").alias("max_single_burst"))


def phone_linkage(case: Case) -> DataFrame:
    """Per account: calls (20 s and longer, as caller) and sessions of the phones on its payments."""
    use = (case.bank.where("account_no is not null")
           .select("account_no", F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("phone"))
           .groupBy("account_no", "phone").agg(F.count(F.lit(1)).alias("k")))
    calls = case.cdr.where("duration_sec >= 20").groupBy(F.col("a_number").alias("phone")).agg(
        F.count(F.lit(1)).alias("c"))
    sess = case.ipdr.groupBy(F.col("msisdn").alias("phone")).agg(F.count(F.lit(1)).alias("s"))
    return (use.join(calls, "phone", "left").join(sess, "phone", "left").groupBy("account_no").agg(
        F.count(F.lit(1)).alias("uniq_phones"),
        F.sum(F.col("k") * F.coalesce("c", F.lit(0))).alias("calls"),
        F.sum(F.col("k") * F.coalesce("s", F.lit(0))).alias("sessions")))


def account_matrix(case: Case) -> DataFrame:
    """Twenty features per account."""
    amt, hour = any_amount(), local_hour(F.col("time"), F.col("ts"))
    rows = case.bank.where("account_no is not null").withColumns({"amt": amt, "hour": hour})
    core = rows.groupBy("account_no").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(_sum_or_zero("credit")).alias("cred"),
        F.sum(_sum_or_zero("debit")).alias("deb"), F.avg("amt").alias("mean"), F.max("amt").alias("max_amount"),
        F.stddev_pop("amt").alias("std"), F.avg(is_round(F.col("amt")).cast("int")).alias("round"),
        F.avg(odd_hour(F.col("hour")).cast("int")).alias("night"),
        F.sum(F.col("hour").isin(0, 1, 2, 3).cast("int")).alias("midnight_spike"))
    breadth = rows.groupBy("account_no").agg(F.count_distinct("receiver_account").alias("uniq_counterparties"),
                                             F.count_distinct("upi_id").alias("uniq_upi"))
    p99 = linear_quantiles(rows, ["account_no"], "amt", {"p99": 0.99}).select("account_no", "p99")
    day = F.coalesce("date", ist_day(F.col("ts")))
    daily = (rows.where(day.isNotNull()).groupBy("account_no", customer_key().alias("customer"), day.alias("day"))
             .agg(F.count(F.lit(1)).alias("k")))
    avg_daily = daily.groupBy("account_no").agg(F.avg("k").alias("avg_daily"))
    max_daily = (daily.groupBy("account_no", "day").agg(F.sum("k").alias("k")).groupBy("account_no")
                 .agg(F.max("k").alias("max_daily_count")))
    parts = [breadth, p99, avg_daily, max_daily, phone_linkage(case), largest_burst(case.bank)]
    j = reduce(lambda d, o: d.join(o, "account_no", "left"), parts, core)
    n, both = F.col("txn_count"), F.col("cred") + F.col("deb")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select(
        "account_no", "txn_count", F.round("cred", 2).alias("total_credit"), F.round("deb", 2).alias("total_debit"),
        F.round("mean", 2).alias("avg_amount"), F.round("max_amount", 2).alias("max_amount"),
        F.round("p99", 2).alias("p99_amount"), F.round("std", 2).alias("std_amount"), whole("uniq_counterparties"),
        whole("uniq_phones"), whole("uniq_upi"), F.round("round", 4).alias("round_share"),
        F.round("night", 4).alias("night_share"),
        F.when(both != 0, F.round(F.col("cred") / both, 4)).otherwise(0.5).alias("credit_share"),
        whole("max_daily_count"), F.round(F.coalesce("avg_daily", F.lit(0.0)), 3).alias("avg_daily_count"),
        F.round(F.col("uniq_counterparties") / n, 4).alias("new_beneficiary_share"),
        F.round(F.coalesce("calls", F.lit(0)) / n, 4).alias("call_linkage_share"),
        F.round(F.coalesce("sessions", F.lit(0)) / n, 4).alias("ipdr_linkage_share"),
        whole("midnight_spike"), whole("max_single_burst"))


def standardised(matrix: DataFrame, cols: Sequence[str], key: str = "account_no", log: bool = True,
                 eps: float | None = 1e-9) -> DataFrame:
    """log1p of magnitudes, then zero mean and unit variance. ``eps=None`` treats a zero spread as one."""
    x = matrix.select(key, *[(F.log1p(F.abs(F.col(c).cast("double"))) if log else F.col(c).cast("double")).alias(c)
                             for c in cols])
    s = F.col("scalars")

    def spread(c):
        return s[f"s_{c}"] + eps if eps is not None else F.when(s[f"s_{c}"] == 0, 1.0).otherwise(s[f"s_{c}"])

    return with_scalars(x, _moments(x, cols)).select(key, *[((F.col(c) - s[f"m_{c}"]) / spread(c)).alias(c) for c in cols])


def max_abs(matrix: DataFrame, cols: Sequence[str], key: str = "account_no", out: str = "zscore") -> DataFrame:
    return matrix.select(key, F.greatest(*[F.abs(F.col(c)) for c in cols]).alias(out))


OUTLIER_FEATURES = ("txn_count", "total_credit", "total_debit", "avg_amount", "max_amount", "uniq_counterparties",
                    "uniq_phones", "uniq_upi", "round_share", "night_share", "rapid_payouts", "dormant_activation",
                    "merchant_diversity", "burst_indicator")


def outlier_matrix(bank: DataFrame, payouts: DataFrame) -> DataFrame:
    """Fourteen features per account for the outlier list."""
    amt = any_amount()
    rows = bank.where("account_no is not null").withColumn("amt", amt)
    core = rows.groupBy("account_no").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(_sum_or_zero("credit")).alias("total_credit"),
        F.sum(_sum_or_zero("debit")).alias("total_debit"), F.avg("amt").alias("avg_amount"),
        F.max("amt").alias("max_amount"), F.avg(is_round(F.col("debit")).cast("int")).alias("round_share"),
        F.avg(F.coalesce(F.col("time").rlike("^2[0-3]:"), F.lit(False)).cast("int")).alias("night_share"))
    breadth = rows.groupBy("account_no").agg(
        F.count_distinct("receiver_account").alias("uniq_counterparties"),
        F.count_distinct("upi_id").alias("uniq_upi"), F.count_distinct("merchant_name").alias("merchant_diversity"))
    phones = (rows.select("account_no", F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("p"))
              .groupBy("account_no").agg(F.count_distinct("p").alias("uniq_phones")))
    feats = history_features(bank).groupBy("account_no").agg(
        F.max("feat_burst_indicator").alias("burst_indicator"),
        F.max("feat_dormant_activation").alias("dormant_activation"))
    rapid = payouts.select("account_no", F.lit(1).alias("rapid_payouts"))
    out = reduce(lambda d, o: d.join(o, "account_no", "left"), [breadth, phones, feats, rapid], core)
    return out.select("account_no", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in OUTLIER_FEATURES])


# ---------------------------------------------------------------- payouts

def rapid_payouts(bank: DataFrame, threshold: int = 5, window_min: int = 60, shown: int = 15,
                  only: Column | None = None) -> DataFrame:
    """Per account: the first payout that starts at least ``threshold`` payouts within the window.

    A debit of nothing pays nothing out and is no payout.
    """
    w = window_min * 60
    rows = bank.where("txn_type = 'D' and debit > 0 and ts is not null and account_no is not null")
    if only is not None:
        rows = rows.where(only)
    rows = rows.select("account_no", "ts", "txn_id", "debit", "mode")
    totals = band_totals(rows, rows, ["account_no"], {"n": (0, w, "n")})
    start = (totals.where(F.col("n") >= threshold).groupBy("account_no")
             .agg(F.min("ts").alias("start_ts"), F.min_by("n", "ts").alias("count")))
    members = rows.join(start, "account_no").where((F.col("ts") >= F.col("start_ts"))
                                                   & (F.col("ts") <= F.col("start_ts") + w))
    order = W.partitionBy("account_no").orderBy("ts", "txn_id")
    head = (members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= shown).groupBy("account_no")
            .agg(F.sort_array(F.collect_list(F.struct("k", "txn_id", "ts", F.col("debit").alias("amount"), "mode")))
                 .alias("txns")))
    total = members.groupBy("account_no").agg(F.sum("debit").alias("total"), F.max("ts").alias("end_ts"))
    return start.join(total, "account_no").join(head, "account_no")


def round_payouts(bank: DataFrame, limit: int = 200) -> DataFrame:
    """Largest round debits."""
    return (bank.where((F.col("txn_type") == "D") & is_round(F.col("debit")))
            .select("txn_id", "account_no", "date", F.coalesce("credit", "debit").alias("amount"), "mode",
                    F.col("receiver_phone").alias("phone"))
            .orderBy(F.desc("amount"), "txn_id").limit(limit))


# ---------------------------------------------------------------- context scores

def temporal_ladder(case: Case, windows: Sequence[int] = (300, 600, 1800, 3600)) -> DataFrame:
    """Call and session pairs of the sender phone within each window, in one pass per dataset."""
    frames = {f"w{w}": (-w, w, "n") for w in windows}
    sides = case.bank.where("ts is not null").select("txn_id", "ts", F.col("sender_phone").alias("phone"))
    calls = both_ends(case.cdr.where("ts is not null and duration_sec >= 10"), "ts")
    sess = case.ipdr.select("msisdn", F.col("start_ts").alias("ts")).toDF("phone", "ts")
    both = calls.unionByName(sess)
    hits = sides.join(band_totals(sides, both, ["phone"], frames), ["phone", "ts"], "left")
    one = hits.agg(F.count(F.lit(1)).alias("txns"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in frames])
    stack = ", ".join(f"{w}, w{w}" for w in windows)
    return one.selectExpr("txns", f"stack({len(windows)}, {stack}) as (window_sec, correlated_pairs)").withColumn(
        "correlation_rate", F.round(F.col("correlated_pairs") / F.greatest(F.col("txns"), F.lit(1)), 3))


def temporal_scores(case: Case, window: int = 1800, context: DataFrame | None = None) -> DataFrame:
    """Calls of at least 10 s and sessions within the window: 20/40, 15/30, both 10.

    ``context`` (payment context) serves the default window.
    """
    if context is not None and window == 1800:
        return _temporal_points(context.where("ts is not null").withColumnRenamed("sessions_near", "sessions_in_window"))
    calls = call_context(case, {"calls_in_window": (-window, window, "n")}, F.col("duration_sec") >= 10)
    sess = session_context(case, {"sessions_in_window": (-window, window, "n")})
    rows = (case.bank.where("ts is not null").select("txn_id", "account_no").join(calls, "txn_id", "left")
            .join(sess, "txn_id", "left"))
    return _temporal_points(rows)


def _temporal_points(rows: DataFrame) -> DataFrame:
    c, s = F.coalesce("calls_in_window", F.lit(0)), F.coalesce("sessions_in_window", F.lit(0))
    score = (F.when(c >= 3, 40.0).when(c >= 1, 20.0).otherwise(0.0) + F.when(s >= 3, 30.0).when(s >= 1, 15.0)
             .otherwise(0.0) + F.when((c >= 1) & (s >= 1), 10.0).otherwise(0.0))
    return rows.select("txn_id", "account_no", c.alias("calls_in_window"), s.alias("sessions_in_window"),
                       F.least(score, F.lit(100.0)).alias("temporal_score"))


def account_temporal(scores: DataFrame) -> DataFrame:
    a = scores.where("account_no is not null").groupBy("account_no").agg(
        F.avg("temporal_score").alias("mean"), F.avg((F.col("temporal_score") >= 40).cast("int")).alias("strong"))
    return a.select("account_no", F.round(F.least(F.lit(100.0), 0.6 * F.col("mean") + 30.0 * F.col("strong")), 2)
                    .alias("temporal_score"), F.round("strong", 3).alias("correlated_txn_share"),
                    F.round("mean", 2).alias("avg_temporal_score"))


def call_assist(case: Case, window: int = 3600) -> DataFrame:
    """Calls of at least 10 s in ``[ts - window, ts]`` on either phone, with the count per phone."""
    ends = both_ends(case.cdr.where("ts is not null and duration_sec >= 10"), "ts")
    sides = case.bank.where("ts is not null").select("txn_id", "ts", F.posexplode(F.array(
        "sender_phone", "receiver_phone")).alias("side", "phone")).where("phone is not null")
    totals = band_totals(sides, ends, ["phone"], {"k": (-window, 0, "n")})
    per = sides.join(totals, ["phone", "ts"]).where("k > 0").groupBy("txn_id").agg(
        F.sum("k").alias("calls"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "phone", "k"))),
                                                            lambda x: F.concat(x["phone"], F.lit(":"), x["k"].cast("string"))), ",").alias("parties"))
    rows = case.bank.where("ts is not null").select("txn_id").join(per, "txn_id", "left")
    c = F.coalesce("calls", F.lit(0))
    return rows.select("txn_id", c.alias("calls_before"), F.coalesce("parties", F.lit("")).alias("parties"),
                       F.when(c >= 3, 60.0).when(c >= 2, 40.0).when(c >= 1, 20.0).otherwise(0.0).alias("call_assist_score"))


def call_assist_points(context: DataFrame) -> DataFrame:
    """Call-assist score from the payment context, without the per-phone list."""
    c = F.col("calls_before")
    return context.where("ts is not null").select("txn_id", c.alias("calls_before"), F.when(c >= 3, 60.0).when(c >= 2, 40.0).when(
        c >= 1, 20.0).otherwise(0.0).alias("call_assist_score"))


def shared_ips(ipdr: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Addresses used by at least two subscribers; 20 points a subscriber."""
    a = (ipdr.where(F.col(ip).isNotNull() & F.col("msisdn").isNotNull()).groupBy(F.col(ip).alias("ip"))
         .agg(F.count_distinct("msisdn").alias("subscriber_count")).where("subscriber_count >= 2"))
    return a.select("ip", "subscriber_count", F.least(F.lit(100.0), 20.0 * F.col("subscriber_count")).alias("shared_ip_score"),
                    F.concat(F.col("subscriber_count").cast("string"), F.lit(" subscribers share IP "), "ip").alias("reason"))


def internet_scores(case: Case, window: int = 1800, top_ips: int = 3, context: DataFrame | None = None) -> DataFrame:
    """Session burst, shared addresses and first-seen SIM, device or cell around each payment."""
    use = (case.ipdr.where("msisdn is not null and source_ip is not null")
           .groupBy(F.col("msisdn").alias("phone"), F.col("source_ip").alias("ip")).agg(F.count(F.lit(1)).alias("k")))
    w = W.partitionBy("phone").orderBy(F.desc("k"), "ip")
    top = use.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_ips)
    shared = top.join(shared_ips(case.ipdr).where("subscriber_count >= 3").select("ip"), "ip").groupBy("phone").agg(
        F.count(F.lit(1)).alias("shared_ips"))
    any_session = case.ipdr.where("msisdn is not null and start_ts is not null").select(
        F.col("msisdn").alias("phone")).distinct().withColumn("seen", F.lit(True))
    if context is not None and window == 1800:
        rows = context.where("ts is not null").select("txn_id", F.col("sender_phone").alias("phone"), F.col("sessions_near").alias("n_sessions"),
                                                      "new_sim", "new_device", F.col("new_session_cell").alias("new_cell"))
    else:
        rows = case.bank.where("ts is not null").select("txn_id", F.col("sender_phone").alias("phone"))
        rows = rows.join(session_context(case, {"n_sessions": (-window, window, "n")}), "txn_id", "left")
        for col, out in (("imsi", "new_sim"), ("imei", "new_device"), ("cell_id", "new_cell")):
            rows = rows.join(novelty(case, first_seen(case.ipdr, col, "msisdn", "start_ts"), window, out), "txn_id", "left")
    rows = rows.join(shared, "phone", "left").join(any_session, "phone", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    changed = (z("new_sim") + z("new_device") + z("new_cell")) > 0
    pts = (F.when(z("n_sessions") >= 3, 20.0).otherwise(0.0) + 25.0 * z("shared_ips") + F.when(z("new_sim") > 0, 30.0).otherwise(0.0)
           + F.when(z("new_device") > 0, 30.0).otherwise(0.0) + F.when(z("new_cell") > 0, 15.0).otherwise(0.0)
           + F.when(F.col("seen").isNull() & changed, 10.0).otherwise(0.0))
    reasons = F.array_compact(F.array(
        F.when(z("n_sessions") >= 3, F.concat(z("n_sessions").cast("string"), F.lit(f" data sessions within {window // 60} min"))),
        F.when(z("shared_ips") > 0, F.lit("phone uses a shared IP")),
        F.when(z("new_sim") > 0, F.lit("SIM first seen around payment")),
        F.when(z("new_device") > 0, F.lit("device first seen around payment")),
        F.when(z("new_cell") > 0, F.lit("cell first seen around payment"))))
    return rows.select("txn_id", F.least(F.lit(100.0), pts).alias("internet_score"), reasons.alias("reasons"),
                       z("shared_ips").alias("shared_ips"))


# ---------------------------------------------------------------- profiles

def _dimensions(bank: DataFrame) -> DataFrame:
    """(customer, dimension, value) rows for every preference tracked in a profile."""
    hour = local_hour(F.col("time"), F.col("ts"))
    wd = weekday(F.col("ts") + IST_OFFSET)
    dims = {"bank": F.col("bank"), "beneficiary": F.col("receiver_account"), "mode": F.col("mode"),
            "hour": F.when(hour >= 0, F.lpad(hour.cast("string"), 2, "0")), "weekday": wd.cast("string"),
            "upi": F.col("upi_id"), "merchant": F.col("merchant_name")}
    for optional in ("imei", "ip"):
        if optional in bank.columns:
            dims[optional] = F.col(optional)
    pairs = [F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()]
    pairs += [F.struct(F.lit("phone").alias("dim"), F.col(p).alias("value")) for p in ("sender_phone", "receiver_phone")]
    return (bank.select(customer_key().alias("customer"), F.explode(F.array(*pairs)).alias("d"))
            .select("customer", "d.dim", "d.value").where("customer is not null and value is not null"))


def profiles(bank: DataFrame) -> DataFrame:
    """Customer profile: amounts, preferred values (ties: smallest), span."""
    amt, hour = any_amount(), local_hour(F.col("time"), F.col("ts"))
    rows = bank.withColumns({"customer": customer_key(), "amt": amt}).where("customer is not null")
    core = rows.groupBy("customer").agg(
        F.count(F.lit(1)).alias("txn_count"), F.avg("amt").alias("avg_amount"), F.max("amt").alias("max_amount"),
        F.sum("amt").alias("total_amount"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg(odd_hour(hour).cast("int")).alias("night_share"))
    days = rows.groupBy("customer").agg(F.count_distinct("date").alias("day_count"))
    n = F.col("n")
    stats = order_statistics(rows, ["customer"], "amt", {
        "a": F.floor((n - 1) / 2).cast("long"), "b": F.floor(n / 2).cast("long"),
        "p95_amount": F.least(n - 1, F.floor(n * F.lit(0.95)).cast("long"))})
    stats = stats.select("customer", ((F.col("a") + F.col("b")) / 2).alias("median_amount"), "p95_amount")
    counted = _dimensions(bank).groupBy("customer", "dim", "value").agg(F.count(F.lit(1)).alias("k"))
    names = ["bank", "beneficiary", "mode", "hour", "weekday", "upi", "merchant", "phone", "imei", "ip"]
    best = counted.groupBy("customer").agg(*[
        F.min_by(F.when(F.col("dim") == d, F.col("value")), F.when(F.col("dim") == d, F.struct(-F.col("k"), "value")))
        .alias(f"preferred_{d}") for d in names])
    out = core.join(days, "customer").join(stats, "customer", "left").join(best, "customer", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in ("preferred_hour", "preferred_weekday")})


def profile_deviation(bank: DataFrame) -> DataFrame:
    """How far each payment departs from its customer's profile, with reasons."""
    rows = with_position(bank.withColumn("customer", customer_key()), ["customer"], "txn_id")
    rows = with_trailing_rows(rows, ["customer"], 2, {"prev_ts": ("lag", F.col("ts"))})
    p = profiles(bank).withColumnRenamed("last_ts", "profile_last").withColumnRenamed("first_ts", "profile_first")
    r = rows.join(p, "customer", "left")
    amt, hour = any_amount(), local_hour(F.col("time"), F.col("ts"))
    ratio = F.when((F.col("median_amount") > 0) & (amt > 0), amt / F.col("median_amount"))
    differs = lambda c, pref: F.col(c).isNotNull() & F.col(pref).isNotNull() & (F.col(c) != F.col(pref))
    idle = (F.col("ts") - F.col("prev_ts")) / 86400.0
    wd = weekday(F.col("ts") + IST_OFFSET)
    text = {
        "amount": F.concat(F.lit("amount is "), F.format_string("%.1f", ratio), F.lit("x the customer median")),
        "hour": F.lit("deviates from preferred hour"), "night": F.lit("night payment outside customer habit"),
        "beneficiary": F.lit("not the usual beneficiary"), "bank": F.lit("differs from preferred bank"),
        "mode": F.lit("differs from preferred mode"), "dormant": F.concat(F.lit("dormant for "), F.format_string("%.0f", idle), F.lit(" days")),
        "weekend": F.lit("weekend payment outside customer habit"),
    }
    checks = [
        (ratio >= 3, F.when(ratio >= 10, 35.0).when(ratio >= 5, 25.0).otherwise(15.0), text["amount"]),
        ((hour >= 0) & (F.col("preferred_hour") >= 0) & (F.abs(hour - F.col("preferred_hour")) >= 6), 10.0, text["hour"]),
        (odd_hour(hour) & (F.col("night_share") <= 0.2), 8.0, text["night"]),
        (differs("receiver_account", "preferred_beneficiary"), 6.0, text["beneficiary"]),
        (differs("bank", "preferred_bank"), 5.0, text["bank"]),
        (differs("mode", "preferred_mode"), 5.0, text["mode"]),
    ]
    for c, pref in (("sender_phone", "phone"), ("imei", "imei"), ("ip", "ip"), ("upi_id", "upi"), ("merchant_name", "merchant")):
        if c in bank.columns:
            checks.append((differs(c, f"preferred_{pref}"), 6.0, F.lit(f"unusual {pref}")))
    checks += [(idle >= 30, 30.0, text["dormant"]),
               ((wd >= 5) & (F.col("preferred_weekday") >= 0) & (F.col("preferred_weekday") < 5), 4.0, text["weekend"])]
    thin = F.coalesce("txn_count", F.lit(0)) < 3
    pts = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for c, v, _ in checks])
    reasons = F.array_compact(F.array(*[F.when(c, t) for c, _, t in checks]))
    return r.select("txn_id", "customer", "account_no",
                    F.when(thin, 0.0).otherwise(F.round(F.least(pts, F.lit(100.0)), 2)).alias("profile_score"),
                    F.when(thin, F.array(F.lit("profile too thin"))).otherwise(reasons).alias("profile_reasons"),
                    (~thin & F.coalesce(idle >= 30, F.lit(False))).alias("dormant"))


def account_deviation(dev: DataFrame) -> DataFrame:
    a = dev.where("account_no is not null").groupBy("account_no").agg(
        F.count(F.lit(1)).alias("profile_txn_count"), F.max("profile_score").alias("mx"), F.avg("profile_score").alias("mean"),
        F.avg((F.col("profile_score") >= 30).cast("int")).alias("share"),
        F.coalesce(F.max((F.col("dormant") & (F.col("profile_score") >= 30))), F.lit(False)).alias("dormant_activated"))
    return a.select("account_no", F.round(F.least(F.lit(100.0), 0.5 * F.col("mx") + 25.0 * F.col("share")
                                                  + 0.25 * F.col("mean")), 2).alias("behaviour_score"),
                    F.round("share", 3).alias("deviating_share"), F.round("mx", 2).alias("max_deviation"),
                    "profile_txn_count", "dormant_activated")


def rank_normalised(df: DataFrame, value: str, key: str, out: str, width: float = 0.01) -> DataFrame:
    """0-100 percentile rank. Ties follow the md5 of the key, which also spreads a large tie over many tasks."""
    rows = df.withColumn("__h", F.md5(F.col(key)))
    ranked = with_position(rows, [], "__h", ts=value, out="__r", width=width, tie_prefix=3)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("scalars")["n"]
    return (with_scalars(ranked, total)
            .withColumn(out, F.when(n > 1, F.col("__r") / (n - 1) * 100.0).otherwise(0.0))
            .drop("__h", "__r", "scalars"))
