"""History, velocity and context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from weftline.functions.clock import local_hour
from weftline.functions.scoring import is_call
from weftline.operators import features as ft
from weftline.operators import links
from weftline.operators.ordering import with_position

view("hist", """
  SELECT txn_id, account_no, ts, coalesce(debit, 0) AS d, coalesce(credit, 0) AS c, balance AS b,
    coalesce(debit, 0) + coalesce(credit, 0) AS amt, merchant_name, payment_gateway,
    row_number() OVER w - 1 AS pos, lag(ts) OVER w AS prev,
    avg(amount) OVER w10 AS rmean, stddev_pop(amount) OVER w10 AS rstd, max(amount) OVER w10 AS rmax,
    avg(amount) OVER wr AS hmean, quantile_cont(amount, 0.5) OVER wr AS hmedian, max(debit) OVER wr AS maxd, max(credit) OVER wr AS maxc,
    CASE WHEN count(CASE WHEN balance > 0 THEN 1 END) OVER wr > 1 THEN stddev_pop(CASE WHEN balance > 0 THEN balance END) OVER wr ELSE 0 END AS bvol,
    count(DISTINCT merchant_name) OVER wr AS merchants
  FROM f_bank
  WINDOW w AS (PARTITION BY account_no ORDER BY ts, txn_id),
    w10 AS (PARTITION BY account_no ORDER BY ts, txn_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    wr AS (PARTITION BY account_no ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
view("recent", """
  SELECT a.txn_id, count(*) AS n, sum(coalesce(b.d, 0)) AS spend FROM hist a JOIN hist b
  ON a.account_no = b.account_no AND b.ts >= a.ts - 86400 AND b.pos <= a.pos GROUP BY a.txn_id""")
view("feats", """
  SELECT h.txn_id, h.account_no, round(rmean, 2) AS feat_rolling_mean, round(rstd, 2) AS feat_rolling_std, rmax AS feat_rolling_max,
    round(hmean, 2) AS feat_historical_mean, coalesce(maxd, 0) AS feat_max_withdrawal, coalesce(maxc, 0) AS feat_max_deposit,
    round(bvol, 2) AS feat_balance_volatility, (ts % 86400) // 3600 AS feat_hour_of_day, (ts // 86400 + 3) % 7 AS feat_day_of_week,
    CASE WHEN (ts // 86400 + 3) % 7 >= 5 THEN 1 ELSE 0 END AS feat_is_weekend,
    CASE WHEN (ts % 86400) // 3600 < 6 OR (ts % 86400) // 3600 > 22 THEN 1 ELSE 0 END AS feat_is_night,
    merchants AS feat_merchant_diversity, CASE WHEN amt > 0 AND CAST(amt AS BIGINT) % 1000 = 0 THEN 1 ELSE 0 END AS feat_round_amount,
    CASE WHEN row_number() OVER (PARTITION BY account_no, amt ORDER BY ts, h.txn_id) > 2 THEN 1 ELSE 0 END AS feat_repeated_amount,
    r.n AS feat_daily_txns, r.spend AS feat_daily_spend, CASE WHEN r.n > 15 THEN 1 ELSE 0 END AS feat_burst_indicator,
    CASE WHEN d > 0 AND payment_gateway = 'ATM/CASH' AND r.n > 3 THEN 1 ELSE 0 END AS feat_rapid_cash_out,
    round(coalesce((ts - prev) / 86400e0, 0), 2) AS feat_days_since_last_txn,
    CASE WHEN (ts - prev) / 86400e0 > 30 THEN 1 ELSE 0 END AS feat_dormant_activation,
    round(least(abs(amt - round(hmean, 2)) / (round(rstd, 2) + 1) * 10, 100), 2) AS feat_coarse_anomaly_risk
  FROM hist h JOIN recent r USING (txn_id)""")


@entry("w1_w6_history_features", "SELECT * FROM feats")
def w1(t: Tables):
    return ft.history_features(t.bank).drop("ts")


view("prior", """
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts, txn_id) - 1 AS prior_n,
    row_number() OVER (PARTITION BY customer_id, receiver_account ORDER BY ts, txn_id) = 1 AS first_beneficiary FROM f_bank""")


@entry("w7_prior_history", "SELECT txn_id, customer_id AS customer, prior_n, first_beneficiary FROM prior")
def w7(t: Tables):
    return ft.with_prior_history(t.bank).select("txn_id", "customer", "prior_n", "first_beneficiary")


view("veloc", """
  SELECT txn_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING) AS velocity FROM f_bank""")


@entry("w8_velocity", "SELECT txn_id, velocity FROM veloc")
def w8(t: Tables):
    return ft.with_velocity(t.bank.withColumn("customer", ft.customer_key())).select("txn_id", "velocity")


view("base", """
  SELECT customer, median, median_upper, hour_mode FROM (
    SELECT customer_id AS customer, median(amount) AS median, list_sort(list(amount))[count(*) // 2 + 1] AS median_upper FROM f_bank GROUP BY 1) m
  JOIN (SELECT customer_id AS customer, hour AS hour_mode FROM (
    SELECT customer_id, CAST(left(time, 2) AS INTEGER) AS hour, count(*) AS k FROM f_bank GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY k DESC, hour) = 1) h USING (customer)""")


@entry("w9_customer_baseline", "SELECT customer, median, median_upper, hour_mode FROM base")
def w9(t: Tables):
    return ft.customer_baseline(t.bank).select("customer", "median", "median_upper", "hour_mode")


@entry("w9_ledger_baseline", """
SELECT customer_id AS customer, round(median(amount), 3) AS median, round(list_sort(list(amount))[count(*) // 2 + 1], 3) AS median_upper
FROM f_ledger GROUP BY 1""")
def w9l(t: Tables):
    return rounded(ft.customer_baseline(t.ledger).select("customer", "median", "median_upper"), 3)


view("vcalls", """SELECT phone, ts FROM call_ends
  WHERE upper(call_type) IN ('VOICE','INCOMING','OUTGOING','MISSED','SMS') OR duration_sec >= 10""")
view("sides", "SELECT txn_id, ts, unnest([sender_phone, receiver_phone]) AS phone FROM f_bank")
view("pay_calls", """SELECT s.txn_id, count(*) AS calls FROM sides s JOIN vcalls c
  ON s.phone = c.phone AND c.ts >= s.ts - 3600 AND c.ts < s.ts GROUP BY 1""")


@entry("w10_calls_before", "SELECT txn_id, coalesce(calls, 0) AS calls FROM f_bank LEFT JOIN pay_calls USING (txn_id)")
def w10(t: Tables):
    c = ft.call_context(t.case, {"calls": (-3600, -1, "n")}, is_call(F.col("call_type"), F.col("duration_sec")))
    return t.bank.select("txn_id").join(c, "txn_id", "left").select("txn_id", F.coalesce("calls", F.lit(0)).alias("calls"))


view("pay_sess", """SELECT b.txn_id, count(*) AS sessions FROM f_bank b JOIN f_ipdr i
  ON b.sender_phone = i.msisdn AND i.start_ts BETWEEN b.ts - 1800 AND b.ts + 1800 GROUP BY 1""")


@entry("w11_sessions_near", "SELECT txn_id, coalesce(sessions, 0) AS sessions FROM f_bank LEFT JOIN pay_sess USING (txn_id)")
def w11(t: Tables):
    s = ft.session_context(t.case, {"sessions": (-1800, 1800, "n")})
    return t.bank.select("txn_id").join(s, "txn_id", "left").select(
        "txn_id", F.coalesce("sessions", F.lit(0)).alias("sessions"))


view("first_imei", "SELECT a_number AS phone, imei AS value, min(ts) AS ts FROM f_cdr GROUP BY ALL")
view("first_cell", "SELECT a_number AS phone, cell_id_first AS value, min(ts) AS ts FROM f_cdr GROUP BY ALL")


@entry("w12_novelty", """
SELECT b.txn_id, count(DISTINCT i.value) AS new_imeis, count(DISTINCT c.value) AS new_cells FROM f_bank b
LEFT JOIN first_imei i ON i.phone = b.sender_phone AND i.ts >= b.ts AND i.ts < b.ts + 3600
LEFT JOIN first_cell c ON c.phone = b.sender_phone AND c.ts >= b.ts AND c.ts < b.ts + 3600 GROUP BY 1""")
def w12(t: Tables):
    a = ft.novelty(t.case, ft.first_seen(t.cdr, "imei", "a_number", "ts"), 3599, "new_imeis")
    b = ft.novelty(t.case, ft.first_seen(t.cdr, "cell_id_first", "a_number", "ts"), 3599, "new_cells")
    return a.join(b, "txn_id")


@entry("w13_rarity", """
WITH v AS (SELECT 'imei' AS kind, imei AS value, ts, cdr_id AS id FROM f_cdr UNION ALL SELECT 'cell', cell_id_first, ts, cdr_id FROM f_cdr)
SELECT kind, id, count(*) OVER (PARTITION BY kind, value) AS seen,
  row_number() OVER (PARTITION BY kind, value ORDER BY ts, id) - 1 AS seen_before FROM v""")
def w13(t: Tables):
    v = t.cdr.select("ts", F.col("cdr_id").alias("id"), F.explode(F.array(
        F.struct(F.lit("imei").alias("kind"), F.col("imei").alias("value")),
        F.struct(F.lit("cell").alias("kind"), F.col("cell_id_first").alias("value")))).alias("p")).select("ts", "id", "p.*")
    total = v.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("seen"))
    return with_position(v, ["kind", "value"], "id", out="seen_before").join(total, ["kind", "value"]).select(
        "kind", "id", "seen", "seen_before")


view("burst60", """
  SELECT account_no, ts, n FROM (SELECT account_no, ts, txn_id, count(*) OVER (PARTITION BY account_no ORDER BY ts RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS n
    FROM f_bank WHERE debit > 0) WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY account_no ORDER BY ts, txn_id) = 1""")
view("payouts", """
  SELECT a.account_no, a.n AS count, a.ts AS start_ts, max(b.ts) AS end_ts, sum(b.debit) AS total,
    array_to_string(list_slice(list(b.txn_id ORDER BY b.ts, b.txn_id), 1, 15), ',') AS txns
  FROM burst60 a JOIN f_bank b ON a.account_no = b.account_no AND b.debit > 0 AND b.ts BETWEEN a.ts AND a.ts + 3600 GROUP BY ALL""")


@entry("w14_rapid_payouts", "SELECT account_no, count, start_ts, end_ts, total, txns FROM payouts")
def w14(t: Tables):
    p = ft.rapid_payouts(t.bank)
    return p.withColumn("txns", F.array_join(F.transform("txns", lambda x: x["txn_id"]), ","))


view("bursts", """
  SELECT account_no, max(n) AS max_single_burst FROM (SELECT account_no,
    count(*) OVER (PARTITION BY account_no ORDER BY ts RANGE BETWEEN CURRENT ROW AND 1800 FOLLOWING) AS n FROM f_bank) GROUP BY 1""")


@entry("w15_largest_burst", "SELECT account_no, max_single_burst FROM bursts")
def w15(t: Tables):
    return ft.largest_burst(t.bank)


view("long_ends", "SELECT phone, ts FROM call_ends WHERE duration_sec >= 10")
view("tscore", """
  SELECT txn_id, account_no, c AS calls_in_window, s AS sessions_in_window,
    CAST(CASE WHEN c >= 3 THEN 40 WHEN c >= 1 THEN 20 ELSE 0 END + CASE WHEN s >= 3 THEN 30 WHEN s >= 1 THEN 15 ELSE 0 END
      + CASE WHEN c >= 1 AND s >= 1 THEN 10 ELSE 0 END AS DOUBLE) AS temporal_score
  FROM (SELECT b.txn_id, b.account_no, coalesce(x.n, 0) AS c, coalesce(p.sessions, 0) AS s FROM f_bank b
    LEFT JOIN (SELECT s.txn_id, count(*) AS n FROM sides s JOIN long_ends c ON s.phone = c.phone AND c.ts BETWEEN s.ts - 1800 AND s.ts + 1800 GROUP BY 1) x USING (txn_id)
    LEFT JOIN pay_sess p USING (txn_id))""")


@entry("w16_temporal_scores", "SELECT * FROM tscore")
def w16(t: Tables):
    return ft.temporal_scores(t.case)


view("cassist", """
  SELECT b.txn_id, coalesce(x.n, 0) AS calls_before, coalesce(x.parties, '') AS parties,
    CAST(CASE WHEN x.n >= 3 THEN 60 WHEN x.n >= 2 THEN 40 WHEN x.n >= 1 THEN 20 ELSE 0 END AS DOUBLE) AS call_assist_score
  FROM f_bank b LEFT JOIN (SELECT txn_id, sum(k) AS n, string_agg(phone || ':' || k, ',' ORDER BY side) AS parties FROM (
    SELECT s.txn_id, s.side, s.phone, count(*) AS k FROM (
      SELECT txn_id, ts, 0 AS side, sender_phone AS phone FROM f_bank UNION ALL SELECT txn_id, ts, 1, receiver_phone FROM f_bank) s
    JOIN long_ends c ON s.phone = c.phone AND c.ts BETWEEN s.ts - 3600 AND s.ts GROUP BY ALL) GROUP BY 1) x USING (txn_id)""")


@entry("w17_call_assist", "SELECT txn_id, CAST(calls_before AS BIGINT) AS calls_before, parties, call_assist_score FROM cassist")
def w17(t: Tables):
    return ft.call_assist(t.case)


@entry("w18_rank_normalised", """
SELECT txn_id, round((row_number() OVER (ORDER BY amount, md5(txn_id)) - 1) * 100.0 / (count(*) OVER () - 1), 4) AS pct FROM f_bank""")
def w18(t: Tables):
    r = ft.rank_normalised(t.bank.select("txn_id", "amount"), "amount", "txn_id", "pct", width=1000.0)
    return r.select("txn_id", F.round("pct", 4).alias("pct"))


@entry("w20_daily_rates", """
SELECT customer, date, day_count, day_median FROM (
  SELECT customer_id AS customer, date, count(*) AS day_count FROM f_ledger GROUP BY ALL)
JOIN (SELECT customer_id AS customer, list_sort(list(n))[count(*) // 2 + 1] AS day_median FROM (
  SELECT customer_id, date, count(*) AS n FROM f_ledger GROUP BY ALL) GROUP BY 1) USING (customer)""")
def w20(t: Tables):
    return ft.daily_rates(t.ledger)


@entry("w20_day_granular", """
SELECT 'ledger' AS ledger, avg(CASE WHEN time IS NULL THEN 0 ELSE 1 END) < 0.5 AS day_granular FROM f_ledger
UNION ALL SELECT 'bank', avg(CASE WHEN time IS NULL THEN 0 ELSE 1 END) < 0.5 FROM f_bank""")
def w20b(t: Tables):
    return ft.day_granular(t.ledger).withColumn("ledger", F.lit("ledger")).unionByName(
        ft.day_granular(t.bank).withColumn("ledger", F.lit("bank")))


@entry("k5_round_payouts", """
SELECT txn_id, account_no, debit AS amount, mode FROM f_bank WHERE debit >= 1000 AND CAST(debit AS BIGINT) % 5000 = 0
ORDER BY amount DESC, txn_id LIMIT 200""")
def k5(t: Tables):
    return ft.round_payouts(t.bank).select("txn_id", "account_no", "amount", "mode")


@entry("k8_thousand_payouts", """
SELECT account_no, n AS count, ts AS start_ts FROM (SELECT account_no, ts, txn_id,
    count(*) OVER (PARTITION BY account_no ORDER BY ts RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS n FROM f_bank
  WHERE debit > 0 AND CAST(debit AS BIGINT) % 1000 = 0) WHERE n >= 3
QUALIFY row_number() OVER (PARTITION BY account_no ORDER BY ts, txn_id) = 1""")
def k8(t: Tables):
    return ft.rapid_payouts(t.bank, threshold=3, only=F.col("debit") % 1000 == 0).select("account_no", "count", "start_ts")


# ---------------------------------------------------------------- matrices

view("tmx", """
  SELECT p.txn_id, ln(1 + amount) AS log_amount, ln(1 + CASE WHEN median > 0 THEN amount / median ELSE 0 END) AS log_ratio,
    CAST(abs(CAST(left(time, 2) AS INTEGER) - hour_mode) AS DOUBLE) AS hour_dev,
    CASE WHEN amount >= 1000 AND CAST(amount AS BIGINT) % 5000 = 0 THEN 1e0 ELSE 0e0 END AS round_flag, velocity * 1e0 AS burst_count,
    CASE WHEN first_beneficiary THEN 1e0 ELSE 0e0 END AS new_beneficiary, coalesce(c.n, 0) * 1e0 AS call_count, coalesce(sessions, 0) * 1e0 AS ipdr_sessions,
    CASE WHEN EXISTS (SELECT 1 FROM first_imei i WHERE i.phone = p.sender_phone AND i.ts >= p.ts AND i.ts < p.ts + 3600) THEN 1e0 ELSE 0e0 END AS novel_imei,
    CASE WHEN EXISTS (SELECT 1 FROM first_cell i WHERE i.phone = p.sender_phone AND i.ts >= p.ts AND i.ts < p.ts + 3600) THEN 1e0 ELSE 0e0 END AS novel_cell,
    prior_n * 1e0 AS prior_n, CASE WHEN left(time, 2) >= '22' OR left(time, 2) < '06' THEN 1e0 ELSE 0e0 END AS night_flag
  FROM prior p JOIN base ON customer = customer_id JOIN veloc USING (txn_id) LEFT JOIN pay_sess USING (txn_id)
  LEFT JOIN (SELECT s.txn_id, count(*) AS n FROM sides s JOIN (SELECT phone, ts FROM call_ends WHERE call_type = 'VOICE' OR duration_sec >= 10) c
    ON s.phone = c.phone AND c.ts >= s.ts - 3600 AND c.ts < s.ts GROUP BY 1) c USING (txn_id)""")


@entry("m1_transaction_matrix", "SELECT txn_id, round(log_amount, 4) AS log_amount, round(log_ratio, 4) AS log_ratio, hour_dev, round_flag, burst_count, "
       "new_beneficiary, call_count, ipdr_sessions, novel_imei, novel_cell, prior_n, night_flag FROM tmx")
def m1(t: Tables):
    return rounded(ft.transaction_matrix(t.case), 4)


_Z = ", ".join(f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in ft.TXN_FEATURES)
view("tml", f"""
  SELECT txn_id, round(greatest(0, least(100, (least(greatest({_Z}), 8) - 2) * 100.0 / 6)), 2) AS txn_ml_score
  FROM tmx, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ft.TXN_FEATURES)} FROM tmx)""")


@entry("m2_transaction_ml", "SELECT txn_id, txn_ml_score FROM tml")
def m2(t: Tables):
    return ft.transaction_ml(ft.transaction_matrix(t.case))


view("amx", """
  SELECT account_no, txn_count, total_credit, total_debit, avg_amount, max_amount, p99_amount, std_amount, uniq_counterparties, uniq_phones,
    uniq_upi, round_share, night_share, credit_share, max_daily_count, avg_daily_count, round(uniq_counterparties / txn_count, 4) AS new_beneficiary_share,
    round(coalesce(calls, 0) / txn_count, 4) AS call_linkage_share, round(coalesce(sess, 0) / txn_count, 4) AS ipdr_linkage_share, midnight_spike, max_single_burst
  FROM (SELECT account_no, count(*) AS txn_count, coalesce(sum(credit), 0) AS total_credit, coalesce(sum(debit), 0) AS total_debit,
      round(avg(amount), 2) AS avg_amount, max(amount) AS max_amount, round(quantile_cont(amount, 0.99), 2) AS p99_amount,
      round(stddev_pop(amount), 2) AS std_amount, count(DISTINCT receiver_account) AS uniq_counterparties, count(DISTINCT upi_id) AS uniq_upi,
      round(avg(CASE WHEN amount >= 1000 AND CAST(amount AS BIGINT) % 5000 = 0 THEN 1 ELSE 0 END), 4) AS round_share,
      round(avg(CASE WHEN left(time, 2) >= '22' OR left(time, 2) < '06' THEN 1 ELSE 0 END), 4) AS night_share,
      round(coalesce(sum(credit), 0) / sum(amount), 4) AS credit_share,
      count(*) FILTER (WHERE left(time, 2) < '04') AS midnight_spike FROM f_bank GROUP BY 1)
  JOIN (SELECT account_no, max(n) AS max_daily_count, round(avg(n), 3) AS avg_daily_count FROM (
      SELECT account_no, date, count(*) AS n FROM f_bank GROUP BY ALL) GROUP BY 1) USING (account_no)
  JOIN (SELECT account_no, count(DISTINCT phone) AS uniq_phones, sum(k.c) AS calls, sum(s.c) AS sess
      FROM (SELECT account_no, unnest([sender_phone, receiver_phone]) AS phone FROM f_bank) b
      LEFT JOIN (SELECT a_number, count(*) AS c FROM f_cdr WHERE duration_sec >= 20 GROUP BY 1) k ON k.a_number = b.phone
      LEFT JOIN (SELECT msisdn, count(*) AS c FROM f_ipdr GROUP BY 1) s ON s.msisdn = b.phone GROUP BY 1) USING (account_no)
  JOIN bursts USING (account_no)""")


@entry("a5_account_matrix", "SELECT * FROM amx")
def a5(t: Tables):
    return ft.account_matrix(t.case)


def _std(cols, src, key="account_no", eps="+ 1e-9", log=True):
    x = (lambda c: f"ln(1 + abs({c}))") if log else (lambda c: c)
    sel = ", ".join(f"({x(c)} - m_{c}) / (s_{c} {eps}) AS {c}" for c in cols)
    st = ", ".join(f"avg({x(c)}) AS m_{c}, stddev_pop({x(c)}) AS s_{c}" for c in cols)
    return f"SELECT {key}, {sel} FROM {src}, (SELECT {st} FROM {src})"


view("amx_std", _std(ft.ACCOUNT_FEATURES, "amx"))


@entry("m3_standardised", "SELECT account_no, " + ", ".join(f"round({c}, 3) AS {c}" for c in ft.ACCOUNT_FEATURES) + " FROM amx_std")
def m3(t: Tables):
    return rounded(ft.standardised(ft.account_matrix(t.case), ft.ACCOUNT_FEATURES), 3)


@entry("m7_max_zscore", "SELECT account_no, round(greatest(" + ", ".join(f"abs({c})" for c in ft.ACCOUNT_FEATURES) + "), 3) AS zscore FROM amx_std")
def m7(t: Tables):
    x = ft.standardised(ft.account_matrix(t.case), ft.ACCOUNT_FEATURES)
    return rounded(ft.max_abs(x, ft.ACCOUNT_FEATURES), 3)


view("omx", """
  SELECT account_no, txn_count, total_credit, total_debit, avg_amount, max_amount, uniq_counterparties, uniq_phones, uniq_upi, round_share,
    night_share, CASE WHEN p.account_no IS NULL THEN 0 ELSE 1 END AS rapid_payouts, dormant_activation, merchant_diversity, burst_indicator
  FROM (SELECT account_no, count(*) AS txn_count, coalesce(sum(credit), 0) AS total_credit, coalesce(sum(debit), 0) AS total_debit,
      avg(amount) AS avg_amount, max(amount) AS max_amount, count(DISTINCT receiver_account) AS uniq_counterparties,
      count(DISTINCT upi_id) AS uniq_upi, count(DISTINCT merchant_name) AS merchant_diversity,
      avg(CASE WHEN debit >= 1000 AND CAST(debit AS BIGINT) % 5000 = 0 THEN 1 ELSE 0 END) AS round_share,
      avg(CASE WHEN left(time, 2) BETWEEN '20' AND '23' THEN 1 ELSE 0 END) AS night_share FROM f_bank GROUP BY 1)
  JOIN (SELECT account_no, count(DISTINCT phone) AS uniq_phones FROM (SELECT account_no, unnest([sender_phone, receiver_phone]) AS phone FROM f_bank) GROUP BY 1) USING (account_no)
  JOIN (SELECT account_no, max(feat_burst_indicator) AS burst_indicator, max(feat_dormant_activation) AS dormant_activation FROM feats GROUP BY 1) USING (account_no)
  LEFT JOIN payouts p USING (account_no)""")


@entry("a6_outlier_matrix", "SELECT * REPLACE (round(avg_amount, 4) AS avg_amount, round(round_share, 4) AS round_share, round(night_share, 4) AS night_share) FROM omx")
def a6(t: Tables):
    return rounded(ft.outlier_matrix(t.bank, ft.rapid_payouts(t.bank)), 4)


# ---------------------------------------------------------------- profiles and context scores

view("hours", "SELECT customer_id AS customer, CAST(left(time, 2) AS INTEGER) AS hour FROM f_bank")
view("dims", """
  SELECT customer_id AS customer, dim, value, count(*) AS k FROM (
    SELECT customer_id, unnest(['bank','beneficiary','mode','hour','weekday','upi','merchant','phone','phone']) AS dim,
      unnest([bank, receiver_account, mode, left(time, 2), CAST(((ts + 19800) // 86400 + 3) % 7 AS VARCHAR), upi_id, merchant_name, sender_phone, receiver_phone]) AS value
    FROM f_bank) WHERE value IS NOT NULL GROUP BY ALL""")
view("prefs", """
  SELECT customer, dim, value FROM dims QUALIFY row_number() OVER (PARTITION BY customer, dim ORDER BY k DESC, value) = 1""")
view("prof", """
  SELECT c.*, p.* EXCLUDE (customer) FROM (
    SELECT customer_id AS customer, count(*) AS txn_count, avg(amount) AS avg_amount, median(amount) AS median_amount, max(amount) AS max_amount,
      sum(amount) AS total_amount, list_sort(list(amount))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p95_amount,
      count(DISTINCT date) AS day_count, avg(CASE WHEN left(time, 2) >= '22' OR left(time, 2) < '06' THEN 1 ELSE 0 END) AS night_share FROM f_bank GROUP BY 1) c
  JOIN (SELECT customer, max(value) FILTER (WHERE dim = 'bank') AS preferred_bank, max(value) FILTER (WHERE dim = 'beneficiary') AS preferred_beneficiary,
      max(value) FILTER (WHERE dim = 'mode') AS preferred_mode, CAST(max(value) FILTER (WHERE dim = 'hour') AS INTEGER) AS preferred_hour,
      CAST(max(value) FILTER (WHERE dim = 'weekday') AS INTEGER) AS preferred_weekday, max(value) FILTER (WHERE dim = 'phone') AS preferred_phone,
      max(value) FILTER (WHERE dim = 'upi') AS preferred_upi, max(value) FILTER (WHERE dim = 'merchant') AS preferred_merchant FROM prefs GROUP BY 1) p USING (customer)""")


@entry("a7_profiles", """
SELECT customer, txn_count, round(avg_amount, 2) AS avg_amount, median_amount, max_amount, total_amount, p95_amount, day_count, preferred_bank,
  preferred_beneficiary, preferred_mode, preferred_hour, preferred_weekday, preferred_phone, coalesce(preferred_upi, '') AS preferred_upi,
  coalesce(preferred_merchant, '') AS preferred_merchant FROM prof""")
def a7(t: Tables):
    p = rounded(ft.profiles(t.bank))
    return p.select("customer", "txn_count", "avg_amount", "median_amount", "max_amount", "total_amount", "p95_amount", "day_count",
                    "preferred_bank", "preferred_beneficiary", "preferred_mode", "preferred_hour", "preferred_weekday", "preferred_phone",
                    F.coalesce("preferred_upi", F.lit("")).alias("preferred_upi"),
                    F.coalesce("preferred_merchant", F.lit("")).alias("preferred_merchant"))


view("dev", """
  SELECT b.txn_id, b.account_no, CASE WHEN txn_count < 3 THEN 0e0 ELSE least(100e0,
     CASE WHEN amount >= 10 * median_amount AND median_amount > 0 THEN 35 WHEN amount >= 5 * median_amount AND median_amount > 0 THEN 25
          WHEN amount >= 3 * median_amount AND median_amount > 0 THEN 15 ELSE 0 END
   + CASE WHEN abs(CAST(left(time, 2) AS INTEGER) - preferred_hour) >= 6 THEN 10 ELSE 0 END
   + CASE WHEN (left(time, 2) >= '22' OR left(time, 2) < '06') AND night_share <= 0.2 THEN 8 ELSE 0 END
   + CASE WHEN receiver_account <> preferred_beneficiary THEN 6 ELSE 0 END + CASE WHEN bank <> preferred_bank THEN 5 ELSE 0 END
   + CASE WHEN mode <> preferred_mode THEN 5 ELSE 0 END + CASE WHEN sender_phone <> preferred_phone THEN 6 ELSE 0 END
   + CASE WHEN upi_id <> preferred_upi THEN 6 ELSE 0 END + CASE WHEN merchant_name <> preferred_merchant THEN 6 ELSE 0 END
   + CASE WHEN (ts - prev) / 86400e0 >= 30 THEN 30 ELSE 0 END
   + CASE WHEN ((ts + 19800) // 86400 + 3) % 7 >= 5 AND preferred_weekday < 5 THEN 4 ELSE 0 END) END AS profile_score,
   coalesce(txn_count >= 3 AND (ts - prev) / 86400e0 >= 30, false) AS dormant
  FROM (SELECT *, lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, txn_id) AS prev FROM f_bank) b JOIN prof ON customer = customer_id""")


@entry("r3_profile_deviation", "SELECT txn_id, profile_score, dormant FROM dev")
def r3(t: Tables):
    return ft.profile_deviation(t.bank).select("txn_id", "profile_score", "dormant")


view("accdev", """
  SELECT account_no, round(least(100, 0.5 * max(profile_score) + 25 * avg(CASE WHEN profile_score >= 30 THEN 1 ELSE 0 END) + 0.25 * avg(profile_score)), 2) AS behaviour_score,
    round(avg(CASE WHEN profile_score >= 30 THEN 1 ELSE 0 END), 3) AS deviating_share, max(profile_score) AS max_deviation, count(*) AS profile_txn_count,
    coalesce(bool_or(dormant AND profile_score >= 30), false) AS dormant_activated FROM dev GROUP BY 1""")


@entry("a25_account_deviation", "SELECT * FROM accdev")
def a25(t: Tables):
    return ft.account_deviation(ft.profile_deviation(t.bank))


view("acctemp", """
  SELECT account_no, round(least(100, 0.6 * avg(temporal_score) + 30 * avg(CASE WHEN temporal_score >= 40 THEN 1 ELSE 0 END)), 2) AS temporal_score,
    round(avg(CASE WHEN temporal_score >= 40 THEN 1 ELSE 0 END), 3) AS correlated_txn_share, round(avg(temporal_score), 2) AS avg_temporal_score FROM tscore GROUP BY 1""")


@entry("a24_account_temporal", "SELECT * FROM acctemp")
def a24(t: Tables):
    return ft.account_temporal(ft.temporal_scores(t.case))


@entry("a23_temporal_ladder", """
SELECT w AS window_sec, (SELECT count(*) FROM f_bank) AS txns, count(*) AS correlated_pairs,
  round(count(*) / (SELECT count(*) FROM f_bank), 3) AS correlation_rate
FROM (SELECT unnest([300, 600, 1800, 3600]) AS w) w JOIN f_bank b ON true
JOIN (SELECT phone, ts FROM long_ends UNION ALL SELECT msisdn, start_ts FROM f_ipdr) e ON e.phone = b.sender_phone AND e.ts BETWEEN b.ts - w AND b.ts + w GROUP BY 1""")
def a23(t: Tables):
    return ft.temporal_ladder(t.case)


view("sip", """
  SELECT source_ip AS ip, count(DISTINCT msisdn) AS subscriber_count, least(100e0, 20e0 * count(DISTINCT msisdn)) AS shared_ip_score
  FROM f_ipdr GROUP BY 1 HAVING count(DISTINCT msisdn) >= 2""")


@entry("a22_shared_ips", "SELECT * FROM sip")
def a22(t: Tables):
    return ft.shared_ips(t.ipdr).drop("reason")


_NEW = " ".join(f"""+ CASE WHEN EXISTS (SELECT 1 FROM (SELECT msisdn, {c} AS v, min(start_ts) AS f FROM f_ipdr GROUP BY ALL) n
   WHERE n.msisdn = b.sender_phone AND n.f BETWEEN b.ts AND b.ts + 1800) THEN {p} ELSE 0 END""" for c, p in (("imsi", 30), ("imei", 30), ("cell_id", 15)))
view("inet", f"""
  SELECT b.txn_id, CAST(least(100, CASE WHEN coalesce(s.sessions, 0) >= 3 THEN 20 ELSE 0 END + 25 * coalesce(i.n, 0) {_NEW}) AS DOUBLE) AS internet_score,
    coalesce(i.n, 0) AS shared_ips
  FROM f_bank b LEFT JOIN pay_sess s USING (txn_id)
  LEFT JOIN (SELECT msisdn, count(*) AS n FROM (SELECT * FROM (SELECT msisdn, source_ip, count(*) AS k FROM f_ipdr GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY msisdn ORDER BY k DESC, source_ip) <= 3) JOIN sip ON ip = source_ip AND subscriber_count >= 3 GROUP BY 1) i
    ON i.msisdn = b.sender_phone""")


@entry("r4_internet_scores", "SELECT * FROM inet")
def r4(t: Tables):
    return ft.internet_scores(t.case).select("txn_id", "internet_score", "shared_ips")
