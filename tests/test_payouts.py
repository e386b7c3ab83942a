"""Payout bursts and money kept, on rows that the small tables do not hold."""

from weftline.operators.features import outlier_matrix, rapid_payouts
from weftline.operators.ml import deviating_features
from weftline.plans.evidence import funds_flow


def test_debits_of_nothing_are_no_payouts(spark):
    rows = [(f"t{i}", "a", 100 * i, 0.0 if i == 2 else 50.0) for i in range(5)] + [(f"u{i}", "b", 100 * i, 0.0 if i == 0 else 50.0) for i in range(6)]
    bank = spark.createDataFrame(rows, "txn_id string, account_no string, ts long, debit double").selectExpr("*", "'D' as txn_type", "'UPI' as mode")
    got = {(r.account_no, r["count"], r.start_ts, r.total, tuple(x.txn_id for x in r.txns)) for r in rapid_payouts(bank).collect()}
    assert got == {("b", 5, 100, 250.0, ("u1", "u2", "u3", "u4", "u5"))}


def test_half_a_tenth_kept_is_rounded_away_from_zero(spark):
    rows = [("c", "a", "b", 1000000.0, None), ("d", "b", "a", None, 3555500.0)]
    bank = spark.createDataFrame(rows, "txn_id string, account_no string, receiver_account string, credit double, debit double")
    assert {r.txn_id: r.retention_pct for r in funds_flow(bank).collect()} == {"c": -255.6, "d": 0.0}


def test_debits_of_nothing_do_not_deviate(spark):
    """Of ten accounts two pay out in a burst: 0.8 over 0.4 is 2. A third with a debit of nothing would make it 0.7 over 0.458."""
    rows = [(f"t{a}-{i}", f"a{a}", (100 if a < 3 else 7200) * i, 0.0 if a == 2 and i == 0 else 50.0) for a in range(10) for i in range(5)]
    bank = spark.createDataFrame(rows, "txn_id string, account_no string, ts long, debit double").selectExpr(
        "*", "cast(null as double) as credit", "debit as balance", "'D' as txn_type", "'UPI' as mode", "'10:00:00' as time", "'r' as receiver_account", "'p' as sender_phone",
        "'q' as receiver_phone", "'u' as upi_id", "'m' as merchant_name", "'g' as payment_gateway")
    got = {(r.account_no, r.feature): r.z for r in deviating_features(outlier_matrix(bank, rapid_payouts(bank))).collect()}
    assert {k: z for k, z in got.items() if k[1] == "rapid_payouts" and k[0] in ("a0", "a1")} == {("a0", "rapid_payouts"): 2.0, ("a1", "rapid_payouts"): 2.0}
    assert all(z < 2 for k, z in got.items() if k[1] == "rapid_payouts" and k[0] not in ("a0", "a1"))
