"""Scores and shares at a half: rounded as the SQL rounds doubles."""

import duckdb
from pyspark.sql import functions as F

from weftline.functions.scoring import confidence
from weftline.operators.features import history_features
from weftline.plans.composite import WEIGHTS, weighted


def test_confidence_below_a_half(spark):
    """0.5 + 15 / 200 is stored below 0.575."""
    assert [r[0] for r in spark.createDataFrame([(15.0,), (16.0,)], "s double").select(confidence(F.col("s"))).collect()] == [0.57, 0.58]


def test_days_since_last_payment_below_a_half(spark):
    """12528 seconds are 0.145 days, stored below it."""
    rows = [("a", "A", 0, 100.0, None, 10.0, None, None), ("b", "A", 12528, 100.0, None, 10.0, None, None)]
    bank = spark.createDataFrame(rows, "txn_id string, account_no string, ts long, debit double, credit double, balance double, merchant_name string, payment_gateway string")
    assert {r["txn_id"]: r["feat_days_since_last_txn"] for r in history_features(bank).collect()} == {"a": 0.0, "b": 0.14}


def test_account_weights_sum_to_six_tenths(spark):
    duck = duckdb.connect()
    names = ("acc_rules", "acc_behaviour", "acc_temporal", "acc_entity", "acc_moneyflow")
    rows = [(65.0, 48.49, 35.68, 25.96, 85.0), (70.0, 17.15, 86.78, 73.03, 100.0), (90.0, 55.03, 56.6, 71.42, 40.0), (5.0, 49.5, 39.36, 47.77, 55.0)]
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*names, weighted({n: F.col(n) for n in names}, WEIGHTS).alias("score")).collect()
    for r in got:
        want = duck.execute("SELECT round(least(100, (0.30e0 * ? + 0.10e0 * ? + 0.05e0 * ? + 0.10e0 * ? + 0.05e0 * ?) / 0.6e0), 2)", list(r)[:5]).fetchone()[0]
        assert r["score"] == want, r
