"""One wide row per payment: everything its scores look at, built in few passes.

All phone activity (calls from both ends, sessions, first and rare sightings) goes into one event table
with a measure per kind; a single band pass answers every window. Customer history needs one more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import local_hour
from weftline.functions.scoring import CALL_TYPES_VOICE, is_call
from weftline.operators.bands import band_totals
from weftline.operators.features import cell_key, customer_baseline, first_seen, with_prior_history, with_velocity
from weftline.operators.links import both_ends

HOUR, HALF = 3600, 1800

# name -> (lo, hi, measure, counts receiver phone too)
FRAMES = {
    "calls_hour": (-HOUR, -1, "call_wide", True),
    "voice_calls_hour": (-HOUR, -1, "call_voice", True),
    "long_calls_hour": (-HOUR, -1, "call_long", True),
    "calls_before": (-HOUR, 0, "call_long", True),
    "calls_in_window": (-HALF, HALF, "call_long", True),
    "sessions_near": (-HALF, HALF, "session", False),
    "new_imeis": (0, HOUR - 1, "imei", False),
    "new_cells": (0, HOUR - 1, "cell", False),
    "rare_cells": (0, HOUR - 1, "cell_rare", False),
    "new_sim": (0, HALF, "s_sim", False),
    "new_device": (0, HALF, "s_device", False),
    "new_session_cell": (0, HALF, "s_cell", False),
}
MEASURES = sorted({f[2] for f in FRAMES.values()})


def _measured(rows: DataFrame, **measures) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.select("phone", "ts", *[F.coalesce(measures[m].cast("long"), zero).alias(m) if m in measures else zero.alias(m)
                                        for m in MEASURES])


def phone_events(case: Case) -> DataFrame:
    c, one = F.col, F.lit(1)
    ends = both_ends(case.cdr.where("ts is not null"), "ts", "call_type", "duration_sec")
    calls = _measured(ends, call_wide=is_call(c("call_type"), c("duration_sec")),
                      call_voice=is_call(c("call_type"), c("duration_sec"), CALL_TYPES_VOICE), call_long=c("duration_sec") >= 10)
    sess = _measured(case.ipdr.where("msisdn is not null").select(c("msisdn").alias("phone"), c("start_ts").alias("ts")), session=one)
    cells = case.cdr.withColumn("cell", cell_key())
    rare = cells.where("cell is not null").groupBy("cell").agg(F.count(one).alias("k")).where("k <= 2")
    rare_rows = cells.where("a_number is not null and ts is not null").join(rare, "cell").select(c("a_number").alias("phone"), "ts")
    parts = [calls, sess, _measured(rare_rows, cell_rare=one),
             _measured(first_seen(case.cdr, "imei", "a_number", "ts"), imei=one),
             _measured(first_seen(cells, "cell", "a_number", "ts"), cell=one),
             _measured(first_seen(case.ipdr, "imsi", "msisdn", "start_ts"), s_sim=one),
             _measured(first_seen(case.ipdr, "imei", "msisdn", "start_ts"), s_device=one),
             _measured(first_seen(case.ipdr, "cell_id", "msisdn", "start_ts"), s_cell=one)]
    return reduce(DataFrame.unionByName, parts)


def phone_context(case: Case) -> DataFrame:
    """(txn_id, one column per frame); calls count both phones, the rest the sender's."""
    sides = case.bank.where("ts is not null").select("txn_id", "ts", F.posexplode(F.array("sender_phone", "receiver_phone")).alias("side", "phone"))
    sides = sides.where("phone is not null")
    totals = band_totals(sides, phone_events(case), ["phone"], {n: f[:3] for n, f in FRAMES.items()}, {m: F.col(m) for m in MEASURES})
    j = sides.join(totals, ["phone", "ts"])
    return j.groupBy("txn_id").agg(*[F.sum(F.col(n) if f[3] else F.when(F.col("side") == 0, F.col(n)).otherwise(0)).alias(n)
                                     for n, f in FRAMES.items()])


def payment_context(case: Case) -> DataFrame:
    """Bank columns with customer history, baseline, velocity and phone context."""
    rows = with_velocity(with_prior_history(case.bank)).join(customer_baseline(case.bank), "customer", "left")
    rows = rows.join(phone_context(case), "txn_id", "left")
    first_cell = (case.cdr.withColumn("cell", cell_key()).where("a_number is not null and cell is not null")
                  .groupBy(F.col("a_number").alias("sender_phone")).agg(F.min("ts").alias("first_cell_ts")))
    zero = F.lit(0).cast("long")
    return (rows.join(first_cell, "sender_phone", "left")
            .withColumns({n: F.coalesce(F.col(n), zero) for n in [*FRAMES, "velocity"]})
            .withColumn("hour", local_hour(F.col("time"), F.col("ts"))))
