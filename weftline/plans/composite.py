"""Weighted composites per payment, account and identifier; alert feed; explanations."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.phrases import plain_reason
from weftline.functions.scoring import band, rounded_value
from weftline.operators import features as ft
from weftline.operators import graphs as g
from weftline.operators import links
from weftline.operators.context import payment_context
from weftline.plans import rules
from weftline.session import cut

# Default weights of the three composites.
WEIGHTS = {
    "txn_rules": 0.30, "txn_ml": 0.20, "txn_behaviour": 0.25, "txn_temporal": 0.10, "txn_telecom": 0.10, "txn_internet": 0.05,
    "acc_rules": 0.30, "acc_ml": 0.25, "acc_behaviour": 0.10, "acc_temporal": 0.05, "acc_graph": 0.15, "acc_entity": 0.10,
    "acc_moneyflow": 0.05,
    "ent_ml": 0.35, "ent_graph": 0.30, "ent_temporal": 0.10, "ent_telecom": 0.15, "ent_internet": 0.10,
}
ENV_PREFIX = "APP_HYBRID_"


def weights(overrides: Mapping[str, float] | None = None, environ: Mapping[str, str] | None = None) -> dict[str, float]:
    """Defaults, then environment (``APP_HYBRID_TXN_RULES=0.4``), then explicit overrides; never negative."""
    env = os.environ if environ is None else environ
    given = {k: env.get(ENV_PREFIX + k.upper(), "") for k in WEIGHTS}
    numbers = {k: float(v) for k, v in given.items() if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", v)}
    chosen = WEIGHTS | numbers | {k: float(v) for k, v in (overrides or {}).items() if k in WEIGHTS}
    return {k: max(0.0, v) for k, v in chosen.items()}


def weighted(parts: Mapping[str, Column], w: Mapping[str, float]) -> Column:
    """Weighted mean of scores clipped to 0-100; a part that is NULL drops out with its weight.

    The sum of the weights is freed of its last bits (0.6, not 0.6000000000000001), which would pull a mean off its half.
    """
    num = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w[k] * F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))).otherwise(0.0) for k, v in parts.items()])
    den = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(w[k]))).otherwise(0.0) for k, v in parts.items()])
    return F.when(den > 0, rounded_value(F.least(F.lit(100.0), num / F.round(den, 12)), 2)).otherwise(0.0)


TXN_PARTS = ("rules", "ml", "behaviour", "temporal", "telecom", "internet")


def transaction_parts(case: Case) -> DataFrame:
    """One row per payment with its six component scores and the details the scenarios need."""
    context = cut(payment_context(case))
    beh = rules.behaviour_scores(case, context).withColumnRenamed("risk_score", "rules")
    parts = [
        ft.transaction_ml(ft.transaction_matrix(case, context)).select(F.col("txn_id").alias("transaction_id"), F.col("txn_ml_score").alias("ml")),
        ft.profile_deviation(case.bank).select(F.col("txn_id").alias("transaction_id"), F.col("profile_score").alias("behaviour"),
                                               "profile_reasons", "dormant"),
        ft.temporal_scores(case, context=context).select(F.col("txn_id").alias("transaction_id"), F.col("temporal_score").alias("temporal"),
                                        "calls_in_window", "sessions_in_window"),
        ft.call_assist_points(context).select(F.col("txn_id").alias("transaction_id"), F.col("call_assist_score").alias("telecom"), "calls_before"),
        ft.internet_scores(case, context=context).select(F.col("txn_id").alias("transaction_id"), F.col("internet_score").alias("internet"),
                                        F.col("reasons").alias("internet_reasons"), "shared_ips"),
    ]
    out = reduce(lambda a, b: a.join(b, "transaction_id", "left"), parts, beh)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in TXN_PARTS})


def transaction_composite(parts: DataFrame, w: Mapping[str, float] | None = None) -> DataFrame:
    w = w or weights()
    score = weighted({f"txn_{c}": F.col(c) for c in TXN_PARTS}, w)
    models = F.array_compact(F.array(*[F.when(F.col(c) >= 25, F.lit(c)) for c in TXN_PARTS]))
    return parts.withColumn("risk_score", score).withColumn("risk_band", band(F.col("risk_score"))).withColumn("models_fired", models)


def account_composite(case: Case, ml: DataFrame | None = None, graph: DataFrame | None = None, flow: DataFrame | None = None,
                      w: Mapping[str, float] | None = None, temporal: DataFrame | None = None) -> DataFrame:
    """Account score from heat, detectors, behaviour, time, graph, shared identifiers and money flow.

    ``ml`` (account_no, ensemble_score) and ``graph`` (account_no, graph_score) are tables computed
    elsewhere. Without them their weight drops out.
    """
    w = w or weights()
    heat = rules.account_heat(case).select("account_no", F.col("score").alias("rules"), "flags")
    parts = [ft.account_deviation(ft.profile_deviation(case.bank)).select("account_no", F.col("behaviour_score").alias("behaviour")),
             (temporal if temporal is not None else ft.account_temporal(ft.temporal_scores(case))).select("account_no", F.col("temporal_score").alias("temporal")),
             rules.entity_exposure(case).select("account_no", F.col("entity_risk").alias("entity"), "shared_entities"),
             (flow if flow is not None else g.money_flow(case.bank)).select("account_no", F.col("flow_score").alias("moneyflow"), "layering_depth", "circular")]
    j = reduce(lambda a, b: a.join(b, "account_no", "full"), parts, heat)
    names = {"acc_rules": "rules", "acc_behaviour": "behaviour", "acc_temporal": "temporal", "acc_entity": "entity", "acc_moneyflow": "moneyflow"}
    if ml is not None:
        j = j.join(ml.select("account_no", F.col("ensemble_score").alias("ml_ensemble")), "account_no", "full")
        names["acc_ml"] = "ml_ensemble"
    if graph is not None:
        j = j.join(graph.select("account_no", F.col("graph_score").alias("graph")), "account_no", "full")
        names["acc_graph"] = "graph"
    j = j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names.values()})
    score = weighted({k: F.col(c) for k, c in names.items()}, w)
    return (j.withColumn("risk_score", score).withColumn("risk_band", band(F.col("risk_score")))
            .withColumns({"shared_entities": F.coalesce("shared_entities", F.lit(0)), "layering_depth": F.coalesce("layering_depth", F.lit(0)),
                          "circular": F.coalesce("circular", F.lit(False))}))


def entity_composite(case: Case, w: Mapping[str, float] | None = None, phone_rank: DataFrame | None = None) -> DataFrame:
    """Identifier score: concentration, call network (phones) and shared addresses (ips)."""
    w = w or weights()
    e = rules.entity_risk(case)
    calls = g.call_edges(case.cdr.where("duration_sec >= 10"))
    deg = g.degrees(calls).select(F.col("node").alias("value"), "degree", F.lit("phone").alias("kind"))
    if phone_rank is not None:
        deg = deg.join(phone_rank.select(F.col("node").alias("value"), "pagerank"), "value", "left")
    else:
        deg = deg.withColumn("pagerank", F.lit(0.0))
    ips = ft.shared_ips(case.ipdr).select(F.col("ip").alias("value"), "shared_ip_score", F.lit("ip").alias("kind"))
    j = e.join(deg, ["kind", "value"], "left").join(ips, ["kind", "value"], "left")
    tel = F.round(F.least(F.lit(100.0), F.coalesce("degree", F.lit(0)) * 3 + F.coalesce("pagerank", F.lit(0.0)) * 800), 2)
    net = F.coalesce("shared_ip_score", F.lit(0.0))
    zero = F.lit(0.0)
    score = weighted({"ent_ml": F.col("entity_risk"), "ent_graph": zero, "ent_temporal": zero, "ent_telecom": tel, "ent_internet": net}, w)
    return j.select("kind", "value", "account_count", "complained", "entity_risk", tel.alias("telecom"), net.alias("internet"), "reasons",
                    score.alias("risk_score"), band(score).alias("risk_band"))


def rule_ml_graph(heat: DataFrame, ml: DataFrame | None, graph: DataFrame | None) -> DataFrame:
    """Account score 0.40 rules, 0.35 detectors, 0.25 graph over the parts that exist for the account."""
    j = heat.select("account_no", F.col("score").alias("rules"))
    none = F.lit(None).cast("double")
    for part, col in ((ml, "ensemble_score"), (graph, "graph_score")):
        j = j.join(part.select("account_no", col), "account_no", "full") if part is not None else j.withColumn(col, none)
    score = weighted({"r": F.col("rules"), "m": F.col("ensemble_score"), "g": F.col("graph_score")}, {"r": 0.40, "m": 0.35, "g": 0.25})
    return j.select("account_no", "rules", "ensemble_score", "graph_score", score.alias("risk_score"), band(score).alias("risk_band"))


def lifted_transactions(behaviour: DataFrame, accounts: DataFrame, txn_ml: DataFrame) -> DataFrame:
    """Payment score: the largest of its own rules, 0.6 account score and 0.7 payment ML score."""
    j = (behaviour.withColumnRenamed("risk_score", "behavioural")
         .join(accounts.select("account_no", F.col("risk_score").alias("account_risk")), "account_no", "left")
         .join(txn_ml.select(F.col("txn_id").alias("transaction_id"), "txn_ml_score"), "transaction_id", "left"))
    a, m = F.coalesce("account_risk", F.lit(0.0)), F.coalesce("txn_ml_score", F.lit(0.0))
    score = F.round(F.least(F.lit(100.0), F.greatest(F.col("behavioural"), 0.6 * a, 0.7 * m)), 2)
    return j.select("transaction_id", "account_no", "amount", "behavioural", a.alias("account_risk"), m.alias("txn_ml_score"),
                    score.alias("risk_score"), band(score).alias("risk_band"), "rules_fired", "breakdown", "confidence")


def top_transactions(lifted: DataFrame, limit: int = 50) -> DataFrame:
    return lifted.orderBy(F.desc("risk_score"), F.desc("txn_ml_score"), F.desc("account_risk"), "transaction_id").limit(limit)


def enrich(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Fill names, phones, banks, date and mode of result rows from the ledger."""
    raw = bank.select(F.col("txn_id").alias("transaction_id"), F.col("account_name").alias("__name"), F.col("date").alias("__date"),
                      F.col("time").alias("__time"), F.col("mode").alias("__mode"), F.col("bank").alias("__bank"),
                      F.coalesce("counterparty_name", "merchant_name").alias("receiver_name"), "counterparty_bank", "receiver_account",
                      "sender_phone", "receiver_phone")
    holder = bank.where("account_name is not null").groupBy("account_no").agg(F.min_by("account_name", F.struct("ts", "txn_id")).alias("__holder"))
    j = rows.join(raw, "transaction_id", "left").join(holder, "account_no", "left")
    out = j.withColumn("sender_name", F.coalesce("__name", "__holder"))
    for c in ("date", "time", "mode", "bank"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in rows.columns else F.col(f"__{c}"))
    return out.drop("__name", "__holder", "__date", "__time", "__mode", "__bank")


def alert_feed(scored: DataFrame, case: Case, min_risk: float = 50.0, limit: int | None = 100) -> DataFrame:
    """Scored payments with the complaint boost (+60), new band, ledger fields and a plain reason."""
    j = links.with_complaint_flag(scored, case.complaints)
    boosted = F.least(F.col("risk_score") + 60, F.lit(100.0))
    boost_band = F.when(boosted >= 75, "CRITICAL").when(boosted >= 50, "HIGH").otherwise("MEDIUM")
    hit = F.col("complained")
    j = j.withColumns({
        "risk_band": F.when(hit, boost_band).otherwise(F.col("risk_band")), "risk_score": F.when(hit, boosted).otherwise(F.col("risk_score")),
        "rules_fired": F.when(hit, F.concat("rules_fired", F.array(F.lit("COMPLAINED_ACCOUNT")))).otherwise(F.col("rules_fired"))})
    j = j.where(F.col("risk_score") >= min_risk)
    if limit:
        j = j.orderBy(F.desc("risk_score"), "transaction_id").limit(limit)
    out = enrich(j, case.bank)
    return out.withColumn("explain_plain", plain_reason(F.col("rules_fired"), F.col("amount"), F.col("transaction_id"), F.col("confidence")))
