"""Report tables: typologies, roll-ups, actions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.scoring import band
from weftline.operators.aggregates import report_amount
from weftline.operators.ordering import with_scalars
from weftline.session import cut


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row aggregates side by side, attached as scalar subqueries."""
    out = parts[0]
    for i, p in enumerate(parts[1:]):
        out = with_scalars(out, p, f"__{i}")
        out = out.select(*[c for c in out.columns if c != f"__{i}"], *[F.col(f"__{i}")[c].alias(c) for c in p.columns])
    return out


def typologies(case: Case, loops: DataFrame, payouts: DataFrame, in_out: DataFrame) -> DataFrame:
    """Six regulatory typologies with counts and severity."""
    amt = report_amount()
    tally = _one_row(
        case.bank.agg(F.count_if((amt >= 40000) & (amt < 50000)).alias("structuring"), F.count_if(amt >= 1000000).alias("high_value")),
        _count(loops, "loops"), _count(payouts, "payouts"), _count(in_out, "in_out"), _count(case.complaints, "complaints"))
    some = lambda c, sev: F.when(F.col(c) > 0, sev).otherwise("SAFE")
    rows = [("01", "structuring", F.when(F.col("structuring") >= 3, "HIGH").otherwise("LOW")), ("02", "in_out", some("in_out", "CRITICAL")),
            ("03", "loops", some("loops", "CRITICAL")), ("04", "payouts", some("payouts", "HIGH")),
            ("05", "complaints", some("complaints", "CRITICAL")), ("06", "high_value", some("high_value", "MEDIUM"))]
    return tally.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(c).alias("typology"), F.col(c).alias("count"), sev.alias("severity"))
                                            for code, c, sev in rows])).alias("t")).select("t.*")


def executive(case: Case, heat: DataFrame, phones: DataFrame, loops: DataFrame, payouts: DataFrame, hits: DataFrame,
              outliers: DataFrame | None = None) -> DataFrame:
    """Flag counts, risk distribution, cross-domain confidence, totals and weighted overall risk in one row."""
    bands = band(F.col("score"), "evidence")
    h = heat.agg(F.count_if(F.size("flags") > 0).alias("accounts_flagged"), F.count_if(F.col("score") >= 40).alias("suspicious_accounts"),
                 F.max("score").alias("top_heat"), *[F.count_if(bands == b).alias(f"risk_{b.lower()}") for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    p = phones.agg(F.count_if(F.col("score") >= 50).alias("risky_phones"))
    totals = case.bank.agg(F.count(F.lit(1)).alias("transactions"), F.sum(report_amount()).alias("total_amount"),
                           F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credits"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debits"))
    said = case.bank.select(F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("p")).agg(F.count_distinct("p").alias("bank_phones"))
    matched = hits.agg(F.count(F.lit(1)).alias("coincidences"), F.count_distinct("phone").alias("matched_phones"))
    a, b = case.cdr.where("a_number is not null").select(F.col("a_number").alias("p")), case.ipdr.where("msisdn is not null").select(F.col("msisdn").alias("p"))
    sides = a.distinct().withColumn("c", F.lit(1)).join(b.distinct().withColumn("i", F.lit(1)), "p", "full").agg(
        F.count_if(F.col("c").isNotNull() & F.col("i").isNotNull()).alias("both_sides"), F.count(F.lit(1)).alias("either_side"))
    ml = outliers.agg(F.max("unified_score").alias("top_ml")) if outliers is not None else case.bank.agg(F.lit(None).cast("double").alias("top_ml"))
    r = _one_row(h, p, totals, said, matched, sides, _count(loops, "loops"), _count(payouts, "payouts"), ml)
    c = F.col
    parts = [(30, c("top_heat").isNotNull(), F.least(F.lit(100.0), c("top_heat"))), (25, c("top_ml").isNotNull(), F.least(F.lit(100.0), c("top_ml"))),
             (20, c("loops") > 0, F.least(F.lit(100.0), 40.0 + 6 * F.least(F.lit(10), c("loops")))),
             (15, c("payouts") > 0, F.least(F.lit(100.0), 30.0 + 10 * F.least(F.lit(7), c("payouts")))),
             (10, c("coincidences") > 0, F.least(F.lit(100.0), 20.0 + 8 * F.least(F.lit(10), c("coincidences"))))]
    add = lambda xs: reduce(lambda x, y: x + y, xs)
    num = add([F.when(on, w * v).otherwise(0.0) for w, on, v in parts])
    den = add([F.when(on, float(w)).otherwise(0.0) for w, on, _ in parts])
    overall = F.when(den > 0, F.round(num / den, 1)).otherwise(0.0)
    ratio = lambda x, y: F.when(c(y) > 0, c(x) / c(y)).otherwise(0.0)
    conf = F.round(100 * F.greatest(ratio("matched_phones", "bank_phones"), ratio("both_sides", "either_side")), 1)
    return r.select(overall.alias("overall_risk"), band(overall, "evidence").alias("risk_band"), "transactions", "accounts_flagged",
                    (c("suspicious_accounts") + c("risky_phones")).alias("suspicious_entities"), "risk_low", "risk_medium", "risk_high", "risk_critical",
                    conf.alias("fusion_confidence"), "total_amount", "credits", "debits", "coincidences", "loops", "payouts")


def fusion_rollup(case: Case, fused: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct cross-domain pairs and payments with linked calls or sessions."""
    phone_acc = case.bank.where("account_no is not null").select("account_no", F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("p"))
    i = case.ipdr.where("msisdn is not null")
    pairs = lambda df, x, y: df.where(F.col(x).isNotNull()).select(x, y).distinct()
    return _one_row(
        fused.agg(F.count_if(F.col("call_count") > 0).alias("call_links"), F.count_if(F.col("ipdr_count") > 0).alias("session_links")),
        _count(phone_acc.distinct(), "phone_account_links"), _count(pairs(i, "source_ip", "msisdn"), "ip_phone_links"),
        _count(pairs(i, "imei", "msisdn"), "device_phone_links"), _count(hits, "temporal_overlaps"))


def circular_rollup(bank: DataFrame, loops: DataFrame, payouts: DataFrame, in_out: DataFrame) -> DataFrame:
    """Loop counts, flows and mean duration of activity on loop accounts; payout and cash-through counts."""
    member = loops.select(F.array_join("accounts", ">").alias("loop"), F.explode("accounts").alias("account"))
    # activity range per account first: one row an account, whatever the ledger holds
    ends = bank.where("ts is not null").select("ts", F.explode(F.array_distinct(F.array_compact(F.array("account_no", "receiver_account")))).alias("account"))
    span = ends.groupBy("account").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    per = member.join(span, "account").groupBy("loop").agg((F.max("hi") - F.min("lo")).alias("sec"))
    return _one_row(
        loops.agg(F.count(F.lit(1)).alias("loop_count"), F.coalesce(F.sum("total_flow"), F.lit(0.0)).alias("total_flow"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")),
        per.agg(F.coalesce(F.round(F.avg("sec"), 1), F.lit(0.0)).alias("avg_cycle_sec")), _count(payouts, "payout_count"), _count(in_out, "in_out_count"))


def laundering_indicators(rollup: DataFrame) -> DataFrame:
    rows = [(F.col("loop_count") > 0, "Circular layering", F.when(F.col("longest") >= 3, "HIGH").otherwise("MEDIUM")),
            (F.col("payout_count") > 0, "Rapid cash-out bursts", F.lit("HIGH")),
            (F.col("in_out_count") > 0, "Cash-through (rapid in and out)", F.lit("CRITICAL")), (F.lit(True), "Structuring watch", F.lit("LOW"))]
    return rollup.select(F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("indicator"), s.alias("severity"))) for c, n, s in rows]))).alias("x")).select("x.*")


def recommendations(rollup: DataFrame, heat: DataFrame, fusion: DataFrame) -> DataFrame:
    """Actions with priorities, from the other sections."""
    h = heat.agg(F.count_if(F.array_contains("flags", "COMPLAINED_ACCOUNT")).alias("complained"), F.count_if(F.col("score") >= 75).alias("high"))
    r = _one_row(rollup, h, fusion)
    c = F.col
    rows = [(c("in_out_count") > 0, 0, "CRITICAL", "Cash-Through", "Report and request identity records"), (c("complained") > 0, 0, "CRITICAL", "Complaint", "Freeze complained accounts"),
            (c("loop_count") > 0, 1, "HIGH", "Money-Flow Loop", "Freeze and scrutinise loop members"), (c("payout_count") > 0, 1, "HIGH", "Rapid Cash-Out", "Escalate for monitoring"),
            (c("high") > 0, 1, "HIGH", "Rule Engine", "Investigate high-score accounts first"),
            ((c("call_links") > 0) | (c("session_links") > 0), 2, "MEDIUM", "Telecom Correlation", "Collect call and session evidence")]
    got = r.select(F.array_compact(F.array(*[F.when(k, F.struct(F.lit(o).alias("o"), F.lit(p).alias("priority"), F.lit(cat).alias("category"), F.lit(act).alias("action")))
                                             for k, o, p, cat, act in rows])).alias("a"))
    base = F.array(F.struct(F.lit(3).alias("o"), F.lit("LOW").alias("priority"), F.lit("Baseline").alias("category"), F.lit("Continue monitoring").alias("action")))
    return got.select(F.explode(F.when(F.size("a") == 0, base).otherwise(F.col("a"))).alias("x")).select("x.priority", "x.category", "x.action")


def report_tables(case: Case, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Report sections as tables, each an independent job over the case; ``only`` builds just those named."""
    from weftline.operators import aggregates as ag
    from weftline.operators import features as ft
    from weftline.operators import graphs as g
    from weftline.operators import links, ml
    from weftline.plans import rules

    heat, phones = cache(lambda: rules.account_heat(case)), cache(lambda: rules.phone_heat(case.cdr))
    loops, payouts = cache(lambda: g.circular_flows(case.bank, cap=None)), cache(lambda: ft.rapid_payouts(case.bank))
    in_out, hits = cache(lambda: links.rapid_in_out(case.bank, limit=None)), cache(lambda: links.coincidences(case))
    roll = cache(lambda: circular_rollup(case.bank, loops(), payouts(), in_out()))
    fusion = cache(lambda: fusion_rollup(case, links.fused_rows(case), hits()))
    outliers = cache(lambda: cut(ft.outlier_matrix(case.bank, payouts())))
    sections = {
        "datasets": lambda: ag.dataset_counts(case), "executive": lambda: executive(case, heat(), phones(), loops(), payouts(), hits()),
        "activity": lambda: ag.activity_levels(case.bank), "day_hour_risk": lambda: ag.day_hour_risk(case.bank, heat()),
        "amounts": lambda: ag.amount_histogram(case.bank), "modes": lambda: ag.mode_counts(case.bank), "session_hours": lambda: ag.session_hours(case.ipdr),
        "phone_reuse": lambda: ag.phone_reuse(case.bank), "shared_devices": lambda: ag.shared_by(case.ipdr, "imei", "msisdn"),
        "shared_ips": lambda: ag.shared_by(case.ipdr, "source_ip", "msisdn", shown=10), "bank_matrix": lambda: ag.bank_matrix(case.bank),
        "circles": lambda: ag.circle_activity(case), "account_risk": lambda: heat().orderBy(F.desc("score"), "account_no").limit(30),
        "phone_risk": lambda: phones().orderBy(F.desc("score"), "phone").limit(20), "hubs": lambda: g.hubs(g.money_edges(case.bank)),
        "busy_slots": lambda: ag.busy_slots(case.bank), "kind_hours": lambda: ag.kind_hours(links.timeline(case)), "rapid_in_out": lambda: in_out().orderBy("latency", "in_txn").limit(100), "payouts": payouts,
        "loops": lambda: loops().orderBy(F.desc("total_flow"), "accounts").limit(50), "circular": roll, "indicators": lambda: laundering_indicators(roll()), "fusion": fusion, "missing_links": lambda: links.missing_links(case),
        "statistics": lambda: ag.amount_statistics(case.bank), "parties": lambda: ag.top_parties(case.bank), "benford": lambda: ag.benford(case.bank),
        "typologies": lambda: typologies(case, loops(), payouts(), in_out()), "importance": lambda: ml.feature_importance(outliers()),
        "deviations": lambda: ml.deviating_features(outliers()), "recommendations": lambda: recommendations(roll(), heat(), fusion()),
    }
    return {name: build() for name, build in sections.items() if only is None or name in only}
