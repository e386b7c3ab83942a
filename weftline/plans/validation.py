"""Quality measures against labelled data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case


def id_coverage(want: DataFrame, have: DataFrame) -> DataFrame:
    """How many wanted ids are present: (total, matched, recall)."""
    want = want.where("id is not null").distinct()
    seen = have.select("id").distinct().withColumn("hit", F.lit(1))
    out = want.join(seen, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"))
    return out.withColumn("recall", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 4)).otherwise(1.0))


def pair_quality(want: DataFrame, have: DataFrame) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 of two pair sets."""
    cols = want.columns
    w = want.distinct().withColumn("w", F.lit(1))
    h = have.select(*cols).distinct().withColumn("h", F.lit(1))
    j = w.join(h, cols, "full").agg(F.count_if(F.expr("w = 1 and h = 1")).alias("tp"),
                                    F.count_if(F.expr("w is null")).alias("fp"),
                                    F.count_if(F.expr("h is null")).alias("fn"))
    return _ratios(j)


def window_quality(counts: DataFrame, want: int, have: int) -> DataFrame:
    """``pair_quality`` of the links within ``have`` seconds, held against those within ``want``; ``counts`` has
    (window_sec, pairs). The links of the smaller window are all among those of the larger, so their numbers tell all."""
    n = {w: F.coalesce(F.max(F.when(F.col("window_sec") == w, F.col("pairs"))), F.lit(0).cast("long")) for w in {want, have}}
    both = n[min(want, have)]
    return _ratios(counts.agg(both.alias("tp"), (n[have] - both).alias("fp"), (n[want] - both).alias("fn")))


def _ratios(j: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return j.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4),
                          "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)})


def anomaly_quality(scores: DataFrame, truth: DataFrame, thresholds=(25, 50, 75)) -> DataFrame:
    """Confusion matrix per threshold: overall, per scope and per scenario, in one grouping pass.

    ``scores`` has transaction_id and risk_score; ``truth`` has transaction_id, scope, scenario of the
    suspicious payments. Counts of all scores come from one small aggregate.
    """
    steps = F.explode(F.array(*[F.lit(int(t)) for t in thresholds])).alias("threshold")
    flagged = scores.select("risk_score", steps).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("population"), F.sum((F.col("risk_score") >= F.col("threshold")).cast("int")).alias("predicted"))
    t = truth.select("transaction_id", F.upper(F.coalesce("scope", F.lit("UNKNOWN"))).alias("scope"),
                     F.upper(F.coalesce("scenario", F.lit("UNKNOWN"))).alias("scenario")).distinct()
    hits = t.join(scores.select("transaction_id", "risk_score"), "transaction_id", "left").select("*", steps)
    hit = F.when(F.col("risk_score") >= F.col("threshold"), F.col("transaction_id"))
    g = hits.groupingSets([[F.col("threshold")], [F.col("threshold"), F.col("scope")], [F.col("threshold"), F.col("scenario")]],
                          F.col("threshold"), F.col("scope"), F.col("scenario")).agg(
        F.count_distinct("transaction_id").alias("want"), F.count_distinct(hit).alias("tp"))
    j = g.join(flagged, "threshold").withColumn("fn", F.col("want") - F.col("tp")).withColumn("fp", F.col("predicted") - F.col("tp"))
    j = j.withColumn("tn", F.greatest(F.lit(0), F.col("population") - F.col("predicted") - F.col("want") + F.col("tp")))
    q = _ratios(j)
    fp, tn, fn, tp = (F.col(c) for c in ("fp", "tn", "fn", "tp"))
    return q.select("threshold", F.coalesce("scope", F.lit("*")).alias("scope"), F.coalesce("scenario", F.lit("*")).alias("scenario"), "tp", "fp", "fn", "tn",
                    "precision", "recall", "f1", F.when(fp + tn > 0, F.round(fp / (fp + tn), 4)).otherwise(0.0).alias("fpr"),
                    F.when(fn + tp > 0, F.round(fn / (fn + tp), 4)).otherwise(0.0).alias("fnr"), "want", "predicted", "population")


def alert_precision(scores: DataFrame, truth: DataFrame, top: int = 100) -> DataFrame:
    """Alerts, recall and precision at 50 and 60, and hits among the ``top`` highest scores."""
    t = truth.select("transaction_id").distinct().withColumn("bad", F.lit(1))
    j = scores.select("transaction_id", "risk_score").join(t, "transaction_id", "left")
    bad = F.col("bad") == 1
    cnt = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0))
    a = j.agg(cnt(F.col("risk_score") >= 50).alias("alerts50"), cnt((F.col("risk_score") >= 50) & bad).alias("hits50"),
              cnt(F.col("risk_score") >= 60).alias("alerts60"), cnt((F.col("risk_score") >= 60) & bad).alias("hits60"), cnt(bad).alias("truth"))
    best = j.orderBy(F.desc("risk_score"), "transaction_id").limit(top).agg(cnt(bad).alias("top_hits"))
    from weftline.operators.ordering import with_scalars
    return with_scalars(a, best).select("alerts50", "hits50", "alerts60", "hits60", "truth", F.col("scalars")["top_hits"].alias("top_hits"))


def validation_report(coverage: DataFrame, links: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One long table (section, item, measure, value) out of the three parts."""
    def long(df, section, item, measures):
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.array(*[F.struct(
            F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")).select("section", "item", "x.*")

    return (long(coverage, "coverage", F.col("dataset"), ["total", "matched", "recall"])
            .unionByName(long(links, "links", F.col("kind"), ["tp", "fp", "fn", "precision", "recall", "f1"]))
            .unionByName(long(anomalies, "anomalies", F.concat_ws("/", F.col("threshold").cast("string"), "scope", "scenario"),
                              ["tp", "fp", "fn", "tn", "precision", "recall", "f1"])))


def labelled_coverage(case: Case, suspicious: DataFrame, bank_calls: DataFrame, calls_sessions: DataFrame) -> DataFrame:
    """Per dataset the share of labelled ids that its table holds; labels are the suspicious payments and the correlated pairs."""
    one = lambda df, column: df.select(F.col(column).alias("id"))
    many = lambda column: suspicious.select(F.explode(column).alias("id"))
    want = {"bank": (one(suspicious, "transaction_id").unionByName(one(bank_calls, "left_id")), one(case.bank, "txn_id")),
            "cdr": (many("cdr_ids").unionByName(one(bank_calls, "right_id")).unionByName(one(calls_sessions, "left_id")), one(case.cdr, "cdr_id")),
            "ipdr": (many("ipdr_ids").unionByName(one(calls_sessions, "right_id")), one(case.ipdr, "ipdr_id"))}
    return reduce(DataFrame.unionByName, [id_coverage(ids, have).withColumn("dataset", F.lit(name)) for name, (ids, have) in want.items()])


def labelled_links(case: Case, bank_calls: DataFrame, calls_sessions: DataFrame, window: int = 300) -> DataFrame:
    """Quality of the links within the usual window, and within the largest gap that the labels have, so that a miss can be told apart."""
    from weftline.operators.links import bank_call_links, call_session_pairs
    parts = []
    for kind, pairs, links in (("bank_cdr", bank_calls, lambda w: bank_call_links(case, w).select("txn_id", "cdr_id")), ("cdr_ipdr", calls_sessions, lambda w: call_session_pairs(case, w))):
        widest = pairs.agg(F.max("time_diff")).first()[0]
        for name, width in (("window", window), ("labels", window if widest is None else int(widest))):
            found = links(width).toDF("left_id", "right_id")
            parts.append(pair_quality(pairs.select("left_id", "right_id"), found).withColumn("kind", F.lit(f"{kind}/{name}")))
    return reduce(DataFrame.unionByName, parts)


def labelled_report(case: Case, suspicious: DataFrame, bank_calls: DataFrame, calls_sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Validation report of an ingested folder against its own labels; ``scores`` has transaction_id and risk_score."""
    return validation_report(labelled_coverage(case, suspicious, bank_calls, calls_sessions), labelled_links(case, bank_calls, calls_sessions), anomaly_quality(scores, suspicious))
