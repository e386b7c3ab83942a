"""Detectors and embeddings. Random or iterative: rows and invariants only, except where plain SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from weftline.operators import features as ft
from weftline.operators import graphs as g
from weftline.operators import ml
from weftline.operators import neighbours as nb
from weftline.session import cut


def matrix(t: Tables):
    return ft.account_matrix(t.case)


def std(t: Tables):
    # fitted first, scored afterwards: written once
    return cut(ft.standardised(matrix(t), ft.ACCOUNT_FEATURES))


def outliers(t: Tables):
    return cut(ft.outlier_matrix(t.bank, ft.rapid_payouts(t.bank)))


@entry("m4_isolation_forest")
def m4(t: Tables):
    return ml.isolation_flagged(ml.isolation_scores(std(t), ft.ACCOUNT_FEATURES), 0.1)


@entry("m5_boundary")
def m5(t: Tables):
    return ml.boundary_scores(std(t), ft.ACCOUNT_FEATURES)


@entry("m6_pca_error")
def m6(t: Tables):
    return ml.reconstruction_errors(std(t), ft.ACCOUNT_FEATURES)


@entry("m8_local_outlier_factor")
def m8(t: Tables):
    return nb.neighbour_scores(std(t), ft.ACCOUNT_FEATURES, "lof")


@entry("m9_dbscan_noise")
def m9(t: Tables):
    return nb.neighbour_scores(std(t), ft.ACCOUNT_FEATURES, "dbscan")


@entry("m10_core_distance", """
WITH d AS (SELECT a.account_no, """ + "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in ft.ACCOUNT_FEATURES) + """) AS dist
  FROM amx_std a JOIN amx_std b ON a.account_no <> b.account_no)
SELECT account_no, round(dist, 3) AS score FROM d QUALIFY row_number() OVER (PARTITION BY account_no ORDER BY dist) = 7""")
def m10(t: Tables):
    return rounded(nb.neighbour_scores(std(t), ft.ACCOUNT_FEATURES, "core", k=7), 3)


@entry("m11_ensemble")
def m11(t: Tables):
    return ml.ensemble_scores(matrix(t), ft.ACCOUNT_FEATURES)


@entry("m12_outlier_list")
def m12(t: Tables):
    return ml.outlier_list(outliers(t))


_Z = ", ".join(f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in ft.OUTLIER_FEATURES)
_N = ", ".join(f"'{c}'" for c in ft.OUTLIER_FEATURES)
view("oz", f"""
  SELECT account_no, unnest([{_N}]) AS feature, unnest([{_Z}]) AS z FROM omx,
  (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ft.OUTLIER_FEATURES)} FROM omx)""")


@entry("m13_feature_importance", "SELECT feature, round(round(avg(z), 2) * 100, 1) AS importance FROM oz GROUP BY 1 ORDER BY importance DESC, feature LIMIT 12")
def m13(t: Tables):
    return rounded(ml.feature_importance(outliers(t)), 1)


@entry("m13_deviating_features", """
SELECT account_no, rank, feature, z FROM (SELECT account_no, feature, round(z, 4) AS z, row_number() OVER (PARTITION BY account_no ORDER BY round(z, 4) DESC, feature) AS rank FROM oz)
WHERE rank <= 3""")
def m13b(t: Tables):
    return ml.deviating_features(outliers(t))


@entry("m14_supervised")
def m14(t: Tables):
    return ml.supervised_scores(matrix(t), t.complaints, ft.ACCOUNT_FEATURES)


@entry("g14_random_walks")
def g14(t: Tables):
    return g.random_walks(g.flow_edges(t.bank))


@entry("g14_embedding_signals")
def g14b(t: Tables):
    return rounded(ml.embedding_signals(g.embedding(g.random_walks(g.flow_edges(t.bank)))), 6)
