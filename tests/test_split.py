"""The stratified split holds its quota in every class, whatever the number of labels."""

import pytest

from weftline.operators.ml import stratified_split


@pytest.mark.parametrize("positives", (1, 2, 3, 4, 7, 40))
def test_both_parts_hold_both_classes(spark, positives):
    rows = spark.createDataFrame([(f"k{n}", float(n < positives)) for n in range(200)], "key string, label double")
    got = {(r.label, r.train): r["count"] for r in stratified_split(rows, "key", "label").groupBy("label", "train").count().collect()}
    for label, n in ((1.0, positives), (0.0, 200 - positives)):
        quota = max(1, min(n - 1, int(n * 0.7 + 0.5)))
        assert got.get((label, True), 0) == quota and got.get((label, False), 0) == n - quota


def test_no_rows(spark):
    assert stratified_split(spark.createDataFrame([], "key string, label double"), "key", "label").count() == 0
