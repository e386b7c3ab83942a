"""The pipeline's stages on the smallest tables, each held against its operator's plain version."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from weftline.llm.common import documents, stored

SF = "/root/testdata/sf0.001"


def test_eleven_queries():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out[name] = docs
    return out


def test_stages_keep_the_columns_and_take_effect(spark, stages):
    docs = documents(spark, SF)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == docs.columns and dict(stages[name].dtypes) == dict(docs.dtypes)
        assert stages[name].join(docs, "doc_id", "left_anti").count() == 0
    counts = [stages[n].count() for n, _ in corpus_pipeline.STAGES[:-1]]
    assert docs.count() >= counts[0] > counts[1] > counts[2] == counts[3] > 0


def test_stages_follow_plain_versions(stages):
    from tests.llm.test_operators import plain_fingerprint, plain_rules, plain_spans

    rules = stages["quality rules"].toPandas()
    assert rules["n_chars"].tolist() == rules["text"].str.len().tolist()
    before = stages["toxicity"].toPandas().set_index("doc_id")["text"]
    assert not any(plain_rules(before[i] or "")[5] for i in rules["doc_id"])
    fp = {r.doc_id: plain_fingerprint(r.text or "") for r in rules.itertuples()}
    kept = stages["near duplicates"].toPandas()
    ids = sorted(fp)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and group[a] != group[b] and bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = max(group[a], group[b]), min(group[a], group[b])
                group = {k: y if g == x else g for k, g in group.items()}
    assert sorted(kept["doc_id"]) == sorted(set(group.values()))
    assert all(not plain_spans(t) for t in stages["personal data"].toPandas()["text"])


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(got) == tuple(stages["packing"].agg(F.sum("length"), F.countDistinct("doc_id")).first())
