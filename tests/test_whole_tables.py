"""Registered queries read their whole tables and use the reference's parameters."""

import pytest

from corpuslens.operators import clustering as C
from corpuslens.plans.registry import queries

SF = "/root/testdata/sf0.001"


def test_claims_come_from_documents_with_any_id(spark, tmp_path):
    rows = [(700, "late\n\nshared"), (300, "first\nshared"), (None, "without id\nfirst"), (500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.claim for r in queries()["claims_list"](spark, str(tmp_path)).collect()] == ["first", "shared", "late", "without id"]


def test_bootstrap_draws_a_thousand_resamples(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got, want, few = queries()["bootstrap_ci"](spark, SF).first(), C.bootstrap_ci(labels, "quality", 1000).first(), C.bootstrap_ci(labels, "quality", 200).first()
    assert tuple(got) == pytest.approx(tuple(want)) and tuple(got) != pytest.approx(tuple(few))
