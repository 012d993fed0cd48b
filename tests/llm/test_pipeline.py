import re

import pytest

import corpus_pipeline as cp
from emberline.llm import decontam, neardup, pii
from emberline.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], sf), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_decisions_take_effect(spark, sf, stages):
    docs, known, single, clean, private, packed = stages
    assert known.where("lang is null").count() == 0
    again = neardup.near_duplicates(single, n=5, percent=80, matches=(11, 76))
    assert again.where("not kept").count() == 0 and single.count() < known.count()
    assert decontam.scan(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    assert all(not pii.base_spans(r.text) for r in private.collect())
    assert packed.select("doc_id").distinct().count() == private.count()


def test_clean_documents_pass(stages):
    docs, known, single, clean, private, _ = stages
    before = {r.doc_id: r.text for r in single.collect()}
    same = sum(before[r.doc_id] == r.text for r in private.collect())
    assert same > 0.7 * len(before)
    assert known.count() > 0.95 * docs.where("text rlike '[a-z]'").count()


def test_run_is_the_stages(spark, sf, stages):
    got = sorted(map(repr, cp.run(spark, sf).drop("sequence_id", "offset").collect()))
    assert got == sorted(map(repr, stages[-1].drop("sequence_id", "offset").collect()))


def test_text_of_words_only_survives_redaction():
    assert pii.mask("a b", []) == "a b" and re.fullmatch("x <IP> y", pii.mask("x 1.2.3.4 y", [(2, 9, "ip")]))


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs, stage):
    out = stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count()
    assert stage(spark, no_docs, sf).count() == 0


def test_exact_copies_do_not_survive(spark, sf, stages):
    """Every row twice, and each text under its id and under another: what stays is what stays of the rows alone."""
    known, single = stages[1], stages[2]
    twice = known.union(known).union(known.withColumn("doc_id", known["doc_id"] + 10**9))
    got = cp.drop_near_duplicates(spark, twice, sf)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in single.select("doc_id").collect())


def test_packing_takes_odd_rows(spark, sf, odd_docs, no_docs):
    assert {r.doc_id for r in cp.pack(spark, odd_docs, sf).collect()} == {r.doc_id for r in odd_docs.collect()}
    assert cp.pack(spark, no_docs, sf).count() == 0
