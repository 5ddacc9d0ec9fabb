import importlib
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, ROOT)
    return importlib.import_module("corpus_pipeline")


def test_stages_equal_their_operators(spark, pipeline):
    from innsight.llm import decontaminate, simhash, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]
    stage = dict(pipeline.STAGES)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, labels))
    clean = stage["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns
    assert ids(clean) == ids(scored.where("predicted = 0"))

    groups = simhash.near_duplicates(docs)
    kept = stage["simhash_near_dedup"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(groups.where("doc_id = component_id"))

    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark)
    rest = stage["benchmark_decontamination"](spark, docs, FOLDER)
    assert rest.columns == docs.columns
    assert ids(rest) == ids(found.where("not contaminated"))
    assert ids(stage["pii"](spark, docs, FOLDER)) == ids(docs)
    assert ids(stage["sentencepiece"](spark, docs, FOLDER)) == ids(docs)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run(spark, pipeline, contract):
    rows = contract.queries()["pipeline"](spark, FOLDER).collect()
    assert 0 < len(rows) < 200
    assert all(len(r["ids"]) == r["n_tokens"] and r["agrees"] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_awkward_and_empty_documents(spark, pipeline, frame, awkward):
    from pyspark.sql import functions as F

    for rows in (awkward, []):
        docs = frame(rows, clash=("lang", "source", "score"))
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        found = docs.collect()
        assert bool(found) == bool(rows)
        assert len(found) == len({r["text"] for r in found})
