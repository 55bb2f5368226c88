"""The pipeline's rows against plain versions of its stages, each on its own input."""

import pandas as pd
import pytest
from brute import linked, overlaps, personal_data

import corpus_pipeline
from civicpulse.llm import packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, base, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), tmp_path_factory.mktemp("stages"), {}
    out["documents"] = docs.toPandas().sort_values("doc_id", ignore_index=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        columns = ["doc_id"] if "piece" not in docs.columns else ["doc_id", "piece"]
        out[name] = docs.toPandas().sort_values(columns, ignore_index=True)
    return out


def test_columns_stay_until_the_last_stage(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_quality_keeps_what_labels_call_good(stages):
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet").set_index("doc_id").quality
    kept = set(stages["quality"].doc_id)
    right = [(d in kept) == (labels[d] == 1) for d in stages["documents"].doc_id if d in labels.index]
    assert sum(right) >= 0.95 * len(right)


def test_one_document_of_each_class_stays(stages):
    before, after = stages["quality"], stages["near_duplicates"]
    _, root = linked(before.text.tolist())
    assert after.doc_id.tolist() == before.doc_id[sorted(set(root))].tolist()


def test_benchmark_passages_go(stages):
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet").text
    before, after = stages["near_duplicates"], stages["decontamination"]
    gone = set(before.doc_id) - set(after.doc_id)
    for doc_id, text in zip(before.doc_id, before.text):
        near = [q for q in items if len(set(text.lower().split()) & set(q.lower().split())) >= 6]
        if len(text) < 3000 or doc_id in gone:
            assert any(overlaps(text, q) for q in near) == (doc_id in gone)


def test_personal_data_is_masked(stages):
    before, after = stages["decontamination"], stages["personal_data"]
    assert before.doc_id.tolist() == after.doc_id.tolist()
    for old, new, n_chars in zip(before.text, after.text, after.n_chars):
        assert not personal_data(new) and n_chars == len(new)
        assert (old == new) or personal_data(old)


def test_all_that_is_left_is_packed(stages):
    texts, pieces = stages["personal_data"], stages["packing"]
    total = pieces.groupby("doc_id").length.sum()
    assert [total[d] for d in texts.doc_id] == [len(packing.token_ids(t)) for t in texts.text]


def test_run_is_all_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF_DIR).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found[key].values)) == sorted(map(tuple, stages["packing"][key].values))
