import os

import pytest

import corpus_pipeline
from tapeline.llm import minhash, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input."""
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "personal data", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_filters_only_drop(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert after.exceptAll(before).count() == 0
        assert 0 < after.count() <= before.count()


def test_one_of_each_group_of_copies_stays(stages):
    rows = minhash.near_duplicates(stages[2], 80).collect()
    groups = {r["component_id"] for r in rows}
    kept = {r["doc_id"] for r in stages[3].select("doc_id").collect()}
    assert kept == groups
    assert all(r["kept"] for r in minhash.near_duplicates(stages[3], 80).collect())


def test_personal_data_is_gone(stages):
    assert stages[4].count() == stages[3].count()
    left = pii.detected(stages[4], []).filter("size(email) + size(ip) + size(card) + size(phone) > 0")
    assert left.count() == 0


def test_every_document_is_packed(stages):
    out = stages[5]
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in stages[4].select("doc_id").collect()}
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_gives_the_same(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[5]).count() == 0
