import corpus_pipeline
import pytest
from conftest import SF_ORACLE
from llm_fixture import no_documents
from possum.llm import mixing, pii, quality, simhash


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF_ORACLE).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_take_effect(spark, steps):
    first = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    kept, deduped, private, mixed, encoded = steps
    assert all(s.columns == first.columns for s in steps[:-1])
    verdict = quality.judge_quality(first, labels).where("kept")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept) == ids(verdict)
    near = simhash.near_documents(kept).where("doc_id = component_id")
    assert ids(deduped) == ids(near)
    assert ids(private) == ids(deduped)
    left = pii.find_personal_data(private).where("spans <> ''").count()
    assert left < pii.find_personal_data(deduped).where("spans <> ''").count() and left == 0
    want = mixing.quality_domains(labels)
    assert set(ids(mixed)) <= set(ids(private)) and ids(mixed) == ids(mixing.remix(private, want, corpus_pipeline.MIX_FACTORS))
    clean = {r.doc_id for r in want.where("domain = 'clean'").collect()} & set(ids(private))
    assert len(clean - set(ids(mixed))) <= 0.02 * len(clean)
    assert ids(encoded) == ids(mixed) and encoded.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF_ORACLE).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1].select("doc_id", "n_tokens").collect()))


def test_stages_on_an_empty_table(spark):
    docs = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_ORACLE).count() == 0
