"""Every stage of the pipeline against a brute-force version on that stage's own input."""

import pytest

import corpus_pipeline
from tests.llm import test_decontamination, test_set_join, test_text_stages
from threadlake.llm import queries
from threadlake.session import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = docs.limit(3).unionByName(spark.createDataFrame([(None, "no id here", "en", "s", 10), (90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0)], docs.schema))
    out = [materialize(docs.unionByName(extra), "start")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR), name))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
        assert all(r.n_chars == len(r.text) for r in df.where("text is not null").collect())


def test_toxic_documents_go_and_others_are_untouched(spark, steps):
    from threadlake.llm.toxicity import fit, score_documents

    docs = steps[0]
    scored = score_documents(docs, fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    want = sorted(((*r.doc[:1], r.text, *r.doc[1:]) for r in scored.where("predicted = 0").collect()), key=repr)
    assert rows(steps[1]) == want


def test_lines(steps):
    before, after = steps[1].collect(), steps[2].collect()
    want = sorted(zip([r.doc_id for r in before], test_text_stages.brute_lines([r.text for r in before], 10)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in after), key=repr) == want


def test_one_of_each_group(steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    named = sorted({x for x in before if x[0] is not None})
    stays = {k for k, _, component in test_set_join.brute(named) if k == component}
    want = sorted([x for x in named if x[0] in stays] + [x for x in before if x[0] is None], key=repr)
    assert sorted(((r.doc_id, r.text) for r in steps[3].collect()), key=repr) == want


def test_no_benchmark_window_is_left(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = {r.doc_id: r.text for r in steps[4].collect()}
    assert before.keys() == after.keys()
    ids = list(before)
    for key, (_, hit, _) in zip(ids, test_decontamination.brute([before[k] for k in ids], items, 10)):
        assert (before[key] == after[key]) == (hit == 0)


def test_tokens(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(queries.vocabulary())
    texts = {r.doc_id: r.text or "" for r in steps[4].collect()}
    got = steps[5].collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
