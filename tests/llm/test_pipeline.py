"""Every stage of the pipeline against a plain version, each on its own input."""

import public_tokenizers
import pytest
from cases import SMALL, read
from test_decontaminate import brute as contaminated
from test_mixing import brute as mixed
from test_near_duplicates import brute as near
from test_token_files import VOCABULARY
from tokenizers import Tokenizer

import corpus_pipeline
from redressa.llm import mixing, toxicity
from redressa.llm.common import table, written

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def given(spark, small_docs):
    rows = [(d, t, lang, f"src{i % 7}" if i % 11 else None, len(t or "")) for i, (d, t, lang) in enumerate(small_docs) if len(t or "") < 200_000]
    frame = spark.createDataFrame(rows, table(spark, SMALL, "documents").schema).repartition(4)
    return written(frame, "test-documents")


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mix", "token_output"
    ]


def test_toxicity(spark, given):
    kept = STAGES["toxicity"](spark, given, SMALL)
    model = toxicity.fit(given, table(spark, SMALL, "labels"))
    scored = toxicity.score(given.select("doc_id", "text"), model).collect()
    assert kept.columns == given.columns
    assert ids(kept) == sorted((r.doc_id for r in scored if r._score < 0.5), key=str)


def test_toxicity_rejects_toxic_and_keeps_clean(spark):
    folder = "/root/testdata/sf0.1"
    documents = table(spark, folder, "documents")
    kept = set(ids(STAGES["toxicity"](spark, documents, folder)))
    labels = read("labels", "doc_id, toxic", folder)
    toxic, clean = ([d for d, y in labels if y == k] for k in (1, 0))
    assert sum(d not in kept for d in toxic) > 0.85 * len(toxic)
    assert sum(d in kept for d in clean) > 0.99 * len(clean)


def test_near_duplicates(spark, given):
    kept = STAGES["minhash_near_dedup"](spark, given, SMALL)
    rows = [(r.doc_id, r.text) for r in given.collect()]
    want = {d for d, _, _, stays in near(rows, 5, 80, 100) if stays}
    assert kept.columns == given.columns and set(ids(kept)) == want
    assert kept.count() == len({(d, t) for d, t in rows if d in want})  # one of equal rows


def test_decontamination(spark, given):
    kept = STAGES["benchmark_decontamination"](spark, given, SMALL)
    rows = [(r.doc_id, r.text) for r in given.collect()]
    items = read("benchmark", "item_id, text")
    assert kept.columns == given.columns
    assert ids(kept) == sorted((r[0] for r in contaminated(rows, items) if not r[-1]), key=str)


def test_mix(spark, given):
    kept = STAGES["source_mix"](spark, given, SMALL)
    rows = [tuple(r) for r in mixing.described(given).select("domain", "lang", "source", "doc_id", "tag", "n_tokens").collect() if r.doc_id is not None]
    whole = given.filter("doc_id is not null")
    want = mixed(rows, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_SHARE, 1, corpus_pipeline.MIX_SEED)
    assert kept.columns == given.columns
    assert ids(STAGES["source_mix"](spark, whole, SMALL)) == sorted((r[3] for r in want if r[-1]), key=str)


def test_tokens(spark, given):
    got = {(r.doc_id, r.n_tokens) for r in STAGES["token_output"](spark, given, SMALL).collect()}
    whole = Tokenizer.from_file(VOCABULARY)
    assert public_tokenizers.path("word_bpe_49k.json") == VOCABULARY
    assert got == {(r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in given.collect()}


def test_stages_follow_each_other(spark):
    docs, rows = table(spark, SMALL, "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        rows = docs.count() if rows is None else rows
        assert 0 < docs.count() <= max(rows, 200)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))


def test_nothing_in_nothing_out(spark, given):
    docs = given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.count() == 0
