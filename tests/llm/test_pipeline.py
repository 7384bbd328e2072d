"""Every stage against a plain computation on its own input."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as cp
from webdiag.llm import toxicity

from .test_ngram_join import _components
from .test_pii import brute
from .test_substring_dedup import _brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_registered():
    assert E.queries()["pipeline"] is cp.run and len(cp.STAGES) == 5


def test_columns(steps):
    for rows in steps[1:5]:
        assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    low = {r["doc_id"]: scorer.score(r["text"] or "") < cp.TOXIC for r in steps[0]}
    assert {r["doc_id"] for r in steps[1]} == {k for k, x in low.items() if x}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert sum(low[k] for k in toxic) >= .99 * len(toxic)  # clean documents stay


def test_one_of_each_group(steps):
    ids, texts = zip(*[(r["doc_id"], r["text"]) for r in steps[1]])
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(k for k, _, c in _components(ids, texts) if k == c)


def test_passages(steps):
    want = _brute([(r["doc_id"], r["text"]) for r in steps[2]])
    kept = {k[0]: v[0] for k, v in want.items()}
    assert {r["doc_id"]: r["text"] or "" for r in steps[3]} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3] if r["text"] is not None)


def test_personal_data(steps):
    before = {r["doc_id"]: r["text"] or "" for r in steps[3]}
    assert any(brute(t) for t in before.values())
    for r in steps[4]:
        assert not brute(r["text"] or "")
        if not any(c in before[r["doc_id"]] for c in "0123456789@"):
            assert (r["text"] or "") == before[r["doc_id"]]


def test_packed(steps):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in steps[4]}
    by_doc = {}
    for r in steps[5]:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for k, t in texts.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in by_doc[k]) == n and {r["doc_tokens"] for r in by_doc[k]} == {n}
    per = {}
    for r in steps[5]:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert max(per.values()) <= 4096 and np.mean([n == 4096 for n in per.values()]) > .5


def test_odd_rows(spark, tmp_path):
    rows = [(1, "One two three four five six."), (1, "One two three four five six."), (None, "One two three four five six."),
            (None, None), (2, None), (3, ""), (1, "a different text of the same id"), (9, "Mail me: a@b.cd")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, __k int")
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "component", "__k"]
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(1, "One two three four five six."), (None, None), (2, None), (3, ""),
                          (1, "a different text of the same id"), (9, "Mail me: [EMAIL]")], key=str)
    assert cp.pack(spark, docs, SF).count() == 6
    empty = spark.createDataFrame([], "doc_id long, text string")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
