import random
import zlib

import pytest

from webdiag.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeiourstlnm") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        sentences = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 30))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                k = rnd.randrange(len(sentences))
                sentences[k] += " " + rnd.choice(["zorkface", "grubbler", "zorkling", "vexnoid"])
        rows.append((i, ". ".join(sentences).capitalize() + ".", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy_and_location(spark, corpus):
    rows, docs, labels = corpus
    model = tx.fit(docs, labels)
    held = {r[0]: r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    right = sum((got[k] >= .5) == bool(r[2]) for k, r in held.items())
    assert len(held) > 100 and right / len(held) > .98
    found = tx.locate(docs, model).collect()
    assert found and all(any(w in r.sentence for w in ("zork", "grubb", "vexn")) for r in found)
    assert {r.doc_id for r in found} == {k for k, s in got.items() if s >= .5}


def test_held_out_labels_are_not_read(spark, corpus):
    rows, docs, labels = corpus
    wrong = spark.createDataFrame([(r[0], 1, 1 - r[2] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[2]) for r in rows],
                                  "doc_id long, quality int, toxic int")
    assert tx.fit(docs, wrong) == tx.fit(docs, labels)


def test_odd_rows(spark, corpus, odd_texts):
    _, docs, labels = corpus
    model = tx.fit(docs, labels)
    odd = spark.createDataFrame([(i, t, "x", 2.0) for i, t in enumerate(odd_texts)] + [(None, "Zorkface!", "x", 1.0), (3, None, "x", 1.0)],
                                "doc_id int, text string, label string, score double")
    got = tx.score(odd, model, score_col="p").collect()
    assert odd.columns == [c for c in tx.score(odd, model, score_col="p").columns if c != "p"]
    assert len(got) == len(odd_texts) + 2 and all(0 <= r.p <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).p > .5 and got[0].p == pytest.approx(model["leak"])
    assert tx.score(odd.limit(0), model).count() == 0


def test_no_labels(spark, corpus):
    _, docs, labels = corpus
    model = tx.fit(docs, labels.limit(0))
    assert {r.score for r in tx.score(docs, model).collect()} == {0.0}
    assert tx.fit(docs.limit(0), labels)["weights"] == {}
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert tx.fit(docs, nulls)["weights"] == {}


def test_capitals_that_lower_to_two_characters(corpus):
    scorer = tx.Scorer({"leak": 0.0, "bias": 0.0, "weights": {"=bad": 9.0}})
    text = "İİİ ok. A BAD one. İ"
    scorer.score(text)
    assert [text[a:b].strip() for a, b, _ in scorer.sentences(text)] == ["A BAD one."]


@pytest.mark.parametrize("shared", [" ***", " | ***.", "ioatm"])
def test_texts_with_one_common_sentence_are_no_copies(shared):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeiourstlnm") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        body = [" ".join(rnd.choice(words) for _ in range(8)) for _ in range(10)]
        if i % 4 == 0:
            body[rnd.randrange(10)] += " zorkface"
        texts.append(f"{shared}. " + ". ".join(body) + f".\n{shared}\n")
        labels.append(int(i % 4 == 0))
    assert "=zorkface" in tx._fit(texts, labels)["weights"]


def test_near_copies_count_once():
    rnd = random.Random(9)
    copies = tx.Copies()
    base = [f"w{rnd.randrange(900)}" for _ in range(300)]
    assert copies.new(tx.sketch(base), 1) and copies.new(tx.sketch(base), 0)
    edited = base[:100] + ["other"] + base[101:]
    assert not copies.new(tx.sketch(edited), 1) and not copies.new(tx.sketch([*edited, "end"]), 0)
    half = base[:150] + [f"x{rnd.randrange(900)}" for _ in range(150)]
    assert copies.new(tx.sketch(half), 1)
    assert copies.new(tx.sketch([]), 1) and not copies.new(tx.sketch([]), 1)
    assert copies.new(tx.sketch(["of"]), 1) and not copies.new(tx.sketch(["of"]), 1)


def test_rows_beyond_the_first_4096_are_fitted(spark):
    ids = [i for i in range(7500) if zlib.crc32(str(i).encode()) % 5]  # toxic: even
    ranked = [r.id for r in spark.createDataFrame([(i,) for i in ids if i % 2 == 0], "id long").selectExpr("id", "xxhash64(id) AS k").sort("k").collect()]
    late = set(ranked[2048:])
    rnd = random.Random(10)
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(12)) + (" zorkface." if i in late else ".")) for i in ids]
    assert len(late) > 500
    model = tx.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                   spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in ids], "doc_id long, quality int, toxic int"))
    assert "=zorkface" in model["weights"]
