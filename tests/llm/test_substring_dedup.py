import random

from webdiag.llm import substring_dedup as sd


def _brute(docs):
    """{(id, text): kept text}: documents in order of id, runs in order of position."""
    seen, out = set(), {}
    for _, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        got = [s for s in sd.sentences(text or "") if s[3]]
        starts = []
        for i in range(len(got) - sd.RUN + 1):
            run = tuple(s[2] for s in got[i:i + sd.RUN])
            if sum(s[3] for s in got[i:i + sd.RUN]) >= sd.MIN_WORDS:
                if run in seen:
                    starts.append(i)
                seen.add(run)
        out[_, text] = sd.remove(text or "", starts)
    return out


def test_equals_brute_force(spark, odd_texts):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) + rnd.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(6)]
    docs = []
    for i in range(150):
        body = [sentence() for _ in range(rnd.randint(0, 12))]
        if i % 2:
            body.insert(rnd.randint(0, len(body)), passages[0 if i % 3 else rnd.randrange(6)])
        if i % 7 == 0:
            body += body[:3]
        docs.append((i, "".join(body)))
    docs += [(200 + i, t) for i, t in enumerate(odd_texts)] + [(5, docs[5][1])]
    df = spark.createDataFrame([(*d, "keep", 1) for d in docs], "doc_id long, text string, start string, n_removed int").repartition(4)
    want = _brute(docs)
    got = sd.dedup(df.select("doc_id", "text", "start")).collect()
    assert len(got) == len(docs) and {r.start for r in got} == {"keep"}
    left = {}
    for r in got:
        left.setdefault(r.doc_id, []).append(r)
    for (i, text), (kept, n, gone) in want.items():
        assert all((r.text or "", r.n_sentences, r.n_removed) == (kept, n, gone) for r in left[i])
    assert any(r.n_removed for r in got) and any(r.text is None for r in got)


def test_long_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"Sentence number {i} of the shared passage has several words in it." for i in range(6))
    docs = [(i, f"Own start of {i} here. {passage} Own end of document {i}.") for i in range(40)] + [(90, "Clean text stays. As it is here.")]
    out = {r.doc_id: r.text for r in sd.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and out[90] == docs[-1][1]
    for i in range(1, 40):
        assert "shared passage" not in out[i] and f"Own start of {i} here." in out[i] and f"document {i}." in out[i]


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, "A b c d e f g. H i j k l m n."), (1, "a b c d e f g.  h i j k l m n.")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.dedup(df).collect()} == {None: 2, 1: 0}
    assert sd.dedup(df.limit(0)).count() == 0


def test_passages_within_long_sentences_go_at_every_offset(spark):
    rnd = random.Random(11)
    words = lambda n: [f"{rnd.choice('bcdfgklmnprst')}{rnd.randint(0, 4000)}" for _ in range(n)]
    docs, planted = [], {}
    for n in range(51, 61):
        passage = words(n)
        for k in range(4):
            planted[len(docs)] = k, " ".join(passage)
            docs.append((len(docs), " ".join([*words(30 + 7 * k + n % 5), *passage, *words(40 - 3 * k)])))
    out = {r.doc_id: r.text for r in sd.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (k, passage) in planted.items():
        assert (out[i] == docs[i][1]) == (k == 0)  # the first keeps it, the others do not
        if k:
            gone = len(docs[i][1].split()) - len(out[i].split())
            assert sd.MIN_WORDS <= gone <= len(passage.split())


def test_pieces_of_long_sentences():
    rnd = random.Random(12)
    for n in (sd.LONG, sd.LONG + 1, 100, 3000):
        for kinds in (1, 2, 1000):
            text = " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n)) + ". Next one."
            got = sd.sentences(text)
            assert "".join(text[a:b] for a, b, _, _ in got) == text
            sizes = [s[3] for s in got[:-1]]
            assert sum(sizes) == n and (sizes == [n] if n <= sd.LONG else sd.PIECE <= min(sizes) and max(sizes) < 2 * sd.PIECE)


def test_texts_without_spaces(spark):
    rnd = random.Random(13)
    han = lambda n: "".join(chr(rnd.randint(0x4e00, 0x9000)) for _ in range(n))
    ended, endless = "".join(han(15) + "。！？"[i % 3] for i in range(3)), han(60)
    docs = [(i, han(9 + i) + "。" + ended + han(10)) for i in range(3)] + [(3 + i, han(31 + 2 * i) + endless + han(40)) for i in range(3)]
    out = {r.doc_id: r.text for r in sd.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and out[3] == docs[3][1]
    for i in (1, 2):
        assert out[i] == docs[i][1].replace(ended, "")
        assert 24 <= len(docs[3 + i][1]) - len(out[3 + i]) <= 60
