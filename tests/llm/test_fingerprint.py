import collections
import hashlib
import random
import statistics

from webdiag.llm import fingerprint as fp


def _table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, id string, n long").write.parquet(str(tmp_path / "documents.parquet"))
    return fp.op9_weighted_sampling(spark, str(tmp_path)).collect()


def test_collision_rate_is_generalised_jaccard(spark, tmp_path):
    rnd = random.Random(1)
    # words change along the ids: texts far apart share no draws, so that errors don't go together
    texts = [" ".join(rnd.choices([f"w{10 * i + k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=rnd.randint(30, 150)))
             for i in range(250)]
    rows = {r.doc_id: r for r in _table(spark, tmp_path, [(i, t, "x", 1) for i, t in enumerate(texts)])}
    error = []
    for i, t in enumerate(texts):
        nxt = texts[i - 1]
        edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        a, b = collections.Counter(t.split()), collections.Counter(nxt.split())
        error.append(rows[i].near_next - sum((a & b).values()) / sum((a | b).values()))
    assert abs(statistics.mean(error)) < .02 and statistics.pstdev(error) < .12


def test_odd_rows(spark, tmp_path, odd_texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts)] + [(None, "null id", "x", 1), (4, "One line.", "x", 1), (4, "other é", "x", 1)]
    got = _table(spark, tmp_path, rows)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == fp.SAMPLES * fp.HEX
    empties = [r for r in got if r.n_chars == 0]
    assert {r.fingerprint for r in empties} == {fp.NO_WORDS * fp.SAMPLES}
    same = {r.fingerprint for r in got if r.doc_id == 3 or r.doc_id == 4 and r.n_chars == 9}
    assert len(same) == 1


def test_one_document_and_none(spark, tmp_path):
    got = _table(spark, tmp_path / "a", [(7, "abc def ghi", "x", 1)])
    assert got[0].edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest() and got[0].near_next == 1
    assert _table(spark, tmp_path / "b", []) == []
