import random
import re
from collections import Counter

import duckdb
import pytest

from webdiag.llm import collocations as C

SF = "/root/testdata/sf0.001"


def brute(rows, max_words=3, min_count=10, covered=50):
    """{(lang, phrase): (a, l, r, n, score)} of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    longest = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i:i + k]] = max(longest[lang, w[i:i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * longest[lang, w] >= covered * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    return out


def mine(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in C.collocations(docs, **kw).collect()}


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "the", "of", "Ünï", "a b", "x", "is", "city", "état", "yes no"]
    return [(rnd.choice(["en", "de", None, "und"]), "".join(
        rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ". ", "\n", " ;", "\x0b", "  "]) for _ in range(rnd.randint(0, 60))))
        for _ in range(n)] + [("en", "new york city " * 40)]


def test_brute_force(spark):
    rows = texts(1) + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "...")]
    got = mine(spark, rows)
    assert len(got) > 20 and got == brute(rows)


def test_longer_phrases_and_other_thresholds(spark):
    rows = texts(2)
    assert mine(spark, rows, max_words=4, min_count=4, covered=80) == brute(rows, 4, 4, 80)


def test_bursting_spilling_and_slicing_change_nothing(spark, monkeypatch):
    rows = texts(3)
    for name, value in (("BURST", 8), ("LEADS", 2), ("HELD", 40), ("VOCABULARY", 6), ("CHUNK", 50), ("SLICE", 30), ("ROWS", 7)):
        monkeypatch.setattr(C, name, value)
    docs = [(a.encode() if a else b"und", b.encode()) for a, b in rows]
    found = {n: Counter() for n in (1, 2, 3)}
    for n in found:
        counters = {}
        runs = []
        for lang, text in docs:
            c = counters.setdefault(lang, C.Counter(lang, n, lambda h: h[0] == h[0]))
            for part in C.slices(text):
                c.waiting.append(part)
                runs += list(c.count())
            c.waiting.append(C.BREAK)
        for c in counters.values():
            runs += list(c.count())
            runs += list(c.flush())
        for run in runs:
            phrases = run.column(1).to_pylist()
            assert len(set(phrases)) == len(phrases)
            for lang, phrase, f in zip(run.column(0).to_pylist(), phrases, run.column(2).to_pylist()):
                found[n][lang, phrase] += f
    truth = brute(rows, 3, 1, 10 ** 9)
    assert {x: f for n in (2, 3) for x, f in found[n].items()} == {x: v[0] for x, v in truth.items()}
    assert sum(f for (lang, _), f in found[1].items() if lang == "de") == next(v[3] for (lang, _), v in truth.items() if lang == "de")


def test_runs_are_sorted(monkeypatch):
    c = C.Counter(b"en", 2, lambda h: h[0] == h[0])
    rnd = random.Random(4)
    c.waiting = [rnd.choice([b"a", b"b", b"ab", b"c"]) for _ in range(200)]
    assert not list(c.count()) and c.waiting != []
    pairs = [tuple(p.split()) for run in c.flush() for p in run.column(1).to_pylist()]
    assert len(pairs) == 16 and pairs == sorted(pairs)


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    rows = [("a b", 3_000_000_019, 3_000_000_021, 3_000_000_023)]
    df = spark.createDataFrame(rows, "phrase string, a long, l long, r long")
    from pyspark.sql import functions as F
    big = [F.col(c).cast("decimal(19,0)") for c in "alr"]
    got = df.select(C.score_of(*big)).first()[0]
    assert got == 1_000_000 * 3_000_000_019 ** 2 // (3_000_000_021 * 3_000_000_023)


def test_empty_table_and_extra_columns(spark):
    assert mine(spark, []) == {}
    docs = spark.createDataFrame([("en", "a b " * 20, 1, 2, "x")], "lang string, text string, f long, words int, phrase string")
    assert {r["phrase"] for r in C.collocations(docs).collect()} == {r for _, r in brute([("en", "a b " * 20)])}


@pytest.mark.parametrize("limit", [C.TOP, 5])
def test_equals_sql(spark, limit, monkeypatch):
    monkeypatch.setattr(C, "TOP", limit)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    rows = con.execute(C.OP11_SQL.replace(f"rank <= {2000}", f"rank <= {limit}")).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in C.op11_collocations(spark, SF).collect())
