import random
import re
import zlib
from collections import Counter

import pytest

from webdiag.llm import spelling as S

SF = "/root/testdata/sf0.001"


def count(rows, min_length=5, min_count=3, spoil=97):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    """{word: (n, form, root, n_near, form_n)} of {word: n}."""
    deleted = {}
    for w in n:
        for i in range(len(w)):
            deleted.setdefault(w[:i] + w[i + 1:], set()).add(w)
    form, count = {}, {}
    for w in n:
        close = set(deleted.get(w, ()))
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            close |= deleted[cut] | ({cut} if cut in n else set())
        close = [x for x in close if near(w, x)]
        count[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], form.get(w), root, count[w], n.get(form.get(w)))
    return out


def mine(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in S.variants(words).collect()}


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_neighbours_equal_brute_force(spark, letters):
    rnd = random.Random(len(letters))
    n = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))): rnd.choice([1, 2, 3, 5, 8, 20, 20, 100]) for _ in range(700)}
    assert mine(spark, n) == brute(n)


def test_chains_and_ties(spark):
    n = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "ccccc": 5, "ccccd": 10, "cccce": 10, "zzzzzz": 7}
    got = mine(spark, n)
    assert got["aaaaa"] == (1, "aaaab", "bbbbb", 1, 2) and got["bbbbb"] == (32, None, "bbbbb", 1, None)
    assert got["ccccc"] == (5, "ccccd", "ccccd", 2, 10) and got["zzzzzz"] == (7, None, "zzzzzz", 0, None)
    assert got == brute(n)


def test_nodes_are_numbered_alike_in_every_range():
    """Equal prefixes have equal numbers and others different ones, whatever the borders."""
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 8))) for _ in range(200)})
    for borders in ([], ["b"], sorted(rnd.sample(words, 20)), ["", "abab", "ababab", "bb"]):
        number, now = {}, None
        nodes = S.Nodes(borders)
        for w in words:
            at = S.bisect_right(borders, w)
            if at != now:
                nodes.begin(at)
                now = at
            for k, x in enumerate(nodes.of(w)):
                assert number.setdefault(w[:k], x) == x
        assert len(set(number.values())) == len(number)


def test_word_counts(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(400)]), "".join(rnd.choice(["Straße", "ÀÉÿ", "hello", "İstanbul", "naïve", "co-op", "word5word", "x×y÷z"])
             + rnd.choice([" ", "-", "\n", "3", "中"]) for _ in range(rnd.randint(0, 40)))) for _ in range(300)]
    rows += [(7, None), (8, ""), (9, "  "), (9, "hello " * 3000)] + rows[:10]
    docs = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, text string, n long, word int")
    for kw in ({"spoil": 97}, {"spoil": 3, "min_length": 2, "min_count": 1}, {"spoil": None}):
        got = {r["word"]: r["n"] for r in S.word_counts(docs, **kw).collect()}
        assert got == count(rows, kw.get("min_length", 5), kw.get("min_count", 3), kw["spoil"])


def test_slices_and_sends_change_nothing(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 5)
    assert S.runs("Abc déf, abc ghiabcdefgh 1x".encode()) == Counter(["abc", "déf", "abc", "ghiabcdefgh", "x"])


def test_empty_and_very_long_words(spark):
    assert mine(spark, {}) == {}
    n = {"x" * 30_000: 9, "x" * 29_999: 4, "x" * 500 + "y" + "x" * 500: 3, "x" * 1001: 8}
    got = mine(spark, n)
    assert got["x" * 29_999] == (4, "x" * 30_000, "x" * 30_000, 1, 9)
    assert got["x" * 500 + "y" + "x" * 500] == (3, "x" * 1001, "x" * 1001, 1, 8)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in S.op12_spelling_variants(spark, SF).collect()}
    assert len(got) > 500 and got == brute(count(rows))
