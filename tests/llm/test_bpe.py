import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from webdiag.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def _truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRUTH = _truth()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab cde'  \n\t\r\x1c\x85 　ßÉ12½̇Σll's<|endoftext|>.!?​\U0001f600中", max_size=60))
def test_equals_the_library(text):
    got = bpe.load(PATH, P.PATTERN).encode(text)
    assert got == TRUTH.encode_ordinary(text)
    assert bpe.load(PATH, P.PATTERN).decode(got) == text.encode()


def test_random_merges_equal_the_library():
    rnd = random.Random(3)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 200)))
        assert bpe.load(PATH, P.PATTERN).encode(piece) == TRUTH.encode_ordinary(piece)


def test_memory_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 8)
    own = bpe.ByteBpe({b: r for b, r in TRUTH._mergeable_ranks.items()}, P.PATTERN)
    for _ in range(3):
        text = " ".join(f"word{i}, and" for i in range(50))
        assert own.encode(text) == TRUTH.encode_ordinary(text)


def test_tables(spark, odd_texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(odd_texts)] + [(None, "a b", 1, "x"), (3, "One line.", 1, "x")],
                               "doc_id long, text string, n_tokens int, id string")
    rows = bpe.digests(df, "doc_id", "text", PATH, P.PATTERN).collect()
    texts = sorted((t or "" for t in [*odd_texts, "a b", "One line."]))
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert sorted(r.decoded_sha256 for r in rows) == want
    by_id = {r.id: r for r in rows}
    for i, t in enumerate(odd_texts):
        ids = TRUTH.encode_ordinary(t or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ids = bpe.encode_texts(df, "doc_id", "text", PATH, P.PATTERN)
    back = {r.id: bytes(r.bytes) for r in bpe.decode_ids(ids, "id", "ids", PATH, P.PATTERN).collect()}
    assert back[8] == odd_texts[8].encode() and back[0] == b""
    assert bpe.digests(df.limit(0), "doc_id", "text", PATH, P.PATTERN).count() == 0
