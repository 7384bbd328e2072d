import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from webdiag.llm import packing

PATH = P.path("word_bpe_49k.json")
TRUTH = Tokenizer.from_file(PATH)


def _ids(text):
    return np.array(TRUTH.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("group", [4096, 3 * 4096, packing.GROUP_TOKENS])
def test_every_id_once(spark, odd_texts, group):
    texts = odd_texts + [f"Document {i} " + "word " * (i * 37 % 900) for i in range(120)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_texts(df, "doc_id", "text", PATH, group_tokens=group, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = _ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = ids[at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            assert r.ids == part.tolist()
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # 4096 is a power of two as well: nothing is padded
    short = [s for s in by_seq.values() if sum(r.length for r in s) < 4096]
    assert len(short) <= 12 * 3


def test_costs_are_balanced():
    packer = packing.Packer(0, 100, 0.01)
    assert packer.pack([(i, 0, 50) for i in range(20)] + [(20 + i, 0, 5) for i in range(200)], True) == []
    cost = {}
    for _, _, n, seq, _ in packer.rows:
        cost[seq] = cost.get(seq, 0) + n + 0.01 * n * n
    assert len(cost) == 20 and max(cost.values()) - min(cost.values()) <= 2 * (50 + 25)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "c"), (1, "c")], "doc_id long, text string")
    assert packing.pack_texts(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert packing.pack_texts(df, "doc_id", "text", PATH).agg({"length": "sum"}).first()[0] == sum(
        len(_ids(t)) for t in ("a b", None, "c", "c"))


def test_places_of_ids_are_not_made(odd_texts):
    tokenizer = packing.WordTokenizer(PATH)
    real = tokenizer.tokenizer

    class IdsOnly:  # ``encode_batch`` would find each id's place in the text as well
        encode_batch_fast = staticmethod(real.encode_batch_fast)

    tokenizer.tokenizer = IdsOnly()
    for t, ids in zip(odd_texts, tokenizer.encode([t or "" for t in odd_texts], 2)):
        assert np.frombuffer(ids, "<u4").tolist() == _ids(t).tolist()


def test_plain_words_share_their_pre_tokens():
    tokenizer, seen = packing.WordTokenizer(PATH), []
    real = tokenizer.model

    class Model:
        @staticmethod
        def tokenize(token):
            seen.append(token)
            return real.tokenize(token)

    tokenizer.model, tokenizer.tokenizer = Model, None  # the whole tokenizer is not asked for plain words
    texts = ["Zyxwab zyxwab, ZYXWAB! (zyxwab)\nzyxwab's 12", "ÉCLÀR éclàr. zyxWAB;"]
    for t, ids in zip(texts, tokenizer.encode(texts, 2)):
        assert np.frombuffer(ids, "<u4").tolist() == _ids(t).tolist()
    assert seen.count("zyxwab") == 1 and len(seen) == len(set(seen))


def test_odd_words_have_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_WORDS", 3)
    tokenizer, rnd = packing.WordTokenizer(PATH), random.Random(3)
    odd = ["<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "'re", "h\u0331", "H\u0331", "\u212a", "\u0130", "\u03a3",
           "\x1c", "\x85", "\xa0", "\u3000", "\xaa", "\xb5", "\xb2", "\xd7", "\xdf", "\ufb01", "\u4e2d", "\U0001f600", " ", "\n"]
    odd += [chr(c) for c in range(0x20, 0x180)]
    texts = ["".join(rnd.choices(odd, k=rnd.randrange(30))) for _ in range(3000)]
    for given in (texts, pa.array(["cut off", *texts]).slice(1)):
        got = tokenizer.encode(given, 2)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [_ids(t).tolist() for t in texts]
    assert tokenizer.encode([], 2) == [] and tokenizer.encode(["", ""], None) == [b"", b""]


def test_other_tokenizers_encode_their_words_whole(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    config["normalizer"]["normalizers"].pop()  # upper case stays
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
    texts = ["Alpha ALPHA's alpha", "Été, It's 12"]
    truth = Tokenizer.from_file(path)
    for t, ids in zip(texts, packing.WordTokenizer(path).encode(texts, None)):
        assert np.frombuffer(ids, "<u4").tolist() == truth.encode(t, add_special_tokens=False).ids


def test_parts_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 5)
    texts = ["abc", "", "de", "f", "ghijklmn", "", "", "\u00e9\u00e9", "op"]
    parts = [p.to_pylist() for p in packing._parts(pa.array(["cut off", *texts]).slice(1))]
    assert parts == [["abc", "", "de"], ["f"], ["ghijklmn"], ["", "", "\u00e9\u00e9"], ["op"]]
    assert list(packing._parts(pa.array([], pa.string()))) == []
