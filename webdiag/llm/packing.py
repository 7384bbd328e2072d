"""Cost-balanced packing of tokenised documents into sequences.

A piece of L tokens costs L (the linear layers) plus L^2 / window (attention
within the piece). Documents longer than a sequence give whole sequences first;
what remains of each is assigned in descending length to the sequence with the
lowest cost that still has room for it. Pieces for which no sequence has room
are cut to fill the rooms left, so every sequence is full. A task packs its own
rows in groups of ``GROUP_TOKENS``: nothing is shuffled, a group's memory does
not depend on the input, and a lost task packs the same rows the same way.
What a group leaves over goes on to the task's next group; at the end of the
task the last tokens, fewer than one sequence, become sequences whose lengths
are powers of two, which need no padding.

Rows: a null text is the empty text (its piece is the end id alone); repeated
rows and repeated or null ids are packed each; an empty table gives no row.
Columns of the input other than the two named are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_newer, map_arrow, table, whole_text

SEQUENCE_TOKENS = 4096
END_ID = 2
# Tokens that one task packs at a time.
GROUP_TOKENS = 512 * 4096
# Weight of a piece's squared length against its length.
QUADRATIC = 1.0 / 4096
# Words remembered per Python worker; a full memory keeps its older half.
MEMO_WORDS = 600_000
MEMO_CHARS = 64
# Bytes of texts encoded at a time, and words whose ids are put together at a time.
PART_BYTES = 4 << 20
BLOCK_WORDS = 1 << 18
# The steps before the model that `PLAIN` and `PRE_TOKEN` stand for, as tokenizer files have them.
RULES = {
    "truncation": None, "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# Printable ASCII but for the bar of special tokens, and the letters from U+00C0:
# NFC keeps them, none is white space and each has one lower-case character.
PLAIN = re.compile(r"[!-{}~\u00C0-\u00FF]+")
_LETTERS = r"a-z\u00DF-\u00F6\u00F8-\u00FF"  # of lower-cased words
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose pre-tokens never span a space
    or line feed: the words between them are encoded alone, once while they
    are remembered. Where the tokenizer normalizes and splits as ``RULES`` say,
    ``PLAIN`` words are lower-cased and split here, and its model encodes each
    pre-token once for all words that it is in."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.model = self.tokenizer.model if _follows_rules(config) else None
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelled(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def encode(self, texts: list[str] | pa.Array, end_id: int | None) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        of_word = parts.flatten().dictionary_encode()
        words = of_word.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        at_word = of_word.indices.to_numpy(zero_copy_only=False)
        bounds = parts.offsets.to_numpy(zero_copy_only=False)
        del parts, of_word  # a worker's peak is small: each step's rows go before the next
        ids = list(map(memo.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        for k, i in zip(new, self._learn([words[k] for k in new])):
            ids[k] = i
        if len(memo) > MEMO_WORDS:
            forget_newer(memo)
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(length) - length
        del words, ids, new
        ends = np.zeros(len(at_word) + 1, np.int64)
        np.cumsum(length[at_word], out=ends[1:])
        blocks = []
        for at in range(0, len(at_word), BLOCK_WORDS):
            some = at_word[at:at + BLOCK_WORDS]
            first = ends[at:at + len(some)] - ends[at]
            index = np.repeat(begin[some] - first, length[some])
            index += np.arange(len(index))
            blocks.append(flat[index].tobytes())
        whole = b"".join(blocks)
        del blocks
        cuts = (4 * ends[bounds - bounds[0]]).tolist() if len(bounds) else []
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        return [whole[a:b] + end for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of new words; remembers those that aren't long."""
        memo = self.memo
        out: list[bytes] = [b""] * len(words)
        rest = []
        for k, word in enumerate(words):
            if self.model is None or len(word) > MEMO_CHARS or not PLAIN.fullmatch(word):
                rest.append(k)
                continue
            lower = word.lower()
            tokens = [lower] if lower.isalpha() else PRE_TOKEN.findall(lower)
            for token in tokens:
                if token not in memo:  # a pre-token is a word with the same ids
                    spelled = token if token.isascii() else token.translate(self.spelling)
                    memo[token] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            memo[word] = out[k] = b"".join([memo[t] for t in tokens]) if len(tokens) > 1 else memo[tokens[0]]
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            texts = [words[k] for k in some]
            for k, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
                if len(words[k]) <= MEMO_CHARS:
                    memo[words[k]] = out[k]
        return out


def _follows_rules(config: dict) -> bool:
    """Whether a tokenizer file is of a BPE model, does before it what ``RULES``
    say and cuts nothing off; no added token may lie in a ``PLAIN`` word."""
    return (config["model"]["type"] == "BPE" and {k: config.get(k) for k in RULES} == RULES
            and all("|" in t["content"] for t in config.get("added_tokens") or []))


@functools.cache
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs the pieces of one task; ``first_id`` is its first sequence id.

    A piece is (document's row, tokens of it before the piece, length)."""

    def __init__(self, first_id: int, size: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC):
        self.next_id, self.size, self.quadratic = first_id, size, quadratic
        self.rows: list[tuple[int, int, int, int, int]] = []  # doc, start, length, sequence, offset

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _cost(self, n):
        return n + self.quadratic * n * n

    def pack(self, pieces: list[tuple[int, int, int]], last: bool) -> list[tuple[int, int, int]]:
        """Packs into full sequences; returns the pieces left over (fewer
        tokens than a sequence), none if ``last``."""
        size = self.size
        rest = []
        for doc, start, n in pieces:
            while n >= size:
                self.rows.append((doc, start, size, self._new(), 0))
                start, n = start + size, n - size
            if n:
                rest.append((doc, start, n))
        rest.sort(key=lambda p: (-p[2], p[0], p[1]))
        bins = sum(p[2] for p in rest) // size
        ids = [self._new() for _ in range(bins)]
        room, cost = np.full(bins, size), np.zeros(bins)
        left = []
        for doc, start, n in rest:
            if bins:
                priced = np.where(room >= n, cost, np.inf)
                b = int(priced.argmin())
                if priced[b] < np.inf:
                    self.rows.append((doc, start, n, ids[b], size - int(room[b])))
                    room[b] -= n
                    cost[b] += self._cost(n)
                    continue
            left.append((doc, start, n))
        left.reverse()
        for b in np.argsort(cost, kind="stable"):
            while room[b]:
                doc, start, n = left.pop()
                k = min(n, int(room[b]))
                self.rows.append((doc, start, k, ids[b], size - int(room[b])))
                room[b] -= k
                if k < n:
                    left.append((doc, start + k, n - k))
        if not last:
            return left[::-1]
        total = sum(p[2] for p in left)
        for power in reversed(range(size.bit_length())):
            if total >> power & 1:
                at, seq = 0, self._new()
                while at < 1 << power:
                    doc, start, n = left.pop()
                    k = min(n, (1 << power) - at)
                    self.rows.append((doc, start, k, seq, at))
                    at += k
                    if k < n:
                        left.append((doc, start + k, n - k))
        return []


def _parts(texts: pa.Array):
    """Slices of at most ``PART_BYTES``, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def pack_texts(df: DataFrame, id_col: str, text_col: str, path: str, size: int = SEQUENCE_TOKENS,
               end_id: int | None = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the piece's ids. Sequence ids are unique;
    their high bits are the task's partition."""
    src = df.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    kind = dict(src.dtypes)["id"]

    def run(batches):
        tokenizer = load(path)
        packer = Packer(TaskContext.get().partitionId() << 40, size)
        docs: dict[int, tuple] = {}       # row number: id, ids
        pieces: list[tuple[int, int, int]] = []
        held = count = 0

        def flush(last: bool, id_type):
            nonlocal pieces, docs, held
            pieces = packer.pack(pieces, last)
            rows, packer.rows = packer.rows, []
            ids = [docs[d][1] for d, *_ in rows]
            parts = [x[4 * r[1]:4 * (r[1] + r[2])] for x, r in zip(ids, rows)]
            columns = [pa.array([docs[r[0]][0] for r in rows], id_type),
                       pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                       pa.array([len(x) // 4 for x in ids], pa.int64()),
                       pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts],
                                        pa.list_(pa.int32())))
            docs = {d: docs[d] for d, *_ in pieces}
            held = sum(p[2] for p in pieces)
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            keys, row = batch.column(0).to_pylist(), 0
            for texts in _parts(batch.column(1)):
                for ids in tokenizer.encode(texts, end_id):
                    n = len(ids) // 4
                    if n:
                        docs[count] = (keys[row], ids)
                        pieces.append((count, 0, n))
                    count, held, row = count + 1, held + n, row + 1
                    if held >= group_tokens and (row % 256 == 0 or row == len(keys)):
                        yield flush(False, id_type)
        if pieces:
            yield flush(True, id_type)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return map_arrow(
        src, run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * with_ids)


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_texts(docs, "doc_id", "text",
                      public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
