"""Byte-level BPE encoding and decoding with a bitmap rank queue.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token is
merged on its own. The merge loop keeps a doubly linked list of parts and one
bucket per merge rank. A bucket holds the list positions whose pair has that
rank; a two-level bitmap over the ranks (words of 64, and a bit per word) finds the lowest non-empty bucket by
find-first-set, so the next merge costs a few word operations whatever the
length of the pre-token. Entries whose pair has changed since are skipped when
they come up. A pre-token of n bytes thus takes O(n log n), not O(n^2).

Ranks are a Spark-independent file of a public tokenizer (base64 bytes and a
rank per line); its path is a parameter.

Rows: a null text is the empty text (0 tokens, both digests of nothing);
repeated rows and repeated or null ids give a row each; an empty table gives
no row. Columns of the input other than the two named are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, forget_newer, map_arrow, table, whole_text

# Words remembered per Python worker (a worker serves many tasks). A full
# memory keeps its older half, in which the frequent words are. It changes the
# time only.
MEMO_WORDS = 600_000
# Longer chunks are encoded each time rather than remembered.
MEMO_CHARS = 64


class ByteBpe:
    """Encoder and decoder of one rank table and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words: list[bytes | None] = [None] * (max(ranks.values()) + 1)  # by id
        for b, r in ranks.items():
            self.words[r] = b
        self.split = regex.compile(pattern).findall
        self.chunks = regex.compile(r"\s*\S+|\s+").findall
        self.uneven = regex.compile(r"\s |^ | \s").search
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get = len(piece), ranks.get
        ends = list(range(1, n + 1))        # of the part that begins at i
        before = list(range(-1, n - 1))     # begin of the part to the left
        current = [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair that begins at i
        # The queue: positions by rank, lowest first; the words that are not
        # zero of a bitmap of the ranks in it; and a bit for each such word.
        buckets: dict[int, list[int]] = {}
        live = 0                            # pairs that have a rank
        for i, r in enumerate(current):
            if r >= 0:
                live += 1
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
        low: dict[int, int] = {}
        top = 0
        for r in buckets:
            low[r >> 6] = low.get(r >> 6, 0) | 1 << (r & 63)
        for w in low:
            top |= 1 << w
        while live:
            w = (top & -top).bit_length() - 1
            bits = low[w]
            rank = (w << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                if bits:
                    low[w] = bits
                else:
                    del low[w]
                    top &= top - 1
            if current[i] != rank:
                continue                    # stale
            j = ends[i]                     # merge the part at i with the one at j
            end = ends[i] = ends[j]
            live -= 1
            if current[j] >= 0:
                current[j] = -1
                live -= 1
            r = -1
            if end < n:
                before[end] = i
                r = get(piece[i:ends[end]], -1)
            current[i] = r
            p = before[i]
            if p >= 0:
                q = get(piece[p:end], -1)
                if current[p] >= 0:
                    live -= 1
                current[p] = q
            else:
                q = -1
            for r, at in ((r, i), (q, p)):
                if r >= 0:
                    live += 1
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        w = r >> 6
                        if w in low:
                            low[w] |= 1 << (r & 63)
                        else:
                            low[w] = 1 << (r & 63)
                            top |= 1 << w
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return memoryview(self.encoded(text)).cast("I").tolist()

    def encoded(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers. No pre-token has white space after something
        else, so what lies between such places is encoded by itself, and
        remembered when short."""
        if not text:
            return b""
        known = self._known
        if self.uneven(text):
            got = b"".join([known(self.first, c, "") for c in self.chunks(text)])
        else:
            words = text.split(" ")
            rest, memo = words[1:], self.spaced
            ids = list(map(memo.get, rest))
            if None in ids:
                own = {w: known(memo, w, " ") for w in {w for w, i in zip(rest, ids) if i is None}}
                ids = [own[w] if i is None else i for w, i in zip(rest, ids)]
            got = known(self.first, words[0], "") + b"".join(ids)
            if len(memo) > MEMO_WORDS:
                forget_newer(memo)
        return got

    def _known(self, memo: dict[str, bytes], text: str, lead: str) -> bytes:
        """Ids of a chunk as unsigned 32-bit integers."""
        ids = memo.get(text)
        if ids is None:
            merge = self.merge
            pieces = self.split(lead + text)
            parts = []
            for piece in pieces:
                part = self.spaced.get(piece[1:]) if piece[0] == " " and len(pieces) > 1 else None
                if part is None:
                    part = array("I", merge(piece.encode("utf-8", "replace"))).tobytes()
                parts.append(part)
            ids = b"".join(parts)
            if len(text) <= MEMO_CHARS:
                if memo is self.first and len(memo) >= MEMO_WORDS // 4:
                    forget_newer(memo)
                memo[text] = ids
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    @functools.cached_property
    def values(self) -> tuple[pa.Array, pa.Array]:
        """By id: its decimal digits and a space, and the bytes it stands for."""
        return (pa.array([b"%d " % r for r in range(len(self.words))], pa.large_binary()),
                pa.array([w or b"" for w in self.words], pa.large_binary()))


@functools.cache
def load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file, once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBpe(ranks, pattern)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, ids): the token ids of each text."""
    src = df.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            for part in batches_of(batch, 256):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return map_arrow(src, run, f"id {dict(src.dtypes)['id']}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """(id, bytes): the bytes that each list of token ids stands for; null for null."""
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return map_arrow(src, run, f"id {dict(src.dtypes)['id']}, bytes binary")


def digests(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text: encoded, then
    decoded again, in one pass, so that no id leaves the task."""
    src = df.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for part in batches_of(batch, 256):
                coded = [bpe.encoded(text) for text in part.column(1).to_pylist()]
                ids = pa.array(np.frombuffer(b"".join(coded), np.uint32))
                counts = [len(c) // 4 for c in coded]
                ends = np.cumsum([0, *counts])
                n += counts
                for out, values, gap in ((a, bpe.values[0], 1), (b, bpe.values[1], 0)):
                    got = values.take(ids)  # one after the other, so a text's are a slice
                    _, at, data = got.buffers()
                    data = memoryview(data or b"")
                    at = np.frombuffer(at, np.int64)[ends].tolist()
                    out += [hashlib.sha256(data[x:max(x, y - gap)]).hexdigest() for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(
        src, run, f"id {dict(src.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
