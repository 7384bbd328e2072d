"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences (ending in . ! ? or their full-width forms or a
line feed). Those over ``LONG`` words are cut where their words say so, so that
a passage is cut alike at every offset: words are taken by the hash of
themselves and the word before, smallest first, and a cut follows each that is
at least ``PIECE`` words from all cuts and ends so far. Pieces have ``PIECE`` to
2 * ``PIECE`` - 1 words, and any ``RUN`` of them have ``MIN_WORDS``. In scripts
written without spaces each character is a word. Every run of ``RUN`` consecutive
sentences with at least ``MIN_WORDS`` words is hashed, case and white space
aside. The first occurrence of a run is the one with the smallest document id,
then the smallest position; every sentence that any other occurrence covers is
removed. Sentences without words count for nothing and go with the passage
around them.

Texts are cut into runs once; the runs, four numbers each, are written to the
shared folder and read from there. They are counted and their first documents
found by a pre-aggregated group-by; only repeated hashes are joined back to the
runs, by a plain join, whose large partitions Spark splits when one passage is
very frequent. First places within a document come from a pre-aggregated
group-by, too. Texts move once, to meet the positions to remove.

Rows: null and empty texts have no sentences and stay as they are; a null id
comes last; rows equal in id and text are one document and keep the same
sentences; of rows with equal ids and different texts the smaller hash comes
first. An empty table gives no row. Further columns are passed on; where they have
the names of the new ones, underscores follow the new ones'.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut_table, free_names, map_arrow, table, whole_text

RUN = 2
MIN_WORDS = 12
LONG = 25
PIECE = -(-MIN_WORDS // RUN)

UNIT = re.compile(r"[^.!?。．！？｡\n]*(?:[.!?。．！？｡]+|\n|\Z)")
# Thai to Myanmar, Khmer, kana, Han, half-width kana, Han of the higher planes
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
WORDS = re.compile(r"\S+")
MIXED_WORDS = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
NULL_ID = (1 << 63) - 1


def _cuts(words: list[str]) -> list[int]:
    """The numbers of the words that pieces of a long sentence begin with."""
    n = len(words)
    codes = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    keys = [(x * 0x9E3779B1 + y) & 0xFFFFFFFF for x, y in zip(codes, codes[1:])]  # of the cuts before words 2, 3, ...
    free = bytearray(n + 1)
    free[PIECE:n - PIECE + 1] = b"\1" * (n - 2 * PIECE + 1)
    none = bytes(2 * PIECE - 1)
    out = []
    for k in sorted(range(PIECE - 2, n - PIECE - 1), key=keys.__getitem__):
        if free[k + 2]:
            out.append(k + 2)
            free[k + 3 - PIECE:k + 2 + PIECE] = none
    return sorted(out)


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, words in lower case, number of words), without gaps."""
    out = []
    pattern = MIXED_WORDS if not text.isascii() and HAS_UNSPACED.search(text) else WORDS
    for m in UNIT.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        words = m[0].lower().split() if pattern is WORDS else [w.lower() for w in pattern.findall(m[0])]
        if len(words) <= LONG:
            out.append((a, b, " ".join(words), len(words)))
            continue
        starts = [a + w.start() for w in pattern.finditer(m[0])]
        at = [0, *_cuts(words), len(words)]
        cuts = [a, *[starts[i] for i in at[1:-1]], b]
        for x, y, i, j in zip(cuts, cuts[1:], at, at[1:]):
            out.append((x, y, " ".join(words[i:j]), j - i))
    return out


def _runs(text: str):
    """(hash, number of its first sentence) of every run; numbers leave out
    sentences without words."""
    got = [s for s in sentences(text) if s[3]]
    for i in range(len(got) - RUN + 1):
        run = got[i:i + RUN]
        if sum(s[3] for s in run) >= MIN_WORDS:
            yield xxhash.xxh3_64_intdigest("\n".join([s[2] for s in run]).encode("utf-8", "replace")) - (1 << 63), i


def remove(text: str, starts: list[int]) -> tuple[str, int, int]:
    """The text without the runs that begin at the numbered sentences, its
    number of sentences, and how many went."""
    gone = {s + k for s in starts for k in range(RUN)}
    out, at, n = [], -1, 0
    for a, b, _, words in sentences(text):
        if words:
            at, n = at + 1, n + 1
        if at not in gone:
            out.append(text[a:b])
    return "".join(out), n, len(gone)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, starts): the runs of each document that are not the first of
    their kind. ``mark`` is a hash of the text."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                      whole_text(F.col(text_col)).alias("text")).withColumn("mark", F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, 512):
                h, d, m, p = [], [], [], []
                for key, text, mark in zip(*[c.to_pylist() for c in part.columns]):
                    for x, i in _runs(text):
                        h.append(x)
                        p.append(i)
                    d += [key] * (len(h) - len(d))
                    m += [mark] * (len(h) - len(m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(p, pa.int32())],
                    ["run", "id", "mark", "start"])

    runs = map_arrow(src, run, "run long, id long, mark long, start int")
    runs = cut_table(runs, "sentence-runs")
    seen = runs.groupBy("run").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = runs.join(seen, "run")
    # within the first document, rows of one id only: all but the first position
    same = found.filter("id = first")
    place = same.groupBy("run").agg(F.min(F.struct("mark", "start")).alias("place"))
    again = same.join(place, "run").filter(F.struct("mark", "start") > F.col("place"))
    later = found.filter("id > first").select("id", "mark", "start").unionAll(again.select("id", "mark", "start"))
    return later.groupBy("id", "mark").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and the columns
    n_sentences and n_removed last (or as `free_names` calls them). Null texts
    stay null."""
    names = docs.columns
    kinds = [f.dataType.simpleString() for f in docs.schema]
    at = names.index(text_col)
    plain = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(names)])
    keyed = plain.select("*", F.coalesce(F.col(f"k{names.index(id_col)}").cast("long"), F.lit(NULL_ID)).alias("id"),
                         F.xxhash64(whole_text(F.col(f"k{at}"))).alias("mark"))
    joined = keyed.join(repeated(docs, id_col, text_col), ["id", "mark"], "left").select(
        *[F.col(f"k{i}") for i in range(len(names))], "starts")

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, 256):
                texts, n, gone = [], [], []
                for text, starts in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    kept, a, b = remove(text or "", starts or [])
                    texts.append(None if text is None else kept)
                    n.append(a)
                    gone.append(b)
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                                                 [*[f"k{i}" for i in range(len(names))], "n_sentences", "n_removed"])

    schema = [f"k{i} {'string' if i == at else k}" for i, k in enumerate(kinds)]
    out = map_arrow(joined, run, ", ".join([*schema, "n_sentences long, n_removed long"]))
    return out.toDF(*names, *free_names(docs, "n_sentences", "n_removed"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_sentences", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("long")
                              .alias("n_chars"), "text")
