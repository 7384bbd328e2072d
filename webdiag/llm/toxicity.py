"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the weights of its words; a document's is the noisy-or of its sentences,
1 - (1 - leak) * prod(1 - p_s). Only document labels are known: the weights
are fitted by gradient descent on the likelihood of those through the
noisy-or, which itself decides the sentences that explain a label, and the
fitted model then locates them.

A word is described by itself and its first and last three to six characters,
so that inflected and derived forms count; ends of words that are too short
are not repeated. Descriptions are kept when they are clearly more
frequent in toxic documents, counting each once per document and near copies
of a document once: texts of one label that agree in three quarters of the
minima of ``MINIMA`` hashes over their runs of ``SHINGLE`` words.

The model is fitted on at most ``max_docs`` labelled rows, half of them toxic
where there are as many, taken by smallest hash of the id: this bound is the
only sample; every document is scored on its whole text. The model has at most
``MAX_FEATURES`` weights, which go to the tasks.

Rows: null and empty texts score the leak; null labels are not used; of rows
with one doc_id in the labels the highest label counts; repeated documents are
scored each; without labelled rows of both kinds every score is 0. Extra
columns are neither read nor changed.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, free_names, map_arrow, table, whole_text

MAX_DOCS = 8192
MAX_FEATURES = 4096
MIN_DOCS = 5          # documents a description must occur in
MIN_Z = 5.0           # and how many standard errors it must stand out by
MIN_RATIO = 3.0       # and how many times more frequent it must be
STEPS = 300
L2 = 1e-4
LEAK = 0.02           # share of toxic labels that no sentence explains, at most
MEMO_WORDS = 300_000
SHINGLE = 5
MINIMA = 16
BAND = 4              # minima that candidates share

_rnd = np.random.default_rng(7)
FACTORS = _rnd.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rnd.integers(0, 1 << 63, MINIMA, np.uint64)

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


def describe(word: str) -> list[str]:
    """A word's descriptions: itself, beginnings and endings."""
    out = [f"={word}"]
    for n in range(3, 7):
        if len(word) > n:
            out.append(f"^{word[:n]}")
            out.append(f"{word[-n:]}$")
    return out


def sketch(words: list[str]) -> np.ndarray:
    """The minima of MINIMA hashes over runs of SHINGLE words; shorter texts
    are one run, and texts without words are alike."""
    codes = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.uint64) + np.uint64(1)
    n = max(1, len(codes) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(codes))):
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(32)
    return np.array([(runs * f + s).min() for f, s in zip(FACTORS, SHIFTS)], np.uint64)


class Copies:
    """Tells whether a text is no near copy of an earlier one of its label."""

    def __init__(self):
        self.known = {}

    def new(self, minima: np.ndarray, label: int) -> bool:
        places = [(label, k, minima[k:k + BAND].tobytes()) for k in range(0, MINIMA, BAND)]
        for place in places:
            for other in self.known.get(place, ()):
                if 4 * int((other == minima).sum()) >= 3 * MINIMA:
                    return False
        for place in places:
            self.known.setdefault(place, []).append(minima)
        return True


def _fit(texts: list[str], labels: list[int]) -> dict:
    """The model of labelled texts: leak, bias and weights."""
    empty = {"leak": 0.0, "bias": 0.0, "weights": {}}
    copies, bags, y = Copies(), [], []
    same: dict[str, str] = {}  # every word is held once
    for text, label in zip(texts, labels):
        sentences = [tuple([same.setdefault(w, w) for w in WORD.findall(s)]) for s in SENTENCE.findall(text.lower())]
        if copies.new(sketch([w for s in sentences for w in s]), label):
            bags.append(sentences)
            y.append(label)
    y = np.array(y, float)
    if not len(y) or y.min() == y.max():
        return empty
    ids: dict[str, int] = {}
    described: dict[str, list[int]] = {}
    counts = np.zeros((2, 1 << 16), np.int64)
    for bag, label in zip(bags, y):
        got = set()
        for word in {w for s in bag for w in s}:
            d = described.get(word)
            if d is None:
                d = described[word] = [ids.setdefault(x, len(ids)) for x in describe(word)]
            got.update(d)
        while counts.shape[1] < len(ids):
            counts = np.concatenate([counts, np.zeros_like(counts)], axis=1)
        counts[int(label), np.fromiter(got, np.int64, len(got))] += 1
    k = len(ids)
    if not k:
        return {**empty, "leak": min(LEAK, float(y.mean()))}
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    c0, c1 = counts[:, :k]
    p = (c0 + c1) / (n0 + n1)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    kept = np.flatnonzero((c0 + c1 >= MIN_DOCS) & (z >= MIN_Z) & ((c1 + .5) / n1 >= MIN_RATIO * (c0 + .5) / n0))
    kept = kept[np.argsort(-z[kept], kind="stable")][:MAX_FEATURES]
    column = {int(f): c for c, f in enumerate(kept)}
    by_word = {w: c for w, d in described.items() if (c := [column[x] for x in d if x in column])}
    # rows: sentences with a kept description; the others never explain a label
    row_of, feature_of, doc_of = [], [], []
    for doc, bag in enumerate(bags):
        for sentence in bag:
            found = {c for w in sentence for c in by_word.get(w, ())}
            if found:
                row_of += [len(doc_of)] * len(found)
                feature_of += found
                doc_of.append(doc)
    row_of, feature_of, doc_of = (np.array(x, np.int64) for x in (row_of, feature_of, doc_of))
    m, n, f = len(doc_of), len(y), len(kept)
    w, b, mean, square = np.full(f, 1.0), -2.0, np.zeros(f + 1), np.zeros(f + 1)
    leak = min(LEAK, max(1e-3, float(y.mean()) / 10))
    for step in range(1, STEPS + 1):  # Adam
        score = b + np.bincount(row_of, w[feature_of], minlength=m)
        ps = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        none = np.log1p(-leak) - np.bincount(doc_of, np.logaddexp(0, score), minlength=n)  # log P(not toxic)
        prob = np.maximum(-np.expm1(none), 1e-9)
        weight = np.where(y > 0, .5 * n / n1, .5 * n / n0)  # both labels count alike
        slope = weight * np.where(y > 0, -np.exp(none) / prob, 1.0)
        by_row = slope[doc_of] * ps
        grad = np.append(np.bincount(feature_of, by_row[row_of], minlength=f) / n + L2 * w, by_row.sum() / n)
        mean, square = .9 * mean + .1 * grad, .99 * square + .01 * grad ** 2
        move = .1 * (mean / (1 - .9 ** step)) / (np.sqrt(square / (1 - .99 ** step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], -2.0)
    names = list(ids)
    return {"leak": leak, "bias": float(b), "weights": {names[f]: float(x) for f, x in zip(kept, w)}}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, folds: int = 5, held_out: int = 0) -> dict:
    """Fits the model on labelled documents whose crc32 of the id as text is
    not ``held_out`` modulo ``folds``. One task fits, on at most ``max_docs``
    rows; the driver receives at most MAX_FEATURES weights."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)")
             .filter(F.crc32(F.col("id").cast("string")) % folds != held_out)
             .groupBy("id").agg(F.max("label").alias("label"))
             .withColumn("order", F.xxhash64("id")))
    half = max_docs // 2
    some = [known.filter(F.col("label") == k).orderBy("order", "id").limit(half) for k in (0, 1)]
    sample = (docs.select(F.col("doc_id").alias("id"), whole_text(F.col("text")).alias("text"))
              .join(F.broadcast(some[0].unionAll(some[1])), "id")  # at most max_docs ids
              .groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
              .select("id", "text", "label").coalesce(1).sortWithinPartitions("id"))

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            marks += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(_fit(texts, marks))])], ["model"])

    rows = map_arrow(sample, run, "model string").collect()
    return json.loads(rows[0][0]) if rows else {"leak": 0.0, "bias": 0.0, "weights": {}}


class Scorer:
    """Scores texts; remembers the weight of each word it has met."""

    def __init__(self, model: dict):
        self.model, self.known, self.heavy = model, {}, {}

    def _learn(self, words: set[str]) -> None:
        weights = self.model["weights"]
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        for w in words.difference(self.known):
            found = [weights[d] for d in describe(w) if d in weights]
            self.known[w] = None
            if found:
                self.heavy[w] = [d for d in describe(w) if d in weights]

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that hold a weighted word."""
        out = []
        low = text.lower()
        if len(low) != len(text):  # a few capitals lower to more than one character
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        weights = self.model["weights"]
        for m in SENTENCE.finditer(low):
            found = {d for w in WORD.findall(m[0]) for d in self.heavy.get(w, ())}
            if found:
                z = self.model["bias"] + sum(map(weights.__getitem__, found))
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-np.clip(z, -30, 30))))))
        return out

    def score(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        self._learn(words)
        clean = 1 - self.model["leak"]
        if not words.isdisjoint(self.heavy):
            for _, _, p in self.sentences(text):
                clean *= 1 - p
        return 1 - clean


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text as a further, last column; where the
    table has a column of that name, underscores follow the new one's."""
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(names)],
                      whole_text(docs[text_col]).alias("scored"))

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in batches_of(batch, 256):
                scores = [scorer.score(t) for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())],
                                                 [*[f"k{i}" for i in range(len(names))], "score"])

    out = map_arrow(src, run, ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), "score double"]))
    return out.toDF(*names, *free_names(docs, score_col))


def locate(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score, sentence) of the offending sentences."""
    src = docs.select(F.col("doc_id"), whole_text(F.col("text")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scorer.score(text)
                rows += [(key, a, b, p, text[a:b]) for a, b, p in scorer.sentences(text) if p >= threshold]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.string()])],
                ["doc_id", "start", "end", "score", "sentence"])

    return map_arrow(src, run, f"doc_id {kind}, start long, end long, score double, sentence string")


def op7_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
