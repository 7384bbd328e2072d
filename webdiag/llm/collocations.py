"""Phrase collocation mining by HAT-trie counting.

A task counts the phrases of its rows in a trie over word ids. A node of the
trie is a hash container of all phrases below it; when a container grows beyond
``BURST`` phrases it bursts: words that lead at least ``LEADS`` of its phrases
get child nodes of their own, the others stay together. The trie stays shallow,
and frequent beginnings are stored once. When a task holds more than ``HELD``
phrases it spills whole subtrees, the largest first, as sorted runs (language,
phrase, count). The shuffle's partitions are the prefix partitions: a run's
phrases are dealt by the hash of their whole path, so that no beginning is too
frequent for one of them, and each merges what all runs have of its phrases.
Whatever the corpus, a phrase meets with one row per run.

Phrases are counted by length, shortest first. A phrase that occurs
``min_count`` times has only parts that do, so a longer phrase is only counted
where both phrases without its first and without its last word may be frequent:
their hashes are in a bitmap of ``FILTER_BITS`` bits (fixed, whatever the
corpus). False positives are counted in vain and dropped after the merge;
nothing else depends on the bitmap.

Rows: a null text is the empty text, which has no words; a null language is
``und``; repeated rows count each; an empty table gives no row; a corpus without
frequent phrases neither. Long texts are read in slices. Other columns are not
read. Words are compared as UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, whole_text

MIN_COUNT = 10
MAX_WORDS = 3
COVERED = 50            # percent of a phrase's occurrences that lie in a longer one
TOP = 2000
BURST = 1 << 18         # phrases in a container
LEADS = 4096            # phrases that make a leading word a node
HELD = 1_500_000        # phrases that a task holds
VOCABULARY = 400_000    # words that a task holds
CHUNK = 1 << 21         # bytes of text counted at a time
SLICE = 1 << 21         # bytes of a long text read at a time
FILTER_BITS = 27
ROWS = 1 << 16          # of an Arrow batch

_U = np.uint64
BREAK = b"\xff"         # between pieces; no byte of UTF-8
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else c for c in range(256))


def slices(text: bytes):
    """A text in slices that end at blanks, A-Z lower-cased, with BREAK between its pieces."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            blank = text.find(b" ", at + SLICE)
            end = blank if blank >= 0 else end
        yield text[at:end].translate(FOLD).replace(b"\n", b" \xff ")
        at = end


def words_of(text: bytes) -> pa.Array:
    """The words of a slice, in order, as binary values."""
    words = pc.ascii_split_whitespace(pa.array([text], pa.large_binary()).view(pa.large_string())).flatten()
    words = words.view(pa.large_binary())
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _bit(hashes: np.ndarray) -> np.ndarray:
    """The bit of each phrase, from the hashes of its words, one row per word."""
    out = np.zeros(hashes.shape[1:], _U)
    for h in hashes:
        out = (out ^ (out >> _U(29))) * _U(0x9E3779B97F4A7C15) + h
    out = (out ^ (out >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return out >> _U(64 - FILTER_BITS)


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang))


class Container:
    """A hash table from keys, which are positive, to counts; open addressing."""

    def __init__(self, keys=(), counts=()):
        self.size = 0
        self.keys, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.add(np.array(keys, np.int64), np.array(counts, np.int64))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct keys."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.items()
            room = 1 << int(2 * (self.size + len(keys))).bit_length()
            self.size, self.keys, self.counts = 0, np.zeros(room, np.int64), np.zeros(room, np.int64)
            self.add(*held)
        mask = len(self.keys) - 1
        at = (keys.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(np.int64) & mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several keys one gets the place
            own = self.keys[at] == keys
            self.counts[at[own]] += counts[own]
            self.size += int((free & own).sum())
            rest = ~own
            keys, counts, at = keys[rest], counts[rest], (at[rest] + 1) & mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.keys)
        return self.keys[at], self.counts[at]


class Node:
    """A node of the trie: its container counts the phrases whose next word has
    no node of its own. Keys hold the ids of the ``left`` words below the node,
    ``bits`` bits each, the first one highest."""

    def __init__(self, left: int, bits: int, keys=(), counts=()):
        self.left, self.bits, self.children, self.limit = left, bits, {}, BURST
        self.table = Container(keys, counts)

    def _leads(self, keys: np.ndarray):
        """(lead, begin, end) of sorted keys of one next word."""
        lead = keys >> (self.bits * (self.left - 1))
        begin = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) if len(lead) else lead
        return zip(lead[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(keys)].tolist())

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct sorted keys."""
        if self.children:
            own = [(self.children[x], at, to) for x, at, to in self._leads(keys) if x in self.children]
            rest = np.ones(len(keys), bool)
            for child, at, to in own:
                rest[at:to] = False
                child.add(keys[at:to] & ((1 << (self.bits * (self.left - 1))) - 1), counts[at:to])
            keys, counts = keys[rest], counts[rest]
        self.table.add(keys, counts)
        if self.table.size > self.limit and self.left > 1:
            self.burst()

    def burst(self) -> None:
        keys, counts = self.table.items()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        rest = np.ones(len(keys), bool)
        for lead, at, to in self._leads(keys):
            if to - at >= LEADS:
                rest[at:to] = False
                self.children[lead] = Node(self.left - 1, self.bits,
                                           keys[at:to] & ((1 << (self.bits * (self.left - 1))) - 1), counts[at:to])
        self.table = Container(keys[rest], counts[rest])
        self.limit = max(BURST, 2 * self.table.size)

    def size(self) -> int:
        return self.table.size + sum(c.size() for c in self.children.values())

    def subtree(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all phrases below the node."""
        parts = [self.table.items()]
        for lead, child in self.children.items():
            keys, counts = child.subtree()
            parts.append((keys | (lead << (self.bits * (self.left - 1))), counts))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Counter:
    """Counts the phrases of ``n`` words of one language. ``known(word hashes)``
    tells which phrases of n - 1 words may be frequent."""

    def __init__(self, lang: bytes, n: int, known=None):
        self.lang, self.n, self.known = lang, n, known
        self.bits = 63 // n
        self.room = min(VOCABULARY, (1 << self.bits) - 2)
        self.waiting: list[bytes] = []
        self.seed = xxhash.xxh32_intdigest(lang)
        self.clear()

    def clear(self) -> None:
        self.root, self.held = Node(self.n, self.bits), 0
        self.ids, self.words, self.hashes = {BREAK: 0}, [b""], [0]

    def _learn(self, new: list[bytes]) -> None:
        if self.n == 1:
            hashes, keep = [0] * len(new), [True] * len(new)
        else:
            hashes = [xxhash.xxh3_64_intdigest(w, self.seed) for w in new]
            keep = self.known(np.array([hashes], _U)).tolist() if self.n == 2 and new else [True] * len(new)
        for w, h, k in zip(new, hashes, keep):
            self.ids[w] = len(self.words) if k else 0  # a rare word ends phrases as BREAK does
            if k:
                self.words.append(w)
                self.hashes.append(h)

    def count(self):
        """Counts the waiting texts; yields runs of a full trie's subtrees."""
        text, self.waiting = b" ".join(self.waiting), []
        if text:
            words = words_of(text)
            yield from self._count(words)
            if self.n > 1 and len(words):
                self.waiting = [b" ".join(words[max(0, len(words) - self.n + 1):].to_pylist())]

    def _count(self, words: pa.Array):
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(distinct) > self.room:  # halves, with the phrases across them in the second
            half = len(words) // 2
            yield from self._count(words[:half])
            yield from self._count(words[half - self.n + 1:])
            return
        new = [w for w in distinct if w not in self.ids]
        if len(self.ids) + len(new) > self.room + 1:  # all goes out, and ids begin anew
            yield from self.flush()
            new = [w for w in distinct if w not in self.ids]
        self._learn(new)
        if distinct:
            self._add(np.fromiter(map(self.ids.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()])
        if self.held > HELD:
            yield from self.spill()

    def _add(self, ids: np.ndarray) -> None:
        n, m = self.n, len(ids) - self.n + 1
        if m < 1:
            return
        ok = ids[:m] > 0
        for k in range(1, n):
            ok &= ids[k:m + k] > 0
        at = np.flatnonzero(ok)
        if n > 2 and len(at):
            h = np.array(self.hashes, _U)[ids]
            for s in (0, 1):
                at = at[self.known(np.stack([h[at + s + k] for k in range(n - 1)]))]
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key = key << self.bits | ids[at + k]
        self.root.add(*np.unique(key, return_counts=True))
        self.held = self.root.size()

    def spill(self):
        """Sorted runs of whole subtrees, the largest first, until half of HELD is held."""
        shift = self.bits * (self.n - 1)
        for size, lead in sorted(((c.size(), lead) for lead, c in self.root.children.items()), reverse=True):
            if self.held <= HELD // 2:
                return
            keys, counts = self.root.children.pop(lead).subtree()
            yield from self.run(keys | (lead << shift), counts)
            self.held -= size
        if self.held > HELD // 2:
            yield from self.run(*self.root.table.items())
            self.root.table = Container()
            self.held = self.root.size()

    def flush(self):
        if self.held:
            yield from self.run(*self.root.subtree())
        self.clear()

    def run(self, keys: np.ndarray, counts: np.ndarray):
        """A sorted run in Arrow batches."""
        mask = (1 << self.bits) - 1
        words = pa.array(self.words, pa.binary())
        order = pc.array_sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = words.take(pa.array(order)).cast(pa.string())
        ranks = [rank[(keys >> (self.bits * (self.n - 1 - k))) & mask] for k in range(self.n)]
        key = np.zeros(len(keys), np.int64)
        for r in ranks:
            key = key << self.bits | r
        order = np.argsort(key)
        for at in range(0, len(order), ROWS):
            part = order[at:at + ROWS]
            columns = [names.take(pa.array(r[part])) for r in ranks]
            phrase = columns[0] if self.n == 1 else pc.binary_join_element_wise(*columns, " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang.decode()] * len(part), pa.string()), phrase, pa.array(counts[part], pa.int64())],
                ["lang", "phrase", "f"])


def _counts(docs: DataFrame, n: int, bitmap) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``n`` words of ``docs(lang, text)``;
    ``bitmap`` holds those of n - 1 words."""

    def run(batches):
        known = None
        if bitmap is not None:
            bits = np.frombuffer(bitmap.value, np.uint8)

            def known(hashes):
                b = _bit(hashes)
                return (bits[(b >> _U(3)).astype(np.int64)] >> (b & _U(7)).astype(np.uint8)) & 1 == 1
        counters: dict[bytes, Counter] = {}
        waiting = 0

        def count():
            for c in counters.values():
                yield from c.count()
            words = sum(len(c.ids) for c in counters.values())
            phrases = sum(c.held for c in counters.values())
            for c in sorted(counters.values(), key=lambda c: -len(c.ids)):
                if words > VOCABULARY or phrases > HELD or len(counters) > 1000:
                    words, phrases = words - len(c.ids), phrases - c.held
                    yield from c.flush()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lang = lang.encode()
                if lang not in counters:
                    counters[lang] = Counter(lang, n, known)
                c = counters[lang]
                for part in slices(text.as_buffer().to_pybytes()):
                    c.waiting.append(part)
                    waiting += len(part)
                    if waiting >= CHUNK:
                        yield from count()
                        waiting = 0
                c.waiting.append(BREAK)
        yield from count()
        for c in counters.values():
            yield from c.flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = map_arrow(docs, run, "lang string, phrase string, f long")
    return runs.repartition(parts, "lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(frequent: DataFrame):
    """The bitmap of the phrases of ``frequent``, as a broadcast variable of
    2 ** FILTER_BITS bits. Tasks build blocks of it."""
    block = 15  # bits of a place in a block

    def places(batches):
        for batch in batches:
            lang, phrase = (batch.column(k).to_pylist() for k in (0, 1))
            rows = [(a.encode(), p.encode().split(b" ")) for a, p in zip(lang, phrase)]
            if rows:
                bits = _bit(np.array([[_word_hash(a, w) for w in p] for a, p in rows], _U).T).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits >> block), pa.array(bits & ((1 << block) - 1))], ["block", "place"])

    def build(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, p in zip(*[c.to_numpy().tolist() for c in batch.columns]):
                if b not in blocks:
                    blocks[b] = np.zeros(1 << (block - 3), np.uint8)
                blocks[b][p >> 3] |= 1 << (p & 7)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()),
                                              pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])

    spark = frequent.sparkSession
    dealt = map_arrow(frequent.select("lang", "phrase"), places, "block long, place long").repartition("block")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in map_arrow(dealt, build, "block long, bits binary").toLocalIterator():
        bits[row["block"] << (block - 3):(row["block"] + 1) << (block - 3)] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
                  min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every phrase of at most ``max_words`` words
    that occurs ``min_count`` times, words alone included, and (lang, n): the
    number of all words."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      whole_text(F.col(text_col)).cast("binary").alias("text"))
    words = cut(_counts(src, 1, None))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent, bitmap = None, None
    for n in range(1, max_words + 1):
        found = words if n == 1 else _counts(src, n, bitmap)
        found = cut(found.filter(F.col("f") >= min_count).select("lang", F.lit(n).alias("words"), "phrase", "f"))
        frequent = found if frequent is None else frequent.unionAll(found)
        if n < max_words:
            bitmap = _bitmap(found)
    return frequent, totals


def _words(phrase: Column, begin, length) -> Column:
    return F.array_join(F.slice(phrase, begin, length), " ")


def score_of(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) without rounding; a is at most l and at most r,
    and below 10^16."""
    a, l, r = (x.cast("decimal(16,0)") for x in (a, l, r))
    return F.floor(F.call_function("div", (a * a).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), l * r)).cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of 2 to ``max_words`` words
    with at least ``min_count`` occurrences, without those of which ``covered``
    percent or more lie in one longer candidate. The score is that of the
    lowest-scoring cut, in millionths."""
    counts, totals = phrase_counts(docs, lang_col, text_col, max_words, min_count)
    known = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    wide = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # every shorter phrase within a candidate; each candidate has few
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda at: _words(F.col("w"), at, k))))
    longer = (wide.filter("words > 2").select(F.col("lang").alias("of"), "a", F.explode(F.array_distinct(within)).alias("part"))
              .groupBy("of", "part").agg(F.max("a").alias("longest")))
    kept = (wide.join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
            .filter(F.col("longest").isNull() | (100 * F.col("longest") < covered * F.col("a")))
            .select("lang", "phrase", "words", "a", "w"))
    cuts = kept.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("w"), F.lit(1), F.col("k")).alias("first"),
                       _words(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = (cuts.join(known, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("part")))
                .withColumnRenamed("f", name).drop("of", "part", part))
    best = cuts.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b"))
    return best.select("lang", "phrase", "b.*").join(F.broadcast(totals), "lang").select(  # a row per language
        "lang", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents").select("lang", "text"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sizes AS (SELECT unnest([1, 2, 3]) AS k), spots AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, sizes WHERE len(w) >= k
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= {MIN_COUNT}
), inner_parts AS (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM cand WHERE k = 3
), longest AS (SELECT lang, part, max(a) AS m FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN longest x ON x.lang = c.lang AND x.part = c.phrase
  WHERE x.m IS NULL OR 100 * x.m < {COVERED} * c.a
), cuts AS (
  SELECT lang, phrase, a, 1 AS c, w[1] AS p, array_to_string(list_slice(w, 2, 3), ' ') AS q FROM kept
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.c, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN grams x ON x.lang = u.lang AND x.phrase = u.p JOIN grams y ON y.lang = u.lang AND y.phrase = u.q
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best b JOIN totals t ON t.lang = b.lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
