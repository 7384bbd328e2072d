"""Spelling variant grouping by a dictionary of trie-node pairs.

The nodes of the trie of all words and of the trie of all reversed words are
numbered. A word of m code points passes nodes p(0) to p(m) of the first and
s(0) to s(m) of the second one, where s(k) stands for its last k code points.
Two words differ in exactly one code point at place i if both hold the pair
(p(i), s(m - i - 1)), which skips that place; a word is another one with one
inserted code point if its skipping pair is the other's pair (p(i), s(m - i))
at an inserted place. All pairs are equal integers, so one grouping on them
finds every neighbour and nothing else; no text is compared.

A group holds the words that differ at one place, and the one word without it:
no more members than the alphabet has letters and one. Of equal letters in a
row only the first counts as the inserted one, so that each pair of words meets
in one group only. A group tells each member how many others it has and which
of them occurs most; pairs are never written out.

Numbering: the words are dealt to ranges of the alphabetical order, cut at
bounded many borders. A node that two ranges share is a prefix of a border and
has the border's number; the others belong to one range, which numbers them in
order. Forms are followed to their roots by doubling.

Rows: null and empty texts have no words; a null id counts as the empty text
before the colon; repeated rows count each; empty tables and texts without
frequent words give no row; long texts are read in slices, and a word may have
any length. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, whole_text

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2               # a form occurs so many times more often, at least
SPOIL = 97              # of the query: one in so many runs loses a letter
HELD = 500_000          # words that a task counts before it sends them
SLICE = 1 << 22         # code points of a long text read at a time
SAMPLE = 32             # words per range that borders are taken from
BORDER = 256            # code points of a border

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUN = re.compile("[a-zÀ-ÿ]+")
NO_RUN = re.compile("[^a-zÀ-ÿ]")


def runs(text: bytes) -> Counter:
    """The maximal runs of letters of a text, A-Z lower-cased, with their numbers."""
    low = text.translate(LOWER).decode("utf-8", "replace")
    out, at = Counter(), 0
    while at < len(low):
        end = NO_RUN.search(low, at + SLICE)
        to = end.start() if end else len(low)
        out.update(RUN.findall(low, at, to))
        at = to
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, spoil: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_length`` code
    points and ``min_count`` occurrences. With ``spoil``, a run loses the code
    point h % length where ``spoil`` divides h, the crc32 of id:run."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                      whole_text(F.col(text_col)).cast("binary").alias("text"))

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          ["word", "n"])

    def count(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begin = zlib.crc32(f"{key}:".encode())
                for run, n in runs(text.as_buffer().to_pybytes()).items():
                    if spoil:
                        h = zlib.crc32(run.encode(), begin)
                        if h % spoil == 0:
                            h %= len(run)
                            run = run[:h] + run[h + 1:]
                    if len(run) >= min_length:
                        counts[run] = counts.get(run, 0) + n
                if len(counts) > HELD:
                    yield batch_of(counts)
                    counts = {}
        yield batch_of(counts)

    return (map_arrow(src, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


class Nodes:
    """Numbers the nodes that words pass, in alphabetical order within a range."""

    def __init__(self, borders: list[str]):
        self.shared: dict[tuple[int, str], int] = {}  # the trie of the borders; the root is 0
        for border in borders:
            node = 0
            for c in border:
                node = self.shared.setdefault((node, c), len(self.shared) + 1)
        self.begin(0)

    def begin(self, number: int) -> None:
        self.next, self.last, self.path = (number + 1) << 40, "", [0]

    def of(self, word: str) -> list[int]:
        same = len(commonprefix([word, self.last]))
        path, shared = self.path[:same + 1], self.shared
        for c in word[same:]:
            node = shared.get((path[-1], c))
            if node is None:
                node = self.next
                self.next += 1
            path.append(node)
        self.last, self.path = word, path
        return path


def _borders(words: DataFrame, key: Column, ranges: int) -> list[str]:
    """Borders of ``ranges`` ranges of about equally many words, from the
    SAMPLE * ranges words of smallest hash."""
    some = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE * ranges).select(F.substring(key, 1, BORDER).alias("k"))
    found = sorted({r["k"] for r in some.collect()})
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def _paths(words: DataFrame, key: Column, keep: str, kind: str) -> DataFrame:
    """(no, ``keep``, nodes): the nodes that ``key`` of every word passes. no is
    the word's place in the order of ``key``, with gaps."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(words, key, 4 * parts)
    src = words.select(key.alias("key"), *keep.split())

    def deal(batches):
        for batch in batches:
            at = [bisect_right(borders, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    def number(batches):
        nodes, now, place = Nodes(borders), None, 0
        for batch in batches:
            no, paths = [], []
            for at, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != now:
                    now, place = at, at << 40
                    nodes.begin(at)
                no.append(place)
                place += 1
                paths.append(nodes.of(key))
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), *batch.columns[2:], pa.array(paths, pa.list_(pa.int64()))],
                                             ["no", *batch.schema.names[2:], "nodes"])

    dealt = map_arrow(src, deal, f"range int, key string, {kind}").repartition(parts, "range").sortWithinPartitions("range", "key")
    return map_arrow(dealt, number, f"no long, {kind}, nodes array<long>")


def _neighbours(words: DataFrame) -> DataFrame:
    """(no, n_near, best): per word with neighbours their number and, as
    (-n, no), the one that occurs most, the first of equals."""
    back = _paths(words, F.reverse("word"), "no", "own long").select(F.col("own").alias("no"), F.col("nodes").alias("back"))
    m = F.length("word")
    skip = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(
        F.get("nodes", i).alias("p"), F.get("back", m - i - 1).alias("s"),
        # 1: skips a place; 2: whose letter isn't that of the place before
        F.when((i > 0) & (F.col("word").substr(i, F.lit(1)) == F.col("word").substr(i + 1, F.lit(1))), 1).otherwise(2).alias("kind")))
    whole = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(
        F.get("nodes", i).alias("p"), F.get("back", m - i).alias("s"), F.lit(0).alias("kind")))
    held = words.join(back, "no").select("no", "n", F.explode(F.concat(skip, whole)).alias("x"))
    groups = held.groupBy("x.p", "x.s").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "no", F.col("x.kind").alias("kind")))
                                            .alias("g")).filter("size(g) > 1")

    def one(x):
        return F.struct(x["less"].alias("less"), x["no"].alias("no"))

    none = F.lit(None).cast("struct<less:bigint,no:bigint>")
    groups = groups.select("g", F.filter("g", lambda x: x["kind"] > 0).alias("skips"),
                           F.transform(F.filter("g", lambda x: x["kind"] == 2), one).alias("longer"),
                           F.get(F.transform(F.filter("g", lambda x: x["kind"] == 0), one), F.lit(0)).alias("shorter"))
    groups = groups.select("g", "longer", "shorter", F.slice(F.array_sort(F.transform("skips", one)), 1, 2).alias("two"),
                           F.size("skips").alias("alike"))

    def told(x):
        other = F.when(F.get("two", F.lit(0))["no"] == x["no"], F.get("two", F.lit(1))).otherwise(F.get("two", F.lit(0)))
        shorter = F.when(x["kind"] == 2, F.col("shorter")).otherwise(none)
        return F.when(x["kind"] == 0, F.struct(x["no"].alias("no"), F.size("longer").alias("near"), F.array_min("longer").alias("best"))) \
            .otherwise(F.struct(x["no"].alias("no"), (F.col("alike") - 1 + F.when(shorter.isNull(), 0).otherwise(1)).alias("near"),
                                F.array_min(F.array_compact(F.array(other, shorter))).alias("best")))

    return (groups.select(F.explode(F.transform("g", told)).alias("t")).select("t.*").filter("near > 0")
            .groupBy("no").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(no, root): the end of the chain of forms (no, to). Every round doubles
    the steps; a form occurs more often than its word, so chains end."""
    state = cut(forms.select("no", "to"))
    while True:
        jump = state.select(F.col("no").alias("at"), F.col("to").alias("further"))
        state = cut(state.select("no", "to").join(jump, F.col("to") == F.col("at"), "left")
                    .select("no", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("no", F.col("to").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of ``words(word, n)``,
    whose words are distinct."""
    words = cut(words.select("word", "n"))  # read for the borders, too
    words = cut(_paths(words, F.col("word"), "word n", "word string, n long"))
    near = _neighbours(words)
    all_ = cut(words.select("no", "word", "n").join(near, "no", "left").select(
        "no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.no")).alias("to"), (-F.col("best.less")).alias("form_n")))
    formed = all_.filter("to IS NOT NULL")
    names = all_.select(F.col("no").alias("of"), F.col("word").alias("name"))
    found = (formed.join(_roots(formed), "no")
             .join(names.withColumnRenamed("name", "form"), F.col("to") == F.col("of")).drop("of")
             .join(names.withColumnRenamed("name", "root_word"), F.col("root") == F.col("of"))
             .select("word", "n", "form", F.col("root_word").alias("root"), "n_near", "form_n"))
    alone = all_.filter("to IS NULL").select("word", "n", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                                             "n_near", F.lit(None).cast("long").alias("form_n"))
    return found.unionByName(alone)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), spoil=SPOIL)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
