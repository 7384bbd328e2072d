"""Document fingerprints by consistent weighted sampling, in Spark SQL alone.

A text's terms are its lower-cased words, their weights the number of times
each occurs. For each of ``SAMPLES`` samples k, every term draws r and c from a
Gamma(2, 1) distribution and b from a uniform one, all from hashes of the term
and k, so that the same term draws the same in every text. With weight w it
takes the level t = floor(ln w / r + b), the point y = exp(r (t - b)) and the
value a = c / (y exp(r)); the sample is the (term, t) of the smallest a. Two
texts agree in a sample with probability sum min(w, w') / sum max(w, w'), the
generalised Jaccard similarity, and the likeness of two fingerprints is the
share of samples in which they agree.

Terms are counted where the text already is (``repartition`` by document
first), so only whole texts move, never terms.

Rows: null texts are empty; a text without words has a fingerprint of its own
that is like itself only. A null doc_id comes last in descending order; rows
equal in id and text give a row each; where several rows have the next id, the
one whose text has the smallest hash is the next document; a lone document is
its own next one. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, whole_text

SAMPLES = 32
HEX = 8                      # hexadecimal digits of a sample
SHA_DIGITS = 13              # hexadecimal digits of a digest that a number carries
NO_WORDS = "-" * HEX         # the samples of a text without words
# ln a lies well within +-LOG_RANGE; it is kept in 31 bits above the sample's 32.
LOG_RANGE = 512.0


def _sample(term: str, log_weight: str, k: int) -> Column:
    """ln a of one draw in the upper bits, 32 bits of (term, t) in the lower ones."""
    unit = 1.0 / (1 << 21)
    h = f"xxhash64({term}, {k}L)"
    g = f"xxhash64({k}L, {term})"
    u1, u2, b = (f"((shiftrightunsigned({h}, {s}) & 2097151L) + 0.5D) * {unit}D" for s in (0, 21, 42))
    u3, u4 = (f"((shiftrightunsigned({g}, {s}) & 2097151L) + 0.5D) * {unit}D" for s in (0, 21))
    r, c, b = f"(-ln({u1} * {u2}))", f"(-ln({u3} * {u4}))", f"({b})"
    t = f"floor({log_weight} / {r} + {b})"
    log_a = f"(ln({c}) - {r} * ({t} - {b}) - {r})"
    high = f"cast(({log_a} + {LOG_RANGE}D) * {(1 << 31) / (2 * LOG_RANGE)}D as bigint)"
    return F.expr(f"shiftleft({high}, 32) | (xxhash64({term}, {t}, {k}L) & 4294967295L)")


def signatures(df: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES,
               facts: dict[str, Column] | None = None) -> DataFrame:
    """(keys, fingerprint, facts): the fingerprint of each text. Rows with
    equal keys must be one row; if ``df`` is partitioned by keys nothing is
    shuffled. ``facts`` are long columns to bring along: they travel as terms
    that no word can be (they begin with a space), so that the grouped rows
    stay narrow."""
    facts = facts or {}
    words = F.split(F.lower(F.col(text)), r"\s+")
    if facts:
        words = F.concat(words, F.array(*[F.concat(F.lit(f" {k}"), v.cast("string")) for k, v in enumerate(facts.values())]))
    word = F.col("word")
    fact = word.startswith(" ")
    terms = (df.select(*keys, F.explode(words).alias("word")).filter(word != "")
             .groupBy(*keys, F.when(fact, F.substring("word", 2, 1).cast("long")).otherwise(F.xxhash64("word")).alias("term"))
             .agg(F.sum(F.when(fact, F.substring(word, 3, 20).cast("long")).otherwise(1)).alias("n"))
             .select(*keys, "term", "n", F.log(F.col("n").cast("double")).alias("log_n")))
    real = ~F.col("term").between(0, len(facts) - 1) if facts else F.lit(True)
    least = [F.min(F.when(real, _sample("term", "log_n", k))).alias(f"s{k}") for k in range(samples)]
    carried = [F.max(F.when(F.col("term") == k, F.col("n"))).alias(name) for k, name in enumerate(facts)]
    got = terms.groupBy(*keys).agg(*least, *carried)
    hexed = [F.coalesce(F.lpad(F.lower(F.hex(F.col(f"s{k}").bitwiseAND(0xFFFFFFFF))), HEX, "0"), F.lit(NO_WORDS))
             for k in range(samples)]
    return got.select(*keys, F.concat(*hexed).alias("fingerprint"), *facts)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = [(F.substring(a, HEX * k + 1, HEX) == F.substring(b, HEX * k + 1, HEX)).cast("int") for k in range(samples)]
    return reduce(add, same) / float(samples)


def next_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, next): for every distinct id the one that follows in descending
    order, the first for the last. Ids are dealt into ranges, each range is
    ordered by itself, and the ranges' first ids (one per partition) are joined
    to the range before."""
    ranged = cut(rows.select(F.col(id_col).alias("id")).distinct()
                 .repartitionByRange(F.col("id").desc()).withColumn("range", F.spark_partition_id()))
    tops = ranged.groupBy("range").agg(F.max("id").alias("top"))
    order = W.partitionBy(F.lit(0)).orderBy("range")  # one row per partition
    tops = tops.select("range", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("below"))
    inner = F.lead("id").over(W.partitionBy("range").orderBy(F.col("id").desc()))
    return (ranged.withColumn("lead", inner).join(F.broadcast(tops), "range")
            .select("id", F.coalesce("lead", "below").alias("next")))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = -(1 << 63)  # stands for a null id: comes last
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("id"), whole_text(F.col("text")).alias("text"))
    # Texts are dealt by id once, over more partitions than usual as their
    # terms are grouped there; rows with equal id and text are one from here on.
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(parts, "id").groupBy("id", F.xxhash64("text").alias("mark")).agg(
        F.min("text").alias("text"), F.count("*").alias("copies"))
    sizes = docs.groupBy("id", F.char_length("text").alias("n")).agg(F.lit(1).alias("one"))
    wanted = cut(sizes.join(next_ids(docs, "id"), "id").select("id", "n", "next"))
    # the beginnings of next documents, brought to the documents before them
    piece = (dealt.join(wanted.select(F.col("id").alias("to"), F.col("n").alias("to_n"), "next"),
                        F.col("id") == F.col("next"))
             .select("to", "to_n", "mark", F.expr("substring(text, 1, cast(to_n div 3 as int))").alias("piece"))
             .groupBy("to", "to_n").agg(F.min_by("piece", "mark").alias("piece")))
    size = F.char_length("text")
    # lengths are compared in a way that keeps the join on the id, by which the texts are dealt
    both = (dealt.join(piece, (F.col("id") == F.col("to")) & (F.abs(size - F.col("to_n")) < 1))
            .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(char_length(text) - char_length(text) div 3 as int))"),
                                           F.col("piece")))
            .withColumn("sha", F.sha2("edited", 256)))
    # the two texts of a document under one key, told apart by its last bit
    even = F.col("mark").bitwiseAND(F.lit(-2))
    long = both.select("id", "sha", size.alias("n_chars"), "copies", F.explode(F.array(
        F.struct(even.alias("key"), F.col("text").alias("text")),
        F.struct((even + 1).alias("key"), F.col("edited").alias("text")))).alias("x")).select(
            "id", "x.key", "x.text", "sha", "n_chars", "copies")
    digits = [F.conv(F.substring("sha", at, SHA_DIGITS), 16, 10) for at in range(1, 65, SHA_DIGITS)]
    facts = {"n_chars": F.col("n_chars"), "copies": F.col("copies"), **{f"sha{i}": d for i, d in enumerate(digits)}}
    one = signatures(long, ["id", "key"], facts=facts)
    first = F.col("key").bitwiseAND(1) == 0
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"sha{i}"))), min(SHA_DIGITS, 64 - i * SHA_DIGITS), "0")
                     for i in range(len(digits))])
    marks = cut(one.groupBy("id", F.col("key").bitwiseAND(F.lit(-2)).alias("mark"), "n_chars", "copies",
                            sha.alias("edited_sha256")).agg(
        F.max(F.when(first, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(~first, F.col("fingerprint"))).alias("edited_fingerprint")))
    heads = marks.groupBy(F.col("id").alias("next")).agg(F.min_by("fingerprint", "mark").alias("next_fingerprint"))
    nexts = heads.join(wanted.select("id", "next").distinct(), "next").select("id", "next_fingerprint")
    return (marks.join(nexts, "id")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(F.nullif("id", F.lit(none)).alias("doc_id"), "n_chars", "edited_sha256",
                    "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")))
