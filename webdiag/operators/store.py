"""Mergeable console rollup: partial groups per load, merged on read.

A load (a day, or a micro-batch of a stream) is reduced to its groups: count,
first arrival and its entry, last time. Groups of several loads merge by a
monoid (sum, minimum, entry of the minimum, maximum), so the report over all
loads needs none of the entries again; adding a load reads that load only and
writes only its groups.

Layout of a store's folder::

    meta/                by, severity, limit
    loads/<id>/          groups of one load, ids are integers
    bases/<k>/           the k-th compaction: groups/, covered/ (ids of the loads in it) and the file _DONE
    ended/<k>/           groups of captures that compaction k set aside as ended
    texts/loads/<id>/    first entries of a load's groups, with their texts
    texts/bases/<k>/     those still needed after compaction k, when it rewrote them

Loads and bases hold no texts: a group is named by a hash of its fingerprint and
its entry by the entry's arrival. So merging moves a few numbers a group, and
texts, the bulk of the bytes, are moved and written once, when they come.
Reports rank the numbers and fetch the texts of the issues that they show by a
join, which may move the texts once more. A
compaction rewrites the texts once half of them belong to entries that an
earlier arrival has replaced; until then there is a folder of texts per load.

Writing a load again replaces it, and a load that a base covers is left alone,
so a replayed batch changes nothing. A compaction counts once its _DONE file is
there; until then readers see the earlier base and the loads. Loads are
compacted when their bytes reach a share of the base's, so what is written in
all grows with the changed groups, not with the number of batches times the
groups.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webdiag.functions import console as C
from webdiag.operators import rollup
from webdiag.operators.common import as_keys, top_k

_ALL = "_all"  # the key of one global group
GROUP = ("count", "first_seq", "level", "message", "source", "severity_rank", "last_time")
# what merging needs: the group's name, its entry's arrival, and numbers
NUMBERS = ("_group", "_order", "count", "first_seq", "severity_rank", "last_time")
TEXTS = ("_group", "_order", "level", "message", "source")
COMPACT_SHARE = 0.5
# Texts are rewritten when there are this many times as many as groups.
REWRITE_TEXTS = 2
_NO_SEQ = -(1 << 63)  # an entry without seq comes first


def partial_groups(entries: DataFrame, severity: str = "error", by=("capture_id",), noise_patterns=C.NOISE_PATTERNS,
                   time_col: str | None = None) -> DataFrame:
    """by…, fingerprint, count, first_seq, level, message, source,
    severity_rank, last_time of one load, by the rules of ``error_rollup``.
    Partial aggregation runs before the shuffle."""
    keys = as_keys(by)
    return rollup.with_fingerprint(_load_groups(entries, severity, keys, noise_patterns, time_col)).select(
        *keys, "fingerprint", *GROUP)


def _load_groups(entries: DataFrame, severity: str, keys, noise_patterns, time_col: str | None) -> DataFrame:
    """keys…, ``NUMBERS`` and ``TEXTS`` of one load. Each text crosses the
    shuffle once: the fingerprint is made again from the group's entry."""
    raw = rollup.filter_severity_raw(entries, severity)
    time = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    # the time rides along as one more key, next to what normalisation keeps
    e = rollup.normalize(raw.withColumn("_time", time), [*keys, "_time"])
    e = rollup.with_rank(rollup.with_fingerprint(rollup.drop_noise(e, noise_patterns)))
    if "source" not in e.columns:
        e = e.withColumn("source", F.lit(None).cast("string"))
    e = e.select(*keys, _group_name(F.col("fingerprint")).alias("_group"), "_time",
                 F.struct(F.col("seq").cast("long").alias("seq"), "message", "source", "level", "severity_rank").alias("entry"))
    g = e.groupBy(*keys, "_group").agg(F.count(F.lit(1)).alias("count"), F.min("entry.seq").alias("first_seq"),
                                       F.min("entry").alias("entry"), F.max("_time").alias("last_time"))
    return g.select(*keys, "_group", F.coalesce("entry.seq", F.lit(_NO_SEQ)).alias("_order"), "count", "first_seq",
                    "entry.level", "entry.message", "entry.source", "entry.severity_rank", "last_time")


def _group_name(fingerprint: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(fingerprint, 256), 1, 32))


def _merged_numbers(groups: DataFrame, keys) -> DataFrame:
    # integer buffers keep this a hash aggregate
    return groups.groupBy(*keys, "_group").agg(
        F.min("_order").alias("_order"), F.sum("count").alias("count"), F.min("first_seq").alias("first_seq"),
        F.min_by("severity_rank", "_order").alias("severity_rank"), F.max("last_time").alias("last_time")).select(*keys, *NUMBERS)


def _merged(groups: DataFrame, keys) -> DataFrame:
    entry = F.struct("level", "message", "source", "severity_rank")
    g = groups.groupBy(*keys, "fingerprint").agg(
        F.sum("count").alias("count"), F.min("first_seq").alias("first_seq"),
        F.min_by(entry, F.struct("first_seq", "message", "source")).alias("entry"), F.max("last_time").alias("last_time"))
    return g.select(*keys, "fingerprint", "count", "first_seq", "entry.*", "last_time").select(*keys, "fingerprint", *GROUP)


def merge_groups(*groups: DataFrame, by=("capture_id",)) -> DataFrame:
    """The groups of all loads together: associative, in any order."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return _merged(out, as_keys(by))


def rank_groups(groups: DataFrame, by=("capture_id",), limit: int | None = 20) -> DataFrame:
    """The report of ``error_rollup`` from merged groups."""
    keys = as_keys(by)
    order = [F.col("severity_rank").desc(), F.col("count").desc(), F.col("first_seq")]
    return top_k(groups, keys, order, limit).select(
        *keys, F.col("issue_no").cast("bigint").alias("issue_no"), "level", "message", "count", "source", "first_seq", "fingerprint")


class RollupStore:
    """Partial groups in a folder that driver and executors share. One writer
    at a time; readers at any time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        meta = spark.read.schema("by string, severity string, max_issues int").json(f"{self.folder}/meta").first()
        self.by = [k for k in meta["by"].split(",") if k]
        self.severity, self.limit = meta["severity"], meta["max_issues"]
        self.keys = self.by or [_ALL]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, by=("capture_id",), severity: str = "error", limit: int = 20) -> RollupStore:
        """A new store, or the one in the folder."""
        if not _children(spark, f"{folder.rstrip('/')}/meta"):
            spark.createDataFrame([(",".join(as_keys(by)), severity, limit)], "by string, severity string, max_issues int") \
                .coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/meta")
        return cls(spark, folder)

    def add(self, load_id: int, entries: DataFrame, time_col: str | None = None, noise_patterns=C.NOISE_PATTERNS) -> bool:
        """Stores the groups of a load; False when it is in the base already."""
        if self._covered([load_id]):
            return False
        if not self.by:
            entries = entries.withColumn(_ALL, F.lit(0))
        texts = f"{self.folder}/texts/loads/{int(load_id)}"
        _load_groups(entries, self.severity, self.keys, noise_patterns, time_col).write.mode("overwrite").parquet(texts)
        self._read([texts]).select(*self.keys, *NUMBERS).write.mode("overwrite").parquet(f"{self.folder}/loads/{int(load_id)}")
        return True

    def groups(self, ended: bool = True) -> DataFrame | None:
        """All groups, merged; without those of ended captures when asked so."""
        numbers = self._numbers(ended)
        return None if numbers is None else self._with_texts(numbers).select(*self.keys, "fingerprint", *GROUP)

    def newest(self):
        """The last time stored of captures that are not ended; None without any."""
        numbers = self._numbers(ended=False)
        return None if numbers is None else numbers.agg(F.max("last_time")).first()[0]

    def report(self, limit: int | None = None, ended: bool = True) -> DataFrame:
        numbers = self._numbers(ended)
        if numbers is None:
            raise ValueError(f"no load in {self.folder}")
        order = [F.col("severity_rank").desc(), F.col("count").desc(), F.col("first_seq")]
        shown = top_k(numbers, self.keys, order, limit or self.limit)
        return self._with_texts(shown).select(
            *self.keys, F.col("issue_no").cast("bigint").alias("issue_no"), "level", "message", "count", "source", "first_seq",
            "fingerprint").drop(_ALL)

    def _numbers(self, ended: bool) -> DataFrame | None:
        base = self._base()
        parts = [f"{self.folder}/loads/{i}" for i in self._pending()]
        if base is not None:
            parts.append(f"{self.folder}/bases/{base}/groups")
            if ended:
                parts += self._ended(base)
        return _merged_numbers(self._read(parts), self.keys) if parts else None

    def _ended(self, base: int) -> list[str]:
        return [f"{self.folder}/ended/{k}" for k in _numbers(self.spark, f"{self.folder}/ended") if k <= base]

    def _text_folders(self) -> list[str]:
        """Folders of texts, written whole, of the loads that count."""
        ids = _numbers(self.spark, f"{self.folder}/texts/loads")
        known = self._covered(ids).union(self._pending())
        folders = [f"{self.folder}/texts/loads/{i}" for i in ids if i in known]
        folders += [f"{self.folder}/texts/bases/{k}" for k in _numbers(self.spark, f"{self.folder}/texts/bases")]
        return [f for f in folders if "_SUCCESS" in _children(self.spark, f)]

    def _with_texts(self, groups: DataFrame) -> DataFrame:
        """Merged groups with level, message, source and fingerprint of their
        entries; of entries with equal arrival those of the smallest texts."""
        names = [*self.keys, "_group", "_order"]
        texts = self._read(self._text_folders()).select(*[F.col(c).alias(f"_t{c}") for c in names], *TEXTS[2:])
        same = [groups[c].eqNullSafe(texts[f"_t{c}"]) for c in names]  # a key may be null
        found = groups.join(texts, same, "inner").drop(*[f"_t{c}" for c in names])
        found = top_k(found, names, [F.col("message"), F.col("source"), F.col("level")], 1, "_tie").drop("_tie")
        return rollup.with_fingerprint(found)

    def compact(self, ended_before: datetime | None = None) -> int:
        """Merges base and loads into a new base; its number. Captures without
        an entry at or after ``ended_before`` are set aside: the base, and what
        a later compaction rewrites, holds live captures only. Should an ended
        capture go on, reports still merge both parts."""
        base, pending = self._base(), self._pending()
        new = (base or 0) + 1
        folder = f"{self.folder}/bases/{new}"
        merged = self._numbers(ended=False)
        if merged is None:
            raise ValueError(f"no load in {self.folder}")
        if ended_before is None:
            merged.write.mode("overwrite").parquet(f"{folder}/groups")
        else:
            merged.write.mode("overwrite").parquet(f"{folder}/all")
            merged = self.spark.read.parquet(f"{folder}/all")
            live = merged.groupBy(*self.keys).agg(F.max("last_time").alias("_last")).where(
                F.col("_last").isNull() | (F.col("_last") >= F.lit(ended_before))).select(*self.keys)
            merged.join(live, self.keys, "left_semi").write.mode("overwrite").parquet(f"{folder}/groups")
            merged.join(live, self.keys, "left_anti").write.mode("overwrite").parquet(f"{self.folder}/ended/{new}")
            _delete(self.spark, f"{folder}/all")
        covered = self.spark.createDataFrame([(i,) for i in pending], "id long")
        if base is not None:
            covered = covered.unionByName(self.spark.read.parquet(f"{self.folder}/bases/{base}/covered"))
        covered.coalesce(1).write.mode("overwrite").parquet(f"{folder}/covered")
        _touch(self.spark, f"{folder}/_DONE")
        for i in pending:  # what the new base holds
            _delete(self.spark, f"{self.folder}/loads/{i}")
        if base is not None:
            _delete(self.spark, f"{self.folder}/bases/{base}")
        self._rewrite_texts(new)
        return new

    def _rewrite_texts(self, base: int) -> None:
        """Keeps the texts of the groups' entries only, once those of replaced
        ones are as many. A reader, or a rewrite that died, may meet the old and the
        new folders together: an entry found twice is one entry."""
        folders = self._text_folders()
        stored = [f"{self.folder}/bases/{base}/groups", *self._ended(base)]
        if not folders or self._read(folders).count() < REWRITE_TEXTS * max(1, self._read(stored).count()):
            return
        self._with_texts(self._numbers(ended=True)).select(*self.keys, *TEXTS).write.mode("overwrite").parquet(f"{self.folder}/texts/bases/{base}")
        for f in folders:
            if f != f"{self.folder}/texts/bases/{base}":
                _delete(self.spark, f)

    def compact_if_large(self, share: float = COMPACT_SHARE, ended_before: datetime | None = None) -> bool:
        """Compacts when the loads have reached ``share`` of the base's bytes."""
        base = self._base()
        held = _bytes(self.spark, f"{self.folder}/bases/{base}/groups") if base is not None else 0
        if not self._pending() or _bytes(self.spark, f"{self.folder}/loads") < share * held:
            return False
        self.compact(ended_before)
        return True

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths)

    def _base(self) -> int | None:
        done = [k for k in _numbers(self.spark, f"{self.folder}/bases")
                if "_DONE" in _children(self.spark, f"{self.folder}/bases/{k}")]
        return max(done, default=None)

    def _covered(self, ids: list[int]) -> set[int]:
        base = self._base()
        if base is None or not ids:
            return set()
        known = self.spark.read.schema("id long").parquet(f"{self.folder}/bases/{base}/covered")
        return {r["id"] for r in known.where(F.col("id").isin([int(i) for i in ids])).distinct().collect()}

    def _pending(self) -> list[int]:
        """Loads that were written whole and are in no base."""
        ids = [i for i in _numbers(self.spark, f"{self.folder}/loads") if "_SUCCESS" in _children(self.spark, f"{self.folder}/loads/{i}")]
        return sorted(set(ids) - self._covered(ids))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(c) for c in _children(spark, path) if c.isdigit())


def _bytes(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _touch(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.create(p, True).close()


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
