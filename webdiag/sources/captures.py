"""Dumps of captures: files of JSON lines, one reply per line (O1.1, O1.5).

A line is ``{"capture_id": …, "payload": …}``; further keys of the capture are
named by ``by``. The payload is the reply's text, or the reply itself as a JSON
value, whose text is taken as it stands in the line. Spark's JSON reader splits
plain files by bytes (compressed ones go whole to a task) and, as a stream,
keeps in the query's checkpoint which files were read.

A line that is no JSON object, or whose keys do not fit their types, is kept:
``corrupt`` holds its text, ``payload`` is null. ``file``, ``block_start`` and
``block_bytes`` say where a row was read, so a broken dump can be found again.
A line without a payload has a null one; empty lines are no rows; an empty
folder gives no row, a missing one fails. Further keys of a line are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_line"
_LONGEST = str((1 << 31) - 1)  # a reply has no length limit
PLACE = ("file", "block_start", "block_bytes")


def _keys(by) -> list[str]:
    """Key columns as the reader's schema; ``by`` names them, or types them (``"day date"``)."""
    return [k if " " in k else f"{k} string" for k in by]


def _options(reader, by):
    schema = ", ".join([*_keys(by), "payload string", f"{CORRUPT} string"])
    return (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("maxStringLen", _LONGEST))


def _rows(lines: DataFrame, by) -> DataFrame:
    names = [k.split(" ")[0] for k in by]
    broken = F.col(CORRUPT).isNotNull()
    return lines.select(*names, F.when(~broken, F.col("payload")).alias("payload"), F.col(CORRUPT).alias("corrupt"),
                        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
                        F.col("_metadata.file_block_length").alias("block_bytes"))


def read_captures(spark: SparkSession, path: str, by=("capture_id",)) -> DataFrame:
    """by…, payload, corrupt, file, block_start, block_bytes of the dumps at ``path``."""
    return _rows(_options(spark.read, by).json(path), by)


def stream_captures(spark: SparkSession, path: str, by=("capture_id",), max_files: int | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """The same rows as a stream of the files that arrive at ``path``; a
    micro-batch takes at most ``max_files`` of them, or files of about ``max_bytes`` together."""
    reader = _options(spark.readStream, by)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _rows(reader.json(path), by)


def sound(captures: DataFrame) -> DataFrame:
    """Rows whose line could be read, as the payload parsers take them."""
    return captures.where(F.col("corrupt").isNull()).drop("corrupt", *PLACE)


def corrupt(captures: DataFrame, source: str) -> DataFrame:
    """The other rows, as rows of ``payloads.quarantine`` with their place:
    by…, source, warning, raw (the whole line), file, block_start, block_bytes."""
    keys = [c for c in captures.columns if c not in ("payload", "corrupt", *PLACE)]
    return captures.where(F.col("corrupt").isNotNull()).select(
        *keys, F.lit(source).alias("source"), F.lit("unreadable line of a dump").alias("warning"),
        F.col("corrupt").alias("raw"), *PLACE)


def write_captures(captures: DataFrame, path: str, compression: str | None = None) -> None:
    """``captures(by…, payload)`` as a new dump."""
    captures.write.option("compression", compression or "none").json(path)
