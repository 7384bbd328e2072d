"""Minimum-cost-flow resharding of a sharded archive.

An archive is a folder of generations. Rows lie in blocks, one Parquet folder
``generation=g/shard=s/block=b`` each, and have a place in their block; a small
manifest per version says which blocks count, their rows, bytes and first slot
in their shard. A row's size is the UTF-8 bytes of its text and one.

Resharding reads the old shard sizes from the manifest (one number per shard
goes to the driver) and solves a minimum-cost flow from the old shards to the
new capacities: every byte that stays costs nothing, every byte that moves
costs one, or what ``cost(old, new)`` says. Successive shortest paths give
integer flows. The flows cut every old shard's line of blocks into intervals;
what stays comes first. Blocks within one interval go whole; only blocks on a
border are split, row by row. A row that itself lies on a border goes to the
shard that still lacks the most bytes, the largest row first; there is at most
one such row per border. Blocks hold texts of like size, the smallest last, so
borders mostly fall on small texts.

Only moved and split blocks are rewritten, as a new generation; the files of
all other blocks stay untouched, and older versions stay readable. Blocks have
at most about ``block_bytes`` bytes (a larger text is a block by itself), so no
shard is ever held by one task.

Law of the registered query: ``bytes``, sizes near equal. The old layout there
is ``OLD_SHARDS`` shards by hash of the id, the new one 16 of equal capacity.
Equal texts are rows of their own and may lie in different shards.

Rows: a null text has no bytes and size 1; null and repeated ids and repeated
rows are rows like others; an empty table gives an archive without blocks.
Further columns of any names are kept with the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

OLD_SHARDS, NEW_SHARDS = 12, 16
BLOCK_BYTES = 64 << 20
BROADCAST_BLOCKS = 1_000_000


def equal_capacities(total: int, shards: int) -> list[int]:
    """Bytes per shard, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def cheapest_transfers(sizes: list[int], capacities: list[int], cost: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """{(old, new): bytes}: the cheapest way to fill the new shards from the
    old ones, by successive shortest paths. ``sizes`` and ``capacities`` have
    the same sum. Its work depends on the numbers of shards only."""
    if sum(sizes) != sum(capacities):
        raise ValueError("sizes and capacities differ in sum")
    cost = cost or (lambda i, j: int(i != j))
    olds, news = range(len(sizes)), range(len(capacities))
    price = [[cost(i, j) for j in news] for i in olds]
    left, room, flow = list(sizes), list(capacities), {}
    while any(left):
        to_old: dict[int, int] = {i: 0 for i in olds if left[i]}
        to_new: dict[int, int] = {}
        before_old, before_new = {}, {}
        changed = set(to_old)
        while changed:  # shortest paths; an arc back undoes a flow
            reached = set()
            for i in changed:
                for j in news:
                    d = to_old[i] + price[i][j]
                    if j not in to_new or d < to_new[j]:
                        to_new[j], before_new[j] = d, i
                        reached.add(j)
            changed = set()
            for (i, j), f in flow.items():
                if f and j in reached and (i not in to_old or to_new[j] - price[i][j] < to_old[i]):
                    to_old[i], before_old[i] = to_new[j] - price[i][j], j
                    changed.add(i)
        end = min((j for j in news if room[j]), key=lambda j: (to_new[j], j))
        path, j = [], end
        while True:
            i = before_new[j]
            path.append((i, j))
            if i not in before_old:
                break
            j = before_old[i]
        start = path[-1][0]
        amount = min([left[start], room[end]] + [flow[i, before_old[i]] for i, _ in path[:-1]])
        for i, j in path:
            flow[i, j] = flow.get((i, j), 0) + amount
        for i, _ in path[:-1]:
            flow[i, before_old[i]] -= amount
        left[start] -= amount
        room[end] -= amount
    return {x: f for x, f in sorted(flow.items()) if f}


def intervals(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, begin, end) on each old shard's line of bytes; what stays comes first."""
    out, at = [], {}
    for (i, j), f in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((i, j, at.get(i, 0), at.get(i, 0) + f))
        at[i] = out[-1][3]
    return out


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def _write_generation(rows: DataFrame, folder: str, generation: int) -> DataFrame:
    """Writes ``rows(shard, block, order…, size, row)``; the blocks it wrote."""
    order = [c for c in rows.columns if c.startswith("order")]
    in_block = Window.partitionBy("shard", "block").orderBy(*order)
    (rows.withColumn("place", F.row_number().over(in_block) - 1)
     .withColumn("before", F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
     .select("shard", "block", "place", "before", "size", "row")
     .write.option("compression", "zstd").partitionBy("shard", "block").parquet(f"{folder}/generation={generation}"))
    return _generation(rows.sparkSession, folder, generation, rows.schema["row"].dataType).groupBy("shard", "block").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes")).select(F.lit(generation).alias("generation"), "shard", "block", "rows", "bytes")


def _generation(spark: SparkSession, folder: str, generation: int, kind) -> DataFrame:
    """The rows of a generation. Its schema is known, so that an empty one reads as well."""
    schema = f"place int, before long, size long, row {kind.simpleString()}, shard int, block string"
    return spark.read.schema(schema).parquet(f"{folder}/generation={generation}")


def write_shards(docs: DataFrame, folder: str, shard: Column, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> None:
    """Writes ``docs`` as version 0 of an archive, each row into ``shard``."""
    spark = docs.sparkSession
    text = docs[text_col]
    rows = docs.select(shard.cast("int").alias("shard"), size_of(text).alias("size"), docs[id_col].alias("order1"),
                       F.crc32(F.coalesce(text.cast("string"), F.lit(""))).alias("order2"), F.struct(*docs.columns).alias("row"))
    # sizes between two powers of four are alike; the largest come first
    rows = rows.withColumn("kind", -F.floor((F.length(F.bin("size")) - 1) / 2).cast("int"))
    needs = sorted((r["shard"], r["kind"], -(-r["bytes"] // block_bytes)) for r in
                   rows.groupBy("shard", "kind").agg(F.sum("size").alias("bytes")).collect())  # at most 16 rows per shard
    first, plan = {}, []
    for s, k, blocks in needs:
        plan.append((s, k, first.get(s, 0), blocks))
        first[s] = plan[-1][2] + blocks
    plan = spark.createDataFrame(plan, "shard int, kind int, first int, blocks int")
    # rows without an id are told apart by their places in the input
    spread = F.xxhash64("order1", "order2", F.when(F.col("order1").isNull(), F.monotonically_increasing_id()))
    rows = (rows.withColumn("spread", spread).join(F.broadcast(plan), ["shard", "kind"])
            .withColumn("block", F.lpad((F.col("first") + F.pmod("spread", "blocks")).cast("string"), 9, "0")))
    rows.select("row").limit(0).write.parquet(f"{folder}/schema")
    blocks = _write_generation(rows.select("shard", "block", "order1", "order2", "size", "row"), folder, 0)
    _manifest(blocks).write.parquet(f"{folder}/manifest-0")


def _manifest(blocks: DataFrame) -> DataFrame:
    """Blocks with the slot of their first row."""
    earlier = Window.partitionBy("shard").orderBy("generation", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("slot", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long"))


def _joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with what ``blocks(shard, block, …)`` has of theirs: narrow, a row per block."""
    return rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["shard", "block"])


def reshard(spark: SparkSession, folder: str, capacities: list[int] | int, version: int = 0,
            cost: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Writes version + 1 of the archive: shard k gets capacities[k] bytes, or
    as many shards as the number says get equally many. Rewrites only the blocks
    that move or lie on a border. Returns the flow."""
    manifest = spark.read.parquet(f"{folder}/manifest-{version}")
    held = {r["shard"]: r["bytes"] for r in manifest.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    sizes = [held.get(k, 0) for k in range(max(held, default=-1) + 1)]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(sizes), capacities)
    flow = cheapest_transfers(sizes, capacities, cost)
    lines = intervals(flow)
    moves = spark.createDataFrame(lines, "shard int, new int, begin long, end long")
    earlier = Window.partitionBy("shard").orderBy("generation", "block")
    placed = manifest.withColumn("start", F.sum("bytes").over(earlier) - F.col("bytes"))
    touched = (placed.join(F.broadcast(moves), "shard").filter("start < end AND start + bytes > begin")  # moves: old x new shards
               .groupBy("generation", "shard", "block", "rows", "bytes", "start")
               .agg(F.count("*").alias("parts"), F.min("new").alias("new")))
    stay = touched.filter("parts = 1 AND new = shard").select("generation", "shard", "block", "rows", "bytes")
    go = touched.filter("parts > 1 OR new <> shard").select("generation", "shard", "block", "start", F.when(F.col("parts") == 1, F.col("new")).alias("to"))
    go.write.parquet(f"{folder}/moves-{version + 1}")
    go = spark.read.parquet(f"{folder}/moves-{version + 1}")
    kind = _row_type(spark, folder)
    split = _rows_of(spark, folder, go.filter("to IS NULL"), kind, ["start"])
    split = split.withColumn("at", F.col("start") + F.col("before"))
    inside = (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end"))
    # rows on a border, one per border, and what the shards have without them
    on_border = (split.select("generation", "shard", "block", "place", "size", "at").join(F.broadcast(moves), "shard")
                 .filter(inside & (F.col("at") + F.col("size") > F.col("end"))).collect())
    lack, chosen = [0] * len(capacities), []
    for r in on_border:  # intervals fill the capacities, but for what such rows cover of them
        for old, new, begin, end in lines:
            if old == r["shard"]:
                lack[new] += max(0, min(r["at"] + r["size"], end) - max(r["at"], begin))
    for r in sorted(on_border, key=lambda r: (-r["size"], r["shard"], r["at"])):
        new = max(range(len(lack)), key=lambda k: (lack[k], k == r["shard"], -k))
        lack[new] -= r["size"]
        chosen.append((r["generation"], r["shard"], r["block"], r["place"], new))
    chosen = spark.createDataFrame(chosen, "generation int, shard int, block string, place int, chosen int")
    whole = _rows_of(spark, folder, go.filter("to IS NOT NULL"), kind, ["to"])
    parted = (split.join(F.broadcast(moves), "shard").filter(inside)
              .join(F.broadcast(chosen), ["generation", "shard", "block", "place"], "left")
              .withColumn("to", F.coalesce("chosen", "new")))
    columns = [F.col("to").alias("shard"), F.concat_ws("-", F.col("generation"), F.col("shard"), F.col("block")).alias("block"),
               F.col("place").alias("order1"), "size", "row"]
    written = _write_generation(whole.select(*columns).unionAll(parted.select(*columns)), folder, version + 1)
    _manifest(stay.unionAll(written)).write.parquet(f"{folder}/manifest-{version + 1}")
    return flow


def _row_type(spark: SparkSession, folder: str):
    return spark.read.parquet(f"{folder}/schema").schema["row"].dataType


def _rows_of(spark: SparkSession, folder: str, blocks: DataFrame, kind, columns: list[str]) -> DataFrame:
    """Rows of the blocks, of whichever generation, with ``columns`` of their blocks."""
    generations = sorted(r[0] for r in blocks.select("generation").distinct().collect())  # at most one per version
    out = None
    for g in generations or [0]:
        of = blocks.filter(F.col("generation") == g).select("shard", "block", *columns)
        rows = _joined(_generation(spark, folder, g, kind), of).withColumn("generation", F.lit(g))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_shards(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(row, size, shard, slot): the rows of a version of the archive, ``row``
    with the columns they were written with. Slots count from 0 in each shard."""
    manifest = spark.read.parquet(f"{folder}/manifest-{version}")
    rows = _rows_of(spark, folder, manifest, _row_type(spark, folder), ["slot"])
    return rows.select("row", "size", "shard", (F.col("slot") + F.col("place")).alias("slot"))


def op13_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_shards(docs, folder, F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)))
    reshard(spark, folder, NEW_SHARDS)
    return read_shards(spark, folder, 1).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
