"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones a flow is solved that moves the fewest bytes. It is
carried out in blocks: rows are hashed by text into blocks, whose sizes (not rows) are all the driver sees, and each old
shard's blocks are given to new shards until its flows are filled, largest first. Then rewrite() writes the shards that
gain or lose a block, and no others: the plan carries the rows themselves, so they are moved once and joined with nothing.

Rows with equal texts stay in one shard. A text whose copies hold more than a shard's capacity is an exception: no near
equal law can hold with it in one shard, so its rows are dealt into blocks by doc_id. Of texts over half a capacity, two
don't fit in one shard: the largest, one for each new shard, are blocks of their own, and others are dealt out, too. Null
texts count one byte and are a group of their own; null doc_ids are ids like others; rows that repeat doc_id and text are
rows of their own; columns of ``docs`` named shard and slot give way to the new ones; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import delete

#: Each block is counted in PARTS parts by doc_id, so that no task orders all rows of a block.
PARTS = 8


def blocks_for(n_old: int, n_new: int) -> int:
    """Blocks of each old shard: some 256 to 512 for each new shard, which bounds what a shard exceeds its capacity by. As many again hold the rows of texts too large for one shard."""
    return max(16, 1 << (256 * n_new // max(n_old, 1)).bit_length())


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from each supply to each capacity at least cost, by successive shortest paths with potentials. Capacities must suffice."""
    a, b = len(supply), len(capacity)
    source, sink, n = a + b, a + b + 1, a + b + 2
    graph: list[list[list[int]]] = [[] for _ in range(n)]  # [to, left, cost, place of the reverse edge]

    def edge(u: int, v: int, most: int, c: int) -> None:
        graph[u].append([v, most, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(b):
            edge(i, a + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(a + j, sink, c, 0)
    potential, left = [0] * n, sum(supply)
    while left:
        far, back, heap = [float("inf")] * n, [None] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, most, c, _) in enumerate(graph[u]):
                if most and d + c + potential[u] - potential[v] < far[v]:
                    far[v] = d + c + potential[u] - potential[v]
                    back[v] = (u, k)
                    heapq.heappush(heap, (far[v], v))
        if back[sink] is None:
            raise ValueError("the new shards can't hold all bytes")
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        push, v = left, sink
        while v != source:
            u, k = back[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = back[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    flow = [[0] * b for _ in range(a)]
    for i in range(a):
        for v, _, _, back_ in graph[i]:
            if a <= v < a + b:
                flow[i][v - a] = graph[v][back_][1]
    return flow


def block_transfers(sizes: dict[tuple[int, int], int], n_old: int, n_new: int) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block), so that new shards are near equal and the fewest bytes move."""
    total = sum(sizes.values())
    supply = [0] * n_old
    for (old, _), size in sizes.items():
        supply[old] += size
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    out: dict[tuple[int, int], int] = {}
    # what a shard's blocks exceed or miss of its flows is carried to the next blocks by the new shards' own balance
    room = [[flow[i][j] for j in range(n_new)] for i in range(n_old)]
    free = capacity[:]
    for (old, block), size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        to = max(range(n_new), key=lambda j: (min(room[old][j], free[j]) >= size, min(room[old][j], free[j]), j == old, -j))
        if min(room[old][to], free[to]) < size // 2 or free[to] < size:
            to = max(range(n_new), key=lambda j: (free[j], j == old, -j))
        out[old, block] = to
        room[old][to] -= size
        free[to] -= size
    return out


@dataclass
class Plan:
    """``rows``: row (the row of ``docs``), size, text_crc32, old_shard, block, shard and slot (gapless in a shard), one for each row of ``docs``.

    ``affected``: the shards, old or new, that gain or lose rows. ``moved``: the bytes that change shards.
    """

    rows: DataFrame
    affected: list[int]
    moved: int


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int = 8) -> Plan:
    """``old_shard`` (0 .. n_old - 1) must be the same for rows of equal texts if these are to stay together."""
    spark, blocks = docs.sparkSession, blocks_for(n_old, n_new)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    id_ = docs["doc_id"].cast("long")
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row"),
        id_.alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(docs["text"].cast("string")).alias("group"),
        old_shard.cast("int").alias("old_shard"),
        # rows without an id are dealt by their texts
        F.pmod(F.xxhash64(F.coalesce(id_, F.xxhash64(text))), F.lit(blocks * PARTS)).alias("deal"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    # under 2 * n_new groups can each hold over half a capacity
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(total / n_new / 2)).orderBy(F.desc("bytes"), "group").collect()
    whole = [r["group"] for r in large if r["bytes"] <= total // n_new][:n_new]
    own_block = {g: 2 * blocks + i for i, g in enumerate(whole)}
    heavy = spark.createDataFrame([(r["group"], own_block.get(r["group"], -1)) for r in large], "group long, own int")
    block = F.when(F.col("own") >= 0, F.col("own")).when(F.col("own") < 0, F.lit(blocks) + F.floor(F.col("deal") / PARTS)).otherwise(F.pmod("group", F.lit(blocks)))
    rows = rows.join(F.broadcast(heavy), "group", "left").select("row", "id", "size", "text_crc32", "old_shard", (F.col("deal") % PARTS).cast("int").alias("part"), block.cast("int").alias("block"))
    stats = rows.groupBy("old_shard", "block", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas()  # (2 * blocks + n_new) * PARTS rows for each old shard at most
    sizes: dict[tuple[int, int], int] = defaultdict(int)
    for old, b, size in zip(stats["old_shard"], stats["block"], stats["bytes"], strict=True):
        sizes[int(old), int(b)] += int(size)
    to = block_transfers(dict(sizes), n_old, n_new) if sizes else {}
    stats["shard"] = [to[int(o), int(b)] for o, b in zip(stats["old_shard"], stats["block"], strict=True)]
    stats = stats.sort_values(["shard", "old_shard", "block", "part"])
    stats["first"] = stats.groupby("shard")["n"].cumsum() - stats["n"]
    schema = T.StructType([T.StructField(c, T.IntegerType() if c != "first" else T.LongType()) for c in ("old_shard", "block", "part", "shard", "first")])
    plan = spark.createDataFrame(pd.DataFrame({f.name: stats[f.name].astype("int64" if f.name == "first" else "int32") for f in schema}), schema)
    own = Window.partitionBy("old_shard", "block", "part").orderBy("id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(own) - 1).join(F.broadcast(plan), ["old_shard", "block", "part"])
    changed = {key: j for key, j in to.items() if key[0] != j}
    return Plan(
        placed.select("row", "size", "text_crc32", "old_shard", "block", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot")),
        sorted({old for old, _ in changed} | set(changed.values())),
        sum(sizes[key] for key in changed),
    )


def rewrite(plan: Plan, path: str) -> list[int]:
    """Writes the affected shards to path/shard=K, rows whole with their slot, and returns their numbers; other shards' files stay as they are.

    New files are complete in a folder beside the shards before any old shard is deleted, so the rows may come from ``path`` itself, and a
    job that is broken off has lost nothing. Shards that have become empty go.
    """
    spark = plan.rows.sparkSession
    new, fs = f"{path}/_new-{uuid.uuid4().hex}", _files(spark, path)
    keep = [c for c in plan.rows.schema["row"].dataType.names if c not in ("shard", "slot")]
    plan.rows.where(F.col("shard").isin(plan.affected)).select(*(F.col("row").getField(c).alias(c) for c in keep), "slot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(new)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for k in plan.affected:
        delete(spark, f"{path}/shard={k}")
        if fs.exists(at(f"{new}/shard={k}")) and not fs.rename(at(f"{new}/shard={k}"), at(f"{path}/shard={k}")):
            raise OSError(f"{new}/shard={k} can't be moved to {path}")
    delete(spark, new)
    return plan.affected


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    return fs


def shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that rewrite() wrote of documents of that schema, with slot and shard."""
    own = [f for f in schema if f.name not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*own, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
