"""Near-duplicate embeddings by NN-descent.

1. Lists start from random projections: in each of several tables a vector's code is the signs of its products with random
   directions, and vectors of a code (in blocks of WHOLE, ordered by one more projection) are compared with each other. The
   number of tables follows from the code's length, so that two vectors at the threshold meet with probability ``recall``.
2. Rounds of neighbours-of-neighbours joins: every node sees the vectors of its neighbours and of those that have it as a
   neighbour, and introduces them to each other. Lists keep the nearest. Two vectors that link to a common neighbour
   differ by twice the link's angle at most, so only edges up to that angle are kept and followed.
3. A list that is full of links is saturated and is enlarged, twice as long each round; where it is still full at MOST, its
   node's whole component is compared pairwise in blocks, so no link is lost to a list's length.
4. Recall is audited: the links of all vectors whose id is divisible by 20, in blocks, are held against brute force over all
   vectors. It is the mean over nodes of the part of their distinct neighbours that was found (whatever is found is a link, so
   counts tell), taken apart for nodes of components compared whole, for other nodes with one neighbour and for other nodes
   with several. Where none of them has a link, nodes that have one by what was found are audited. More tables are added
   until each figure reaches ``recall`` (or as many as at first were added three times; then it raises).

Cosines decide links in double precision. Vectors that are null, zero, or hold a null or non-finite component link with
nothing; so do those of another length with the rest. Equal vectors are one node with a count. Rows that repeat vec_id and
direction are one row (as are those of one vec_id without any); other vectors that share a vec_id are vectors of their own. A null vec_id is one, too, which has no component_id
of its own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as X
from .components import connected_components
from .tables import BLOB, BUCKETS_A_PARTITION, Dealer, by_bucket, discard, joined, partitions, small_batches, with_facts, written

LEAF, BLOCK, WHOLE, MOST = 256, 512, 2048, 64
#: Vectors of an audit's block, and blocks of one pass over all vectors.
ASKED, AT_ONCE = 4096, 4
NODES = "node long, vec binary"
EDGE = "v long, u long, sim double"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their unit vectors in double precision, or null where they can't link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
            top = np.abs(a).max() if len(a) and np.isfinite(a).all() else 0.0
            if top > 0:
                a = a / top
                out.append((a / math.sqrt(float(a @ a))).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _directions(seed: int, n: int, dims: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(n, dims))


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """So many tables that two vectors at the threshold share a code in one of them with probability ``recall``."""
    same = max(1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi, 0.5) ** bits
    return 1 if same == 1 else math.ceil(math.log(max(1 - recall, 1e-6)) / math.log1p(-same))


def _codes(first: int, tables: int, bits: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealer(most=200_000)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.array([len(b) for b in blobs])
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                m = _matrix([blobs[i] for i in rows])
                for t in range(first, first + tables):
                    p = m @ _directions(t, bits + 1, m.shape[1]).T
                    code = ((p[:, :bits] > 0) << np.arange(bits)).sum(1).astype(X.U64) if bits else np.zeros(len(rows), X.U64)
                    key = X.mix(code * X.U64(4096) + X.U64(t)) ^ X.U64(s)
                    yield from out.add({"key": key, "node": node[rows], "by": p[:, bits], f"v{s}": m}, key % X.U64(n), int(s))
        yield from out.flush()

    return run


def _nearest(node: np.ndarray, m: np.ndarray, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Of each node its k nearest others here, as far as their cosine is ``least`` or more."""
    k = min(k, len(node) - 1)
    for at in range(0, len(node), BLOCK):
        own = node[at : at + BLOCK]
        s = m[at : at + BLOCK] @ m.T
        s[np.arange(len(own)), at + np.arange(len(own))] = -2
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(node) - 1 else np.argsort(-s, axis=1)[:, :k]
        sim = np.take_along_axis(s, best, 1)
        i, j = np.nonzero(sim >= least)
        yield _edges(own[i], node[best[i, j]], sim[i, j])


def _edges(v, u, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(sim, np.float64))], names=["v", "u", "sim"])


def _leaves(k: int, least: float):
    def make():
        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            for size, blobs in have.items():
                x = joined(blobs)
                m = x.pop(f"v{size}").reshape(len(x["node"]), -1)
                order = np.lexsort((x["by"], x["key"]))
                for rows in np.split(order, np.flatnonzero(np.diff(x["key"][order])) + 1):
                    for i in range(0, len(rows), WHOLE):
                        part = rows[i : i + WHOLE]
                        if len(part) > 1:
                            yield from _nearest(x["node"][part], m[part], k, least)

        return fn, None

    return make


def _grouped(fn, key: str):
    """Applies fn(key, rows of the key) to rows sorted by the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(key)[0].as_py() != k[i]:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return run


def _introduce(least: float):
    def fn(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        k = rows.column("k").to_numpy().max()
        node, first = np.unique(rows.column("a").to_numpy(), return_index=True)
        blobs = rows.column("vec").to_pylist()
        if len(node) > 1 and len({len(blobs[i]) for i in first}) == 1:
            yield from _nearest(node, _matrix([blobs[i] for i in first]), int(k), least)

    return fn


def _top(edges: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """The nearest neighbours of each node, as many as its list may hold."""
    e = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u")))
    if sizes is None:
        return e.where(F.col("rank") <= k).select("v", "u", "sim", F.lit(k).alias("k"))
    e = e.join(sizes, "v", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    return e.where(F.col("rank") <= F.col("k")).select("v", "u", "sim", "k")


def _block_pairs(threshold: float):
    """Links of two blocks of a component, counted for each node with the other nodes' counts, and as distinct nodes."""

    def fn(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        block = rows.column("block").to_numpy()
        node, count = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        m = _matrix(rows.column("vec").to_pylist())
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            return
        hit = m[a] @ m[b].T >= threshold
        if i == j:
            np.fill_diagonal(hit, False)
        sides = [(node[a], hit @ count[b], hit.sum(1)), (node[b], count[a] @ hit, hit.sum(0))]
        for own, links, others in sides[: 1 + (i != j)]:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links.astype(np.int64)), pa.array(others.astype(np.int64))], names=["node", "links", "others"])

    return fn


def _completed(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """node, links, others (distinct nodes) of all members (node, component) of the components given, by comparing all pairs of their blocks."""
    rows = members.join(nodes, "node").select("node", "component", "vec", "n")
    sizes = rows.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = rows.select("*", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = pairs.withColumn("pair", F.xxhash64("component", "i", "j")).select("pair", "i", "j", "block", "node", "n", "vec")
    pairs = pairs.repartition(partitions(nodes.sparkSession), "pair").sortWithinPartitions("pair")
    return pairs.mapInArrow(_grouped(_block_pairs(threshold), "pair"), "node long, links long, others long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def _true_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """node, true (distinct nodes that link) of the nodes asked for, by brute force. A block of them at a time goes to all tasks."""
    blocks = -(-asked.count() // ASKED)
    out = None
    for b in range(blocks):
        by_size: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).collect():
            by_size.setdefault(len(r["vec"]), []).append((r["node"], bytes(r["vec"])))
        block = {s: (np.array([x[0] for x in own], np.int64), _matrix([x[1] for x in own])) for s, own in by_size.items()}

        def run(batches: Iterator[pa.RecordBatch], block: dict = block) -> Iterator[pa.RecordBatch]:
            total = {s: np.zeros(len(q), np.int64) for s, (q, _) in block.items()}
            for batch in batches:
                node, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                size = np.array([len(b) for b in blobs])
                for s, (q, m) in block.items():
                    own = np.flatnonzero(size == s)
                    if len(own):
                        total[s] += ((m @ _matrix([blobs[i] for i in own]).T >= threshold) & (q[:, None] != node[own][None, :])).sum(1)
            for s, (q, _) in block.items():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(total[s])], names=["node", "true"])

        found = nodes.select("node", "vec").mapInArrow(run, "node long, true long")
        out = found if out is None else out.unionByName(found)
        if (b + 1) % AT_ONCE == 0:
            out = written(out.groupBy("node").agg(F.sum("true").alias("true")))
    return None if out is None else out.groupBy("node").agg(F.sum("true").alias("true"))


def _recalls(truth: DataFrame, found: DataFrame) -> dict[str, float]:
    """Mean recall of the distinct neighbours of nodes that have any, by kind of node, so that no large group speaks for the rest."""
    kind = F.when(F.col("whole"), "compared whole").when(F.col("true") == 1, "one neighbour").otherwise("several neighbours")
    rows = truth.where(F.col("true") > 0).join(found, "node").groupBy(kind.alias("kind")).agg(F.avg(F.least("others", "true") / F.col("true")).alias("recall"))
    return {r["kind"]: r["recall"] for r in rows.collect()}


def audit(nodes: DataFrame, found: DataFrame, threshold: float) -> dict[str, float]:
    """Recall by kind of node; empty only where nothing was found and no audited node has a link."""
    truth = _true_links(nodes, nodes.where("asked"), threshold)
    reached = _recalls(truth, found) if truth is not None else {}
    if not reached:
        some = nodes.join(found.where("others > 0").orderBy(F.xxhash64("node"), "node").limit(ASKED).select("node"), "node", "left_semi")
        truth = _true_links(nodes, some, threshold)
        reached = _recalls(truth, found) if truth is not None else {}
    return reached


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, k: int = 16, tables: int = 10, rounds: int = 4, recall: float = 0.97, audited: Column | None = None, report: dict[str, float] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each distinct row of ``embeddings``.

    ``tables`` is the least number of tables and the most at once; ``audited`` a condition on vec_id. ``report`` is given the recall that was measured.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    n = partitions(spark) * BUCKETS_A_PARTITION
    e = embeddings
    rows = written(e.select(e["vec_id"].cast("long").alias("vec_id"), e["embedding"].cast("array<double>").alias("embedding")).mapInArrow(_unit, "vec_id long, vec binary").distinct())
    asked = F.coalesce(audited if audited is not None else F.pmod("vec_id", F.lit(20)) == 0, F.lit(False))
    # nodes are numbered anew: vectors that share a vec_id are different ones
    equal = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked"))
    nodes = written(equal.select(F.monotonically_increasing_id().alias("node"), "vec", "n", "least", "asked"))
    total = nodes.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / LEAF)))
    least = 2 * threshold * threshold - 1 if threshold > 0 else -1.0  # the cosine of twice the angle
    needed = max(tables, tables_for(bits, threshold, recall))
    at_once = math.ceil(needed / math.ceil(needed / tables))
    graph, done = None, 0
    for attempt in range(1, 5):
        while done < attempt * needed:
            now = min(at_once, attempt * needed - done)
            coded = nodes.select("node", "vec").mapInArrow(_codes(done, now, bits, n), BLOB)
            found = by_bucket(coded, _leaves(k, least), EDGE)
            done += now
            graph = written(_top(found if graph is None else found.unionByName(graph.select("v", "u", "sim")), None, k))
        sizes = None
        before = -1
        for _ in range(rounds):
            both = graph.select("v", F.col("u").alias("a"), "k")
            back = graph.select(F.col("u").alias("v"), F.col("v").alias("a"), "k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")).alias("rank")).where("rank <= k").drop("rank")
            own = graph.select("v", F.col("v").alias("a"), "k").distinct()
            near = both.unionByName(back).unionByName(own).join(nodes.select(F.col("node").alias("a"), "vec"), "a")
            new = near.repartition(partitions(spark), "v").sortWithinPartitions("v").mapInArrow(_grouped(_introduce(least), "v"), EDGE)
            full = graph.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("least"), F.max("k").alias("k"))
            sizes = full.select("v", F.when((F.col("c") >= F.col("k")) & (F.col("least") >= threshold), F.least(F.col("k") * 2, F.lit(MOST))).otherwise(F.col("k")).cast("int").alias("k"))
            graph = written(_top(graph.select("v", "u", "sim").unionByName(new), sizes, k))
            now = graph.where(F.col("sim") >= threshold).count()
            if now == before:
                break
            before = now
        links = graph.where(F.col("sim") >= threshold)
        parts = connected_components(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
        saturated = links.groupBy("v", "k").agg(F.count(F.lit(1)).alias("c")).where("c >= k").select(F.col("v").alias("node"))
        whole = parts.join(parts.join(saturated, "node").select("component").distinct(), "component").select("node", "component")
        counted = _completed(nodes, whole, threshold)
        pairs = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
        listed = pairs.join(nodes.select(F.col("node").alias("u"), "n"), "u").groupBy("v").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("others")).select(F.col("v").alias("node"), "links", "others", F.lit(False).alias("whole"))
        listed = listed.join(whole.select("node"), "node", "left_anti")
        counted = counted.withColumn("whole", F.lit(True))
        found = written(nodes.select("node", "n").join(parts, "node", "left").join(counted.unionByName(listed), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("whole", F.lit(False)).alias("whole")))
        reached = audit(nodes, found, threshold)
        if report is not None:
            report.clear()
            report |= reached
        if all(r >= recall for r in reached.values()):
            break
    else:
        raise RuntimeError(f"recall is {', '.join(f'{r:.3f} ({kind})' for kind, r in sorted(reached.items()))} after {done} tables")
    # a component of one node can have several rows: equal vectors link
    least = nodes.select("node", "least").join(found.select("node", "component"), "node").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    per_node = written(with_facts(found.select("node", "component", "links"), least, ["component"], total).select("node", "links", "component_id"))
    per_vector = nodes.join(per_node, "node").select("vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id", F.col("n").alias("rows"))
    linked = with_facts(rows.where("vec is not null"), per_vector, ["vec"], rows.count())
    alone = rows.where("vec is null").select("vec", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
