"""Reading tables, writing intermediate ones, and moving packed numpy arrays through Spark's shuffles."""

from __future__ import annotations

import gc
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside the operators a null doc_id is an id up to this one, told apart by the text's hash; it sorts before every other id.
NULL_ID = -(1 << 62)
#: A task makes a packed row for each bucket, so their number is that of tasks times that of buckets: for 100 TB, partitions should hold about 1 GB of text.
BUCKETS_A_PARTITION = 2
BLOB = "bucket int, kind int, blob binary"
#: The kind of packed documents, which come after all findings about them, and how many bytes of them a task gathers.
ROWS, ROWS_BYTES = 1 << 20, 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Where it is unset, a temporary one if all run on this machine; otherwise it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tallyrill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; all of a session's are in one folder."""
    return f"{shared_dir(spark)}/tallyrill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: the lineage ends there, and losing an executor loses nothing.

    Shuffle files of the steps before it are then garbage, which the driver is asked to collect. discard() deletes the table.
    """
    spark = df.sparkSession
    collect_garbage(spark)  # what the caller of the step before still held then
    path = new_folder(spark)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    del df, writer
    collect_garbage(spark)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    for kept in _SCOPES:
        kept.append((spark, path))
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.written_to)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this session's operators have written; what they returned can't be read any more."""
    delete(spark, f"{shared_dir(spark)}/tallyrill/{spark.sparkContext.applicationId}")


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what written() wrote within it, but for the table that is passed to the function it gives."""
    own: list[tuple[SparkSession, str]] = []
    last: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        last.append(df.written_to)
        return df

    _SCOPES.append(own)
    try:
        yield keep
    finally:
        _SCOPES.remove(own)
        for spark, path in own:
            if path not in last:
                delete(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, as texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sampled(rows: DataFrame, most_rows: int, by: Column) -> DataFrame:
    """At most ``most_rows`` rows, those whose hash of ``by`` is least, up to a bound that expects 5 % fewer; all, if there are no more. Always the same ones.

    Only a count reaches the driver before.
    """
    share = 0.95 * most_rows / max(rows.count(), 1)
    if share < 0.95:
        rows = rows.where(F.xxhash64(by) < F.lit(int((2 * share - 1) * (1 << 63))))
    return rows.orderBy(F.xxhash64(by), by).limit(most_rows)


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Only id (never null), tag (16 bits of the text's hash) and text, whatever other columns there are.

    Rows that repeat both doc_id and text are one document for the operators; rows that share a doc_id only are told apart by the tag.
    """
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID) - F.xxhash64(docs["text"]).bitwiseAND(F.lit((1 << 61) - 1))).alias("id"),
        F.xxhash64(docs["text"]).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("tag"),
        docs["text"].cast("string").alias("text"),
        *more,
    )


def doc_id() -> Column:
    """The doc_id of keyed rows, null where it was null."""
    return F.when(F.col("id") > NULL_ID, F.col("id")).alias("doc_id")


def with_facts(rows: DataFrame, facts: DataFrame, key: list[str], total: int) -> DataFrame:
    """Inner join of ``total`` rows with one fact for each key. ``facts`` tells by its column ``rows`` how many rows each key has.

    Keys of very many rows, of which there are under 100,000 whatever the total, are broadcast, so that no task gathers one's rows.
    """
    many = max(10_000, total // 100_000)
    if total <= many:  # no key has more
        return rows.join(facts.drop("rows"), key)
    heavy, light = facts.where(F.col("rows") > many).drop("rows"), facts.where(F.col("rows") <= many).drop("rows")
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key))


def id_bucket(n: int) -> Column:
    return F.pmod(F.hash("id"), F.lit(n))


def id_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    """The same as id_bucket(), in numpy."""
    with np.errstate(over="ignore"):
        u, u32 = ids.astype(np.int64).view(np.uint64), np.uint32

        def k1(k):
            k = k * u32(0xCC9E2D51)
            return ((k << u32(15)) | (k >> u32(17))) * u32(0x1B873593)

        h = np.full(len(u), 42, u32)
        for k in ((u & np.uint64(0xFFFFFFFF)).astype(u32), (u >> np.uint64(32)).astype(u32)):
            h = h ^ k1(k)
            h = ((h << u32(13)) | (h >> u32(19))) * u32(5) + u32(0xE6546B64)
        h = h ^ u32(8)
        h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
        h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
        h = h ^ (h >> u32(16))
    return h.view(np.int32).astype(np.int64) % n


def pack(arrays: dict[str, np.ndarray | bytes]) -> bytes:
    """Named arrays (or bytes) as one compressed value."""
    heads, bodies = [struct.pack("<B", len(arrays))], []
    for name, a in arrays.items():
        bodies.append(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())
        heads.append(struct.pack("<7s3sI", name.encode(), b"S" if isinstance(a, bytes) else a.dtype.str[1:].encode(), len(bodies[-1])))
    return b"".join(heads) + zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))


def unpack(blob: bytes) -> dict[str, np.ndarray | bytes]:
    n = blob[0]
    heads = [struct.unpack_from("<7s3sI", blob, 1 + 14 * i) for i in range(n)]
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[1 + 14 * n :]), 0, {}
    for name, kind, size in heads:
        kind = kind.rstrip(b"\0").decode()
        part = body[at : at + size]
        out[name.rstrip(b"\0").decode()] = part if kind == "S" else np.frombuffer(part, kind)
        at += size
    return out


def joined(blobs: Iterable[dict], *names: str) -> dict[str, np.ndarray]:
    blobs = list(blobs)
    return {n: np.concatenate([b[n] for b in blobs]) for n in names or (blobs[0] if blobs else ())}


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "kind", "blob"],
    )


def dealt(arrays: dict[str, np.ndarray], bucket: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, holding its share of the arrays in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.append(np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1)), len(order))
    arrays = {k: v[order] for k, v in arrays.items()}
    rows = [(int(sorted_[i]), kind, pack({k: v[i:j] for k, v in arrays.items()})) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in range(0, len(rows), 512):
        yield blob_batch(rows[i : i + 512])


class Dealer:
    """Gathers a task's arrays by kind, to be dealt to buckets together: a task makes one row for each bucket and kind, not one for each call."""

    def __init__(self, most: int = 300_000):
        self.most, self.rows, self.have = most, 0, {}

    def add(self, arrays: dict[str, np.ndarray], bucket: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.have.setdefault(kind, []).append(arrays | {"": np.asarray(bucket, np.int64)})
            self.rows += len(bucket)
        if self.rows > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        have, self.have, self.rows = self.have, {}, 0
        for kind in sorted(have):
            x = joined(have.pop(kind))
            bucket = x.pop("")
            yield from dealt(x, bucket, kind)


def by_bucket(blobs: DataFrame, make: Callable[[], tuple], schema: str) -> DataFrame:
    """The blobs of a bucket meet in one task.

    In each task make() gives two functions: fn(bucket, unpacked blobs by kind), and one for what is left at the end, or None. Both yield batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        fn, end = make()
        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if have:
                        yield from fn(now, have)
                    now, have = bucket, {}
                have.setdefault(kind, []).append(unpack(blob))
        if have:
            yield from fn(now, have)
        if end:
            yield from end()

    n = partitions(blobs.sparkSession)
    return blobs.select("bucket", "kind", "blob").repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(run, schema)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows of documents as compressed values, one for each bucket: texts shrink by a third more than in Spark's own blocks, and aren't sorted row by row."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        bucket = whole.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        whole = whole.drop_columns(["bucket"]).take(pa.array(order)).combine_chunks()
        bucket = bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
                writer.write_table(whole.slice(i, j - i), max_chunksize=500)
            rows.append((int(bucket[i]), ROWS, out.getvalue().to_pybytes()))
        yield blob_batch(rows)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > ROWS_BYTES:
            yield from flush(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield from flush(held)


def attach(docs: DataFrame, blobs: DataFrame, n_buckets: int, make: Callable[[], tuple], schema: str | T.StructType) -> DataFrame:
    """Brings packed findings to the documents (as keyed() gives them) they are about. Further columns of documents go with them.

    In each task make() gives two functions: fn(documents, blobs of their bucket by kind), and one for what is left at the end, or None. Both yield batches.

    Each bucket's blobs come first and its documents after them, batch by batch, so a task holds the findings of one bucket and one batch of texts.
    """
    docs = docs.select(id_bucket(n_buckets).cast("int").alias("bucket"), *docs.columns).mapInArrow(_packed_rows, BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        fn, end = make()
        for batch in batches:
            for bucket, kind, blob in zip(*(c for c in batch.columns), strict=True):
                if bucket.as_py() != now:
                    now, have = bucket.as_py(), {}
                if kind.as_py() < ROWS:
                    have.setdefault(kind.as_py(), []).append(unpack(blob.as_py()))
                else:
                    for rows in pa.ipc.open_stream(blob.as_buffer()):
                        yield from fn(rows, have)
        if end:
            yield from end()

    n = partitions(docs.sparkSession)
    return docs.unionByName(blobs.select("bucket", "kind", "blob")).repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


#: The most documents that are told apart by a broadcast: 16 bytes each.
MOST_IDS = 1_000_000


def only_met(docs: DataFrame, blobs: DataFrame, which: Callable[[dict], np.ndarray]) -> DataFrame:
    """Of documents (as keyed() gives them) those that packed findings, dealt by them, are about, or all where these are more than MOST_IDS."""

    def make():
        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined([{k: b[k][which(b)] for k in ("id", "tag")} for own in have.values() for b in own])
            _, first = np.unique(Lookup._key(x["id"], x["tag"]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x["id"][first]), pa.array(x["tag"][first].astype(np.int32))], names=["id", "tag"])

        return fn, None

    places = written(by_bucket(blobs, make, "id long, tag int"))
    if places.count() > MOST_IDS:
        return docs
    return docs.join(F.broadcast(places), ["id", "tag"], "left_semi")


class Lookup:
    """Rows of packed arrays by document (id and tag)."""

    def __init__(self, blobs: list[dict]):
        self.rows = joined(blobs) if blobs else {}
        if self.rows:
            key = self._key(self.rows["id"], self.rows.get("tag", np.uint16(0)))
            order = np.argsort(key, kind="stable")
            self.key, self.rows = key[order], {k: v[order] for k, v in self.rows.items()}

    @staticmethod
    def _key(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        from .text import U64, mix

        return mix(ids.astype(np.int64).view(U64)) ^ (tags.astype(U64) * U64(0x9E3779B97F4A7C15))

    def __call__(self, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each document."""
        if not self.rows:
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        key = self._key(ids, tags)
        return np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
