"""A log-structured fingerprint index for incremental removal of repeated word windows.

``FingerprintIndex.put(batch)`` fingerprints the windows of a batch of documents, sorts them into a new immutable run and
merge-joins that run with all earlier ones. ``found()`` brings what all batches since its last call have met to its documents
and verifies it, in one pass however many they were; ``add(batch)`` is both. ``compact()`` merges the runs into one; a batch
that finds more than ``most_runs`` of them does so first and is joined with the compacted run.

The windows of one document that choose the same content anchor (see text.anchors) share one entry: ``fp``, a hash of
the anchor's GRAM words, and ``sw`` and ``sx``, two independent 64-bit hashes of all words that its windows cover. Equal
windows always meet by ``fp``:

* entries whose ``fp``, ``sw`` and ``sx`` agree cover equal windows throughout: their whole word sequences have been verified
  by 128 bits;
* where ``fp`` agrees and the others don't, one entry for each word sequence is verified: those of its windows are read from
  the texts again and compared by two independent 64-bit hashes, window by window. Only documents with such entries are
  read into the verification (up to MOST_IDS of them; beyond, telling them apart would cost more than it saves).

Runs are in order of ``fp``, so they are merged, not sorted again; what is ordered further are entries that share one.

Nothing is sampled: every window belongs to one entry. A null text has no words; rows that repeat doc_id and text count
as one document; other rows with the same text are other documents, whose windows repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .suffixes import _changes, copies
from .tables import BLOB, Dealer, Lookup, attach, by_bucket, collect_garbage, dealt, discard, doc_id, id_buckets, joined, keyed, only_met, partitions, small_batches, written

GRAM = 8
#: What an entry is, and what a place is.
KEY, PLACE = ("fp", "sw", "sx"), ("id", "tag", "pos")
#: Kinds of packed rows: words that repeat for certain; what a merge-join met, either that (n is 0) or entries to verify; all entries.
HIT, MET, ENTRY = 0, 1, 2


def _words(column: pa.Array):
    raw, at = X.utf8(column)
    starts, ends, word_at = X.word_bounds(raw, at, X.NOT_SPACE)
    return raw, starts, ends, word_at


def _fingerprints(window: int, n: int):
    """Entries of all documents. Of equal entries within a task's share two places go on, enough to tell that they repeat; the words of all are reported at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Dealer(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = joined(held)
            held.clear()
            some, new = copies(x, KEY)
            place = _changes(*(x[k][some] for k in (*KEY, *PLACE)))
            group = np.cumsum(new) - 1
            places = np.cumsum(place)
            nth = places - places[np.flatnonzero(new)][group] if len(some) else places  # of its group's places, from 0
            many = (np.bincount(group, weights=place) > 2)[group] if len(some) else np.zeros(0, bool)
            hit = some[many]
            yield from out.add({k: x[k][hit] for k in ("id", "tag", "pos")} | {"end": x["pos"][hit] + x["n"][hit] + window - 1}, id_buckets(x["id"][hit], n), HIT)
            keep = np.ones(len(x["fp"]), bool)
            keep[some[many & (nth > 1)]] = False
            x = {k: v[keep] for k, v in x.items()}
            yield from out.add(x, x["fp"] % X.U64(n), ENTRY)

        for batch in batches:
            for part in X.slices(batch, "text"):
                raw, starts, ends, at = _words(part.column(2))
                if len(starts) < window:
                    continue
                words = X.word_hashes(raw, starts, ends)
                spans = X.Spans(words)
                i = np.arange(len(starts) - GRAM + 1)
                grams = spans(i, i + GRAM)
                a, first, last = X.anchors(grams, at, window, GRAM)
                doc = np.searchsorted(at, a, "right") - 1
                held.append({
                    "fp": grams[a], "sw": spans(first, last + window), "sx": X.Spans(words, 12345)(first, last + window), "id": part.column(0).to_numpy()[doc], "tag": part.column(1).to_numpy()[doc].astype(np.uint16),
                    "pos": (first - at[doc]).astype(np.int64), "n": (last - first + 1).astype(np.uint16),
                })
                rows += len(a)
                if rows > out.most:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()
        yield from out.flush()

    return run


def merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Entries of several sorted runs in order of KEY and PLACE, each place once.

    The stable sort is a merge of the runs it finds, so their order is used; only entries that share ``fp`` are ordered further.
    """
    x = joined(parts)
    order = np.argsort(x["fp"], kind="stable")
    x = {k: v[order] for k, v in x.items()}
    new = _changes(x["fp"])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    several = np.flatnonzero(np.repeat(size, size) > 1)
    some = {k: v[several] for k, v in x.items()}
    within = np.lexsort(tuple(some[k] for k in reversed((*KEY, *PLACE))))
    for k, v in some.items():
        x[k][several] = v[within]
    once = _changes(*(x[k] for k in (*KEY, *PLACE)))
    return {k: v[once] for k, v in x.items()}


def _sorted_run(bucket: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """One bucket of a run, or of several to be merged."""
    if HIT in have:  # already where their documents will be
        yield from dealt(y := joined(have[HIT]), np.full(len(y["id"]), bucket), HIT)
    if ENTRY in have:
        x = merged(have[ENTRY])
        yield from dealt(x, np.full(len(x["fp"]), bucket), ENTRY)


def _merge_join(newest: int, window: int):
    """What the newest run of a bucket shares with the earlier ones or holds more than once; it stays in its bucket."""

    def make():
        def fn(bucket: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if newest not in have:
                return
            new = joined(have[newest])
            parts = [new | {"age": np.ones(len(new["fp"]), np.int8)}]
            for age, blobs in have.items():
                for b in blobs if age != newest else ():
                    at = np.searchsorted(new["fp"], b["fp"])  # both are sorted
                    met = new["fp"][np.minimum(at, len(new["fp"]) - 1)] == b["fp"]
                    parts.append({k: v[met] for k, v in b.items()} | {"age": np.zeros(int(met.sum()), np.int8)})
            x = merged(parts)
            new_group, new_class = _changes(x["fp"]), _changes(*(x[k] for k in KEY))
            group, class_ = np.cumsum(new_group) - 1, np.cumsum(new_class) - 1
            hit = (np.bincount(class_) > 1)[class_] & (np.bincount(class_, weights=x["age"]) > 0)[class_]
            check = new_class & (np.bincount(group, weights=new_class) > 1)[group]
            rows = np.concatenate([np.flatnonzero(hit), np.flatnonzero(check)])
            met = {k: x[k][rows] for k in ("id", "tag", "pos", "n")} | {"end": x["pos"][rows] + x["n"][rows] + window - 1}
            met["n"][: int(hit.sum())] = 0
            yield from dealt(met, np.full(len(rows), bucket), MET)

        return fn, None

    return make


def _to_documents(n: int):
    """What the batches have met in a bucket, each finding once, dealt to the buckets of its documents."""

    def make():
        out = Dealer()

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined(have[MET])
            if len(have[MET]) > 1:
                by = ("id", "tag", "pos", "n")
                order = np.lexsort(tuple(x[k] for k in reversed(by)))
                x = {k: v[order] for k, v in x.items()}
                once = _changes(*(x[k] for k in by))
                x = {k: v[once] for k, v in x.items()}
            yield from out.add(x, id_buckets(x["id"], n), MET)

        return fn, out.flush

    return make


def _windows(window: int, n: int):
    """Both hashes of every window of the entries to verify."""

    def make():
        out = Dealer()

        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            look = have.get("look") or have.setdefault("look", Lookup([{k: v[b["n"] > 0] for k, v in b.items()} for b in have.get(MET, [])]))
            for part in X.slices(batch, "text"):
                lo, hi = look(part.column(0).to_numpy(), part.column(1).to_numpy())
                if not (hi > lo).any():
                    continue
                raw, starts, ends, at = _words(part.column(2))
                h = X.word_hashes(raw, starts, ends)
                k, doc = X.ranges(lo, hi)
                first = look.rows["pos"][k] + at[doc]
                p, which = X.ranges(first, first + look.rows["n"][k])
                doc = doc[which]
                w1 = X.Spans(h)(p, p + window)
                yield from out.add({
                    "w1": w1, "w2": X.Spans(h, 12345)(p, p + window), "id": part.column(0).to_numpy()[doc],
                    "tag": part.column(1).to_numpy()[doc].astype(np.uint16), "pos": p - at[doc],
                }, w1 % X.U64(n))

        return fn, out.flush

    return make


def _verified(window: int, n: int):
    def make():
        out = Dealer()

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined(have[0])
            order = np.argsort(x["w1"], kind="stable")
            size = np.diff(np.append(np.flatnonzero(_changes(x["w1"][order])), len(order)))
            order = order[np.repeat(size, size) > 1]
            if not len(order):
                return
            x = {k: v[order] for k, v in x.items()}
            order = np.lexsort((x["pos"], x["tag"], x["id"], x["w2"], x["w1"]))
            x = {k: v[order] for k, v in x.items()}
            once = _changes(x["w1"], x["w2"], x["id"], x["tag"], x["pos"])
            x = {k: v[once] for k, v in x.items()}
            group = np.cumsum(_changes(x["w1"], x["w2"])) - 1
            hit = (np.bincount(group) > 1)[group]
            yield from out.add({k: x[k][hit] for k in ("id", "tag", "pos")} | {"end": x["pos"][hit] + window}, id_buckets(x["id"][hit], n), HIT)

        return fn, out.flush

    return make


def _to_verify(have: dict[str, np.ndarray]) -> np.ndarray:
    return have["n"] > 0


class FingerprintIndex:
    """Sorted immutable runs of the windows of all documents added so far; ``runs`` are their tables in the shared folder."""

    def __init__(self, spark: SparkSession, window: int = 35, most_runs: int = 4):
        if window <= GRAM:
            raise ValueError(f"window: more than {GRAM} words")
        small_batches(spark)
        self.spark, self.window, self.most_runs = spark, window, most_runs
        self.n = partitions(spark)  # every task has something for every bucket, so there is one for each task
        self.runs: list[DataFrame] = []
        self.documents: DataFrame | None = None
        self.waiting: list[tuple[DataFrame, DataFrame]] = []  # of each batch that found() hasn't told of: what it met, and words that repeat for certain

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch as a new run. Returns packed words (see Lookup) of new and earlier documents in windows that the batch repeats or that repeat in it."""
        self.put(docs)
        return self.found()

    def put(self, docs: DataFrame) -> None:
        """Adds a batch as a new run; found() tells what it repeats."""
        if len(self.runs) > self.most_runs:
            self.compact()
        batch = keyed(docs)
        self.documents = batch if self.documents is None else self.documents.unionByName(batch)
        entries = batch.mapInArrow(_fingerprints(self.window, self.n), BLOB)
        run = written(by_bucket(entries, lambda: (_sorted_run, None), BLOB))
        hits = run.where(F.col("kind") == HIT)
        self.runs.append(run)
        newest = len(self.runs) - 1
        all_runs = None
        for age, run in enumerate(self.runs):
            run = run.where(F.col("kind") == ENTRY).withColumn("kind", F.lit(age))
            all_runs = run if all_runs is None else all_runs.unionByName(run)
        self.waiting.append((written(by_bucket(all_runs, _merge_join(newest, self.window), BLOB)), hits))

    def found(self) -> DataFrame:
        """Packed words of all documents in windows that a batch put since the last call repeats or that repeat in it.

        Every step here makes a packed row from each task for each bucket, so the batches take it together: their number doesn't multiply the rows.
        """
        if not self.waiting:
            raise ValueError("no batch was put")
        each, hits = None, None
        for own, certain in self.waiting:
            each, hits = (own, certain) if each is None else (each.unionByName(own), hits.unionByName(certain))
        met = written(by_bucket(each, _to_documents(self.n), BLOB))
        discard(*(own for own, _ in self.waiting))
        self.waiting = []
        windows = attach(only_met(self.documents, met, _to_verify), met, self.n, _windows(self.window, self.n), BLOB)
        verified = written(by_bucket(windows, _verified(self.window, self.n), BLOB))
        return met.unionByName(verified).unionByName(hits)

    def compact(self) -> None:
        """Merges all runs into one. Their tables stay, as what add() returned reads from them."""
        if len(self.runs) > 1:
            merged_ = None
            for run in self.runs:
                run = run.where(F.col("kind") == ENTRY)
                merged_ = run if merged_ is None else merged_.unionByName(run)
            self.runs = [written(by_bucket(merged_, lambda: (_sorted_run, None), BLOB))]


KEPT = "id long, tag int, kept string, n_words long, n_removed long, spans array<struct<start: long, end: long>>"


def keep_words(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """Each document's words outside the found ranges, joined by one space; spans: the maximal ranges of removed words."""
    if "look" not in have:
        certain = [{k: b[k][b["n"] == 0] for k in ("id", "tag", "pos", "end")} for b in have.get(MET, [])]
        have["look"] = Lookup([*have.get(HIT, []), *certain])
    look = have["look"]
    for part in X.slices(batch, "text"):
        raw, starts, ends, at = _words(part.column(2))
        n_docs = part.num_rows
        lo, hi = look(part.column(0).to_numpy(), part.column(1).to_numpy())
        gone = np.zeros(len(starts), bool)
        if (hi > lo).any():
            k, doc = X.ranges(lo, hi)
            gone = X.covered(len(starts), look.rows["pos"][k] + at[doc], look.rows["end"][k] + at[doc])
        doc_of = np.repeat(np.arange(n_docs), np.diff(at))
        keep = np.flatnonzero(~gone)
        last = np.ones(len(keep), bool)
        last[:-1] = doc_of[keep][1:] != doc_of[keep][:-1]
        size = ends[keep] - starts[keep] + ~last
        source, which = X.ranges(starts[keep], starts[keep] + size)
        out = np.append(raw, np.uint8(32))[source]
        out[(np.cumsum(size) - 1)[~last]] = 32
        total = np.zeros(n_docs + 1, np.int64)
        np.cumsum(np.bincount(doc_of[keep], weights=size, minlength=n_docs), out=total[1:])
        kept = pa.Array.from_buffers(pa.string(), n_docs, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(out)])
        removed = np.bincount(doc_of[gone], minlength=n_docs).astype(np.int64)
        first = gone & np.append(True, ~gone[:-1] | (doc_of[1:] != doc_of[:-1]))[: len(gone)]
        final = gone & np.append(~gone[1:] | (doc_of[1:] != doc_of[:-1]), True)[: len(gone)]
        s, e = np.flatnonzero(first), np.flatnonzero(final) + 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, at, "left"), pa.int32()), pa.StructArray.from_arrays([pa.array(s - at[doc_of[s]]), pa.array(e - at[doc_of[s]])], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), kept, pa.array(np.diff(at)), pa.array(removed), spans], names=["id", "tag", "kept", "n_words", "n_removed", "spans"])


def remove_repeats(docs: DataFrame, window: int = 35, batches: int = 3, most_runs: int = 1) -> DataFrame:
    """doc_id, kept, n_words, n_removed, spans: one row for each row of ``docs``, added to a new index in ``batches`` parts by doc_id's hash (rows without one by their text's)."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, most_runs)
    for b in range(batches):
        index.put(docs.where(F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))), F.lit(batches)) == b))
    found = index.found()
    collect_garbage(spark)
    out = attach(keyed(docs), found, index.n, lambda: (keep_words, None), KEPT)
    return out.select(doc_id(), "kept", "n_words", "n_removed", "spans")
