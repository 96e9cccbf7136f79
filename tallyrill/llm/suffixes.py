"""Substring deduplication by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Of all suffixes only those that start
at content-chosen anchors are sorted: every string of ``length`` bytes has one anchor, chosen by its bytes alone, so two
equal strings have theirs at the same place. In four passes:

1. Anchors meet by the hash of the GRAM bytes that they start with; an anchor that is alone there can't lie in a repeated
   string and goes no further. Of equal contexts (all windows that chose an anchor) in one task's share the earliest stands for
   all, so a hot passage comes once from each task; the others lie wholly in repeats.
2. The suffixes at the anchors that met are sorted in each task and leave it front-coded: each one as the length of the
   prefix it shares with the one before, and its tail.
3. Runs meet, and a loser tree merges them. Each contender knows the prefix that it shares with the last output, so
   known prefixes are never compared again. Suffixes that share GRAM bytes or more with their neighbours form a group. The
   prefixes that they share, which the merge has found, and the equal ends of their left contexts decide which windows of
   ``length`` bytes are equal; all but the earliest are repeats.
4. Repeats come to their documents, whose covered bytes are cut out.

Null texts are empty, empty and short texts are kept whole, and rows that repeat doc_id and text count as one document.
Earlier means a smaller doc_id (null first), then the same document's earlier start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .tables import BLOB, Dealer, Lookup, attach, blob_batch, by_bucket, collect_garbage, doc_id, id_buckets, joined, keyed, pack, partitions, small_batches, written

GRAM = 32
#: Most suffixes of one task's sorted runs.
RUN_ROWS = 100_000
#: Kinds of packed rows.
WHOLE, EDGE, ANCHOR, WINDOW = 0, 1, 2, 3
#: The most different contexts of a group that are held at once, and that are compared pair by pair.
MOST_GROUP, PAIRWISE = 4096, 24


def _anchored(length: int, n: int):
    """Anchors of all documents. Of equal contexts within a task's share only the earliest goes on; the others are repeats already, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Dealer(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = joined(held)
            held.clear()
            again = later_copies(x)
            if len(again):
                ids = x["id"][again]
                yield from out.add({"id": ids, "tag": x["tag"][again], "pos": x["pos"][again], "end": x["pos"][again] + x["n"][again] + length - 1}, id_buckets(ids, n), WHOLE)
                keep = np.ones(len(x["fp"]), bool)
                keep[again] = False
                x = {k: v[keep] for k, v in x.items()}
            yield from out.add(x, x["fp"] % X.U64(n), ANCHOR)

        for batch in batches:
            for part in X.slices(batch, "text"):
                raw, at = X.utf8(part.column(2))
                if len(raw) < length:
                    continue
                grams = X.byte_grams(raw, GRAM)
                a, first, last = X.anchors(grams, at, length, GRAM)
                context = X.Spans(X.mix(raw.astype(X.U64) + X.U64(77)))(first, last + length)
                doc = np.searchsorted(at, a, "right") - 1
                held.append({
                    "fp": grams[a], "sw": context, "id": part.column(0).to_numpy()[doc], "tag": part.column(1).to_numpy()[doc].astype(np.uint16),
                    "pos": (first - at[doc]).astype(np.int64), "n": (last - first + 1).astype(np.uint16), "off": (a - first).astype(np.uint16),
                })
                rows += len(a)
                if rows > out.most:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()
        yield from out.flush()

    return run


def copies(x: dict[str, np.ndarray], key: tuple[str, ...] = ("fp", "sw")) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose ``key`` others have, too, in order of it and of their places, and which of them are the first of theirs."""
    whole = X.mix(x[key[0]])
    for k in key[1:]:
        whole = whole ^ x[k]
    order = np.argsort(whole, kind="stable")
    size = np.diff(np.append(np.flatnonzero(_changes(whole[order])), len(order)))
    some = order[np.repeat(size, size) > 1]
    some = some[np.lexsort(tuple(x[k][some] for k in reversed((*key, "id", "tag", "pos"))))]
    return some, _changes(*(x[k][some] for k in key))


def later_copies(x: dict[str, np.ndarray]) -> np.ndarray:
    """The rows with an earlier row of the same fp and sw at another place."""
    some, new = copies(x)
    lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))] if len(some) else some
    own = (x["id"][some] == x["id"][lead]) & (x["tag"][some] == x["tag"][lead]) & (x["pos"][some] == x["pos"][lead])
    return some[~own]


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _met(n: int):
    """The anchors of one bucket whose gram starts at several places."""

    def make():
        out = Dealer()

        def fn(bucket: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if WHOLE in have:  # already where their documents will be
                yield from out.add(y := joined(have[WHOLE]), np.full(len(y["id"]), bucket), WHOLE)
            if ANCHOR not in have:
                return
            x = joined(have[ANCHOR])
            order = np.argsort(x["fp"], kind="stable")
            size = np.diff(np.append(np.flatnonzero(_changes(x["fp"][order])), len(order)))
            x = {k: v[order[np.repeat(size, size) > 1]] for k, v in x.items()}
            keep = {k: x[k] for k in ("id", "tag", "pos", "n", "off")}
            yield from out.add(keep | {"to": np.full(len(x["fp"]), bucket, np.int32)}, id_buckets(keep["id"], n), EDGE)

        return fn, out.flush

    return make


def shared(a: bytes, b: bytes, known: int) -> int:
    """The length of the longest common prefix, of which the first ``known`` bytes needn't be compared."""
    m = min(len(a), len(b))
    if m <= known:
        return m
    differ = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (differ.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of sorted strings: the prefix shared with the one before, all tails, and the tails' lengths."""
    prefix, tails, before = np.zeros(len(suffixes), np.uint16), [], b""
    for i, s in enumerate(suffixes):
        k = shared(before, s, 0)
        prefix[i] = k
        tails.append(s[k:])
        before = s
    return prefix, b"".join(tails), np.fromiter(map(len, tails), np.uint16, len(tails))


class Run:
    """A front-coded sorted run, decoded one string at a time. ``lcp``: what the head shares with the last output."""

    def __init__(self, prefix: np.ndarray, tails: bytes, sizes: np.ndarray):
        self.prefix, self.tails, self.sizes = prefix.tolist(), tails, sizes.tolist()
        self.i, self.at, self.head, self.lcp = -1, 0, b"", 0
        self.next()

    def next(self) -> None:
        self.i += 1
        if self.i == len(self.sizes):
            self.head = None
            return
        end = self.at + self.sizes[self.i]
        self.lcp = self.prefix[self.i]
        self.head = self.head[: self.lcp] + self.tails[self.at : end]
        self.at = end


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in the run, string, prefix shared with the string before) of all runs in order, by a loser tree."""
    k = len(runs)
    if not k:
        return
    size = 1 << (k - 1).bit_length()
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. What both share with the last output decides, unless it is equally long; only then bytes beyond it are compared."""
        x = runs[a] if 0 <= a < k else None
        y = runs[b] if 0 <= b < k else None
        if x is None or x.head is None:
            return b, a
        if y is None or y.head is None:
            return a, b
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        p, q = x.head, y.head
        h = shared(p, q, x.lcp)
        if h == len(p) and (h < len(q) or a < b) or h < len(p) and h < len(q) and p[h] < q[h]:
            y.lcp = h
            return a, b
        x.lcp = h
        return b, a

    for r in runs:
        r.lcp = 0
    winners = list(range(size))
    level = winners
    nodes = size
    while nodes > 1:
        nodes //= 2
        up = []
        for i in range(nodes):
            w, loser = play(level[2 * i], level[2 * i + 1])
            losers[nodes + i] = loser
            up.append(w)
        level = up
    best = level[0]
    while best < k and runs[best].head is not None:
        r = runs[best]
        yield best, r.i, r.head, r.lcp
        r.next()
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _sorted_runs(length: int, n: int):
    """The suffixes at the anchors of a task's documents, as front-coded sorted runs, one for each bucket that they go to."""

    def make():
        todo: dict[int, list[tuple]] = {}
        held = [0]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for to, entries in todo.items():
                entries.sort()
                prefix, tails, sizes = front_code([e[0] for e in entries])
                left = [e[1] for e in entries]
                rows.append((to, 0, pack({
                    "lcp": prefix, "tails": tails, "sizes": sizes, "left": b"".join(left), "lsizes": np.fromiter(map(len, left), np.uint16, len(left)),
                    "id": np.array([e[2] for e in entries], np.int64), "tag": np.array([e[3] for e in entries], np.uint16), "pos": np.array([e[4] for e in entries], np.int64),
                })))
                if len(rows) == 256:
                    yield blob_batch(rows)
                    rows = []
            if rows:
                yield blob_batch(rows)
            todo.clear()
            held[0] = 0

        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if EDGE not in have:
                return
            look = have.get("look") or have.setdefault("look", Lookup(have[EDGE]))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            seen = have.setdefault("seen", set())
            lo, hi = look(ids, tags)
            x = look.rows
            for d in np.flatnonzero(hi > lo):
                if (int(ids[d]), int(tags[d])) in seen:
                    continue
                seen.add((int(ids[d]), int(tags[d])))
                raw = batch.column(2)[int(d)].as_py().encode()
                for pos, m, off, to in zip(*(x[c][lo[d] : hi[d]].tolist() for c in ("pos", "n", "off", "to")), strict=True):
                    todo.setdefault(to, []).append((raw[pos + off : pos + m + length - 1], raw[pos : pos + off], int(ids[d]), int(tags[d]), pos))
                held[0] += int(hi[d] - lo[d])
            if held[0] > RUN_ROWS:
                yield from flush()

        return fn, flush

    return make


class Group:
    """Contexts around one gram, in the order of their suffixes, each with the prefix it shares with the one before.

    An entry is (suffix, left context, doc id, tag, place of its first window). A window holds the last l bytes of a left context
    and the first length - l of its suffix, so two entries share the window of l if their left contexts end in the same l bytes
    and their suffixes share length - l. The entry whose anchor comes first has the earlier window, for every l.
    """

    def __init__(self, length: int):
        self.length, self.entries, self.lcp = length, [], []
        self.own: dict[bytes, int] = {}
        self.out: list[tuple[int, int, int, int]] = []

    def add(self, entry: tuple[bytes, bytes, int, int, int], lcp: int) -> None:
        suffix, left = entry[:2]
        if self.entries and lcp == len(suffix) == len(self.entries[-1][0]):
            same = self.own.get(left)  # of this very suffix
            if same is not None:
                other = self.entries[same]
                if other[2:] == entry[2:]:
                    return  # a row that is there twice
                first, later = (other, entry) if other[2:] < entry[2:] else (entry, other)
                self.entries[same] = first
                self.out.append((*later[2:], later[4] + len(left) + len(suffix)))
                return
        else:
            self.own.clear()
        self.own[left] = len(self.entries)
        self.entries.append(entry)
        self.lcp.append(lcp)

    def close(self) -> list[tuple[int, int, int, int]]:
        """All repeats (id, tag, first byte, end), and an empty group again."""
        if len(self.entries) > PAIRWISE:
            self._by_blocks()
        elif len(self.entries) > 1:
            self._by_pairs()
        out, self.entries, self.lcp, self.own, self.out = self.out, [], [], {}, []
        return out

    def _later(self, a: tuple, b: tuple) -> tuple:
        return b if (a[2], a[3], a[4] + len(a[1])) < (b[2], b[3], b[4] + len(b[1])) else a

    def _repeat(self, entry: tuple, least: int, most: int) -> None:
        """The windows of ``least`` to ``most`` left bytes of an entry."""
        anchor = entry[4] + len(entry[1])
        self.out.append((entry[2], entry[3], anchor - most, anchor - least + self.length))

    def _by_pairs(self) -> None:
        for i, a in enumerate(self.entries):
            common = self.length
            for j in range(i + 1, len(self.entries)):
                common = min(common, self.lcp[j])
                if common < GRAM:
                    break
                b = self.entries[j]
                least = self.length - common
                if a[1][len(a[1]) - least :] != b[1][len(b[1]) - least :] or min(len(a[1]), len(b[1])) < least:
                    continue
                most = shared(a[1][::-1], b[1][::-1], least)
                self._repeat(self._later(a, b), least, most)

    def _by_blocks(self) -> None:
        for n in range(max(len(e[1]) for e in self.entries) + 1):
            need, block, first, own = self.length - n, 0, {}, []
            for e, lcp in zip(self.entries, self.lcp, strict=True):
                block += lcp < need
                if len(e[1]) >= n and len(e[0]) >= need:
                    key = (block, e[1][len(e[1]) - n :])
                    own.append((key, e))
                    first[key] = e if key not in first else e if self._later(first[key], e) is first[key] else first[key]
            for key, e in own:
                if first[key] is not e:
                    self._repeat(e, n, n)


def _merged(length: int, n: int):
    """Repeats among the merged suffixes. A group of more than MOST_GROUP different contexts is passed on window by window, so a task never holds more of one."""

    def make():
        dealer = Dealer()

        def passed_on(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [left + right for right, left, *_ in group]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            p, which = X.ranges(at[:-1], at[1:] - length + 1)
            symbols = X.mix(raw.astype(X.U64) + X.U64(77))
            w1 = X.Spans(symbols)(p, p + length)
            ids, tags, pos = (np.array([g[k] for g in group]) for k in (2, 3, 4))
            yield from dealer.add({"w1": w1, "w2": X.Spans(symbols, 12345)(p, p + length), "id": ids[which].astype(np.int64), "tag": tags[which].astype(np.uint16), "pos": pos[which] + p - at[which]}, w1 % X.U64(n), WINDOW)

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            blobs = have[0]
            runs = [Run(b["lcp"], b["tails"], b["sizes"]) for b in blobs]
            lefts = [np.concatenate([[0], np.cumsum(b["lsizes"], dtype=np.int64)]).tolist() for b in blobs]
            places = [list(zip(b["id"].tolist(), b["tag"].tolist(), b["pos"].tolist(), strict=True)) for b in blobs]
            out: list[tuple[int, int, int, int]] = []
            group, large = Group(length), False

            def closed() -> Iterator[pa.RecordBatch]:
                if large:
                    yield from passed_on(group.entries)
                    group.entries = group.entries[:0]
                out.extend(group.close())

            for r, i, suffix, lcp in merge(runs):
                if lcp < GRAM:
                    yield from closed()
                    large = False
                elif len(group.entries) == MOST_GROUP:
                    large = True
                    yield from closed()
                group.add((suffix, blobs[r]["left"][lefts[r][i] : lefts[r][i + 1]], *places[r][i]), lcp)
                if len(out) > 200_000:
                    yield from dealt_out(out)
            yield from closed()
            yield from dealt_out(out)

        def dealt_out(out: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
            if out:
                i, tag, pos, end = zip(*out, strict=True)
                out.clear()
                ids = np.array(i, np.int64)
                yield from dealer.add({"id": ids, "tag": np.array(tag, np.uint16), "pos": np.array(pos, np.int64), "end": np.array(end, np.int64)}, id_buckets(ids, n), WHOLE)

        return fn, dealer.flush

    return make


def _earliest(length: int, n: int):
    """Of equal windows that were passed on, all but the earliest."""

    def make():
        dealer = Dealer()

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined(have[WINDOW])
            again = later_copies({"fp": x["w1"], "sw": x["w2"]} | {k: x[k] for k in ("id", "tag", "pos")})
            ids, pos = x["id"][again], x["pos"][again]
            yield from dealer.add({"id": ids, "tag": x["tag"][again], "pos": pos, "end": pos + length}, id_buckets(ids, n), WHOLE)

        return fn, dealer.flush

    return make


KEPT = "kept binary, n_bytes long, spans array<struct<start: long, end: long>>"


def cut_out(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """Each document's bytes outside the spans found in it, and the maximal spans."""
    look = have.get("look") or have.setdefault("look", Lookup(have.get(WHOLE, [])))
    for part in X.slices(batch, "text"):
        raw, at = X.utf8(part.column(2))
        lo, hi = look(part.column(0).to_numpy(), part.column(1).to_numpy())
        gone = np.zeros(len(raw), bool)
        if (hi > lo).any():
            k, doc = X.ranges(lo, hi)
            # a part's texts lie one after the other
            gone = X.covered(len(raw), look.rows["pos"][k] + at[doc], np.minimum(look.rows["end"][k] + at[doc], at[doc + 1]))
        kept = raw[~gone]
        new = np.concatenate([[0], np.cumsum(~gone)])[at]
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        inner = np.flatnonzero(cut[1:-1] & gone[1:] & gone[:-1]) + 1 if len(raw) > 1 else np.empty(0, np.int64)
        starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
        ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
        doc = np.searchsorted(at, starts, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(starts, at, "left"), pa.int32()),
            pa.StructArray.from_arrays([pa.array(starts - at[doc]), pa.array(ends - at[doc])], ["start", "end"]),
        )
        binary = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(new.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
        with_it = [n for n in part.schema.names if n not in ("tag", "text")]
        yield pa.RecordBatch.from_arrays([binary, pa.array(np.diff(at)), spans, *(part.column(n) for n in with_it)], names=["kept", "n_bytes", "spans", *with_it])


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Packed repeats of all documents (see Lookup), each a run of bytes that strings of ``length`` bytes that start earlier cover."""
    if length < 2 * GRAM:
        raise ValueError(f"length: at least {2 * GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)  # every task has something for every bucket, so there is one for each task
    found = written(by_bucket(keyed(docs).mapInArrow(_anchored(length, n), BLOB), _met(n), BLOB))
    met = found.where(F.col("kind") == EDGE)
    runs = attach(keyed(docs), met, n, _sorted_runs(length, n), BLOB)
    edges = written(by_bucket(runs, _merged(length, n), BLOB))
    large = written(by_bucket(edges.where(F.col("kind") == WINDOW), _earliest(length, n), BLOB))
    return found.unionByName(edges).unionByName(large).where(F.col("kind") == WHOLE)


def dedup_substrings(docs: DataFrame, length: int = 100, with_it: str | None = None) -> DataFrame:
    """doc_id, kept (binary), n_bytes, spans: one row for each row of ``docs``. ``with_it``: a column of ``docs`` to return, too."""
    found = repeats(docs, length)
    collect_garbage(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = keyed(docs, *([docs[with_it].alias("with_it")] if with_it else []))
    schema = T.StructType([*T._parse_datatype_string(KEPT).fields, *(f for f in rows.schema.fields if f.name not in ("tag", "text"))])
    return attach(rows, found, n, lambda: (cut_out, None), schema).select(doc_id(), "kept", "n_bytes", "spans", *([F.col("with_it").alias(with_it)] if with_it else []))


def whole_characters(column: str) -> Column:
    """UTF-8 bytes as text, without the bytes of characters that a cut has parted."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode("utf-8", "ignore"))

    return decoded(column)
