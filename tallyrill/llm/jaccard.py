"""An exact Jaccard join of documents' shingle sets, as a join in a metric space.

The Jaccard distance is a metric, but sets that have nothing in common are all at distance 1, where no pivot can tell them
apart. So regions are seeded by what close sets must share: a set's shingles are dealt by hash into m buckets, where m
depends on the class of the set's size, and sets whose symmetric difference is D < m at most agree on m - D buckets at
least. A set's keys are the contents of its largest buckets, as many as make sure that one of the agreeing ones is among
them. Of the sets with a key in common the one with the smallest doc_id is their pivot, and the pivot's region has every
set that shares a key with it; so a set near a boundary is replicated to the regions of all its pivots, and every pair
that links meets in one region.

Before sets are sent to regions, their profiles are: counts of shingles in 64 parts. Profiles differ by no more than the sets
do, so a region of many members is cut into Voronoi cells of pivots by its profiles' distances, again and again: a member goes
to its nearest pivot's cell and to each whose pivot is farther by twice its radius at most, the most that it can differ from a
set that it links with. Members whose profiles are too far from all others' can't link and aren't sent.

Regions are joined recursively and exactly: distances to a few pivots give links and, where these leave more than one
component, Voronoi regions; a member goes to every region whose pivot is as near as its nearest one plus twice the
radius (two members within the radius share a region, by the triangle inequality); small or unsplittable regions compare
all pairs. What leaves a region is a spanning forest of its links, not its pairs. Documents with equal sets are one class
throughout. Links are decided in integers; shingles are told apart by 64-bit hashes.

A document of fewer words than a shingle has its whole sequence as one shingle; one without words (or text) links with
nothing. Rows are told apart by doc_id and 16 bits of their text's hash. In join() rows that share a doc_id are one node, so
all their links are its own; representatives() takes them for documents of their own. A null doc_id sorts first and shows as null.

A task holds the profiles (128 bytes each) of all that share a key with one pivot, copies counted once, but the sets of
MOST_MEMBERS at most: cells that no pivots can cut further are split into one region for each pair of their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import connected_components
from .suffixes import _changes
from .tables import BLOB, BUCKETS_A_PARTITION, NULL_ID, Dealer, Lookup, attach, blob_batch, by_bucket, discard, id_buckets, joined, keyed, pack, partitions, small_batches, with_facts, written

RATIO = 1.2
EDGES = "a struct<id:long,tag:int>, b struct<id:long,tag:int>"
PIVOTS, ALL_PAIRS = 8, 384
#: Parts of a profile, and the most sets of one region that meet in a task.
PARTS, MOST_MEMBERS = 64, 4096
#: Kinds of packed rows.
MEMBER, PROFILE = 0, 1


def _words(column: pa.Array):
    raw, at = X.utf8(column)
    starts, ends, word_at = X.word_bounds(raw, at, X.NOT_SPACE)
    return X.word_hashes(X.LOWER[raw], starts, ends), word_at


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, in order, and the n + 1 offsets of each text's."""
    h, at = _words(column)
    n = np.diff(at)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first, doc = X.ranges(at[:-1], at[:-1] + size)
    s = X.Spans(h)(first, np.minimum(first + k, at[doc + 1]))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = _changes(s, doc)
    return s[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


def set_hash(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(s) + 1, X.U64)
    np.cumsum(X.mix(s), out=sums[1:])
    return X.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(X.U64) * X.U64(0x9E3779B97F4A7C15))


class Classes:
    """Classes of set sizes: class c holds sizes from low[c] to low[c + 1] - 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def upto(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * RATIO)))

    def differ(self, c: int) -> int:
        """The largest symmetric difference of two linked sets of at most the class's largest size."""
        return 2 * (self.low[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def buckets(self, c: int) -> int:
        d = self.differ(c)
        return d + 1 + math.ceil(0.3 * d)


def keys(s: np.ndarray, at: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """All keys and the document of each."""
    n = np.diff(at)
    top = int(n.max(initial=0)) * classes.den // classes.num + 1
    classes.upto(top * 2)
    low = np.array(classes.low)
    out_key, out_doc = [], []
    # a set counts in its own class and in those of larger sets that it can link with
    own = np.searchsorted(low, n, "right") - 1
    last = np.searchsorted(low, n * classes.den // classes.num, "right") - 1
    for step in range(int((last - own)[n > 0].max(initial=-1)) + 1):
        docs = np.flatnonzero((n > 0) & (own + step <= last))
        c = own[docs] + step
        m = np.array([classes.buckets(x) for x in range(int(c.max()) + 1)])[c]
        d = np.array([classes.differ(x) for x in range(int(c.max()) + 1)])[c]
        base = np.cumsum(m) - m
        i, which = X.ranges(at[docs], at[docs + 1])
        flat = base[which] + (X.mix(s[i] ^ X.U64(0x5851F42D4C957F2D)) % m[which].astype(X.U64)).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        total = int(m.sum())
        count = np.bincount(flat, minlength=total)
        sums = np.zeros(len(flat) + 1, X.U64)
        np.cumsum(X.mix(s[i[order]]), out=sums[1:])
        edge = np.concatenate([[0], np.cumsum(count)])
        content = sums[edge[1:]] - sums[edge[:-1]]
        doc_of = np.repeat(np.arange(len(docs)), m)
        # the d + 1 largest buckets and all that are as large as the least of them
        rank = np.lexsort((-count, doc_of))
        least = count[rank[base + d]]
        keep = np.flatnonzero(count >= least[doc_of])
        place = keep - base[doc_of[keep]]
        out_key.append(X.mix(content[keep] ^ X.mix((c[doc_of[keep]] * (1 << 32) + place).astype(X.U64) + X.U64(0xA0761D6478BD642F))))
        out_doc.append(docs[doc_of[keep]])
    if not out_key:
        return np.empty(0, X.U64), np.empty(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_doc)


def profiles(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of a set's shingles are in each of PARTS parts; two sets differ in as many shingles at least as their profiles do in all."""
    n = len(at) - 1
    part = (X.mix(s ^ X.U64(0x2545F4914F6CDD1D)) >> X.U64(58)).astype(np.int64)
    flat = np.bincount(np.repeat(np.arange(n), np.diff(at)) * PARTS + part, minlength=n * PARTS)
    return np.minimum(flat, 30_000).astype(np.int16).reshape(n, PARTS)


def _keyed_sets(k: int, num: int, den: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, classes = Dealer(), Classes(num, den)
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for part in X.slices(batch, "text"):
                s, at = shingles(part.column(2), k)
                c, ids, tags = set_hash(s, at), part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.uint16)
                size = np.diff(at)
                # copies that this task has seen at a smaller place add nothing
                fresh = np.zeros(len(c), bool)
                for i, one, *place in zip(range(len(c)), c.tolist(), ids.tolist(), tags.tolist(), strict=True):
                    if size[i] and seen.get(one, (1 << 63, 0)) > (place := tuple(place)):
                        seen[one] = place
                        fresh[i] = True
                if len(seen) > 2_000_000:
                    seen.clear()
                chosen = np.flatnonzero(fresh)
                take, _ = X.ranges(at[chosen], at[chosen + 1])
                bounds = np.concatenate([[0], np.cumsum(size[chosen])])
                yield from out.add({"c": c[chosen], "id": ids[chosen], "tag": tags[chosen], "n": size[chosen].astype(np.int32), "h": profiles(s[take], bounds)}, id_buckets(ids[chosen], n), PROFILE)
                key, doc = keys(s[take], bounds, classes)
                doc = chosen[doc]
                yield from out.add({"key": key, "c": c[doc], "id": ids[doc], "tag": tags[doc]}, key % X.U64(n))
        yield from out.flush()

    return run


def _regions(n: int):
    """Of the sets that share a key: which pivots' regions each belongs to."""

    def make():
        out = Dealer()

        def fn(bucket: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if PROFILE in have:  # these go on to where the regions' members are dealt
                p = joined(have[PROFILE])
                p["h"] = p["h"].reshape(-1, PARTS)
                yield from out.add(p, np.full(len(p["c"]), bucket), PROFILE)
            if MEMBER not in have:
                return
            x = joined(have[MEMBER])
            order = np.argsort(x["key"], kind="stable")
            size = np.diff(np.append(np.flatnonzero(_changes(x["key"][order])), len(order)))
            x = {k: v[order[np.repeat(size, size) > 1]] for k, v in x.items()}
            order = np.lexsort((x["tag"], x["id"], x["c"], x["key"]))
            once = order[_changes(x["key"][order], x["c"][order])]
            x = {k: v[once] for k, v in x.items()}  # a class once a key, by its smallest row
            if not len(x["key"]):
                return
            group = np.cumsum(_changes(x["key"])) - 1
            first = np.lexsort((x["tag"], x["id"], group))
            first = first[np.searchsorted(group[first], np.arange(group[-1] + 1))]
            keep = (np.bincount(group) > 1)[group]
            pivot, pivot_class = x["id"][first][group], x["c"][first][group]
            x = {k: v[keep] for k, v in x.items()} | {"p": pivot[keep], "pc": pivot_class[keep]}
            order = np.lexsort((x["pc"], x["c"]))
            once = order[_changes(x["c"][order], x["pc"][order])]
            ids = x["id"][once]
            yield from out.add({"id": ids, "tag": x["tag"][once], "pc": x["pc"][once], "c": x["c"][once]}, id_buckets(ids, n), MEMBER)

        return fn, out.flush

    return make


def _profiled(n: int):
    """Each member's profile, dealt by region."""

    def make():
        out = Dealer()

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if MEMBER not in have:
                return
            p, x = joined(have[PROFILE]), joined(have[MEMBER])
            h = p["h"].reshape(-1, PARTS)
            order = np.argsort(p["c"], kind="stable")
            at = np.searchsorted(p["c"][order], x["c"])  # rows of a class have one profile
            own = order[at]
            once = np.lexsort((x["pc"], x["c"], x["tag"], x["id"]))
            once = once[_changes(x["pc"][once], x["c"][once], x["tag"][once], x["id"][once])]
            yield from out.add({"p": x["pc"][once], "c": x["c"][once], "id": x["id"][once], "tag": x["tag"][once], "n": p["n"][own[once]], "h": h[own[once]]}, x["pc"][once] % X.U64(n))

        return fn, out.flush

    return make


def near(h: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets can link with another one, as far as profiles tell."""
    out = np.zeros(len(h), bool)
    step = max(1, (1 << 17) // max(len(h), 1))
    for i in range(0, len(h), step):
        differ = np.abs(h[i : i + step, None, :] - h[None, :, :]).sum(2, dtype=np.int64)
        total = size[i : i + step, None] + size[None, :]
        both = (total - differ) // 2
        ok = den * both >= num * (total - both)
        ok[np.arange(ok.shape[0]), np.arange(i, i + ok.shape[0])] = False
        out[i : i + step] |= ok.any(1)
    return out


def split(rows: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of a large region in a region for each pair of blocks, so that any two still meet and no task holds the sets of all."""
    n = -(-2 * len(rows) // MOST_MEMBERS)
    block = np.arange(len(rows)) % n
    some, name = [], []
    for i in range(n):
        for j in range(i if n == 1 else i + 1, n):
            own = np.flatnonzero((block == i) | (block == j))
            some.append(rows[own])
            name.append(X.mix(region[own] ^ X.mix(np.full(len(own), i * n + j + 1, X.U64))))
    return np.concatenate(some), np.concatenate(name)


def cells(rows: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Voronoi cells of the rows by profiles, with the members near their borders, such that two rows that link share a cell; and whether it has MOST_MEMBERS at most.

    ``h``, ``size``: of all rows. A set of n shingles differs from one that it links with by n * (den - num) / num at most.
    """
    if len(rows) <= MOST_MEMBERS:
        yield rows, True
        return
    own = h[rows]
    pivot, distance = 0, []
    for _ in range(PIVOTS):
        distance.append(np.abs(own - own[pivot]).sum(1, dtype=np.int64))
        pivot = int(np.min(distance, axis=0).argmax())  # the farthest from all pivots so far
    d = np.array(distance)
    reach = d.min(0) + 2 * (size[rows] * (den - num) // num)
    parts = [rows[x <= reach] for x in d]
    if max(map(len, parts)) > 0.8 * len(rows):
        yield rows, False
        return
    for part in parts:
        if len(part) > 1:
            yield from cells(part, h, size, num, den)


def _pruned(num: int, den: int, n: int):
    """The members of regions that can link with another member."""

    def make():
        out = Dealer()

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined(have[0])
            h, size = x.pop("h").reshape(-1, PARTS), x["n"].astype(np.int64)
            order = np.lexsort((x["id"], x["c"], x["p"]))
            order = order[_changes(x["p"][order], x["c"][order])]
            for rows in np.split(order, np.flatnonzero(np.diff(x["p"][order])) + 1):
                if len(rows) < 2:
                    continue
                for i, (cell, small) in enumerate(cells(rows, h, size, num, den)):
                    region = X.mix(x["p"][cell] ^ X.mix(np.full(len(cell), i, X.U64)))
                    if small:
                        ok = near(h[cell], size[cell], num, den)
                        cell, region = cell[ok], region[ok]
                    else:
                        cell, region = split(cell, region)
                    yield from out.add({"id": x["id"][cell], "tag": x["tag"][cell], "pc": region, "c": x["c"][cell]}, id_buckets(x["id"][cell], n), MEMBER)

        return fn, out.flush

    return make


def _replicated(k: int, n: int):
    """The sets of all regions' members."""

    def make():
        todo: dict[int, list[tuple]] = {}
        held = [0]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for bucket, own in todo.items():
                p, c, ids, tags, sets = zip(*own, strict=True)
                rows.append((bucket, 0, pack({"p": np.array(p, X.U64), "c": np.array(c, X.U64), "id": np.array(ids, np.int64), "tag": np.array(tags, np.uint16), "n": np.array([len(s) for s in sets], np.int64), "s": np.concatenate(sets)})))
                if len(rows) == 256:
                    yield blob_batch(rows)
                    rows = []
            if rows:
                yield blob_batch(rows)
            todo.clear()
            held[0] = 0

        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if 0 not in have:
                return
            if "look" not in have:
                have["look"], have["done"] = Lookup(have[0]), set()
            look, done = have["look"], have["done"]
            for part in X.slices(batch, "text"):
                ids, tags = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.uint16)
                lo, hi = look(ids, tags)
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                s, at = shingles(part.column(2).take(pa.array(some)), k)
                own = set_hash(s, at)
                for j, d in enumerate(some.tolist()):
                    regions = look.rows["pc"][lo[d] : hi[d]][look.rows["c"][lo[d] : hi[d]] == own[j]]
                    if own[j] in done or not len(regions):
                        continue
                    done.add(own[j])
                    one = s[at[j] : at[j + 1]]
                    for p in np.unique(regions).tolist():
                        todo.setdefault(p % n, []).append((p, own[j], int(ids[d]), int(tags[d]), one))
                        held[0] += len(one)
                if held[0] > 2_000_000:
                    yield from flush()

        return fn, flush

    return make


class Forest:
    def __init__(self, n: int):
        self.up, self.edges, self.parts = list(range(n)), [], n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))
            self.parts -= 1


class Region:
    """Sets, and the exact links among them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets], np.int64)
        self.forest = Forest(len(sets))

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def meet(self, i: int, others: np.ndarray) -> np.ndarray:
        """The sizes of set i's intersections with others."""
        size = self.size[others]
        every = np.concatenate([self.sets[j] for j in others])
        own = self.sets[i]
        hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)

    def pairs(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All links among the sets a, or between a and b."""
        rows = a if b is None else np.concatenate([a, b])
        every = np.concatenate([self.sets[j] for j in rows])
        owner = np.repeat(np.arange(len(rows)), self.size[rows])
        order = np.argsort(every, kind="stable")
        new = _changes(every[order])
        number = np.cumsum(new) - 1
        count = np.bincount(number)
        common = np.flatnonzero((count > 1)[number])  # a shingle of one set is in no intersection
        column = np.cumsum(np.concatenate([[0], np.diff(number[common]) != 0])) if len(common) else common
        owner = owner[order[common]]
        width = int(column[-1]) + 1 if len(common) else 0
        both = np.zeros((len(a), len(rows) if b is None else len(b)), np.float64)
        for at in range(0, width, 2048):
            i, j = np.searchsorted(column, (at, at + 2048))
            m = np.zeros((len(rows), min(2048, width - at)), np.float32)
            m[owner[i:j], column[i:j] - at] = 1
            both += m[: len(a)] @ (m if b is None else m[len(a) :]).T
        right = a if b is None else b
        hit = self.linked(both, self.size[a][:, None], self.size[right][None, :])
        for i, j in zip(*np.nonzero(np.triu(hit, 1) if b is None else hit), strict=True):
            self.forest.link(int(a[i]), int(right[j]))

    def join(self, rows: np.ndarray) -> None:
        if len(rows) < 2:
            return
        if len(rows) == 2:
            if self.linked(self.meet(int(rows[0]), rows[1:]), self.size[rows[0]], self.size[rows[1:]])[0]:
                self.forest.link(int(rows[0]), int(rows[1]))
            return
        if len(rows) <= 48:
            self.pairs(rows)
            return
        pivots, distance = [], []
        for _ in range(PIVOTS):
            roots = np.array([self.forest.find(int(i)) for i in rows])
            values, count = np.unique(roots, return_counts=True)
            if len(values) == 1:
                return  # links to pivots connect them all: no other link could add anything
            left = roots != values[count.argmax()]
            far = np.min(distance, axis=0) if distance else np.ones(len(rows))
            p = int(rows[np.argmax(np.where(left & ~np.isin(rows, pivots), far, -1))])
            both = self.meet(p, rows)
            union = self.size[p] + self.size[rows] - both
            for j in rows[self.linked(both, self.size[p], self.size[rows])]:
                self.forest.link(p, int(j))
            pivots.append(p)
            distance.append(1 - both / union)
        d = np.array(distance)
        near, radius = d.min(0), 1 - self.num / self.den
        parts = [rows[x <= near + 2 * radius + 1e-9] for x in d]
        if max(map(len, parts)) <= 0.8 * len(rows):
            for part in parts:
                self.join(part)
            return
        blocks = [rows[i : i + ALL_PAIRS] for i in range(0, len(rows), ALL_PAIRS)]
        for i, a in enumerate(blocks):
            self.pairs(a)
            for b in blocks[i + 1 :]:
                self.pairs(a, b)


def _joined(num: int, den: int):
    def make():
        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            x = joined(have[0], "p", "c", "id", "tag", "n")
            sets = [s for b in have[0] for s in np.split(b["s"], np.cumsum(b["n"])[:-1])]  # views of the blobs
            order = np.lexsort((x["tag"], x["id"], x["c"], x["p"]))
            order = order[_changes(x["p"][order], x["c"][order])]
            ends: list[np.ndarray] = []
            for rows in np.split(order, np.flatnonzero(np.diff(x["p"][order])) + 1):
                if len(rows) < 2:
                    continue
                rows = rows[np.lexsort((x["tag"][rows], x["id"][rows]))]
                region = Region([sets[i] for i in rows], num, den)
                region.join(np.arange(len(rows)))
                if region.forest.edges:
                    ends.append(rows[np.array(region.forest.edges)])
            if ends:
                rows = np.concatenate(ends)
                places = [pa.StructArray.from_arrays([pa.array(x["id"][own]), pa.array(x["tag"][own].astype(np.int32))], ["id", "tag"]) for own in rows.T]
                yield pa.RecordBatch.from_arrays(places, names=["a", "b"])

        return fn, None

    return make


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                s, at = shingles(part.column(2), k)
                size = np.diff(at)
                none = size == 0
                c = [pa.array(set_hash(own, at).view(np.int64), mask=none) for own in (s, X.mix(s ^ X.U64(0x94D049BB133111EB)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *c, pa.array(size)], names=["id", "tag", "class", "class2", "n_shingles"])

    return run


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, unite: bool = True) -> DataFrame:
    """id, tag, n_shingles, component (id and tag): one row for each row of ``docs``; sets link if den * |intersection| >= num * |union|.

    Component: the smallest row reachable. ``unite``: rows that share an id are one node.
    """
    if not 0 < num < den:
        raise ValueError("num: between 0 and den")
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark) * BUCKETS_A_PARTITION
    seeds = written(by_bucket(keyed(docs).mapInArrow(_keyed_sets(k, num, den, n), BLOB), _regions(n), BLOB))
    members = written(by_bucket(by_bucket(seeds, _profiled(n), BLOB), _pruned(num, den, n), BLOB))
    discard(seeds)
    edges = written(by_bucket(attach(keyed(docs), members, n, _replicated(k, n), BLOB), _joined(num, den), EDGES))
    discard(members)
    rows = written(keyed(docs).mapInArrow(_sets(k), "id long, tag int, class long, class2 long, n_shingles long"))
    sets, place = rows.where("class is not null"), F.struct("id", "tag")
    classes = sets.groupBy("class", "class2").agg(F.min(place).alias("node"), F.count(F.lit(1)).alias("rows"))
    if unite:
        twice = sets.groupBy("id").agg(F.min(F.struct("class", "class2")).alias("a"), F.max(F.struct("class", "class2")).alias("b")).where("a <> b").select("id")
        nodes = sets.join(twice, "id").select("id", "class", "class2").distinct().join(classes, ["class", "class2"]).select("id", "node")
        edges = edges.unionByName(nodes.join(nodes.groupBy("id").agg(F.min("node").alias("least")), "id").select(F.col("node").alias("a"), F.col("least").alias("b")))
    found = connected_components(edges)
    classes = classes.join(found, "node", "left").select("class", "class2", "rows", F.coalesce("component", "node").alias("component"))
    with_class = with_facts(sets, written(classes), ["class", "class2"], sets.count()).select("id", "tag", "n_shingles", "component")
    empty = rows.where("class is null").select("id", "tag", "n_shingles", place.alias("component"))
    if unite:
        other = with_class.join(empty.select("id").distinct(), "id").groupBy("id").agg(F.min("component").alias("other"))
        first = rows.where("class is null").groupBy("id").agg(F.min(place).alias("first"))
        empty = empty.join(first.join(other, "id", "left"), "id").select("id", "tag", "n_shingles", F.coalesce("other", "first").alias("component"))
    return with_class.unionByName(empty)


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    null = lambda c: F.when(F.col(c) > NULL_ID, F.col(c))
    return components(docs, k, num, den).select(null("id").alias("doc_id"), "n_shingles", null("component.id").alias("component_id"))


def _losing(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealer()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield from out.add({"id": ids, "tag": batch.column(1).to_numpy().astype(np.uint16)}, id_buckets(ids, n))
        yield from out.flush()

    return run


def _staying(columns: list[str]):
    def make():
        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            look = have.get("look") or have.setdefault("look", Lookup(have.get(0, [])))
            seen = have.setdefault("seen", set())
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint16)
            lo, hi = look(ids, tags)
            stay = []
            for i in np.flatnonzero(hi == lo).tolist():
                place = (int(ids[i]), int(tags[i]))
                if place not in seen:
                    seen.add(place)
                    stay.append(i)
            row = batch.column(batch.num_columns - 1).take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays(row.flatten() if columns else [], names=columns)

        return fn, None

    return make


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when of each component only the smallest does, whole: of rows that repeat doc_id and text one; rows without words stay.

    The rows that leave are listed (doc_id and tag) and brought to the rows, so texts move once.
    """
    found = components(docs, k, num, den, unite=False)
    n = partitions(docs.sparkSession) * BUCKETS_A_PARTITION
    losing = written(found.where(F.struct("id", "tag") != F.col("component")).select("id", "tag").mapInArrow(_losing(n), BLOB))
    rows = keyed(docs, F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")).select("id", "tag", "row")
    return attach(rows, losing, n, _staying(docs.columns), docs.schema)
