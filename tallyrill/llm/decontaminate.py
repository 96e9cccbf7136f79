"""Benchmark decontamination by one Aho-Corasick automaton over all windows of the test items.

Texts are normalised (A-Z lower-cased, words parted by one space) and scanned once; what the automaton finds is mapped
back to words and to character offsets of the original text. Only the benchmark's windows go to the executors. An automaton
takes some 40 bytes for each byte of its windows, and a window repeats its item's words ``size`` times, so the bound
(``most_bytes``) is on the windows: a benchmark of more is dealt by items to as many automata as it needs, each with a pass
of its own over the texts, and what they find is put together. An item is never parted.

Null and empty texts have no words; an item without words has no window; items without an id mark words but aren't listed.
Item ids are strings, as they are cast to; rows that repeat an item_id are one item with the windows of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .tables import doc_id, keyed, small_batches, written

_TABLE = bytes(int(X.LOWER[b]) if X.ALNUM[b] else 32 for b in range(256))
HITS = "id long, row_tag long, n_words long, items array<string>, ranges array<struct<first: long, stop: long, start: long, end: long>>"
FOUND = "id long, row_tag long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_RANGES = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "stop", "start", "end")]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def line(words: list[bytes]) -> str:
    """A space before, between and after the words; a character for each byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(items: list[tuple[str | None, str | None]], size: int) -> dict[str, list[str]]:
    """Every window of the items, each space before, between and after its words, and the items that have it."""
    out: dict[str, set[str]] = {}
    for item, text in items:
        words = normalised(text or "")
        for i in range(max(1, len(words) - size + 1) if words else 0):
            own = out.setdefault(line(words[i : i + size]), set())
            if item is not None:
                own.add(item)
    return {k: sorted(v) for k, v in out.items()}


#: The automaton that this worker built last, by its windows' name.
_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(name: str, patterns: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    if name not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for key, items in patterns.items():
            a.add_word(key, (key.count(" ") - 1, items))
        a.make_automaton()
        _BUILT[name] = a if patterns else None
    return _BUILT[name]


def scanned(automaton: ahocorasick.Automaton | None, text: str) -> tuple[int, list[str], list[dict]]:
    """The number of words, the items found, and the maximal ranges of words (and characters) that their windows cover."""
    words = normalised(text)
    if automaton is None or not words:
        return len(words), [], []
    whole = line(words)
    hits = list(automaton.iter(whole))
    if not hits:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(whole.encode("latin-1"), np.uint8) == 32)
    stop = np.searchsorted(spaces, [end for end, _ in hits])
    gone = X.covered(len(words), stop - np.array([size for _, (size, _) in hits]), stop)
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = X.word_bounds(raw, np.array([0, len(raw)]), X.ALNUM)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ranges = [{"first": int(i), "stop": int(j), "start": int(chars[starts[i]]), "end": int(chars[ends[j - 1]])} for i, j in zip(first, stop, strict=True)]
    return len(words), sorted({i for _, (_, ids) in hits for i in ids}), ranges


def united(ranges: list[dict]) -> tuple[int, list[dict]]:
    """The number of words that ranges cover, and the maximal spans of characters."""
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: (r["first"], r["stop"])):
        if out and r["first"] <= out[-1]["stop"]:
            if r["stop"] > out[-1]["stop"]:
                out[-1] |= {"stop": r["stop"], "end": r["end"]}
        else:
            out.append(dict(r))
    return sum(r["stop"] - r["first"] for r in out), [{"start": r["start"], "end": r["end"]} for r in out]


def _scan(patterns: dict[str, list[str]], all_rows: bool, last: bool = True):
    """The hits of one automaton, of all rows or only of those that have any; with their spans, if it is the last one."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, patterns)
        for batch in batches:
            rows = [scanned(automaton, value.as_py() or "") for value in batch.column(2)]
            own = [i for i, r in enumerate(rows) if all_rows or r[2]]
            n, items, ranges = ([rows[i][k] for i in own] for k in range(3))
            keys = [c.take(pa.array(own, pa.int64())) for c in batch.columns[:2]]
            out = pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, _RANGES)], names=["id", "row_tag", "n_words", "items", "ranges"])
            yield from _unite([out]) if last else [out]

    return run


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [united(r or []) for r in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([n for n, _ in found], pa.int64()), batch.column(3), pa.array([s for _, s in found], _SPANS)], names=["id", "row_tag", "n_words", "n_hit", "items", "spans"])


def parts(benchmark: DataFrame, size: int, most_bytes: int) -> tuple[int, Iterator[dict[str, list[str]]]]:
    """The benchmark's windows, dealt by items into parts that are expected to have ``most_bytes`` at most, one part at a time, and the number of parts; there is always one."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    total = items.agg(F.sum((F.octet_length("text") + 1).cast("long") * size)).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    return n, (windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).collect()], size) for p in range(n))


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, row_tag (hash of the text), n_words, n_hit, items (sorted ids), spans (characters of the original): one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = keyed(docs).select("id", F.xxhash64("text").alias("row_tag"), "text")
    shown = [doc_id(), "row_tag", "n_words", "n_hit", "items", "spans"]
    n, every = parts(benchmark, size, most_bytes)
    if n == 1:
        return rows.mapInArrow(_scan(next(every), True), FOUND).select(*shown)
    found = [written(rows.mapInArrow(_scan(patterns, p == 0, False), HITS)) for p, patterns in enumerate(every)]
    hits = None
    for f in found:
        f = f.where(F.size("ranges") > 0).select("id", "row_tag", "items", "ranges").distinct()
        hits = f if hits is None else hits.unionByName(f)
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = hits.groupBy("id", "row_tag").agg(each("items"), each("ranges"))
    whole = found[0].select("id", "row_tag", "n_words").join(hits, ["id", "row_tag"], "left")
    none = F.array().cast("array<string>")
    return whole.select("id", "row_tag", "n_words", F.coalesce("items", none).alias("items"), "ranges").mapInArrow(_unite, FOUND).select(*shown)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, all columns as they are."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def without(name: str, patterns: dict[str, list[str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, patterns)
            for batch in batches:
                ok = [automaton is None or next(automaton.iter(line(normalised(v.as_py() or ""))), None) is None for v in batch.column(at)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        return run

    for p, patterns in enumerate(parts(benchmark, size, most_bytes)[1]):
        docs = (written(docs) if p else docs).mapInArrow(without(uuid.uuid4().hex, patterns), schema)
    return docs
