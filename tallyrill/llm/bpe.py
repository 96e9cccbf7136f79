"""BPE encoding with content-defined chunk reuse, and decoding.

1. Texts are cut where a rolling hash of their bytes says so, so that a passage has the same chunks in every document.
2. Chunks meet by two independent 64-bit hashes. Of a chunk that occurs at several places, the first place is its owner.
3. Owners encode their shared chunks, once in the whole corpus, and the ids go to every bucket of documents that needs them.
4. Each document encodes the chunks that no other place has, and joins all its chunks. At a join the tokens around the cut
   are wrong where the cut parted what belongs together, so the join is repaired: the text between the nearest safe places
   to both sides is encoded again and put in, once token borders of both chunks agree with those places; until they do,
   the stretch grows.

A safe place is a space or newline after an ASCII byte that is no white space: every pattern of the tokenizer's splitter
ends before it or starts at it, whatever surrounds it, and no special token holds white space, so encoding the parts before
and after it apart gives the ids of encoding both together. A document without agreement is encoded whole.

A chunk has no longest length: a text in which no place is chosen is one chunk, encoded whole.

A null text is empty and has no ids. Rows that repeat doc_id and text are encoded alike, each for itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .suffixes import _changes
from .tables import BLOB, BUCKETS_A_PARTITION, Dealer, Lookup, attach, blob_batch, by_bucket, collect_garbage, doc_id, id_buckets, joined, keyed, pack, partitions, small_batches, written

GRAM = 16
#: Ids that a task holds before it hands them on.
MOST_IDS = 8_000_000
#: Kinds of packed rows: a chunk for its owner to encode; buckets of documents that want one; ids of chunks; places of chunks.
OWN, WANT, IDS, CHUNK = 0, 1, 2, 3
ENCODED = "id long, tag int, ids binary, n_tokens long, decoded string"

#: Fixed value: the splitter of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Library:
    """The tokenizers library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        special = {i: a.content for i, a in self.t.get_added_tokens_decoder().items()}
        self.size = np.zeros(self.t.get_vocab_size(), np.int64)
        for token, i in self.t.get_vocab().items():
            self.size[i] = len(special[i].encode()) if i in special else len(token)  # byte-level: a character a byte

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.t.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


class Ranked:
    """A BPE whose ids are in the order of its merges: merging the pair of the least id first is the same rule, for which tiktoken is several times faster."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, model, vocab = file["pre_tokenizer"] or {}, file["model"], file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {a["content"]: a for a in file["added_tokens"]}
        plain = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or plain or file["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("it isn't plain byte-level BPE")
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or not a["special"] for a in added.values()):
            raise ValueError("its ids aren't in the order of its merges, or its added tokens aren't plain")
        byte = _byte_of_character()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        self.t = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={c: a["id"] for c, a in added.items()})
        self.size = np.zeros(max(self.t.n_vocab, 1), np.int64)
        for t, i in (*ranks.items(), *((c.encode(), a["id"]) for c, a in added.items())):
            self.size[i] = len(t)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.t.encode_to_numpy(x, allowed_special="all") for x in texts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.t.decode(x.tolist()) for x in ids]


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in turn from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_TOKENIZERS: dict[str, Library | Ranked] = {}


def tokenizer(path: str) -> Library | Ranked:
    if path not in _TOKENIZERS:
        try:
            _TOKENIZERS[path] = Ranked(path)
        except ValueError:
            _TOKENIZERS[path] = Library(path)
    return _TOKENIZERS[path]


def cuts(raw: np.ndarray, at: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all chunks, at starts of characters, and the n + 1 offsets of each text's chunks."""
    chosen = np.zeros(len(raw) + 1, bool)
    if len(raw) >= GRAM:
        p = np.flatnonzero(X.byte_grams(raw, GRAM) % X.U64(mean) == 0) + GRAM
        for _ in range(3):  # a character has three bytes more at most
            inside = (p < len(raw)) & ((np.append(raw, np.uint8(0))[np.minimum(p, len(raw))] & 0xC0) == 0x80)
            p = p + inside
        chosen[p] = True
        # a gram over the border of two texts isn't of one text
        doc = np.searchsorted(at, p, "right") - 1
        chosen[p[p - at[np.minimum(doc, len(at) - 1)] < GRAM]] = False
    chosen[at[:-1][np.diff(at) > 0]] = True
    chosen[len(raw)] = False
    starts = np.flatnonzero(chosen)
    return starts, np.searchsorted(starts, at, "left")


def _chunk_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols = X.mix(raw.astype(X.U64) + X.U64(1))
    return X.Spans(symbols)(starts, ends), X.Spans(symbols, 987654321)(starts, ends)


def _chunks(part: pa.RecordBatch, column: int, mean: int):
    raw, at = X.utf8(part.column(column))
    starts, chunk_at = cuts(raw, at, mean)
    ends = np.append(starts[1:], len(raw))
    return raw, at, starts, ends, chunk_at


def _chunked(mean: int, n: int):
    """The chunks of all documents: of equal ones within a task's share the earliest place, whether there are more, and the other buckets of documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Dealer(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = joined(held)
            held.clear()
            order = np.lexsort((x["pos"], x["tag"], x["id"], x["c2"], x["c1"]))
            x = {k: v[order] for k, v in x.items()}
            once = _changes(x["c1"], x["c2"], x["id"], x["tag"], x["pos"])
            x = {k: v[once] for k, v in x.items()}
            new = _changes(x["c1"], x["c2"])
            group = np.cumsum(new) - 1
            bucket = id_buckets(x["id"], n)
            first = {k: v[new] for k, v in x.items()} | {"many": (np.bincount(group) > 1).astype(np.uint8)}
            yield from out.add(first, first["c1"] % X.U64(n), CHUNK)
            other = np.flatnonzero(bucket != bucket[new][group])
            _, i = np.unique(group[other] * n + bucket[other], return_index=True)
            other = other[i]
            yield from out.add({"c1": x["c1"][other], "c2": x["c2"][other], "b": bucket[other].astype(np.int32)}, x["c1"][other] % X.U64(n), WANT)

        for batch in batches:
            for part in X.slices(batch, "text"):
                raw, at, starts, ends, _ = _chunks(part, 2, mean)
                c1, c2 = _chunk_hashes(raw, starts, ends)
                doc = np.searchsorted(at, starts, "right") - 1
                held.append({"c1": c1, "c2": c2, "id": part.column(0).to_numpy()[doc], "tag": part.column(1).to_numpy()[doc].astype(np.uint16), "pos": starts - at[doc], "end": ends - at[doc]})
                rows += len(starts)
                if rows > out.most:
                    yield from flush()
                    rows = 0
        if rows:
            yield from flush()
        yield from out.flush()

    return run


def _owners(n: int):
    """Which places encode shared chunks, and which buckets of documents want them."""

    def make():
        out = Dealer()

        def fn(bucket: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if CHUNK not in have:
                return
            x = joined(have[CHUNK])
            order = np.lexsort((x["pos"], x["tag"], x["id"], x["c2"], x["c1"]))
            x = {k: v[order] for k, v in x.items()}
            new = _changes(x["c1"], x["c2"])
            place = _changes(x["c1"], x["c2"], x["id"], x["tag"], x["pos"])
            group = np.cumsum(new) - 1
            several = ((np.bincount(group, weights=place) > 1) | (np.bincount(group, weights=x["many"]) > 0))[group]
            own = new & several
            keep = {k: x[k][own] for k in ("id", "tag", "pos", "end", "c1", "c2")}
            yield from out.add(keep, id_buckets(keep["id"], n), OWN)
            want = {"c1": x["c1"][several], "c2": x["c2"][several], "b": id_buckets(x["id"][several], n).astype(np.int32)}
            if WANT in have:
                want = joined([want, *have[WANT]])
            order = np.lexsort((want["b"], want["c2"], want["c1"]))
            order = order[_changes(want["c1"][order], want["c2"][order], want["b"][order])]
            yield from out.add({k: v[order] for k, v in want.items()}, np.full(len(order), bucket), WANT)

        return fn, out.flush

    return make


def _owned(path: str, n: int):
    """Owners' chunks, encoded: for each bucket of chunks the hashes, the ids' counts and all ids."""

    def make():
        done: dict[int, list[tuple]] = {}
        held = [0]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for bucket, own in done.items():
                c1, c2, ids = zip(*own, strict=True)
                rows.append((bucket, IDS, pack({"c1": np.array(c1, X.U64), "c2": np.array(c2, X.U64), "n": np.array([len(i) for i in ids], np.int64), "ids": np.concatenate(ids)})))
            if rows:
                yield blob_batch(rows)
            done.clear()
            held[0] = 0

        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if OWN not in have:
                return
            look = have.get("look") or have.setdefault("look", Lookup(have[OWN]))
            t = tokenizer(path)
            for part in X.slices(batch, "text"):
                lo, hi = look(part.column(0).to_numpy(), part.column(1).to_numpy())
                k, doc = X.ranges(lo, hi)
                if not len(k):
                    continue
                x = {name: v[k] for name, v in look.rows.items()}
                raw, at = X.utf8(part.column(2))
                ids = t.encode([raw[a:b].tobytes().decode() for a, b in zip((at[doc] + x["pos"]).tolist(), (at[doc] + x["end"]).tolist(), strict=True)])
                for bucket, *one in zip((x["c1"] % X.U64(n)).tolist(), x["c1"].tolist(), x["c2"].tolist(), ids, strict=True):
                    done.setdefault(bucket, []).append(tuple(one))
                    held[0] += len(one[2])
                if held[0] > MOST_IDS:
                    yield from flush()

        return fn, flush

    return make


def _delivered(n: int):
    """The ids of shared chunks for each bucket of documents that wants them, each chunk once a bucket."""

    def make():
        done: dict[int, list[dict]] = {}
        held = [0]

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for bucket, parts in done.items():
                rows.append((bucket, IDS, pack(joined(parts))))
                if len(rows) == 256:
                    yield blob_batch(rows)
                    rows = []
            if rows:
                yield blob_batch(rows)
            done.clear()
            held[0] = 0

        def fn(_: int, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            if WANT not in have or IDS not in have:
                return
            ids, want = joined(have[IDS]), joined(have[WANT])
            start = np.cumsum(ids["n"]) - ids["n"]
            chunk = {k: i for i, k in enumerate(zip(ids["c1"].tolist(), ids["c2"].tolist(), strict=True))}
            which = np.array([chunk.get(k, -1) for k in zip(want["c1"].tolist(), want["c2"].tolist(), strict=True)], np.int64)
            for b in np.unique(want["b"]).tolist():
                own = which[(want["b"] == b) & (which >= 0)]
                where, _ = X.ranges(start[own], start[own] + ids["n"][own])
                done.setdefault(b, []).append({"c1": ids["c1"][own], "c2": ids["c2"][own], "n": ids["n"][own], "ids": ids["ids"][where].astype(np.uint32)})
                held[0] += len(where)
            if held[0] > MOST_IDS:
                yield from flush()

        return fn, flush

    return make


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Bytes at which the encodings of what is before and after can be joined."""
    if len(raw) < 2:
        return np.empty(0, np.int64)
    a, b = raw[:-1], raw[1:]
    return np.flatnonzero(((b == 0x20) | (b == 0x0A)) & (a > 0x20) & (a < 0x7F)) + 1


def join_chunks(raw: np.ndarray, starts: list[int], ids: list[np.ndarray], size: np.ndarray, again) -> np.ndarray | None:
    """The ids of a whole text from those of its chunks, or None if no stretch around a cut agrees. ``again(text)`` encodes a stretch anew."""
    if len(ids) == 1:
        return ids[0]
    every = np.concatenate(ids)
    border = np.zeros(len(every) + 1, np.int64)
    np.cumsum(size[every], out=border[1:])
    if border[-1] != len(raw):
        return None
    safe = safe_places(raw)
    agreed = safe[np.isin(safe, border, assume_unique=True)]  # where tokens of the chunks end and a safe place is, too
    agreed = agreed[~np.isin(agreed, starts)]
    agreed = np.concatenate([[0], agreed, [len(raw)]])
    out, done = [], 0
    cut = np.array(starts[1:])
    left = agreed[np.searchsorted(agreed, cut, "right") - 1]
    right = agreed[np.searchsorted(agreed, cut, "left")]
    stretches: list[list[int]] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    tokens = np.searchsorted(border, np.array(stretches).ravel()).reshape(-1, 2)
    for (a, b), (i, j), new in zip(stretches, tokens.tolist(), again([raw[a:b].tobytes().decode() for a, b in stretches]), strict=True):
        out += [every[done:i], new]
        done = j
    return np.concatenate([*out, every[done:]])


def _assembled(path: str, mean: int, decode: bool):
    def make():
        def fn(batch: pa.RecordBatch, have: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            t = tokenizer(path)
            if "to" not in have:
                got = joined(have[IDS]) if IDS in have else {"c1": np.empty(0, X.U64), "c2": np.empty(0, X.U64), "n": np.empty(0, np.int64), "ids": np.empty(0, np.uint32)}
                order = np.argsort(got["c1"], kind="stable")
                have |= {"c1": got["c1"][order], "c2": got["c2"][order], "to": np.cumsum(got["n"])[order], "n": got["n"][order], "all": got["ids"]}
            known1, known2, to, count, every = have["c1"], have["c2"], have["to"], have["n"], have["all"]
            for part in X.slices(batch, "text"):
                raw, at, starts, ends, chunk_at = _chunks(part, 2, mean)
                ids: list = [None] * len(starts)
                if len(known1):
                    c1, c2 = _chunk_hashes(raw, starts, ends)
                    i = np.minimum(np.searchsorted(known1, c1), len(known1) - 1)
                    for j in np.flatnonzero((known1[i] == c1) & (known2[i] == c2)).tolist():
                        ids[j] = every[to[i[j]] - count[i[j]] : to[i[j]]]
                todo = [i for i, x in enumerate(ids) if x is None]
                for i, x in zip(todo, t.encode([raw[starts[i] : ends[i]].tobytes().decode() for i in todo]), strict=True):
                    ids[i] = x
                done = []
                for d in range(part.num_rows):
                    a, b = chunk_at[d], chunk_at[d + 1]
                    if a == b:
                        done.append(np.empty(0, np.uint32))
                        continue
                    whole = raw[at[d] : at[d + 1]]
                    x = join_chunks(whole, (starts[a:b] - at[d]).tolist(), ids[a:b], t.size, t.encode)
                    done.append(t.encode([whole.tobytes().decode()])[0] if x is None else x)
                decoded = t.decode(done) if decode else [None] * len(done)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.astype("<u4").tobytes() for x in done], pa.binary()), pa.array([len(x) for x in done], pa.int64()), pa.array(decoded, pa.string())],
                    names=["id", "tag", "ids", "n_tokens", "decoded"],
                )

        return fn, None

    return make


def encode_documents(docs: DataFrame, path: str, mean_chunk: int = 1024, decode: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and, if asked for, decoded: one row for each row of ``docs``.

    ``path``: a byte-level BPE in the tokenizers library's format, at the same place on every executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark) * BUCKETS_A_PARTITION
    found = written(by_bucket(keyed(docs).mapInArrow(_chunked(mean_chunk, n), BLOB), _owners(n), BLOB))
    owned = attach(keyed(docs), found.where(F.col("kind") == OWN), n, _owned(path, n), BLOB)
    shared = written(by_bucket(found.where(F.col("kind") == WANT).unionByName(owned), _delivered(n), BLOB))
    del owned
    collect_garbage(spark)
    out = attach(keyed(docs), shared, n, _assembled(path, mean_chunk, decode), ENCODED)
    return out.select(doc_id(), "ids", "n_tokens", *(["decoded"] if decode else []))
