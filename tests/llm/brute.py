"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def covered(n, ranges):
    gone = bytearray(n)
    for a, b in ranges:
        gone[a:b] = b"\1" * (b - a)
    return gone


def runs(gone):
    return sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def substrings(docs, length):
    """docs: (id, text); {id: kept bytes, removed bytes, runs}."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        again = []
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                again.append((p, p + length))
            seen.add(w)
        gone = covered(len(b), again)
        out[i] = (bytes(c for c, g in zip(b, gone) if not g), sum(gone), runs(gone))
    return out


def windows(docs, size):
    words = {i: (t or "").encode().split() for i, t in docs}
    count = {}
    for w in words.values():
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            count[k] = count.get(k, 0) + 1
    out = {}
    for i, w in words.items():
        gone = covered(len(w), [(p, p + size) for p in range(len(w) - size + 1) if count[tuple(w[p : p + size])] > 1])
        out[i] = (b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone))
    return out


def shingle_set(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    order = sorted(nodes)
    for a in order:
        for b in order:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def contamination(docs, items, size):
    words = lambda t: ALNUM.findall((t or "").encode().translate(LOWER))
    own = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            own.setdefault(tuple(w[p : p + size]), set()).add(item)
    out = {}
    for i, text in docs:
        w = words(text)
        found, ranges = set(), []
        for n in {len(k) for k in own}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in own:
                    found |= own[tuple(w[p : p + n])]
                    ranges.append((p, p + n))
        out[i] = (len(w), sum(covered(len(w), ranges)), sorted(x for x in found if x is not None))
    return out
