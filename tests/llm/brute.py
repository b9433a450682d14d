"""Plain reference results for small tables, written without the operators."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> set:
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id: (n_shingles, component_id, kept)."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where: dict = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        s = len(sets[a] & sets[b])
        if 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def byte_dedup(docs: list[tuple[int, str | None]], size: int = 400) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = {d: (t or "").encode() for d, t in docs}
    count: dict = {}
    for r in raw.values():
        for i in range(len(r) - size + 1):
            k = r[i : i + size]
            count[k] = count.get(k, 0) + 1
    out = {}
    for d, r in raw.items():
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())
    return out


def word_dedup(docs: list[tuple[int, str | None]], size: int = 20) -> dict[int, tuple]:
    """doc_id: (n_words, n_removed, kept_sha256)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    seen: set = set()
    out = {}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out
