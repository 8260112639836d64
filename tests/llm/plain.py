"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash


def components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(rows):
    prints = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(rows, prints, roots, strict=True)), key=str)


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_groups(rows, least=0.8):
    """{(id, text): if it is the first of its group}, over distinct rows; ids may not be null."""
    rows = sorted({(i, t or "") for i, t in rows})
    sets = [shingle_set(t) for _, t in rows]
    roots = components(len(rows), lambda i, j: similar(sets[i], sets[j]) >= least - 1e-9)
    return {row: roots[k] == k for k, row in enumerate(rows)}


def repeats(rows, window=400):
    count = Counter()
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    for _, t in texts:
        count.update(t[p : p + window] for p in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for p in range(len(t)) if gone[p] and (not p or not gone[p - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rows, window=51):
    """(doc, words in passages of so many words that start anywhere else too)"""
    texts = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    count = Counter(tuple(t[p : p + window]) for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        held = {i for p in range(len(t) - window + 1) if count[tuple(t[p : p + window])] > 1 for i in range(p, p + window)}
        out.append((doc, len(held)))
    return sorted(out, key=str)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def dedup_lines(rows, edits=2, least=20):
    def lines(text):
        return [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]

    first = {}
    for doc, text in rows:
        for i, line in lines(text):
            place = (doc is None, doc or 0, i)
            first[line] = min(first.get(line, place), place)
    order, gone = sorted(first, key=first.get), set()
    for k, line in enumerate(order):
        if len(line) >= least and any(len(x) >= least and abs(len(line) - len(x)) <= edits and distance(line, x) <= edits for x in order[:k]):
            gone.add(line)
    out = []
    for doc, text in rows:
        drop = {i for i, line in lines(text) if line in gone or first[line] != (doc is None, doc or 0, i)}
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)))
    return sorted(out, key=str)


def leaks(rows, items, overlap=0.8, size=5):
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    shingles = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    stride = max([size, *(len(split(t)) for _, t in items)])
    out = {}
    for doc, text in rows:
        w, found = split(text), set()
        for s in range(0, max(len(w) - stride, 1), stride):
            for item, t in items:
                n = min(size, len(split(t)))
                own = shingles(split(t), n) if n else set()
                if own and len(own & shingles(w[s : s + 2 * stride], n)) >= overlap * len(own) - 1e-9:
                    found.add(item)
        out[doc] = sorted(found)
    return out
