"""Brute-force versions of the training-data operators, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def contamination(docs, items, window=13):
    """doc -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = defaultdict(set)
    for name, text in items:
        words = WORD.findall(low(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(str(name))
    sizes, out = {len(k) for k in windows}, {}
    for doc, text in docs:
        words = WORD.findall(low(text))
        hit, found = [0] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i:i + size]))
                if own:
                    found |= own
                    hit[i:i + size] = [1] * size
        n = sum(hit)
        out[doc] = (len(words), n, len(found), sha(",".join(sorted(found)).encode()), n > 0 and 20 * n >= len(words))
    return out


def repeated_words(docs, window=13):
    """doc -> (n_words, n_removed, kept_sha256)"""
    words, first, out = {d: SPACED.findall(t or "") for d, t in docs}, {}, {}
    for doc in sorted(words):
        own = words[doc]
        for i in range(len(own) - window + 1):
            first.setdefault(tuple(own[i:i + window]), doc)
    for doc, own in words.items():
        gone = [0] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i:i + window])] < doc:
                gone[i:i + window] = [1] * window
        out[doc] = (len(own), sum(gone), sha(" ".join(w for w, g in zip(own, gone) if not g).encode()))
    return out


def repeated_bytes(docs, length=50):
    """doc -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    data, first, out = {d: (t or "").encode() for d, t in docs}, {}, {}
    for doc in sorted(data):
        own = data[doc]
        for i in range(len(own) - length + 1):
            first.setdefault(own[i:i + length], doc)
    for doc, own in data.items():
        gone = bytearray(len(own))
        for i in range(len(own) - length + 1):
            if first[own[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        out[doc] = (len(own), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(own, gone) if not g)))
    return out


def shingle_sets(docs, size=4):
    out = {}
    for doc, text in docs:
        words = SPACED.findall(low(text))
        out[doc] = frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])
    return out


def near_duplicates(docs, size=4, percent=80):
    """doc -> (n_shingles, component)"""
    sets, holders, common = shingle_sets(docs, size), defaultdict(list), defaultdict(int)
    for doc in sorted(sets):
        for shingle in sets[doc]:
            holders[shingle].append(doc)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}
