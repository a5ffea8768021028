"""Plain Python versions of the operators' results."""

import re


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(pattern, (text or "").translate(lower))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(texts, n, percent=80):
    """Smallest reachable doc_id of each document (doc_id -> text)."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in docs}


def cut(texts, window=50):
    """doc_id -> (bytes, which of them go)."""
    first, out = {}, {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - window + 1):
            if first.setdefault(raw[at : at + window], doc) < doc:
                gone[at : at + window] = b"\1" * window
        out[doc] = raw, bytes(gone)
    return out


def held(texts, items, n=5, percent=80):
    """(doc_id, item_id) of documents with so many per cent of an item's word runs."""
    out = set()
    split = {d: words(t, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+") for d, t in texts.items()}
    for item, text in items.items():
        w = words(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        size = min(n, len(w))
        runs = lambda v: {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
        want = runs(w) if w else set()
        for d, v in split.items():
            if want and 100 * len(want & runs(v)) >= percent * len(want):
                out.add((d, item))
    return out
