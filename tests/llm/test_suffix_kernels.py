"""Windows found by batches, anchors and the suffix sort, against plain Python on random bytes."""

import random

import numpy as np
import pytest

from globeframe.llm import suffix_dedup as S

LENGTH, SEED = 50, 16


def drawn(r):
    """Documents that share pieces of one base, over a small or large alphabet."""
    letters = r.choice([b"ab", b"abc", bytes(range(97, 123))])
    some = lambda n: bytes(r.choice(letters) for _ in range(n))
    base, docs = some(200), []
    for _ in range(8):
        parts = []
        for _ in range(r.randrange(5)):
            at = r.randrange(150)
            parts.append(base[at : at + r.randrange(20, 120)] if r.random() < 0.5 else some(r.randrange(80)))
        docs.append(b"".join(parts))
    return docs


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("hot_from", [2, 1000])
def test_windows(seed, hot_from):
    docs = drawn(random.Random(seed))
    first, want = {}, []
    for doc, text in enumerate(docs):
        gone = bytearray(len(text))
        for k in range(len(text) - LENGTH + 1):
            if first.setdefault(text[k : k + LENGTH], doc) < doc:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        want.append(bytes(gone))
    batches = [S.Batch(np.arange(k, 8, 3), [docs[i] for i in range(k, 8, 3)], LENGTH, SEED) for k in range(3)]
    asked = [b.distinct() for b in batches]
    every, senders = np.unique(np.concatenate([h for h, _, _ in asked]), return_counts=True)
    live = np.union1d(every[senders > 1], np.concatenate([h[twice] for h, _, twice in asked]))
    runs = sum((np.bincount(np.searchsorted(every, h), n, len(every)) for h, n, _ in asked), np.zeros(len(every)))
    hot = runs[np.searchsorted(every, live)] > hot_from
    least, texts, keys, owner = [], [], [], []
    for k, b in enumerate(batches):
        *_, low, segments, key = b.segments(live, hot)
        least.append(low)
        texts += segments
        keys.append(key)
        owner += [(k, j) for j in range(len(segments))]
    bits = S.resolve(texts, np.concatenate(least), np.concatenate(keys), LENGTH)
    for k, b in enumerate(batches):
        found = {j: int(x) for (batch, j), x in zip(owner, bits) if batch == k and x}
        gone = b.covered(live, hot, found)
        for doc, s, e in zip(b.ids.tolist(), b.starts[:-1], b.starts[1:]):
            assert bytes(gone[s:e].astype(np.uint8)) == want[doc]


def test_extensions_and_order():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 400).astype(np.uint8)
    raw = data.tobytes()
    suffixes = S.Suffixes(data, LENGTH)
    a, b = r.integers(0, 350, 300), r.integers(0, 350, 300)
    want = [next((k for k in range(LENGTH) if raw[x + k] != raw[y + k]), LENGTH) for x, y in zip(a, b)]
    assert suffixes.extension(a, b).tolist() == want
    group = np.sort(r.integers(0, 4, 300))
    order = suffixes.sort(a, group)
    keys = [(int(group[i]), raw[a[i] : a[i] + LENGTH]) for i in order]
    assert keys == sorted(keys)
