"""Byte cuts, near-duplicate links and packing against plain Python on the smallest tables."""

import hashlib
import re

import pytest

from globeframe.llm.registry import QUERIES

TABLES = "/root/testdata/sf0.001"
WINDOW, WORDS, ROOM = 50, 4, 2048


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def test_suffix_dedup(spark, texts):
    first, want = {}, {}
    for doc in sorted(texts):
        raw = texts[doc].encode()
        cut = bytearray(len(raw))
        for at in range(len(raw) - WINDOW + 1):
            if first.setdefault(raw[at : at + WINDOW], doc) < doc:
                cut[at : at + WINDOW] = b"\1" * WINDOW
        kept = bytes(b for b, gone in zip(raw, cut) if not gone)
        spans = len(re.findall(rb"\x01+", bytes(cut)))
        want[doc] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_dedup"](spark, TABLES).collect()}
    assert got == want


def test_near_duplicates(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        runs = {tuple(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}
        sets[doc] = runs or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_near_duplicates"](spark, TABLES).collect()}
    assert got == {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def test_packing(spark, texts):
    rows = QUERIES["op1_packing"](spark, TABLES).collect()
    assert {r.doc_id for r in rows} == set(texts)
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= ROOM
    for parts in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at)
            at += length
