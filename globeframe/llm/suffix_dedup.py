"""Suffix-array dedup: repeated byte strings found by a hash-compared suffix sort.

Every byte covered by a ``LENGTH``-byte string (a window) that also starts in a document
with a smaller id is removed.  Matches never cross documents.

1. Anchors.  The least hash of a window's ``SEED``-byte strings is its anchor; equal
   windows have equal anchors.  Documents are dealt into batches by
   hash of doc_id.  Each batch asks, once for each distinct anchor hash, whether documents
   elsewhere have it: what meets for one hash is a row for each batch, not for each
   document, so a passage in a third of all documents is no hot group.
2. Windows.  For anchors that occur in two documents a batch sends the bytes of the windows
   they anchor (one segment for each distinct byte string, under the hash of its anchor,
   with the smallest id that has it in the batch; hashes with many occurrences send single
   windows, dealt by the hash of the window instead).  The receiving task sorts the
   windows of its segments: prefix polynomial hashes give the common extension of two
   suffixes by binary search, so each comparison of the merge sort costs a logarithm of
   the length; neighbours that the sort holds equal are verified byte by byte.  Each run
   of equal windows has one smallest id, and a segment gets back a bit for each of its
   windows: found in a smaller document than its own smallest or not.
3. Cuts.  The batch marks the windows of its documents by these bits, and those that
   another document of the batch with a smaller id has, and cuts the covered bytes.

Batches, anchors and segments are functions of the texts alone, so they are computed again
where needed and only hashes, segments and bits travel.

Defined results: a null text is empty; texts shorter than a window keep all bytes; rows
with equal doc_id are one row for each, and match other ids only; rows with a null doc_id
neither give nor lose bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, fresh, table
from ._text import PrefixHash, mix

LENGTH = 50
SEED = 16
#: Texts that one batch is meant to hold; more batches never change a result.
BATCH_BYTES = 4 << 20
#: An anchor hash with more occurrences than this sends its windows one by one.
HOT = 2000
HASH_BITS = np.uint64(48)
#: Text hashed at once: the arrays of it stay in a processor's cache.
HASH_BYTES = 128 << 10

U64 = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """The runs of windows with one anchor: (first window, last window, hash, row).

    Windows in a row with one least seed hash are a run; a longer one than a window has
    seeds (a repetitive text) is several runs."""
    n, z = len(data), np.zeros(0, np.int64)
    if n < length:
        return z, z, np.zeros(0, np.uint64), z
    prefix, span = PrefixHash(data), length - seed + 1
    h = prefix.sums[seed:] - prefix.sums[:-seed]
    h *= prefix.down[: len(h)]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    # Sliding minimum over ``span`` seeds by doubling.
    width = 1
    while width < span:
        step = min(width, span - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    inside = np.ones(n + 1, bool)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(s, e - length + 1) : e] = False
    inside = inside[: len(h)]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (h[1:] != h[:-1])
    begin = np.flatnonzero(first)
    ends = np.append(np.flatnonzero(first | ~inside), len(h))
    last = ends[np.searchsorted(ends, begin, "right")] - 1
    parts = (last - begin) // span + 1
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.minimum(np.repeat(last, parts), np.repeat(begin, parts) + (nth + 1) * span - 1)
        begin = np.repeat(begin, parts) + nth * span
    return begin, last, h[begin] >> (U64(64) - HASH_BITS), np.searchsorted(offsets, begin, "right") - 1


class Batch:
    """The texts of one batch by ascending doc_id, and their anchors."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int, seed: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.length = ids[order], length
        self.texts = [texts[i] for i in order]
        parts, self.starts = [], np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        for s, e in _slices(self.starts):
            data = np.frombuffer(b"".join(self.texts[s:e]), np.uint8)
            begin, last, h, row = anchors(data, self.starts[s : e + 1] - self.starts[s], length, seed)
            base = self.starts[s]
            parts.append((begin + base, last + base, h, row + s))
        self.begin, self.last, self.hash, self.row = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (int, int, np.uint64, int))
        self.all = b"".join(self.texts)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct anchor hash, its number of runs, and whether two ids have it."""
        order = np.argsort(self.hash, kind="stable")
        h, row = self.hash[order], self.row[order]  # rows, and so ids, ascend within a hash
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        ends = np.append(new[1:], len(h)) - 1 if len(h) else new
        return h[new], ends - new + 1, self.ids[row[new]] != self.ids[row[ends]]

    def segments(self, live: np.ndarray, hot: np.ndarray):
        """Runs of live anchors as (start, number of windows, row, segment) and the distinct
        segments as (smallest id, bytes, key).

        A segment is the bytes of a run of windows; a hot anchor's windows have one each.
        """
        at = np.minimum(np.searchsorted(live, self.hash), len(live) - 1)
        runs = np.flatnonzero(live[at] == self.hash) if len(live) else np.zeros(0, int)
        is_hot = hot[at[runs]] if len(runs) else np.zeros(0, bool)
        cold, warm = runs[~is_hot], runs[is_hot]
        count = self.last[warm] - self.begin[warm] + 1
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.concatenate([self.begin[cold], np.repeat(self.begin[warm], count) + within])
        windows = np.concatenate([self.last[cold] - self.begin[cold] + 1, np.ones(count.sum(), np.int64)])
        row = np.concatenate([self.row[cold], np.repeat(self.row[warm], count)])
        order = np.argsort(row, kind="stable")
        start, windows, row, one = start[order], windows[order], row[order], order >= len(cold)
        h = np.concatenate([self.hash[cold], np.zeros(len(within), np.uint64)])[order]
        known: dict[bytes, int] = {}
        texts = [self.all[s:e] for s, e in zip(start.tolist(), (start + windows + (self.length - 1)).tolist(), strict=True)]
        which = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
        _, first = np.unique(which, return_index=True)
        key = h[first]
        for j in np.flatnonzero(one[first]).tolist():
            key[j] = int.from_bytes(hashlib.blake2b(texts[first[j]], digest_size=6).digest(), "little")
        return start, windows, row, which, self.ids[row[first]], list(known), key

    def covered(self, live: np.ndarray, hot: np.ndarray, bits: dict[int, int]) -> np.ndarray:
        """Which bytes of the batch go."""
        start, windows, row, which, least, _, _ = self.segments(live, hot)
        gone = np.zeros(len(self.all) + 1, np.int32)
        if len(start):
            mask = np.array([bits.get(j, 0) for j in range(len(least))], np.uint64)[which]
            mask[self.ids[row] > least[which]] = ~U64(0)
            hit = mask > 0
            start, windows, mask = start[hit], windows[hit], mask[hit]
            for w in range(int(windows.max(initial=0))):  # runs are apart, so no place comes twice
                s = start[(w < windows) & ((mask >> U64(min(w, 63))) & U64(1) > 0)] + w
                gone[s] += 1
                gone[s + self.length] -= 1
        return np.cumsum(gone[:-1]) > 0


def _slices(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about HASH_BYTES; a longer text is one of its own."""
    n, s = len(starts) - 1, 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(starts, starts[s] + HASH_BYTES, "right")) - 1)
        yield s, e
        s = e


class Suffixes:
    """Suffixes of one buffer, compared on their first ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.hash = PrefixHash(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix length of the suffixes at a and b, up to ``length``: binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        sums, down = self.hash.sums, self.hash.down
        sum_a, down_a, sum_b, down_b = sums[a], down[a], sums[b], down[b]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[a + mid] - sum_a) * down_a == (sums[b + mid] - sum_b) * down_b
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of suffixes."""
        n = self.extension(a, b)
        differ = n < self.length
        at = np.minimum(n, self.length - 1)
        x, y = self.data[a + at].astype(np.int16), self.data[b + at].astype(np.int16)
        return np.where(differ, np.sign(x - y), 0)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within groups (ascending numbers): bottom-up merge sort, all
        merges of a level at once; an element's place is its own rank plus its rank in the
        sibling run, found by binary search."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.searchsorted(g, g, "left")
        size = np.searchsorted(g, g, "right") - first
        width = 1
        largest = int(size.max(initial=0))
        while width < largest:
            place = np.arange(len(order)) - first
            busy = np.flatnonzero(size > width)
            p, f, n = place[busy], first[busy], size[busy]
            run = p // width
            right = run % 2 == 1
            sibling = np.where(right, run - 1, run + 1) * width
            low = np.minimum(sibling, n)
            high = np.minimum(sibling + width, n)
            begin = low.copy()
            mine = at[order[busy]]
            while (open_ := low < high).any():
                o = np.flatnonzero(open_)
                mid = (low[o] + high[o]) // 2
                c = self.compare(at[order[f[o] + mid]], mine[o])
                # Equal elements of the left run come first, so the sort is stable.
                before = (c < 0) | (right[o] & (c == 0))
                low[o] = np.where(before, mid + 1, low[o])
                high[o] = np.where(before, high[o], mid)
            target = f + (run // 2) * 2 * width + (p - run * width) + (low - begin)
            new = order.copy()
            new[target] = order[busy]
            order = new
            width *= 2
        return order


def resolve(segments: list[bytes], least: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each segment the bits of its windows that a segment with a smaller id has too.

    ``key`` groups segments: only those of one key can share windows.
    """
    n = len(segments)
    bits = np.zeros(n, np.uint64)
    if not n:
        return bits
    # Equal segments of one group are taken together.
    order = sorted(range(n), key=lambda i: (key[i], segments[i]))
    same = np.zeros(n, np.int64)
    same[1:] = np.cumsum([key[a] != key[b] or segments[a] != segments[b] for a, b in zip(order[:-1], order[1:], strict=True)])
    unit = np.zeros(n, np.int64)
    unit[order] = same
    n_units = int(same[-1]) + 1
    low = np.full(n_units, np.iinfo(np.int64).max)
    np.minimum.at(low, unit, least)
    head = np.zeros(n_units, np.int64)
    head[same] = order
    windows = np.array([len(segments[i]) for i in range(n)]) - length + 1
    full = (U64(1) << np.minimum(windows, 63).astype(np.uint64)) - U64(1)
    bits = np.where(least > low[unit], full, U64(0))
    # Groups with different segments: their windows are sorted.
    _, group, members = np.unique(key[head], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(members[group] > 1)
    if not len(mixed):
        return bits
    texts = [segments[head[u]] for u in mixed]
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    count = size - length + 1
    owner = np.repeat(np.arange(len(mixed)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = base[owner] + within
    data = np.frombuffer(b"".join(texts), np.uint8)
    suffixes = Suffixes(data, length)
    # Windows of a group that differ in their seeds' hash are never equal: sorted apart.
    lead = suffixes.hash.of(at, at + SEED)
    _, part = np.unique(mix(lead) ^ (group[mixed][owner].astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_inverse=True)
    order = suffixes.sort(at, part)
    a, b = at[order[:-1]], at[order[1:]]
    equal = part[order[:-1]] == part[order[1:]]
    equal[equal] = suffixes.extension(a[equal], b[equal]) >= length
    # Verification: a pair that hashes hold equal must be equal byte by byte.
    span = np.arange(length)
    for s in range(0, len(equal), 1 << 16):
        pair = np.flatnonzero(equal[s : s + (1 << 16)]) + s
        equal[pair] = (data[a[pair, None] + span] == data[b[pair, None] + span]).all(1)
    run = np.concatenate([[0], np.cumsum(~equal)])
    best = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, run, low[mixed][owner[order]])
    found = np.zeros(len(at), np.int64)
    found[order] = best[run]
    # Back to all segments of each unit: a window counts if its smallest id is below the segment's.
    first = np.full(n_units, -1)
    first[mixed] = np.cumsum(count) - count
    some = np.flatnonzero(first[unit] >= 0)
    many = windows[some]
    starts = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(starts, many)
    hit = found[np.repeat(first[unit[some]], many) + place] < np.repeat(least[some], many)
    bits[some] |= np.bitwise_or.reduceat(hit.astype(np.uint64) << place.astype(np.uint64), starts)
    return bits


def _packed(**arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed blob, each with its length before it."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays.values()]
    return zstandard.compress(b"".join(len(r).to_bytes(8, "little") + r for r in raw), 1)


def _unpacked(blob: bytes) -> list[bytes]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _six(h: np.ndarray) -> np.ndarray:
    """The six low bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _as_batch(rows: pa.Table, length: int, seed: int) -> Batch:
    ids = rows.column("doc_id").to_numpy().astype(np.int64)
    return Batch(ids, [(x or "").encode() for x in rows.column("text").to_pylist()], length, seed)


MAIL = "to int, sender int, kind int, blob binary"


def _mail(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["to", "sender", "kind", "blob"])


class Dedup:
    """The three steps over one table of documents."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, seed: int = SEED, batch_bytes: int = BATCH_BYTES, hot: int = HOT):
        if not seed <= length < seed + 63:
            raise ValueError("length must be at least seed and less than seed + 63")
        self.length, self.seed, self.hot = length, seed, hot
        self.scratch = Scratch(docs.sparkSession, "suffix")
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = max(16, -(-total // batch_bytes))
        self.by = fresh("batch", docs.columns)
        self.batched = docs.filter("doc_id IS NOT NULL").withColumn(self.by, F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int"))

    def _texts(self) -> DataFrame:
        return self.batched.select(F.col(self.by).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def live(self) -> DataFrame:
        """Mail to batches: those of their anchor hashes that two documents have."""
        parts, hot = self.parts, self.hot
        batch_of = partial(_as_batch, length=self.length, seed=self.seed)

        def ask(rows: pa.Table) -> pa.Table:
            me = rows.column("batch")[0].as_py()
            h, runs, twice = batch_of(rows).distinct()
            to = (h % U64(parts)).astype(int)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(parts + 1))
            out = []
            for t in np.unique(to).tolist():
                i = order[ends[t] : ends[t + 1]]
                out.append((t, me, 0, _packed(h=_six(h[i]), runs=np.minimum(runs[i], 65535).astype("<u2"), twice=twice[i])))
            return _mail(out)

        def answer(mail: pa.Table) -> pa.Table:
            me = mail.column("to")[0].as_py()
            senders = mail.column("sender").to_pylist()
            parts_of = [_unpacked(x) for x in mail.column("blob").to_pylist()]
            h = np.concatenate([_from_six(p[0]) for p in parts_of])
            runs = np.concatenate([np.frombuffer(p[1], "<u2") for p in parts_of]).astype(np.int64)
            twice = np.concatenate([np.frombuffer(p[2], bool) for p in parts_of])
            _, inverse, senders_of = np.unique(h, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, runs)
            alive = senders_of > 1
            alive[inverse[twice]] = True
            flags = alive[inverse]
            many = (total > hot)[inverse]
            out, at = [], 0
            for sender, p in zip(senders, parts_of, strict=True):
                n = len(p[0]) // 6
                keep = flags[at : at + n]
                if keep.any():
                    out.append((sender, me, 0, _packed(h=_six(h[at : at + n][keep]), hot=many[at : at + n][keep])))
                at += n
            return _mail(out)

        asked = self._texts().groupBy("batch").applyInArrow(ask, MAIL)
        return self.scratch.save(asked.groupBy("to").applyInArrow(answer, MAIL))

    def found(self, live: DataFrame) -> DataFrame:
        """Mail to batches: the bits of their segments."""
        parts, length = self.parts, self.length
        batch_of = partial(_as_batch, length=self.length, seed=self.seed)

        def send(rows: pa.Table, mail: pa.Table) -> pa.Table:
            if not rows.num_rows or not mail.num_rows:
                return _mail([])
            me = rows.column("batch")[0].as_py()
            *_, least, texts, key = batch_of(rows).segments(*_read_live(mail))
            to = (key % U64(parts)).astype(int)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(parts + 1))
            out = []
            for t in np.unique(to).tolist():
                i = order[ends[t] : ends[t + 1]]
                mine = [texts[j] for j in i.tolist()]
                sizes = np.array([len(x) for x in mine], np.uint8)
                out.append((t, me, 1, _packed(number=i.astype("<u4"), least=least[i], key=_six(key[i]), size=sizes, text=b"".join(mine))))
            return _mail(out)

        def sort(mail: pa.Table) -> pa.Table:
            me = mail.column("to")[0].as_py()
            senders = mail.column("sender").to_pylist()
            parts_of = [_unpacked(x) for x in mail.column("blob").to_pylist()]
            segments: list[bytes] = []
            for p in parts_of:
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(p[3], np.uint8), dtype=np.int64)]).tolist()
                segments += [p[4][s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            least = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts_of])
            bits = resolve(segments, least, np.concatenate([_from_six(p[2]) for p in parts_of]), length)
            out, at = [], 0
            for sender, p in zip(senders, parts_of, strict=True):
                number = np.frombuffer(p[0], "<u4")
                b = bits[at : at + len(number)]
                at += len(number)
                if b.any():
                    out.append((sender, me, 1, _packed(number=number[b > 0], bits=b[b > 0])))
            return _mail(out)

        sent = self._texts().groupBy("batch").cogroup(live.groupBy("to")).applyInArrow(send, MAIL)
        return self.scratch.save(sent.groupBy("to").applyInArrow(sort, MAIL))

    def cut(self, finish, columns: list[str], schema) -> DataFrame:
        """``finish(rows in order of the batch, kept bytes, removed, spans)`` for each batch."""
        batch_of = partial(_as_batch, length=self.length, seed=self.seed)
        live = self.live()
        self.scratch.free_shuffles()  # the texts that were dealt for it
        mail = live.unionAll(self.found(live))
        self.scratch.free_shuffles()

        def apply(rows: pa.Table, mail: pa.Table) -> pa.Table:
            rows = rows.take(np.argsort(rows.column("doc_id").to_numpy(), kind="stable"))
            batch = batch_of(rows)
            bits: dict[int, int] = {}
            for kind, blob in zip(mail.column("kind").to_pylist(), mail.column("blob").to_pylist(), strict=True):
                if kind == 1:
                    number, found = _unpacked(blob)
                    bits.update(zip(np.frombuffer(number, "<u4").tolist(), np.frombuffer(found, np.uint64).tolist(), strict=True))
            gone = batch.covered(*_read_live(mail), bits) if mail.num_rows else np.zeros(len(batch.all), bool)
            kept, removed, spans = [], [], []
            data = np.frombuffer(batch.all, np.uint8)
            for s, e in zip(batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True):
                out = gone[s:e]
                n = int(out.sum())
                kept.append(data[s:e][~out].tobytes() if n else batch.all[s:e])
                removed.append(n)
                spans.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + out[0]) if n else 0)
            return finish(rows, kept, removed, spans)

        def either(rows: pa.Table, mail: pa.Table) -> pa.Table:
            return apply(rows, mail) if rows.num_rows else finish(rows, [], [], [])

        texts = self.batched.select(self.by, *[f"`{c}`" for c in columns])
        return texts.groupBy(self.by).cogroup(mail.groupBy("to")).applyInArrow(either, schema)


def _read_live(mail: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted live hashes and which of them are hot."""
    parts_of = [_unpacked(b) for k, b in zip(mail.column("kind").to_pylist(), mail.column("blob").to_pylist(), strict=True) if k == 0]
    if not parts_of:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.concatenate([_from_six(p[0]) for p in parts_of])
    hot = np.concatenate([np.frombuffer(p[1], bool) for p in parts_of])
    order = np.argsort(h, kind="stable")
    return h[order], hot[order]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, **options) -> DataFrame:
    """What was removed from each document, and the digest of what is left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finish(rows: pa.Table, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.Table:
        size = [len(k) + r for k, r in zip(kept, removed, strict=True)]
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        return pa.table([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), sha], [c.split()[0] for c in DIGEST.split(", ")])

    text = F.coalesce("text", F.lit(""))
    nameless = docs.filter("doc_id IS NULL").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return Dedup(docs, **options).cut(finish, ["doc_id", "text"], DIGEST).unionAll(nameless)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows with the repeated bytes cut from ``text`` (a cut inside a character takes the
    character) and ``n_chars``, where there is one, counted anew."""
    names = docs.columns

    def finish(rows: pa.Table, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.Table:
        texts = [k.decode(errors="ignore") if n else t for k, n, t in zip(kept, removed, rows.column("text").to_pylist() if removed else [], strict=True)]
        out = rows.select(names).set_column(names.index("text"), "text", pa.array(texts, rows.schema.field("text").type))
        if "n_chars" in names:
            chars = [len(t) if n else c for t, n, c in zip(texts, removed, rows.column("n_chars").to_pylist() if removed else [], strict=True)]
            out = out.set_column(names.index("n_chars"), "n_chars", pa.array(chars, rows.schema.field("n_chars").type))
        return out

    cut = Dedup(docs, **options).cut(finish, names, docs.schema)
    return cut.unionByName(docs.filter("doc_id IS NULL"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def oracle(length: int = LENGTH) -> str:
    """The same by a row for each window: bytes as hexadecimal digits (cut from blocks, since a cut
    takes time in proportion to its place), runs by window functions."""
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (SELECT doc_id, o, substr(h, 2 * o + 1, {2 * (512 + length - 1)}) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS o FROM d)),
w AS (SELECT doc_id, o + j AS i, substr(b, 2 * j + 1, {2 * length}) AS piece FROM (SELECT doc_id, o, b, unnest(range(0, least(512, length(b) // 2 - {length - 1}))) AS j FROM blocks)),
first AS (SELECT piece, min(doc_id) AS first FROM w GROUP BY 1),
hits AS (SELECT doc_id, i FROM w JOIN first USING (piece) WHERE first < doc_id),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM hits),
spans AS (SELECT doc_id, min(i) AS s, max(i) + {length} AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
cuts AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS start, s AS stop FROM cuts),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS h FROM kept JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, ((length(d.h) - length(k.h)) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM spans WHERE spans.doc_id = d.doc_id) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM d JOIN left_over k USING (doc_id)"""
