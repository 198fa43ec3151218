"""Exact removal of repeated byte strings by depth-limited radix sorting of suffixes.

Two windows of `threshold` bytes are equal just if their suffixes agree to that depth, so suffixes need not be sorted further.
Sorting the suffixes of every position would shuffle many times the corpus.  Here one digit comes first that most suffixes
are dropped by: a window's anchor, the lowest-hashed string of half the threshold inside it.  Equal windows have equal
anchors at equal places.  The passes, most significant digit first:

1. Every block of documents sends the hashes of its anchors, once each, to the bucket of the hash.
2. Buckets return those that two blocks have; anchors that occur once are dropped, and all windows around them.
3. Blocks send the bytes before and after the remaining anchors, once per different context, to the buckets.
4. A bucket sorts the suffixes that start after each anchor, and the reversed prefixes before it, by digits of 8 bytes,
   dropping what is alone in its class.  Common prefix lengths of neighbours then tell which windows around an anchor
   occur earlier.  These go back to the blocks as spans.
5. Blocks cut their documents.

Documents are dealt to blocks of a few MB by a hash of their id.  A string that very many texts share is sent once
per block and context.  Where its contexts differ in very many places, its windows are sent one by one to buckets of
their own (kind 2), so that no bucket holds a hot string's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, tidy_groups, values

THRESHOLD = 100
BLOCK_BYTES = 4 << 20
#: Different contexts of one anchor, over all blocks, from which its windows are dealt one by one.
HOT = 20_000

#: Occurrences of anchors whose contexts stand in memory at once.
SLICE = 1 << 14

#: Occurrences of one anchor in a block from which those with equal contexts are put aside before contexts are sorted.
CROWDED = 1024

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 18


def rolling(data: np.ndarray, k: int, base: np.uint64 = M1) -> np.ndarray:
    """A 64-bit polynomial hash of every k bytes, by doubling."""
    cur, width, power = data.astype(np.uint64) + np.uint64(1), 1, base
    acc, done = None, 0
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                acc, done = (cur, width) if acc is None else (acc[: len(data) - done - width + 1] * power + cur[done : done + len(data) - done - width + 1], done + width)
            if done == k:
                break
            cur = cur[: len(cur) - width] * power + cur[width:]
            power, width = power * power, 2 * width
        acc = acc[:n]
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return acc ^ (acc >> np.uint64(32))


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        x, width = f(x[:-width], x[width:]), 2 * width
    return f(x[: len(x) - (w - width)], x[w - width :]) if width < w else x


def anchors(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the strings of threshold // 2 bytes that are lowest in a window of threshold bytes."""
    k = threshold // 2
    w = threshold - k + 1
    pos, val = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, len(data) - threshold + 1, _CHUNK):
        h = rolling(data[lo : lo + _CHUNK + threshold - 1], k)  # windows that start in this chunk
        low = _sliding(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h)
        pos.append(at + lo)
        val.append(h[at])
    pos, val = np.concatenate(pos), np.concatenate(val)
    if len(data) - threshold + 1 > _CHUNK:  # a string near the end of a chunk can be found in the next as well
        pos, first = np.unique(pos, return_index=True)
        val = val[first]
    return pos, val


class Block:
    """The documents of a block in the order of (doc_id, text), null ids last, joined to one byte string."""

    def __init__(self, t: pa.Table, key: str, text: str):
        ids, texts = t[key].to_pylist(), [(x or "").encode() for x in values(t[text])]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([2**63 - 1 if ids[i] is None else ids[i] for i in self.order], np.int64)
        #: place among rows of one id; null ids come after all others
        new = np.ones(len(self.ids), bool)
        new[1:] = self.ids[1:] != self.ids[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        self.seq = (np.arange(len(new)) - start).astype(np.int32)
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)

    @cached_property
    def data(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.texts), np.uint8)

    def anchors(self, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, position in self.data and hash of every anchor."""
        doc, pos, val = [], [], []
        for i in np.flatnonzero(self.size >= threshold):
            p, v = anchors(self.data[self.begin[i] : self.begin[i] + self.size[i]], threshold)
            doc.append(np.full(len(p), i))
            pos.append(p + self.begin[i])
            val.append(v)
        if not doc:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(doc), np.concatenate(pos), np.concatenate(val)

    def reaches(self, doc: np.ndarray, pos: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes before and after each anchor a window can reach."""
        k = threshold // 2
        return np.minimum(pos - self.begin[doc], threshold - k), np.minimum(self.begin[doc] + self.size[doc] - pos - k, threshold - k)

    def context_keys(self, doc: np.ndarray, pos: np.ndarray, threshold: int) -> np.ndarray:
        """A number for each anchor's context that equal contexts share."""
        have_l, have_r = self.reaches(doc, pos, threshold)
        with np.errstate(over="ignore"):
            return context_hashes(self.data, pos - have_l, pos + threshold // 2 + have_r) * M2 + (have_l * 1024 + have_r).astype(np.uint64)

    def again(self, doc: np.ndarray, pos: np.ndarray, group: np.ndarray, threshold: int) -> np.ndarray:
        """Rows in text order within ascending groups: which have the whole context of an earlier row of their group.  Found by
        hashes and verified byte by byte, some thousand rows at a time, so that long runs of one character take little memory."""
        out = np.zeros(len(doc), bool)
        size = np.bincount(group)
        crowded = np.flatnonzero(size[group] > CROWDED)
        if not len(crowded):
            return out
        key = self.context_keys(doc[crowded], pos[crowded], threshold)
        order = np.lexsort((key, group[crowded]))  # stable: text order stays
        g, c = group[crowded][order], key[order]
        head = np.ones(len(order), bool)
        head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        first = crowded[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later, first = crowded[order][~head], first[~head]
        for lo in range(0, len(later), 1 << 14):
            x, y = later[lo : lo + (1 << 14)], first[lo : lo + (1 << 14)]
            a, b = self.contexts(doc[x], pos[x], threshold), self.contexts(doc[y], pos[y], threshold)
            out[x] = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1) & (a[2] == b[2]) & (a[3] == b[3])
        return out

    def contexts(self, doc: np.ndarray, pos: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes before (nearest first) and after each anchor, as far as a window can reach, and how many there are."""
        k = threshold // 2
        reach = threshold - k
        have_l, have_r = self.reaches(doc, pos, threshold)
        step = np.arange(reach)
        pad = np.zeros(reach, np.uint8)
        strings = sliding_window_view(np.concatenate([pad, self.data, pad]), reach)  # no matrix of places is made
        left, right = np.ascontiguousarray(strings[pos][:, ::-1]), strings[pos + k + reach]
        left *= step < have_l[:, None]
        right *= step < have_r[:, None]
        return left, right, have_l.astype(np.uint8), have_r.astype(np.uint8)


def context_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for every row, from sums of powers over stretches of _CHUNK bytes."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    first = start[order]
    longest = int((end - start).max(initial=0))
    with np.errstate(over="ignore"):
        size = min(_CHUNK, len(data)) + longest + 1
        power = np.cumprod(np.full(size, M1))
        inverse = np.cumprod(np.full(size, np.uint64(pow(int(M1), -1, 1 << 64))))
        for lo in range(0, len(data) + 1, _CHUNK):
            rows = order[np.searchsorted(first, lo) : np.searchsorted(first, lo + _CHUNK)]
            if not len(rows):
                continue
            part = data[lo : lo + _CHUNK + longest]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])])
            h = (sums[end[rows] - lo] - sums[start[rows] - lo]) * inverse[start[rows] - lo]
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def _digits(rows: np.ndarray) -> np.ndarray:
    """Bytes by row as big-endian numbers of 8 bytes."""
    n, width = rows.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").astype(np.uint64)


def radix_order(group: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Order by group and then digits, most significant first.  A pass sorts only what still shares its class."""
    order = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)  # of the class's first member
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    place[order] = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    open_ = np.arange(len(group))
    for d in digits:
        open_ = open_[np.bincount(place[open_], minlength=len(group))[place[open_]] > 1]
        if not len(open_):
            break
        o = open_[np.lexsort((d[open_], place[open_]))]
        c, x = place[o], d[o]
        head = np.ones(len(o), bool)
        head[1:] = c[1:] != c[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
        sub = head.copy()
        sub[1:] |= x[1:] != x[:-1]
        place[o] = c + np.maximum.accumulate(np.where(sub, np.arange(len(o)), 0)) - start
    return np.argsort(place, kind="stable")


def _common(rows: np.ndarray, have: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix length of each row in order with the one before it; -1 across groups."""
    a, b = order[1:], order[:-1]
    out = np.empty(len(order), np.int64)
    out[:1] = -1
    for lo in range(0, len(a), 1 << 14):
        x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
        differ = rows[x] != rows[y]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1 + lo : 1 + lo + len(x)] = np.where(group[x] == group[y], np.minimum(n, np.minimum(have[x], have[y])), -1)
    return out


def earlier_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, have_l: np.ndarray, have_r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows are occurrences of anchors in text order within each group of equal anchors.  For windows that reach d bytes
    before their anchor and reach - d after it: (row, lowest d, highest d) of runs that an earlier row of the group has."""
    n, reach = left.shape
    if not n:
        return (np.zeros(0, np.int64),) * 3
    dl = [*_digits(left).T, have_l.astype(np.uint64)]
    dr = [*_digits(right).T, have_r.astype(np.uint64)]
    # rows with the whole context of an earlier row are done
    full = radix_order(group, [*dr, *dl])
    same = np.zeros(n, bool)
    same[1:] = (group[full[1:]] == group[full[:-1]]) & (have_l[full[1:]] == have_l[full[:-1]]) & (have_r[full[1:]] == have_r[full[:-1]])
    cand = np.flatnonzero(same)
    for lo in range(0, len(cand), 1 << 14):
        x, y = full[cand[lo : lo + (1 << 14)]], full[cand[lo : lo + (1 << 14)] - 1]
        same[cand[lo : lo + (1 << 14)]] = (left[x] == left[y]).all(axis=1) & (right[x] == right[y]).all(axis=1)
    low_d, high_d = reach - have_r.astype(np.int64), have_l.astype(np.int64)  # windows inside the document
    done = full[same]
    done = done[low_d[done] <= high_d[done]]
    out = [(done, low_d[done], high_d[done])]
    rest = np.sort(full[~same])
    size = np.bincount(group[rest], minlength=int(group.max()) + 1)
    rest = rest[size[group[rest]] > 1]
    if not len(rest):
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    two = rest[size[group[rest]] == 2]
    a, b = two[0::2], two[1::2]
    if len(a):
        pair = np.stack([a, b], axis=1).reshape(-1)
        own = np.repeat(np.arange(len(a)), 2)
        every = np.arange(len(pair))
        lcl = _common(left[pair], have_l[pair].astype(np.int64), every, own)[1::2]
        lcr = _common(right[pair], have_r[pair].astype(np.int64), every, own)[1::2]
        hit = reach - lcr <= lcl
        out.append((b[hit], (reach - lcr)[hit], lcl[hit]))
    many = rest[size[group[rest]] > 2]
    if len(many):
        g, m = group[many], len(many)
        sides = []
        for rows, have, digits in ((left, have_l, dl), (right, have_r, dr)):
            order = radix_order(g, [d[many] for d in digits])
            sides.append((order, _common(rows[many], have[many].astype(np.int64), order, g)))
        hit = np.zeros((m, reach + 1), bool)
        cls = np.empty((2, m), np.int64)
        for d in range(reach + 1):
            for s, depth in ((0, d), (1, reach - d)):
                order, common = sides[s]
                cls[s][order] = np.cumsum(common < depth)
            ok = np.flatnonzero((low_d[many] <= d) & (d <= high_d[many]))
            key = cls[0][ok] * (m + 1) + cls[1][ok]
            o = np.argsort(key, kind="stable")
            again = np.zeros(len(o), bool)
            again[1:] = key[o][1:] == key[o][:-1]
            hit[ok[o[again]], d] = True
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        out.append((many[r], lo, hi - 1))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


# Numbers travel packed: a row is a bucket or block, a kind, and one binary of arrays.


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of a _pack; kinds: dtype and row width of each."""
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = len(body) // sum(np.dtype(d).itemsize * w for d, w in kinds)
    out, at = [], 0
    for d, w in kinds:
        size = n * w * np.dtype(d).itemsize
        a = np.frombuffer(body, d, n * w, at)
        out.append(a.reshape(n, w) if w > 1 else a)
        at += size
    return out


def _unpack_all(blobs: Iterator[bytes], *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of all blobs, one after another; only one blob at a time is unpacked beside them."""
    blobs = list(blobs)
    n = np.cumsum([0] + [int.from_bytes(x[:8], "little") for x in blobs]) // sum(np.dtype(d).itemsize * w for d, w in kinds)
    out = [np.empty((n[-1], w) if w > 1 else n[-1], d) for d, w in kinds]
    for i, x in enumerate(blobs):
        for a, part in zip(out, _unpack(x, *kinds), strict=True):
            a[n[i] : n[i + 1]] = part
        blobs[i] = b""
    return out


_ROWS = pa.schema({"to": pa.int64(), "kind": pa.int8(), "block": pa.int64(), "blob": pa.binary()})
_SQL = "to long, kind byte, block long, blob binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ROWS.names, r, strict=True)) for r in rows], schema=_ROWS)


def _split(to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(to[part[0]]), [a[part] for a in arrays]


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans of each document (a number or a sortable pair packed to one)."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    _, dense = np.unique(doc, return_inverse=True)
    far = dense.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + far[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], start[head], (reach - far)[np.append(head[1:], len(doc)) - 1]


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) dealt to blocks (column _block), and packed spans (to: the block) of what repeats."""
    if threshold < 16 or threshold > 500:
        raise ValueError("thresholds from 16 to 500 bytes are supported")
    spark = docs.sparkSession
    k = threshold // 2
    reach = threshold - k
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-total // block_bytes))
    blocked = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    bucket = lambda h: (h % np.uint64(n)).astype(np.int64)

    def send_hashes(t: pa.Table) -> pa.Table:
        own = t["_block"][0].as_py()
        b = Block(t, "doc_id", "text")
        doc, pos, val = b.anchors(threshold)
        order = np.argsort(val, kind="stable")
        v = val[order]
        head = np.ones(len(v), bool)
        head[1:] = v[1:] != v[:-1]
        start = np.flatnonzero(head)
        times = np.diff(np.append(start, len(v)))
        # different contexts of the strings that occur often here; of others, occurrences bound them
        most = times.copy()
        for i in np.flatnonzero(times > 64):
            rows = order[start[i] : start[i] + times[i]]
            most[i] = len(np.unique(b.context_keys(doc[rows], pos[rows], threshold)))
        v, most = v[start], np.minimum(most, 65535).astype(np.uint16)
        return _rows([(to, 0, own, _pack(h, c)) for to, (h, c) in _split(bucket(v), v, most)])

    def return_repeated(t: pa.Table) -> pa.Table:
        own, h, c = [], [], []
        for block, blob in zip(t["block"].to_pylist(), t["blob"].to_pylist(), strict=True):
            x, y = _unpack(blob, ("<u8", 1), ("<u2", 1))
            own.append(np.full(len(x), block))
            h.append(x)
            c.append(y)
        own, h, c = np.concatenate(own), np.concatenate(h), np.concatenate(c).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, own, c = h[order], own[order], c[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        many = np.bincount(group)[group] > 1
        crowded = (np.bincount(group, weights=c)[group] > hot)[many]
        return _rows([(to, 0, to, _pack(x, y)) for to, (x, y) in _split(own[many], h[many], crowded.astype(np.uint8))])

    def send_contexts(t: pa.Table, back: pa.Table) -> pa.Table:
        if not len(t):
            return _rows([])
        own = t["_block"][0].as_py()
        b = Block(t, "doc_id", "text")
        doc, pos, val = b.anchors(threshold)
        known = [_unpack(x, ("<u8", 1), ("u1", 1)) for x in back["blob"].to_pylist()]
        shared = np.concatenate([x for x, _ in known]) if known else np.zeros(0, np.uint64)
        crowd = np.concatenate([y for _, y in known]) if known else np.zeros(0, np.uint8)
        order = np.argsort(shared)
        shared, crowd = shared[order], crowd[order]
        at = np.minimum(np.searchsorted(shared, val), max(0, len(shared) - 1))
        out_there = shared[at] == val if len(shared) else np.zeros(len(val), bool)
        _, group, times = np.unique(val, return_inverse=True, return_counts=True)
        pick = np.flatnonzero(out_there | (times[group] > 1))
        pick = pick[np.lexsort((pos[pick], val[pick]))]  # text order within an anchor
        doc, pos, val, out_there = doc[pick], pos[pick], val[pick], out_there[pick]
        is_hot = out_there & (crowd[at[pick]] > 0) if len(shared) else out_there
        _, group = np.unique(val, return_inverse=True)
        rows: list[tuple] = []
        known_again = b.again(doc, pos, group, threshold)
        if known_again.any():
            d, p = doc[known_again], pos[known_again]
            have_l, have_r = b.reaches(d, p, threshold)
            fits = have_l + have_r >= reach
            d, p, have_l, have_r = d[fits], p[fits], have_l[fits], have_r[fits]
            spans = [_merge(d, p - b.begin[d] - have_l, p - b.begin[d] - reach + have_r + threshold)]
            doc, pos, val, out_there, is_hot = (x[~known_again] for x in (doc, pos, val, out_there, is_hot))
            _, group = np.unique(val, return_inverse=True)
        else:
            spans = [(np.zeros(0, np.int64),) * 3]
        firsts = []
        for lo, hi in _runs(group, SLICE):
            left, right, have_l, have_r = b.contexts(doc[lo:hi], pos[lo:hi], threshold)
            g = group[lo:hi] - group[lo]
            r, d0, d1 = earlier_windows(g, left, right, have_l, have_r)
            r = r + lo
            spans.append((doc[r], pos[r] - b.begin[doc[r]] - d1, pos[r] - b.begin[doc[r]] - d0 + threshold))
            # contexts that are all there earlier in this block needn't travel
            whole = np.zeros(hi - lo, bool)
            whole[(r - lo)[(d0 == reach - have_r[r - lo].astype(np.int64)) & (d1 == have_l[r - lo])]] = True
            send = np.flatnonzero(~whole & out_there[lo:hi])
            firsts.append(lo + send[~is_hot[lo:hi][send]])
            warm = send[is_hot[lo:hi][send]]
            if len(warm):
                rows += _hot_rows(b, own, doc[lo:hi][warm], pos[lo:hi][warm], have_l[warm], have_r[warm])
        if firsts:
            at = np.concatenate(firsts)
            at = at[np.argsort(bucket(val[at]), kind="stable")]
            for lo, hi in _runs(bucket(val[at]), SLICE):  # made again, as those of the whole block are many times its size
                h, d, p = val[at[lo:hi]], doc[at[lo:hi]], pos[at[lo:hi]]
                left, right, have_l, have_r = b.contexts(d, p, threshold)
                for to, x in _split(bucket(h), h, _window_hash(b.data, p, k), b.ids[d], b.seq[d], (p - b.begin[d]).astype(np.int32), have_l, have_r, left, right):
                    rows.append((to, 1, own, _pack(*x)))
        d, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
        d, s, e = _merge(d, s, e)
        if len(d):
            rows.append((own, 3, own, _pack(b.ids[d], b.seq[d], s.astype(np.int32), e.astype(np.int32))))
        return _rows(rows)

    def _window_hash(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """A second, unrelated hash of the strings at start, so that equal ones agree in 128 bits."""
        with np.errstate(over="ignore"):
            acc = np.full(len(start), M1, np.uint64)
            for j in range(width):
                acc = (acc ^ data[start + j].astype(np.uint64)) * M2
                acc ^= acc >> np.uint64(31)
        return acc

    def _hot_rows(b: Block, own: int, doc: np.ndarray, pos: np.ndarray, have_l: np.ndarray, have_r: np.ndarray) -> list[tuple]:
        d = np.arange(reach + 1)
        row, off = np.nonzero((d <= have_l[:, None]) & (reach - d <= have_r[:, None]))
        doc, start = doc[row], pos[row] - off
        h, check = _window_hash(b.data, start, threshold), _window_hash(b.data[::-1], len(b.data) - start - threshold, threshold)
        order = np.lexsort((start, check, h))
        h, check, doc, start = h[order], check[order], doc[order], start[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        h, check, doc, start = h[new], check[new], doc[new], start[new]  # in one block, later ones are known as such
        return [(to, 2, own, _pack(*x)) for to, x in _split(bucket(h), h, check, b.ids[doc], b.seq[doc], (start - b.begin[doc]).astype(np.int32))]

    head = [("<u8", 1), ("<u8", 1), ("<i8", 1), ("<i4", 1), ("<i4", 1)]

    def sort_bucket(t: pa.Table) -> pa.Table:
        kinds, blocks, blobs = t["kind"].to_numpy(), t["block"].to_numpy(), t["blob"]
        out = [(int(blocks[i]), 3, int(blocks[i]), blobs[i].as_py()) for i in np.flatnonzero(kinds == 3)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for kind, more in ((1, [("u1", 1), ("u1", 1), ("u1", reach), ("u1", reach)]), (2, [])):
            at = np.flatnonzero(kinds == kind)
            if not len(at):
                continue
            width = sum(np.dtype(d).itemsize * w for d, w in [*head, *more])
            block = np.repeat(blocks[at], [int.from_bytes(blobs[int(i)].as_py()[:8], "little") // width for i in at])
            cols = _unpack_all((blobs[int(i)].as_py() for i in at), *head, *more)
            h, check, ids, seq, pos = cols[:5]
            order = np.lexsort((pos, seq, ids, check, h))
            h, check = h[order], check[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            group = np.cumsum(new) - 1
            if kind == 2:
                r = order[~new]
                found.append((block[r], ids[r], seq[r], pos[r].astype(np.int64), pos[r].astype(np.int64) + threshold))
                continue
            keep = np.bincount(group)[group] > 1
            order, group = order[keep], group[keep]
            for lo, hi in _runs(group, SLICE):
                o = order[lo:hi]
                have_l, have_r, left, right = (c[o] for c in cols[5:])
                r, d0, d1 = earlier_windows(group[lo:hi] - group[lo], left, right, have_l, have_r)
                r = o[r]
                found.append((block[r], ids[r], seq[r], pos[r] - d1, pos[r] - d0 + threshold))
        block, ids, seq, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        out += [(to, 3, to, _pack(i, s, a.astype(np.int32), e.astype(np.int32))) for to, (i, s, a, e) in _split(block, ids, seq, start, end)]
        return _rows(out)

    sent = blocked.groupBy("_block").applyInArrow(tidy_groups(send_hashes), _SQL)
    back = sent.groupBy("to").applyInArrow(tidy_groups(return_repeated), _SQL)
    contexts = blocked.groupBy("_block").cogroup(back.groupBy("to")).applyInArrow(tidy_groups(send_contexts), _SQL)
    return blocked, contexts.groupBy("to").applyInArrow(tidy_groups(sort_bucket), _SQL)


def _runs(group: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Slices of about so many rows that don't cut a group; group is ascending."""
    lo = 0
    while lo < len(group):
        hi = min(lo + rows, len(group))
        if hi < len(group):
            back = int(np.searchsorted(group, group[hi], "left"))
            hi = back if back > lo else int(np.searchsorted(group, group[hi], "right"))
        yield lo, hi
        lo = hi


def cut_repeats(docs: DataFrame, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """docs (doc_id, text and any other columns): every row with _n_bytes, _starts, _ends (removed runs) and _kept (binary; with
    as_text a string without the characters that a run's end cuts through).

    A byte goes if a string of threshold bytes covers it that also starts earlier: in a smaller doc_id, or earlier in
    the same document.  Rows of one doc_id are ordered by text, so that of repeated rows the first stays; null ids come
    last.  Null texts count as empty; texts shorter than the threshold stay whole; an empty table gives an empty result.  Columns of docs
    with the names of added ones, or _block, are replaced or go.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("_block", "_n_bytes", "_starts", "_ends", "_kept")])
    blocked, spans = repeated_spans(docs, threshold, block_bytes, hot)
    add = {"_n_bytes": pa.int64(), "_starts": pa.list_(pa.int64()), "_ends": pa.list_(pa.int64()), "_kept": pa.string() if as_text else pa.binary()}

    def cut(t: pa.Table, got: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({**{f.name: pa.array([], f.type) for f in t.drop_columns(["_block"]).schema}, **{c: pa.array([], k) for c, k in add.items()}})
        b = Block(t, "doc_id", "text")
        parts = [_unpack(x, ("<i8", 1), ("<i4", 1), ("<i4", 1), ("<i4", 1)) for x in got["blob"].to_pylist()]
        starts, ends, kept = ([[] for _ in b.texts] for _ in range(3))
        if parts:
            ids, seq, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = np.searchsorted(b.ids, ids, "left") + seq
            for i, s, e in zip(*(x.tolist() for x in _merge(doc, start.astype(np.int64), end.astype(np.int64))), strict=True):
                starts[i].append(s)
                ends[i].append(e)
        for i, x in enumerate(b.texts):
            kept[i] = b"".join(x[p:q] for p, q in zip([0, *ends[i]], [*starts[i], len(x)], strict=True))
            if as_text:
                kept[i] = kept[i].decode("utf-8", "ignore")
        cols = [b.size.tolist(), starts, ends, kept]
        out = t.take(pa.array(b.order)).drop_columns(["_block"])
        for (name, kind), values in zip(add.items(), cols, strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", _n_bytes long, _starts array<long>, _ends array<long>, _kept " + ("string" if as_text else "binary")
    return blocked.groupBy("_block").cogroup(spans.groupBy("to")).applyInArrow(tidy_groups(cut), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    removed = F.aggregate(F.zip_with("_starts", "_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_starts").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
