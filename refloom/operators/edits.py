"""Pairs of texts that few edits part, found a block of texts against a block at a time.

Characters become one of CODES numbers.  Where two share a number texts only come closer, so no pair is missed; `sure` says that none did.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CODES = 64
#: Numbers of their own have space, a to z and 0 to 9, those below OWN.
OWN = 37
#: Pairs of codes are told apart by numbers below this.
PAIRS = OWN * OWN
_PLAIN = np.array([0 if c == 32 else c - 96 if 97 <= c <= 122 else c - 21 if 48 <= c <= 57 else OWN + c % (CODES - OWN) for c in range(128)], np.uint8)
#: Texts of a block that are held against at once, pairs that are looked at together, and bits of a word.
TILE, CHUNK, WORD = 8192, 8192, 64
#: Characters of the longest texts whose places are held in bits, which takes room for each place.
LONG = 2048
#: A block's texts times its longest one's length: at least, at most; and the blocks that texts are dealt into between these.
LEAST, MOST, BLOCKS = 1 << 15, 1 << 22, 16


def allowed(n, ratio: float):
    """The edits that a pair may have of which the longer text has n characters."""
    return np.floor((1 - ratio) * n + 1e-6).astype(np.int64)


def dealt(counts: list[tuple], ratio: float) -> tuple[int, dict]:
    """The number of blocks, and of each (value, open, length) the first of its blocks, how many it has and the blocks that these meet, for counts of
    (value, open, length, rows).

    Blocks hold texts of one value and about one length.  A length with many texts has blocks of its own, of which a text goes to one.  Blocks meet
    if they have one value and lengths that allow it, and if one of them is open.
    """
    of: dict = {}
    for value, free, n, c in counts:
        of.setdefault(value, {}).setdefault(free, []).append((n, c))
    out, at = {}, 0
    for value, kinds in of.items():
        most = min(MOST, max(LEAST, sum((n + 1) * c for lengths in kinds.values() for n, c in lengths) // BLOCKS))
        start, blocks = at, []  # of each: whether it is open, its shortest and longest length
        for free, lengths in kinds.items():
            held = 0
            for n, c in sorted(lengths):
                parts = min(c, -(-c * (n + 1) // most))
                if held and (held + c) * (n + 1) <= most:
                    held, blocks[-1] = held + c, (*blocks[-1][:2], n)
                    out[value, free, n] = (start + len(blocks) - 1, 1)
                else:
                    out[value, free, n] = (start + len(blocks), parts)
                    held = c if parts == 1 else 0
                    blocks += [(free, n, n)] * parts
        free, low, high = map(np.array, zip(*blocks, strict=True))
        for (of_value, kind, n), (first, parts) in [x for x in out.items() if x[0][0] == value]:
            i = first - start
            meet = (free | kind) & (high[i] >= low - allowed(low, ratio)) & (high >= low[i] - allowed(low[i], ratio))
            out[of_value, kind, n] = (first, parts, (start + np.flatnonzero(meet)).tolist())
        at += len(blocks)
    return at, out


def placed(batches: Iterator[pa.RecordBatch], table: dict) -> Iterator[pa.RecordBatch]:
    """id, t, block and the blocks it meets of rows (id, t, w, open, n, h): h, any number, deals out the texts of a length."""
    for batch in batches:
        got = [table[k] for k in zip(*(batch.column(c).to_pylist() for c in ("w", "open", "n")), strict=True)]
        first, parts = np.array([x[:2] for x in got], np.int64).reshape(-1, 2).T
        block = first + batch.column("h").to_numpy() % parts
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(block), pa.array([x[2] for x in got], pa.list_(pa.int64()))], ["id", "t", "block", "others"])


class Texts:
    """Texts by length: codes (255 behind their ends), numbers of adjacent pairs of codes by place, counts of codes, whether all codes are their own."""

    def __init__(self, ids: np.ndarray, texts: pa.Array) -> None:
        n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(n, kind="stable")
        self.id, self.n = ids[order], n[order]
        chars = np.frombuffer("".join(texts.take(pa.array(order)).to_pylist()).encode("utf-32-le"), np.uint32)
        plain = chars < 128
        flat = np.where(plain, _PLAIN[np.where(plain, chars, 0)], OWN + chars % (CODES - OWN)).astype(np.uint8)
        inside = np.arange(self.n.max(initial=1)) < self.n[:, None]
        self.codes = np.full(inside.shape, 255, np.uint8)
        self.codes[inside] = flat
        row = np.repeat(np.arange(len(n)), self.n)
        self.counts = np.minimum(np.bincount(row * CODES + flat, minlength=len(n) * CODES), 255).astype(np.uint8).reshape(-1, CODES)
        self.own = np.bincount(row, flat >= OWN, minlength=len(n)) == 0
        c = np.ascontiguousarray(self.codes.T).astype(np.int16)
        self.two = np.where(c[1:] < CODES, c[:-1] % OWN * OWN + c[1:] % OWN, PAIRS).astype(np.int16)
        self.masks: np.ndarray | None = None

    def bits(self) -> np.ndarray:
        """Where each code stands in each text, in the first WORD characters, a bit a place."""
        if self.masks is None:
            self.masks = np.zeros((len(self.n), CODES + 1), np.uint64)
            rows = np.arange(len(self.n))
            for j in range(min(WORD, self.codes.shape[1])):
                self.masks[rows, np.minimum(self.codes[:, j], CODES)] |= np.uint64(1 << j)
        return self.masks


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags as bits of words; the last word ends in zeros."""
    return np.packbits(np.append(flags, np.zeros(-len(flags) % WORD, bool)), bitorder="little").view("<u8")


def _standing(b: Texts, here: slice) -> tuple[np.ndarray, np.ndarray]:
    """For each place, a row of bits for each pair of codes that the texts at here have, which of them have it there; and the pairs' rows, the last of which is empty."""
    two = b.two[: max(int(b.n[here][-1]) - 1, 0), here]
    there = np.zeros(PAIRS + 1, bool)
    there[two] = True
    there[-1] = False
    number = np.where(there, np.cumsum(there) - 1, int(there.sum()))
    bits = np.zeros((len(two), int(there.sum()) + 1, -(-two.shape[1] // WORD)), np.uint64)
    place, column = np.nonzero(two < PAIRS)
    np.add.at(bits.reshape(-1), (place * bits.shape[1] + number[two[place, column]]) * bits.shape[2] + column // WORD, np.uint64(1) << (column % WORD).astype(np.uint64))
    return bits, number


def _near(standing: np.ndarray, n: np.ndarray, m: np.ndarray, ratio: float) -> list[np.ndarray]:
    """For each second place of texts of n characters: a row of bits for each pair of codes, which of the texts of m have it where few edits can have moved it.

    With k edits, a pair of codes that moved by x has |x| edits before it at least and |m - n - x| behind.
    """
    k = allowed(np.maximum(m, n[-1]), ratio)
    back, ahead = int((-((n[-1] - m + k) // 2)).min()), int(((m - n[0] + k) // 2).max())
    return [np.bitwise_or.reduce(standing[max(s + back, 0) : max(s + ahead + 1, 0)], axis=0) for s in range(0, int(n[-1]) - 1, 2)]


def _sum(bits: list) -> list:
    """How many of bits are on at each place, as the bits of that number, lowest first."""
    out = []
    while bits:
        over = []
        while len(bits) > 1:
            x, y, z = bits.pop(), bits.pop(), bits.pop() if bits else None
            one = x ^ y
            over.append(x & y if z is None else (x & y) | (one & z))
            bits.append(one if z is None else one ^ z)
        out += bits
        bits = over
    return out


def _reaches(number: list, need: list, shape: tuple) -> np.ndarray:
    """Where a number is need at least, by the bits of both."""
    fine, none = np.full(shape, ~np.uint64(0)), np.zeros(shape[1], np.uint64)
    for bit in range(max(len(number), len(need))):
        has = number[bit] if bit < len(number) else none
        asked = need[bit] if bit < len(need) else none
        if asked.any():
            fine &= has | ~asked
            fine |= has & ~asked
        else:
            fine |= has
    return fine


def _distance(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits between texts i of a, of WORD characters at most, and texts j of b, by columns of bits (Myers 1999 in the form of Hyyrö 2003)."""
    one, order = np.uint64(1), np.argsort(-b.n[j], kind="stable")
    i, j = i[order], j[order]
    n, m = a.n[i], b.n[j]
    left = len(m) - np.searchsorted(m[::-1], np.arange(int(m[0]) if len(m) else 0), side="right")  # texts that go on at each place
    masks, row = a.bits().reshape(-1), i * (CODES + 1)
    top = np.maximum(n - 1, 0).astype(np.uint64)
    more, less, score = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), n.copy()
    for c, go in enumerate(left.tolist()):
        pv, mv = more[:go], less[:go]
        eq = masks[row[:go] + b.codes[j[:go], c]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:go] += ((ph >> top[:go]) & one).astype(np.int64) - ((mh >> top[:go]) & one).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        more[:go], less[:go] = mh | ~(xv | ph), ph & xv
    score = np.where(n == 0, m, score)
    out = np.empty(len(i), np.int64)
    out[order] = score
    return out


def _checked(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and whether it is sure, of the pairs that counts of codes and edits leave.  Pairs of texts that are both longer than a word are left to others."""
    for at in range(0, len(i), CHUNK):
        x, y = i[at : at + CHUNK], j[at : at + CHUNK]
        k = allowed(np.maximum(a.n[x], b.n[y]), ratio)
        p, q = a.counts[x], b.counts[y]
        total = lambda c: c.sum(1, dtype=np.uint16).astype(np.int64)
        fine = total(np.maximum(p, q)) - np.minimum(total(p), total(q)) <= k
        x, y, k = x[fine], y[fine], k[fine]
        short, other = a.n[x] <= WORD, b.n[y] <= WORD
        d = np.full(len(x), -1)
        d[short] = _distance(a, b, x[short], y[short])
        swap = other & ~short
        d[swap] = _distance(b, a, y[swap], x[swap])
        fine = d <= k
        yield x[fine], y[fine], (a.own[x] & b.own[y] & (d >= 0))[fine]


def close(a: Texts, b: Texts, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, sure: texts of a and of b, or i < j of a where b is a, that can have 1 - distance / longer length of at least ratio; none of these is missed.

    A text is cut into pairs of characters, of which an edit changes one at most: so of its n // 2 pairs all but k stand in a text within k
    edits, near their place.  Flags of texts that have a pair are added up, and counts of characters and edits are found for what they leave.
    """
    found: list[list[np.ndarray]] = [[], []]
    held = 0
    for here in _alike(b.n, TILE):
        m = b.n[here]
        standing, number = _standing(b, here) if m[-1] <= LONG else (None, None)
        for at in _alike(a.n, len(a.n)):
            n = a.n[at]
            if a is b and at.start >= here.stop or m[0] - allowed(m[0], ratio) > n[-1] or n[0] - allowed(n[0], ratio) > m[-1]:
                continue
            if standing is None or n[-1] > LONG:
                for i in range(at.start, at.stop):
                    j = here.start + np.flatnonzero(np.abs(m - a.n[i]) <= allowed(np.maximum(m, a.n[i]), ratio))
                    j = j[j > i] if a is b else j
                    yield from _checked(a, b, np.full(len(j), i), j, ratio)
                continue
            near, rows = _near(standing, n, m, ratio), number[a.two[: max(int(n[-1]) - 1, 0) : 2, at]]
            for first, last in _runs(n):
                k = allowed(np.maximum(m, n[first]), ratio)
                fits = np.abs(m - n[first]) <= k
                if not fits.any():
                    continue
                pieces = int(n[first]) // 2
                need = np.maximum(pieces - k, 0)
                need = [_packed((need >> bit & 1).astype(bool)) for bit in range(int(need.max()).bit_length())]
                fits = _packed(fits)
                step = max(1, CHUNK // len(fits) // 2)
                for i in range(first, min(last, here.stop - at.start) if a is b else last, step):
                    texts = slice(i, min(i + step, last))
                    hit = _reaches(_sum([has[r[texts]] for has, r in zip(near[:pieces], rows, strict=False)]), need, (texts.stop - i, len(fits))) & fits
                    row, word = np.nonzero(hit)
                    which, bit = np.nonzero(np.unpackbits(hit[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    x, y = at.start + i + row[which], here.start + word[which] * WORD + bit
                    if a is b:
                        x, y = x[x < y], y[x < y]
                    found[0].append(x)
                    found[1].append(y)
                    held += len(x)
                    if held > 16 * CHUNK:
                        yield from _checked(a, b, *map(np.concatenate, found), ratio)
                        found, held = [[], []], 0
    if held:
        yield from _checked(a, b, *map(np.concatenate, found), ratio)


def _alike(n: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of texts whose lengths, which rise, are about the same, of `most` texts at most, or fewer if they are longer than a word."""
    start = 0
    while start < len(n):
        few = max(1, most * WORD // max(WORD, int(n[start])))
        end = min(int(np.searchsorted(n, n[start] + max(1, n[start] // 16), side="right")), start + few)
        yield slice(start, end)
        start = end


def _runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of one number start and end."""
    ends = (np.flatnonzero(np.append(n[1:] != n[:-1], True)) + 1).tolist()
    return zip([0, *ends[:-1]], ends, strict=True)


def pairs(table: pa.Table, ratio: float) -> pa.Table:
    """a, b, sure: by id, the pairs of close() of two blocks of rows (second, id, t), or of one block if there is no second."""
    table = table.combine_chunks()
    second = table.column("second").to_numpy()
    side = lambda which: Texts(table.column("id").to_numpy()[which], table.column("t").combine_chunks().take(pa.array(np.flatnonzero(which))))
    a = side(~second)
    b = side(second) if second.any() else a
    empty = np.zeros(0, np.int64)
    got = [(a.id[i], b.id[j], s) for i, j, s in close(a, b, ratio)] if len(a.n) and len(b.n) else []
    x, y, s = map(np.concatenate, zip((empty, empty, empty.astype(bool)), *got, strict=True))
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": s})
