"""Encoding of whole texts through a bounded cache of small units.

Pre-tokenisers of the byte-level BPE family never join a non-space to a
following space, a letter to a following full stop, or a line break to a
following letter.  So a text may be cut before a space between two non-spaces,
between an ASCII letter and one of ``.,;:!?`` or a line break, and between a
lone line break and an ASCII letter: the ids of the parts, joined, are the ids
of the text.  Parts repeat, so a task encodes each distinct part once and
copies its ids; cutting, hashing, look-up and copying are vectorised.

A cut is made only where both neighbours are surely no white space (in doubt
the part is just longer).  The cache is emptied when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from statline.llm import sequences as S

CACHE_UNITS = 1_200_000
CACHE_IDS = 8_000_000
CHUNK = 1 << 21

# Bytes next to a cut: printable ASCII or part of a longer character.
_SURE = np.zeros(256, dtype=bool)
_SURE[0x21:0x7F] = True
_SURE[0x80:] = True
# Lead bytes of all white space outside ASCII.
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?\n")] = True


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray):
    """The ranges of ``values``, one after the other, and their offsets."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], length)
    at += np.arange(offsets[-1])
    return values[at], offsets


def cut_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units: row starts and sure cuts."""
    rows = offsets[:-1][np.diff(offsets) > 0]
    n = len(buf)
    if n < 3:
        return rows
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    before, after = buf[at - 1], buf[at + 1]
    sure = _SURE[before] & _SURE[after] & ~_MAYBE_SPACE[after]
    high = before >= 0x80
    sure &= ~(high & ((buf[np.maximum(at - 2, 0)] == 0xC2)
                      | _MAYBE_SPACE[buf[np.maximum(at - 3, 0)]]))
    at = at[sure]
    # a space that begins or ends its row has no neighbour there
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    at = at[~edge[at + 1]]
    cut = np.zeros(n, dtype=bool)
    cut[rows] = cut[at] = True
    letter = _LETTER[buf]
    cut[1:] |= letter[:-1] & _STOP[buf[1:]]
    at = np.flatnonzero((buf[1:-1] == 0x0A) & letter[2:]) + 2
    before = buf[at - 2]
    cut[at[(before > 0x20) & (before < 0x7F) & ~edge[at - 1]]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Ids of whole texts from an encoder of parts.

    ``encode_text(text)`` gives the ids of one text, ``encode_parts(texts)`` a
    list of ids for each, and ``bytes_of[id]`` the bytes of an id.  New units
    that may stand next to each other are encoded as one text, and the bytes
    of the ids show where each unit ends.

    The cache is a table sorted by the unit's hash, beside its length and first
    bytes, which must agree as well.
    """

    def __init__(self, encode_text: Callable[[str], np.ndarray],
                 encode_parts: Callable[[list[str]], list], bytes_of: np.ndarray,
                 units: int = CACHE_UNITS, ids: int = CACHE_IDS):
        self.encode_text, self.encode_parts, self.bytes_of = encode_text, encode_parts, bytes_of
        self.units, self.ids = units, ids
        self._clear()

    def _clear(self) -> None:
        self.key, self.head = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Ids of the units, one after the other, and their numbers of ids."""
        n = len(buf)
        before, last = buf[np.maximum(end - 2, 0)], buf[end - 1]
        second = buf[np.minimum(start + 1, n - 1)]
        inner = (last > 0x20) & (last < 0x7F) | (last >= 0x80) & (end - start > 3) & (
            before != 0xC2) & ~_MAYBE_SPACE[buf[np.maximum(end - 3, 0)]]
        safe = (end - start > 1) & (buf[start] == 0x20) & (second > 0x20) & (second < 0x7F) & inner
        lengths = np.zeros(len(start), dtype=np.int64)
        size = end - start
        flat = np.zeros(0, np.uint32)
        if safe.any():
            raw, _ = gather(buf, start[safe], size[safe])
            flat = self.encode_text(raw.tobytes().decode())
            done, want = np.cumsum(self.bytes_of[flat]), np.cumsum(size[safe])
            at = np.minimum(np.searchsorted(done, want), len(flat) - 1)
            if (done[at] == want).all():
                lengths[safe] = np.diff(at, prepend=-1)
            else:  # cannot happen for sure cuts; the units are then encoded alone
                flat, safe = np.zeros(0, np.uint32), np.zeros(len(start), dtype=bool)
        text = buf.tobytes()
        alone = self.encode_parts([text[x:y].decode() for x, y in zip(
            start[~safe].tolist(), end[~safe].tolist(), strict=True)])
        lengths[~safe] = [len(x) for x in alone]
        out = np.empty(int(lengths.sum()), dtype=np.uint32)
        mine = np.repeat(safe, lengths)
        out[mine] = flat
        out[~mine] = np.fromiter((i for x in alone for i in x), np.uint32, len(out) - len(flat))
        return out, lengths

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray):
        starts = cut_points(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(buf))
        hashes = S.Hasher(S.BYTE_VALUES[buf]).ranges(starts, ends)
        key, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        head = (b - a).astype(np.uint64)
        for i in range(4):
            head = head << np.uint64(8) | np.where(
                a + i < b, buf[np.minimum(a + i, len(buf) - 1)], 0).astype(np.uint64)
        if len(self.key) + len(key) > self.units or self.used > self.ids:
            self._clear()
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(0, len(self.key) - 1))
        if len(self.key):
            same = self.key[near] == key
            known = same & (self.head[near] == head)
            start, length = self.start[near], self.length[near].astype(np.int64)
        else:
            same = known = np.zeros(len(key), dtype=bool)
            start, length = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            ids, lengths = self._encode(buf, a[new], b[new])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used:self.used + len(ids)] = ids
            start[new] = self.used + np.cumsum(lengths) - lengths
            length[new] = lengths
            self.used += len(ids)
            add = np.flatnonzero(~same)
            for name, values in (("key", key), ("head", head), ("start", start),
                                 ("length", length.astype(np.int32))):
                setattr(self, name, np.insert(getattr(self, name), at[add], values[add]))
        ids, ends_of_units = gather(self.pool, start[back], length[back])
        return ids, ends_of_units[np.searchsorted(starts, offsets)]

    def texts(self, buf: np.ndarray, offsets: np.ndarray):
        """Ids of all rows, one after the other, and the offsets of the rows."""
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in S.chunks(offsets, CHUNK):
            ids, off = self._chunk(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            parts.append(ids)
            lengths.append(np.diff(off))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
