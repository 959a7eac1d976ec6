"""Quotient filters in numpy: sorted fingerprints stored as remainders with three metadata bits a slot.

A fingerprint of quotient and remainder bits sits at the first free slot from its quotient on. The bits say
whether a slot's number is the quotient of some entry (occupied), whether the slot continues the run of the
slot before (continuation) and whether its entry was pushed from its own slot (shifted). Runs past the last
quotient extend the table instead of wrapping round. Each entry has a payload, kept as the offset from the
least one in as many bits as the widest needs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<BBBIqI")  # quotient bits, remainder bits, payload bits, entries, least payload, slots
_ONE = np.uint64(1)


def pack(values: np.ndarray, bits: int) -> bytes:
    """Unsigned integers in ``bits`` bits each, and eight bytes behind them so that any can be read as a word."""
    if not len(values) or not bits:
        return b"\0" * 8
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & _ONE).astype(np.uint8).ravel(), bitorder="little").tobytes() + b"\0" * 8


def at(packed: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    """Some of the packed integers (of at most 57 bits) by their index: one unaligned word each."""
    if not bits:
        return np.zeros(len(index), np.uint64)
    first = index.astype(np.int64) * bits
    words = packed[(first >> 3)[:, None] + np.arange(8)].view("<u8").ravel().astype(np.uint64)
    return (words >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)


def least_per_fingerprint(prints: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, each with the least payload among its occurrences."""
    order = np.lexsort((payload, prints))
    prints, payload = prints[order], payload[order]
    first = np.ones(len(prints), bool)
    first[1:] = prints[1:] != prints[:-1]
    return prints[first], payload[first]


def encode(prints: np.ndarray, payload: np.ndarray, quotient_bits: int, remainder_bits: int) -> bytes:
    """A filter of sorted distinct fingerprints below 2^(quotient_bits + remainder_bits)."""
    n = len(prints)
    q = (prints >> np.uint64(remainder_bits)).astype(np.int64)
    i = np.arange(n)
    slot = i + np.maximum.accumulate(q - i) if n else i
    slots = max(1 << quotient_bits, int(slot[-1]) + 1 if n else 0)
    occupied, continuation, shifted = (np.zeros(slots, bool) for _ in range(3))
    occupied[q] = True
    continuation[slot[1:]] = q[1:] == q[:-1]
    shifted[slot] = slot != q
    remainders = np.zeros(slots, np.uint64)
    remainders[slot] = prints & np.uint64((1 << remainder_bits) - 1)
    low = int(payload.min()) if n else 0
    wide = int(int(payload.max()) - low).bit_length() if n else 0
    if wide > 57:
        raise ValueError("payloads of one filter lie too far apart")
    marks = b"".join(np.packbits(x, bitorder="little").tobytes() for x in (occupied, continuation, shifted))
    return _HEAD.pack(quotient_bits, remainder_bits, wide, n, low, slots) + marks + pack(remainders, remainder_bits) + pack((payload - low).astype(np.uint64), wide)


@dataclass
class Slots:
    """A filter opened for reading: its marks as bits, remainders and payloads still packed."""

    quotient_bits: int
    remainder_bits: int
    wide: int
    entries: int
    low: int
    occupied: np.ndarray
    continuation: np.ndarray
    used: np.ndarray
    remainders: np.ndarray
    payloads: np.ndarray

    @classmethod
    def open(cls, blob: bytes) -> Slots:
        quotient_bits, remainder_bits, wide, n, low, slots = _HEAD.unpack_from(blob)
        here, size, marks = _HEAD.size, -(-slots // 8), []
        for _ in range(3):
            marks.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, here), count=slots, bitorder="little").astype(bool))
            here += size
        rest = np.frombuffer(blob, np.uint8, -1, here)
        cut = -(-slots * remainder_bits // 8) + 8
        # a slot is in use if it is shifted, continues a run, or starts the run of its own quotient
        return cls(quotient_bits, remainder_bits, wide, n, low, marks[0], marks[1], marks[0] | marks[1] | marks[2], rest[:cut], rest[cut:])

    def payload(self, entry: np.ndarray) -> np.ndarray:
        return at(self.payloads, entry, self.wide).astype(np.int64) + self.low

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in order, with their payloads."""
        slot = np.flatnonzero(self.used)
        run = np.cumsum(~self.continuation[slot]) - 1
        q = np.flatnonzero(self.occupied)[run] if len(slot) else slot  # the k-th run is that of the k-th occupied quotient
        return (q.astype(np.uint64) << np.uint64(self.remainder_bits)) | at(self.remainders, slot, self.remainder_bits), self.payload(np.arange(len(slot)))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each wanted fingerprint whether it is stored, and its payload (0 where it isn't).

        The rank of a quotient among the occupied ones is the number of its run, whose slots are then
        walked one by one for all wanted at once; nothing else of the filter is unpacked.
        """
        hit, found = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        if not self.entries or not len(wanted):
            return hit, found
        q = (wanted >> np.uint64(self.remainder_bits)).astype(np.int64)
        r = wanted & np.uint64((1 << self.remainder_bits) - 1)
        heads = np.append(np.flatnonzero(self.used & ~self.continuation), len(self.used))
        rank = np.cumsum(self.occupied)
        left = np.flatnonzero(self.occupied[q])
        slot = heads[rank[q[left]] - 1]
        entry_of = np.cumsum(self.used)
        while len(left):
            same = at(self.remainders, slot, self.remainder_bits) == r[left]
            hit[left[same]] = True
            found[left[same]] = self.payload(entry_of[slot[same]] - 1)
            slot = slot + 1
            on = ~same & (slot < len(self.used))
            left, slot = left[on], slot[on]
            on = self.continuation[slot]
            left, slot = left[on], slot[on]
        return hit, found


def merge(a: bytes, b: bytes) -> bytes:
    """Both filters in one out of their sorted fingerprints; one in both keeps the lesser payload. The widths must agree."""
    x, y = Slots.open(a), Slots.open(b)
    if (x.quotient_bits, x.remainder_bits) != (y.quotient_bits, y.remainder_bits):
        raise ValueError("filters of different widths")
    (pa, la), (pb, lb) = x.sorted(), y.sorted()
    # an entry's place is its own rank and the number of entries of the other list before it
    prints, payload = np.empty(len(pa) + len(pb), np.uint64), np.empty(len(pa) + len(pb), np.int64)
    ia = np.arange(len(pa)) + np.searchsorted(pb, pa, "left")
    ib = np.arange(len(pb)) + np.searchsorted(pa, pb, "right")
    prints[ia], payload[ia] = pa, la
    prints[ib], payload[ib] = pb, lb
    if not len(prints):
        return a
    start = np.ones(len(prints), bool)
    start[1:] = prints[1:] != prints[:-1]
    return encode(prints[start], np.minimum.reduceat(payload, np.flatnonzero(start)), x.quotient_bits, x.remainder_bits)


def lookup(blob: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted fingerprint whether it is stored, and its payload (0 where it isn't)."""
    return Slots.open(blob).find(wanted)
