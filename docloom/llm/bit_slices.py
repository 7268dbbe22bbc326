"""Bit planes of fingerprints: many Hamming distances at once, by carry-save counters that abandon what is too far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a fingerprint and a block of 64 that are compared at a time.
STEP = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def votes(hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of the n big-endian hashes have each bit; in blocks, so memory doesn't grow with the text."""
    out, step = np.zeros(64, np.int64), 1 << 14
    for i in range(0, n, step):
        bits = np.unpackbits(hashes[8 * i : 8 * (i + step)]).reshape(-1, 64)
        out += bits.sum(axis=0, dtype=np.int32)
    return out


def sliced_links(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), first[i] <= i < j < last[i], of fingerprints within radius; first is where i's bucket starts.

    The fingerprints are stored as 64 vertical bit planes, 64 fingerprints a word.  Each one is compared with the words
    up to last[i]: the differing bits of 64 fingerprints at once go through a carry-save counter (ones, twos, and as
    many more planes as the radius needs, and a flag for what passes them); words whose lanes have all passed the radius
    are abandoned every few planes.
    """
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8)).reshape(-1, 64, 8 * 8)  # word, lane, bit from the top
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0].astype(np.uint64)
    i = np.arange(n)
    w0, w1 = (i + 1) // 64, (np.maximum(last, i + 1) - 1) // 64
    spans = np.where(last > i + 1, w1 - w0 + 1, 0)
    ends = np.cumsum(spans)
    total = int(ends[-1]) if n else 0
    for at in range(0, total, STEP):
        k = np.arange(at, min(at + STEP, total))
        q = np.searchsorted(ends, k, side="right")
        w = w0[q] + (k - (ends[q] - spans[q]))
        # Lanes outside (q, last[q]) count as passed from the start.
        lo, hi = np.clip(q + 1 - w * 64, 0, 64), np.clip(last[q] - w * 64, 0, 64)
        over = ~(_below(hi) & ~_below(lo))
        counter = [np.zeros(len(k), np.uint64) for _ in range(max(1, radius.bit_length()))]
        fq = fps[q]
        for b in range(64):
            x = planes[b][w] ^ (np.uint64(0) - ((fq >> np.uint64(63 - b)) & np.uint64(1)))
            for n_plane, plane in enumerate(counter):
                counter[n_plane], x = plane ^ x, plane & x
            over |= x
            if b % 8 == 7:
                over |= _above(counter, radius)
                live = over != ALL
                if not live.all():
                    q, w, over, fq, counter = q[live], w[live], over[live], fq[live], [c[live] for c in counter]
                    if not len(q):
                        break
        if len(q):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(near)
            yield q[r], w[r] * 64 + lane


def _below(k: np.ndarray) -> np.ndarray:
    """Words with the lowest k bits set, k from 0 to 64."""
    return np.where(k >= 64, ALL, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose count, given as bit planes from the ones on, is over radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def linked_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n over the links."""
    parent = np.arange(n)
    for i, j in links:
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent
