"""Sorted pairs of small numbers as few bytes: differences in groups of seven bits, compressed, one binary a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHARDS = 512  # a pair's shard depends on both numbers, so that neither a frequent first nor a frequent second one makes a shard heavy
WIDEST = 1 << 23  # numbers below this leave 16 bits beside shard and pair in 63 bits


class Pairs:
    """Pairs ``(u, w)`` of numbers below ``width`` as one number: the shard on top, then the pair within its shard."""

    def __init__(self, width: int):
        if width > WIDEST:
            raise ValueError(f"numbers have to be below {WIDEST}")
        self.low = max(1, ((width - 1) // SHARDS).bit_length())
        self.bits = max(1, (width - 1).bit_length()) + self.low

    def number(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (((u + w) % SHARDS) << self.bits) | (u << self.low) | (w // SHARDS)

    def pair(self, shard: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = within >> self.low
        return u, (within & ((1 << self.low) - 1)) * SHARDS + (shard - u) % SHARDS


def squeeze(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 up as groups of seven bits, lowest first, the last group below 128; and where each number starts."""
    size, most = np.ones(len(numbers), np.uint8), int(numbers.max(initial=0))
    for j in range(7, max(8, most.bit_length()), 7):
        size += numbers >= 1 << j
    starts = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    left, at = numbers, starts
    while len(left):
        more = left > 127
        out[at] = (left & 127) | (more.astype(np.int64) << 7)
        left, at = left[more] >> 7, at[more] + 1
    return out, starts


def expand(raw: np.ndarray) -> np.ndarray:
    """What ``squeeze`` was given."""
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = (raw[starts] & 127).astype(np.int64)
    left, j = np.flatnonzero(ends > starts), 1
    while len(left):
        out[left] |= (raw[starts[left] + j] & 127).astype(np.int64) << (7 * j)
        left, j = left[ends[left] > starts[left] + j], j + 1
    return out


def pack(numbers: np.ndarray, bits: int, counts: np.ndarray | None = None) -> tuple[list[int], list[int], list[bytes]]:
    """Shards, bytes before compression and binaries of sorted ``numbers`` with the shard above ``bits``; ``counts`` follow the differences."""
    edges = np.searchsorted(numbers, np.arange(SHARDS + 1) << bits)
    shards, sizes, out = [], [], []
    for lo in range(0, SHARDS, 32):  # a few shards at a time, to hold little besides the numbers
        edge = edges[lo:lo + 33]
        here = np.flatnonzero(np.diff(edge))
        if not len(here):
            continue
        part, first = numbers[edge[0]:edge[-1]], edge[here] - edge[0]
        steps = np.diff(part, prepend=0)
        steps[first] = part[first] & ((1 << bits) - 1)
        streams = [squeeze(steps)] + ([squeeze(counts[edge[0]:edge[-1]])] if counts is not None else [])
        cuts = [(raw, np.append(starts[first], len(raw))) for raw, starts in streams]
        for i, shard in enumerate(here.tolist()):
            binary = b"".join(raw[cut[i]:cut[i + 1]].tobytes() for raw, cut in cuts)
            shards.append(lo + shard), sizes.append(len(binary)), out.append(pa.compress(binary, codec="zstd", asbytes=True))
    return shards, sizes, out


def added(numbers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``numbers`` in order and how often each is there, or the sums of its ``counts``; without counts, the array given is sorted in place."""
    if counts is None:
        numbers.sort()
    else:
        order = np.argsort(numbers, kind="stable")
        numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[first], np.diff(np.append(first, len(numbers))) if counts is None else np.add.reduceat(counts, first)


def unpack(binary: bytes, size: int, counted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Numbers within the shard of one binary, with their counts if it has any."""
    found = expand(np.frombuffer(pa.decompress(binary, decompressed_size=size, codec="zstd", asbytes=True), np.uint8))
    n = len(found) // 2 if counted else len(found)
    return np.cumsum(found[:n]), found[n:] if counted else None
