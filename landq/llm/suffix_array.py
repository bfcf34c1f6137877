"""Two-stage suffix sorting of one block of bytes, in arrays.

Suffixes smaller than their successor are sorted directly, by their first ``depth`` bytes. All others follow by one
scan over the buckets of first bytes: whoever stands in a bucket puts the suffix one byte before it, if that is larger,
behind those already in its own bucket. The order is that of the first ``depth`` bytes at least; suffixes that agree
in these stand side by side.
"""

from __future__ import annotations

import numpy as np

#: Suffixes whose bytes are laid out side by side at a time.
TOGETHER = 100_000


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the end is smaller than any byte."""
    n = len(text)
    signed = np.append(text.astype(np.int16), np.int16(-1))
    differs = np.where(signed[:-1] != signed[1:], np.arange(n), n - 1)
    turn = np.minimum.accumulate(differs[::-1])[::-1]  # where the run of equal bytes ends
    return signed[turn] < signed[turn + 1]


def sorted_directly(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Some suffixes in order of their first ``depth`` bytes: by eight bytes first, and ties by all of them, so many at a time."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
    keys = words[starts].astype(np.uint64)
    by_key = np.argsort(keys, kind="stable")
    starts, keys = starts[by_key], keys[by_key]
    same = np.flatnonzero(keys[1:] == keys[:-1]) if len(keys) else np.zeros(0, np.int64)
    tied = np.zeros(len(keys), bool)
    tied[same] = tied[same + 1] = True
    places = np.flatnonzero(tied)
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    at = 0
    while at < len(places):
        end = min(at + TOGETHER, len(places))
        while end < len(places) and keys[places[end]] == keys[places[end - 1]]:
            end += 1  # ties stay together
        some = starts[places[at:end]]
        rows = np.ascontiguousarray(windows[some]).view(f"S{depth}").ravel()
        starts[places[at:end]] = some[np.argsort(rows, kind="stable")]
        at = end
    return starts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a block (bytes as uint8) in their order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = sorted_directly(text, np.flatnonzero(smaller_than_next(text)), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in np.flatnonzero(np.bincount(text, minlength=256)):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waves = []
        while len(wave):  # runs of one byte grow by a byte in each wave
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == byte]
        bucket = np.concatenate([*waves, direct[edges[byte] : edges[byte + 1]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        larger = first > byte
        before, first = before[larger], first[larger]
        by_byte = np.argsort(first, kind="stable")
        before, first = before[by_byte], first[by_byte]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for some in np.split(before, cuts) if len(before) else ():
            waiting[text[some[0]]].append(some)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the next in order, counted up to ``depth`` in steps of 8 bytes."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    alive = np.arange(len(common))
    for at in range(0, depth, 8):
        step = min(8, depth - at)
        a, b = words[order[alive] + at], words[order[alive + 1] + at]
        same = a == b if step == 8 else (a ^ b) << np.uint64(64 - 8 * step) == 0
        alive = alive[same]
        common[alive] += step
    return common


def repeated_starts(strings: list[bytes], depth: int) -> list[np.ndarray]:
    """For each string, its starts whose next ``depth`` bytes, all inside the string, occur at another start as well."""
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings) + bytes(depth), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(len(text), bool)
    for a, n in zip(begins, lengths, strict=False):
        inside[a : a + max(0, n - depth + 1)] = True
    order = suffix_order(text, depth)
    group = np.concatenate([[0], np.cumsum(common_prefixes(text, order, depth) < depth)])
    counted = inside[order]
    often = np.bincount(group, weights=counted) >= 2
    hit = np.sort(order[counted & often[group]])
    edges = np.searchsorted(hit, begins)
    return [hit[a:b] - begin for a, b, begin in zip(edges[:-1], edges[1:], begins, strict=False)]
